"""The stream functions on files, read to the end, against the batch functions."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import graph, store
from tallyforge.sources import documents
from tallyforge.streaming import jobs

SF = "/root/testdata/sf0.001"


def streamed(spark, df_of, source, name, mode):
    q = df_of(source).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_as_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "events"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    got = streamed(spark, lambda s: jobs.window_counts(s, "user_id", "ts"), source, "w", "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, jobs.window_counts(events, "user_id", "ts").collect()))


def test_jobs_as_a_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    first = [(1, t, 1, "claim"), (1, t + dt.timedelta(minutes=1), 2, "succeed"), (2, t, 3, "claim"), (3, t, 4, "cancel"), (3, t, 5, "claim")]
    later = [(9, t + dt.timedelta(hours=5), 6, "claim")]
    last = [(9, t + dt.timedelta(hours=6), 7, "claim")]
    schema = "job_id long, ts timestamp, event_id long, event string"
    for k, rows in enumerate((first, later, last)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = streamed(spark, jobs.track, q, "jobs", "update").collect()
    final = {r.job_id: r for r in out}
    assert final[1].state == "succeeded" and final[3].state == "cancelled" and final[3].n_legal == 1
    assert final[2].state == "retrying" and final[2].lease_expired
    batch = {r.job_id: r.state for r in jobs.fold(spark.createDataFrame(first, schema), "job_id", ["ts", "event_id"]).collect()}
    assert batch == {1: "succeeded", 2: "running", 3: "cancelled"}


@pytest.mark.parametrize("bits", [0, 2, 13])
def test_fold_in_pieces(spark, monkeypatch, bits):
    """A job with most of all events is cut into pieces of any size; the result is that of a loop. Unknown and null events change nothing."""
    monkeypatch.setattr(jobs, "PIECE_BITS", bits)
    r = random.Random(bits)
    kinds = [*sorted({e for _, e, _ in jobs.TRANSITIONS}), "claim", "claim", "release", "expire", "other", None]
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.randint(0, 40), i, r.choice(kinds)) for i in range(400)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "job_id long, ts long, event_id long, event string")
    got = {x.job_id: (x.state, x.n_legal, x.n_events) for x in jobs.fold(df, "job_id", ["ts", "event_id"]).collect()}
    to = {(a, e): b for a, e, b in jobs.TRANSITIONS}
    want = {}
    for job, _, _, event in sorted(rows, key=lambda x: x[1:3]):
        state, legal, n = want.get(job, ("queued", 0, 0))
        want[job] = (to.get((state, event), state), legal + ((state, event) in to), n + 1)
    assert got == want
    assert jobs.fold(df.limit(0), "job_id", ["ts", "event_id"]).count() == 0


def test_every_state_and_event(spark):
    states = sorted({s for s, _, _ in jobs.TRANSITIONS} | {s for _, _, s in jobs.TRANSITIONS})
    events = sorted({e for _, e, _ in jobs.TRANSITIONS})
    df = spark.createDataFrame([(s, e) for s in states for e in events], "state string, event string")
    legal = {(s, e): n for s, e, n in jobs.TRANSITIONS}
    for r in df.select("state", "event", jobs.next_state(F.col("state"), F.col("event")).alias("n")).collect():
        assert r.n == legal.get((r.state, r.event), r.state)


def test_backoff_stays_within_a_quarter(spark):
    rows = [(a, f"{b:02x}") for a in (1, 2, 5, 40) for b in (0, 128, 255)]
    for r in spark.createDataFrame(rows, "a int, u string").select("a", jobs.backoff_ms(F.col("a"), 30, 900, F.col("u")).alias("w")).collect():
        nominal = min(30_000 * 2 ** (r.a - 1), 900_000)
        assert 0.75 * nominal <= r.w <= 1.25 * nominal


def test_store(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, t timestamp")
    seen, after = [], None
    while True:
        got = store.page(df, "t", "k", after, 4).collect()
        seen += [r.k for r in got[:4]]
        if len(got) <= 4:
            break
        after = (got[3].t, got[3].k)
    assert seen == [k for k, _ in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]
    assert store.tenant(df.withColumnRenamed("k", "company_id"), None).count() == 0
    assert spark.range(1).select(store.cursor(F.lit("2024-01-01").cast("timestamp"), F.lit(5)).alias("c")).first().c == "MjAyNC0wMS0wMVQwMDowMDowMC4wMDAwMDB8NQ"


def test_paths_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = {(r.start, r.node) for r in graph.reachable(edges, spark.createDataFrame([("a",), ("x",)], "node string")).collect()}
    assert got == {("a", n) for n in "abcd"} | {("x", "y")}


def archive(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return b.getvalue()


def test_documents(spark, tmp_path):
    sheet = "<worksheet><sheetData><row><c t='s'><v>0</v></c><c><v>12</v></c></row><row></row></sheetData></worksheet>"
    files = {
        "a.docx": archive(word__document_xml="<w:p><w:t>Hej</w:t></w:p><w:p>du</w:p>"), "b.xlsx": archive(xl__workbook_xml="<x/>", xl__sharedStrings_xml="<sst><si><t>Löner</t></si></sst>", xl__worksheets__sheet1_xml=sheet),
        "c.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}L\'f6ner\par 12 \b 500}", "d.json": b'{"net_sales": {"2025": 12}, "ok": true, "rows": ["x", 2]}', "e.csv": b"a;b;c\n1;2;3\n", "f.txt": "sid ett\fsid två".encode(),
        "g.html": b"<!DOCTYPE html><html><p>a</p><td>b</td><td>c</td></html>", "h.bin": b"\x89PNG\r\n", "j.zip": archive(**{"one_txt": "1"}), "k.docx": b"PK\x03\x04broken", "l.dat": b"\xff\xfe\xfa",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {}
    for r in documents.read_documents(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.mime, r.status, r.page, r.text))
    assert got["a.docx"][0][3] == "Hej \ndu" or "Hej" in got["a.docx"][0][3]
    assert got["b.xlsx"] == [("application/xlsx", "ok", 1, "Löner   12")]
    assert "Löner\n12" in got["c.rtf"][0][3] and got["d.json"][0][3] == "net sales 2025   12\nrows   x\nrows   2"
    assert got["e.csv"][0][0] == "text/csv" and [p[2:] for p in sorted(got["f.txt"])] == [(1, "sid ett"), (2, "sid två")]
    assert got["g.html"][0][0] == "text/html" and "b c" in got["g.html"][0][3]
    assert got["h.bin"] == [("image/png", "no_text", 0, "")] and got["k.docx"][0][1] == "unreadable" and got["l.dat"][0][0] == "application/octet-stream"
    assert got["j.zip"][0][3] == "one_txt"
    empty = spark.range(1).select(documents.sniff(F.lit(bytearray()), F.lit("a.txt")).alias("m")).first().m
    assert empty == "application/x-empty"


@pytest.mark.parametrize("raw, want", [("5560160680", "556016-0680"), ("16 556016-0680", "556016-0680"), ("556016-0681", None), ("123", None)])
def test_org_numbers(spark, raw, want):
    from tallyforge.functions import text as tx

    assert spark.range(1).select(tx.org_number(F.lit(raw)).alias("o")).first().o == want
