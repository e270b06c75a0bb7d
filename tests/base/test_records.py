import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import classified, variants
from tallyforge.operators import decisions, graph, opportunity, retention, tables


def reached(edges):
    out = {}
    for s in {a for a, _ in edges}:
        seen, todo = set(), [s]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in seen:
                    seen.add(b)
                    todo.insert(0, b)
            todo.pop()
        out[s] = seen
    return out


@pytest.mark.parametrize("seed, n, m", [(1, 30, 45), (2, 12, 30), (3, 1300, 1500)])
def test_reach_as_search(spark, seed, n, m):
    """Cycles, self loops, repeated edges, more starts than a block has bits."""
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] if n < 100 else [(i, n + i % 7) for i in range(n)] + [(n, n + 50), (n + 50, n + 51)]
    want = reached(edges) if n < 100 else {i: {n + i % 7} | ({n + 50, n + 51} if i % 7 == 0 else set()) for i in range(n)}
    starts = sorted(want) + [-5]
    df = spark.createDataFrame(edges + edges[:3] + [(None, 1), (1, None)], "src long, dst long")
    found = graph.reach(df, spark.createDataFrame([(s,) for s in [*starts, starts[0], None]], "node long"))
    assert {(x.start, x.node) for x in graph.pairs(found).collect()} == {(s, v) for s in want for v in want[s]}
    assert {x.start: x.n_nodes for x in graph.start_counts(found).collect()} == {s: len(want.get(s, ())) for s in starts}
    by = {}
    for s, v in ((s, v) for s in want for v in want[s]):
        by.setdefault(v, set()).add(s)
    first = {}
    for v in sorted(by):
        first.setdefault(frozenset(by[v]), v)
    assert {(x.node, x["class"], x.n_starts) for x in graph.node_classes(found).collect()} == {(v, first[frozenset(b)], len(b)) for v, b in by.items()}
    found.release()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_starts_share_blocks(spark, kind):
    """Ten neighbours reach each node, so its bits lie in one block or two, not in as many as there are blocks."""
    edges = spark.range(6000).selectExpr(f"cast(100000 + id as {kind}) as src", f"cast(200000 + id div 10 as {kind}) as dst")
    edges = edges.union(spark.range(600).selectExpr(f"cast(200000 + id as {kind})", f"cast(300000 + id as {kind})"))
    starts = edges.where("src < '200000'" if kind == "string" else "src < 200000").select(F.col("src").alias("node"))
    for reread in (False, True):
        found = graph.reach(edges, starts, reread=reread)
        assert found.bits.select("node").distinct().count() == 1200 and found.bits.count() < 1240
        assert {tuple(map(int, x)) for x in graph.pairs(found).collect()} == {(100_000 + s, n + s // 10) for s in range(6000) for n in (200_000, 300_000)}
        found.release()


@pytest.fixture
def in_groups(spark, monkeypatch):
    """3000 starts in three groups of a block, whose bits are watched: rows of rounds that lie there at a time, and of all rounds."""
    monkeypatch.setattr(graph, "GROUP_EDGES", 500)
    there, seen, written, discard = {}, [], graph.written, graph.discard

    def put(df, name, *more):
        t = written(df, name, *more)
        if name == "fresh":
            there[t._tallyforge_path] = t.count()
            seen.append((sum(there.values()), there[t._tallyforge_path]))
        return t

    monkeypatch.setattr(graph, "written", put)
    monkeypatch.setattr(graph, "discard", lambda *tables: (discard(*tables), [there.pop(getattr(t, "_tallyforge_path", ""), None) for t in tables]))
    starts = spark.range(3000).selectExpr("id + 100000 as src")
    first = starts.selectExpr("src", "200000 + (src - 100000) div 10 as dst").union(starts.where("src % 1000 = 0").selectExpr("src", "400000"))
    second = spark.range(300).selectExpr("200000 + id as src", "300000 + id as dst").union(spark.range(5).selectExpr("300000 + id", "200000 + id"))
    found = graph.reach([first, second], starts.select(F.col("src").alias("node")), reread=True)
    yield found, lambda: (max(x for x, _ in seen), sum(x for _, x in seen), there)
    found.release()


def test_counts_group_by_group(in_groups):
    """A node that all groups reach, and cycles; one group's bits are deleted before the next is followed."""
    found, watched = in_groups
    got = {x.start: x.n_nodes for x in graph.start_counts(found).collect()}
    assert got == {100_000 + s: 2 + (s % 1000 == 0) for s in range(3000)}
    most, total, there = watched()
    assert 600 < total and most < 0.6 * total and not there


def test_classes_group_by_group(in_groups):
    found, watched = in_groups
    got = {(x.node, x["class"], x.n_starts) for x in graph.node_classes(found).collect()}
    assert got == {(n + k, 200_000 + k, 10) for n in (200_000, 300_000) for k in range(300)} | {(400_000, 400_000, 3)}
    most, total, there = watched()
    assert 600 < total and most < 0.6 * total and not there


@pytest.mark.parametrize("most", [1 << 19, 0])
def test_pairs_move_no_bits(spark, in_groups, monkeypatch, most):
    """Lists of starts go to the bits, whatever Spark's own limit; too many are joined by a shuffle."""
    found, _ = in_groups
    monkeypatch.setattr(found, "few", most > 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = graph.pairs(found)
        assert ("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()) == (most > 0)
        got = [tuple(x) for x in df.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {(100_000 + s, n + s // 10) for s in range(3000) for n in (200_000, 300_000)} | {(100_000 + s, 400_000) for s in range(0, 3000, 1000)}
    assert len(got) == len(want) and set(got) == want


def test_written_leaves_no_shuffle(spark):
    top = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for t in top for _, _, names in os.walk(t) for f in names if f.startswith("shuffle_")}
    before = files()
    t = tables.written(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "t")
    assert not files() - before and t.count() == 700
    tables.discard(t)


def test_reach_of_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long")
    found = graph.reach(none, spark.createDataFrame([(1,)], "node long"))
    assert graph.pairs(found).count() == 0 and graph.node_classes(found).count() == 0 and [tuple(x) for x in graph.start_counts(found).collect()] == [(1, 0)]


def test_batches_are_put_once(spark, tmp_path):
    path = "file://" + str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    schema = "x int, k string"
    assert tables.rows_of(spark, path, schema).count() == 0
    assert tables.put(df, path, "1", "k") and not tables.put(df, path, "1", "k")
    # a writer that was killed before it published
    df.write.parquet(f"{path}/.pending-2-dead")
    assert sorted(tuple(x) for x in tables.rows_of(spark, path, schema).select("x", "k").collect()) == [(1, "a"), (2, "b")]
    assert tables.put(df, path, "2", "k") and tables.rows_of(spark, path, schema).count() == 4
    assert tables.clear_pending(spark, path) == 0 and tables.clear_pending(spark, path, -10) == 1
    assert tables.rows_of(spark, path, schema).count() == 4
    with pytest.raises(ValueError):
        tables.put(df, path, "a/b")


def test_a_lost_race_leaves_one_batch(spark, tmp_path, monkeypatch):
    """Two writers of one batch that both saw no batch: the first to rename wins."""
    path = "file://" + str(tmp_path / "t")
    df = spark.createDataFrame([(1,), (2,)], "x int")
    real = tables._place
    raced = []

    def place(s, p):
        fs, at = real(s, p)
        if "/_batch=7/" in p and not raced:
            raced.append(1)
            df.write.parquet(f"{path}/_batch=7")
        return fs, at

    monkeypatch.setattr(tables, "_place", place)
    assert not tables.put(df, path, "7")
    assert tables.rows_of(spark, path, "x int").count() == 2


def test_stream_batches_are_put_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), "file://" + str(tmp_path / "t")
    spark.range(10).write.parquet(source)
    for _ in range(2):  # a checkpoint that was lost: the same batch comes again
        check = str(tmp_path / f"check{_}")
        q = spark.readStream.schema("id long").parquet(source).writeStream.foreachBatch(lambda b, i: tables.put(b, path, str(i))).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert tables.rows_of(spark, path, "id long").count() == 10


def test_purge(spark):
    r = random.Random(4)
    keys = {"a": "id", "b": "id", "c": "id"}
    links = [retention.Link("b", "a_id", "a"), retention.Link("c", "b_id", "b"), retention.Link("c", "a_id", "a")]
    a = [(i, r.randrange(10)) for i in range(40)] + [(3, 9), (None, 0)]
    b = [(i, r.choice([None, *range(40)]), r.randrange(10)) for i in range(120)]
    c = [(i, r.choice([None, *range(120)]), r.choice([None, *range(40)])) for i in range(300)]
    t = {"a": spark.createDataFrame(a, "id int, age int"), "b": spark.createDataFrame(b, "id int, a_id int, age int"), "c": spark.createDataFrame(c, "id int, b_id int, a_id int")}
    done = retention.purge(t, keys, links, {"a": F.col("age") > 7, "b": F.col("age") > 8})
    gone_a = {x[0] for x in a if x[1] > 7}
    gone_b = {x[0] for x in b if x[2] > 8 or x[1] in gone_a}
    gone_c = {x[0] for x in c if x[1] in gone_b or x[2] in gone_a}
    assert list(done.kept) == ["c", "b", "a"]
    assert {x.id for x in done.gone["c"].collect()} == gone_c and {x.id for x in done.kept["c"].collect()} == {x[0] for x in c} - gone_c
    assert {x.id for x in done.gone["b"].collect()} == gone_b and done.kept["c"].columns == ["id", "b_id", "a_id"]
    # of the two rows of key 3 the older goes, and with it the children
    assert sorted(done.gone["a"].collect()) == sorted(x for x in t["a"].collect() if x.age > 7)
    assert all(x.n == 0 for x in retention.orphans(done.kept, keys, links).collect())
    assert sum(x.n for x in retention.orphans({**t, "a": t["a"].limit(0)}, keys, links).collect()) > 0
    assert [(x.tab, x.n_kept + x.n_gone) for x in retention.summary(done).orderBy("place").collect()] == [("c", 300), ("b", 120), ("a", 42)]
    with pytest.raises(ValueError):
        retention.deletion_order(["a", "b"], [retention.Link("a", "x", "b"), retention.Link("b", "x", "a")])


def test_patterns(spark):
    cases = {("a.*", "a.b"): True, ("a.*", "a"): False, ("a.*", "a.b.c"): False, ("a.**", "a.b.c"): True, ("a.**", "ab"): False, ("**.c", "c"): True, ("**.c", "a.b.c"): True, ("**.c", "a.bc"): False,
             ("a.**.c", "a.c"): True, ("a.**.c", "a.x.y.c"): True, ("a.**.c", "ac"): False, ("a+b", "aab"): False, ("a+b", "a+b"): True, ("**", "x.y"): True, ("*", "x"): True, ("a.**", "a"): True}
    for (p, path), want in cases.items():
        assert spark.createDataFrame([(path,)], "p string").select(F.col("p").rlike(classified.pattern(p))).first()[0] is want, (p, path)


def test_rendered(spark):
    doc = {"user": {"id": 7, "mail": "x@y"}, "tags": ["a", {"k": None}], "ok": True, "user.id": 9, "empty": {}}
    classes = {"user.id": "public", "user.*": "internal", "tags.**": "internal", "tags": "public", "user_id": "highly_confidential"}
    df = spark.createDataFrame([(i, json.dumps(doc) if i < 5 else None, s) for i, s in enumerate(["metric_label", "log", "error_body", "model_request", "unheard", "log"])], "id int, t string, sink string")
    got = [x.line for x in classified.rendered(df, ["id"], F.parse_json("t"), classes, F.col("sink")).orderBy("id").collect()]
    # user.id is under user.* too, so it is as closed as that
    line = lambda lo, mid, hi: f"empty={mid} ok={mid} tags={lo} tags.k={lo} user.id={lo} user.mail={lo} user_id={hi}"
    h = classified.REDACTED
    assert got[1] == "empty=[redacted] ok=[redacted] tags=a tags.k=null user.id=7 user.mail=x@y user_id=[redacted]"
    assert got[0] == got[4] == line(h, h, h)
    assert got[2] == "empty={} ok=true tags=a tags.k=null user.id=7 user.mail=x@y user_id=[redacted]" and got[3].endswith("user_id=9") and got[5] is None
    adm = spark.createDataFrame([("kind", 0), ("kind", 1), ("user_id", 0), (None, 0)], "n string, l int")
    assert [x[0] for x in adm.select(classified.admitted(F.col("n"), F.col("l"))).collect()] == [True, False, False, False]


def test_lines_are_not_joined_to_their_rows(spark):
    """A join would broadcast all lines where the files of their leaves are small."""
    df = spark.range(50).select("id", F.to_variant_object(F.struct(F.lit("a").alias("k"))).alias("t"))
    made = classified.rendered(df, ["id"], F.col("t"), {"k": "public"}, F.lit("log"))
    flat = variants.flat_lines(df.select("id", F.to_json("t").alias("t")), "id", F.col("t"))
    for x in (made, flat):
        assert x.count() == 50 and "Join" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_every_role_permission_and_level(spark):
    may = {"owner": set(decisions.PERMISSIONS), "advisor": set(decisions.ADVISOR), "member": {*decisions.ADVISOR, "update_company", "delete_document"}}
    rows = [x for x in itertools.product(["owner", "member", "advisor", "guest", None], [*decisions.LEVELS, None, "odd"], [*decisions.PERMISSIONS, "fly"], [*decisions.LEVELS, None])]
    grants = spark.createDataFrame([(r, p) for r, ps in decisions.GRANTS.items() for p in ps], "role string, permission string")
    inherits = spark.createDataFrame([(r, p) for r, ps in decisions.INHERITS.items() for p in ps] + [("advisor", "advisor")], "role string, parent string")
    got = decisions.decided(spark.createDataFrame(rows, "role string, held string, permission string, required string"), decisions.closed_grants(grants, inherits, decisions.PERMISSIONS))
    assert got.count() == len(rows) and got.columns == ["role", "held", "permission", "required", "decision"]
    for x in got.collect():
        held = decisions.LEVELS.index(x.held) if x.held in decisions.LEVELS else 0
        required = decisions.LEVELS.index(x.required) if x.required else 2
        assert x.decision == ("role_insufficient" if x.permission not in may.get(x.role, ()) else "verification_insufficient" if held < required else "allowed")


def test_roles_inherit_over_cycles(spark):
    grants = spark.createDataFrame([("c", "p"), ("d", "q")], "role string, permission string")
    inherits = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "role string, parent string")
    assert {tuple(x) for x in decisions.closed_grants(grants, inherits, ["p", "q"]).collect()} == {(r, p) for r in "abc" for p in "pq"} | {("d", "q")}


def test_channels(spark):
    notices = spark.createDataFrame([(1, 1, "analysis_failed"), (2, 2, "analysis_failed"), (3, None, "analysis_failed"), (4, 1, "security_alert"), (5, 3, "analysis_failed"), (6, 1, "unheard"), (7, 1, None)], "id int, user_id int, kind string")
    wishes = spark.createDataFrame([(1, "analysis_failed", ["fax", "email"]), (2, "analysis_failed", []), (1, "security_alert", [])], "user_id int, kind string, channels array<string>")
    defaults = spark.createDataFrame(list(decisions.CHANNELS.items()), "kind string, channels array<string>")
    got = {x.id: (x.channels, x.suppressed) for x in decisions.channels(notices, defaults, wishes, ["email", "push", "in_app"]).collect()}
    assert got == {1: (["email"], False), 2: ([], True), 3: (["push", "email"], False), 4: (["email", "push"], False), 5: (["push", "email"], False), 6: ([], True), 7: ([], True)}


def opportunities(spark):
    finding = "company_id int, tax_year int, rule_id string, category string, effect string, risk string, outcome string, low long, high long, missing array<string>, questions array<string>"
    found = spark.createDataFrame([
        (1, 2024, "money", "tax", "reduction", "low", "matched", 0, 20_000_000, [], []), (1, 2024, "gap", "costs", "reduction", "medium", "indeterminate", None, None, ["wages", "odd"], ["in_group"]),
        (2, 2024, "money", "tax", "reduction", "low", "matched", 0, 100, [], []), (2, 2024, "peril", "risk", "reduction", "high", "matched", None, None, [], []), (3, 2024, "unheard", "tax", "reduction", "low", "matched", 1, 2, [], []),
    ], finding)
    readings = spark.createDataFrame([(1, "a", 5, 11, 1, "x"), (1, "b", 6, 12, None, "y"), (2, "b", 7, 13, 2, "z"), (1, "wages", 8, 14, 1, "w")], "company_id int, kind string, value_ore long, fact_id long, page int, source_text string")
    rule = "rule_id string, version string, title string, description string, action string, referenced array<string>, source_ids array<string>, method string, effort string, urgency string, relevance double, reviewed boolean, note string, hints array<string>"
    rules = spark.createDataFrame([
        ("money", "1", "M", "Money.", "Do.", ["b", "a"], ["s2", "s1", "gone"], "formula", "low", "now", 1.0, True, "never said", []), ("gap", "1", "G", "Gap.", "Do.", ["a"], ["s1"], None, "low", "normal", 1.0, False, "not reviewed", ["in_group", "hint"]),
        ("peril", "1", "P", "Peril.", "Do.", ["b"], ["s3"], None, "low", "normal", 1.0, True, "", None),
    ], rule)
    sources = spark.createDataFrame([("s1", "First", "verified"), ("s2", "Second", "verified"), ("s3", "Third", "mismatch")], "source_id string, reference string, state string")
    verdicts = spark.createDataFrame([(1, "money", 0.2, True, "but", ["more"], True), (2, "money", 0.9, False, "wrong", [], False)], "company_id int, rule_id string, objection double, survives boolean, reasoning string, lacks array<string>, corroborated boolean")
    return opportunity.records(found, readings, rules, sources, verdicts)


def test_records(spark):
    got = {(x.company_id, x.rule_id): x for x in opportunities(spark).collect()}
    assert set(got) == {(1, "money"), (1, "gap"), (2, "money"), (2, "peril")} and len({x.opportunity_id for x in got.values()}) == 4
    m = got[1, "money"]
    assert [(e.kind, e.name, e.value_ore) for e in m.evidence] == [("document_value", "b", 6), ("document_value", "a", 5), ("rule", "money", None), ("calculation", "formula", None), ("model_judgement", "opportunity_discovery", None)]
    assert m.evidence[2].source == "Second; First" and (m.evidence[3].low, m.evidence[3].high) == (0, 20_000_000)
    # one of two readings has a page: .125 + .25 + .15 + .15 + .1 * .8 + .1
    assert m.confidence == 86 and m.status == "identified" and m.rationale == "Money. Invändning att beakta: but" and m.missing == ["more"] and m.band == "high"
    g = got[1, "gap"]
    assert [e.kind for e in g.evidence] == ["document_value", "rule", "assumption"] and g.evidence[2].statement == "not reviewed" and g.status == "investigate" and g.low == g.high == 0
    assert g.missing == ["uppgift saknas: wages", "uppgift saknas: odd", "in_group", "hint", "in_group"] and g.rationale == "Gap. wages, odd, in_group."
    assert got[2, "money"].status == "rejected" and got[2, "money"].rejection_reason == "wrong" and got[2, "money"].confidence <= 49 and got[2, "money"].rationale == "Money."
    assert got[2, "peril"].status == "warning" and got[2, "peril"].missing == []


def test_a_finding_of_no_year_has_its_readings(spark):
    """Findings pick from their company's row of readings, whatever year they are of; readings of other kinds and companies stay out."""
    found = spark.createDataFrame([(1, None, "r", "tax", "reduction", "low", "matched", 0, 100, [], [])], "company_id int, tax_year int, rule_id string, category string, effect string, risk string, outcome string, low long, high long, missing array<string>, questions array<string>")
    readings = spark.createDataFrame([(1, "a", 5, 11, 1, "x"), (1, "c", 6, 12, 1, "y"), (2, "b", 7, 13, 2, "z"), (1, None, 8, 14, 1, "w")], "company_id int, kind string, value_ore long, fact_id long, page int, source_text string")
    rules = spark.createDataFrame([("r", "1", "R", "Rule.", "Do.", ["b", "a"], ["s1"], "formula", "low", "normal", 1.0, True, "", [])], "rule_id string, version string, title string, description string, action string, referenced array<string>, source_ids array<string>, method string, effort string, urgency string, relevance double, reviewed boolean, note string, hints array<string>")
    sources = spark.createDataFrame([("s1", "First", "verified")], "source_id string, reference string, state string")
    verdicts = spark.createDataFrame([], "company_id int, rule_id string, objection double, survives boolean, reasoning string, lacks array<string>, corroborated boolean")
    (x,) = opportunity.records(found, readings, rules, sources, verdicts).collect()
    # one of two readings is there: .125 + .25 + .15 + .15 + .1 + .05
    assert [(e.kind, e.name, e.fact_id) for e in x.evidence] == [("document_value", "a", 11), ("rule", "r", None), ("calculation", "formula", None)] and x.confidence == 83


def test_adjacent_once(spark):
    df = spark.createDataFrame([(["a", "a", "b", "a", None, None, "b"],), ([],)], "x array<string>")
    assert [x[0] for x in df.select(opportunity.adjacent_once(F.col("x"))).collect()] == [["a", "b", "a", None, "b"], []]


def test_records_are_stored_once(spark, tmp_path):
    found, path = opportunities(spark), "file://" + str(tmp_path)
    evidence = opportunity.evidence_rows(found)
    # killed after the first table
    tables.put(found.drop("evidence"), f"{path}/opportunities", "run1")
    assert opportunity.store(found, path, "run1") == ["evidence", "calculations"] and opportunity.store(found, path, "run1") == []
    assert spark.read.parquet(f"{path}/opportunities").count() == 4 and spark.read.parquet(f"{path}/calculations").count() == 2
    rows = spark.read.parquet(f"{path}/evidence")
    assert rows.count() == evidence.count() == sum(len(x.evidence) for x in found.collect())
    first = rows.where("position = 0").collect()
    assert all(None not in json.loads(x.item).values() for x in first)
    calc = {x.low: x.inputs for x in opportunity.calculation_rows(found).where("high > 1000").collect()}
    assert [(i.name, i.value_ore) for i in calc[0]] == [("b", 6), ("a", 5)]


def test_facts_are_as_sure_as_their_pages(spark):
    """Recognised pages count less, and all of a document that is half blank."""
    from tallyforge.sources.documents import statement_facts

    line = "Summa tillgångar 1 000"
    pages = spark.createDataFrame([(1, "a", 1, line, False), (1, "a", 2, " \n\t ", False), (1, "b", 1, line, True), (1, "b", 2, "x", None), (2, "c", 1, line, None), (2, "c", 2, None, True)], "company_id int, doc string, page int, text string, ocr boolean")
    assert {(x.company_id, x.doc): round(x.confidence, 6) for x in statement_facts(pages).collect()} == {(1, "a"): 0.475, (1, "b"): 0.45, (2, "c"): 0.475}
    assert {round(x.confidence, 6) for x in statement_facts(pages.drop("ocr")).where("doc = 'b'").collect()} == {0.95}


def test_queue_repeats_and_gaps(spark):
    """The first of several results counts, kinds without a lease raise, and a null list of channels is empty."""
    from tallyforge.operators import queue

    now = F.lit("2024-01-01").cast("timestamp")
    job = "job_id int, kind string, state string, attempt int, max_attempts int, run_after timestamp, leased_until timestamp, leased_by string"
    jobs = spark.createDataFrame([(1, "a", "running", 1, 3, None, None, "w"), (2, "a", "running", 1, 3, None, None, "w")], job)
    results = spark.createDataFrame([(1, True, False, None, 2), (1, False, True, "first", 1), (2, True, False, None, 5), (2, True, False, None, 5)], "job_id int, ok boolean, permanent boolean, error string, at int")
    after, log, _ = queue.finish(jobs, results, now)
    assert {x.job_id: x.state for x in after.collect()} == {1: "failed", 2: "succeeded"} and log.count() == 2 and after.columns == jobs.columns
    with pytest.raises(ValueError, match="kind b"):
        queue.claim(jobs, now, spark.createDataFrame([("b", "w")], "kind string, worker string"), {"a": 5})
    notes = spark.createDataFrame([(1, "delivering", 1, 3, None, None, ["email", "push"]), (2, "delivering", 1, 3, None, ["email"], ["email", "push"])], "note_id int, state string, attempt int, max_attempts int, run_after timestamp, delivered array<string>, channels array<string>")
    outcomes = spark.createDataFrame([(1, ["push"], None), (2, None, "lost")], "note_id int, went array<string>, error string")
    assert {x.note_id: (x.delivered, x.state) for x in queue.record_delivery(notes, outcomes, now).collect()} == {1: (["push"], "delivered"), 2: (["email"], "pending")}
