import json

from pyspark.sql import functions as F

from tallyforge.operators import metrics, report
from tallyforge.plans import catalog
from tallyforge.sources import ocr


def test_words_to_rows(spark):
    words = [("Löner", 10, 100, 10), ("12", 200, 102, 10), ("450", 230, 99, 10), ("000", 260, 101, 10), ("Rubrik", 10, 50, 12), ("Kostnader", 10, 130, 10), ("(4", 200, 131, 10), ("100)", 220, 130, 10), ("Resultat", 10, 160, 10), ("-", 190, 160, 10), ("7", 200, 161, 10)]
    df = spark.createDataFrame([(1, "d", 1, *map(lambda x: x, (t, float(a), float(b), float(h)))) for t, a, b, h in words], "company_id long, doc string, page int, text string, left double, top double, height double")
    got = [(r.label, r.amount) for r in ocr.rows_from_words(df).orderBy("row").collect()]
    assert got == [("Rubrik", None), ("Löner", 12_450_000), ("Kostnader", -4100), ("Resultat", -7)]


def test_ocr_fills_only_bare_images(spark):
    pages = spark.createDataFrame([("a", "image/png", 1, ""), ("b", "text/plain", 1, ""), ("c", "image/png", 1, " "), ("c", "image/png", 2, "x")], "path string, mime string, page int, text string")
    found = spark.createDataFrame([(p, 1, "read") for p in "abc"], "path string, page int, ocr_text string")
    assert {(r.path, r.page): (r.text, r.from_ocr) for r in ocr.fill_pages(pages, found).collect()} == {("a", 1): ("read", True), ("b", 1): ("", False), ("c", 1): (" ", False), ("c", 2): ("x", False)}


def test_quantile_of_buckets(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 101)], "k string, v double")
    q = metrics.quantile(metrics.buckets(df, "k", "v", (10.0, 50.0, 100.0)), "k", 0.95).first()
    assert abs(q.value - 95) < 1e-9
    line = metrics.exposition(df.limit(1), F.lit("m"), {"b": F.lit('x"y'), "a": F.lit("1")}, F.lit(2.0)).first().line
    assert line == 'm{a="1",b="x\\"y"} 2'


def test_reports(spark, tmp_path):
    r = catalog.QUERIES["company_reports"](spark, "/root/testdata/sf0.001").first()
    body = json.loads(r.json)
    assert [f["place"] for f in body["findings"]] == list(range(1, len(body["findings"]) + 1)) and r.markdown.startswith("# Company ")
    found = spark.createDataFrame([(1, "r", ["a"], ["q"])], "company_id long, rule_id string, missing array<string>, questions array<string>")
    report.write_findings(found, str(tmp_path))
    assert [x.item for x in spark.read.parquet(str(tmp_path / "evidence")).orderBy("position").collect()] == ["a", "q"]
