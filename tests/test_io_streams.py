import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from clausework.operators import leaves as V
from clausework.sources import readers, sinks
from clausework.streaming import jobs


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_json_documents(spark, folder):
    doc = {"document_id": "d1", "title": "T", "pages": [{"text": "甲"}, {"page_no": 7, "text": "乙", "quality": {"avg_score": 0.8}}], "tables": [{"caption": "c", "matrix": [["h"], ["x"]]}]}
    put(f"{folder}/in/a.json", json.dumps(doc, indent=1))
    docs, pages, tables = readers.json_documents(spark, f"{folder}/in")
    assert docs.count() == 1 and tables.count() == 1
    assert [(p["page_no"], p["raw_text"], p["avg_score"]) for p in pages.orderBy("page_no").collect()] == [(1, "甲", None), (7, "乙", 0.8)]


def test_units_and_tolerant_log(spark, folder):
    rows = [{"retrieval_unit_id": "u1", "search_eligible": True}, {"retrieval_unit_id": "u1", "search_eligible": True}, {"retrieval_unit_id": "u2", "search_eligible": False}]
    put(f"{folder}/u.jsonl", "\n".join(json.dumps(r) for r in rows))
    units = readers.jsonl_units(spark, f"{folder}/u.jsonl")
    assert units.count() == 2 and [v["detail"] for v in readers.unit_violations(units).collect()] == ["u1"]
    put(f"{folder}/log.jsonl", '{"a": 1}\nbroken\n{"a": 2}\n')
    assert readers.jsonl_log(spark, f"{folder}/log.jsonl", "a long").count() == 2


def test_markdown_guides(spark, folder):
    put(f"{folder}/g/a.md", "---\nid: g1\nname: \"Guide\"\n---\n# Title\n## Scope\nText [x](http://a)\n## Materials\n| No | Name |\n|---|---|\n| 1 | form |\n")
    guides, sections, rows = readers.markdown_guides(spark, f"{folder}/g")
    g = guides.first()
    assert g["metadata"] == {"id": "g1", "name": "Guide"} and g["title"] == "Title" and g["links"] == ["http://a"]
    assert [s["name"] for s in sections.orderBy("section_no").collect()] == ["Scope", "Materials"]
    assert [r["cells"] for r in rows.orderBy("row_no").collect()] == [["No", "Name"], ["1", "form"]]


def test_registry_and_html(spark):
    html = '<table><tr><td>1</td><td>DZ/T 0430-2023</td><td><a href="/d/1">编写规范</a></td><td>2023-04-19</td><td>2023-08-01</td><td>现行</td></tr></table>'
    row = readers.registry_rows(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (row["number"], row["title"], row["status"], row["detail_path"], row["is_amendment"]) == ("DZ/T0430-2023", "编写规范", "现行", "/d/1", False)
    page = readers.html_pages(spark.createDataFrame([(1, "<title>t</title><script>x</script><p>a &lt;b&gt;</p><article><p>m</p></article>")], "page_id long, html string")).first()
    assert page["main_text"] == "m" and "x" not in page["text"] and "a <b>" in page["text"]


def test_inventory_of_files(spark, folder):
    put(f"{folder}/f/a.bin", "abc")
    declared = spark.createDataFrame([(f"{folder}/f/a.bin",), (f"{folder}/f/missing",)], "path string")
    got = {r["path"].rsplit("/", 1)[-1]: (r["exists"], r["bytes"]) for r in readers.binary_inventory(spark, f"{folder}/f", declared).collect()}
    assert got == {"a.bin": (True, 3), "missing": (False, None)}


def test_ocr_and_wide_pages(spark, folder):
    lines = [{"text": "左一", "score": 0.9, "box": [0, 0, 40, 10]}, {"text": "右一", "score": 0.7, "box": [60, 0, 100, 10]}, {"text": "- 12 -", "score": 0.8, "box": [0, 90, 20, 99]}]
    put(f"{folder}/o/p.json", json.dumps({"document_id": "d", "page_no": 1, "lines": lines}))
    rows, pages = readers.ocr_pages(spark, f"{folder}/o")
    assert abs(pages.first()["avg_score"] - 0.8) < 1e-9
    got = {r["side"]: (r["text"], r["page_label"]) for r in V.wide_page_split(rows).collect()}
    assert got == {"left": ("左一", "12"), "right": ("右一", None)}


def test_page_labels_of_any_length(spark):
    rows = [(d, 1, 0, 90, y, text, 1.0) for d, last in enumerate(("- 12345 -", "12345", "1234", "- 1.5 -")) for y, text in ((0, "x"), (9, last))]
    pages = V.wide_page_split(spark.createDataFrame(rows, "document_id long, page_no int, x1 int, x2 int, y1 int, text string, score double"))
    assert {r["document_id"]: (r["page_label"], r["text"]) for r in pages.collect()} == {0: ("12345", "x"), 1: (None, "x\n12345"), 2: ("1234", "x"), 3: (None, "x\n- 1.5 -")}


def test_merged_cells_are_carried_down(spark):
    t = spark.createDataFrame([(1, "表1", [["类型", "间距"], ["Ⅰ", "100"], ["", "50"]])], "table_id long, caption string, matrix array<array<string>>")
    assert [r["leaf_text"] for r in V.table_row_leaves(t).orderBy("row_no").collect()] == ["表1\n类型：Ⅰ；间距：100", "表1\n类型：Ⅰ；间距：50"]


def test_sinks(spark, folder):
    df = spark.createDataFrame([(1, "secret", "a"), (2, "body", "b")], "id long, text string, kind string")
    sinks.inventory(df, f"{folder}/inv")
    assert spark.read.csv(f"{folder}/inv/csv", header=True).columns == ["id", "kind"]
    sinks.write_checked(df, f"{folder}/w", ["id", "text"])
    assert sinks.read_checked(spark, f"{folder}/w", ["id", "text"]).count() == 2
    df.limit(1).write.mode("overwrite").parquet(f"{folder}/w/data")
    with pytest.raises(ValueError):
        sinks.read_checked(spark, f"{folder}/w", ["id", "text"])


BASE = dt.datetime(2024, 1, 1)


def stream(spark, folder, rows, schema):
    """Write each group of rows as one file, oldest first, and open it as a stream of one file per batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drain(df, folder, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName("q" + os.path.basename(folder).replace("-", "")).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q.name


def test_rate_limit_stream_equals_batch(spark, folder):
    rows = [[("u", BASE + dt.timedelta(minutes=10 * i)) for i in range(k * 6, k * 6 + 6)] for k in range(3)]
    df = stream(spark, folder, rows, "user_id string, ts timestamp")
    name = drain(jobs.rate_limit_stream(df, "user_id", "1 hour", 4, "1 minute"), folder, "append")
    got = {(r["window_start"], r["calls"], r["allowed"], r["rejected"]) for r in spark.table(name).collect()}
    batch = {(r["window_start"], r["calls"], r["allowed"], r["rejected"]) for r in jobs.rate_limit(spark.read.parquet(f"{folder}/in"), "user_id", "1 hour", 4).collect()}
    assert got and got <= batch and len(batch) - len(got) <= 1  # the last window is still open


def test_usage_writer_equals_batch(spark, folder):
    rows = [[("ask", 1.0 * i, BASE + dt.timedelta(minutes=7 * i)) for i in range(k * 5, k * 5 + 5)] for k in range(3)]
    df = stream(spark, folder, rows, "endpoint string, latency double, ts timestamp")
    q = jobs.usage_writer(df, "1 hour", "1 day", f"{folder}/out", f"{folder}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: {(r["window_start"], r["endpoint"], r["calls"], r["latency_sum"]) for r in d.collect()}
    assert key(jobs.current_usage(spark.read.parquet(f"{folder}/out"))) == key(jobs.usage_by_window(spark.read.parquet(f"{folder}/in"), "1 hour"))


def test_ttl_dedup_stream(spark, folder):
    rows = [[("h1", BASE), ("h1", BASE + dt.timedelta(hours=1))], [("h2", BASE + dt.timedelta(hours=2)), ("h1", BASE + dt.timedelta(hours=3))]]
    name = drain(jobs.ttl_dedup_stream(stream(spark, folder, rows, "key string, ts timestamp"), "key", "24 hours"), folder, "append")
    assert sorted(r["key"] for r in spark.table(name).collect()) == ["h1", "h2"]


def test_embed_missing_skips_known(spark, folder):
    df = stream(spark, folder, [[(1, "a")], [(1, "a"), (2, "b")]], "document_id long, text string")
    run = jobs.embed_missing(df, f"{folder}/v", lambda b: b.select("document_id", F.array(F.lit(1.0)).alias("v")), f"{folder}/c3")
    run.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["document_id"] for r in spark.read.parquet(f"{folder}/v").collect()) == [1, 2]


def test_stale_release_stream(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "request_id long, kind string, mode string, units long, ts timestamp"
    minute = lambda m: BASE + dt.timedelta(minutes=m)
    rows = [
        [(1, "open", "quick", 1, minute(0)), (2, "open", "quick", 2, minute(0)), (3, "open", "deep", 3, minute(0))],
        [(2, "settle", "quick", 0, minute(5))],
        [(9, "open", "deep", 1, minute(60))],
        [(9, "open", "deep", 1, minute(120))],
    ]
    try:
        name = drain(jobs.stale_release_stream(stream(spark, folder, rows, schema), 10, "1 minute"), folder, "append")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [tuple(r) for r in spark.table(name).collect()] == [(1, "error", 1)]
