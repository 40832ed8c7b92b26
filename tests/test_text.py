from pyspark.sql import functions as F

from clausework.functions import ids, spans, text as T
from clausework.operators import evidence as V, segment as S


def one(spark, value, *exprs):
    return spark.createDataFrame([(value,)], "t string").select(*exprs).first()


def test_measurements_take_compound_units_first(spark):
    row = one(spark, "间距80 m，高80米，3m³和4m2，5mg/L，6m。", spans.measurements("t").alias("m"), spans.canonical_text("t").alias("c"))
    assert [(m["raw_text"], m["canonical_text"]) for m in row["m"]] == [("80 m", "80米"), ("80米", "80米"), ("3m³", "3立方米"), ("4m2", "4平方米"), ("6m", "6米")]
    assert all("间距80 m，高80米，3m³和4m2，5mg/L，6m。"[m["char_start"] : m["char_end"]] == m["raw_text"] for m in row["m"])
    assert row["c"] == "间距80米，高80米，3立方米和4平方米，5mg/L，6米。"


def test_page_artifacts_only_at_edges(spark):
    row = one(spark, "- 843 -\n5.1 要求\n12\n正文\n一", T.page_artifacts("t").alias("p"))
    assert row["p"]["clean"] == "5.1 要求\n12\n正文" and row["p"]["removed"] == ["- 843 -", "一"]


def test_short_pages_keep_every_line_once(spark):
    for n in range(1, 7):
        text = "\n".join(f"line {i}" for i in range(n))
        assert one(spark, text, T.page_artifacts("t").alias("p"))["p"]["clean"] == text


def test_fold_and_clean(spark):
    row = one(spark, "Ａ　B\r\n\r\n\r\n\r\nｍ³ ", T.clean_display(T.fold_wide("t")).alias("c"))
    assert row["c"] == "A B\n\nm³"


def test_normalize_folds_full_width(spark):
    assert one(spark, "ＧＢ／Ｔ　１２ ABC", T.normalize("t").alias("n"))["n"] == "gb/t 12 abc"


def test_clause_recognition(spark):
    cases = {"5.2.1 勘查": "5.2.1", "第三条 总则": "第三条", "附录 A": "附录A", "（二）范围": "（二）", "见 6.1 条": "6.1", "按照（6.2.3 要求": None, "plain words": None, "三、要求": "三、"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.infer_clause_no("t").alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == cases


def test_number_and_dates(spark):
    assert one(spark, "dz／t 0430—2023（试行）", T.normalize_number("t").alias("n"))["n"] == "DZ/T0430-2023〔试行〕"
    rows = spark.createDataFrame([("2023年4月9日",), ("2023.13.1",), ("none",)], "t string").select(T.loose_date("t").cast("string").alias("d")).collect()
    assert [r["d"] for r in rows] == ["2023-04-09", None, None]


def test_table_references_limit(spark):
    row = one(spark, "见表A.1～表A.3、表B.2，A.1-A.40", T.table_references("t").alias("r"))
    assert row["r"] == ["A.1", "A.2", "A.3", "B.2"]


def test_long_single_sentence_is_cut_at_commas(spark):
    text = "，".join("字" * 50 for _ in range(3))
    assert len(one(spark, text, T.split_sentences("t").alias("s"))["s"]) == 3


def test_stable_id_treats_null_as_empty(spark):
    row = one(spark, "x", ids.stable_id("u", "t", F.lit(None)).alias("a"), ids.stable_id("u", "t", F.lit("")).alias("b"))
    assert row["a"] == row["b"] and row["a"].startswith("u-") and len(row["a"]) == 18


def test_structural_units_rebuild_the_text(spark):
    text = "前言\n1 范围\n本文件\n5.1 要求\n内容一\n第二条 乙\n末"
    docs = spark.createDataFrame([(1, text)], "document_id long, text string")
    units = S.clause_units(docs).orderBy("unit_order").collect()
    assert "\n".join(u["unit_text"] for u in units) == text
    assert [u["unit_type"] for u in units] == ["front_matter", "section", "clause", "clause"]
    assert [u["section_path"] for u in units] == [None, "1 范围", "1 范围", "1 范围"]


def test_clause_chunks_keep_the_limit(spark):
    docs = spark.createDataFrame([(1, "5.1 要求\n" + "\n".join("字" * 30 for _ in range(20)))], "document_id long, text string")
    chunks = S.clause_chunks(docs, 100).orderBy("piece").collect()
    assert len(chunks) > 1 and all(len(c["chunk_text"]) <= 100 for c in chunks) and chunks[0]["chunk_no"] == "5.1#1"


def test_explicit_blocks(spark):
    rows = spark.createDataFrame([(1, "一、第一组内容的说明\n1. 第一项内容足够长\n2. 第二项内容足够长"), (2, "没有编号的文字\n另一行文字")], "document_id long, text string")
    got = S.explicit_blocks(rows, "text", ["document_id"]).orderBy("block_no").collect()
    assert [(r["document_id"], r["block_no"]) for r in got] == [(1, 1), (1, 2), (1, 3)]
    assert {r["local_heading"] for r in got} == {"一、第一组内容的说明"}


def test_anchor_sequences_need_adjacent_sentences(spark):
    df = spark.createDataFrame([(1, ["甲方负责。", "乙方真实。", "其他。"]), (2, ["甲方负责。", "其他。", "乙方真实。"])], "document_id long, sentences array<string>")
    assert [(r["document_id"], r["quote"]) for r in V.sequence_runs(df, [("甲方",), ("乙方", "真实")]).collect()] == [(1, "甲方负责。乙方真实。")]


def test_quote_window(spark):
    df = spark.createDataFrame([(1, ["无关的一句话。", "短。", "重点句子。", "后续。", "结尾。"])], "document_id long, sentences array<string>")
    assert V.quote_windows(df, ["重点"], 100, 3).first()["quote"] == "...短。重点句子。后续。..."


def test_projection_and_spacing(spark):
    df = spark.createDataFrame([(1, "有限外推按实际工程间距的1/4平推。无限外推取经验工程间距1/2尖推。Ⅰ类型 100~200 m，50 m，80 m，40 m。")], "document_id long, text string")
    facts = V.projection_facts(df).collect()
    assert [(f["kind"], f["ratio"], f["action"], f["basis"]) for f in facts] == [("finite", "1/4", "平推", "实际工程间距"), ("infinite", "1/2", "尖推", "经验工程间距")]
    assert [r["spacing"] for r in V.spacing_matrix(df).orderBy("column_no").collect()] == ["100~200", "50", "80", "40"]


def test_compact_length_without_replacing(spark):
    texts = ["", "a", "ab-c d.e", "\n\n地质 A1\n b", "É é - - -", "x" * 9, "1 2 3 4 5 6 7 8", " 1 2 3 4 5 6 7"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*[(T.holds_compact("t", n) == (F.char_length(T.compact("t")) >= n)).alias(f"n{n}") for n in (1, 5, 7, 8)])
    assert all(all(r) for r in rows.collect())
    assert "regexp_replace" not in S.block_list("t", F.lit(True))._jc.toString()


def test_flags_cut_and_squeeze_few_texts(spark):
    stream = "\n".join(["1.5", "", "ab"] * 20)
    cases = {  # text: (table stream, front matter)
        "表 1 sizes": (True, False), "x\n  续表\tA": (True, False), "x\r表 1": (False, False), "x\n\t表 1": (False, False), "a 表 1": (False, False), "表\n1": (False, False),
        stream: (True, False), "\n".join(["1.5"] * 29): (False, False), "\n".join(["1.5"] * 30): (True, False), "\n" * 40: (False, False), "\n".join(["long enough line"] * 40): (False, False),
        "中华 人民\n共和国 前 言 发布": (False, True), "中华人民共和国 发布": (False, False), "目 录 a......b......c......": (False, True), "目 录 a......": (False, False), "": (False, False),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: (r["a"], r["b"]) for r in df.select("t", T.unstructured_table_flag("t").alias("a"), T.front_matter_flag("t").alias("b")).collect()}
    assert got == cases
    assert T.unstructured_table_flag("t")._jc.toString().count("split(") == 1


def test_compact_signs_are_counted_without_lowering(spark):
    texts = ["ABC-12中", "Kİx", "ÅÄß.,!", "a b c d e f g", "", None, "İİ", "ａｂ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 7):
        r = df.select(T.holds_compact("t", n).alias("a"), (F.char_length(T.compact("t")) >= n).alias("b")).collect()
        assert [x["a"] for x in r] == [x["b"] for x in r]
    assert "lower" not in T.holds_compact("t", 8)._jc.toString()
