"""Literal cases of the cleaning chain, of JSON that must be walked, and of the plans that the operators are meant to have."""

from lakeloom.functions import files, predicates
from lakeloom.functions.text import once
from lakeloom.operators import cleaning, compare, payloads, quality, routing, search, structure
from lakeloom.sources import scratch_folder
from pyspark.sql import functions as F


def lines(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def text_of(rows):
    return cleaning.joined(rows).first()["text"]


def test_ocr_pages(spark):
    pages = ["# Scan", ""]
    for n in range(1, 7):
        pages += [f"## Page {n}", "", str(n), "流水账本", "", f"第 {n} 页的正文写得足够长，因此不会被当作标题来处理。", "", f"流水账本 - {n}", ""]
    out = text_of(cleaning.ocr_pages(lines(spark, "\n".join(pages))))
    assert "## 流水账本" not in out and "<!-- Page 3 -->" in out and "## Page" not in out
    assert "removed repeated OCR header/footer: 流水账本 -->" in out and "removed repeated OCR header/footer: 流水账本 - 6" in out
    assert "removed OCR page number: 1" in out
    scored = quality.scored(spark.createDataFrame([(1, out)], "doc_id long, text string")).first()
    assert scored.page_number_lines == 0 and scored.repeated_noise_lines == 0


def test_first_telling_line_of_a_page_is_its_heading(spark):
    text = "<!-- Page 1 -->\n\n绪论\n\n这一页的正文从这里开始，它比标题长得多，也更详细。\n第二章\n<!-- Page 2 -->\nABC\n后面的文字"
    out = text_of(cleaning.ocr_pages(lines(spark, text))).split("\n")
    assert "## 绪论" in out and "第二章" in out and "ABC" in out


def test_epub_markdown(spark):
    raw = (
        '<nav epub:type="landmarks"><ol><li>Cover</li></ol></nav>\n![](cover.jpg)\n\n- [One](#a)\n- [Two](#b)\n- [Three](#c)\n\n# 正文\n\n<div class="x">\n<st c="1">Some</st> <b>bold</b> and <i>fine</i> text<sup><a href="#n">[1]</a></sup> here.\n</div>\n\n'
        '<span id="p1"></span>\n<img src="x.png" />\n第三章 归途\n\n[返回总目录](#part0000.html#aid-1)\nLast line<br/>broken.\n'
    )
    out = cleaning.epub_documents(spark.createDataFrame([(1, raw)], "doc_id long, text string")).first()["text"]
    assert out.startswith("# 正文") and "landmarks" not in out and "cover.jpg" not in out and "<" not in out
    assert "Some **bold** and *fine* text[^1] here." in out and "## 第三章 归途" in out and "返回总目录" not in out and "Last line\nbroken." in out
    assert out.endswith("\n") and "\n\n\n" not in out


def test_front_matter_goes_only_if_enough_stays(spark):
    imprint = "ISBN 1\nCopyright 2\n定价 3\n发行 4\n"
    text = imprint + "# 正文\n" + "words of the body\n" * 20
    assert text_of(cleaning.without_front_matter(lines(spark, text))).startswith("# 正文")
    long = imprint + "filler line\n" * 800 + "# 正文\nshort"
    assert text_of(cleaning.without_front_matter(lines(spark, long))).startswith("ISBN 1")


def test_chapter_takes_a_short_next_line(spark):
    out = text_of(cleaning.chapters_promoted(lines(spark, "第一章\n风起\n\nbody\n后记\n\n第二章 已有标题\nlong body line follows directly\nand more")))
    assert out.split("\n") == ["## 第一章　风起", "", "body", "## 后记", "", "## 第二章 已有标题", "long body line follows directly", "and more"]


def test_json_of_any_shape_is_walked(spark):
    rows = spark.createDataFrame([(1, '{"a": [{"Token": "x"}, {"b": {"api-key": 3}}], "password": ""}'), (2, "no json"), (3, None)], "id long, j string")
    got = {(r.path, r.name) for r in payloads.json_fields(rows, "id", "j").filter(predicates.credential_name("name") & (F.col("value") != "")).collect()}
    assert got == {("$.a[0].Token", "Token"), ("$.a[1].b.api-key", "api-key")}


def test_names_and_paths(spark):
    v = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert v(files.source_kind(F.lit("a/b.Docx"))) == "docling" and v(files.source_kind(F.lit("a/b"))) == "unsupported"
    assert v(files.format_label(F.lit("x.tar.gz"))) == "GZ" and v(files.format_label(F.lit("x"))) == "UNKNOWN"
    long = "d/" + "n" * 300 + ".epub"
    short = v(files.shortened(F.lit(long), F.lit(long), keep="-v2"))
    assert short.startswith("d/nnn") and short.endswith(".epub") and "-v2-" in short and len(short) < 170
    assert v(files.name_suffix(F.lit(" new name? "))) == "-new-name" and v(files.page_list(F.lit("3-1"))) is None and v(files.page_list(F.lit("2, 4-5"))) == [2, 4, 5]
    assert v(routing.scaled_confidences(F.array(F.lit(42.0), F.lit(0.9), F.lit(-1.0)))) == [0.42, 0.9]


def test_counters_are_made_once(spark):
    docs = spark.createDataFrame([(1, "# a\n\nb " * 300)], "doc_id long, text string")
    plan = quality.queue(quality.scored(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert once(docs, {"n": F.length("text")}).columns == ["doc_id", "text", "n"]


def test_winner_limits_before_the_shuffle(spark):
    rows = spark.createDataFrame([("s", f"p{i}", float(i % 50)) for i in range(200)], "source string, pipeline string, score double")
    out = compare.winner(rows, "source", minimum=10, order=[F.col("pipeline")])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    r = out.first()
    assert (r.pipeline, r.score, r.runner_up, r.margin, r.auto_accept, r.confidence) == ("p149", 49.0, 49.0, 0.0, False, "low")


def test_common_names_are_numbered_in_parts(spark):
    rows = spark.createDataFrame([(i, "Name" if i % 3 else "name") for i in range(500)] + [(900, None)], "id long, name string")
    got = {r.id: r.output for r in compare.disambiguated(rows, "name", "id", parts=7).collect()}
    assert got[0] == "name" and all(got[i] == f"{'Name' if i % 3 else 'name'}-{i + 1}" for i in range(1, 500)) and got[900] is None


def test_index_reads_the_buckets_of_its_terms(spark):
    docs = spark.createDataFrame([(1, "the mit license"), (2, "license of the words"), (3, None), (4, "nothing")], "doc_id long, text string")
    at = scratch_folder(spark, "index")
    search.build_index(docs, at, buckets=8)
    got = search.bm25_of_index(spark, at, "MIT license")
    assert "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString()
    want = {r.doc_id: (r.hits, round(r.score, 9)) for r in search.bm25(docs, "MIT license").collect()}
    assert {r.doc_id: (r.hits, round(r.score, 9)) for r in got.collect()} == want and set(want) == {1, 2}
    assert not search.bm25_of_index(spark, at, " ").count()


def test_next_line_comes_from_a_running_pass(spark):
    rows = structure.line_table(spark.createDataFrame([(1, "a\n\nb\n\n")], "doc_id long, text string"))
    assert [r.n for r in rows.withColumn("n", structure.next_nonblank()).orderBy("pos").collect()] == ["b", "b", None]
