"""Sources and sinks: file scans, lenient readers, delimited and Markdown tables, converters as injected functions."""

from __future__ import annotations

import csv
import io
import re
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import file_name, is_hidden, natural_key, strip, suffix

# Suffixes by the engine that converts them.
KINDS = {
    "pandoc": (".epub", ".fb2", ".odt", ".txt"),
    "calibre": (".azw", ".azw3", ".mobi", ".rtf"),
    "pdf": (".pdf",),
    "docling": (".docx", ".pptx", ".xlsx", ".html", ".htm", ".md", ".csv", ".tsv"),
    "image": (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff"),
}


def scan(spark: SparkSession, folder: str, *, recursive: bool = True, hidden: bool = False, content: bool = False) -> DataFrame:
    """path, name, suffix, kind, length, modified (and content) of the files of a folder; hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    rows = files.select("path", file_name("path").alias("name"), suffix("path").alias("suffix"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    rows = rows.withColumn("kind", source_kind(F.col("suffix")))
    return rows if hidden else rows.filter(~is_hidden("path"))


def source_kind(suffix_col: Column) -> Column:
    """Engine kind of a suffix: one lookup in a literal map."""
    pairs = [x for kind, names in KINDS.items() for s in names for x in (F.lit(s), F.lit(kind))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix_col), F.lit("unsupported"))


def plan(files: DataFrame, out_dir: str, extension: str = ".md") -> DataFrame:
    """Dry-run plan of a scan: where each file's output goes and whether it is supported, in natural order of names."""
    stem = F.regexp_replace(F.regexp_replace("name", r"\.[^.]+$", ""), r'[<>:"/\\|?*\x00-\x1f]+', "_")
    stem = F.coalesce(F.nullif(strip(stem), F.lit("")), F.lit("converted-book"))
    long = F.length(stem) > 150
    short = F.concat(F.substring(stem, 1, 120), F.lit("-"), F.substring(F.sha1(F.col("path").cast("binary")), 1, 10))
    output = F.concat(F.lit(out_dir.rstrip("/") + "/"), F.when(long, short).otherwise(stem), F.lit(extension))
    return files.withColumns({"output": output, "status": F.when(F.col("kind") == "unsupported", "unsupported").otherwise("planned"), "sort_key": natural_key("name")})


def decode_bytes(data: bytes) -> tuple[str, str]:
    """(encoding, text) by byte-order mark, then by the first codec that fits."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name, data.decode(name, "replace")
    for name in ("utf-8", "gb18030", "big5", "utf-16"):
        try:
            return name, data.decode(name)
        except UnicodeDecodeError:
            continue
    return "utf-8", data.decode("utf-8", "replace")


def decoded(files: DataFrame, column: str = "content") -> DataFrame:
    """files with encoding and text."""

    @F.pandas_udf("struct<encoding: string, text: string>")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_bytes(bytes(b)) if b is not None else ("utf-8", "") for b in content], columns=["encoding", "text"])

    return files.withColumn("_d", run(column)).select(*files.columns, "_d.encoding", "_d.text")


def delimited_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, row (from 0), cells of delimited texts: delimiter sniffed in each, cells trimmed, ragged rows padded."""

    def of_text(value: str) -> list[list[str]]:
        try:
            dialect = csv.Sniffer().sniff(value[:4096], delimiters=",;\t")
        except csv.Error:
            dialect = csv.excel
        rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(value), dialect)]
        width = max(map(len, rows), default=0)
        return [r + [""] * (width - len(r)) for r in rows]

    def run(frames):
        for pdf in frames:
            out = [(k, i, r) for k, t in zip(pdf[key], pdf[text], strict=True) for i, r in enumerate(of_text(t or ""))]
            yield pd.DataFrame(out, columns=[key, "row", "cells"])

    return texts.select(key, text).mapInPandas(run, T.StructType([texts.schema[key], T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))]))


def markdown_table(rows: DataFrame, key: str) -> DataFrame:
    """key, markdown of rows (key, row, cells): the first row heads the table, empty heads are `Column N`."""
    safe = F.transform("cells", lambda c, i: F.replace(F.when((F.col("row") == 0) & (c == ""), F.concat(F.lit("Column "), i + 1)).otherwise(c), F.lit("|"), F.lit("\\|")))
    line = F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.lit("---")), " | "), F.lit(" |"))
    lined = rows.select(key, "row", F.when(F.col("row") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"])
    return lined.groupBy(key).agg(F.array_join(ordered, "\n").alias("markdown"))


def split_table_row(line: Column) -> Column:
    """Cells of a Markdown table row: outer pipes dropped, escaped pipes kept."""
    inner = F.regexp_replace(strip(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank, malformed and non-object lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def recognised(pages: DataFrame, recogniser: Callable[[bytes], str], content: str = "content") -> DataFrame:
    """pages with text, status and message of an injected recogniser (OCR or VLM); a failure is that row's status."""

    def run(frames):
        for pdf in frames:
            texts, states, notes = [], [], []
            for data in pdf[content]:
                try:
                    texts.append(recogniser(bytes(data)))
                    states.append("ok")
                    notes.append("")
                except Exception as e:  # the row carries it on
                    texts.append("")
                    states.append("failed")
                    notes.append(str(e)[:500])
            yield pdf.drop(columns=[content]).assign(text=texts, ocr_status=states, ocr_message=notes)

    kept = [f for f in pages.schema.fields if f.name != content]
    more = [T.StructField(n, T.StringType()) for n in ("text", "ocr_status", "ocr_message")]
    return pages.mapInPandas(run, T.StructType(kept + more))


def tesseract_words(rows: DataFrame) -> DataFrame:
    """Word blocks of Tesseract TSV rows: text, box, confidence in 0..1 (null if negative)."""
    conf = F.try_to_number(F.col("conf").cast("string"), F.lit("S999.999999")).cast("double")
    conf = F.coalesce(F.col("conf").try_cast("double"), conf)
    words = rows.filter((F.col("level").cast("int") == 5) & (strip("text") != ""))
    x, y, w, h = (F.col(c).cast("double") for c in ("left", "top", "width", "height"))
    return words.select(strip("text").alias("text"), F.array(x, y, x + w, y + h).alias("bbox"), F.when(conf >= 0, F.least(F.lit(1.0), conf / 100)).alias("score"))


def scratch_folder(spark, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a local one where all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lakeloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
