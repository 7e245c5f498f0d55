"""Documents from files: text and Markdown, Word, JSON lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "id string, label string, text string, word_count int, source string, register string, era string, date string, court string, model string, prompt_style string, pair_id string, split string"
REGISTERS = {"docx": "document", "md": "markdown", "markdown": "markdown", "txt": "plain-text", "text": "plain-text"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _sample(line: str) -> Column:
    """A line as a sample, with `__bad` where it is none."""
    return F.from_json(line, SAMPLE + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples, one JSON object per line; blank lines are left out, and a malformed one is an error that names its file and quotes it."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S")).select("value", F.input_file_name().alias("file"), _sample("value").alias("s"))
    fields = [c.split()[0] for c in SAMPLE.split(", ")]
    kind = ",".join(c.replace(" ", ":") for c in SAMPLE.split(", "))
    wrong = F.raise_error(F.concat("file", F.lit(": invalid JSON: "), F.substring("value", 1, 80))).cast(f"struct<{kind}>")
    return lines.select(F.when(F.col("s.__bad").isNotNull() | F.col("s.id").isNull(), wrong).otherwise(F.struct(*(F.col(f"s.{f}") for f in fields))).alias("x")).select("x.*")


def invalid_samples(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of the malformed lines, for a report: a file is read whole so that its lines have numbers."""
    each = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "text")).where(F.col("text").rlike(r"\S"))
    bad = each.select("file", (F.col("n") + 1).alias("line"), "text", _sample("text").alias("s"))
    return bad.where("s.__bad is not null or s.id is null").select("file", "line", "text")


def word_text(data: bytes) -> str:
    """The text of a .docx file: runs, tabs and breaks; a blank line behind each paragraph."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out: list[str] = []

    def walk(node) -> None:
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}tab":
            out.append("\t")
        elif node.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
        for child in node:
            walk(child)
        if node.tag == f"{_W}p":
            out.append("\n\n")

    walk(root)
    return "".join(out)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [word_text(c) if p.lower().endswith(".docx") else c.decode("utf-8", "replace") for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), batch.column(2)], names=["path", "text", "modified"])


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, text, register, markdown, modified) of the files in a folder and below, or of one file, by path.
    Hidden and unknown files and blank texts are left out; one file alone of an unknown kind is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(folder)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile() and folder.rpartition(".")[2].lower() not in REGISTERS:
        raise ValueError(f"{folder}: not a file of a known kind ({', '.join(REGISTERS)})")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    files = files.where(ending.isin(*REGISTERS) & ~F.col("path").rlike(r"/\.[^/]*$"))
    texts = files.select("path", "content", F.col("modificationTime").alias("modified")).mapInArrow(_texts, "path string, text string, modified timestamp")
    register = F.coalesce(*(F.when(ending == e, r) for e, r in REGISTERS.items()))
    return texts.where(F.col("text").rlike(r"(?U)\S")).select(F.xxhash64("path").alias("doc_id"), "path", "text", register.alias("register"), (register == "markdown").alias("markdown"), "modified").orderBy("path")
