"""Word packages (.docx): their parts as columns, and packages with a reviewed document part.

Only the parts that a review changes are written anew; all others keep their bytes and their order.
A package that cannot be read gives a row with its error, not a failed job.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lint, review
from ..rules.model import Options, RuleSet

# Names and kinds of the format's parts.
DOCUMENT, COMMENTS, TYPES, RELATIONS = "word/document.xml", "word/comments.xml", "[Content_Types].xml", "word/_rels/document.xml.rels"
COMMENTS_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"
COMMENTS_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments"
PARTS = "xml string, comments string, error string"


def parts_of(data: bytes) -> dict[str, bytes]:
    """The parts of a package in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()}


def package_of(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)  # the same bytes on every run
    return out.getvalue()


def with_review(parts: dict[str, bytes], xml: str, comments: str | None) -> dict[str, bytes]:
    """The parts with a new document part and, if there are any, its comments, declared and related once."""
    parts = parts | {DOCUMENT: xml.encode("utf-8")}
    if comments is None:
        return parts
    parts |= {COMMENTS: comments.encode("utf-8")}
    types, relations = parts[TYPES].decode("utf-8"), parts[RELATIONS].decode("utf-8")
    if "/word/comments.xml" not in types:
        types = types.replace("</Types>", f'<Override PartName="/word/comments.xml" ContentType="{COMMENTS_TYPE}"/></Types>', 1)
    if COMMENTS_RELATION not in relations:
        free = max((int(n) for n in re.findall(r'Id="rId([0-9]+)', relations)), default=0) + 1
        relations = relations.replace("</Relationships>", f'<Relationship Id="rId{free}" Type="{COMMENTS_RELATION}" Target="comments.xml"/></Relationships>', 1)
    return parts | {TYPES: types.encode("utf-8"), RELATIONS: relations.encode("utf-8")}


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for content in batch.column("content"):
            try:
                parts = parts_of(content.as_py() or b"")
                comments = parts.get(COMMENTS)
                rows.append((parts[DOCUMENT].decode("utf-8"), None if comments is None else comments.decode("utf-8"), None))
            except (zipfile.BadZipFile, KeyError, UnicodeDecodeError, OSError) as e:
                rows.append((None, None, f"{type(e).__name__}: {e}"))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))] if rows else [*batch.columns, *[pa.array([], pa.string())] * 3], names=[*batch.schema.names, "xml", "comments", "error"])


def opened(files: DataFrame) -> DataFrame:
    """`files` (path, content) with the document part `xml`, the part of `comments` and, where there is no document, an `error`."""
    files = files.select("path", "content")
    return files.mapInArrow(_opened, "path string, content binary, " + PARTS)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [content if xml is None else package_of(with_review(parts_of(content), xml, comments)) for content, xml, comments in zip(*(batch.column(c).to_pylist() for c in ("content", "reviewed_xml", "comments_xml")), strict=True)]
        keep = [c for c in batch.schema.names if c not in ("content", "reviewed_xml", "comments_xml")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "content"])


COUNTS = ["applied", "maybe_applied", "annotated", "skipped"]


def reviewed_packages(files: DataFrame, how: review.Review = review.Review(), rules: RuleSet | None = None, options: Options = Options()) -> DataFrame:
    """path, applied, maybe_applied, annotated, skipped, error, content: each package of `files` (path, content) with its review.
    One without findings, or that cannot be read, keeps its bytes."""
    docs = review.projected(opened(files)).withColumn("doc_id", F.xxhash64("path"))
    found = lint.find(docs, rules, options)
    edits = review.edits(found, how, review.max_comment(F.coalesce("comments", F.lit(""))) + 1)
    df = review.reviewed(edits, how, existing="comments")
    untouched = F.col("error").isNotNull() | (F.col("applied") + F.col("annotated") == 0)
    df = df.withColumn("reviewed_xml", F.when(~untouched, F.col("reviewed_xml"))).select("path", *COUNTS, "error", "content", "reviewed_xml", "comments_xml")
    return df.mapInArrow(_closed, "path string, " + ", ".join(f"{c} int" for c in COUNTS) + ", error string, content binary")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row's `content` under its `name` in a folder that driver and executors share (any URI of a file system),
    and gives path and size of what was written. A file is moved into place once it is whole, so a task that runs again does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            paths, sizes = [], []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name!r} is no name of a file in the folder")
                path = posixpath.join(root, name)
                system.create_dir(posixpath.dirname(path), recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write(content)
                system.move(part, path)
                paths.append(path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    return files.select("name", "content").mapInArrow(run, "path string, size long")


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the packages in a folder and below."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(folder).select("path", "content")
