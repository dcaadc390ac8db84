"""Readers: notice tables as CSV, folders of JSON, TeX, zipped projects, word-processor files.

Files are read by Spark's own sources, so any store that the cluster knows will do; what has to be
parsed in Python runs file by file inside the partitions that hold them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import numbered

NOTICE_COLUMNS = (
    "record_id", "title", "subject", "institution", "journal", "publisher", "country", "author", "urls", "article_type",
    "retraction_date", "retraction_doi", "retraction_pmid", "original_date", "original_doi", "original_pmid", "nature", "reason",
    "paywalled", "notes",
)
NOTICE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in NOTICE_COLUMNS])
# Limits of zipped projects.
ZIP_ENTRIES, ZIP_ENTRY_BYTES, ZIP_BYTES = 200, 10 << 20, 50 << 20


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: quoted line breaks and ragged rows allowed, nothing trimmed, missing as ""."""
    raw = spark.read.csv(path, schema=NOTICE_SCHEMA, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return raw.select(*(F.coalesce(c, F.lit("")).alias(c) for c in NOTICE_COLUMNS))


def row_ids(notices: DataFrame, order: list[str]) -> DataFrame:
    """A missing record id becomes row-<n>, n counting from 1 among all rows in the given order."""
    return numbered(notices, order, "_n").withColumn("record_id", F.when(F.col("record_id") == "", F.concat(F.lit("row-"), F.col("_n").cast("string"))).otherwise(F.col("record_id"))).drop("_n")


def open_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a snapshot; a missing one is an error that says what to do."""
    try:
        return spark.read.parquet(f"{path}/{name}")
    except AnalysisException as error:
        raise FileNotFoundError(f"there is no table {name} in the snapshot at {path}: import the notices first (sources.refresh.refresh)") from error


def newest_files(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """(path, modified, length) of the newest files of a folder, newest first; ties by path. Contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), "length")
    return files.orderBy(F.col("modified").desc(), "path").limit(limit)


def snapshot(spark: SparkSession, csv_path: str, readme: str = "") -> DataFrame:
    """One row: digest, length and generation date of a raw snapshot."""
    files = spark.read.format("binaryFile").load(csv_path)
    day = re.search(r"generated on (\d{4}-\d{2}-\d{2})", readme)
    return files.select(F.lit(1).alias("id"), F.sha2("content", 256).alias("csv_sha256"), F.col("length").alias("csv_bytes"), F.lit(day[1] if day else None).cast("string").alias("generated_on"))


def read_json_folder(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A folder of JSON files; unreadable ones are left out."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED")


def strip_latex(text: Column) -> Column:
    """Without comments and commands, their brace argument included."""
    steps = ((r"(?m)(?<!\\)%.*$", " "), (r"\\begin\{[^}]*\}|\\end\{[^}]*\}", " "), (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?", " "), (r"[{}$&~]", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def bib_items(text: Column) -> Column:
    """array<struct<raw, year, doi>> of the items of a thebibliography block."""
    from ..functions.text import extract_doi, extract_year

    raw = F.transform(F.slice(F.split(F.regexp_replace(text, r"(?s)\\end\{thebibliography\}.*$", ""), r"\\bibitem(?:\[[^\]]*\])?\{[^}]*\}"), 2, 100_000), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.transform(raw, lambda x: F.struct(x.alias("raw"), extract_year(x).alias("year"), extract_doi(x).alias("doi")))


def unzip_guarded(content: bytes) -> dict[str, bytes]:
    """Entries of an archive within the limits; parent or absolute paths and nested archives are refused."""
    out, total = {}, 0
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        infos = [i for i in archive.infolist() if not i.is_dir()]
        if len(infos) > ZIP_ENTRIES:
            raise ValueError("too many entries")
        for info in infos:
            name = info.filename.replace("\\", "/")
            if name.startswith("/") or ".." in name.split("/") or re.match(r"[A-Za-z]:", name) or name.lower().endswith(".zip"):
                raise ValueError(f"entry refused: {name}")
            with archive.open(info) as file:
                data = file.read(ZIP_ENTRY_BYTES + 1)
            total += len(data)
            if len(data) > ZIP_ENTRY_BYTES or total > ZIP_BYTES:
                raise ValueError("too large")
            out[name] = data
    return out


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        xml = archive.read("word/document.xml").decode("utf-8", "replace")
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
    return "\n\n".join("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p)) for p in paragraphs)


def extract_files(files: DataFrame) -> DataFrame:
    """Text of files (path, content): docx, tex, zipped projects; others empty, each problem as a warning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                text, warning = "", None
                try:
                    if path.lower().endswith(".docx"):
                        text = docx_text(content)
                    elif path.lower().endswith(".zip"):
                        text = "\n".join(v.decode("utf-8", "replace") for k, v in sorted(unzip_guarded(content).items()) if k.endswith(".tex"))
                    elif path.lower().endswith(".tex"):
                        text = content.decode("utf-8", "replace")
                    else:
                        warning = "unsupported"
                except (ValueError, KeyError, zipfile.BadZipFile) as error:
                    warning = str(error)
                out.append((path, text, warning or (None if len("".join(text.split())) >= 1 else "text_extraction_empty")))
            yield pd.DataFrame(out, columns=["path", "text", "warning"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, warning string")


def upload_status(head: Column, tail: Column, size: Column) -> Column:
    """ok or the reason to refuse an upload, by its first and last bytes."""
    text = lambda c: F.decode(c, "ISO-8859-1")
    first, last = text(head), text(tail)
    pdf = first.startswith("%PDF-")
    word = first.startswith("PK\x03\x04") & first.contains("[Content_Types].xml") & first.contains("word/")
    tex = first.rlike(r"\\(documentclass|begin|section|title)\b")
    return (
        F.when(size > 50 << 20, "too_large").when(pdf & ~last.contains("%%EOF"), "truncated").when(pdf & (first.contains("/Encrypt") | last.contains("/Encrypt")), "encrypted")
        .when(pdf | word | tex | first.startswith("PK\x03\x04"), "ok").otherwise("unsupported")
    )
