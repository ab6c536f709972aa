"""Markdown files with front matter: scan, parse, validate."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.functions.text import is_blank, unicode_trim
from lexifold.operators.chunking import has_section

# Field names of the front matter, and the closed vocabularies.
FIELDS = {
    "id": "source_id",
    "documentKey": "document_key",
    "title": "title",
    "version": "version",
    "effectiveDate": "effective_date",
    "status": "status",
    "supersedes": "supersedes",
    "category": "category",
}
STATUSES = ("active", "superseded")
CATEGORIES = ("politika", "prosedur", "kilavuz", "sss")

# Files of a folder that a task hands on at a time.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1_024, 1 << 24

_OPENING, _CLOSING = "---\n", "\n---\n"
# Anything that starts in the first column must be "key:", a comment or a list item of an ignored key.
_UNREADABLE_LINE = r"(?m)^(?![A-Za-z0-9_.-]+[ \t]*:([ \t]|$))[^\s#\-\]}]"
# A field of the document has to be one flat value: no block or flow form, anchor, alias or tag, and no line that goes on below.
_KEYS = "|".join(FIELDS)
_NOT_FLAT = rf"(?m)^(?:{_KEYS})[ \t]*:[ \t]+[|>&*!\[{{%@`]"
_GOES_ON = rf"(?m)^(?:{_KEYS})[ \t]*:[^\n]*\n+[ \t]+[^\s#]"


def read_markdown_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``file_name, text`` of every ``*.md`` directly in the folder, one whole file per row.

    Spark's readers pass over files without a byte, so those are not seen, here and in the manifest. They also keep what
    they know of every file in the driver, so a folder of a mounted file system, which all tasks reach, is listed by the tasks:
    each goes through the names and reads the files whose names fall to it.
    """
    mounted = _mounted_folder(spark, folder)
    if mounted is None:
        return _texts(spark.read.text(folder, wholetext=True, pathGlobFilter="*.md"))
    parts = 2 * spark.sparkContext.defaultParallelism
    found = spark.range(0, parts, 1, parts).mapInArrow(_files_of_part(mounted, parts), "file_name string, value binary")
    return found.select("file_name", F.col("value").cast("string").alias("text"))


def _mounted_folder(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder with the scheme ``file``, else null."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() != "file" or not system.exists(path) or not system.getFileStatus(path).isDirectory():
        return None
    return system.makeQualified(path).toUri().getPath()


def _files_of_part(folder: str, parts: int):
    """Names and bytes of the files that fall to a part; hidden ones (as Spark has it) and those without a byte are none."""

    def run(batches: Iterator) -> Iterator:
        import os
        from zlib import crc32

        import pyarrow as pa

        def batch_of(rows: list) -> pa.RecordBatch:
            names, values = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], ["file_name", "value"])

        for part in (i for batch in batches for i in batch.column(0).to_pylist()):
            rows, n_bytes = [], 0
            with os.scandir(folder) as entries:
                for entry in entries:
                    name = entry.name
                    hidden = name[0] == "." or (name[0] == "_" and "=" not in name)
                    if not name.endswith(".md") or hidden or crc32(os.fsencode(name)) % parts != part or not entry.is_file():
                        continue
                    with open(entry.path, "rb") as stream:
                        value = stream.read()
                    if value:
                        rows.append((name, value))
                        n_bytes += len(value)
                    if len(rows) >= ROWS_AT_ONCE or n_bytes >= BYTES_AT_ONCE:
                        yield batch_of(rows)
                        rows, n_bytes = [], 0
            if rows:
                yield batch_of(rows)

    return run


def _texts(files: DataFrame) -> DataFrame:
    """The metadata has names as in a URI: a space is ``%20`` there, but a plus sign is itself."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return files.select(name.alias("file_name"), F.col("value").alias("text"))


def folder_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``file_name, length, modified`` of every ``*.md`` directly in the folder; no file is opened."""
    return spark.read.format("binaryFile").load(folder, pathGlobFilter="*.md").select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.col("modificationTime").alias("modified")
    )


def read_changed_markdown(spark: SparkSession, folder: str, manifest: DataFrame, max_named: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """Texts of the files that are new or differ from a former ``manifest`` in size or time, and the names that are gone.

    Up to ``max_named`` files are opened by their names, and no other; more are joined by name.
    """
    now = folder_manifest(spark, folder)
    changed = now.join(manifest, ["file_name", "length", "modified"], "left_anti").select(F.col("file_name").alias("changed_name"))
    names = [r[0] for r in changed.limit(max_named + 1).collect()]
    if len(names) > max_named:
        texts = read_markdown_folder(spark, folder)
        texts = texts.join(changed, texts["file_name"] == F.col("changed_name"), "left_semi")
    elif names:
        paths = [f"{folder}/" + re.sub(r"([\\\[\]{}*?])", r"\\\1", name) for name in names]  # a name is no pattern
        texts = _texts(spark.read.text(paths, wholetext=True))
    else:
        texts = spark.createDataFrame([], "file_name string, text string")
    return texts, manifest.select("file_name").join(now, "file_name", "left_anti")


def write_markdown_folder(files: DataFrame, folder: str) -> None:
    """One file for each row of ``files`` (file_name, text), written by the tasks; ``folder`` is a URI or path all of them reach.

    A repeated task writes the same files again. Names have to be different, without a separator.
    """

    def write(rows: Iterator) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        system.create_dir(root, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{root}/{row['file_name']}") as stream:
                stream.write((row["text"] or "").encode())

    files.select("file_name", "text").foreachPartition(write)


def canonical_text(text: Column) -> Column:
    """No byte-order mark, LF line ends: the same document hashes the same on every checkout."""
    return F.replace(F.ltrim(text, F.lit("﻿")), F.lit("\r\n"), F.lit("\n"))


def content_hash(canonical: Column) -> Column:
    return F.upper(F.sha2(canonical, 256))


def _field(header: Column, key: str) -> Column:
    raw = F.trim(F.regexp_extract(header, rf"(?dm)^{key}[ \t]*:(?:[ \t]+([^\n]*))?$", 1))
    double_quoted = F.regexp_extract(raw, r'^"((?:[^"\\]|\\.)*)"', 1)
    single_quoted = F.regexp_extract(raw, r"^'((?:[^']|'')*)'", 1)
    plain = F.trim(F.regexp_replace(raw, r"(^|[ \t])#.*$", ""))
    value = (
        F.when(raw.startswith('"'), F.regexp_replace(double_quoted, r'\\(["\\])', "$1"))
        .when(raw.startswith("'"), F.replace(single_quoted, F.lit("''"), F.lit("'")))
        .when(plain.isin("~", "null", "Null", "NULL"), F.lit(None))
        .otherwise(plain)
    )
    trimmed = unicode_trim(value)
    return F.when(trimmed != "", trimmed)


def split_front_matter(files: DataFrame) -> DataFrame:
    """Adds ``canonical``, ``header`` and ``body``; the latter two are null when a delimiter is missing."""
    closing = F.locate(_CLOSING, F.col("canonical"), 4)
    return (
        files.withColumn("canonical", canonical_text(F.col("text")))
        .withColumn("closing", F.when(F.col("canonical").startswith(_OPENING), closing))
        .withColumn("header", F.when(F.col("closing") > 0, F.substr("canonical", F.lit(5), F.col("closing") - 5)))
        .withColumn("body", F.when(F.col("closing") > 0, F.substr("canonical", F.col("closing") + 5)))
    )


def parse_markdown(files: DataFrame) -> DataFrame:
    """``file_name, text`` -> document columns, ``content_hash``, ``body`` and ``error`` (null when well formed).

    ``error`` names the first thing wrong, as ``code`` or ``code:field``.
    """
    split = split_front_matter(files)
    fields = split.select(
        "file_name", "canonical", "closing", "header", "body",
        *[_field(F.col("header"), key).alias(f"raw_{column}") for key, column in FIELDS.items()],
    )
    raw = {column: F.col(f"raw_{column}") for column in FIELDS.values()}
    date = F.when(
        raw["effective_date"].rlike(r"^\d{4}-\d{2}-\d{2}$"),
        F.try_to_timestamp(raw["effective_date"], F.lit("yyyy-MM-dd")).cast("date"),
    )
    repeated = F.lit(False)
    for key in FIELDS:
        repeated = repeated | (F.regexp_count(F.col("header"), F.lit(rf"(?m)^{key}[ \t]*:")) > 1)

    def missing(key: str) -> Column:
        return is_blank(raw[FIELDS[key]])

    error = (
        F.when(F.col("closing").isNull(), "front_matter_missing")
        .when(F.col("closing") == 0, "front_matter_unclosed")
        .when(F.col("header").rlike(_UNREADABLE_LINE) | F.col("header").rlike(_NOT_FLAT) | F.col("header").rlike(_GOES_ON) | repeated, "front_matter_unreadable")
        .when(missing("title"), "field_missing:title")
        .when(~has_section(F.col("body")), "section_missing")
        .when(missing("id"), "field_missing:id")
        .when(missing("documentKey"), "field_missing:documentKey")
        .when(missing("version"), "field_missing:version")
        .when(missing("effectiveDate"), "field_missing:effectiveDate")
        .when(date.isNull(), "date_invalid")
        .when(missing("status"), "field_missing:status")
        .when(~F.lower(raw["status"]).isin(*STATUSES), "status_unknown")
        .when(missing("category"), "field_missing:category")
        .when(~F.lower(raw["category"]).isin(*CATEGORIES), "category_unknown")
    )
    return fields.select(
        "file_name",
        raw["source_id"].alias("source_id"),
        raw["document_key"].alias("document_key"),
        raw["title"].alias("title"),
        raw["version"].alias("version"),
        date.alias("effective_date"),
        F.lower(raw["status"]).alias("status"),
        F.lower(raw["category"]).alias("category"),
        raw["supersedes"].alias("supersedes"),
        content_hash(F.col("canonical")).alias("content_hash"),
        "body",
        error.alias("error"),
    )
