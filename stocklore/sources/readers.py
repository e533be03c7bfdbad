"""Sources: CSV with encoding probe, spreadsheets-style aliases, JSON lines, text, HTML, file manifests."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_filled
from ..operators.reject_rows import FEED_COLUMNS

# Fixed value: the first bytes of a file that only points at large-file storage.
POINTER = b"version https://git-lfs.github.com/spec/v1"
WESTERN = tuple("".join(x) for x in zip(*((chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))))
CORPUS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in FEED_COLUMNS])

# Accepted column names of enterprise exports, best first.
EXPORT_ALIASES = {
    "description": ("description", "material_description", "text"), "material_code": ("material_code", "code", "matnr"),
    "plant": ("plant", "plant_code"), "uom": ("uom", "unit"), "quantity": ("quantity",),
}


def probe_encodings(spark: SparkSession, path: str) -> dict[str, str]:
    """By file: ``utf-8`` where all of it decodes as such, else ``windows-1252``; a storage pointer raises ValueError.

    Every line is checked, in the executors: line breaks never stand within a UTF-8 character, so files are split like any text.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    start = F.substring(F.col("value").cast("binary"), 1, len(POINTER))
    files = lines.groupBy("file").agg(F.min_by(start, "at").alias("start"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")).collect()
    if any(r.start == POINTER for r in files):
        raise ValueError(f"{path} holds a pointer to large-file storage, not the data")
    return {unquote(r.file): "utf-8" if r.utf8 else "windows-1252" for r in files}


def read_csv(spark: SparkSession, path: str | list[str], encoding: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header, every column STRING, quoted line breaks allowed, doubled quotes; each file's encoding is probed unless given.

    Where a folder's files differ in encoding, those of either one are read together and joined by column name.
    """
    if encoding is None:
        found = probe_encodings(spark, path)
        kinds = sorted(set(found.values())) or ["utf-8"]
        if len(kinds) > 1:
            parts = [read_csv(spark, [re.sub(r"([\\*?\[\]{}])", r"\\\1", f) for f in sorted(found) if found[f] == k], k, schema) for k in kinds]
            return parts[0].unionByName(parts[1], allowMissingColumns=True)
        encoding = kinds[0]
    western = encoding.lower() in ("windows-1252", "cp1252")  # not among the reader's own: read byte for byte, then mapped
    reader = spark.read.options(header=True, multiLine=True, escape='"', encoding="iso-8859-1" if western else encoding, inferSchema=False)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.select(*[F.translate(F.col(f"`{c}`"), *WESTERN).alias(c.translate(str.maketrans(*WESTERN))) for c in rows.columns]) if western else rows


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Enterprise exports with varying column names: canonical columns, ``source`` file and ``metadata`` map of what remains."""
    raw = read_csv(spark, path).withColumn("source", F.input_file_name())
    low = {c.lower(): c for c in raw.columns}
    used = {low[a] for names in EXPORT_ALIASES.values() for a in names if a in low} | {"source"}
    pick = lambda names: first_filled(*[F.col(low[n]) for n in names if n in low]) if any(n in low for n in names) else F.lit("")
    rest = [c for c in raw.columns if c not in used]
    metadata = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull() & (v != "")) if rest else F.create_map().cast("map<string,string>")
    return raw.select("source", *[pick(names).alias(c) for c, names in EXPORT_ALIASES.items()], metadata.alias("metadata"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines of objects; ``strict`` fails at the first bad line, else bad lines stand in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(list(schema.fields))
    return spark.read.schema(full.add("_corrupt_record", T.StringType())).json(path, mode="PERMISSIVE")


def read_documents(spark: SparkSession, path: str, pattern: str = "*.{md,txt,html}") -> DataFrame:
    """Whole text files under a folder: ``path``, ``name``, ``text``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def read_text_lines(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Lines of text files: ``nit_id`` (file name up to the first underscore), ``doc_name``, ``line_no`` from 1, ``line``."""
    docs = read_documents(spark, path, pattern).select(F.split("name", "_")[0].alias("nit_id"), F.col("name").alias("doc_name"), F.posexplode(F.split("text", r"\r\n|\n")).alias("_i", "line"))
    return docs.select("nit_id", "doc_name", (F.col("_i") + 1).alias("line_no"), "line")


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row a file: ``path``, ``bytes``, ``modified``, ``sha256``, ``is_pointer``, ``content_type``, ``lineage``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.lower(F.col("path"))
    kind: Column = F.when(name.endswith(".csv"), "text/csv").when(name.rlike(r"\.jsonl?$"), "application/json").when(name.endswith(".parquet"), "application/parquet").when(name.rlike(r"\.html?$"), "text/html").when(name.rlike(r"\.(?:txt|md)$"), "text/plain").when(name.endswith(".pdf"), "application/pdf").otherwise("application/octet-stream")
    lineage = F.when(name.contains("/raw/"), "raw").when(name.contains("/reference/"), "reference").otherwise("derived")
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, len(POINTER)) == F.lit(bytearray(POINTER))).alias("is_pointer"), kind.alias("content_type"), lineage.alias("lineage"))


def unprocessed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key isn't among those done (resume of an interrupted run)."""
    return items.join(done.select(key).distinct(), key, "left_anti")
