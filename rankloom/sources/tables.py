"""Sources and sinks: pair tables, feature tables, runs of many folds, templates and file manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import CODES

_CHUNK = 1 << 23
_SEPARATOR = {"csv": ",", "tsv": "\t"}


def read_pairs(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A delimited table, every column text and empty fields empty, with the number of each row's line (`source_row`)."""
    names = spark.read.options(header=True, sep=_SEPARATOR[fmt]).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.options(header=True, sep=_SEPARATOR[fmt], multiLine=False).schema(schema).csv(path).na.fill("")


def write_scores(scores: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt == "parquet":
        scores.write.parquet(path)
    else:
        scores.write.options(header=True, sep=_SEPARATOR[fmt]).csv(path)


def read_features(spark: SparkSession, path: str, columns: list[str], schema: T.StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """Only these columns are read, of the types that a schema gives; delimited tables need one. A name that the schema lacks is an error; a field that isn't of its type fails the read."""
    if schema is None and fmt != "parquet":
        raise ValueError("a delimited feature table needs a schema")
    reader = spark.read if schema is None else spark.read.schema(schema)
    table = reader.parquet(path) if fmt == "parquet" else reader.options(header=True, sep=_SEPARATOR[fmt], mode="FAILFAST", enforceSchema=False).csv(path)
    if missing := sorted(set(columns) - set(table.columns)):
        raise ValueError(f"columns that the table lacks: {missing}")
    return table.select(*columns)


def split_filter(table: DataFrame, split: str, column: str = "baseline_split") -> DataFrame:
    """Rows of one split; where the table is partitioned by it, only its files are read."""
    return table.where(F.col(column) == split)


def collect_runs(runs: DataFrame, status: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of completed runs only, columns in order: runs is one table of many files, status names completed ones."""
    done = status.where(F.col("status") == "complete").select(*keys).distinct()
    return runs.join(done, keys, "left_semi").select(*order)


def read_runs(spark: SparkSession, root: str, status: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of completed runs of a folder that is partitioned by run (`root/model_id=A/outer_fold=0/...`), columns in order.

    Files of runs that aren't complete are not opened: completed runs are a filter on all partition columns together, which Spark evaluates on the folder's listing.
    (Pruning by the join alone goes column by column, and would open what only their combination excludes.) The driver holds a row a run, as it does for the listing.
    """
    name = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    done = [r[0] for r in status.where(F.col("status") == "complete").select(name).distinct().collect()]
    return spark.read.parquet(root).where(name.isin(done)).select(*order)


def clean_templates(raw: DataFrame, number: str = "template_no", text: str = "template_sequence") -> DataFrame:
    """Upper-case, letters other than ambiguity codes dropped, groups of nine by number."""
    clean = F.regexp_replace(F.upper(F.col(text)), f"[^{CODES}]", "")
    group = F.format_string("grp_%03d", F.floor((F.col(number) - 1) / 9) + 1)
    return raw.select(F.col(number).cast("int").alias("template_no"), group.alias("template_group_id"), clean.alias("template_sequence_clean"), F.length(clean).alias("template_length"))


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, name = fs.FileSystem.from_uri(quote(path, safe="/:"))
            sha = hashlib.sha256()
            with system.open_input_stream(name) as f:
                while chunk := f.read(_CHUNK):
                    sha.update(chunk)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sha.hexdigest()])], names=["path", "sha256"])


def file_manifest(spark: SparkSession, path: str, whole: int = 1 << 26) -> DataFrame:
    """path, size and SHA-256 of each file below a folder, hashed in tasks.

    Files of at most `whole` bytes are read by Spark. Larger ones are streamed in chunks with a carried digest, so a file of any size takes
    the memory of a chunk; their store must be one that Arrow's file systems open (local, HDFS, S3, GCS). Empty files aren't listed: Spark's scans leave them out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= whole).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", F.col("length").alias("size"))
    # Spark writes file:/x, Arrow wants file:///x
    opened = F.regexp_replace("path", "^file:/(?!/)", "file:///")
    hashed = large.select(opened.alias("path")).repartition("path").mapInArrow(_stream_digests, "path string, sha256 string")
    return small.unionByName(large.join(hashed.withColumnRenamed("path", "__path"), opened == F.col("__path")).select("path", "size", "sha256"))


def verify_manifest(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are missing, unexpected, or of another size or digest."""
    both = expected.alias("e").join(found.alias("f"), F.col("e.path") == F.col("f.path"), "full_outer")
    problem = F.when(F.col("f.path").isNull(), "missing").when(F.col("e.path").isNull(), "unexpected").when(F.col("e.size") != F.col("f.size"), "size").when(F.col("e.sha256") != F.col("f.sha256"), "digest")
    return both.select(F.coalesce("e.path", "f.path").alias("path"), problem.alias("problem")).where("problem is not null")
