"""Pairs that arrive as a stream, encoded by a static reference: stream-static joins, no state, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sequences import normalize_sequence
from ..operators.features import alignment
from ..operators.history import classes, guide_encoding
from ..functions.sequences import count_char, ungap


def encode_stream(pairs: DataFrame, history: DataFrame, mean: DataFrame) -> DataFrame:
    """pairs (a stream or not) with difference classes and the eleven guide columns of a static history."""
    g, t = normalize_sequence("crRNA_sequence"), normalize_sequence("target_aligned_25")
    rows = pairs.withColumns({"guide": g, "target": ungap(t), "events": alignment(g, t)})
    rows = rows.withColumns({"aligned_difference_count": count_char(F.col("events"), "STG"), "gap_count": count_char(F.col("events"), "TG")})
    return guide_encoding(classes(rows), history, mean)


def write_stream(encoded: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once by the sink's own log."""
    return encoded.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
