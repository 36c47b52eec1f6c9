"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from a text's bytes and word codes, for a whole slice of texts at once (`statistics`). Trees
are fitted on at most `most` labelled rows (a bounded sample: those with the smallest hashes of their ids), with
features in at most 64 bins and gradient histograms by bin; every tree is stored in arrays (feature, threshold, left,
right, value), and scoring walks all texts down all trees with numpy indexing. Id, language, source and labels are
never inputs of a score.

A null or empty text has statistics like any other (all counts 0) and gets a score. Labels that are null, or rows
whose id is null, teach nothing; several labels of one id count as the lowest, and of several
documents of one id the one with the smallest statistics teaches. Repeated documents are scored each for itself. With labels of one kind only, or none, the score is the labels' mean (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship
from .textcodes import Texts, mix, slices, words

FOLDS = 5
MOST_LABELLED = 20_000
THRESHOLD = 0.3
NAMES = (
    "bytes", "words", "bytes_per_word", "upper", "digits", "space", "newlines", "stops", "bars", "symbols", "marks", "beyond_ascii",
    "distinct_words", "same_as_last_word", "distinct_pairs", "top_word", "longest_word", "short_words", "capital_words", "words_per_line", "distinct_lines", "longest_line",
)

_CLASSES = ("other", "upper", "lower", "digit", "space", "newline", "stop", "bar", "symbol", "mark", "beyond")
_CLASS = np.zeros(256, np.uint8)
for _name, _bytes in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t"), ("newline", b"\n\r"), ("stop", b".,;:?"), ("bar", b"|"), ("symbol", b"#$%&*@^~<>{}[]\\_=+"), ("mark", b"!"), ("beyond", range(128, 256))):
    _CLASS[list(_bytes)] = _CLASSES.index(_name)


def _distinct(codes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each text, and its largest count of one code."""
    _, first, count = np.unique(mix(codes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, text[first], count)
    return np.bincount(text[first], minlength=n), most


def statistics(texts: Texts) -> np.ndarray:
    """A row of NAMES for each text."""
    n, size = texts.hi - texts.lo, np.diff(texts.offsets)
    of = np.repeat(np.arange(n), size)
    kind = _CLASS[texts.data]
    by = np.bincount(of * len(_CLASSES) + kind, minlength=n * len(_CLASSES)).reshape(n, -1)
    share = by / np.maximum(size, 1)[:, None]
    w = words(texts)
    count = np.diff(w.bounds)
    text, length = np.repeat(np.arange(n), count), w.end - w.start
    some = np.maximum(count, 1)
    distinct, top = _distinct(w.codes, text, n)
    inner = text[1:] == text[:-1]
    same = np.bincount(text[1:][inner & (w.codes[1:] == w.codes[:-1])], minlength=n)
    pairs, _ = _distinct((w.codes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w.codes[1:])[inner], text[1:][inner], n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, text, length)
    short, capital = np.bincount(text[length <= 2], minlength=n), np.bincount(text[(kind[w.start] == 1)], minlength=n)
    # lines: from a line feed, or a text's first byte, on; a line's code is the sum of its words' codes
    begins = np.unique(np.concatenate([np.flatnonzero(texts.data == 10), texts.offsets[:-1][size > 0]]))
    line_of = of[begins]
    lines = np.bincount(line_of, minlength=n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.codes), dtype=np.uint64)])
    at = np.searchsorted(w.start, np.append(begins, len(texts.data)))
    different, _ = _distinct(sums[at[1:]] - sums[at[:-1]], line_of, n)
    widest = np.zeros(n, np.int64)
    np.maximum.at(widest, line_of, np.diff(np.append(begins, len(texts.data))))
    c = {name: share[:, i] for i, name in enumerate(_CLASSES)}
    return np.column_stack([
        np.log1p(size), np.log1p(count), size / some, c["upper"], c["digit"], c["space"], c["newline"], c["stop"], c["bar"], c["symbol"], c["mark"], c["beyond"],
        distinct / some, same / some, pairs / some, top / some, longest, short / some, capital / some, count / np.maximum(lines, 1), different / np.maximum(lines, 1), np.log1p(widest),
    ])


@dataclass
class Trees:
    """Trees as arrays of nodes: a leaf's feature is -1; roots are where trees begin."""

    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    depth: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                low = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(f < 0, node, np.where(low, self.left[node], self.right[node]))
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 3.0) -> Trees:
    """Boosted trees for labels y (0 or 1) of rows x, by logistic loss; without rows, or with labels of one kind, the labels' mean (0.5 without any)."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Trees(float(np.log(mean / (1 - mean))))
    if not len(y) or y.min() == y.max():
        return model
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])  # bin <= b means x <= edges[b]
    raw = np.full(n, model.base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    slot = (np.arange(k) * bins)[None, :] + binned
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(n))]
        for level in range(depth + 1):
            below = []
            for i, rows in open_nodes:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[i] = float(-rate * gs / (hs + ridge))
                if level == depth or len(rows) < 2 * least:
                    raw[rows] += value[i]
                    continue
                at = slot[rows].ravel()
                gh = np.bincount(at, np.repeat(g[rows], k), k * bins).reshape(k, bins).cumsum(1)
                hh = np.bincount(at, np.repeat(h[rows], k), k * bins).reshape(k, bins).cumsum(1)
                nh = np.bincount(at, minlength=k * bins).reshape(k, bins).cumsum(1)
                gain = gh**2 / (hh + ridge) + (gs - gh) ** 2 / (hs - hh + ridge) - gs**2 / (hs + ridge)
                gain[(nh < least) | (len(rows) - nh < least)] = -1
                j, b = divmod(int(gain.argmax()), bins)
                if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                    raw[rows] += value[i]
                    continue
                feature[i], threshold[i] = j, float(edges[j][b])
                low = binned[rows, j] <= b
                left[i], right[i] = node(), node()
                below += [(left[i], rows[low]), (right[i], rows[~low])]
            open_nodes = below
    return Trees(model.base, np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth)


def fold(id_column):
    """0 to FOLDS - 1; rows of fold 0 are held out."""
    return F.crc32(id_column.cast("string")) % FOLDS


def held_out(id_column):
    """Whether a row teaches nothing by its id's remainder; one without an id has none, and nothing is learnt from it either way."""
    return F.coalesce(fold(id_column) == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Trees:
    """Trees fitted on at most `most` labelled documents that aren't held out."""
    ship(documents.sparkSession)
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__quality")).where(F.col("__id").isNotNull() & F.col("__quality").isNotNull() & (fold(F.col("__id")) != 0))
    sample = known.groupBy("__id").agg(F.min("__quality").alias("__quality")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    met = documents.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(sample), "__id").select("__id", "__quality", "__text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([statistics(part) for part in slices(batch.column(2))]) if batch.num_rows else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["__id", "__quality", *NAMES])

    measured = met.mapInArrow(each, ", ".join(["__id long", "__quality int", *(f"{x} double" for x in NAMES)]))
    measured = measured.groupBy("__id", "__quality").agg(F.min(F.struct(*NAMES)).alias("one"))  # at most `most` rows, however often an id repeats
    rows = measured.select("__id", "__quality", "one.*").toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")  # the same trees however Spark deals the rows out
    return fit(rows[list(NAMES)].to_numpy(float), rows["__quality"].to_numpy(float))


def score(documents: DataFrame, model: Trees, keep_from: float | None = None, column: str = "quality_score") -> DataFrame:
    """documents with a score added (a column of that name gives way), or only those that score keep_from or more."""
    ship(documents.sparkSession)
    frame = documents if keep_from is not None else documents.drop(column)
    schema = frame.schema if keep_from is not None else T.StructType([*frame.schema.fields, T.StructField(column, T.DoubleType())])
    at = frame.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.concatenate([model.score(statistics(part)) for part in slices(batch.column(at))]) if batch.num_rows else np.zeros(0)
            if keep_from is not None:
                yield batch.filter(pa.array(got >= keep_from))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*batch.schema.names, column])

    return frame.mapInArrow(each, schema)
