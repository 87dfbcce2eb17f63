"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

A scan turns every text into a short vector of statistics. The trees are fitted on the driver, on a bounded
sample of labelled vectors, and flattened into arrays; scoring walks all trees of a batch at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import textscan
from logloom.llm.staging import stage

#: At most so many labelled rows are fetched to the driver for fitting, those with the smallest hash of the id.
MOST_LABELLED = 20_000

FEATURES = (
    "log_words", "log_bytes", "word_length", "word_length_spread", "longest_word", "distinct_words", "distinct_shingles",
    "upper", "lower", "digits", "spaces", "stops", "commas", "exclaims", "symbols", "pipes", "other_ascii", "non_ascii",
    "upper_words", "log_lines", "line_length", "repeated_lines", "line_ends_stop",
)

_CLASSES = np.zeros((256, 11), np.float64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\x0b\x0c\r", b".?", b",;:", b"!", b"#*$%&<>", b"|")):
    _CLASSES[[*_chars], _i] = 1
_CLASSES[:128, 9] = _CLASSES[:128, :9].sum(axis=1) == 0
_CLASSES[192:, 10] = 1  # first bytes of characters beyond ASCII
_NOT_NEWLINE = np.arange(256) != ord("\n")


def _spread(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean, standard deviation and maximum of each group of consecutive values; 0 for empty groups."""
    n = np.diff(first)
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    squares = np.concatenate([[0.0], np.cumsum(values.astype(np.float64) ** 2)])
    mean = np.diff(sums[first]) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(0, np.diff(squares[first]) / np.maximum(n, 1) - mean**2))
    most = np.zeros(len(n))
    if len(values) and (n > 0).any():
        most[n > 0] = np.maximum.reduceat(values, first[:-1][n > 0])
    return n, mean, spread, most


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1)
    for i in range(len(out)):
        own = np.sort(hashes[first[i] : first[i + 1]])
        out[i] = (own[1:] != own[:-1]).sum() + 1 if len(own) else 0
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; all 0 for an empty one."""
    m = len(offsets) - 1
    counts = np.stack([np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256) for i in range(m)]).astype(np.float64)
    size = np.maximum(np.diff(offsets), 1)[:, None]
    shares = counts @ _CLASSES / size
    starts, ends, first = textscan.words(data, offsets)
    hashes = textscan.word_hashes(data, starts, ends)
    n, mean, spread, most = _spread(ends - starts, first)
    shingles = np.diff(textscan.shingle_hashes(hashes, first, 5)[1])
    upper = (data >= 65) & (data <= 90)
    shouted = upper[starts] & upper[np.minimum(starts + 1, ends - 1)] if len(starts) else np.zeros(0, bool)
    l_starts, l_ends, l_first = textscan.words(data, offsets, _NOT_NEWLINE)
    lines, line_mean, _, _ = _spread(l_ends - l_starts, l_first)
    stop = np.isin(data[l_ends - 1], [*b".!?"]) if len(l_ends) else np.zeros(0, bool)
    return np.column_stack([
        np.log1p(n), np.log1p(np.diff(offsets)), mean, spread, most,
        _distinct(hashes, first) / np.maximum(n, 1), shingles / np.maximum(n - 4, 1) * (n > 0),
        shares, _spread(shouted, first)[1],
        np.log1p(lines), line_mean, 1 - _distinct(textscan.word_hashes(data, l_starts, l_ends), l_first) / np.maximum(lines, 1), _spread(stop, l_first)[1],
    ])


def described(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, features array<float>) per row, in the order of FEATURES."""
    docs = documents.select(F.col(id_col), F.col(text_col).alias("__text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in textscan.steps(batch["__text"]):
                x = statistics(data, offsets).astype(np.float32)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch[id_col].slice(begin, end - begin), rows], names=[id_col, "features"])

    return docs.mapInArrow(scan, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, features array<float>")


class Trees(NamedTuple):
    """Complete binary trees of one depth, flattened: node i's children are 2 i + 1 and 2 i + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right if the feature is above
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all trees of a block of rows at once."""
        out = np.empty(len(x))
        trees, inner = self.feature.shape
        for begin in range(0, len(x), 1024):
            own = x[begin : begin + 1024]
            rows = np.arange(len(own))[:, None]
            node = np.zeros((len(own), trees), np.int64)
            each = np.arange(trees)[None, :]
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (own[rows, self.feature[each, node]] > self.threshold[each, node])
            out[begin : begin + len(own)] = self.base + self.leaf[each, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least_weight: float = 3.0, penalty: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss; splits are searched in per-node histograms of quantile bins.

    Without rows, or with one class alone, the result is the smoothed share of label 1 for every text.
    """
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)))
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(d) * bins
    margin, found = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        node, feature, threshold = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, begin = 2**level, 2**level - 1
            at = ((node - begin) * d * bins)[:, None] + flat
            g = np.bincount(at.ravel(), np.repeat(gradient, d), width * d * bins).reshape(width, d, bins)
            h = np.bincount(at.ravel(), np.repeat(weight, d), width * d * bins).reshape(width, d, bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(hl < least_weight) | (ht - hl < least_weight)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[begin + k], threshold[begin + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        slot = node - inner
        leaf = rate * np.bincount(slot, gradient, inner + 1) / (np.bincount(slot, weight, inner + 1) + penalty)
        margin = margin + leaf[slot]
        found.append((feature, threshold, leaf))
    return Trees(base, *(np.stack(c) for c in zip(*found, strict=True)))


def training_rows(features: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", most: int = MOST_LABELLED) -> DataFrame:
    """Features and label of at most ``most`` labelled documents, those with the smallest hash of the id.

    Several labels of one document count as their majority (ties as 1); null ids and labels are left out.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("__label"))
    found = features.join(one, id_col)
    return found.orderBy(F.xxhash64(id_col), id_col).limit(most)


def score(features: DataFrame, model: Trees, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, score double) per row of ``described``."""
    shared = features.sparkSession.sparkContext.broadcast(model)  # trees x leaves numbers, whatever the corpus' size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["features"].flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(FEATURES)), np.float32)
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(shared.value.score(x))], names=[id_col, "score"])

    return features.mapInArrow(scan, f"`{id_col}` {features.schema[id_col].dataType.simpleString()}, score double")


def classify(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", may_train=None, most: int = MOST_LABELLED) -> DataFrame:
    """(``id_col``, score) per row: how likely label 1 is, from the text's statistics alone.

    ``may_train`` is a condition on the id: labels of other rows are never used. Null and empty texts are
    scored by all-zero statistics; null ids are scored but never train; repeated rows score alike; without
    labels every score is 0.5. Other columns are not read.
    """
    features = stage(described(documents, id_col, text_col), "features")
    usable = labels if may_train is None else labels.where(may_train)
    rows = training_rows(features, usable, label_col, id_col, most).select("features", "__label").toPandas()
    x = np.stack(rows["features"].to_numpy()).astype(np.float32) if len(rows) else np.zeros((0, len(FEATURES)), np.float32)
    return score(features, fit(x, rows["__label"].to_numpy(np.float64)), id_col)
