"""Toxicity categories predicted by a classifier chain of linear models.

The chain predicts categories in order; each link is a logistic regression over indicators of words and word
beginnings, and over the earlier categories' probabilities. For fitting, those probabilities come from
models that didn't see the row (out-of-fold), as a later link must learn how far to trust them: neither their
weights nor the choice of their features have anything from the row's fold, in which copies of a text stay together.

Features are chosen from counts over the labelled sample: words and word beginnings of 4, 5 and 6 bytes, as
hashes, that toxic documents have far more often than chance. Scoring is one scan of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import textscan
from logloom.llm.staging import scratch, stage

#: At most so many labelled documents of each class are used for fitting, those with the smallest hash of the id.
MOST_PER_CLASS = 5_000
#: At most so many features are chosen, the most telling ones.
MOST_FEATURES = 2_048
PREFIXES = (4, 5, 6)
FOLDS = 5

#: The chain, in order. The label table has one toxicity label; the other category combines it with the text's
#: length, which no model is given: an outburst is a toxic document of at most OUTBURST_WORDS words.
CATEGORIES = ("outburst", "toxic")
OUTBURST_WORDS = 150

_LETTERS = np.zeros(256, bool)
_LETTERS[ord("a") : ord("z") + 1] = True
_LETTERS[128:] = True


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings of the texts, and the text of each."""
    low = textscan.TO_LOWER[data]
    starts, ends, first = textscan.words(low, offsets, _LETTERS)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found, docs = [textscan.word_hashes(low, starts, ends)], [doc]
    for size in PREFIXES:
        longer = ends - starts > size
        found.append(textscan.word_hashes(low, starts[longer], starts[longer] + size) ^ np.uint64(size))
        docs.append(doc[longer])
    return np.concatenate(found), np.concatenate(docs)


def _distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of toxic and of other documents per feature and fold, for a batch."""
    for batch in batches:
        toxic, fold = batch["label"].to_numpy().astype(np.int64), batch["fold"].to_numpy()
        for begin, _, data, offsets in textscan.steps(batch["text"]):
            h, d = _distinct(*_hashes(data, offsets))
            t, f = toxic[begin + d], fold[begin + d]
            order = np.lexsort((f, h))
            h, f, t = h[order], f[order], t[order]
            if not len(h):
                continue
            at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])]))
            n = np.diff(np.append(at, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(f[at]), pa.array(np.add.reduceat(t, at)), pa.array(n)], names=["feature", "fold", "toxic", "documents"])


def chosen_features(sample: DataFrame, folds: int = FOLDS, most: int = MOST_FEATURES, least_z: float = 4.5) -> list[np.ndarray]:
    """Sorted hashes of the features that toxic documents have more often than chance, at most ``most``.

    One set from all of the sample, and after it one without each fold.
    """
    rows = {r["fold"]: r for r in sample.groupBy("fold").agg(F.sum("label").alias("toxic"), F.count("*").alias("documents")).collect()}
    counts = sample.select("text", "label", "fold").mapInArrow(_counts, "feature long, fold int, toxic long, documents long")
    per_fold = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(f"{c}{f}") for f in range(folds) for c in ("toxic", "documents")]
    total = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("documents").alias("documents"), *per_fold).where("toxic >= 3")
    total = stage(total, "features")
    found = None
    for left_out in (None, *range(folds)):
        seen = [r for f, r in rows.items() if f != left_out]
        share = sum(r["toxic"] for r in seen) / max(1, sum(r["documents"] for r in seen))
        toxic, documents = (F.col(c) if left_out is None else F.col(c) - F.col(f"{c}{left_out}") for c in ("toxic", "documents"))
        expected = documents * F.lit(share)
        z = (toxic - expected) / F.sqrt(expected * F.lit(max(1e-9, 1 - share)) + F.lit(1e-9))
        top = total.where(toxic >= 3).select(F.lit(-1 if left_out is None else left_out).alias("set"), "feature", z.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(most)
        found = top if found is None else found.unionByName(top)
    found = found.select("set", "feature").collect()  # at most ``most`` rows a set
    return [np.sort(np.array([r["feature"] for r in found if r["set"] == s], np.int64).view(np.uint64)) for s in (-1, *range(folds))]


def indicators(data: np.ndarray, offsets: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature index) of the chosen features that each text has, each once."""
    hashes, docs = _hashes(data, offsets)
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[features & np.uint64(0xFFFF)] = True
    likely = maybe[hashes & np.uint64(0xFFFF)]
    hashes, docs = hashes[likely], docs[likely]
    at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
    hit = features[at] == hashes
    pairs = np.unique(docs[hit] * len(features) + at[hit])
    return pairs // len(features), pairs % len(features)


class Link(NamedTuple):
    """One linear model: weights of the features, of the earlier categories' probabilities, and the bias."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, docs: np.ndarray, at: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        margin = self.bias + np.bincount(docs, self.weights[at], len(earlier)) + earlier @ self.earlier
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit_link(docs: np.ndarray, at: np.ndarray, earlier: np.ndarray, y: np.ndarray, features: int, penalty: float = 0.1, steps: int = 400, rate: float = 0.1) -> Link:
    """Logistic regression with a quadratic penalty, by Adam over the whole sample; rows of ``earlier`` are the texts."""
    n, k = earlier.shape
    w = np.zeros(features + k + 1)
    share = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = Link(w[:features], w[features:-1], w[-1]).predict(docs, at, earlier)
        e = p - y
        g = np.concatenate([np.bincount(at, e[docs], features), e @ earlier, [e.sum()]]) / max(n, 1)
        g[:-1] += penalty * w[:-1] / max(n, 1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Link(w[:features], w[features:-1], float(w[-1]))


class Chain(NamedTuple):
    categories: tuple[str, ...]
    features: np.ndarray
    links: tuple[Link, ...]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each category (columns) for each text."""
        docs, at = indicators(data, offsets, self.features)
        out = np.zeros((len(offsets) - 1, 0))
        for link in self.links:
            out = np.column_stack([out, link.predict(docs, at, out)])
        return out


class Hits(NamedTuple):
    """(text, feature) pairs by one set of features."""

    docs: np.ndarray
    at: np.ndarray
    features: int

    def of(self, rows: np.ndarray) -> Hits:
        """Those of the texts in ``rows``, numbered anew."""
        place = np.full(int(max(self.docs.max(initial=-1), rows.max(initial=-1))) + 1, -1)
        place[rows] = np.arange(len(rows))
        own = place[self.docs] >= 0
        return Hits(place[self.docs[own]], self.at[own], self.features)


def fit_chain(hits: Sequence[Hits], labels: np.ndarray, fold: np.ndarray, features: np.ndarray, categories: Sequence[str]) -> Chain:
    """``hits`` by all features, and after them by those chosen without each fold; ``labels`` has a column per category."""
    n = len(labels)
    earlier, links = np.zeros((n, 0)), []
    for c in range(len(categories)):
        links.append(fit_link(hits[0].docs, hits[0].at, earlier, labels[:, c], hits[0].features))
        out_of_fold = np.zeros(n)
        for f in range(len(hits) - 1) if c + 1 < len(categories) else ():
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            own, asked = hits[1 + f].of(train), hits[1 + f].of(test)
            link = fit_link(own.docs, own.at, earlier[train], labels[train, c], own.features)
            out_of_fold[test] = link.predict(asked.docs, asked.at, earlier[test])
        earlier = np.column_stack([earlier, out_of_fold])
    return Chain(tuple(categories), features, tuple(links))


def training_sample(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_PER_CLASS) -> DataFrame:
    """(text, label, at, fold) of at most ``most`` labelled documents of each class; equal texts share a fold.

    Several labels of one document count as their majority (ties as 1); null ids and labels are left out.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    rank = F.xxhash64(id_col)
    picked = [one.where(F.col("label") == y).withColumn("at", rank).orderBy("at", id_col).limit(most) for y in (1, 0)]
    ids = picked[0].unionByName(picked[1]).withColumnRenamed(id_col, "__id")
    docs = documents.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.join(F.broadcast(ids), F.col("__doc") == F.col("__id")).select("text", "label", "at", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))  # at most 2 * most ids


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_PER_CLASS) -> Chain:
    """The chain of CATEGORIES, fitted on a bounded sample; without labelled toxic rows it predicts next to nothing."""
    with scratch(documents.sparkSession):
        sample = stage(training_sample(documents, labels, label_col, id_col, text_col, most), "toxicity")
        sets = chosen_features(sample)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, end, data, offsets in textscan.steps(batch["text"]):
                    hits = []
                    for features in sets:
                        docs, at = indicators(data, offsets, features)
                        ends = np.searchsorted(docs, np.arange(end - begin + 1)).astype(np.int32)
                        hits.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32))))
                    words = np.diff(textscan.words(data, offsets)[2])
                    own = [batch[c].slice(begin, end - begin) for c in ("label", "at", "fold")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(words.astype(np.int64)), *hits], names=["label", "at", "fold", "words", *(f"hits{i}" for i in range(len(sets)))])

        lists = ", ".join(f"hits{i} array<int>" for i in range(len(sets)))
        rows = sample.mapInArrow(scan, f"label int, at long, fold int, words long, {lists}").toPandas().sort_values("at", kind="stable")  # at most 2 * most rows, of features found
    found = []
    for i, features in enumerate(sets):
        own = [np.asarray(h, np.int64) for h in rows[f"hits{i}"]]
        docs = np.repeat(np.arange(len(rows)), [len(h) for h in own]) if len(rows) else np.zeros(0, np.int64)
        found.append(Hits(docs, np.concatenate(own) if own else np.zeros(0, np.int64), len(features)))
    toxic = rows["label"].to_numpy(np.float64)
    outburst = toxic * (rows["words"].to_numpy() <= OUTBURST_WORDS)
    return fit_chain(found, np.column_stack([outburst, toxic]), rows["fold"].to_numpy(), sets[0], CATEGORIES)


def toxicity(documents: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, one probability per category) per row, from the whole text.

    Null and empty texts are scored by the models' biases alone; null ids and repeated rows are scored like
    others; an empty table gives no rows. Other columns are not read.
    """
    docs = documents.select(F.col(id_col), F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most MOST_FEATURES weights per category

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in textscan.steps(batch["__text"]):
                p = shared.value.predict(data, offsets)
                yield pa.RecordBatch.from_arrays([batch[id_col].slice(begin, end - begin), *(pa.array(np.ascontiguousarray(c)) for c in p.T)], names=[id_col, *shared.value.categories])

    kinds = ", ".join(f"`{c}` double" for c in chain.categories)
    return docs.mapInArrow(scan, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, {kinds}")
