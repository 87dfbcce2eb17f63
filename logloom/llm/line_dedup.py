"""Line deduplication over range-partitioned line hashes.

Every line becomes a 128-bit hash of its key with its document and position. The hashes are range-partitioned
with document and position as secondary sort, so each partition streams its lines in order: first
occurrences, and the number of documents of each key, need no state but the current run. A key common enough
to fill a partition is split over several by the secondary key; runs that touch a partition's edge are left
open and settled afterwards from their partial counts, at most two keys per partition. What comes back is one
compressed keep bitmap per document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm import textscan
from logloom.llm.staging import scratch, stage

# The characters stripped from both ends of a line, and the letters lower-cased, for its key.
STRIPPED = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lines that one range partition holds on average.
RANGE_LINES = 1_000_000

#: Lines of one key that a task holds; a longer run is settled later, like those at a partition's edges.
MOST_HELD = 200_000

#: Keys of open runs that are broadcast at most (some 40 bytes each); with more, a common key is split over SALTS.
MOST_BROADCAST, SALTS = 100_000, 64

OPEN, DROPPED = 0, 1

#: The column that tells apart rows, those with null or equal ids too.
ROW = "__row"


def numbered(documents: DataFrame) -> DataFrame:
    """``documents`` with a key of each row, written once to the shared folder, so that all readings agree on it."""
    return documents if ROW in documents.columns else stage(documents.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(STRIPPED)), UPPER, LOWER)


def hashed_lines(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, doc_id, row, pos) of every line whose key is not empty; the text itself is not kept."""
    lines = documents.select(F.col(id_col).alias("doc_id"), F.col(ROW).alias("row"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where("key <> ''")
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "row", "pos")


def _stream(min_docs: int, keep_first: bool):
    """For one partition's sorted lines: settled lines to drop, and the lines of runs that touch an edge."""

    def table(kind: int, part: dict) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(part["pos"]), kind, np.int32))
        return pa.RecordBatch.from_arrays([kinds, pa.array(part["h1"]), pa.array(part["h2"]), part["doc_id"], pa.array(part["row"]), pa.array(part["pos"])], names=["kind", "h1", "h2", "doc_id", "row", "pos"])

    def taken(part: dict, at: np.ndarray) -> dict:
        return {k: (v.take(pa.array(at)) if isinstance(v, pa.Array) else v[at]) for k, v in part.items()}

    def of(batch: pa.RecordBatch) -> dict:
        return {"h1": batch["h1"].to_numpy(), "h2": batch["h2"].to_numpy(), "doc_id": batch["doc_id"], "row": batch["row"].to_numpy(), "pos": batch["pos"].to_numpy()}

    def joined(a: dict, b: dict) -> dict:
        return {k: (pa.concat_arrays([a[k], b[k]]) if isinstance(v, pa.Array) else np.concatenate([a[k], b[k]])) for k, v in b.items()}

    def runs(part: dict) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of one hash, and whether each line is the first of its document in its run."""
        ids = part["doc_id"]
        new_doc = np.ones(len(ids), bool)
        if len(ids) > 1:
            a, b = ids[1:], ids[:-1]
            same = pa.compute.fill_null(pa.compute.equal(a, b), False).to_numpy(zero_copy_only=False)
            both_null = a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False)
            new_doc[1:] = ~(same | both_null & (part["row"][1:] == part["row"][:-1]))
        new_run = np.ones(len(ids), bool)
        new_run[1:] = (part["h1"][1:] != part["h1"][:-1]) | (part["h2"][1:] != part["h2"][:-1])
        return np.flatnonzero(new_run), new_doc | new_run

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textscan.return_memory()
        held, open_first = None, True  # lines of the unfinished run; whether the next run may have begun earlier
        for batch in batches:
            if not batch.num_rows:
                continue
            part = of(batch) if held is None else joined(held, of(batch))
            starts, first = runs(part)
            stop = starts[-1]
            inner = starts[:-1]
            if open_first and len(inner):
                yield table(OPEN, taken(part, np.arange(starts[1])))
                inner, open_first = starts[1:-1], False
            if len(inner):
                docs = np.add.reduceat(first[:stop].astype(np.int64), inner)
                drop = np.repeat(docs >= min_docs, np.diff(np.append(inner, stop)))
                if keep_first:
                    drop[inner - inner[0]] = False
                at = np.flatnonzero(drop) + inner[0]
                if len(at):
                    yield table(DROPPED, taken(part, at))
            held = taken(part, np.arange(stop, len(part["pos"])))
            if open_first or len(held["pos"]) > MOST_HELD:
                # a run that goes on and on is passed on unsettled, so no run has to fit into memory
                yield table(OPEN, held)
                held, open_first = None, True
        if held is not None:
            yield table(OPEN, held)

    return stream


def dropped_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(row, pos) of the lines to drop from ``numbered`` documents: those whose key is in at least ``min_docs`` documents.

    ``keep_first`` spares each key's first line in the order of document, row and position.
    """
    spark = documents.sparkSession
    lines = stage(hashed_lines(documents, id_col, text_col), "lines")
    n = max(lines.count() // RANGE_LINES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["h1", "h2", "doc_id", "row", "pos"]
    ranged = lines.repartitionByRange(n, *order).sortWithinPartitions(*order)
    id_type = documents.schema[id_col].dataType.simpleString()
    found = stage(ranged.mapInArrow(_stream(min_docs, keep_first), f"kind int, h1 long, h2 long, doc_id {id_type}, row long, pos int"), "line-runs")
    settled = found.where(F.col("kind") == DROPPED).select("row", "pos")
    open_ = found.where(F.col("kind") == OPEN)
    # at most two runs per partition are open; an edge may cut a document's lines, so documents are counted anew
    lone = F.when(F.col("doc_id").isNull(), F.col("row")).alias("lone")  # a null id is a document of its own
    per_doc = open_.groupBy("h1", "h2", "doc_id", lone).agg(F.min(F.struct("row", "pos")).alias("at")).groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "at.row", "at.pos")).alias("first"))
    common = stage(per_doc.where(F.col("docs") >= min_docs).select("h1", "h2", "first"), "line-keys")
    edge = open_.select("h1", "h2", "doc_id", "row", "pos")
    if common.count() <= MOST_BROADCAST:
        edge = edge.join(F.broadcast(common), ["h1", "h2"])
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        edge = edge.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"])
    if keep_first:
        edge = edge.where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
    return settled.unionByName(edge.select("row", "pos"))


DIGESTS = ("__text1", "__text2")


def _digests(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias(DIGESTS[0]), F.xxhash64(F.lit("second"), text).alias(DIGESTS[1])]


def bitmaps(documents: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, __row, n_lines, n_dropped, keep) per row of ``numbered`` documents; ``keep`` is null where every line stays.

    ``keep`` is the zlib-compressed bitmap of the lines, first line in the highest bit, 1 for lines that stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    docs = documents.select(F.col(id_col).alias("doc_id"), ROW, lines.alias("n_lines"), *_digests(text))
    per_row = dropped.groupBy(F.col("row").alias(ROW)).agg(F.sort_array(F.collect_set("pos")).alias("at"))
    marked = docs.join(per_row, ROW, "left")

    @F.pandas_udf("binary")
    def packed(n: pd.Series, at: pd.Series) -> pd.Series:
        def one(n, at):
            if at is None:
                return None
            keep = np.ones(int(n), np.uint8)
            keep[np.asarray(at, np.int64)] = 0
            return zlib.compress(np.packbits(keep).tobytes())

        return pd.Series([one(*x) for x in zip(n, at, strict=True)], dtype=object)

    keep = F.when(F.col("at").isNotNull(), packed("n_lines", "at"))
    # written once: the bitmaps are the result, and whoever applies them doesn't pack them in the same task
    return stage(marked.select("doc_id", ROW, *DIGESTS, "n_lines", F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"), keep.alias("keep")), "line-bitmaps", keep=True)


def kept_text(text: str, n_lines: int, keep: bytes) -> str:
    """The lines that a bitmap keeps, joined by newlines."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines)
    lines = text.split("\n")
    return "\n".join([lines[i] for i in np.flatnonzero(bits)])


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """One keep bitmap per row: (doc_id, n_lines, n_dropped, keep) and what ties it to its row; see ``bitmaps``.

    A line's key is the line stripped of spaces and U+0009 to U+000D at both ends, with A-Z lower-cased. Lines
    whose key occurs in at least ``min_docs`` documents are dropped in all of them, or with ``keep_first`` in
    all places but the first by document, row and position. Lines with an empty key stay.

    Null and empty texts are one empty line. Rows that share an id count as one document, but each has a bitmap
    of its own. A null id is a document of its own. An empty table gives no rows; other columns are not read.
    """
    with scratch(documents.sparkSession):
        documents = documents if ROW in documents.columns else numbered(documents.select(id_col, text_col))
        return bitmaps(documents, dropped_lines(documents, id_col, text_col, min_docs, keep_first), id_col, text_col)


def apply_keep(documents: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with the text that its bitmap keeps (null texts become empty), and n_lines, n_dropped.

    ``numbered`` documents meet their bitmaps by row. Others do so by id and text, rows alike in both one by one.
    """
    names = [c for c in documents.columns if c not in (text_col, ROW)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    m = marks.select(F.col("n_lines").alias("__n"), F.col("n_dropped").alias("__d"), F.col("keep").alias("__keep"), F.col("doc_id").alias("__mark_id"), ROW, *DIGESTS)
    if ROW in documents.columns:
        joined = documents.join(m.drop(*DIGESTS), ROW)
    else:
        alike = W.partitionBy("__mark_id", *DIGESTS).orderBy(ROW)
        m = m.withColumn("__copy", F.row_number().over(alike)).drop(ROW)
        d = documents.withColumn("__id", F.col(id_col)).select("*", *_digests(text))
        d = d.withColumn("__copy", F.row_number().over(W.partitionBy("__id", *DIGESTS).orderBy(F.lit(0)))).alias("d")
        m = m.alias("m")
        same = F.col("d.__id").eqNullSafe(F.col("m.__mark_id"))
        for c in (*DIGESTS, "__copy"):
            same = same & (F.col(f"d.{c}") == F.col(f"m.{c}"))
        joined = d.join(m, same).select(*[F.col(f"d.{c}") for c in documents.columns], "__n", "__d", "__keep")

    @F.pandas_udf("string")
    def kept(text: pd.Series, n: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([None if k is None else kept_text(t, int(x), k) for t, x, k in zip(text, n, keep, strict=True)], dtype=object)

    # texts that stay whole don't go through Python
    touched = F.when(F.col("__keep").isNotNull(), text)
    out = F.coalesce(kept(touched, F.col("__n"), F.col("__keep")), text)
    return joined.select(*[F.col(c) for c in names], out.alias(text_col), F.col("__n").alias("__n_lines"), F.col("__d").alias("__n_dropped"))
