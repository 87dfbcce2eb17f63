"""Mixing sources to target weights by weighted fair queueing.

Every document, shuffled within its source, queues once per copy, each further copy behind the whole source.
Long documents queue in packets, so that no source waits behind one of them. A packet's virtual finish time is
the source's words up to its end, divided by the source's target. All packets are then range-sorted by finish
time over all sources, and the queue is truncated once, where its words reach the total budget. A source's
share is never cut by itself: it comes out near its target because all sources advance at the same pace.

Both orders (a source's shuffle, and the global order by finish time) are range partitions with running sums
inside; a small table of their totals, one row per range and source, joins ranges together. So neither a source
nor rows that are all alike are ever one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.staging import scratch, stage

#: A packet has at most so many words, and at most this part of its source's target.
PACKET_WORDS, PACKETS_OF_A_TARGET = 1000, 500


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_copies: int = 2) -> DataFrame:
    """Each source's share of ``share`` times all words; (source, source_size) -> target and ``at``, its place, added.

    Sources in code point order, null last, take the weights in turn. A source stops at ``most_copies`` times
    its size and the others share the excess by weight. The level at which all targets settle follows from
    the sources in the order in which they fill up, with one running sum; one row per source. Sources
    without words get 0.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("at", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.get(cycle, F.col("at") % len(weights)))
    s = s.withColumn("most", F.col("source_size") * most_copies).withColumn("fills_at", F.col("most") / F.col("weight"))
    order = W.orderBy("fills_at", "at")
    everything = W.partitionBy()
    s = s.withColumn("full_before", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("full_before")) / F.col("weight_left"))
    # the first source that doesn't fill up has the common level; if all do, each gets its most
    s = s.withColumn("settled", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "at", "level"))).over(everything)["level"])
    return s.select("source", "source_size", "at", F.coalesce(F.least(F.col("weight") * F.col("settled"), F.col("most")), F.col("most")).cast("double").alias("target"))


def _summed(words: str, by: str | None):
    """Rows of a sorted range with the range's number and the words up to and including each, by runs of ``by``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(batch[words].to_numpy())
            group = batch[by].to_numpy() if by else np.zeros(len(ends), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            before = np.concatenate([[0], ends])[starts]
            before[0] -= carried if group[0] == last else 0
            ends = ends - np.repeat(before, np.diff(np.append(starts, len(ends))))
            last, carried = group[-1], int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ends), part, np.int32)), pa.array(ends)], names=[*batch.schema.names, "range", "range_end"])

    return scan


def in_order(rows: DataFrame, order: Sequence[str], words: str, by: str | None = None) -> DataFrame:
    """``rows`` with ``before``: the ``words`` of all rows that come earlier in ``order`` (of the same ``by``, its first column)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    summed = stage(ranged.mapInArrow(_summed(words, by), f"{fields}, range int, range_end long"), "in-order")
    keys = [by, "range"] if by else ["range"]
    totals = summed.groupBy(*keys).agg(F.max("range_end").alias("total"))
    earlier = W.partitionBy(*keys[:-1]).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("earlier"))
    return summed.join(totals, keys).withColumn("before", F.col("earlier") + F.col("range_end") - F.col(words)).drop("range", "range_end", "earlier")


def queue(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_copies: int = 2, seed: str = "mix", row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with size, source_size, target and key; their packets with finish, words, mix_offset and taken)."""
    key = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5("text")))
    docs = stage(docs.withColumn("shuffled", digest).drop("text"), "mix-sizes")

    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, share, most_copies).alias("g")
    d = docs.alias("d").join(goals, F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", "at", "source_size", "target")

    waiting = d.where("size > 0").select("at", "shuffled", "size", "key", "source_size", "target")
    waiting = in_order(waiting, ["at", "shuffled", "size", "key"], "size", "at")
    packet = F.greatest(F.lit(1), F.least(F.lit(PACKET_WORDS), F.floor(F.col("target") / PACKETS_OF_A_TARGET))).cast("long")
    copies = waiting.withColumn("packet", packet).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most_copies - 1))))
    packets = copies.withColumn("skip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("packet"))))
    packets = packets.withColumn("words", F.least(F.col("packet"), F.col("size") - F.col("skip")))
    packets = packets.withColumn("end", F.col("copy") * F.col("source_size") + F.col("before") + F.col("skip") + F.col("words"))
    packets = packets.select((F.col("end") / F.col("target")).alias("finish"), "at", "end", "key", "copy", "words")
    sorted_packets = in_order(packets, ["finish", "at", "end"], "words").withColumnRenamed("before", "mix_offset")
    budget = sizes.agg(F.sum("source_size").alias("n")).select(F.least(F.floor(F.col("n") * F.lit(float(share))), F.col("n") * most_copies).cast("long")).scalar()
    taken = F.greatest(F.lit(0), F.least(F.col("words"), budget - F.col("mix_offset")))
    return d.drop("at", "shuffled"), sorted_packets.withColumn("taken", taken)


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_copies: int = 2, seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """One row per row: doc_id, source, size, source_size, target, key, taken, copies.

    ``copies`` has the words taken of each of the ``most_copies`` copies, ``taken`` their sum. The budget is
    ``share`` times all words; the packet on which it ends is cut there. A source's taken words differ from its
    target by about a packet, at most 1/500 of the target and 1000 words.

    Null texts and texts without words have size 0 and take nothing; a null source is a source of its own. The
    order within a source is by the MD5 digest of the seed, the id (null: empty) and the text's digest; rows alike
    in all of these follow one another, so reruns agree in how many of them take how much. An empty table gives
    no rows. ``row_col`` names a column of type long that tells rows apart, returned as ``key``; else a number of
    our own does.
    """
    with scratch(documents.sparkSession):
        docs, packets = queue(documents, id_col, text_col, source_col, weights, share, most_copies, seed, row_col)
        per_copy = [F.coalesce(F.sum(F.when(F.col("copy") == c, F.col("taken"))), F.lit(0)).alias(f"copy{c}") for c in range(most_copies)]
        took = packets.where("taken > 0").groupBy("key").agg(F.sum("taken").alias("taken"), F.array(*per_copy).alias("copies"))
        none = F.array(*[F.lit(0).cast("long")] * most_copies)
        mixed = docs.join(took, "key", "left").select("doc_id", "source", "size", "source_size", "target", "key", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", none).alias("copies"))
        return stage(mixed, "mix", keep=True)
