"""The corpus pipeline: stages over ``documents``, each applying one operator of ``logloom.llm``.

Every stage but the last returns the columns of ``documents``. SQL can't express the estimation of the first
stage's accuracies, nor byte-pair merges, so each stage is tested against a brute-force version on its own input.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from logloom.llm.staging import collecting, delete, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
HAS_WORD = r"[^\x20\x09-\x0D]"


_left: list[tuple[SparkSession, list[str]]] = []  # tables that the last stage's result still reads


def own_tables(apply: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the intermediate tables of the stage before: what that returned is written by now."""

    @functools.wraps(apply)
    def applied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            delete(*_left.pop())
        with collecting() as paths:
            result = apply(spark, docs, sf_dir)
        _left.append((spark, paths))
        return result

    return applied


@own_tables
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; those without text or with too few words are among them.

    Rows are judged one by one: null ids do no harm, repeated rows fare alike. No rows give none.
    """
    return quality_rules.keep_good(docs.select(*COLUMNS))


@own_tables
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first of them alone.

    Documents of which no word is left go: all their lines stand elsewhere. Documents without words stay. The first is by
    id, row and line; rows that share an id count as one document, a null id as one of its own. No rows give none.
    """
    docs = line_dedup.numbered(docs.select(*COLUMNS))
    marks = line_dedup.dedup_lines(docs, min_docs=10, keep_first=True)
    kept = line_dedup.apply_keep(docs, marks)
    kept = kept.where((F.col("__n_dropped") == 0) | F.col("text").rlike(HAS_WORD))
    changed = F.col("__n_dropped") > 0
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@own_tables
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by similar shingle sets, one with the smallest id stays; of those without words, one of each id.

    Rows that share an id are compared like any others. Rows with a null id link with nothing and stay.
    """
    docs = line_dedup.numbered(docs.select(*COLUMNS))
    row = line_dedup.ROW
    found = ngram_join.similar_documents(docs.where("doc_id IS NOT NULL").select(F.col(row).alias("doc_id"), "text"))
    found = found.withColumnRenamed("doc_id", row).join(docs.select(row, "doc_id"), row)
    empty = F.col("n_shingles") == 0
    group = F.when(empty, F.col("doc_id").cast("long")).otherwise(F.col("component_id"))
    firsts = found.groupBy(empty, group).agg(F.min(F.struct("doc_id", row)).alias("first")).select(f"first.{row}")
    kept = docs.join(firsts, row, "left_semi").select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


@own_tables
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy of which the mix takes at least half; a copy that the budget cuts stays whole or goes.

    Rows with null or repeated ids are mixed as themselves; rows without words are in no mix and go. No rows give none.
    """
    docs = line_dedup.numbered(docs.select(*COLUMNS))
    mixed = mixing.mix(docs, row_col=line_dedup.ROW).where("taken > 0")
    copies = mixed.select(F.col("key").alias(line_dedup.ROW), F.explode(F.filter("copies", lambda words: (words > 0) & (2 * words >= F.col("size")))).alias("words"))
    return docs.join(copies, line_dedup.ROW).select(*COLUMNS)


@own_tables
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, with the digest of what they decode to.

    A null text has no ids; null ids and repeated rows are encoded like others. No rows give none.
    """
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_decoded=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs, written = table(spark, sf_dir, "documents"), []
    for i, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            with collecting() as paths:
                docs = stage(docs, f"pipeline-{i}")
            delete(spark, written)
            written = paths
    return docs
