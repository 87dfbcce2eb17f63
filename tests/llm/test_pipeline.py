"""The pipeline's stages, each on its own input, against plain Python; and all of them one after another."""

import collections
import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import quality_rules
from test_llm_operators import RANKS, WORD, base_counts, components_of, corpus, documents, key, mixed_by_hand, plain_estimation


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus(21, 80)
    texts = [" ".join([t, *corpus(22 + i, 6)]) for i, t in enumerate(texts)]
    for i in range(12):  # a passage in many documents, exact and near copies
        texts[i] += "\nA license passage that stands in many documents and says the same in all of them."
    texts += [texts[40]] * 3 + [re.sub("^[A-Z]", "Q", texts[41])] + ["JUNK!! " * 60, None, "", "short"]
    return documents(spark, texts).select(*corpus_pipeline.COLUMNS)


def test_quality_stage(spark, docs):
    kept = texts_of(corpus_pipeline.keep_quality(spark, docs, ""))
    votes = {r["doc_id"]: tuple(r["votes"]) for r in quality_rules.voted(docs).collect()}
    p_good = plain_estimation(list(collections.Counter(votes.values()).items()), 30)

    def good(i, text):
        n_words, _, _, _, repeated = base_counts(text)
        return n_words >= 10 and 100 * repeated <= 20 * n_words and p_good[votes[i]] >= 0.5

    assert sorted(kept) == sorted(i for i, t in texts_of(docs).items() if good(i, t))
    assert set(range(80)) <= set(kept) and not set(range(84, 88)) & set(kept)


def test_line_stage(spark, docs):
    before = texts_of(docs)
    after = texts_of(corpus_pipeline.drop_repeated_lines(spark, docs, ""))
    where = collections.defaultdict(list)
    for i, t in before.items():
        for p, line in enumerate((t or "").split("\n")):
            if key(line):
                where[key(line)].append((i, p))
    drop = {x for s in where.values() if len({i for i, _ in s}) >= 10 for x in sorted(s)[1:]}
    want = {}
    for i, t in before.items():
        lines = (t or "").split("\n")
        left = "\n".join(x for p, x in enumerate(lines) if (i, p) not in drop)
        if len(left) == len(t or "") or WORD.search(left):
            want[i] = left
    assert after == want and sum("license passage" in (t or "") for t in after.values()) == 1


def test_near_duplicate_stage(spark, docs):
    before = texts_of(docs)
    ids = sorted(before)
    want = components_of([before[i] for i in ids])
    after = texts_of(corpus_pipeline.one_of_each_group(spark, docs, ""))
    assert sorted(after) == [ids[i] for i, (_, c) in want.items() if i == c]


def test_last_stages_and_run(spark, docs, tmp_path):
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    before = texts_of(docs)
    rows = mixed.collect()
    assert mixed.columns == list(corpus_pipeline.COLUMNS) and all(r["text"] == before[r["doc_id"]] for r in rows)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    want = mixed_by_hand([before[i] for i in sorted(before)], source)
    assert sorted(before) == list(range(len(before)))
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, (taken, size, _, _) in want.items() for words in taken if words and 2 * words >= size)
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r["n_tokens"] == len(r["ids"]) for r in out)
    clean = [r for r in out if r["doc_id"] == 60]
    assert clean and all(r["decoded_sha256"] == hashlib.sha256(before[60].encode()).hexdigest() for r in clean)
    assert not {84, 85, 86, 87} & {r["doc_id"] for r in out}
    assert RANKS == public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_stages_with_null_and_repeated_ids(spark):
    texts = corpus(31, 12)
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[0]), (2, texts[0]), (3, texts[1]), (3, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[4]), (4, ""), (4, ""), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    counted = lambda out: collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    once = counted(corpus_pipeline.one_of_each_group(spark, df, ""))
    assert once == collections.Counter([(1, texts[0]), *rows[4:10], rows[11]])
    mixed = corpus_pipeline.mix_sources(spark, df, "")
    copies, have = counted(mixed), collections.Counter(rows)
    assert all(n <= 2 * have[row] for row, n in copies.items())
    # one source has 1.5 times its words as its target: each row with words at least once, and half of the words twice
    assert all(copies[row] >= n for row, n in have.items() if row[1])
    words = lambda c: sum(n * len(WORD.findall(t or "")) for (_, t), n in c.items())
    assert abs(words(copies) - 1.5 * words(have)) <= max(len(WORD.findall(t or "")) for _, t in rows)
    lines = spark.createDataFrame([(None, f"shared\nown {i}", "en", "s", 0) for i in range(10)] + [(1, "shared\nx", "en", "s", 0)] * 2, df.schema)
    left = counted(corpus_pipeline.drop_repeated_lines(spark, lines, ""))
    assert sum(left.values()) == 12 and sum(n for (_, t), n in left.items() if "shared" in t) == 1
