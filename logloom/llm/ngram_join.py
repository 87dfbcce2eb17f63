"""Exact Jaccard self-join of documents' word n-gram sets by vertical partitioning.

1. Document frequencies. The global n-gram order is cut into fragments (ranges of the n-grams' hashes). A scan
   turns each chunk of texts into one row per fragment: the fragment's distinct n-grams of the chunk, counted, and
   which documents have them. Each fragment adds the counts up and answers with one byte per n-gram, so a common
   n-gram costs a few bytes per chunk, not per document. A document more than a quarter of whose n-grams occur
   nowhere else has no partner and is done: for most documents that is the end.
2. Equal texts left are cut into n-grams once, and collapse into classes of equal sets. n-grams are ordered from
   rare to common; two sets can only reach the threshold if they share one of the first n - ceil(0.75 n) + 1
   n-grams (prefix filter).
3. Candidates are verified by fragment: the overlap is counted in each fragment separately and summed per pair.
4. Pairs are never enumerated within a group. Rounds of stars link each class to the partner with which it
   shares most of its prefix; only classes that still share a prefix n-gram *and* lie in different
   components are then compared, behind bounds from their positions and parity bitmaps, so no link between
   different sets is lost and groups of near copies cost about one pair per member. An n-gram in the prefixes
   of very many classes is dealt to as many tasks as it needs (salted).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import textscan
from logloom.llm.components import components
from logloom.llm.staging import scratch, stage

#: Bytes of text whose n-grams one fragment counts at a time.
FRAGMENT_BYTES = 64 << 20
#: n-grams of a chunk: enough for CHUNK_ROW in each fragment, within these bounds (of memory above).
CHUNK_ROW, CHUNK_LEAST, CHUNK_MOST = 256, 1 << 19, 1 << 23
#: Classes that share a prefix n-gram and meet in one task at most.
TOKEN_CLASSES = 1000
#: n-grams in the prefixes of more classes than that are broadcast (16 bytes each) if there are at most so many.
MOST_BROADCAST = 100_000
#: Fragments in which a pair's overlap is counted.
PAIR_FRAGMENTS = 4
STAR_ROUNDS = 3
#: 64-bit words of a set's parity bitmap: bit i is the parity of the n-grams that hash to i. Two bitmaps differ in
#: at most as many bits as the sets differ in n-grams, which bounds a pair's overlap from above.
BITMAP_WORDS = 16


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct n-gram hashes, first index of each row) of successive runs of rows."""
    for begin, end, data, offsets in textscan.steps(column):
        low = textscan.TO_LOWER[data]
        starts, ends, first = textscan.words(low, offsets)
        yield begin, end, *textscan.shingle_hashes(textscan.word_hashes(low, starts, ends), first, width)


def _fragmented(width: int, fragments: int):
    """Per chunk of texts and fragment: its distinct n-grams in order, how many documents have each, and which.

    The row of one fragment, by the chunk's hash, also has the chunk's ids and text keys.
    """
    most = min(max(CHUNK_ROW * fragments, CHUNK_LEAST), CHUNK_MOST)
    names = ["fragment", "chunk", "tokens", "runs", "docs", "ids", "k1", "k2"]

    def rows(chunk: int, tokens: np.ndarray, docs: np.ndarray, keys: list[pa.Array]) -> pa.RecordBatch:
        order = np.argsort(tokens, kind="stable")  # so documents rise within an n-gram
        tokens, docs = tokens[order], docs[order]
        # tokens times fragments, 96 bits: the upper part is the fragment, the next 32 bits rise with the hash within it
        scaled = (tokens >> np.uint64(32)) * np.uint64(fragments) + ((tokens & np.uint64(0xFFFFFFFF)) * np.uint64(fragments) >> np.uint64(32))
        new = np.flatnonzero(np.concatenate([[True], scaled[1:] != scaled[:-1]])) if len(scaled) else np.zeros(0, np.int64)
        runs, scaled = np.diff(np.append(new, len(scaled))), scaled[new]
        cuts = np.searchsorted(scaled >> np.uint64(32), np.arange(fragments + 1, dtype=np.uint64))
        ends = np.append(new, len(docs))[cuts]
        n = len(keys[0])
        small = np.uint16 if n < 1 << 16 else np.uint32
        low, runs, docs = scaled.astype(np.uint32), runs.astype(small), docs.astype(small)
        head = int(textscan.mixed(np.array([chunk], np.uint64))[0] % np.uint64(fragments))
        has = [f for f in range(fragments) if cuts[f] < cuts[f + 1] or f == head]
        blobs = [pa.array([x[at[f] : at[f + 1]].tobytes() for f in has], pa.binary()) for x, at in ((low, cuts), (runs, cuts), (docs, ends))]
        starts = pa.array(np.where(np.arange(len(has) + 1) > has.index(head), n, 0).astype(np.int32))
        lists = [pa.ListArray.from_arrays(starts, k) for k in keys]
        return pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array([chunk] * len(has), pa.int64()), *blobs, *lists], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textscan.return_memory()
        chunk, n, held = TaskContext.get().partitionId() << 32, 0, 0
        tokens, docs, keys = [], [], ([], [], [])
        joined = lambda: rows(chunk, np.concatenate(tokens), np.concatenate(docs), [pa.concat_arrays(k) for k in keys])
        for batch in batches:
            for begin, end, own, first in _sets(batch["text"], width):
                tokens.append(own)
                docs.append(np.repeat(np.arange(n, n + end - begin, dtype=np.uint32), np.diff(first)))
                for k, name in zip(keys, ("doc_id", "k1", "k2"), strict=True):
                    k.append(batch[name].slice(begin, end - begin))
                n, held = n + end - begin, held + len(own)
                if held >= most:
                    yield joined()
                    chunk, n, held = chunk + 1, 0, 0
                    tokens, docs, keys = [], [], ([], [], [])
        if n:
            yield joined()
        tokens, docs, keys = [], [], ([], [], [])
        textscan.return_memory()

    return scan


def _frequencies(group: pa.Table) -> pa.Table:
    """One fragment: in place of its n-grams their numbers of documents, up to 255."""
    textscan.return_memory()
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in group["tokens"]]
    runs = np.concatenate([_counts(r, len(t)) for r, t in zip(group["runs"], parts, strict=True)])
    tokens = np.concatenate(parts)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    totals = np.minimum(np.add.reduceat(runs[order], new), 255) if len(new) else new
    df = np.empty(len(tokens), np.uint8)
    df[order] = np.repeat(totals.astype(np.uint8), np.diff(np.append(new, len(ordered))))
    at = np.cumsum([0, *map(len, parts)])
    packed = [zlib.compress(df[at[i] : at[i + 1]].tobytes(), 1) for i in range(len(parts))]
    return group.set_column(group.schema.get_field_index("tokens"), "tokens", pa.array(packed, pa.binary()))


def _counts(blob: pa.Scalar, n: int) -> np.ndarray:
    """``n`` numbers of two or four bytes each."""
    data = blob.as_buffer()
    return np.frombuffer(data, np.uint32 if data.size > 2 * n else np.uint16).astype(np.int64)


def _assembled(group: pa.Table) -> pa.Table:
    """One chunk, all fragments: each document's set size, and its frequencies if enough n-grams are shared."""
    textscan.return_memory()
    group = group.sort_by("fragment")
    head = int(np.argmax(pc.list_value_length(group["ids"]).to_numpy()))
    ids, k1, k2 = (group[name].combine_chunks()[head].values for name in ("ids", "k1", "k2"))
    dfs, docs = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for blob, runs, own in zip(group["tokens"], group["runs"], group["docs"], strict=True):
        df = np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
        runs = _counts(runs, len(df))
        dfs.append(np.repeat(df, runs))
        docs.append(_counts(own, int(runs.sum())))
    docs, df = np.concatenate(docs), np.concatenate(dfs)
    order = np.argsort(docs, kind="stable")  # fragments rise, and n-grams within them: so do each document's n-grams
    df, docs = df[order], docs[order]
    at = np.searchsorted(docs, np.arange(len(ids) + 1))
    size = np.diff(at)
    shared = np.bincount(docs[df > 1], minlength=len(ids))
    live = (4 * shared >= 3 * size) & (size > 0)
    kept = [df[at[i] : at[i + 1]].tobytes() if live[i] else None for i in range(len(ids))]
    return pa.table({"doc_id": ids, "k1": k1, "k2": k2, "n": pa.array(size, pa.int64()), "df": pa.array(kept, pa.binary())})


def _ordered(width: int):
    """Live texts: signature of the set, prefix in the global order, and the shared n-grams by pair fragment."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("signature", pa.binary()), ("prefix", pa.list_(pa.int64())), ("unique", pa.int64()), ("bits", pa.list_(pa.int64())), *((f"f{i}", pa.binary()) for i in range(PAIR_FRAGMENTS))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textscan.return_memory()
        for batch in batches:
            for begin, end, tokens, first in _sets(batch["text"], width):
                rows = []
                for i in range(end - begin):
                    own = tokens[first[i] : first[i + 1]]
                    df = np.frombuffer(batch["df"][begin + i].as_py(), np.uint8)
                    n, unique = len(own), int((df == 1).sum())
                    order = np.argsort(df, kind="stable")  # within one frequency by hash
                    prefix = own[order[unique : n - (3 * n + 3) // 4 + 1]]
                    common = own[df > 1]
                    cuts = np.searchsorted(common, np.arange(1, PAIR_FRAGMENTS, dtype=np.uint64) * np.uint64(2**64 // PAIR_FRAGMENTS))
                    signature = (int(textscan.mixed(own).sum(dtype=np.uint64)) << 64 | int(np.bitwise_xor.reduce(textscan.mixed(~own)))).to_bytes(16, "big")
                    odd = np.bincount((textscan.mixed(own) % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
                    bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
                    rows.append((batch["k1"][begin + i].as_py(), batch["k2"][begin + i].as_py(), n, signature, prefix.view(np.int64), unique, bits, *[x.tobytes() for x in np.split(common, cuts)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return scan


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many n-grams two fragments share; both are sorted and without repeats."""
    for batch in batches:
        counts = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
            both.sort(kind="stable")
            counts.append(int((both[1:] == both[:-1]).sum()))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["wanted"], pa.array(counts, pa.int64())], names=["a", "b", "wanted", "shared"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose overlap, summed over the fragments, reaches 3/4 of the union."""
    pieces = F.explode(F.array(*[F.struct(F.lit(i).alias("fragment"), F.col(f"f{i}").alias("tokens")) for i in range(PAIR_FRAGMENTS)]))
    pieces = sets.select("doc_id", "n", pieces.alias("p")).select("doc_id", "n", "p.*")
    left = pairs.join(pieces.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "fragment", F.col("tokens").alias("x")), "a")
    both = left.join(pieces.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "fragment", F.col("tokens").alias("y")), ["b", "fragment"])
    # 100 o >= 75 (na + nb - o), so o >= 3 (na + nb) / 7
    both = both.select("a", "b", F.expr("3 * (na + nb)").alias("wanted"), "x", "y")
    partial = both.mapInArrow(_overlaps, "a long, b long, wanted long, shared long")
    return partial.groupBy("a", "b", "wanted").agg(F.sum("shared").alias("shared")).where("7 * shared >= wanted").select("a", "b")


def _compatible(n: str, m: str) -> str:
    return f"4 * least({n}, {m}) >= 3 * greatest({n}, {m})"


def _dealt(tokens: DataFrame) -> DataFrame:
    """A row for each of the ``ways`` in which an n-gram's postings are dealt (column ``salt``)."""
    return tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")


def _ways(classes: str) -> Column:
    return F.ceil(F.col(classes) / TOKEN_CLASSES).cast("int")


def _salt() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.col("ways")).cast("int")


def _shared(postings: DataFrame) -> DataFrame:
    """The postings whose n-gram several classes have, with the number of ways in which it is dealt, and their own."""
    several = stage(postings.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1").select("token", _ways("classes").alias("ways")), "tokens")
    hot = several.where("ways > 1")
    if 0 < hot.count() <= MOST_BROADCAST:
        rest = postings.join(F.broadcast(hot.select("token")), "token", "left_anti").join(several.where("ways = 1"), "token")
        postings = postings.join(F.broadcast(hot), "token").unionByName(rest)
    else:
        postings = postings.join(several, "token")  # AQE splits what is skewed
    return postings.withColumn("salt", _salt())


def _stars(postings: DataFrame, seed: int) -> DataFrame:
    """At most one candidate per class: of the pivots of its prefix n-grams, that with most of them in common.

    An n-gram's pivot is, among its classes of similar size, first the one with the smallest share of n-grams
    of its own (the text that others were copied from), in later rounds the one with the smallest seeded hash.
    """
    order = F.col("unique") / F.col("n") if seed == 0 else F.xxhash64(F.lit(seed), "doc_id").cast("double")
    rank = F.struct(order.alias("rank"), F.col("doc_id").alias("pivot"), F.col("n").alias("m"), F.col("component").alias("other"))
    pivots = postings.groupBy("token", "band").agg(F.min(rank).alias("p"), F.count("*").alias("members"), F.first("ways").alias("ways")).where("members > 1").select("token", "band", "ways", "p.*")
    near = postings.join(_dealt(pivots), ["token", "band", "salt"]).where("doc_id <> pivot AND component <> other AND " + _compatible("n", "m"))
    counts = near.groupBy("doc_id", "pivot").agg(F.count("*").alias("common"))
    best = counts.groupBy("doc_id").agg(F.max(F.struct("common", F.col("pivot"))).alias("best"))
    return best.select(F.col("doc_id").alias("a"), F.col("best.pivot").alias("b"))


def _labelled(postings: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "label")
    return postings.drop("component").join(labels, "doc_id", "left").withColumn("component", F.coalesce("label", "doc_id")).drop("label")


def _between(postings: DataFrame) -> DataFrame:
    """The postings whose n-gram classes of different components have, dealt by how many are left."""
    per_token = postings.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("classes"), F.first("ways").alias("ways"))
    mixed = per_token.where("least <> most").select("token", "ways", _ways("classes").alias("left"))
    return postings.drop("ways").join(_dealt(mixed), ["token", "salt"]).withColumnRenamed("left", "ways").withColumn("salt", _salt())


def similar_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: components of the links at a Jaccard similarity of 0.75 or more.

    Texts are lower-cased in A-Z; words are the runs of characters other than space and U+0009 to U+000D. A
    text's set has its distinct ``width``-word shingles; with fewer words, the whole sequence; a null text or
    one without words has an empty set and links with nothing. Sets are compared by 64-bit hashes of shingles,
    texts for equality by 128-bit hashes.

    Ids are of type long. Rows with a null id link with nothing and have no component. Rows are linked by their own
    texts: rows that repeat a row share its component, and rows that share an id but not the text join what each of
    the texts links with. An empty table gives no rows. Other columns are not read.
    """
    with scratch(documents.sparkSession):
        spark = documents.sparkSession
        docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        docs = docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")})
        volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), volume // FRAGMENT_BYTES + 1)

        rows = "fragment int, chunk long, tokens binary, runs binary, docs binary, ids array<long>, k1 array<long>, k2 array<long>"
        counted = docs.mapInArrow(_fragmented(width, fragments), rows).groupBy("fragment").applyInArrow(_frequencies, rows)
        sized = stage(counted.groupBy("chunk").applyInArrow(_assembled, "doc_id long, k1 long, k2 long, n long, df binary"), "sizes")

        live = sized.where("df IS NOT NULL AND doc_id IS NOT NULL")
        once = live.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "df")).alias("x")).select("k1", "k2", "x.*")
        texts = docs.join(once, ["doc_id", "k1", "k2"]).select("k1", "k2", "text", "df")
        fields = ", ".join(f"f{i} binary" for i in range(PAIR_FRAGMENTS))
        sets = stage(texts.mapInArrow(_ordered(width), f"k1 long, k2 long, n long, signature binary, prefix array<long>, unique long, bits array<long>, {fields}"), "sets")

        classes = sets.groupBy("signature", "n").agg(F.min(F.struct("k1", "k2")).alias("first"))
        classes = stage(classes.select("signature", "n", "first.*", F.monotonically_increasing_id().alias("class_id")), "classes")
        of_text = sets.select("k1", "k2", "signature", "n").join(classes.select("signature", "n", "class_id"), ["signature", "n"]).select("k1", "k2", "class_id").distinct()
        members = stage(live.select("doc_id", "k1", "k2").join(of_text, ["k1", "k2"]).select("doc_id", "class_id"), "members")
        # one set per class; a text of several rows alike may be there more than once
        firsts = sets.join(classes.select("k1", "k2", F.col("class_id").alias("doc_id")), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
        firsts = stage(firsts.drop("k1", "k2", "signature"), "firsts")
        postings = firsts.select("doc_id", "n", "unique", F.posexplode("prefix").alias("pos", "token"), F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int").alias("band"))
        postings = postings.select("token", "doc_id", "n", "unique", (F.col("pos") + F.col("unique")).alias("pos"), "band", F.col("doc_id").alias("component"))
        postings = stage(_shared(postings), "postings")

        links = None
        for seed in range(STAR_ROUNDS):
            found = stage(verified(_stars(postings, seed), firsts), "links")
            links = found if links is None else links.unionByName(found)
            postings = stage(_between(_labelled(postings, links)), "postings")
        # what is left between components, compared in full
        words = [F.get("bits", F.lit(i)).alias(f"w{i}") for i in range(BITMAP_WORDS)]
        postings = stage(postings.join(firsts.select("doc_id", *words), "doc_id"), "between")
        differ = " + ".join(f"bit_count(l.w{i} ^ r.w{i})" for i in range(BITMAP_WORDS))
        left, right = postings.alias("l"), _dealt(postings.drop("salt")).alias("r")
        cross = left.join(
            right,
            F.expr(
                f"l.token = r.token AND l.salt = r.salt AND l.doc_id < r.doc_id AND l.component <> r.component AND {_compatible('l.n', 'r.n')}"
                f" AND 7 * ({differ}) <= l.n + r.n"
                " AND 7 * (least(l.pos - l.unique, r.pos - r.unique) + least(l.n - l.pos, r.n - r.pos)) >= 3 * (l.n + r.n)"
            ),
        )
        pairs = cross.select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).distinct()
        links = links.unionByName(stage(verified(pairs, firsts), "links"))
        # an id with several texts holds their classes together
        several = members.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a <> z").select("doc_id", "a")
        links = links.unionByName(members.join(several, "doc_id").where("class_id <> a").select("a", F.col("class_id").alias("b")).distinct())

        labels = components(links).withColumnRenamed("node", "class_id")
        least = members.groupBy("class_id").agg(F.min("doc_id").alias("least")).join(labels, "class_id", "left")
        least = stage(least.select("class_id", "least", F.coalesce("component", "class_id").alias("component")), "least")
        named = least.groupBy("component").agg(F.min("least").alias("component_id"))
        named = least.join(named, "component").select("class_id", "component_id")
        found = members.join(named, "class_id").groupBy("doc_id").agg(F.min("component_id").alias("linked"))
        result = sized.select("doc_id", "n").join(found, "doc_id", "left")
        return stage(result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("linked", "doc_id").alias("component_id")), "components", keep=True)
