"""Approximate nearest neighbours by largest inner product, over shifted space-filling curves.

Vectors are projected to a few dimensions by several random rotations, each with its own shift, and ordered
along a Hilbert curve in each. Spark range-partitions and sorts every ordering; inside a range, runs of
neighbouring keys form blocks of bounded size. A query is looked up on those curves on which it lies farthest from
the middle, as they tell it best from other vectors, and is compared there with its own block and the two next to
it. The best of all windows are merged, and reranked by their exact inner products.

Along the curves travel codes, vectors rounded to a byte per component; they only choose whom to rerank. At a
range's edge a window ends, which is a share of windows that falls as ranges grow.

Inner products become distances by one more coordinate, which lifts vectors to one norm (queries, scaled to that
norm, have 0 there). Norms that differ much would leave the curves nothing to tell vectors apart by, so vectors are
searched in bands of norms that differ by a factor of two at most, each lifted to its own largest norm. A band of
few vectors is one window for all queries. Equal vectors are searched once, as a class, and stand for their members
in the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm import textscan
from logloom.llm.staging import scratch, stage

#: Curves, and those of them on which a query is looked up.
ORDERINGS, PROBES = 96, 48
DIMENSIONS, BITS = 8, 4
#: A curve has about so many blocks, of so many rows at least and at most; three of them are a query's window.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 240, 16, 512
#: A band of at most so many vectors is compared as a whole, with so many queries in one task.
WHOLE, QUERY_ROWS = 4096, 16384
#: Queries whose scores are in memory at a time.
STEP_ROWS = 1024


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of rows of cell coordinates, each below 2 ** ``bits``.

    After J. Skilling, Programming the Hilbert curve (2004): undo the excess work per bit from the top, Gray-encode,
    then interleave the bits.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(len(x)):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    key = np.zeros_like(x[0])
    for j in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ turn) >> j & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def coded(x: np.ndarray) -> pa.Array:
    """Vectors as a byte per component, followed by the four bytes of the factor that undoes the scaling."""
    factor = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(np.float32).tiny)
    small = np.rint(x / factor[:, None]).astype(np.int8)
    both = np.ascontiguousarray(np.concatenate([small.view(np.uint8), factor.astype(np.float32)[:, None].view(np.uint8)], axis=1))
    ends = np.arange(len(x) + 1, dtype=np.int32) * both.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(both.tobytes())])


def decoded(column: pa.Array) -> np.ndarray:
    """About the vectors that ``coded`` was given."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    both = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)
    factor = np.ascontiguousarray(both[:, -4:]).view(np.float32)
    return np.ascontiguousarray(both[:, :-4]).view(np.int8).astype(np.float32) * factor


def _keyed(bands: dict[int, tuple[float, np.ndarray, np.ndarray]], orderings: int, probes: int, seed: int, unit: float):
    """Rows (o, key, is_query, cid, code): every class on the curves of its band, query classes once more on some of each band.

    ``bands`` has the norm, and of the lifted coordinates the mean and variance; codes are of vectors divided by ``unit``.
    """
    curves: dict[int, list] = {}
    for at, (b, (norm, mean, var)) in enumerate(bands.items()):
        curves[b] = []
        for o in range(orderings):
            random = np.random.default_rng([seed, o])
            rotation = np.linalg.qr(random.normal(size=(len(mean), len(mean))))[0][:, : min(DIMENSIONS, len(mean))]
            scale = np.maximum(np.sqrt(var @ rotation**2), 1e-12 * norm)  # each coordinate by its own spread
            curves[b].append((at * orderings + o, rotation / scale, mean @ rotation / scale, random.random(rotation.shape[1])))

    def keys(z: np.ndarray, shift: np.ndarray) -> pa.Array:
        place = 0.5 * (1 + np.tanh(0.8 * z))
        return pa.array(hilbert_keys(np.minimum((place + shift) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS))

    def rows(curve: int, key: pa.Array, is_query: bool, cid: pa.Array, code: pa.Array) -> pa.RecordBatch:
        n = len(key)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, curve, np.int32)), key, pa.array(np.full(n, is_query)), cid, code], names=["o", "key", "is_query", "cid", "code"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textscan.return_memory()
        for batch in batches:
            if not batch.num_rows:
                continue
            x, size, asked = _matrix(batch["vec"]), batch["size"].to_numpy(), batch["asked"].to_numpy(zero_copy_only=False)
            band, code = batch["band"].to_numpy(), coded(x / unit)
            for b, (norm, _, _) in bands.items():
                own = np.flatnonzero(band == b)
                ids, codes = batch["cid"].take(pa.array(own)), code.take(pa.array(own))
                lifted = np.column_stack([x[own], np.sqrt(np.maximum(0, norm**2 - size[own] ** 2))])
                for curve, rotation, middle, shift in curves[b] if len(own) else ():
                    yield rows(curve, keys(lifted @ rotation - middle, shift), False, ids, codes)
            wanted = np.flatnonzero(asked)
            for b, (norm, _, _) in bands.items() if len(wanted) else ():
                lifted = np.column_stack([x[wanted] * (norm / size[wanted])[:, None], np.zeros(len(wanted))])
                far = np.stack([np.linalg.norm(lifted @ rotation - middle, axis=1) for _, rotation, middle, _ in curves[b]])
                chosen = np.zeros(far.shape, bool)
                np.put_along_axis(chosen, np.argsort(-far, axis=0, kind="stable")[:probes], True, axis=0)
                for (curve, rotation, middle, shift), picked in zip(curves[b], chosen, strict=True):
                    at = pa.array(wanted[picked])
                    if len(at):
                        yield rows(curve, keys(lifted[picked] @ rotation - middle, shift), True, batch["cid"].take(at), code.take(at))

    return scan


FOUND = pa.schema([("qid", pa.int64()), ("cids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())), ("compared", pa.int64())])


def _best(qids: np.ndarray, queries: np.ndarray, cids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best vectors for each query."""
    n = min(k, len(cids))
    for begin in range(0, len(qids) if n else 0, STEP_ROWS):
        scores = queries[begin : begin + STEP_ROWS] @ vectors.T
        top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        ends = pa.array(np.arange(0, top.size + 1, n, dtype=np.int32))
        found = np.take_along_axis(scores, top, 1).ravel().astype(np.float64)
        lists = [pa.ListArray.from_arrays(ends, pa.array(cids[top].ravel())), pa.ListArray.from_arrays(ends, pa.array(found))]
        yield pa.RecordBatch.from_arrays([pa.array(qids[begin : begin + STEP_ROWS]), *lists, pa.array(np.full(len(scores), len(cids)))], schema=FOUND)


def _windows(block_rows: dict[int, int], orderings: int, k: int):
    """The ``k`` best vectors of each query's window: its block of a sorted range, and the blocks before and after it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textscan.return_memory()
        curve, open_, blocks = None, [], []  # pieces of the unfinished block; the two finished ones before it

        def answered(at: int) -> Iterator[pa.RecordBatch]:
            """The queries of block ``at``, compared with all blocks at hand."""
            qids, queries = blocks[at][2:]
            if len(qids):
                yield from _best(qids, queries, np.concatenate([x[0] for x in blocks]), np.concatenate([x[1] for x in blocks]), k)

        def closed() -> tuple:
            is_query, cid, x = (np.concatenate([p[i] for p in open_]) for i in range(3))
            return cid[~is_query], x[~is_query], cid[is_query], x[is_query]

        def finished(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal open_, blocks
            if open_:
                blocks.append(closed())
                open_ = []
                if len(blocks) > 1:
                    yield from answered(-2)
                blocks = blocks[-2:]
            if last and blocks:
                yield from answered(-1)
                blocks = []

        for batch in batches:
            if not batch.num_rows:
                continue
            o, is_query, cid, x = batch["o"].to_numpy(), batch["is_query"].to_numpy(zero_copy_only=False), batch["cid"].to_numpy(), decoded(batch["code"])
            at = 0
            while at < len(o):
                if o[at] != curve:
                    yield from finished(True)
                    curve = int(o[at])
                room = block_rows[curve // orderings] - sum(len(p[1]) for p in open_)
                stop = min(at + room, int(np.searchsorted(o, curve, "right")))
                open_.append((is_query[at:stop], cid[at:stop], x[at:stop]))
                if stop - at == room:
                    yield from finished(False)
                at = stop
        yield from finished(True)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for found in scan(batches):
            held.append(found)
            if sum(x.num_rows for x in held) >= STEP_ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gathered


def _compared(k: int, unit: float):
    """The ``k`` best vectors of a whole band for each query of one group; scores are of vectors divided by ``unit``."""

    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found: list[pa.RecordBatch] = []
        if queries.num_rows and vectors.num_rows:
            x, asked = _matrix(vectors["vec"].combine_chunks()) / unit, _matrix(queries["qvec"].combine_chunks()) / unit
            found = list(_best(queries["qid"].to_numpy(), asked, vectors["cid"].to_numpy(), x, k))
        return pa.Table.from_batches(found, FOUND)

    return search


def inner_product(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    """Length of a vector that isn't zero; scaled first, so that squares neither overflow nor vanish."""
    most = F.array_max(F.transform(x, F.abs))
    return most * F.sqrt(F.aggregate(F.transform(x, lambda a: (a / most) * (a / most)), F.lit(0.0), lambda s, v: s + v))


def classes_of(vectors: DataFrame, is_query: Callable[[Column], Column], id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame] | None:
    """(classes of equal vectors: cid, vec, asked, size; their members: cid, vec_id, asked); none without a sound vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite)
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return None
    rows = rows.where(F.size("vec") == common["d"]).withColumns({"c1": F.xxhash64("vec"), "c2": F.xxhash64(F.lit("second"), "vec")})
    asked = is_query(F.col("vec_id"))
    # one vector of each id, then classes of equal vectors
    chosen = stage(rows.groupBy("vec_id").agg(F.min(F.struct("c1", "c2")).alias("c")).select("vec_id", "c.*"), "chosen")
    heads = chosen.groupBy("c1", "c2").agg(F.min("vec_id").alias("cid"), F.max(asked).alias("asked"))
    size = norm(F.col("vec"))
    classes = rows.groupBy("c1", "c2").agg(F.first("vec").alias("vec")).join(heads, ["c1", "c2"])
    classes = stage(classes.select("c1", "c2", "cid", "vec", "asked", size.alias("size")), "classes")
    members = chosen.join(classes.select("c1", "c2", "cid"), ["c1", "c2"])
    return classes, stage(members.select("cid", "vec_id", asked.alias("asked")), "members")


def candidates(classes: DataFrame, k: int, orderings: int = ORDERINGS, probes: int = PROBES, whole: int = WHOLE, seed: int = 7) -> DataFrame:
    """(qid, cids, scores, compared): for each query and window the best classes by about their inner product."""
    top = classes.agg(F.max("size")).first()[0]
    band = F.floor(F.log2(F.lit(top) / F.col("size")))  # at most 2100: a norm is at least the least number above 0
    banded = classes.withColumn("band", F.least(F.lit(2100), F.greatest(F.lit(0), band)).cast("int"))
    # one row per band: norms differ by a factor of two in each, so there are at most some two thousand
    counts = {r["band"]: r for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("size").alias("norm"), F.count_if("asked").alias("asked")).orderBy("band").collect()}
    asked = sum(r["asked"] for r in counts.values())
    curved = [b for b, r in counts.items() if r["n"] > whole]
    small = [b for b, r in counts.items() if r["n"] <= whole]
    found = None
    if curved:
        some = banded.where(F.col("band").isin(curved))
        most = F.element_at(F.create_map(*[F.lit(x) for b in curved for x in (b, counts[b]["norm"])]), F.col("band"))
        lift = F.sqrt(F.greatest(F.lit(0.0), most * most - F.col("size") * F.col("size")))
        shape = some.select("band", F.posexplode(F.concat("vec", F.array(lift))).alias("i", "x")).groupBy("band", "i").agg(F.avg("x").alias("mean"), F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("var")).orderBy("band", "i").collect()
        fits = {b: (counts[b]["norm"], *[np.array([r[c] for r in shape if r["band"] == b]) for c in ("mean", "var")]) for b in curved}
        block_rows = {i: int(min(max((counts[b]["n"] + asked * probes // orderings) // BLOCKS, LEAST_BLOCK), MOST_BLOCK)) for i, b in enumerate(curved)}
        keyed = banded.where(F.col("band").isin(curved) | F.col("asked")).select("cid", "vec", "size", "band", "asked").mapInArrow(_keyed(fits, orderings, probes, seed, top), "o int, key long, is_query boolean, cid long, code binary")
        order = ["o", "key", "is_query", "cid"]
        ranged = keyed.repartitionByRange(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        found = ranged.mapInArrow(_windows(block_rows, orderings, k), "qid long, cids array<long>, scores array<double>, compared long")
    if small:
        groups = max(1, -(-asked // QUERY_ROWS))
        every = banded.where(F.col("band").isin(small)).select("band", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "cid", "vec")
        asking = banded.where("asked").select(F.explode(F.array(*[F.lit(b) for b in small])).alias("qband"), F.pmod(F.xxhash64("cid"), F.lit(groups)).cast("int").alias("qgroup"), F.col("cid").alias("qid"), F.col("vec").alias("qvec"))
        compared = asking.groupBy("qband", "qgroup").cogroup(every.groupBy("band", "group")).applyInArrow(_compared(k, top), "qid long, cids array<long>, scores array<double>, compared long")
        found = compared if found is None else found.unionByName(compared)
    return found


def search(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", orderings: int = ORDERINGS, probes: int = PROBES, whole: int = WHOLE, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id meets ``is_query``.

    Nearest is the largest inner product, in double precision; ties go to the smaller id; a query isn't its own
    neighbour. Null ids and vectors, vectors with null or non-finite components, zero vectors, and those of
    another length than most take no part. Repeated rows count once; of different vectors with one id, one
    takes part. With ``k`` vectors or fewer all are returned, and with ``whole`` or fewer (of similar norms) the result
    is exact; an empty table gives no rows. Candidates of which both norms together are some 10^-30 of the longest's
    square are beyond what codes can tell apart, and come in any order before the rerank.
    """
    with scratch(vectors.sparkSession):
        prepared = classes_of(vectors, is_query, id_col, vec_col)
        if prepared is None:
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        classes, members = prepared
        known = classes.select("cid", "vec")
        # merge: a class appears in several windows; codes choose twice as many as are asked for, the exact measure decides
        most = 2 * (k + 1)
        found = candidates(classes, most, orderings, probes, whole, seed)
        ranked = found.groupBy("qid").agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("scores", "cids"))), False).alias("best"))
        best = ranked.select("qid", F.explode(F.slice(F.array_distinct(F.col("best")["cids"]), 1, most)).alias("cid"))
        best = best.join(known, "cid").join(known.select(F.col("cid").alias("qid"), F.col("vec").alias("qvec")), "qid")
        best = stage(best.select("qid", "cid", inner_product(F.col("qvec"), F.col("vec")).alias("score")), "best")

        # a class stands for its members; k + 1 with the smallest ids are all that a result can need
        salted = members.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
        few = salted.withColumn("r", F.row_number().over(W.partitionBy("cid", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
        few = few.withColumn("r", F.row_number().over(W.partitionBy("cid").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("cid", "vec_id")
        result = members.where("asked").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")).join(best, "qid").join(few, "cid").where("vec_id <> query_id")
        result = result.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        return stage(result.select("query_id", "rank", "vec_id", "score"), "neighbours", keep=True)
