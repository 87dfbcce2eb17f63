"""Byte-level BPE: every distinct word of the corpus is encoded once, and ids are joined back by position.

A scan cuts each chunk of texts into pre-tokens and codes them against the chunk's own dictionary; the codes,
in order of position, stay compact. The dictionaries' words are shuffled by hash, so each distinct word of the
corpus meets in one place, is encoded there once, and its ids go back to every chunk that has the word. There
the documents are reassembled by position. A word in every document, however frequent, is shuffled once per
chunk. Decoding joins ids with the token-byte table, which has one row per token of the vocabulary.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import tiktoken
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import pretokens, textscan

#: Bytes of text whose pre-tokens share one dictionary.
CHUNK_BYTES = 8 << 20
#: Bytes of text that are cut into pre-tokens at a time.
STEP_BYTES = 1 << 20
#: Bytes of text for each of the buckets to which words are shuffled.
BUCKET_BYTES = 64 << 20

#: Ids that are joined with the token-byte table at a time.
DECODED_IDS = 1 << 18

CODES = -1  # in place of a bucket


@functools.lru_cache(maxsize=4)
def _encoding(ranks_file: bytes, pattern: str) -> tiktoken.Encoding:
    lines = map(bytes.split, ranks_file.splitlines())
    ranks = {base64.b64decode(token): int(rank) for token, rank in (x for x in lines if x)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _token_table(ranks_file: bytes) -> pa.Table:
    """The token-byte table: (id, token), one row per token of the vocabulary."""
    pairs = [(int(rank), base64.b64decode(token)) for token, rank in (x.split() for x in ranks_file.splitlines() if x)]
    return pa.table({"id": pa.array([i for i, _ in pairs], pa.int32()), "token": pa.array([t for _, t in pairs], pa.binary())})


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one item size, compressed by byte planes with their lengths before them."""
    out = [np.array([len(arrays), *map(len, arrays)], np.uint32).tobytes()]
    out += [np.ascontiguousarray(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.compress(b"".join(out), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    sizes = np.frombuffer(raw, np.uint32, n, 4)
    at, out = 4 * (n + 1), []
    for size in sizes.tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view(np.uint32).ravel())
        at += 4 * size
    return out


def _blob_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary array of the slices of ``data`` that end at ``ends``, the first from 0."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _coded(buckets: int, id_type: pa.DataType):
    """Chunks of texts as dictionary codes, and the dictionaries' words by bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("ids", pa.list_(id_type)), ("codes", pa.binary()), ("words", pa.binary()), ("digest", pa.int64())])

    def rows(chunk: int, ids: list, counts: list[np.ndarray], parts: list[pa.Array]) -> pa.RecordBatch:
        merged = pa.chunked_array(parts).unify_dictionaries()
        words = merged.chunk(0).dictionary
        codes = np.concatenate([x.indices.to_numpy(zero_copy_only=False) for x in merged.chunks])
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words get small codes
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        words = words.take(pa.array(order)).cast(pa.large_binary())
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
        data, ends = data[ends[0] : ends[-1]], ends - ends[0]
        hashes = textscan.word_hashes(data, ends[:-1], ends[1:])
        # the two readers of a scan must see the same chunks; the digest is compared when they meet again
        digest = int(textscan.mixed(hashes + np.arange(len(hashes), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))
        out = [(CODES, chunk, pa.concat_arrays(ids).to_pylist(), _pack(np.concatenate(counts), rank[codes]), None, digest)]
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        for b in range(buckets):
            own = by_bucket[cuts[b] : cuts[b + 1]]
            if len(own):
                mine = words.take(pa.array(own))
                lengths = np.diff(np.frombuffer(mine.buffers()[1], np.int64)[: len(mine) + 1])
                text = zstandard.compress(mine.buffers()[2].to_pybytes(), 1)
                out.append((b, chunk, None, _pack(np.diff(own, prepend=0), lengths), text, digest))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textscan.return_memory()
        chunk, held, ids, counts, parts = TaskContext.get().partitionId() << 32, 0, [], [], []
        for batch in batches:
            for begin, end, data, offsets in textscan.steps(batch["text"], STEP_BYTES):
                at = pretokens.starts(data, offsets)
                ends = np.append(at[1:], len(data)) if len(at) else at
                ids.append(batch["id"].slice(begin, end - begin))
                counts.append(np.diff(np.searchsorted(at, offsets)))
                parts.append(_blob_array(data, ends).dictionary_encode())
                held += len(data)
                if held >= CHUNK_BYTES:
                    yield rows(chunk, ids, counts, parts)
                    chunk, held, ids, counts, parts = chunk + 1, 0, [], [], []
        if ids:
            yield rows(chunk, ids, counts, parts)
        del ids, counts, parts
        textscan.return_memory()

    return scan


def _encoded(ranks: Broadcast, pattern: str):
    def encode(group: pa.Table) -> pa.Table:
        """One bucket: each distinct word of all chunks encoded once; every chunk gets its words' ids."""
        textscan.return_memory()
        encoding, known, packed = _encoding(ranks.value, pattern), {}, []
        for codes, words in zip(group["codes"], group["words"], strict=True):
            own, lengths = _unpack(codes.as_py())
            text = zstandard.decompress(words.as_py())
            ends = np.cumsum(lengths, dtype=np.int64).tolist()
            ids, sizes, begin = [], [], 0
            for stop in ends:
                word = text[begin:stop]
                begin = stop
                found = known.get(word)
                if found is None:
                    found = known[word] = encoding.encode_ordinary(word.decode())
                ids += found
                sizes.append(len(found))
            packed.append(_pack(own, np.array(sizes, np.uint32), np.array(ids, np.uint32)))
        return pa.table({"chunk": group["chunk"], "word_ids": pa.array(packed, pa.binary()), "digest": group["digest"]})

    return encode


def _reassembled(id_type: pa.DataType, ranks: Broadcast, with_decoded: bool):
    def reassemble(codes: pa.Table, words: pa.Table) -> pa.Table:
        """One chunk: the ids of its words put at the words' positions, document by document."""
        textscan.return_memory()
        if pa.compute.count_distinct(pa.concat_arrays([*codes["digest"].chunks, *words["digest"].chunks])).as_py() != 1:
            raise RuntimeError("a chunk's words don't belong to its codes: the input changed between two readings")
        counts, at = _unpack(codes["codes"][0].as_py())
        pieces = [_unpack(x.as_py()) for x in words["word_ids"]]
        own = np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in pieces]) if pieces else np.zeros(0, np.int64)
        sizes = np.concatenate([p[1] for p in pieces]).astype(np.int64) if pieces else np.zeros(0, np.int64)
        flat = np.concatenate([p[2] for p in pieces]).astype(np.int32) if pieces else np.zeros(0, np.int32)
        del pieces
        by_piece = np.empty(len(own), np.int32)
        by_piece[own] = np.arange(len(own), dtype=np.int32)
        at = by_piece[at]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
        ids = lists.take(pa.array(at)).flatten()
        words_before = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
        ids_before = np.concatenate([[0], np.cumsum(sizes[at])])[words_before].astype(np.int32)
        columns = {"id": pa.array(codes["ids"][0].as_py(), id_type), "ids": pa.ListArray.from_arrays(pa.array(ids_before), ids)}
        if with_decoded:
            columns["decoded"] = _decoded(_token_table(ranks.value), columns["ids"])
        return pa.table(columns)

    return reassemble


def _decoded(table: pa.Table, lists: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids; null lists have none.

    Runs of lists are decoded by a join of their distinct ids with the token-byte table; the ids' places then put the
    tokens' bytes in order.
    """
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    ids, row, found = lists.flatten(), 0, []
    while row < len(sizes):
        stop = max(row + 1, int(np.searchsorted(before, before[row] + DECODED_IDS, "right")) - 1)
        places = ids.slice(before[row], before[stop] - before[row]).dictionary_encode()
        asked = pa.table({"id": places.dictionary, "place": pa.array(np.arange(len(places.dictionary)))})
        met = asked.join(table, "id", join_type="inner", use_threads=False).sort_by("place")
        if len(met) < len(asked):
            raise ValueError("an id is not in the vocabulary")
        tokens = met["token"].combine_chunks().cast(pa.large_binary()).take(places.indices)
        ends = np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
        offsets = ends[before[row : stop + 1] - before[row]]
        data = tokens.buffers()[2] if len(tokens) else pa.py_buffer(b"")
        found.append(pa.Array.from_buffers(pa.large_binary(), stop - row, [None, pa.py_buffer(offsets.tobytes()), data]).cast(pa.binary()))
        row = stop
    return pa.concat_arrays(found) if found else pa.array([], pa.binary())


def encode(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """(``id_col``, ids) per row: the token ids of the whole text, without special tokens.

    ``ranks_path`` is a file of base64 tokens with their ranks, read by the driver; ``pattern`` cuts texts for the
    encoder and must be the one that ``pretokens`` implements; another is an error. ``with_decoded`` adds ``decoded``, the bytes that
    the ids stand for, as ``decode`` gives them, without sending the ids round again.

    Null and empty texts have no ids. Each row is encoded by itself, so repeated rows and null ids do no harm;
    ids are long, int or string. An empty table gives no rows. Other columns are not read.
    """
    if pattern != pretokens.PATTERN:
        raise ValueError("texts can only be cut by pretokens.PATTERN")
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(open(ranks_path, "rb").read())  # the vocabulary, whatever the corpus' size
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), volume // BUCKET_BYTES + 1)
    kind = docs.schema["id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    # read twice, once for the words and once for the codes: codes are too large to be kept beside their shuffle
    coded = docs.mapInArrow(_coded(buckets, id_type), f"bucket int, chunk long, ids array<{kind}>, codes binary, words binary, digest long")
    words = coded.where(F.col("bucket") != CODES).select("bucket", "chunk", "codes", "words", "digest")
    found = words.groupBy("bucket").applyInArrow(_encoded(ranks, pattern), "chunk long, word_ids binary, digest long")
    codes = coded.where(F.col("bucket") == CODES).select("chunk", "ids", "codes", "digest").toDF("code_chunk", "ids", "codes", "digest")
    out = f"id {kind}, ids array<int>" + ", decoded binary" * with_decoded
    done = codes.groupBy("code_chunk").cogroup(found.groupBy("chunk")).applyInArrow(_reassembled(id_type, ranks, with_decoded), out)
    return done.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; an id that the vocabulary lacks is an error.

    Null and empty id arrays decode to no bytes.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _decoded(_token_table(ranks.value), batch[ids_col].cast(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(scan, f"{fields}, `{out_col}` binary")
