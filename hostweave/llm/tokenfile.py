"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file holds blocks. A block is a run of documents in ascending doc_id order and has these fields:

    part, block   place of the block: range of doc_ids, number within the range
    before        ids of earlier blocks of the same range
    n_ids         ids of the block, end ids included
    doc_ids       int64 little-endian, one per document
    counts        int64 little-endian, ids per document
    control       one byte for four ids, two bits each from the low end: bytes of the id's rank, less one
    data          the ranks, 1 to 4 bytes each, little-endian, without gaps

An id's rank is its place by falling corpus frequency (ties by id), so frequent ids take one byte. The ranks'
table is stored beside the blocks. Decoding looks each control byte up in a 256-row table of lengths; offsets
are one cumulative sum, and there is no loop over ids. Blocks are rows of Parquet files, so Spark's commit
protocol makes a lost or repeated task harmless and any store that Spark writes will do.

Tokenising happens once. A first pass counts ids over all documents and keeps them, as 16-bit numbers where
the vocabulary allows, in the shared folder; the second orders them and codes their ranks, a block at once.
Documents are dealt by ranges of doc_id found from quantiles, and each range is sorted by Spark, which spills, and
then streamed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _support as S
from .pretokens import CACHE_ENTRIES, byte_bpe

#: Ids after which a block is closed; a longer document has a block of its own.
BLOCK_IDS = 1 << 18

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    size = np.ones(len(ranks), np.uint8)
    for most in (0xFF, 0xFFFF, 0xFFFFFF):
        size += ranks > most
    width = int(size.max(initial=1))
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width, dtype=np.uint8) < size[:, None]]
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    quads = codes.reshape(-1, 4)
    return (quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of ``encode_ranks`` by table lookup."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.zeros((n, 4), np.uint8)
    width = int(size.max(initial=1))
    raw[:, :width][np.arange(width, dtype=np.uint8) < size[:, None]] = np.frombuffer(data, np.uint8)
    return raw.view("<u4").reshape(-1)


def _binaries(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array: the first ``counts[0]`` ids, the next ``counts[1]`` and so on."""
    ends = np.append(0, np.cumsum(counts)) * ids.itemsize
    if ends[-1] >= 1 << 31:  # beyond the offsets of a plain binary array
        raw = ids.tobytes()
        return pa.array([raw[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])


def _tokenised(docs: DataFrame, path: str, end_id: int, cache_entries: int) -> DataFrame:
    """doc_id, ids (packed, with the end id) of every text; and, with null doc_id, a task's counts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.begin("byte_bpe")
        coder = byte_bpe(path, cache_entries)
        kind = "<u2" if coder.size <= 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        seen = np.zeros(max(coder.size, end_id + 1), np.int64)
        for batch in batches:
            coded = [coder.encode(text or "") + end for text in batch.column(1).to_pylist()]
            ids = np.frombuffer(b"".join(coded), "<u4")
            seen += np.bincount(ids, minlength=len(seen))
            counts = np.array([len(c) // 4 for c in coded], np.int64)
            out = _binaries(ids.astype(kind), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), out, pa.nulls(len(out), pa.binary())], ["doc_id", "n", "ids", "seen"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], ["doc_id", "n", "ids", "seen"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, ids binary, seen binary")


def _frequencies(tokenised: DataFrame) -> np.ndarray:
    """Corpus counts of all ids: the tasks' arrays summed per slice of the vocabulary, so one row per id at most."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                one = np.frombuffer(raw, "<i8")
                total = one.copy() if total is None else total + one
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64()), pa.array(np.full(len(used), len(total)), pa.int64())], ["id", "c", "size"])

    rows = tokenised.filter("seen is not null").select("seen").mapInArrow(spread, "id bigint, c bigint, size bigint").groupBy("id").agg(F.sum("c").alias("c"), F.max("size").alias("size")).collect()
    counts = np.zeros(max((r.size for r in rows), default=1), np.int64)
    for r in rows:
        counts[r.id] = r.c
    return counts


def write_token_files(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, cache_entries: int = CACHE_ENTRIES) -> None:
    """Write the blocks of all documents to ``path``/blocks and the ranks' table to ``path``/ranks.

    A null or empty text is a document of the end id alone. Rows whose doc_id is null can't be placed in
    doc_id order and raise. Rows that share a doc_id are all written, next to each other, the shorter first.
    Columns besides the two named are not read. An empty table gives an empty file.
    """
    spark = docs.sparkSession
    S.bounded_batches(spark)
    docs = docs.select(F.when(F.col(doc_id).isNull(), F.raise_error(F.lit("doc_id is null"))).otherwise(F.col(doc_id)).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    kept = S.cut(_tokenised(docs, vocabulary, end_id, cache_entries), "token-ids", "zstd")
    counts = _frequencies(kept)
    by_rank = np.argsort(-counts, kind="stable").astype("<u4")
    spark.createDataFrame([(bytearray(by_rank.tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.empty(len(by_rank), "<u4")
    rank_of[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(rank_of)
    wide = "<u2" if len(counts) <= 1 << 16 else "<u4"

    rows = kept.filter("doc_id is not null")
    width = S.shuffle_width(spark)
    cuts = [k / width for k in range(1, width)] or [0.5]
    bounds = np.array(rows.agg(F.percentile_approx("doc_id", cuts, 100 * width).alias("b")).first().b or [0], np.int64)
    edges = spark.sparkContext.broadcast(np.unique(bounds))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(edges.value, batch.column(0).to_numpy(zero_copy_only=False), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], ["part", "doc_id", "n", "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "before", "n_ids", "doc_ids", "counts", "control", "data"]
        ranks = shared.value
        part, number, before, held, size = None, 0, 0, [], 0

        def closed() -> pa.RecordBatch:
            control, data = encode_ranks(ranks[np.frombuffer(b"".join([x[2] for x in held]), wide)])
            row = [part, number, before, size, np.array([x[0] for x in held], "<i8").tobytes(), np.array([x[1] for x in held], "<i8").tobytes(), control, data]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for p, d, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (p != part or size + n > BLOCK_IDS):
                    yield closed()
                    before, number = (before + size, number + 1)
                    held, size = [], 0
                if p != part:
                    part, number, before = p, 0, 0
                held.append((d, n, ids))
                size += n
        if held:
            yield closed()

    placed = rows.select("doc_id", "n", "ids").mapInArrow(dealt, "part int, doc_id bigint, n bigint, ids binary")
    placed = placed.repartitionById(width, F.col("part")).sortWithinPartitions("part", "doc_id", "n", "ids")
    schema = "part int, block bigint, before bigint, n_ids bigint, doc_ids binary, counts binary, control binary, data binary"
    placed.mapInArrow(blocks, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    S.discard(kept)


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, with ``ids``, ids (packed) of every document in the files at ``path``."""
    S.bounded_batches(spark)
    ids_of = spark.sparkContext.broadcast(np.frombuffer(bytes(spark.read.parquet(f"{path}/ranks").first().ids), "<u4"))
    files = spark.read.parquet(f"{path}/blocks")
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row per range
    first, at = {}, 0
    for r in totals:
        first[r.part], at = at, at + r.n
    start_of = spark.sparkContext.broadcast(first)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, n, doc_ids, counts, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.ascontiguousarray(ids_of.value[decode_ranks(control, data, n)], "<u4")
                sizes = np.frombuffer(counts, "<i8")
                ends = np.cumsum(sizes)
                raw = memoryview(found).cast("B")
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
                starts = start_of.value[part] + before + ends - sizes
                out = [pa.array(np.frombuffer(doc_ids, "<i8")), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())]
                if ids:
                    out.append(_binaries(found, sizes))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    columns = files.select("part", "before", "n_ids", "doc_ids", "counts", "control", "data")
    return columns.mapInArrow(decoded, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * ids)
