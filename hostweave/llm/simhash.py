"""SimHash near-duplicates: documents whose 64-bit fingerprints differ in at most four bits.

Candidates come from deletion variants. The fingerprint is cut into three segments, so of two fingerprints
that differ in at most four bits one segment differs in at most one (two bits in each would make six). Each
segment is indexed once for each of its bits with that bit masked out: 64 keys a fingerprint, and any two
that link share a key. Equal keys meet by a shuffle on the key and are verified by counting differing bits; a key of more than
a few fingerprints gives a star for each of its groups, so m fingerprints give at most m - 1 edges.

Equal fingerprints are one row before any of this, whatever the number of their documents. A key with more
than ``RUN`` fingerprints is dealt out again as pairs of blocks, each a task's bounded share, so no group is
ever held whole and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _support as S
from .components import components

BITS = 64
#: Lowest bit and width of the segments; three leave one with at most one of four differing bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST = 4
#: Fingerprints of one key that a task holds at once.
RUN = 2048

_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes.

    Eight bit positions are counted at once in the bytes of a word, up to 255 rows before a byte is full.
    """
    n = len(hashes)
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    counts = np.empty((8, 8), np.int64)
    for k in range(8):
        lanes = (padded >> np.uint64(k)) & _LANES
        counts[:, k] = lanes.reshape(-1, 255).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts.reshape(-1) > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of the XXH64 (seed 42) of the text's word shingles; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return majority(np.array([xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts, stops, strict=False)], np.uint64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed 64-bit integer) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.begin("simhash")
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _variants(distinct: DataFrame) -> DataFrame:
    """key, fp: the 64 one-wildcard keys of every fingerprint; the bit's number keeps keys of bits apart."""
    keys = []
    for low, width in SEGMENTS:
        for bit in range(width):
            value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)).cast("bigint"))
            keys.append(value + F.lit((low + bit) << 22).cast("bigint"))
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one run of fingerprints that suffice to connect what is linked: (member, first of its group)."""
    n = len(fps)
    near = np.empty((n, n), bool)
    for i in range(0, n, 256):
        near[i : i + 256] = np.bitwise_count(fps[i : i + 256, None] ^ fps[None, :]) <= MOST
    label, fresh = np.full(n, -1), np.ones(n, bool)
    for i in range(n):
        if fresh[i]:
            front = np.zeros(n, bool)
            front[i] = True
            while front.any():
                label[front] = i
                fresh &= ~front
                front = near[front].any(axis=0) & fresh
    member = np.flatnonzero(label != np.arange(n))
    return fps[member], fps[label[member]]


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted): all pairs of short runs, forests of longer ones."""
    edges = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0))
    sizes = np.diff(edges, append=len(keys))
    out_a, out_b = [], []
    size_of = np.repeat(sizes, sizes)
    short = size_of <= 8
    for d in range(1, 8):
        i = np.flatnonzero(short[:-d] & (keys[:-d] == keys[d:]))
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= MOST]
        out_a.append(fps[i]), out_b.append(fps[i + d])
    for at, n in zip(edges[sizes > 8], sizes[sizes > 8], strict=True):
        a, b = _forest(fps[at : at + n])
        out_a.append(a), out_b.append(b)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1]


def _within_keys(rows: DataFrame, most: int) -> DataFrame:
    """hot, a, b from rows (key, fp) dealt and sorted by key: links, or the rows of keys with over ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.begin("simhash")

        def out(hot: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["hot", "a", "b"])

        key, fp, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(key, key[-1], side="left"))
            done, done_fp, key, fp = key[:last], fp[:last], key[last:], fp[last:]
            if over is not None and len(done):
                end = int(np.searchsorted(done, over, side="right"))  # the rest of a long run
                yield out(True, done[:end], done_fp[:end])
                done, done_fp, over = done[end:], done_fp[end:], None
            if len(done):
                yield from split(done, done_fp, out)
            if over == key[0] or len(key) > most:
                over = key[0]
                yield out(True, key[:-1], fp[:-1])
                key, fp = key[-1:], fp[-1:]
        if len(key):
            if over == key[0]:
                yield out(True, key, fp)
            else:
                yield from split(key, fp, out)

    def split(key, fp, out):
        starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        sizes = np.diff(starts, append=len(key))
        long = np.repeat(sizes > most, sizes)
        if long.any():
            yield out(True, key[long], fp[long])
            key, fp = key[~long], fp[~long]
        if len(key):
            yield out(False, *_links(key, fp))

    return rows.mapInArrow(run, "hot boolean, a bigint, b bigint")


def link_fingerprints(distinct: DataFrame, most: int = RUN) -> DataFrame:
    """a, b: edges with the same components as all pairs of at most four differing bits. ``distinct``: fp.

    Within a long run an edge names a member and the first of its group, which need not link directly.
    """
    spark = distinct.sparkSession
    with S.batches(spark, 50_000):
        rows = _variants(distinct).repartition("key").sortWithinPartitions("key", "fp")
        found = S.cut(_within_keys(rows, most), "links")
        links = found.filter("not hot").select("a", "b")
        hot = found.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
        if hot.limit(1).count():
            # block of a fingerprint, then every pair of blocks of its key that the block is part of
            blocks = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (most // 2)).cast("int").alias("n"))
            dealt = hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
            again = _within_keys(dealt.repartition("key").sortWithinPartitions("key", "fp"), 1 << 62)
            links = links.unionAll(S.cut(again.select("a", "b"), "links"))
    return links


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach.

    Null and empty texts and texts of white space have fingerprint zero and link like any other; a text with
    fewer words than a shingle is hashed whole. Repeated rows stay, in one component. Rows with a null doc_id
    stay and are never a component's name, unless it has no other. Other columns are not read.
    """
    spark = docs.sparkSession
    S.bounded_batches(spark)
    prints = S.cut(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = S.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    group = components(link_fingerprints(distinct.select("fp")))
    named = distinct.join(group.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = S.cut(named.join(least, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
