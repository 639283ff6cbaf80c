"""Packing of token sequences by a configuration linear program over the histogram of lengths.

A configuration (pattern) is a multiset of lengths that fits one sequence. The covering program, the fewest
sequences whose patterns hold every piece, is solved by multiplicative weights: a length's weight is its share of
a sequence times the exponential of how far it lags behind in being covered, a knapsack dynamic program prices
the best pattern through every length at once, and all patterns whose price is within ``WITHIN`` of the best are
used. The step is bounded by the width: a pattern is used as often as a ``SHARE`` of what its scarcest length has
left, rounded down, so that no length runs ahead of the others. Steps shrink with what is left, down to single
sequences; the little that fits no priced pattern any more is placed best-fit. Every pricing also proves a lower
bound, the weight of all pieces over the weight of the best pattern. The program sees a histogram of at most
``capacity`` rows, and its rounds grow with the logarithm of the number of pieces.

Tokenising is one map-side pass that writes a row per piece. A piece's rank within its length is the rank of
its task plus a counter within the task, so no sort or window gathers one length anywhere; the rank is then
looked up among the patterns' slots.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _support as S
from .pretokens import CACHE_ENTRIES, byte_bpe

CAPACITY = 2048
#: The share of a length's open pieces that one pattern may use in a round.
SHARE = 0.1
#: How much a length's weight grows by lagging, and how near the best price a pattern must be.
STEP = 0.02
WITHIN = 0.001

log = logging.getLogger(__name__)


def knapsack(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c], the greatest weight that c tokens of room can hold, and choice[c], the piece it takes first (or -1).

    An unbounded knapsack by dynamic programming; each step tries every length at once. ``lengths`` ascend.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - lengths[:k]] + weights[:k]
            j = k - 1 - int(gain[::-1].argmax())  # the longest of equals, as short pieces are easier to place
            if gain[j] > best[c]:
                best[c], choice[c] = gain[j], j
    return best, choice


def _filled(choice: np.ndarray, lengths: np.ndarray, room: int, pattern: dict[int, int]) -> dict[int, int]:
    """``pattern`` (piece number to how many) with what the knapsack puts into ``room``."""
    while room > 0:
        if (j := int(choice[room])) < 0:
            room -= 1
        else:
            pattern[j] = pattern.get(j, 0) + 1
            room -= int(lengths[j])
    return pattern


def price(weights: np.ndarray, lengths: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length the pattern of greatest weight has, no more than ``limits``."""
    order = np.argsort(lengths)
    _, choice = knapsack(weights[order], lengths[order], capacity)
    pattern = np.zeros(len(lengths), np.int64)
    for j, n in _filled(choice, lengths[order], capacity, {}).items():
        pattern[order[j]] = n
    return np.minimum(pattern, limits)


def _within_stock(pattern: dict[int, int], lengths: np.ndarray, rest: np.ndarray, capacity: int) -> dict[int, int]:
    """The pattern cut to the pieces there are, its room filled up with the longest that fit."""
    cut = {k: min(n, int(rest[k])) for k, n in pattern.items()}
    room = capacity - sum(int(lengths[k]) * n for k, n in cut.items())
    for k in range(int(np.searchsorted(lengths, room, side="right")) - 1, -1, -1):
        if lengths[k] <= room and (n := min(int(rest[k]) - cut.get(k, 0), room // int(lengths[k]))) > 0:
            cut[k] = cut.get(k, 0) + n
            room -= n * int(lengths[k])
    return {k: n for k, n in cut.items() if n}


def cover(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Patterns and how many sequences follow each, which together hold exactly the histogram's pieces; and a
    number of sequences below which no packing can get.

    The better of the program's solution and of plain best-fit is returned. ``rounds`` bounds the rounds of
    the program; best-fit has the rest.
    """
    need = {int(k): int(v) for k, v in histogram.items() if v > 0}
    if not need:
        return [], 0
    lengths = np.array(sorted(need))
    wanted = np.array([need[int(k)] for k in lengths], np.int64)
    rest, total = wanted.copy(), int(wanted.sum())
    bound = max(-(-int(lengths @ wanted) // capacity), int(wanted[2 * lengths > capacity].sum()))
    use: dict[tuple[tuple[int, int], ...], int] = {}

    def take(pattern: dict[int, int], n: int) -> None:
        for k, a in pattern.items():
            rest[k] -= n * a
        key = tuple(sorted(pattern.items()))
        use[key] = use.get(key, 0) + n

    for k in np.flatnonzero(lengths + lengths[0] > capacity):
        take({int(k): 1}, int(rest[k]))  # nothing fits beside these
    done, stuck = 0, False
    while rest.any() and (rounds is None or done < rounds):
        done += 1
        live = np.flatnonzero(rest)
        lag = rest / wanted / (rest.sum() / total) - 1
        weights, up = (lengths / capacity * np.exp(STEP * lag.clip(-1, 1)))[live], lengths[live]
        best, choice = knapsack(weights, up, capacity)
        bound = max(bound, int(np.ceil(float(wanted[live] @ weights) / best[capacity] - 1e-6)))
        through = weights + best[capacity - up]  # the best pattern that has the piece
        near = np.flatnonzero(through >= (1 - WITHIN) * best[capacity])
        taken = 0
        for i in near[np.argsort(-lag[live[near]], kind="stable")].tolist():
            if not rest[live[i]]:
                continue
            pattern = {int(live[k]): n for k, n in _filled(choice, up, capacity - int(up[i]), {i: 1}).items()}
            if stuck:
                pattern = _within_stock(pattern, lengths, rest, capacity)
            n = min(int(rest[k] * SHARE) // a for k, a in pattern.items()) or int(all(rest[k] >= a for k, a in pattern.items()))
            if n:
                take(pattern, n)
                taken += n
        if not taken and int(rest @ lengths) <= capacity * len(lengths):
            break
        stuck = not taken
    tail = best_fit({int(k): int(v) for k, v in zip(lengths, rest, strict=True) if v}, capacity)
    out = [({int(lengths[k]): a for k, a in key}, n) for key, n in use.items()] + tail
    plain = _decreasing(need, capacity)
    log.debug("program %d, plain best-fit %d sequences, %d rounds", sum(n for _, n in out), sum(n for _, n in plain), done)
    return min(out, plain, key=lambda patterns: sum(n for _, n in patterns)), bound


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None) -> list[tuple[dict[int, int], int]]:
    """The patterns of ``cover``; how far they may be from the best is logged."""
    patterns, bound = cover(histogram, capacity, rounds)
    log.info("packing: %d sequences by %d patterns, at least %d are needed", sum(n for _, n in patterns), len(patterns), bound)
    return patterns


def _decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    left, out = dict(histogram), []
    while left:
        pattern, room = {}, capacity
        for k in sorted(left, reverse=True):
            if n := min(left[k], room // k):
                pattern[k], room = n, room - n * k
        n = min(left[k] // v for k, v in pattern.items())
        out.append((pattern, n))
        left = {k: v - n * pattern.get(k, 0) for k, v in left.items() if v > n * pattern.get(k, 0)}
    return out


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: equal sequences are opened and filled together, not one by one."""
    return _decreasing(histogram, capacity)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with the task and the rank in it of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.begin("byte_bpe")
        coder, task = byte_bpe(vocabulary, cache_entries), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, which = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                raw = memoryview(coder.encode(value or "") + end)
                n = len(raw) // 4
                at = 0
                size = n % capacity or capacity  # the first piece takes the remainder
                for piece in range(-(-n // capacity)):
                    rows.append((piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), int(seen[size])))
                    which.append(i)
                    seen[size] += 1
                    at, size = at + size, capacity
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array([task] * len(rows), pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"],
            )

    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint, task int")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, rounds: int | None = None, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Place of every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id. A document longer than ``capacity`` is cut into pieces
    of that length, the first shorter; no other is cut. Repeated rows and equal doc_ids are documents of their
    own, null doc_ids stay null. Other columns are not read. An empty table gives no rows. Within a sequence
    pieces lie without gaps from offset 0.
    """
    spark = docs.sparkSession
    S.bounded_batches(spark)
    pieces = S.cut(token_pieces(docs, vocabulary, capacity, doc_id, text, end_id, cache_entries), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most

    # slots: for a length, ranks from `low` on go to sequences from `seq` on, `each` to a sequence, from `offset` on
    slots: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in solve(histogram, capacity, rounds):
        offset = 0
        for length, each in sorted(pattern.items(), reverse=True):
            slots.append((length, used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        sequence += n
    slots.sort()
    shared = spark.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 5))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at, where = shared.value, np.zeros((2, len(length)), np.int64)
        for k, rows in length.groupby(length).groups.items():
            i = length.index.get_indexer(rows)
            lo, hi = np.searchsorted(at[:, 0], [k, k + 1])
            r = rank.to_numpy()[i]
            j = lo + np.searchsorted(at[lo:hi, 1], r, side="right") - 1
            nth = r - at[j, 1]
            where[0, i], where[1, i] = at[j, 2] + nth // at[j, 3], at[j, 4] + nth % at[j, 3] * k
        return pd.DataFrame({"sequence_id": where[0], "offset": where[1]})

    placed = F.pandas_udf(place, "sequence_id bigint, offset bigint")
    base = per_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("length", "task", F.coalesce("base", F.lit(0)).alias("base"))
    out = pieces.join(base, ["length", "task"]).withColumn("at", placed("length", F.col("base") + F.col("nth")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
