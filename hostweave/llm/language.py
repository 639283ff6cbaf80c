"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (1 to 3 letters, word edges included) in falling order.
A text's own n-grams are ranked alike; the distance to a profile is the sum, over the text's ranked n-grams,
of how far each is out of place, with ``PROFILE`` for one the profile lacks. The nearest profile wins.

Profiles are learnt from a bounded sample of labelled texts for each language, counted where the texts are;
only profiles reach the driver, ``PROFILE`` n-grams for each language there is. Rows are drawn by their ids, so
that drawing reads no text. Scoring is one map-side pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _support as S

#: Ranked n-grams of a profile and of a text.
PROFILE = 300
#: Labelled texts of a language that profiles are learnt from, whole; those of least hashes are taken.
SAMPLE_ROWS = 600
#: Letters of a text whose n-grams are counted at once while learning; only memory depends on it.
STRETCH = 1 << 20
#: Groups of partitions in which a language's least hashes are found first.
DEALT = 256
#: Languages whose ends of the sample are broadcast, a row each; beyond them the join is shuffled.
BROADCAST_LANGUAGES = 20_000
UNKNOWN = "und"


@lru_cache(maxsize=4)
def _letter_table(alphabet: str) -> np.ndarray:
    """Code point -> 0 for no letter, 2 and up for the alphabet's letters, and above them a number for each other letter."""
    out = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000) * (np.arange(0x110000) + len(alphabet) + 2)
    for i, c in enumerate(alphabet):
        out[ord(c)] = i + 2
    return out


def _codes(text: str, alphabet: str) -> np.ndarray:
    """Letters of the lower-cased text as numbers, single zeros between words and at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    a = np.zeros(len(points) + 2, np.int64)
    a[1:-1] = _letter_table(alphabet)[points]
    return a[np.append((a[:-1] != 0) | (a[1:] != 0), True)]


def _grams(a: np.ndarray, base: int) -> np.ndarray:
    """n-gram numbers: one, two and three letters lie in ranges of their own, n-grams with a letter outside the alphabet below zero."""
    if len(a) < 2 or not a.any():
        return np.zeros(0, np.int64)
    if a.max() >= base:
        far = a >= base
        low = _grams(np.where(far, 1, a), base).astype(np.int64)
        own = np.concatenate([far[a > 0], far[:-1] | far[1:], far[:-2] | far[1:-1] | far[2:]])
        return np.where(own, -_grams(a, base + 0x110000), low)  # no profile has them; the product stays below 2**63
    two = a[:-1] * base + a[1:]
    three = two[:-1] * base + a[2:]
    out = np.concatenate([a[a > 0], base + two, base + base * base + three])
    return out.astype(np.int32) if base < 1200 else out


def ranked(text: str, alphabet: str, size: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """The text's most frequent n-grams, most frequent first (equals by number), and their counts."""
    base = len(alphabet) + 2
    grams = _grams(_codes(text, alphabet), base)
    space = base + base * base + base**3
    if len(grams) > 8_000 and space <= 1 << 20 and grams.min() >= 0:
        counts = np.bincount(grams, minlength=space)
        known = np.flatnonzero(counts)
        counts = counts[known]
    else:
        known, counts = np.unique(grams, return_counts=True)
    if len(known) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        known, counts = known[keep], counts[keep]
    order = np.argsort(-counts, kind="stable")[:size]
    return known[order].astype(np.int64), counts[order]


class Profiles:
    """Ranks of all languages' n-grams: a sorted vocabulary and a row of ranks for each entry."""

    def __init__(self, alphabet: str, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.alphabet, self.size, self.languages = alphabet, size, sorted(profiles)
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)])).astype(np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int32)
        for i, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, profiles[name]), i] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: one less the distance as a share of the greatest possible."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        grams, _ = ranked(text, self.alphabet, self.size)
        if not len(grams):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, grams), max(len(self.grams) - 1, 0))
        known = self.grams[at] == grams if len(self.grams) else np.zeros(len(grams), bool)
        theirs = self.ranks[np.where(known, at, len(self.grams))]
        out_of_place = np.where(theirs >= 0, np.minimum(np.abs(theirs - np.arange(len(grams))[:, None]), self.size), self.size)
        distance = out_of_place.sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], float(1.0 - distance[best] / (self.size * len(grams)))


def _least(rows: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows of each language, those of least ``o``.

    Found among the rows of like partition numbers first, so that a frequent language isn't one task's.
    """
    for keys in (["lang", "deal"], ["lang"]):
        if "deal" in keys:
            rows = rows.withColumn("deal", F.spark_partition_id() % DEALT)
        order = Window.partitionBy(*keys).orderBy("o")
        rows = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= size).drop("k")
    return rows.drop("deal")


def _sample(rows: DataFrame, size: int) -> DataFrame:
    """lang, text of at most ``size`` rows (lang, text, o) of each language: those of least ``o``.

    First the languages' least hashes are found without reading a text, then rows that have them; a row limit
    follows, as many rows may share a hash. Texts aren't shuffled to be compared with the hashes: their ends, a
    row a language, are broadcast while they are few, and beyond that the join's keys are the hashes themselves.
    """
    least = S.cut(_least(rows.select("lang", "o"), size), "language-hashes")
    last = least.groupBy("lang").agg(F.max("o").alias("last"))
    if last.count() <= BROADCAST_LANGUAGES:
        near = rows.join(F.broadcast(last), "lang").filter("o <= last").select("lang", "text", "o")
    else:
        near = rows.join(least.distinct(), ["lang", "o"]).select("lang", "text", "o")
    out = S.cut(_least(near, size).select("lang", "text"), "language-sample")
    S.discard(least)
    return out


def _counted(text: str, alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a text and how often each is there, a stretch of letters at a time."""
    codes, base = _codes(text, alphabet), len(alphabet) + 2
    parts = []
    for i in range(0, max(1, len(codes)), STRETCH):
        part = codes[i : i + STRETCH + 2]
        used, n = np.unique(_grams(part, base), return_counts=True)
        if len(codes) > i + STRETCH:  # what begins after the stretch belongs to the next
            next_, m = np.unique(_grams(part[STRETCH:], base), return_counts=True)
            n[np.searchsorted(used, next_)] -= m
        parts.append((used, n))
    return _summed(parts)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, n = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
    used, at = np.unique(grams, return_inverse=True)
    return used, np.bincount(at.reshape(-1), n, len(used)).astype(np.int64)


def learn(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, size: int = PROFILE, order: Column | None = None) -> Profiles:
    """Profiles from labelled rows (text, lang); rows without text or language teach nothing.

    ``order``: a hash by which rows are drawn, one of the text if it is not given.
    """
    rows = rows.filter("text is not null and lang is not null")
    rows = rows.select("lang", "text", (F.xxhash64("text") if order is None else order).alias("o"))
    sample = _sample(rows, sample_rows)
    letters = F.explode(F.array_distinct(F.split(F.lower("text"), "")))
    common = sample.select(letters.alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").collect()  # a row per character
    alphabet = "".join(r.c for r in common if len(r.c) == 1 and r.c.isalpha())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, []).append(_counted(text, alphabet))
            for lang, parts in seen.items():
                used, n = _summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    total = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = total.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= size)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "k").collect():  # `size` rows per language
        profiles.setdefault(r.lang, []).append(r.gram)
    S.discard(sample)
    return Profiles(alphabet, {k: np.array(v, np.int64) for k, v in profiles.items()}, size)


def identify(docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, lang_pred, score of every row, with profiles learnt from rows where ``learn_from`` holds.

    A text that is null or has no letter is ``und`` with score 0, and so is any text if there is nothing to
    learn from. Of languages equally near the first by name is given. Repeated rows give repeated results, and
    null doc_ids stay; a row for which ``learn_from`` is null teaches nothing. Other columns are not read; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    S.bounded_batches(spark)
    rows = docs.filter(learn_from).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(doc_id).alias("drawn"))
    profiles = learn(rows, sample_rows, order=F.col("drawn"))
    shared = spark.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.begin("language")
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
