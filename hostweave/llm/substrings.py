"""Incremental substring dedup: a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words. Its anchor is the least hash among the shorter grams inside it, so
equal windows have equal anchors at equal offsets, and neighbouring windows mostly share theirs. The index
keeps one entry for each stretch of windows with a common anchor: (anchor hash, digest of the stretch's words,
first holder), about one for every 17 words instead of one for each.

The index is a log of immutable runs: tables bucketed by anchor and sorted, one file a bucket. A batch of
documents, in ascending doc_id order, becomes a sorted run. That run is merge-joined with every older run; both
sides lie in the same buckets, so neither is shuffled. A stretch that an older run or a smaller document of the
batch has is covered whole: its 128-bit BLAKE2b digest is of the words themselves, so equality is verified and
not guessed from rolling hashes. Only where documents share an anchor but not the stretch, at the edges of what
they share, are single windows compared, by digests of their words, which are read again from the first holder
of each such stretch; only documents that such a hit names are joined with their texts. At last runs of like
size are merged, so an entry is rewritten as often as the logarithm of the number of batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _support as S
from .rolling import Sequence, WordHashes, runs, window_minima

WINDOW = 50
#: Words of a gram from which anchors are chosen.
GRAM = 18
#: A run is merged with its predecessor while that is at most so many times its size.
LIKE_SIZE = 2

_KEY = ["h", "r", "q"]
#: So that tables bucketed by h serve joins on (h, r, q), and sorted buckets are neither sorted nor hashed again.
_MERGE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.execution.replaceHashWithSortAgg": "true"}


class _Text:
    """One text's words with the digests of stretches of them."""

    def __init__(self, words: list[bytes], window: int):
        self.words, self.window = words, window
        self.joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        self.starts, self.stops = np.append(0, ends), ends - 1

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(self.joined).digest()

    def digests(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """128 bits of the words from ``first`` to before ``stop``, as two columns of integers."""
        joined, blake = self.joined, hashlib.blake2b
        out = [blake(joined[i:j], digest_size=16).digest() for i, j in zip(self.starts[first].tolist(), self.stops[stop - 1].tolist(), strict=True)]
        return np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)

    def stretches(self, hashes: WordHashes, gram: int) -> tuple[np.ndarray, ...]:
        """Anchor hash, the digest's halves, first window and windows after it, of each stretch with one anchor."""
        grams = Sequence(hashes.of(self.words)).grams(gram)
        least = window_minima(grams, self.window - gram + 1)
        first, last = runs(least)
        digests = self.digests(first, last + self.window)
        return grams[least[first]].view(np.int64), digests[:, 0], digests[:, 1], first, last - first


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()  # bytes: ASCII white space only


def _key_of(digest: bytes) -> int:
    """What, with the doc_id, names a text: rows that share both have the same words."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _fingerprinted(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, key, n_words, digest of the words, and the packed stretches of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, names = WordHashes(), ["doc_id", "key", "n_words", "digest", "h", "r", "q", "place"]
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                text = _Text(_split(value), window)
                digest, packed = text.digest, (None,) * 4
                if len(text.words) >= window:
                    h, r, q, first, more = text.stretches(hashes, gram)
                    packed = (h.tobytes(), r.tobytes(), q.tobytes(), (first * 64 + more).astype("<i8").tobytes())
                rows.append((_key_of(digest), len(text.words), digest, *packed))
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.mapInArrow(run, "doc_id bigint, key bigint, n_words bigint, digest binary, h binary, r binary, q binary, place binary")


def _unpacked(prints: DataFrame) -> DataFrame:
    """h, r, q, doc_id, key, place: a row per stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, r, q, place = (np.frombuffer(b"".join(c.to_pylist()), "<i8") for c in batch.columns[2:])
            sizes = np.array([len(x) // 8 for x in batch.column(2).to_pylist()])
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(r), pa.array(q), batch.column(0).take(at), batch.column(1).take(at), pa.array(place)], [*_KEY, "doc_id", "key", "place"])

    rows = prints.filter("h is not null and doc_id is not null").select("doc_id", "key", *_KEY, "place")
    return rows.mapInArrow(run, "h bigint, r bigint, q bigint, doc_id bigint, key bigint, place bigint")


class FingerprintIndex:
    """The log of runs; grows by ``ingest``, batch by batch. ``with`` drops its tables at the end."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM):
        self.spark, self.window, self.gram, self.width = spark, window, gram, S.shuffle_width(spark)
        self.runs: list[DataFrame] = []
        self.docs: list[DataFrame] = []

    def __enter__(self) -> FingerprintIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _run(self, entries: DataFrame, in_buckets: bool = False) -> DataFrame:
        """Write one immutable run (h, r, q, doc_id, key, place, n), bucketed and sorted, one file a bucket."""
        path = S.scratch_path(self.spark, "run")
        name = "run_" + path.rpartition("-")[2]
        if not in_buckets:
            entries = entries.repartition(self.width, "h")
        entries.sortWithinPartitions(*_KEY).write.bucketBy(self.width, "h").sortBy(*_KEY).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._scratch, out._name = path, name
        out._entries = out.count()
        return out

    def _drop(self, run: DataFrame) -> None:
        self.spark.sql(f"drop table if exists {run._name}")
        S.discard(run)

    def close(self) -> None:
        for run in self.runs:
            self._drop(run)
        self.runs = []

    def compact(self) -> None:
        """Merge the newest runs while they are of like size. The older run's holder is the smaller one."""
        while len(self.runs) > 1 and self.runs[-2]._entries <= LIKE_SIZE * self.runs[-1]._entries:
            old, new = self.runs[-2:]
            theirs = new.select(*_KEY, *(F.col(c).alias(f"new_{c}") for c in ("doc_id", "key", "place", "n"))).hint("merge")
            both = old.join(theirs, _KEY, "full")
            kept = [F.when(F.col("n").isNotNull(), F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in ("doc_id", "key", "place")]
            with S.settings(self.spark, _MERGE):
                merged = self._run(both.select(*_KEY, *kept, (F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n")), in_buckets=True)
            self.runs[-2:] = [merged]
            self._drop(old)
            self._drop(new)

    def merge_join(self, own: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``own`` with ``old`` (an older run has the stretch) and ``contested``; and older entries with those anchors.

        An anchor is contested if the runs together have more than one stretch for it.
        """

        def ends(run: DataFrame, tag: str) -> DataFrame:
            return run.groupBy("h").agg(*(f(c).alias(f"{f.__name__}_{c}_{tag}") for f in (F.min, F.max) for c in ("r", "q")))

        entries, anchors = own.withColumn("old", F.lit(False)), ends(own, "own")
        differ = F.lit(False)
        for c in ("r", "q"):
            differ = differ | (F.col(f"min_{c}_own") != F.col(f"max_{c}_own"))
        for i, run in enumerate(self.runs):
            older = run.select(*_KEY, F.lit(True).alias(f"old_{i}")).hint("merge")
            entries = entries.join(older, _KEY, "left").withColumn("old", F.col("old") | F.coalesce(f"old_{i}", F.lit(False))).drop(f"old_{i}")
            anchors = anchors.join(ends(run, str(i)).hint("merge"), "h", "left")
            for c in ("r", "q"):
                for end in ("min", "max"):
                    differ = differ | F.coalesce(F.col(f"{end}_{c}_{i}") != F.col(f"min_{c}_own"), F.lit(False))
        contested = anchors.filter(differ).select("h", F.lit(True).alias("contested"))
        flagged = entries.join(contested.hint("merge"), "h", "left").withColumn("contested", F.coalesce("contested", F.lit(False)))
        theirs = None
        for run in self.runs:
            part = run.join(contested.hint("merge"), "h", "left_semi").select("doc_id", "key", "place")
            theirs = part if theirs is None else theirs.unionAll(part)
        return flagged.filter("old or contested or n > 1"), theirs

    def ingest(self, docs: DataFrame, compact: bool = True) -> DataFrame:
        """Results of one batch (doc_id, text), whose doc_ids must all be greater than any ingested before."""
        window, gram = self.window, self.gram
        prints = S.cut(_fingerprinted(docs, window, gram), "prints", "zstd")
        stretches = _unpacked(prints)
        since = prints.agg(F.min("doc_id").alias("m")).first().m
        least = F.min(F.struct("doc_id", "key", "place")).alias("first")
        own = self._run(stretches.groupBy(*_KEY).agg(least, F.count(F.lit(1)).alias("n")).select(*_KEY, "first.*", "n"))

        with S.settings(self.spark, _MERGE):
            flagged, theirs = self.merge_join(own)
            shared = S.cut(flagged.withColumnsRenamed({"doc_id": "first", "place": "at"}).drop("key", "at"), "shared")
            theirs = None if theirs is None else S.cut(theirs, "theirs")
        total = shared.agg(F.sum("n").alias("n")).first().n or 0

        mine = S.salted_join(stretches, shared, _KEY, total, ["doc_id", "key", "place"])
        covered = F.col("old") | (F.col("doc_id") > F.col("first"))
        mine = mine.filter(covered | F.col("contested")).select("doc_id", "key", F.when(covered, F.col("place")).alias("covered"), F.when(~covered, F.col("place")).alias("checked"))
        wanted = mine if theirs is None else mine.unionAll(theirs.select("doc_id", "key", F.lit(None).cast("bigint").alias("covered"), F.col("place").alias("checked")))
        wanted = wanted.groupBy("doc_id", "key").agg(F.collect_set("covered").alias("covered"), F.collect_set("checked").alias("checked"))
        texts = docs
        if theirs is not None and (span := theirs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()).lo is not None:
            for older in self.docs:
                texts = texts.unionAll(older.filter(F.col("doc_id").between(span.lo, span.hi)))
        work = S.cut(texts.join(wanted, "doc_id"), "work", "zstd")

        windows = S.cut(self._windows(work.filter(F.size("checked") > 0)), "windows")
        first = windows.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("first < top").drop("top")
        again = windows.filter(F.col("doc_id") >= F.lit(since))
        hits = S.salted_join(again, first, ["one", "two"], windows.count(), ["doc_id", "key", "start"]).filter("doc_id > first")
        hits = hits.groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))
        changed = S.cut(self._removed(work.filter(F.col("doc_id") >= F.lit(since)).join(hits, ["doc_id", "key"], "left")), "changed")
        for done in (windows, shared, theirs, work):
            S.discard(done)

        out = prints.select("doc_id", "key", "n_words", F.lower(F.hex("digest")).alias("all_sha256")).join(changed.distinct(), ["doc_id", "key"], "left")
        result = out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"))
        result = S.cut(result, "deduplicated")
        for done in (prints, changed):
            S.discard(done)
        self.docs.append(docs)
        self.runs.append(own)
        if compact:
            self.compact()
        return result

    def _windows(self, work: DataFrame) -> DataFrame:
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["one", "two", "doc_id", "key", "start"]
            for batch in batches:
                for i, (key, value, places) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                    text = _Text(_split(value), window)
                    if _key_of(text.digest) != key:
                        continue  # another text under the same doc_id
                    starts = _starts(places)
                    digests, at = text.digests(starts, starts + window), pa.array(np.full(len(starts), i))
                    yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(starts)], names)

        return work.select("doc_id", "key", "text", "checked").mapInArrow(run, "one bigint, two bigint, doc_id bigint, key bigint, start bigint")

    def _removed(self, work: DataFrame) -> DataFrame:
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                which, removed, shas = [], [], []
                for i, (key, value, covered, starts) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True)):
                    text = _Text(_split(value), window)
                    if _key_of(text.digest) != key:
                        continue
                    words = text.words
                    at = np.concatenate([_starts(covered), np.array(starts or [], np.int64)])
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    which.append(i)
                    removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
                at = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "key", "n_removed", "kept_sha256"])

        rows = work.select("doc_id", "key", "text", "covered", "starts")
        return rows.mapInArrow(run, "doc_id bigint, key bigint, n_removed bigint, kept_sha256 string")


def _starts(places: list[int] | None) -> np.ndarray:
    """The windows of packed stretches."""
    p = np.array(places or [], np.int64)
    first, size = p >> 6, (p & 63) + 1
    return np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 3, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words in windows that start in a smaller document too are removed.

    The table is ingested as ``batches`` ranges of doc_id, each against the index of those before. Null and
    empty texts have no words. Rows that share a doc_id are judged each by its own words, and none takes anything
    from another; rows with a null doc_id have nothing removed, and nothing is removed for them. Repeated rows
    all stay. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    S.bounded_batches(spark)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [1.0], 10_000).alias("c")).first().c or []
    cuts = sorted(set(cuts))[: batches - 1]
    out = None
    with FingerprintIndex(spark, window, gram) as index:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            part = docs
            if low is not None:
                part = part.filter(F.col("doc_id") > low)
            if high is not None:
                part = part.filter((F.col("doc_id") <= high) | (F.col("doc_id").isNull() & F.lit(low is None)))
            result = index.ingest(part, compact=high is not None)
            out = result if out is None else out.unionAll(result)
    return out
