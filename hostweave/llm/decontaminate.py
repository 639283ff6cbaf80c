"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words. Both sides hash their grams of ``GRAM`` words and keep, of every
window, the least gram hash; a shared window therefore shares a kept hash, so no shared span of a window's
length is missed. The test side's kept hashes are joined with a document's on the map side; a hit is extended
to the whole windows around it, which must equal a test window word for word. Test items shorter than a
window are one window of their own length and are looked up as such.

The test side travels to the executors in blocks whose text is bounded, so its size is known before it is
broadcast. One block is one scan of the documents; a larger benchmark takes a scan for each block, and the
hits found so far go along in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _support as S
from .rolling import Sequence, WordHashes

WINDOW = 10
GRAM = 5
#: Bytes of test text in one broadcast block.
BLOCK_BYTES = 4 << 20

#: A-Z to lower case; every other ASCII byte that is no letter or digit to a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


def sliding_least(grams: np.ndarray, window: int) -> np.ndarray:
    """The least value of every window of consecutive grams, by doubling."""
    out, span = grams, 1
    while 2 * span <= window:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    rest = window - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


class TestBlock:
    """The windows of a block of test items: kept gram hashes, and by window hash the words and items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, gram: int):
        hashes = WordHashes()
        kept: list[np.ndarray] = []
        self.windows: dict[int, dict[int, list[tuple[tuple[bytes, ...], set[str]]]]] = {}
        for name, text in items:
            words = words_of(text)
            size = min(window, len(words))
            if not size:
                continue
            sequence = Sequence(hashes.of(words))
            if size == window:
                kept.append(sliding_least(sequence.grams(gram), window - gram + 1))
            same = self.windows.setdefault(size, {})
            for at, h in enumerate(sequence.grams(size).tolist()):
                key = tuple(words[at : at + size])
                held = same.setdefault(h, [])
                names = next((n for k, n in held if k == key), None)
                if names is None:
                    held.append((key, names := set()))
                if name is not None:
                    names.add(name)
        self.kept = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
        self.window, self.gram = window, gram
        self.hashes = {size: np.array(sorted(same), np.uint64) for size, same in self.windows.items()}

    def find(self, words: list[bytes], hashes: WordHashes, hit: np.ndarray, names: set[str]) -> None:
        """Mark the words of all occurrences of test windows, and add the items they come from."""
        sequence = Sequence(hashes.of(words))
        for size, known in self.hashes.items():
            if len(words) < size:
                continue
            if size == self.window:
                least = sliding_least(sequence.grams(self.gram), size - self.gram + 1)
                starts = np.flatnonzero(_among(least, self.kept))
                if not len(starts):
                    continue
                found = sequence.stretch(starts, starts + size)
            else:
                starts, found = np.arange(len(words) - size + 1), sequence.grams(size)
            among = _among(found, known)
            for at, h in zip(starts[among].tolist(), found[among].tolist(), strict=True):
                for key, items in self.windows[size][h]:
                    if tuple(words[at : at + size]) == key:
                        hit[at : at + size] = True
                        names |= items


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document; before them columns ``keep``.

    Null and empty texts have no words; a test item without words has no window. Items that share an item_id
    count as one; an item whose id is null marks words but is not counted or named. Repeated document rows give
    repeated results. Other columns are not read. Without documents there are no rows, without test items no hits.
    """
    spark = docs.sparkSession
    S.bounded_batches(spark)
    tests = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("t"))
    size = tests.agg(F.sum(F.octet_length("t")).alias("b")).first().b or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    kept = [docs[c].alias(f"keep_{i}") for i, c in enumerate([doc_id] if keep is None else keep)]
    rows = docs.select(F.col(text).alias("text"), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"), *kept)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    for b in range(n_blocks):
        part = tests.filter(F.pmod(F.xxhash64("name", "t"), F.lit(n_blocks)) == b)
        block = spark.sparkContext.broadcast([(r.name, r.t) for r in part.collect()])
        last = b == n_blocks - 1
        schema = f"{kinds}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean" if last else f"text string, hit binary, items array<string>, {kinds}"
        rows = rows.mapInArrow(_scan(block, window, gram, last), schema)
        if not last:
            rows = S.cut(rows, "hits")
    return rows.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(["doc_id"] if keep is None else keep)})


def _scan(block, window: int, gram: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.begin("decontamination")
        tests, hashes = TestBlock(block.value, window, gram), WordHashes()
        for batch in batches:
            out = []
            for text, before, items in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                words, names = words_of(text), set(items or ())
                hit = np.zeros(len(words), bool)
                if before:
                    hit |= np.unpackbits(np.frombuffer(before, np.uint8), count=len(words)).astype(bool)
                if words:
                    tests.find(words, hashes, hit, names)
                if last:
                    n = int(hit.sum())
                    out.append((len(words), n, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n > 0))
                else:
                    out.append((np.packbits(hit).tobytes(), sorted(names)))
            kinds, names = ([pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()], ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]) if last else ([pa.binary(), pa.list_(pa.string())], ["hit", "items"])
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            kept, kept_names = batch.columns[3:], batch.schema.names[3:]
            if last:
                yield pa.RecordBatch.from_arrays([*kept, *cols], [*kept_names, *names])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *kept], ["text", *names, *kept_names])

    return run
