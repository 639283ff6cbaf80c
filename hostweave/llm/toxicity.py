"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of three hashed embeddings: of the word and of its first four and five letters, so
inflections of a stem share most of it. Filters of one, two and three words slide over the text; each
filter's greatest response after a rectifier is pooled and a logistic unit weighs them. Pooling makes a score
depend on the strongest passage, however long the text is.

Every labelled row counts. A quarter of the texts, by hash, is held back; each pass over all others trains a copy of
the model on every partition of them and averages the copies, weight by weight. On all that is held back a threshold
is chosen for each language, which is recognised from the same hashed words (counted in all training texts), never
read from a column; the score is shifted so that a language's threshold is 0.5. Scoring is one map-side pass. No word
becomes a Python object on the way: numpy finds the words of many texts at once and takes their checksums byte by byte.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _support as S

#: Bytes that all texts of a warm start may have, where one is asked for.
SAMPLE_BYTES = 48 << 20

BUCKETS = 1 << 15
WIDTH = 12
FILTERS = 8
SPANS = (1, 2, 3)
EPOCHS = 6
#: Texts of a copy of the model in each pass over all rows, at least: fewer would hardly move it from where it started.
COPY_LEAST = 2000
BATCH = 32
RATE = 0.08
#: Spread of untrained embeddings: small, so that words never seen hardly move a filter.
INIT = 0.01
#: The share of the labelled texts held back to calibrate, and the examples of either class that a language needs.
HELD_BACK = 0.25
CALIBRATION_LEAST = 5
#: Texts that a language needs to be recognised.
LANGUAGE_LEAST = 10
#: Words of a text that training looks at together; characters whose words are found at once; rows of embeddings sent as one.
STRETCH = 1 << 15
PIECE = 1 << 18
BLOCK = 1 << 10
#: Bytes of a word up to which its checksum is taken together with those of other words; 20 at least, for five letters.
STEPS = 48
#: Slices of a unit of z in which greatest F1 is sought, and the most on either side of 0.
SLICES = 64
MOST_SLICES = 1 << 12

_WORDS = re.compile(r"[^\W\d_]+")
_NO_LETTER = re.compile(r"[\W\d_]")
#: Columns of a word's shares: for each span, for each place in it, all its filters.
_COLUMNS = FILTERS * sum(SPANS)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def buckets(words: list[str]) -> np.ndarray:
    """Three bucket numbers for each word."""
    mask = BUCKETS - 1
    crc = zlib.crc32
    return np.array([(crc(w.encode()) & mask, crc(b"4" + w[:4].encode()) & mask, crc(b"5" + w[:5].encode()) & mask) for w in words], np.int64).reshape(-1, 3)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether words may hold a character, for those below U+10000."""
    return np.array([c.isalnum() and not c.isdecimal() for c in map(chr, range(1 << 16))])


def _is_letter(codes: np.ndarray) -> np.ndarray:
    far = np.flatnonzero(codes >= 1 << 16)
    if not len(far):
        return _letters()[codes]
    out = _letters()[np.minimum(codes, (1 << 16) - 1)]
    found, which = np.unique(codes[far], return_inverse=True)
    out[far] = np.array([_WORDS.match(chr(c)) is not None for c in found.tolist()])[which]
    return out


@lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """crc32's table of steps; and what a first byte "4" or "5" changes in the state after so many more bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    first = np.array([zlib.crc32(b) for b in (b"4", b"5")], np.uint32)  # inverted, as the state without a first byte is
    out = [first]
    for _ in range(4 * 5):
        out.append(step[out[-1] & 0xFF] ^ out[-1] >> 8)
    return step, np.array(out)


def _checksums(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of every word of lower-case texts, of "4" and its first four and "5" and its first five letters; a text's words."""
    joined = " ".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter = np.zeros(len(codes) + 2, bool)
    letter[1:-1] = _is_letter(codes)
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    first, end = edges[::2], edges[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    n_words = np.diff(np.searchsorted(first, begins))
    stops = [np.minimum(first + n, end) for n in (4, 5)]
    raw = np.frombuffer(joined.encode(), np.uint8)
    if len(raw) > len(codes):  # from characters to bytes
        at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), out=at[1:])
        first, end, stops = at[first], at[end], [at[x] for x in stops]
    size, heads = end - first, np.array([x - first for x in stops])
    order = np.argsort(-np.minimum(size, STEPS + 1).astype(np.int8), kind="stable")
    first, size, heads = first[order], size[order], heads[:, order].astype(np.int8)
    step, change = _crc_tables()
    state = np.full((3, len(first)), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(size.max(initial=0)), STEPS)):
        n = np.count_nonzero(size > k)
        now = state[0, :n]
        now[:] = step[(now ^ raw[first[:n] + k]) & 0xFF] ^ now >> 8
        for j in range(2):
            if k < 4 * (4 + j):
                np.copyto(state[1 + j, :n], now, where=heads[j, :n] == k + 1)
    state = ~state
    for k in range(np.count_nonzero(size > STEPS)):
        state[0, k] = zlib.crc32(raw[first[k] : first[k] + size[k]])
    for j in range(2):
        state[1 + j] ^= change[heads[j], j]
    out = np.empty((len(order), 3), np.uint32)
    out[order] = state.T
    return out, n_words


def checksums_of(texts: list[str | None]) -> list[np.ndarray]:
    """For each text three numbers a word, of which ``buckets`` are the low bits."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        found, n_words = _checksums([t for _, t in held])
        ends = np.cumsum(n_words)
        for (k, _), i, j in zip(held, (ends - n_words).tolist(), ends.tolist(), strict=True):
            out[k].append(found[i:j])
        held.clear()
        size = 0

    for k, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while at < len(text):
            gap = _NO_LETTER.search(text, at + PIECE)  # a longer text is cut between words
            end = gap.start() if gap else len(text)
            held.append((k, text[at:end]))
            size, at = size + end - at, end
            if size >= PIECE:
                flush()
    if held:
        flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros((0, 3), np.uint32) for x in out]


def buckets_of(texts: list[str | None]) -> list[np.ndarray]:
    """``buckets`` of the words of each text."""
    return [(x & np.uint32(BUCKETS - 1)).astype(np.int64) for x in checksums_of(texts)]


@dataclass
class Model:
    embeddings: np.ndarray
    filters: np.ndarray  # WIDTH x _COLUMNS
    bias: np.ndarray  # a filter's
    weights: np.ndarray
    offset: float
    languages: list[str] = field(default_factory=list)
    evidence: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))


def responses(shares: np.ndarray) -> np.ndarray:
    """Filter responses at every place of a text, from its words' shares; two places of padding at the end."""
    n, at, out = len(shares), 0, []
    padded = np.vstack([shares, np.zeros((max(SPANS) - 1, shares.shape[1]), shares.dtype)])
    for span in SPANS:
        total = padded[:n, at : at + FILTERS].copy()
        for j in range(1, span):
            total += padded[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
        out.append(total)
        at += span * FILTERS
    return np.hstack(out)


class Scorer:
    """Scores whole texts. ``entries``: words of texts looked at together; ``stretch``: words of one text among them."""

    def __init__(self, model: Model, entries: int = 1 << 13, stretch: int = 1 << 13):
        self.model, self.entries, self.stretch = model, entries, stretch
        self.embeddings = np.vstack([model.embeddings, np.zeros(WIDTH)]).astype(np.float32)  # the last row stands after texts
        self.filters = np.ascontiguousarray(model.filters.T, np.float32)
        self.evidence = np.ascontiguousarray(model.evidence.T)

    def _best(self, parts: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """Each filter's greatest response (a column a part) at the first ``sizes`` places of parts."""
        pad = max(SPANS) - 1
        last = np.full((pad, 3), BUCKETS)
        rows = np.concatenate([x for part in parts for x in (part, last)])
        lengths = np.array([len(x) + pad for x in parts])
        begins = np.cumsum(lengths) - lengths
        vectors = self.embeddings[rows[:, 0]]
        vectors += self.embeddings[rows[:, 1]]
        vectors += self.embeddings[rows[:, 2]]
        bounds = np.stack([begins, begins + sizes], axis=1).reshape(-1)
        shares, n, at, out = self.filters @ vectors.T, len(rows) - pad, 0, []
        for span in SPANS:
            total = shares[at : at + FILTERS, :n]
            for j in range(1, span):
                total += shares[at + j * FILTERS : at + (j + 1) * FILTERS, j : j + n]
            out.append(np.maximum.reduceat(total, bounds[: -1 if bounds[-1] == n else None], axis=1)[:, ::2])
            at += span * FILTERS
        return np.vstack(out)

    def raw_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The logistic unit's inputs before calibration, and the recognised languages' numbers (or -1)."""
        m, overlap = self.model, max(SPANS) - 1
        best = np.zeros((len(texts), len(m.bias)))  # a rectifier's least response
        spoken = np.full(len(texts), -1)
        held: list[tuple[int, np.ndarray, int]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            found = self._best([x for _, x, _ in held], np.array([n for _, _, n in held])).T + m.bias
            np.maximum.at(best, [k for k, _, _ in held], found)
            held.clear()
            size = 0

        for k, rows in enumerate(buckets_of(texts)):
            heard = np.zeros(len(m.languages))
            for i in range(0, len(rows), self.stretch):
                part = rows[i : i + self.stretch + overlap]
                if held and size + len(part) > self.entries:
                    flush()
                held.append((k, part, min(self.stretch, len(rows) - i)))
                size += len(part)
                heard += self.evidence.take(rows[i : i + self.stretch, 0], axis=1).sum(axis=1, dtype=np.float64)
            if len(rows) and len(heard):
                spoken[k] = heard.argmax()
        if held:
            flush()
        return best @ m.weights + m.offset, spoken

    def raw(self, text: str | None) -> tuple[float, int]:
        z, language = self.raw_of([text])
        return float(z[0]), int(language[0])

    def score_of(self, texts: list[str | None]) -> np.ndarray:
        z, language = self.raw_of(texts)
        z -= self.model.thresholds[language]  # the last entry serves texts without a language
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def score(self, text: str | None) -> float:
        return float(self.score_of([text])[0])


class Trainer:
    """Stochastic gradients with per-weight steps (Adagrad); only the places that won the pooling learn."""

    SPAN = np.repeat(SPANS, FILTERS)
    COLUMN = np.concatenate([np.arange(FILTERS) + FILTERS * sum(SPANS[:i]) for i in range(len(SPANS))])
    NAMES = ("filters", "bias", "weights", "offset")

    def __init__(self, model: Model, grads: dict[str, np.ndarray] | None = None):
        self.model = model
        self.grads = grads or {k: np.full_like(np.asarray(getattr(model, k), float), 1e-6) for k in ("embeddings", *self.NAMES)}
        self.pulled = np.zeros(BUCKETS)  # how often a row of embeddings learnt
        self.seen = 0

    def buckets_of(self, text: str | None) -> np.ndarray:
        """Bucket numbers of a text's words."""
        return buckets_of([text])[0]

    def responses(self, vectors: np.ndarray) -> np.ndarray:
        """What ``responses`` gives, a filter a row, for all places but the last two."""
        shares, n, at, out = self.model.filters.T @ vectors.T, len(vectors) - max(SPANS) + 1, 0, []
        for span in SPANS:
            total = shares[at : at + FILTERS, :n].copy()
            for j in range(1, span):
                total += shares[at + j * FILTERS : at + (j + 1) * FILTERS, j : j + n]
            out.append(total)
            at += span * FILTERS
        return np.vstack(out)

    def pool(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's greatest response in a text and its place; a stretch of words is looked at together."""
        emb, pad, every = self.model.embeddings, max(SPANS) - 1, np.arange(len(self.SPAN))
        best, won = np.full((len(docs), len(every)), -np.inf), np.zeros((len(docs), len(every)), np.int64)
        parts = [(k, i, rows[i : i + STRETCH + pad], min(STRETCH, len(rows) - i)) for k, rows in enumerate(docs) for i in range(0, len(rows), STRETCH)]
        while parts:
            size, n = 0, 0
            while n < len(parts) and (n == 0 or size + len(parts[n][2]) + pad <= STRETCH):
                size, n = size + len(parts[n][2]) + pad, n + 1
            now, parts = parts[:n], parts[n:]
            vectors, at = np.zeros((size, WIDTH)), 0
            for _, _, rows, _ in now:
                vectors[at : at + len(rows)] = emb[rows[:, 0]] + emb[rows[:, 1]] + emb[rows[:, 2]]
                at += len(rows) + pad
            r, at = self.responses(vectors), 0
            for k, i, rows, places in now:
                top = r[:, at : at + places].argmax(axis=1)
                value = r[every, at + top]
                better = value > best[k]
                best[k, better], won[k, better] = value[better], i + top[better]
                at += len(rows) + pad
        return best + self.model.bias, won

    def move(self, name: str, gradient, where=slice(None)) -> None:
        self.grads[name][where] += gradient**2
        getattr(self.model, name)[where] -= RATE * gradient / np.sqrt(self.grads[name][where])

    def learn(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        """One step from texts, as bucket numbers of their words (one at least)."""
        m, spans = self.model, self.SPAN
        pooled, won = self.pool(docs)
        pooled = np.maximum(pooled, 0)
        z = pooled @ m.weights + m.offset
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) / len(docs)
        back = error[:, None] * m.weights * (pooled > 0)
        to_filters = np.zeros_like(m.filters)
        touched, pulls = [], []
        words, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
        first = np.cumsum(sizes) - sizes
        for j in range(max(SPANS)):
            k, c = np.nonzero((spans > j) & (won + j < sizes[:, None]) & (back != 0))
            cols, at, pull = self.COLUMN[c] + j * FILTERS, words[first[k] + won[k, c] + j], back[k, c, None]
            np.add.at(to_filters.T, cols, m.embeddings[at].sum(axis=1) * pull)
            touched.append(at)
            pulls.append(pull * m.filters.T[cols])
        self.move("weights", pooled.T @ error)
        self.move("bias", back.sum(axis=0))
        self.move("filters", to_filters)
        self.grads["offset"] = self.grads["offset"] + error.sum() ** 2
        m.offset = float(m.offset - RATE * error.sum() / np.sqrt(self.grads["offset"]))
        places, pull = np.concatenate(touched), np.concatenate(pulls)
        unique, inverse, often = np.unique(places.reshape(-1), return_inverse=True, return_counts=True)
        total = np.zeros((len(unique), WIDTH))
        np.add.at(total, inverse.reshape(-1), np.repeat(pull, 3, axis=0))
        self.move("embeddings", total, unique)
        self.pulled[unique] += often
        self.seen += len(docs)

    def dense(self) -> np.ndarray:
        """All weights but embeddings, and after them what their steps go by."""
        return np.concatenate([np.ravel(x) for x in (*(getattr(self.model, k) for k in self.NAMES), *(self.grads[k] for k in self.NAMES))])

    def set_dense(self, flat: np.ndarray) -> None:
        parts = [np.asarray(getattr(self.model, k)) for k in self.NAMES]
        for half in range(2):
            for name, like in zip(self.NAMES, parts, strict=True):
                now, flat = flat[: like.size].reshape(like.shape).copy(), flat[like.size :]
                if half:
                    self.grads[name] = now
                else:
                    setattr(self.model, name, now if like.shape else float(now))


def untrained(rng: np.random.Generator, prior: float) -> Trainer:
    model = Model(rng.normal(0, INIT, (BUCKETS, WIDTH)), rng.normal(0, 0.3, (WIDTH, _COLUMNS)), np.zeros(FILTERS * len(SPANS)), rng.normal(0, 0.3, FILTERS * len(SPANS)), 0.0)
    prior = np.clip(prior, 0.01, 0.99)
    model.offset = float(np.log(prior / (1 - prior)))
    return Trainer(model)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    return start(texts, labels, epochs, seed).model


def start(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Trainer:
    """A trainer after ``epochs`` passes over a list of texts."""
    rng = np.random.default_rng(seed)
    trainer = untrained(rng, labels.mean() if len(labels) else 0.5)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    rows = buckets(list(vocabulary))
    usable = [i for i, d in enumerate(docs) if len(d)]
    for _ in range(epochs):
        rng.shuffle(usable)
        for at in range(0, len(usable), BATCH):
            batch = usable[at : at + BATCH]
            trainer.learn([rows[docs[i]] for i in batch], labels[batch])
    return trainer


def language_evidence(texts: list[str], langs: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Log share of each bucket in a language's words, for every language with ten texts of the list."""
    names = sorted(x for x, n in Counter(langs).items() if x is not None and n >= LANGUAGE_LEAST)
    number = {x: i for i, x in enumerate(names)}
    out = np.full((BUCKETS, len(names)), 0.5)
    for text, lang in zip(texts, langs, strict=True):
        if lang in number:
            unique = list(dict.fromkeys(words_of(text)))
            if unique:
                np.add.at(out[:, number[lang]], buckets(unique)[:, 0], 1)
    return names, np.log(out / out.sum(axis=0)).astype(np.float32) if names else out.astype(np.float32)


def threshold(z: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The cut of greatest F1, in the middle of the gap it lies in."""
    order = np.argsort(-z)
    z, toxic, weight = z[order], toxic[order], weight[order]
    found = np.cumsum(weight * toxic)
    f1 = 2 * found / (np.cumsum(weight) + found[-1])
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float(z[k] - 1 if k + 1 == len(z) else (z[k] + z[k + 1]) / 2)


def fit(sample: list[tuple[str, int, str | None]], clean_weight: float = 1.0) -> Model:
    """Of a list in memory: train on most of (text, toxic, language), calibrate on the rest. ``clean_weight``: clean rows each stands for."""
    sample = sorted(sample, key=lambda r: zlib.crc32(r[0].encode("utf-8", "replace")))
    cut = int(len(sample) * (1 - HELD_BACK))
    first, rest = sample[:cut], sample[cut:]
    model = train([t for t, _, _ in first], np.array([y for _, y, _ in first], float))
    model.languages, model.evidence = language_evidence([t for t, _, _ in first], [g for _, _, g in first])
    model.thresholds = np.zeros(len(model.languages) + 1)
    z, spoken = Scorer(model).raw_of([t for t, _, _ in rest])
    toxic = np.array([y for _, y, _ in rest], float)
    weight = np.where(toxic > 0, 1.0, clean_weight)

    def enough(mask: np.ndarray) -> bool:
        return len(mask) > 0 and min(toxic[mask].sum(), (1 - toxic[mask]).sum()) >= CALIBRATION_LEAST

    everyone = np.ones(len(z), bool)
    model.thresholds[:] = threshold(z, toxic, weight) if enough(everyone) else 0.0
    for k in range(len(model.languages)):
        if enough(spoken == k):
            model.thresholds[k] = threshold(z[spoken == k], toxic[spoken == k], weight[spoken == k])
    return model


def labelled(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """text, toxic (0 or 1), lang, o (a hash of the doc_id), h (of the text), held of every labelled text outside fold 0."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(S.doc_fold(F.col("doc_id"), folds) != 0)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = docs.filter("doc_id is not null and text is not null").filter(S.doc_fold(F.col("doc_id"), folds) != 0)
    rows = rows.select("doc_id", "text", "lang").join(known.hint("merge"), "doc_id")  # alike at every size
    rows = rows.withColumn("h", F.xxhash64("text")).groupBy("doc_id", "h")
    rows = rows.agg(F.any_value("text").alias("text"), F.max("toxic").alias("toxic"), F.min("lang").alias("lang"))
    held = F.pmod(F.xxhash64("h"), F.lit(100)) < int(100 * HELD_BACK)  # by text, so that copies are on one side
    return rows.select("text", "toxic", "lang", F.xxhash64("doc_id").alias("o"), "h", held.alias("held"))


def _sample(rows: DataFrame, toxic: int, clean: int, room: int) -> list:
    """Whole rows for a warm start: so many of either class, of least ``o``, within ``room`` bytes."""
    keys = rows.select("o", "h", "toxic", F.octet_length("text").alias("size"))
    sizes = [r for y, n in ((1, toxic), (0, clean)) for r in keys.filter(F.col("toxic") == y).orderBy("o", "h").limit(n).collect()]
    taken = []
    for r in sorted(sizes, key=lambda r: (r.o, r.h)):
        if r["size"] <= room:
            room -= r["size"]
            taken.append((r.o, r.h))
    wanted = rows.sparkSession.createDataFrame(taken, "o bigint, h bigint").distinct()
    found = rows.join(F.broadcast(wanted), ["o", "h"]).select("o", "h", "text", "toxic").collect()  # at most `room` of text
    return sorted(found, key=lambda r: (r.o, r.h))


def _evidence(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """``language_evidence`` of all rows; words of a text are told apart by 64 bits of checksums."""
    rows = rows.filter("lang is not null").select("lang", "text")
    names = sorted(r.lang for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LANGUAGE_LEAST).collect())  # a row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.begin("toxicity")
        seen: dict[str, np.ndarray] = {}

        def found() -> Iterator[pa.RecordBatch]:
            for lang, n in seen.items():
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], ["lang", "bucket", "n"])
            seen.clear()

        for batch in batches:
            for lang, words in zip(batch.column(0).to_pylist(), checksums_of(batch.column(1).to_pylist()), strict=True):
                if lang not in seen:
                    if len(seen) == 64:
                        yield from found()
                    seen[lang] = np.zeros(BUCKETS, np.int64)
                once = np.unique(words[:, 0].astype(np.uint64) << np.uint64(32) | words[:, 1]) >> np.uint64(32)
                np.add.at(seen[lang], (once & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        yield from found()

    out = np.full((BUCKETS, len(names)), 0.5)
    if names:
        known = rows.sparkSession.createDataFrame([(x,) for x in names], "lang string")
        total = rows.join(F.broadcast(known), "lang").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        number = {x: i for i, x in enumerate(names)}
        for batch in total.toArrow().to_batches():  # at most a number for each weight that is learnt from them
            at = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            out[batch.column(1).to_numpy(), at] += batch.column(2).to_numpy()
        out = np.log(out / out.sum(axis=0))
    return names, out.astype(np.float32)


def _train_everywhere(rows: DataFrame, trainer: Trainer, turn: int) -> None:
    """One pass over all rows (text, toxic): each partition trains a copy of the model, then the copies are averaged.

    A row of embeddings is averaged over the copies in which it learnt, by how often it did; other weights by the
    texts of a copy. What steps go by is averaged alike, so that steps don't shrink with the number of copies.
    """
    shared = rows.sparkSession.sparkContext.broadcast((trainer.model, trainer.grads))
    kind = "block int, part int, rows binary, data binary"
    names = ["block", "part", "rows", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.begin("toxicity")
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng((turn, part))
        own = Trainer(*copy.deepcopy(shared.value))
        for batch in batches:
            texts, labels = batch.column(0), batch.column(1).to_numpy().astype(float)
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                docs = [(rows, y) for rows, y in zip(buckets_of(texts.take(pa.array(some)).to_pylist()), labels[some], strict=True) if len(rows)]
                if docs:
                    own.learn([d for d, _ in docs], np.array([y for _, y in docs]))
        if not own.seen:
            return
        model, grads = shared.value
        change = own.dense() - Trainer(model, grads).dense()
        yield _packed(-1, part, np.zeros(1, np.int32), np.concatenate([[own.seen], change * own.seen])[None])
        for block in range(0, BUCKETS, BLOCK):
            used = block + np.flatnonzero(own.pulled[block : block + BLOCK])
            if len(used):
                n = own.pulled[used, None]
                yield _packed(block, part, used - block, np.hstack([n, n * (own.model.embeddings - model.embeddings)[used], n * (own.grads["embeddings"] - grads["embeddings"])[used]]))

    def _packed(block: int, part: int, used: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([used.astype(np.int32).tobytes()], pa.binary()), pa.array([data.astype(np.float32).tobytes()], pa.binary())], names)

    def unpacked(used: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(used, np.int32)
        return at, np.frombuffer(data, np.float32).reshape(len(at), -1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, used, data in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                at, data = unpacked(used, data)
                if block not in total:
                    total[block] = np.zeros((1 if block < 0 else BLOCK, data.shape[1]))
                total[block][at] += data
        for block, data in total.items():
            used = np.flatnonzero(data[:, 0])
            mean = data[used]
            mean[:, 1:] /= mean[:, :1]
            yield _packed(block, 0, used, mean)

    copies = rows.select("text", "toxic").mapInArrow(run, kind)
    width = BUCKETS // BLOCK + 1
    for r in copies.repartition(width, "block").sortWithinPartitions("block", "part").mapInArrow(add, kind).collect():  # a row a block
        used, mean = unpacked(r.rows, r.data)
        if r.block < 0:
            trainer.set_dense(trainer.dense() + mean[0, 1:])
        else:
            trainer.model.embeddings[r.block + used] += mean[:, 1 : WIDTH + 1]
            trainer.grads["embeddings"][r.block + used] += mean[:, WIDTH + 1 :]
    shared.unpersist()


def cuts(scored: DataFrame) -> dict[int, tuple[float, int, int]]:
    """``threshold`` of all rows (language, z, toxic) of a language, with its toxic and its clean rows; -1: of all rows.

    Exact: running sums go over slices of z first and then, within each slice, over its distinct values.
    """
    rows = scored.select(F.explode(F.array_distinct(F.array("language", F.lit(-1)))).alias("language"), "z", "toxic")
    points = rows.groupBy("language", "z").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    slice_ = F.greatest(F.lit(-MOST_SLICES), F.least(F.lit(MOST_SLICES), F.floor(F.col("z") * SLICES))).cast("int")
    points = S.cut(points.withColumn("slice", slice_), "cuts")
    down, whole = Window.partitionBy("language").orderBy(F.desc("slice")), Window.partitionBy("language")
    slices = points.groupBy("language", "slice").agg(F.sum("toxic").alias("t"), F.sum("n").alias("m"), F.max("z").alias("top"))
    slices = slices.select("language", "slice", (F.sum("t").over(down) - F.col("t")).alias("t"), (F.sum("m").over(down) - F.col("m")).alias("m"), F.lead("top").over(down).alias("below"), F.sum("t").over(whole).alias("all_toxic"), F.sum("m").over(whole).alias("all"))
    inside = Window.partitionBy("language", "slice").orderBy(F.desc("z"))
    found, taken = F.col("t") + F.sum("toxic").over(inside), F.col("m") + F.sum("n").over(inside)
    at = F.coalesce((F.col("z") + F.coalesce(F.lead("z").over(inside), "below")) / 2, F.col("z") - 1)
    tried = points.join(slices, ["language", "slice"]).select("language", "z", at.alias("at"), (2 * found / (taken + F.col("all_toxic"))).alias("f1"), "all_toxic", "all")
    best = tried.groupBy("language").agg(F.max_by("at", F.struct("f1", "z")).alias("at"), F.max("all_toxic").alias("toxic"), F.max("all").alias("n")).collect()  # a row a language
    S.discard(points)
    return {r.language: (r["at"], r.toxic, r.n - r.toxic) for r in best}


def _calibrate(rows: DataFrame, model: Model) -> None:
    """Thresholds of the languages from all rows (text, toxic); one with too few examples takes that of all rows."""
    model.thresholds = np.zeros(len(model.languages) + 1)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.begin("toxicity")
        scorer = Scorer(shared.value)
        for batch in batches:
            z, spoken = scorer.raw_of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(spoken, pa.int32()), pa.array(z, pa.float64()), batch.column(1)], ["language", "z", "toxic"])

    found = cuts(rows.select("text", "toxic").mapInArrow(run, "language int, z double, toxic int"))
    enough = {k: at for k, (at, toxic, clean) in found.items() if min(toxic, clean) >= CALIBRATION_LEAST}
    model.thresholds[:] = enough.get(-1, 0.0)
    for k, at in enough.items():
        model.thresholds[k] = at
    shared.unpersist()


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_toxic: int = 0, sample_clean: int = 0, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from all labelled documents outside fold 0 of ``folds``.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, toxic. A doc_id with both labels counts as toxic; null
    doc_ids, labels and texts teach nothing, and a repeated row counts once. Texts are read whole. The weights
    depend a little on how the labelled rows are dealt over partitions.

    ``sample_toxic``, ``sample_clean``: rows of a warm start, from whose weights the passes over all rows set out.
    Without one they set out from random weights.
    """
    S.bounded_batches(docs.sparkSession)
    rows = S.cut(labelled(docs, labels, folds), "labelled")
    training = rows.filter("not held")
    n = training.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    trainer = untrained(np.random.default_rng(7), n.toxic / n.n if n.n else 0.5)
    if sample_toxic or sample_clean:
        sample = _sample(training, sample_toxic, sample_clean, sample_bytes)
        trainer = start([r.text for r in sample], np.array([r.toxic for r in sample], float))
    copies = training.coalesce(max(1, n.n // COPY_LEAST))
    for turn in range(EPOCHS):
        _train_everywhere(copies, trainer, turn)
    model = trainer.model
    model.languages, model.evidence = _evidence(training)
    _calibrate(rows.filter("held"), model)
    S.discard(rows)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more).

    A null or empty text, or one without letters, gets the score of a text in which no filter responds. Only
    the text is read. Repeated rows give equal scores; columns named score or predicted are replaced.
    """
    spark = docs.sparkSession
    S.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.begin("toxicity")
        scorer = Scorer(shared.value)
        for batch in batches:
            found = scorer.score_of(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array(found >= 0.5).cast(pa.int32())], [*batch.schema.names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType([*docs.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return docs.mapInArrow(run, schema)
