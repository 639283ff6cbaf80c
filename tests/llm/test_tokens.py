"""Token counts, token files and packing against the tokenizer libraries themselves."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hostweave.llm import _support as S
from hostweave.llm import packing, tokenfile, tokens
from hostweave.llm.pretokens import ByteBpe, ChunkCache, piece_chunks, piece_count

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    None, "", " ", "  ", "a  b", " a", "a ", "a \nb", "a\n  b", "\n\n x  ", "one <|endoftext|> two", "a\t b", "\x1c a", "a　b", "it's  don't 's", "<|x", "①② 12 34",
    "a\r\n b", "x\x85 y", "▁▁ a ▁", "</s> <s>", "ﬁ é é", "​", "😀 😀😀", "A" * 5000, "word " * 3000, "Ünïcode Straße naïve", "中文 字 text", "\x00a\x00",
]


@pytest.fixture(scope="module")
def reference():
    tokenizer, pieces = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    return (lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")), (lambda t: len(pieces.encode(t or "")))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 7, 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", 7, 0)]  # a repeated row, clashing extra columns
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n int, ids int")


def test_chunk_caches_are_exact(reference):
    ids, count = reference
    rng = np.random.default_rng(5)
    parts = ["a", "b", " ", " ", "\n", "é", ".", "1", "\t", " ", "▁", "'s", "\x0b", "😀", "\x1d", "Ж", "中", "<|endoftext|>"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(3000)]
    coder, cache = ByteBpe(BYTE, entries=50), ChunkCache(piece_count(PIECE), entries=50)
    for t in texts:
        cache.age()
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == ids(t)[:-1].tolist(), repr(t)
        assert (sum(map(cache.__getitem__, piece_chunks(t))) if t else 0) == count(t), repr(t)


def test_words_with_marks_and_lines_are_exact(reference):
    rng = np.random.default_rng(9)
    parts = ["word", "Éa", "Жж", "中", "it", "s", "12", ".", ",", "...", "_", "'", "'s", '"', "\\", "\n", "\n", "\n\n", "\r", "\t", "½", "“", "^", "`~"]
    coder = ByteBpe(BYTE, entries=50)
    for _ in range(3000):
        t = " ".join("".join(rng.choice(parts, rng.integers(1, 6))) for _ in range(4))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == reference[0](t)[:-1].tolist(), repr(t)


def test_common_words_need_no_pattern(reference, monkeypatch):
    import regex

    class Refused:
        def findall(self, text):
            raise AssertionError(text)

    text = "First word, word. Éa... and\nanother line.\nNext word), word; word!!"
    monkeypatch.setattr(regex, "compile", lambda pattern: Refused())
    coder = ByteBpe(BYTE)
    monkeypatch.undo()
    with pytest.raises(AssertionError):
        coder.encode("a b2")
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == reference[0](text)[:-1].tolist()


def test_counts(docs, reference):
    got = sorted(tokens.count_tokens(docs, PIECE, limit=100).collect(), key=lambda r: r.doc_id)
    want = sorted((i, len((t or "").encode()), reference[1](t)) for i, t in [*enumerate(TEXTS), (3, TEXTS[3])])
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert tokens.count_tokens(docs.limit(0), PIECE).count() == 0


@pytest.mark.parametrize("numbers", [[], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1], list(range(1000))])
def test_variable_length_coding_round_trip(numbers):
    a = np.array(numbers, "<u4")
    assert (tokenfile.decode_ranks(*tokenfile.encode_ranks(a), len(a)) == a).all()


def test_token_files(docs, reference, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 2000)  # several blocks, one document larger than a block
    path = f"file://{tmp_path}/files"
    tokenfile.write_token_files(docs, path, BYTE)
    got = sorted(tokenfile.read_token_files(spark, path).collect(), key=lambda r: r.start)
    rows = sorted([*enumerate(TEXTS), (3, TEXTS[3])], key=lambda r: r[0])
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    at = 0
    for r, (_, text) in zip(got, rows, strict=True):
        ids = reference[0](text)
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)


def test_token_files_without_ids(docs, spark, tmp_path):
    path = f"file://{tmp_path}/files"
    tokenfile.write_token_files(docs, path, BYTE)
    bare, whole = tokenfile.read_token_files(spark, path, ids=False), tokenfile.read_token_files(spark, path)
    assert bare.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, whole.drop("ids").collect()))


def test_empty_token_file(docs, spark, tmp_path):
    path = f"file://{tmp_path}/files"
    tokenfile.write_token_files(docs.limit(0), path, BYTE)
    assert tokenfile.read_token_files(spark, path).count() == 0


def check_packing(rows, reference, texts, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        ids = reference[0](texts[doc])
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert len(pieces) == -(-len(ids) // capacity) and all(p.length == capacity for p in pieces[1:])
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return by_sequence


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, reference, capacity):
    unique = docs.dropDuplicates(["doc_id"])
    rows = packing.pack(unique, BYTE, capacity, rounds=60).collect()
    sequences = check_packing(rows, reference, dict(enumerate(TEXTS)), capacity)
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // capacity) + 1
    assert packing.pack(docs, BYTE, capacity, rounds=20).count() == len(rows) + 1  # the repeated row is one more piece
    assert packing.pack(docs.limit(0), BYTE, capacity).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_solver_holds_exactly_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 513, 80), rng.integers(1, 400, 80), strict=True)} | {512: 7}
    patterns = packing.solve(histogram, 512, rounds=150)
    held = {}
    for pattern, n in patterns:
        assert sum(k * v for k, v in pattern.items()) <= 512 and n > 0
        for k, v in pattern.items():
            held[k] = held.get(k, 0) + n * v
    assert held == histogram
    used = sum(n for _, n in patterns)
    assert used <= 1.025 * max(sum(k * n for k, n in histogram.items()) / 512, sum(n for k, n in histogram.items() if k > 256)) + 3 or used <= sum(n for _, n in packing.best_fit(histogram, 512)) + 2


def test_best_fit_gets_a_remainder_that_does_not_grow(monkeypatch):
    rng = np.random.default_rng(7)
    base = {int(k): int(n) for k, n in zip(range(1, 601), rng.integers(1, 400, 600), strict=True)}
    best_fit, rest = packing.best_fit, []
    monkeypatch.setattr(packing, "best_fit", lambda h, capacity: rest.append(sum(k * n for k, n in h.items())) or best_fit(h, capacity))
    for times in (1, 1000):
        patterns = packing.solve({k: n * times for k, n in base.items()}, 640)
        assert sum(k * v * n for pattern, n in patterns for k, v in pattern.items()) == times * sum(k * n for k, n in base.items())
    assert max(rest) < 640 * len(base)


def test_knapsack_price_is_optimal():
    lengths, weights = np.array([5, 4, 3]), np.array([5.1, 4.0, 2.9])
    best = packing.price(weights, lengths, np.array([9, 9, 9]), 11)
    assert float(best @ weights) == pytest.approx(max(a * 5.1 + b * 4.0 + c * 2.9 for a in range(3) for b in range(3) for c in range(4) if 5 * a + 4 * b + 3 * c <= 11))


def test_null_doc_id_is_refused_in_files(docs, spark, tmp_path):
    with pytest.raises(Exception, match="doc_id is null"):
        tokenfile.write_token_files(docs.withColumn("doc_id", F.lit(None).cast("bigint")), f"file://{tmp_path}/x", BYTE)


def triples(n, capacity=2048, seed=0):
    """A histogram of n triples of pieces that each fill a sequence to the last token."""
    rng = np.random.default_rng(seed)
    pool, found = rng.choice(np.arange(300, 1100), 320, replace=False), []
    while len(found) < 320:
        a, b = rng.choice(pool, 2)
        if 200 < capacity - a - b < 1200:
            found.append((int(a), int(b), int(capacity - a - b)))
    histogram = {}
    for three, times in zip(found, rng.multinomial(n, np.ones(320) / 320).tolist(), strict=True):
        for k in three:
            histogram[k] = histogram.get(k, 0) + times
    return {k: v for k, v in histogram.items() if v}


@pytest.mark.parametrize("n", [50_000, 500_000])
def test_waste_stays_below_the_number_of_lengths(n):
    histogram = triples(n)
    patterns, bound = packing.cover(histogram)
    assert bound == n <= sum(times for _, times in patterns) <= n + len(histogram)


def fewest(pieces, capacity):
    """The optimum for a handful of pieces, by trying every place for each."""
    best = [len(pieces)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= pieces[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - pieces[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(6))
def test_small_packings_are_near_the_optimum(seed):
    rng = np.random.default_rng(seed)
    pieces = sorted(map(int, rng.integers(3, 30, 11)), reverse=True)
    histogram = {k: pieces.count(k) for k in pieces}
    patterns, bound = packing.cover(histogram, 40)
    used, want = sum(n for _, n in patterns), fewest(pieces, 40)
    assert bound <= want <= used <= want + 1 and used <= sum(n for _, n in packing.best_fit(histogram, 40))
    assert packing.cover({}, 40) == ([], 0)


def test_log_normal_lengths_reach_the_bound():
    lengths, counts = np.unique(np.clip(np.random.default_rng(1).lognormal(5.6, 0.8, 5000).astype(int), 1, 2048), return_counts=True)
    patterns, bound = packing.cover(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    assert sum(n for _, n in patterns) == bound


def test_a_worker_keeps_the_caches_of_one_user(monkeypatch):
    from hostweave.llm import pretokens

    monkeypatch.setattr(S, "_user", None)
    S.begin("byte_bpe")
    coder = pretokens.byte_bpe(BYTE)
    S.begin("byte_bpe")
    assert pretokens.byte_bpe(BYTE) is coder
    S.begin("toxicity")
    assert pretokens.byte_bpe.cache_info().currsize == pretokens._byte_bpe.cache_info().currsize == 0
    assert pretokens.byte_bpe(BYTE).encode("some words") == coder.encode("some words")
