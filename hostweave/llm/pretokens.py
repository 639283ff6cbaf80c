"""Exact chunk caches in front of two public tokenizers.

Both tokenizers build their pieces inside stretches of text that a single space ends, so a text can be cut
before each space that follows a non-space and the pieces of the stretches put together again. A stretch's
pieces are then looked up instead of computed. Texts with runs of spaces or other white space before a space
go through a slower cut; texts with a special token or rare control characters go to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

from . import _support as S

#: Entries of a worker's cache; beyond it the older half is forgotten. It bounds memory, not what is counted.
CACHE_ENTRIES = 900_000
#: Chunks longer than this are encoded without being kept.
CACHED_CHARS = 40


class ChunkCache(dict):
    """chunk -> value, filled from ``fixed`` or else by ``make`` on a miss; two generations bound its size."""

    def __init__(self, make, entries: int = CACHE_ENTRIES, fixed: dict | None = None):
        super().__init__()
        self.make, self.half, self.old, self.fixed = make, max(1, entries // 2), {}, fixed or {}

    def __missing__(self, chunk):
        value = self.fixed.get(chunk) if self.fixed else None
        if value is None:
            value = self.old.get(chunk)
        if value is None:
            value = self.make(chunk)
        if len(chunk) <= CACHED_CHARS:
            self[chunk] = value
        return value

    def age(self) -> None:
        """Call between texts: drops the older generation once the newer is full."""
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()


# ---- byte-level BPE -------------------------------------------------------------------------------------

#: White space before a space, where a plain cut at single spaces would part a run of white space.
_RUNS = tuple(c + " " for c in " \t\n\r\v\f\xa0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Characters that Python and the tokenizer's pattern may class differently; special tokens begin with "<|".
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u1680", "\u180e", "\u200b", "\ufeff")
#: Those of either that a text of ASCII alone can have.
_RUNS_ASCII, _ODD_ASCII = (tuple(x for x in xs if x.isascii()) for xs in (_RUNS, _ODD))
_CHUNK = re.compile(r"\s*\S+|\s+")
#: Marks of which a run is one pre-token after a word; the apostrophe may begin another one.
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


@lru_cache(maxsize=2)
def _byte_bpe(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The public byte-level pre-token pattern, as the tokenizer's documentation states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    A pre-token that the caches lack goes to the library's BPE model; a chunk with characters beyond the
    scripts whose classes never changed between Unicode versions goes to the library's whole encoder.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        import sys
        from array import array

        import regex

        tokenizer = _byte_bpe(path)
        self.size = tokenizer.get_vocab_size(with_added_tokens=True)
        alphabet, tokenize, pre_tokens = _byte_alphabet(), tokenizer.model.tokenize, regex.compile(PATTERN).findall

        space = alphabet[32]

        def packed(ids: list[int]) -> bytes:
            out = array("I", ids)
            if sys.byteorder == "big":
                out.byteswap()
            return out.tobytes()

        def ids(chunk: str) -> bytes:
            return packed(tokenizer.encode(chunk, add_special_tokens=False).ids)

        def model(pre_token: str) -> bytes:
            return packed([t.id for t in tokenize(pre_token.encode().decode("latin-1").translate(alphabet))])

        def word(w: str) -> bytes:
            if w.isascii():
                if w.isalpha():
                    return packed([t.id for t in tokenize(space + w)])
            elif max(w) >= "\u0530":
                return ids(" " + w)
            elif w.isalpha():
                return model(" " + w)
            before = w.rstrip(_MARKS)
            if before.isalpha():
                return self.words[before] + self.pre[w[len(before) :]]
            before, line, after = w.partition("\n")
            if after.isalpha() and before and not before[-1].isspace():
                return self.words[before] + self.pre[line] + self.pre[after]
            return chunk(" " + w)

        def chunk(c: str) -> bytes:
            if max(c) >= "\u0530":
                return ids(c)
            return b"".join([self.words[p[1:]] if p[0] == " " and p[1:].isalpha() else self.pre[p] for p in pre_tokens(c)])

        self.whole = ids
        self.words = ChunkCache(word, entries)  # keyed without the space before
        self.pre = ChunkCache(model, entries // 8)
        self.chunks = ChunkCache(chunk, entries // 8)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        runs, odd = (_RUNS_ASCII, _ODD_ASCII) if text.isascii() else (_RUNS, _ODD)
        if any(x[0] in text and x in text for x in odd):  # a single character is found much faster
            return self.whole(text)
        for cache in (self.words, self.pre, self.chunks):
            cache.age()
        if any(x[0] in text and x in text for x in runs) or text[-1] == " ":
            return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))
        first, *rest = text.split(" ")
        if first:
            first = self.pre[first] if first.isalpha() and max(first) < "\u0530" else self.whole(first)
        return (first or b"") + b"".join(map(self.words.__getitem__, rest))


@lru_cache(maxsize=2)
def byte_bpe(path: str, entries: int = CACHE_ENTRIES) -> ByteBpe:
    """One coder for a worker process, so that its caches outlive a task."""
    return ByteBpe(path, entries)


# ---- sentencepiece --------------------------------------------------------------------------------------

_SPACE = "▁"
_PIECES = re.compile(f"{_SPACE}+[^{_SPACE}]*")


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_count(path: str):
    """A function: the pieces of a chunk, which is given without the space mark that it starts with."""
    model = _pieces(path)

    def count(chunk: str) -> int:
        return len(model.encode(chunk)) if chunk else 1  # encode() puts the mark back; a lone mark is a piece

    return count


@lru_cache(maxsize=2)
def piece_counts(path: str, entries: int = CACHE_ENTRIES) -> ChunkCache:
    """One cache of piece counts for a worker process."""
    return ChunkCache(piece_count(path), entries)


def piece_chunks(text: str) -> list[str]:
    """The stretches of a text that a run of space marks begins, each without its first mark."""
    if "  " in text or text[0] == " " or _SPACE in text:
        return [c[1:] for c in _PIECES.findall(_SPACE + text.replace(" ", _SPACE))]
    return text.split(" ")


def _free() -> None:
    for held in (byte_bpe, _byte_bpe, piece_counts, _pieces):
        held.cache_clear()


S.kept.append(_free)
