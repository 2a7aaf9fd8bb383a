"""Pre-tokenisation of the ``word_bpe`` vocabulary and two readings of its merges.

The vocabulary lower-cases, drops white space, splits words, single digits and
runs of other marks, and marks word ends. No piece crosses white space, so what
one white-space-free chunk becomes does not depend on its neighbours; both
classes below remember chunks and pieces they have met. The memory is bounded;
what it forgets costs time but never changes a result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array

import regex

#: Fixed values of the vocabulary's file: its split pattern and the characters that its byte
#: alphabet leaves as they are (the other bytes follow from 256 on, in order).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
KEPT_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: str.split() also splits at these four; the vocabulary does not.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Marks that often end a word; the apostrophe is not one, as the pattern knows endings with it.
END_MARKS = ".,;:!?"
CHUNKS = regex.compile(r"\P{White_Space}+")


def _byte_alphabet() -> dict[int, int]:
    kept = set(KEPT_BYTES)
    spare = iter(range(256, 512))
    return {b: b if b in kept else next(spare) for b in range(256)}


def chunks(text: str) -> list[str]:
    if any(c in text for c in NOT_SPACE):
        return CHUNKS.findall(text)
    return text.split()


class _Remembering(dict):
    """What ``make`` gave for up to ``limit`` keys of late, and for as many before them: of two generations the younger is
    this dictionary; when it is full it becomes the elder, whose entries come back one by one as they are met. So frequent
    keys stay, however many rare ones pass."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.elder = make, limit, {}

    def __missing__(self, key):
        made = self.elder.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.elder = dict(self)
                self.clear()
            self[key] = made
        return made


class _Reader:
    """Splits chunks into pieces; subclasses say what a piece and a special token give."""

    #: Entries in a generation of each memory: about 190 MB in a worker, as words are in one of them only.
    LIMIT = 480_000

    def __init__(self, spec: bytes):
        self.spec = json.loads(spec)
        if self.spec["normalizer"] is None or self.spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("not a vocabulary with word ends")
        self.specials = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.specials)))
        self.to_symbols = _byte_alphabet()
        self.pieces = _Remembering(self.piece, self.LIMIT)
        self.chunks = _Remembering(self.chunk, self.LIMIT)

    def symbols(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.to_symbols)

    def chunk(self, chunk: str):
        met = chunk
        if "<" in chunk and (parts := self.special_pattern.split(chunk))[1:]:
            found = [*self.special_pattern.findall(chunk), None]
            out = [self.zero]
            for part, special in zip(parts, found, strict=True):
                if part:
                    out.append(self.chunk(part))
                if special is not None:
                    out.append(self.special(special))
            return self.total(out)
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        lowered = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        core = lowered.rstrip(END_MARKS)
        if core.isalpha():  # a word, or a word and a run of marks: what the pattern finds, without its cost
            word = self.piece(core) if core == met else self.word(core)
            return word + self.pieces[lowered[len(core) :]] if len(core) < len(lowered) else word
        return self.total(map(self.pieces.__getitem__, PIECES.findall(lowered)))

    def word(self, word: str):
        """A lower-case word. It is remembered once, as the chunk that it is by itself; only where that chunk would be composed
        first it is another word, which is a piece."""
        return self.chunks[word] if word.isascii() or unicodedata.is_normalized("NFC", word) else self.pieces[word]

    def read(self, text: str | None):
        return self.total(map(self.chunks.__getitem__, chunks(text))) if text else self.zero


class MergeCounter(_Reader):
    """Counts tokens: initial symbols minus merges, without naming any token."""

    zero, total = 0, staticmethod(sum)

    def __init__(self, spec: bytes):
        super().__init__(spec)
        merges = (m if isinstance(m, list) else m.split(" ") for m in self.spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.spec = None

    def special(self, token: str) -> int:
        return 1

    def piece(self, piece: str) -> int:
        symbol = list(self.symbols(piece))
        symbol[-1] += "</w>"
        n = len(symbol)
        if n == 1:
            return 1
        rank = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((symbol[i], symbol[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            if symbol[i] is None or (j := after[i]) >= n or rank((symbol[i], symbol[j])) != r:
                continue  # a merge beside it has changed this pair
            symbol[i] += symbol[j]
            symbol[j] = None
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left


class IdReader(_Reader):
    """The ids themselves, by the ``tokenizers`` library's merges, as little-endian unsigned 32-bit bytes."""

    zero, total = b"", staticmethod(b"".join)

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        super().__init__(spec)
        self.merged = Tokenizer.from_str(spec.decode()).model.tokenize
        self.spec = None

    def special(self, token: str) -> bytes:
        return self.specials[token].to_bytes(4, "little")

    def piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.merged(self.symbols(piece))]).tobytes()


_READERS: dict[tuple, _Reader] = {}


def reader(kind: type, key: str, spec: bytes) -> _Reader:
    """One reader for each vocabulary and worker process."""
    if (kind, key) not in _READERS:
        _READERS.clear()
        _READERS[kind, key] = kind(spec)
    return _READERS[kind, key]
