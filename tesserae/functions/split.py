"""Recursive text splitting into overlapping chunks of a bounded number of tokens, as a UDF.

A text is cut at the coarsest separator that it has, each separator staying at the
head of what follows it. A part that is as long as a chunk is cut again, at finer
separators; runs of shorter ones are put together as far as the sum of their own
lengths allows, and a chunk begins with the last parts of the one before it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators, from the coarsest to single characters.
SEPARATORS = ("\n\n", "\n", ".", ",", " ", "\u200b", "\uff0c", "\u3001", "\uff0e", "\u3002", "")
SIZE, OVERLAP_SHARE = 500, 0.15


def tokens(text: str) -> int:
    """Tokens by the rule of thumb: words by 1.3, rounded down."""
    return int(len(text.split()) * 1.3)


def _parts(text: str, separators: tuple[str, ...]) -> tuple[list[str], tuple[str, ...]]:
    """The text cut before each occurrence of the first separator in it, and the finer separators left."""
    for i, s in enumerate(separators):
        if not s:
            return list(text), ()
        if s in text:
            head, *tail = text.split(s)
            return [x for x in [head, *(s + t for t in tail)] if x], separators[i + 1 :]
    return [text], ()


def _together(run: list[tuple[str, int]], size: int, overlap: int) -> Iterator[str]:
    """Chunks of neighbouring (part, length), as many as ``size`` holds; the next begins with up to ``overlap`` of the last parts."""
    held: deque[tuple[str, int]] = deque()
    total = 0
    for part, n in run:
        if held and total + n > size:
            yield "".join(p for p, _ in held)
            while total > overlap or (total and total + n > size):
                total -= held.popleft()[1]
        held.append((part, n))
        total += n
    yield "".join(p for p, _ in held)


def split(
    text: str | None, size: int = SIZE, overlap: int | None = None, length: Callable[[str], int] = tokens, separators: tuple[str, ...] = SEPARATORS
) -> list[str]:
    """Chunks in order, without white space at their ends; blank ones are left out, and a null text has none. ``length`` measures parts:
    a chunk's parts sum up to ``size`` at most, neighbours share parts of up to ``overlap`` (0.15 of the size, if not given)."""
    overlap = int(size * OVERLAP_SHARE) if overlap is None else overlap
    parts, finer = _parts(text or "", separators)
    out: list[str] = []
    run: list[tuple[str, int]] = []

    def close() -> None:
        out.extend(chunk for c in _together(run, size, overlap) if (chunk := c.strip()))
        run.clear()

    for part in parts:
        if (n := length(part)) < size:
            run.append((part, n))
            continue
        close()
        out += split(part, size, overlap, length, finer) if finer else [part]
    close()
    return out


def splitter(length: Callable[[str], int] = tokens, size: int = SIZE):
    """A function of a text column that gives its chunks, measured by ``length``. Rows go to Python by the hundred: an Arrow batch of
    ten thousand texts and their chunks would be held at once."""
    return F.udf(lambda text: split(text, size, length=length), T.ArrayType(T.StringType()), useArrow=False)


split_text = splitter()
