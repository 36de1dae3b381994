"""Cutting one text into overlapping chunks (the per-document helper of R1).

A chunk ends, if it must end before the text does, at the last paragraph break
that keeps it within ``size``; else at the last line break; else at the last
blank; else after ``size`` characters.  The next chunk starts at most
``overlap`` characters earlier, at a place of the same kind where there is
one.  All places are found once per text; each cut is two bisections.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

# Fixed splitting parameters of the document loader, strongest separator first.
SEPARATORS = ("\n\n", "\n", " ")
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200

BLANKS = " \t\n\v\f\r"


def chunk_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) offsets of the chunks, without blanks at their ends.

    Every character that is no blank lies in a chunk; neighbours share at most
    ``overlap`` characters and no chunk is longer than ``size``.
    """
    places = [[m.start() for m in re.finditer(re.escape(s), text)] for s in separators]
    found: list[tuple[int, int]] = []
    n, start = len(text), 0
    while start < n:
        end, kind = min(n, start + size), None
        if end < n:
            for at in places:
                # A cut inside the overlap would not get the text any further.
                i = bisect_right(at, end) - 1
                if i >= 0 and at[i] > start + overlap:
                    end, kind = at[i], at
                    break
        a, b = start, end
        while a < b and text[a] in BLANKS:
            a += 1
        while b > a and text[b - 1] in BLANKS:
            b -= 1
        if a < b:
            found.append((a, b))
        if end == n:
            break
        start = max(end - overlap, 0)
        if kind is not None:
            start = kind[bisect_left(kind, start)]
    return found


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    return [text[a:b] for a, b in chunk_spans(text, size, overlap, separators)]
