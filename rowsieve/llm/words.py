"""Words and word shingles of whole texts, as vectors of 64-bit hashes.

A word is a run of characters other than the space and U+0009 to U+000D. UTF-8 keeps
these bytes out of longer characters, so bytes are cut, never characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import xxhash

SEED = 42
BLOCK = 1 << 20
_SPACE = b" \t\n\r\x0b\x0c"


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """``data`` in pieces that end between words, so that long texts stay cheap."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end]
        at = end


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``width`` lower-cased words, repeats included.

    Only A-Z is lower-cased. Fewer words make one shingle, no words make none.
    """
    data = (text or "").encode().lower()
    held: list[bytes] = []
    made = False
    for block in blocks(data, BLOCK):
        held += block.split()
        if len(held) >= width:
            rows = zip(*(held[k:] for k in range(width)), strict=False)
            found = map(xxhash.xxh64_intdigest, map(b" ".join, rows), repeat(SEED))
            yield np.fromiter(found, np.uint64, len(held) - width + 1)
            made = True
            held = held[len(held) - width + 1 :]
    if held and not made:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)
