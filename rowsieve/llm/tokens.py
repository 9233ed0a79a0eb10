"""Token ids of whole texts, encoded once per distinct piece."""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from functools import lru_cache

KEPT_PIECES = 500_000
LONGEST_KEPT = 64

#: A space beside other white space belongs to a run, which the tokenizer cuts by itself.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace()]


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary, as installed on every machine.

    It is ``byte_bpe_50k`` written as ranks, which encodes to the same ids four times as
    fast; tests hold whole texts against the file of the tokenizers library.
    """
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _pieces(text: str) -> list[str]:
    """``text`` cut at its single spaces."""
    for c in _WHITE:
        if c in text and (c + " " in text or " " + c in text):
            return _CUT.split(text)
    return text.split(" ")


class Encoder:
    """Ids as little-endian 32-bit bytes.

    The tokenizer always begins a new unit at a single space between two other characters,
    so a text is cut there and equal pieces are encoded once. Pieces are kept up to a
    number, then dropped all at once. A special token written out in a text becomes its id,
    as the tokenizer's own file (beside ``path``) has it, and the texts around it are
    encoded each by itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        known = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ids = known.encode_ordinary
        self._special = special_tokens(f"{os.path.splitext(path)[0]}.json")
        # The longest of those that begin at a place is meant.
        names = sorted(map(re.escape, self._special), key=len, reverse=True)
        self._split = re.compile(f"({'|'.join(names)})" if names else "(?!)")
        self._first: dict[str, bytes] = {}
        self._later: dict[str, bytes] = {}

    def _learn(self, held: dict[str, bytes], wanted: set[str], before: str) -> list[str]:
        """Encode what is new; the long pieces among it, which are not kept."""
        new = wanted.difference(held)
        if len(held) + len(new) > KEPT_PIECES:
            held.clear()
            new = wanted
        for piece in new:
            held[piece] = array("I", self._ids(before + piece)).tobytes()
        return [x for x in new if len(x) > LONGEST_KEPT]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null and empty texts have none."""
        if not any(name in t for t in texts if t for name in self._special):
            return self._encode(texts)
        parts = [self._split.split(t or "") for t in texts]  # every second part is a special token
        plain = iter(self._encode([x for p in parts for x in p[::2]]))
        return [b"".join(next(plain) if k % 2 == 0 else self._special[x] for k, x in enumerate(p)) for p in parts]

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [_pieces(t or "") for t in texts]
        first = [pieces.pop(0) for pieces in cut]
        long = [(self._first, self._learn(self._first, set(first), ""))]
        long.append((self._later, self._learn(self._later, set().union(*cut), " ")))
        get = self._later.__getitem__
        made = [self._first[x] + b"".join(map(get, pieces)) for x, pieces in zip(first, cut, strict=True)]
        for held, pieces in long:
            for piece in pieces:
                del held[piece]
        return made


def special_tokens(path: str) -> dict[str, bytes]:
    """Text and id of the tokens that the tokenizer's file at ``path`` adds to its vocabulary; none without a file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        return {t["content"]: array("I", [t["id"]]).tobytes() for t in json.load(file)["added_tokens"]}


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, so that its pieces serve later tasks too."""
    return Encoder(path)
