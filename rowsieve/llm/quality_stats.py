"""Statistics of one text, counted over the whole of it."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _count(data: bytes, kinds: bytes) -> int:
    return len(data) - len(data.translate(None, kinds))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    seen = one[: n - width + 1]
    for k in range(1, width):
        # A pair of numbers below n fits 63 bits for every text below 3 billion words.
        pair = seen * len(ids) + one[k : n - width + 1 + k]
        _, seen, counts = np.unique(pair, return_inverse=True, return_counts=True)
    twice = (counts > 1)[seen]
    edges = np.zeros(n + 1, np.int64)
    edges[: len(twice)] += twice
    edges[width : width + len(twice)] -= twice
    return int(np.count_nonzero(np.cumsum(edges[:n])))


def statistics(text: str | None) -> tuple[int, int, int, int, int, tuple[float, ...]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and model features."""
    text = text or ""
    data = text.encode()
    words = data.split()
    spaces, symbols = _count(data, _SPACES), _count(data, SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    chars, n = len(text) - spaces, len(words)
    per_word, per_char = 1.0 / max(n, 1), 1.0 / max(chars, 1)
    features = (
        float(np.log1p(n)),
        chars * per_word,
        symbols * per_char,
        dup_lines / max(len(lines), 1),
        repeat * per_word,
        len(set(words)) * per_word,
        _count(data, _UPPER) * per_char,
        _count(data, b"!?") * per_char,
        _count(data, b".,;:") * per_char,
        n / max(len(lines), 1),
        _count(data, b"0123456789") * per_char,
    )
    return n, chars, symbols, dup_lines, repeat, features


#: Order of ``features``; 1: quality cannot fall as it grows, -1: cannot rise, 0: free.
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "distinct_word_share": 1,
    "upper_share": -1,
    "exclamation_share": -1,
    "punctuation_share": 0,
    "words_per_line": 0,
    "digit_share": 0,
}
