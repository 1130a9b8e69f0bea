"""Counts and shares of a text that quality rules and quality scores build on.

Words are `[^\\x20\\x09-\\x0D]+`: bytes.split() without an argument cuts UTF-8 at exactly those six characters, and
bytes.translate() counts ASCII classes, so a text is never decoded.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa

SYMBOLS = b"#*$%&|<>"
_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower()
_STOPS = b".,;:!?"
_MARKS = frozenset(SYMBOLS + b"!")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Inputs of the forest and of the classifier; nothing here knows the language, the source or the id.
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "type_share", "upper_share", "stop_share", "shout_share", "bar_share", "adjacent_share", "top_share", "digit_share", "marked_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more; the first occurrence counts."""
    if len(words) < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    first: dict = {}
    covered = None
    for i, g in enumerate(grams):
        j = first.setdefault(g, i)
        if j != i:
            if covered is None:
                covered = np.zeros(len(words), dtype=bool)
            covered[i : i + 3] = True
            covered[j : j + 3] = True
    return 0 if covered is None else int(covered.sum())


def counts_of(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(COUNTS, FEATURES) of one text in UTF-8."""
    words = text.split()
    n = len(words)
    size = lambda drop: len(text) - len(text.translate(None, drop))
    word_chars = len(text) - size(_WHITE) - size(_CONTINUATION)
    symbols = size(SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else ([text] if n else [])
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    if not n:
        return (0, 0, symbols, 0, 0), (0.0,) * len(FEATURES)
    seen = Counter(words)
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    letters = size(_LETTERS)
    marked = sum(c for w, c in seen.items() if w[-1] in _MARKS) if symbols or b"!" in text else 0
    features = (
        math.log1p(n), min(40.0, word_chars / n), symbols / word_chars, dup_lines / max(1, len(lines)), repeats / n, len(seen) / n, size(_UPPER) / max(1, letters), size(_STOPS) / word_chars, size(b"!?") / word_chars,
        size(b"|") / word_chars, adjacent / n, max(seen.values()) / n, size(b"0123456789") / word_chars, marked / n,
    )
    return (n, word_chars, symbols, dup_lines, repeats), features


def batch_stats(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows x 5, int64) and features (rows x 14) of a column of texts; null has no words."""
    rows = [counts_of(x or b"") for x in texts.cast(pa.binary()).to_pylist()]
    counts = np.array([r[0] for r in rows], dtype=np.int64).reshape(len(rows), len(COUNTS))
    return counts, np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
