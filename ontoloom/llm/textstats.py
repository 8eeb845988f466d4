"""Counts over one text that several operators use. Texts are UTF-8 bytes; a null text is empty."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


class TextStats(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in windows), np.int64, len(windows))
    repeated = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= repeated
    return int(covered.sum())


def text_stats(text: str, data: bytes) -> TextStats:
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else []
    return TextStats(
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def base_failed(s: TextStats) -> bool:
    return s.n_words < 50 or 100 * s.n_repeat_words > 50 * s.n_words
