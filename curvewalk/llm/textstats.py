"""Word, symbol and repetition statistics of one text."""

from __future__ import annotations

from collections import Counter

import numpy as np

SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"!\"'(),-./:;?@[\\]^_`{}~+="
WINDOW = 8
_FACTORS = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that occurs twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    sums = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    factor, width = int(_FACTORS[0]), 1
    while width < window:
        sums = sums[: len(sums) - width] * np.uint64(pow(factor, width, 1 << 64)) + sums[width:]
        width *= 2
    order = np.argsort(sums, kind="stable")
    equal = sums[order[1:]] == sums[order[:-1]]
    if not equal.any():
        return 0
    maybe = np.unique(np.r_[order[1:][equal], order[:-1][equal]])
    # The sums are hashes; only equal words count.
    spans = {int(i): tuple(words[i : i + window]) for i in maybe}
    seen = Counter(spans.values())
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for i, span in spans.items():
        if seen[span] > 1:
            edges[i] += 1
            edges[i + window] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def duplicate_lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def without(raw: bytes, removed: bytes) -> int:
    return len(raw) - len(raw.translate(None, removed))


def statistics(text: str) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then lines, capitals and other marks."""
    raw = text.encode()
    words = raw.split()  # at the bytes 20 and 09 to 0D
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines, again = duplicate_lines(raw)
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), chars, symbols, again, repeated_words(words), lines, without(raw, UPPER), without(raw, MARKS)
