"""Byte-pair encoding by dynamic programming over prefixes.

Every prefix of a word has exactly one encoding, and a token sequence is that encoding if and only if each
pair of neighbours is what the merge rules make of the two tokens' bytes. So the last token of each prefix is
the one vocabulary entry that ends there and goes with the last token of the prefix before it. An automaton
over the vocabulary gives all entries that are suffixes of the prefix read so far; the pair test picks one.
Counts and back-pointers follow, for every prefix, in one pass without a merge queue.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache

import ahocorasick
import regex

# The split patterns of the two public tokenizers and the mark of a word's end.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Words remembered by a worker in each of two generations. It bounds memory and changes no result.
MEMORY = 500_000
#: Tokens share one integer in the table of pairs; START stands for the word's beginning.
SHIFT = 24
START = (1 << SHIFT) - 1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte value in the vocabulary files.

    Bytes that print stand for themselves, the others take the code points from 256 on, in order.
    """
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for value in range(256):
        letters.append(chr(value if value in prints else spare))
        spare += value not in prints
    return letters


class PrefixTable:
    """A vocabulary with its automaton; encode() and prefix_counts() fill the table of one word."""

    def __init__(self, model: dict):
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.names = {token: name for name, token in self.ids.items()}
        self.fits: dict[int, bool] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """All vocabulary entries as (length, id inside a word, id at a word's end)."""
        bodies: dict[str, list[int]] = {}
        for name, token in self.ids.items():
            closes = bool(self.end) and name.endswith(self.end) and len(name) > len(self.end)
            bodies.setdefault(name[: -len(self.end)] if closes else name, [-1, -1])[closes] = token
        automaton = ahocorasick.Automaton()
        for body, (inner, final) in bodies.items():
            automaton.add_word(body, (len(body), inner, final))
        automaton.make_automaton()
        return automaton

    def merged(self, letters: str, closed: bool) -> list[str]:
        """What the merge rules make of a few letters: the lowest rank first, leftmost among equals."""
        parts = list(letters)
        if closed:
            parts[-1] += self.end
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merge rules leave the pair as it stands; left START is the word's beginning."""
        names = [self.names[t] for t in (left, right) if t != START]
        closed = bool(self.end) and names[-1].endswith(self.end) and len(names[-1]) > len(self.end)
        letters = "".join(names)
        fits = self.merged(letters[: -len(self.end)] if closed else letters, closed) == names
        if len(self.fits) > 4 * MEMORY:
            self.fits.clear()
        self.fits[left << SHIFT | right] = fits
        return fits

    def encode(self, word: str) -> list[int]:
        """Ids of a whole word of byte letters, by the back-pointers from its end."""
        size = len(word)
        last, fits = [-1] * (size + 1), self.fits
        last[0] = START
        lengths = [0] * (size + 1)
        closing_at = size if self.end else -1
        for at, (length, inner, closing) in self.automaton.iter(word):
            end = at + 1
            if last[end] >= 0:
                continue
            token = closing if end == closing_at else inner
            left = last[end - length]
            if token < 0 or left < 0:
                continue
            known = fits.get(left << SHIFT | token)
            if self.compatible(left, token) if known is None else known:
                last[end], lengths[end] = token, length
        out = []
        while size:
            out.append(last[size])
            size -= lengths[size]
        out.reverse()
        return out

    def prefix_counts(self, word: str) -> list[int]:
        """Token count of each prefix of a word of byte letters, the empty one first, as a word of its own."""
        size, fits = len(word) + 1, self.fits
        last, inside, whole = [-1] * size, [0] * size, [0] * size
        last[0] = START
        for at, (length, inner, closing) in self.automaton.iter(word):
            end, begin = at + 1, at + 1 - length
            left = last[begin]
            if left < 0:
                continue
            if inner >= 0 and last[end] < 0:
                known = fits.get(left << SHIFT | inner)
                if self.compatible(left, inner) if known is None else known:
                    last[end], inside[end] = inner, inside[begin] + 1
            if closing >= 0 and not whole[end]:
                known = fits.get(left << SHIFT | closing)
                if self.compatible(left, closing) if known is None else known:
                    whole[end] = inside[begin] + 1
        return whole if self.end else inside


class _Memory(dict):
    """Remembers what a function gave for a word, within bounds: words used again outlive a generation."""

    def __init__(self, fn):
        super().__init__()
        self.fn, self.older = fn, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        if len(key) <= 200:
            self[key] = value
        return value


class _Shadow(dict):
    """For str.translate: letters and digits that the library's Unicode tables don't know yet become a symbol."""

    def __init__(self):
        super().__init__()
        from tokenizers import Regex, pre_tokenizers

        self.kinds = [
            (regex.compile(p), pre_tokenizers.Split(Regex(p), "isolated")) for p in (r"\p{L}", r"\p{N}")
        ]

    def __missing__(self, point: int) -> int:
        letter = chr(point)
        odd = any(ours.match(letter) and len(theirs.pre_tokenize_str(f"-{letter}-")) != 3 for ours, theirs in self.kinds)
        self[point] = 0xFFFF if odd else point
        return self[point]


class _Lower(dict):
    def __init__(self):
        super().__init__()
        from tokenizers import normalizers

        self.rule = normalizers.Lowercase()

    def __missing__(self, point: int) -> str:
        self[point] = self.rule.normalize_str(chr(point))
        return self[point]


_RARE = regex.compile(r"[^\x00-ԯ]")


class Splitter:
    """Cuts text into words as the pattern does, with the library's view of letters."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        self.shadow = _Shadow()

    def words(self, text: str) -> list[str]:
        if not _RARE.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.shadow))]


class Tokenizer:
    """One of the public byte-pair vocabularies, with whole texts cut into chunks that repeat a lot."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.table = PrefixTable(self.spec["model"])
        self.closed = bool(self.table.end)
        self.letters = byte_letters()
        self.splitter = Splitter(WORD_SPLIT if self.closed else BYTE_SPLIT)
        self.lower = _Lower()
        self.word_ids = _Memory(lambda word: self.table.encode(self.spelled(word)))
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, longest_first))) if self.special else None
        values = {letter: value for value, letter in enumerate(self.letters)}
        self.bytes_of = {
            token: bytes(values[c] for c in name) for token, name in self.table.names.items() if not self.closed
        } | {token: text.encode() for text, token in self.special.items()}

    def spelled(self, word: str) -> str:
        return "".join(map(self.letters.__getitem__, word.encode()))

    def normal(self, text: str) -> str:
        """Composed and lower-cased letter by letter, for the vocabulary with word ends; otherwise unchanged."""
        if not self.closed:
            return text
        text = unicodedata.normalize("NFC", text)
        return text.translate(self.lower) if _RARE.search(text) or "Σ" in text else text.lower()

    def pieces(self, text: str) -> list[tuple[str, int | None]]:
        """The text around its special strings, and those with their ids."""
        if not self.marks or "<|" not in text:
            return [(text, None)]
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [(text[at : m.start()], None), (m.group(), self.special[m.group()])]
            at = m.end()
        return [*out, (text[at:], None)]

    def chunks(self, text: str) -> list[str]:
        """Parts of a text without special strings that can be encoded one by one.

        White space ends a chunk. In the vocabulary that keeps white space, a space belongs to the chunk
        after it; where white space meets white space the text isn't cut at all.
        """
        if self.closed:
            return _SPACES.split(text) if _SEPARATORS.search(text) else text.split()
        if _MEETING.search(text):
            return self.splitter.words(text)
        head, *rest = text.split(" ")
        return [head, *(" " + x for x in rest)] if rest else [head]

    def chunk_ids(self, chunk: str) -> list[int]:
        words = self.splitter.words(self.normal(chunk))
        if len(words) == 1:
            return self.table.encode(self.spelled(words[0]))
        known = self.word_ids
        return [t for w in words for t in known[w]]


# White space as the libraries see it; str.split() would also cut at the separators 1C to 1F.
_SPACES = regex.compile(r"\s+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_MEETING = re.compile(r" \s|\s ")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)
