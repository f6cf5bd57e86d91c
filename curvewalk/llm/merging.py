"""Merge rules of a byte-pair vocabulary with word ends, applied to many words at a time in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from curvewalk.llm.bpe import WORD_SPLIT, Splitter, Tokenizer, tokenizer

#: Bytes of a word up to which it is merged with others in one array; longer ones are encoded one by one.
WIDE = 24
#: Chunks and words remembered by a worker in each of two generations; what is used again outlives one.
CHUNKS, WORDS = 500_000, 250_000
_NONE = np.int32(1 << 30)
_EMPTY = np.int64(-1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Merger:
    """Ids of many words at once: in each round every word merges its pair of lowest rank, leftmost first."""

    def __init__(self, vocabulary: Tokenizer):
        table, end = vocabulary.table, vocabulary.table.end
        self.table, self.letters = table, vocabulary.letters
        self.open = np.array([table.ids[c] for c in self.letters], dtype=np.int64)
        self.closed = np.array([table.ids[c + end] for c in self.letters], dtype=np.int64)
        pairs = [(table.ids[a] << 24 | table.ids[b], rank, table.ids[a + b]) for (a, b), rank in table.ranks.items()]
        keys, ranks, made = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.made = np.zeros(int(ranks.max()) + 1, dtype=np.int64)
        self.made[ranks] = made
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):  # open addressing, all keys a step at a time
            free = left[self.keys[slot[left]] == _EMPTY]
            taken, first = np.unique(slot[free], return_index=True)
            self.keys[taken], self.ranks[taken] = keys[free[first]], ranks[free[first]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 24 | right
        slot = self._slots(key)
        found, out = self.keys[slot], self.ranks[slot]
        out = np.where(found == key, out, _NONE)
        again = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(again):
            slot[again] = (slot[again] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[again]]
            hit = found == key[again]
            out[again[hit]] = self.ranks[slot[again[hit]]]
            again = again[~hit & (found != _EMPTY)]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, word in enumerate(words):
            if len(word) <= WIDE:
                short.append(i)
            else:
                out[i] = np.array(self.table.encode("".join(map(self.letters.__getitem__, word))), "<u4").tobytes()
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            for i, ids in zip(part, self._merge([words[i] for i in part])):
                out[i] = ids
        return out

    def _merge(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        width = int(sizes.max(initial=1))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        tokens = np.full((len(words), width + 1), -1, dtype=np.int64)
        inside = np.arange(width + 1) < sizes[:, None]
        tokens[inside] = self.open[flat]
        some = np.flatnonzero(sizes)
        tokens[some, sizes[some] - 1] = self.closed[flat[np.cumsum(sizes)[some] - 1]]
        ranks = np.full((len(words), width), _NONE, dtype=np.int32)
        paired = inside[:, 1:]
        ranks[paired] = self.rank(tokens[:, :-1][paired], tokens[:, 1:][paired])
        columns, active = np.arange(width), np.arange(len(words))
        done = np.empty_like(tokens)
        while len(active):
            at = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(active)), at]
            live = lowest < _NONE
            done[active[~live]] = tokens[~live]
            active, at, lowest, tokens, ranks = active[live], at[live], lowest[live], tokens[live], ranks[live]
            row = np.arange(len(active))
            behind = columns > at[:, None]
            tokens[:, :-1] = np.where(behind, tokens[:, 1:], tokens[:, :-1])
            tokens[:, -1] = -1
            tokens[row, at] = self.made[lowest]
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NONE
            ranks[row, at] = _NONE
            more = np.flatnonzero(tokens[row, at + 1] >= 0)
            ranks[more, at[more]] = self.rank(tokens[more, at[more]], tokens[more, at[more] + 1])
            more = np.flatnonzero(at > 0)
            ranks[more, at[more] - 1] = self.rank(tokens[more, at[more] - 1], tokens[more, at[more]])
        kept = done >= 0
        raw, ends = done[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _recall(keys: set[str], known: dict[str, bytes], older: dict[str, bytes]) -> list[str]:
    """Take what an older generation knows into the present one; what is left is new."""
    new = []
    for key in keys:
        ids = older.get(key)
        if ids is None:
            new.append(key)
        else:
            known[key] = ids
    return new


class BatchCoder:
    """Encodes texts by the batch, merging only words not seen before; chunks and words bound what it remembers."""

    def __init__(self, vocabulary: Tokenizer, chunks: int = CHUNKS, words: int = WORDS):
        self.most_chunks, self.most_words = chunks, words
        if not vocabulary.closed:
            raise ValueError("this coder is for vocabularies with word ends")
        self.vocabulary, self.merger = vocabulary, Merger(vocabulary)
        self.splitter = Splitter(WORD_SPLIT + r"|\n")
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        """Ids of chunks that aren't known yet; chunks hold no white space."""
        new = _recall(chunks, self.chunks, self.older_chunks)
        marked = self.splitter.words(self.vocabulary.normal("\n".join(new)))
        if len(self.words) > self.most_words:
            self.words, self.older_words = {}, self.words
        unknown = _recall(set(marked).difference(self.words, "\n"), self.words, self.older_words)
        self.words.update(zip(unknown, self.merger.encode([w.encode() for w in unknown])))
        known, parts, at = self.words, [], 0
        for word in marked:
            if word == "\n":
                self.chunks[new[at]] = b"".join(parts)
                parts, at = [], at + 1
            else:
                parts.append(known[word])
        if new:
            self.chunks[new[at]] = b"".join(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.chunks) > self.most_chunks:
            self.chunks, self.older_chunks = {}, self.chunks
        cut = [[(special, piece if special is not None else self.vocabulary.chunks(piece)) for piece, special in self.vocabulary.pieces(t)] for t in texts]
        seen: set[str] = set()
        for pieces in cut:
            for special, chunks in pieces:
                if special is None:
                    seen.update(chunks)
        self.learn(seen.difference(self.chunks))
        known, out = self.chunks, []
        for pieces in cut:
            parts: list[bytes] = []
            for special, chunks in pieces:
                if special is not None:
                    parts.append(int(special).to_bytes(4, "little"))
                else:
                    parts += map(known.__getitem__, chunks)
            out.append(b"".join(parts))
        return out


@lru_cache(maxsize=2)
def batch_coder(path: str, chunks: int = CHUNKS, words: int = WORDS) -> BatchCoder:
    return BatchCoder(tokenizer(path), chunks, words)
