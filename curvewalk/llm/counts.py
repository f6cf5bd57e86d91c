"""Token counts of every prefix of a text, and what follows from them: budgets and truncation without re-encoding."""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvewalk.llm.bpe import Tokenizer, _Memory, tokenizer
from curvewalk.llm.tables import id_and_text, map_columns


class Counter:
    """Counts tokens under a vocabulary with word ends (or without), remembering chunks."""

    def __init__(self, vocabulary: Tokenizer):
        self.vocabulary = vocabulary
        self.known = _Memory(lambda chunk: len(vocabulary.chunk_ids(chunk)))

    def prefixes(self, chunk: str) -> list[int]:
        """Token count of each prefix of a chunk, the empty one first, as if the text ended there.

        Prefixes are those of the normalised chunk (composed, lower-cased), by code point.
        """
        vocabulary, counts, before = self.vocabulary, [0], 0
        for word in vocabulary.splitter.words(vocabulary.normal(chunk)):
            ends = vocabulary.table.prefix_counts(vocabulary.spelled(word))
            byte, here = 0, []
            for at, letter in enumerate(word):
                byte += len(letter.encode())
                # A contraction that is cut falls apart into its apostrophe and letters.
                if word[0] == "'" and 0 < at < len(word) - 1:
                    here.append(sum(self.prefixes(w)[-1] for w in ("'", word[1 : at + 1])))
                else:
                    here.append(ends[byte])
            counts += [before + n for n in here]
            before = counts[-1]
        return counts

    def chunks(self, text: str) -> list[tuple[str, int]]:
        """Each chunk with its token count."""
        out: list[tuple[str, int]] = []
        for piece, special in self.vocabulary.pieces(text):
            if special is not None:
                out.append((piece, 1))
            else:
                chunks = self.vocabulary.chunks(piece)
                out += zip(chunks, map(self.known.__getitem__, chunks))
        return out

    def count(self, text: str) -> int:
        if "<|" not in text:
            return sum(map(self.known.__getitem__, self.vocabulary.chunks(text)))
        return sum(n for _, n in self.chunks(text))

    def within(self, text: str, budget: int) -> tuple[int, int, int]:
        """The longest prefix with at most budget tokens: whole chunks, code points of the next one, tokens."""
        chunks = self.chunks(text)
        ends = [0, *accumulate(n for _, n in chunks)]
        if ends[-1] <= budget:
            return len(chunks), 0, ends[-1]
        # Counts at chunk ends never fall; inside a chunk a longer prefix may need fewer tokens.
        whole = bisect_right(ends, budget) - 1
        if chunks[whole][0] in self.vocabulary.special:
            return whole, 0, ends[whole]
        inside = self.prefixes(chunks[whole][0])
        letters = max(i for i, n in enumerate(inside) if ends[whole] + n <= budget)
        return whole, letters, ends[whole] + inside[letters]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(tokenizer(path))


def count_tokens(
    docs: DataFrame, vocabulary: str, budget: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, budget_chunks, budget_letters, budget_tokens) of every text.

    The last three tell how far the longest prefix with at most budget tokens reaches: whole chunks (words
    between white space), code points of the chunk after them, and its exact token count. A null text counts
    as empty, an empty one has no tokens. One row per input row; other columns are ignored.
    """
    slim = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def run(doc_id, text, n_bytes) -> dict:
        count, out = counter(vocabulary), {k: [] for k in ("n_tokens", "over_limit", "chunks", "letters", "tokens")}
        for t in text.to_pylist():
            n = count.count(t)
            chunks, letters, tokens = count.within(t, budget) if n > budget else (None, None, n)
            for key, value in zip(out, (n, n > budget, chunks, letters, tokens)):
                out[key].append(value)
        return {
            "doc_id": doc_id,
            "n_bytes": n_bytes,
            "n_tokens": out["n_tokens"],
            "over_limit": out["over_limit"],
            "budget_chunks": out["chunks"],
            "budget_letters": out["letters"],
            "budget_tokens": out["tokens"],
        }

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, budget_chunks long, budget_letters long, budget_tokens long"
    return map_columns(slim, run, schema)
