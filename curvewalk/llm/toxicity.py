"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length.

The lexicon is learned from labelled rows: whole words and word beginnings with the log odds of being in a toxic text.
Texts are folded first: compatibility forms and look-alike letters become Latin ones, digits and signs inside words
the letters they stand for. Phrases in which a listed word is used harmlessly are exceptions and cancel its hit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewalk.llm.tables import id_and_text, map_columns

# Letters of other scripts that look like Latin ones, and signs used for letters inside words.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ѐ": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ո": "n", "օ": "o",
}
SIGNS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "l", "|": "l"}
#: One letter for those that signs can't tell apart.
SAME = {"i": "l"}
UNSEEN = "​‌‍⁠﻿­"

#: Labelled rows of each label that a lexicon is learned from at most, on average: the bound of the fit.
FIT_ROWS = 2_500
#: Words of a text that are added to its length, so that one hit in a short text doesn't count as a dense one.
PRIOR_WORDS = 20
LEAST_CONTEXTS, LEAST_WEIGHT, MOST_TERMS = 4, 2.0, 5_000
PREFIXES = range(4, 8)
CHANCE = 1e-5

_FOLD = {ord(a): SAME.get(b, b) for a, b in LOOK_ALIKES.items()} | {ord(a): b for a, b in SAME.items()} | dict.fromkeys(map(ord, UNSEEN))
_SIGNS = {ord(a): b for a, b in SIGNS.items()}
_MIXED = re.compile(r"[^\W\d_](?:[\w@$|!]*[\w@$|])?[0-9@$|!](?=[^\W_])[\w@$|]*|[0-9@$|!]+[^\W\d_][\w@$|]*|[^\W\d_]+[013457@$|]+\b[\w@$|]*")
_SIGN = re.compile(r"[0-9@$|!]")
_GAPS = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes and signs inside words replaced, words apart by one space, a space at both ends."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
    if _SIGN.search(text):
        text = _MIXED.sub(lambda m: m.group().translate(_SIGNS), text)
    return f" {_GAPS.sub(' ', text.translate(_FOLD)).strip()} "


class Lexicon:
    """Terms as ' word ' or ' beginning', with weights, and exception phrases; scores folded texts."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: list[float]):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> tuple[float, int]:
        """Sum of weights and number of the words hit; a word counts its heaviest term, none inside an exception."""
        if not len(self.automaton):
            return 0.0, 0
        best: dict[int, float] = {}
        spans: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spans.append((start, end))
            else:
                best[start] = max(weight, best.get(start, 0.0))
        for low, high in spans:
            for start in [s for s in best if low <= s < high]:
                del best[start]
        return sum(best.values()), len(best)

    def features(self, text: str) -> tuple[float, float, int]:
        """Log weight, log weight for the length, and the number of words hit."""
        folded = fold(text)
        total, hits = self.hits(folded)
        words = folded.count(" ") - 1
        return math.log1p(total), math.log1p(100.0 * total / (words + PRIOR_WORDS)), hits

    def score(self, text: str) -> tuple[float, int]:
        total, dense, hits = self.features(text)
        z = self.curve[0] + self.curve[1] * total + self.curve[2] * dense
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z)))), hits


def learn(texts: list[str], toxic: list[int], share: float | None = None) -> Lexicon:
    """A lexicon from labelled texts. share is the toxic share of all labelled rows, if the texts are no fair sample.

    A term's weight is its smoothed log odds. It counts in how many different contexts it stands in toxic texts, not how
    often, so that copies of one text don't make its words terms. Terms are taken from the most frequent on, and one
    whose toxic texts are all explained by those before it is left out unless it is in no clean text and in more toxic
    ones than chance would put it. Harmless phrases of a word are those found in several clean contexts and no toxic one.
    """
    contexts: dict[str, set[int]] = defaultdict(set)
    inside: dict[str, set[int]] = defaultdict(set)
    clean: dict[str, int] = defaultdict(int)
    same: dict[str, str] = {}  # one object a word keeps the driver's share small
    rows = [([same.setdefault(w, w) for w in fold(t).split()], y) for t, y in zip(texts, toxic)]
    n_toxic = sum(y for _, y in rows)
    n_clean = len(rows) - n_toxic
    if not n_toxic or not n_clean:
        level = 4.0 if n_toxic and not n_clean else -4.0
        return Lexicon({}, [], [level, 0.0, 0.0])
    often: dict[str, int] = defaultdict(int)
    for words, y in rows:
        if y:
            for term in {form for word in set(words) for form in _forms(word)}:
                often[term] += 1
    often = {term: n for term, n in often.items() if n >= LEAST_CONTEXTS}
    for number, (words, y) in enumerate(rows):
        if y:
            for before, word, after in zip([""] + words, words, words[1:] + [""]):
                for term in _forms(word):
                    if term in often:
                        contexts[term].add(hash((before, after)))
                        inside[term].add(number)
    for words, y in rows:
        if not y:
            for term in {form for word in set(words) for form in _forms(word)}:
                if term in contexts:
                    clean[term] += 1
    found = []
    for term, seen in contexts.items():
        if len(seen) >= LEAST_CONTEXTS:
            weight = math.log((min(len(seen), len(inside[term])) + 0.5) / n_toxic) - math.log((clean[term] + 0.5) / n_clean)
            if weight >= LEAST_WEIGHT:
                found.append((len(inside[term]) * weight, len(term), term, weight))
    found.sort(reverse=True)
    # So many toxic texts and no clean one are hardly chance for a word that has nothing to do with the label.
    sure = max(LEAST_CONTEXTS, math.ceil(math.log(CHANCE) / math.log(n_toxic / len(rows))))
    explained: set[int] = set()
    weights: dict[str, float] = {}
    for _, _, term, weight in found:
        new = len(inside[term] - explained)
        if new >= 2 or clean[term] == 0 and min(len(inside[term]), len(contexts[term])) >= sure:
            weights[term] = weight
            explained |= inside[term]
        if len(weights) == MOST_TERMS:
            break
    lexicon = Lexicon(weights, _exceptions(rows, weights), [0.0, 0.0, 0.0])
    x = np.array([lexicon.features(t)[:2] for t in texts])
    y = np.array(toxic, dtype=float)
    share = n_toxic / len(rows) if share is None else min(max(share, 1e-4), 1 - 1e-4)
    each = np.where(y == 1, share / n_toxic, (1 - share) / n_clean) * len(rows)
    return Lexicon(weights, lexicon.exceptions, _logistic(x, y, each))


def _forms(word: str) -> list[str]:
    return [f" {word} "] + [f" {word[:k]}" for k in PREFIXES if k <= len(word)] if len(word) >= 3 else []


def _exceptions(rows: list[tuple[list[str], int]], weights: dict[str, float]) -> list[str]:
    clean: dict[str, set[int]] = defaultdict(set)
    bad: set[str] = set()
    for words, y in rows:
        for i, word in enumerate(words):
            if any(form in weights for form in _forms(word)):
                for a, b in ((i - 1, i), (i, i + 1)):
                    if 0 <= a and b < len(words):
                        phrase = f" {words[a]} {words[b]} "
                        if y:
                            bad.add(phrase)
                        else:
                            clean[phrase].add(hash(tuple(words[max(0, a - 1) : b + 2])))
    return sorted(p for p, seen in clean.items() if len(seen) >= LEAST_CONTEXTS and p not in bad)


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> list[float]:
    """Weighted logistic regression with a small penalty, by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-3, 1e-2, 1e-2]) * len(x) / 100
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (each * (y - p)) - penalty @ beta
        step = np.linalg.solve((x * (each * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta.tolist()


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from the labelled rows that aren't held out.

    Of either label about fit_rows rows are used, chosen by the hash of their ids: the sample is bounded whatever the
    table's size. Labels other than 0 and 1 and null ids are left out; of repeated labels the largest counts, of
    documents that repeat an id the text with the least hash.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("toxic").cast("int").alias("toxic")).where(~is_held_out(F.col("doc_id")))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limits = [F.when(F.col("toxic") == y, dealt < int(min(1.0, fit_rows / n) * (1 << 30))) for y, n in counts.items()]
    if not limits:
        return learn([], [])
    sample = known.where(F.coalesce(*limits))
    # The sample is bounded by fit_rows, so its ids go to the texts; of rows that repeat an id one text counts.
    found = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    rows = found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    share = counts.get(1, 0) / sum(counts.values())
    return learn([r.text for r in rows], [r.toxic for r in rows], share)


@lru_cache(maxsize=2)
def _lexicon(weights: tuple, exceptions: tuple, curve: tuple) -> Lexicon:
    return Lexicon(dict(weights), list(exceptions), list(curve))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted, hits).

    score is the calibrated share of toxic texts among those with as many and as dense hits, from 0 to 1; predicted
    is 1 from limit on. Only the text counts. A null or empty text has no hits and the score of such texts. Repeated
    rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    state = (tuple(lexicon.weights.items()), tuple(lexicon.exceptions), tuple(lexicon.curve))
    slim = id_and_text(docs, id_col, text_col).withColumn("held_out", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)))

    def run(doc_id, text, held_out) -> dict:
        model = _lexicon(*state)
        scored = [model.score(t) for t in text.to_pylist()]
        return {
            "doc_id": doc_id,
            "held_out": held_out,
            "score": [s for s, _ in scored],
            "predicted": [int(s >= limit) for s, _ in scored],
            "hits": [n for _, n in scored],
        }

    return map_columns(slim, run, "doc_id long, held_out boolean, score double, predicted int, hits long")
