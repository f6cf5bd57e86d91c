"""Aligning the tokens of two tokenizers over the same bytes.

A text's tokens on either side cover its bytes without gap. Each token's start is looked up among the other side's
starts, in both directions: the covering token overlaps it, and every overlap is found from the token that starts
later. Places where tokens of both sides end cut the text into groups; the pairs that end there are its links.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvewalk.llm.tables import _arrow_schema, id_and_text
from curvewalk.sources.tables import materialize

#: Characters of texts aligned at a time; a longer text is taken alone.
CHARS = 1 << 20
#: Pairs of ids whose counts are sent to every task. All other pairs' counts meet their links by a join.
COMMON = 200_000


class Side:
    """A tokenizer with the bytes of each of its tokens."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
            self.bytes_of = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            with open(path, encoding="utf-8") as file:
                spec = json.load(file)
            letters = {c: bytes([b]) for b, c in byte_letters().items()}
            vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
            self.bytes_of = [b""] * (1 + max(vocabulary.values()))
            for token, i in vocabulary.items():
                self.bytes_of[i] = b"".join(letters.get(c, c.encode()) for c in token)
            encode = self._by_ranks(spec) or _by_library(path)
            self.encode = lambda texts: encode([" " + t for t in texts])
        self.size = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def _by_ranks(self, spec: dict) -> Callable[[list[str]], list[list[int]]] | None:
        """A faster encoder with the same ids, for a byte-level file whose merged tokens are numbered in order of the merges."""
        import public_tokenizers
        import tiktoken

        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if spec["normalizer"] or model["type"] != "BPE" or any(cut.get(k) != v for k, v in plain.items()):
            return None
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {self.bytes_of[i]: i for t, i in model["vocab"].items() if t not in special}
        if sorted(set(ids)) != ids or len(ranks) != 256 + len(ids):
            return None
        ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: ranked.encode_ordinary_batch(texts, num_threads=1)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _by_library(path: str) -> Callable[[list[str]], list[list[int]]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    model.no_truncation()
    model.no_padding()
    return lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    return Side(path)


@dataclass
class Aligned:
    """Tokens, overlaps and groups of some texts, each array over all of them; *_at says where a text's part begins."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    over_a: np.ndarray
    over_b: np.ndarray
    over_at: np.ndarray
    last_a: np.ndarray  # of each group, its last token on each side: the link
    last_b: np.ndarray
    group_at: np.ndarray


def align(texts: list[str], left: Side, right: Side) -> Aligned:
    """Texts that are empty, or whose joined bytes on a side differ from a space and the text, have no tokens."""
    a_ids, b_ids = left.encode(texts), right.encode(texts)
    for i, t in enumerate(texts):
        whole = b" " + t.encode()
        if not t or left.joined(a_ids[i]) != whole or right.joined(b_ids[i]) != whole:
            a_ids[i], b_ids[i] = [], []

    def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.array([len(x) for x in ids], dtype=np.int64)
        joined = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(counts.sum()))
        return joined, np.r_[0, np.cumsum(counts)], np.repeat(np.arange(len(ids)), counts)

    (a, a_at, a_doc), (b, b_at, b_doc) = flat(a_ids), flat(b_ids)
    # Both sides have the same bytes, so running sums over all texts are the same places on both.
    a_end, b_end = np.cumsum(left.size[a]), np.cumsum(right.size[b])
    mine = pd.DataFrame({"doc": a_doc, "at": a_end - left.size[a], "a": np.arange(len(a))})
    other = pd.DataFrame({"doc": b_doc, "at": b_end - right.size[b], "b": np.arange(len(b))})
    down = pd.merge_asof(mine, other, on="at", by="doc")
    up = pd.merge_asof(other, mine.assign(begin=mine["at"]), on="at", by="doc")
    up = up[up["begin"] < up["at"]]  # equal starts are in down
    over_a = np.r_[down["a"].to_numpy(), up["a"].to_numpy()]
    over_b = np.r_[down["b"].to_numpy(), up["b"].to_numpy()]
    # An overlap's later start is inside the other token, so its order by both sides is that by the sum.
    order = np.argsort(over_a + over_b, kind="stable")
    over_a, over_b = over_a[order], over_b[order]
    together = a_end[over_a] == b_end[over_b]
    last_a, last_b = over_a[together], over_b[together]
    edges = np.arange(len(texts) + 1)
    return Aligned(
        a, b, a_at, b_at, over_a, over_b, np.searchsorted(a_doc[over_a], edges), last_a, last_b, np.searchsorted(a_doc[last_a], edges)
    )


class Digits:
    """Token ids as text: groups as a1,a2|b1;a3|b2."""

    def __init__(self, size: int):
        self.comma, self.bar, self.end = (np.array([f"{i}{c}" for i in range(size)], dtype="S") for c in ",|;")

    def groups(self, x: Aligned) -> list[bytes]:
        """Each text's groups."""
        n, m = len(x.a), len(x.b)
        # A token comes after all tokens of the other side in earlier groups; on the right, also in its own.
        before = np.searchsorted(x.last_a, np.arange(n))
        after = np.searchsorted(x.last_b, np.arange(m))
        a_place = np.arange(n) + np.r_[0, x.last_b + 1][before]
        b_place = np.arange(m) + (x.last_a + 1)[after]
        kind = self.comma.dtype
        out = np.zeros(n + m, dtype=kind)
        out[a_place], out[b_place] = self.comma[x.a], self.comma[x.b]
        out[a_place[x.last_a]], out[b_place[x.last_b]] = self.bar[x.a[x.last_a]], self.end[x.b[x.last_b]]
        edges = (x.a_at + x.b_at).tolist()
        return [out[i:j].tobytes().replace(b"\0", b"")[:-1] for i, j in zip(edges, edges[1:])]


@lru_cache(maxsize=2)
def digits(size: int) -> Digits:
    return Digits(size)


def _portions(texts: list[str]) -> Iterator[slice]:
    """Slices of the texts with about CHARS characters."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHARS:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))


def _mapped(docs: DataFrame, schema: str, left: str, right: str, columns) -> DataFrame:
    """columns(Aligned, left, right) gives the columns after those of docs but its last, the text."""
    fields = _arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for part in _portions(texts):
                x = align(texts[part], side(left), side(right))
                kept = [c.slice(part.start, part.stop - part.start) for c in batch.columns[:-1]]
                made = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns(x, side(left), side(right))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, *made], fields)], schema=fields)

    return docs.mapInArrow(run, schema)


def align_tokens(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, overlap_a, overlap_b, group_a, group_b) of every text, by two tokenizer files.

    a_ids and b_ids are its tokens; overlap_a[i] and overlap_b[i] the places of two tokens that share bytes, in order;
    group_a[i] and group_b[i] the places of the last tokens of group i, which end at the same byte and are its link.

    Tokens are those of a space and the text; a .model file adds that space itself. Special strings inside a text are
    plain text. Null and empty texts, and texts that either side's tokens don't give back byte for byte, have no
    tokens. One row per input row, repeated and null ids included; an empty table gives no rows and other columns are
    ignored. Memory follows the longest text.
    """

    def columns(x: Aligned, *_) -> list:
        over, group = x.over_at, x.group_at
        a_first, b_first = np.repeat(x.a_at[:-1], np.diff(over)), np.repeat(x.b_at[:-1], np.diff(over))
        a_start, b_start = np.repeat(x.a_at[:-1], np.diff(group)), np.repeat(x.b_at[:-1], np.diff(group))
        return [
            _lists(x.a, x.a_at), _lists(x.b, x.b_at), _lists(x.over_a - a_first, over), _lists(x.over_b - b_first, over),
            _lists(x.last_a - a_start, group), _lists(x.last_b - b_start, group),
        ]

    names = ["a_ids", "b_ids", "overlap_a", "overlap_b", "group_a", "group_b"]
    schema = "doc_id long, " + ", ".join(f"{c} array<int>" for c in names)
    return _mapped(id_and_text(docs, id_col, text_col), schema, left, right, columns)


def alignment_links(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_overlaps, n_groups, groups_sha256, link_a, link_b, link_n) of every text.

    The last three list its different linked pairs of ids and how often they are linked. groups_sha256 is the digest of
    the groups as a1,a2|b1;a3|b2, empty without tokens. Rows are as in align_tokens, row numbers them.
    """

    def columns(x: Aligned, a: Side, b: Side) -> list:
        counts = [np.diff(x.a_at), np.diff(x.b_at), np.diff(x.over_at), np.diff(x.group_at)]
        sha = [hashlib.sha256(g).hexdigest() if g else "" for g in digits(max(len(a.size), len(b.size))).groups(x)]
        doc = np.repeat(np.arange(len(counts[3])), counts[3])
        # One number for text and pair; texts are at most CHARS and ids below 2^20, so it fits in 64 bits.
        code, times = np.unique((doc * len(a.size) + x.a[x.last_a]) * len(b.size) + x.b[x.last_b], return_counts=True)
        at = np.searchsorted(code // (len(a.size) * len(b.size)), np.arange(len(counts[3]) + 1))
        return [*counts, sha, _lists(code // len(b.size) % len(a.size), at), _lists(code % len(b.size), at), _lists(times, at)]

    slim = id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = "row long, doc_id long, n_a long, n_b long, n_overlaps long, n_groups long, groups_sha256 string, "
    schema += "link_a array<int>, link_b array<int>, link_n array<int>"
    return _mapped(slim, schema, left, right, columns)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, total, best): how many links of the corpus have this pair, and whether none of its b's pairs has more."""
    each = links.select(F.inline(F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_n").alias("n"))))
    pairs = materialize(each.groupBy("a", "b").agg(F.sum("n").alias("total")), "pairs")
    most = pairs.groupBy("b").agg(F.max("total").alias("most"))
    return pairs.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def score_links(links: DataFrame, counts: DataFrame, common: int = COMMON) -> DataFrame:
    """(row, n_links, n_best, count_sum) of the texts that have links.

    The common most frequent pairs' counts go to every task, a bound whatever the corpus; the other pairs are rare, so
    no key of their join is large.
    """
    counts = materialize(counts, "pair-counts")
    few = counts.orderBy(F.desc("total"), "a", "b").limit(common)
    few = materialize(few, "common-pairs")
    zipped = F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_n").alias("n"))
    each = links.select("row", F.inline(zipped))
    looked = each.join(F.broadcast(few), ["a", "b"], "left")
    rest = looked.where("total is null").select("row", "a", "b", "n").join(counts, ["a", "b"])

    def summed(found: DataFrame) -> DataFrame:
        n = F.col("n").cast("long")
        return found.groupBy("row").agg(
            F.sum(n).alias("n_links"), F.sum(n * F.col("best")).alias("n_best"), F.sum(n * F.col("total")).alias("count_sum")
        )

    both = summed(looked.where("total is not null")).unionByName(summed(rest))
    return both.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])


def alignment_scores(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """(doc_id, n_a, n_b, n_overlaps, n_groups, n_links, n_best, count_sum, groups_sha256) of every text.

    n_best counts the links whose pair is among the most frequent ones of its right id in the corpus, count_sum adds up
    the counts of all links' pairs. Rows are as in align_tokens; without tokens all counts are 0.
    """
    links = materialize(alignment_links(docs, left, right, id_col, text_col), "links")
    scored = score_links(links, pair_counts(links), common)
    zero = F.lit(0).cast("long")
    return links.join(scored, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_overlaps", "n_groups",
        *[F.coalesce(c, zero).alias(c) for c in ("n_links", "n_best", "count_sum")], "groups_sha256",
    )
