from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from curvewalk.llm import alignment
from curvewalk.llm.queries import QUERIES

from .conftest import ODD

LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
EXTRA = [" leading", "trailing ", "two  spaces   here", "▁ x▁y", "<s> </s> <unk> <0x41>", "a\x00b", "Ünïcödé", "x" * 50_000]


def sides():
    """Encoders that give (id, bytes) of each token, by the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(LEFT)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    letters = decoders.ByteLevel()
    plain = {i: a.id_to_token(i) for i in range(a.get_vocab_size())}

    def left(text):
        # Offsets of a byte-level token may share characters, so its bytes are taken from the whole decoded text.
        ids, out, done = a.encode(" " + text, add_special_tokens=False).ids, [], b""
        whole = (" " + text).encode()
        for i in ids:
            size = len(plain[i]) if plain[i] != "<|endoftext|>" else 13
            out.append((i, whole[len(done) : len(done) + size]))
            done += out[-1][1]
        assert done == whole and letters.decode([plain[i] for i in ids]) == " " + text
        return out

    def right(text):
        out = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            out.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        return out

    return left, right


def plain(text, left, right):
    """(ids a, ids b, overlaps, groups, links) by looking at all pairs of tokens."""
    if not text:
        return [], [], [], [], []
    a, b = left(text), right(text)
    if b"".join(x for _, x in b) != (" " + text).encode():
        return [], [], [], [], []

    def ranges(tokens):
        at, out = 0, []
        for _, x in tokens:
            out.append((at, at + len(x)))
            at += len(x)
        return out

    ra, rb = ranges(a), ranges(b)
    ends_b = {e: j for j, (_, e) in enumerate(rb)}
    overlaps, near = [], 0
    for i, (s, e) in enumerate(ra):
        while rb[near][1] <= s:
            near += 1
        j = near
        while j < len(rb) and rb[j][0] < e:
            overlaps.append((i, j))
            j += 1
    links = [(i, ends_b[e]) for i, (_, e) in enumerate(ra) if e in ends_b]
    groups, i, j = [], 0, 0
    for last_a, last_b in links:
        groups.append(",".join(str(x) for x, _ in a[i : last_a + 1]) + "|" + ",".join(str(x) for x, _ in b[j : last_b + 1]))
        i, j = last_a + 1, last_b + 1
    return [x for x, _ in a], [x for x, _ in b], overlaps, groups, [(a[i][0], b[j][0]) for i, j in links]


def check_scores(rows, texts):
    """rows of (doc_id, text) against the plain results over all of them."""
    left, right = sides()
    found = {t: plain(t, left, right) for t in set(texts)}
    counts = Counter(link for t in texts for link in found[t][4])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = []
    for doc, t in rows:
        a, b, over, groups, links = found[t]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        tops = sum(counts[x] == best[x[1]] for x in links)
        want.append((doc, len(a), len(b), len(groups), len(links), tops, sum(counts[x] for x in links), sha, len(over)))
    return want


def listed(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_whole_query_against_plain_alignment(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    got = QUERIES["op11_token_alignment"](spark, SF)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]
    assert listed(got.select(*names).collect()) == listed(check_scores(rows, [t for _, t in rows]))


@pytest.mark.parametrize("common", [0, 5, 200_000])
def test_odd_texts_with_any_number_of_common_pairs(spark, common):
    rows = list(enumerate([*ODD, *EXTRA, "the cat sat", "the cat sat"])) + [(None, "the cat sat"), (3, "a")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_a long")
    got = alignment.alignment_scores(docs, LEFT, RIGHT, common=common)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]
    assert listed(got.select(*names).collect()) == listed(check_scores(rows, [t for _, t in rows]))


def test_tokens_overlaps_and_groups(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHARS", 40)  # several portions
    rows = list(enumerate([*ODD, *EXTRA]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left, right = sides()
    for r in alignment.align_tokens(docs, LEFT, RIGHT).collect():
        a, b, over, groups, links = plain(rows[r.doc_id][1], left, right)
        assert (r.a_ids, r.b_ids, list(zip(r.overlap_a, r.overlap_b))) == (a, b, over)
        assert [(r.a_ids[i], r.b_ids[j]) for i, j in zip(r.group_a, r.group_b)] == links and len(groups) == len(r.group_a)


def test_texts_that_a_side_does_not_give_back_have_no_tokens(spark):
    docs = spark.createDataFrame([(0, "▁ x▁y"), (1, None), (2, "")], "doc_id long, text string")
    for r in alignment.align_tokens(docs, LEFT, RIGHT).collect():
        assert r.a_ids == r.b_ids == r.group_a == []


def test_empty_table(none):
    assert alignment.alignment_scores(none, LEFT, RIGHT).count() == 0
    assert alignment.align_tokens(none, LEFT, RIGHT).count() == 0
