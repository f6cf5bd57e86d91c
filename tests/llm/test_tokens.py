"""Counts, ids and packing against the public library itself."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curvewalk.llm.bpe import tokenizer
from curvewalk.llm.counts import count_tokens, counter
from curvewalk.llm.encoding import coder, decode_ids, encode_texts, encoding_digests
from curvewalk.llm.merging import batch_coder
from curvewalk.llm.packing import Mixture, pack

from .conftest import ODD

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}


def mixed(n, seed=1):
    pick = random.Random(seed)
    pool = "abc ABC  \n\t'sélÉßΣσς́漢😀12½.,!?\x1c "
    return ["".join(pick.choice(pool) for _ in range(pick.randint(1, 60))) for _ in range(n)]


TEXTS = [t or "" for t in ODD] + mixed(600)


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_equal_the_library(path):
    want = [e.ids for e in LIBRARY[path].encode_batch(TEXTS, add_special_tokens=False)]
    assert [np.frombuffer(coder(path).encode(t), "<u4").tolist() for t in TEXTS] == want
    assert [counter(path).count(t) for t in TEXTS] == [len(ids) for ids in want]


def test_merging_in_batches_equals_the_library():
    want = [e.ids for e in LIBRARY[WORDS].encode_batch(TEXTS, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in batch_coder(WORDS).encode(TEXTS)] == want


def test_every_prefix_count_equals_the_library():
    for text in ["hello", "don't", "we'll", "!'s", "naïve", "unbelievable...", "a1b2", "''s", "'re"]:
        chunk = tokenizer(WORDS).normal(text)
        want = [len(LIBRARY[WORDS].encode(chunk[:i], add_special_tokens=False).ids) for i in range(len(chunk) + 1)]
        assert counter(WORDS).prefixes(text) == want, text


def test_budget_is_the_longest_prefix():
    text = "some words don't fit into unbelievable budgets, do they?"
    total = counter(WORDS).count(text)
    words = text.split()
    for budget in range(total + 2):
        chunks, letters, tokens = counter(WORDS).within(text, budget)
        prefix = " ".join([*words[:chunks], words[chunks][:letters] if chunks < len(words) else ""])
        assert tokens == len(LIBRARY[WORDS].encode(prefix, add_special_tokens=False).ids) <= budget
        longer = [" ".join(words)[:n] for n in range(len(prefix.rstrip()) + 1, len(text) + 1)]
        over = [p for p in longer if len(LIBRARY[WORDS].encode(p, add_special_tokens=False).ids) <= budget]
        assert all(p.strip() == prefix.strip() for p in over)


def test_counts_of_odd_rows(odd, none):
    got = {(r.doc_id, r.n_bytes): r for r in count_tokens(odd, WORDS, budget=100).collect()}
    assert count_tokens(odd, WORDS).count() == odd.count() and count_tokens(none, WORDS).count() == 0
    for i, t in enumerate(ODD):
        row = got[i, len((t or "").encode())]
        assert row.n_tokens == len(LIBRARY[WORDS].encode(t or "", add_special_tokens=False).ids)
        assert row.over_limit == (row.n_tokens > 100) and row.budget_tokens <= 100


def test_digests_and_round_trip(odd, none):
    rows = encoding_digests(odd, BYTES).collect()
    assert len(rows) == odd.count() and encoding_digests(none, BYTES).count() == 0
    texts = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect()}
    assert {(r.doc_id, r.decoded_sha256) for r in rows} == texts
    for r in rows:
        if r.doc_id == 5:
            ids = LIBRARY[BYTES].encode(ODD[5], add_special_tokens=False).ids
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)
    back = decode_ids(encode_texts(odd, BYTES), BYTES)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())


def check_packing(rows, docs, size):
    ids = {}
    for doc, text in docs:
        ids[doc] = np.array([*LIBRARY[WORDS].encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc]) and r.length > 0
            at += r.length
        assert at == len(ids[doc])
    sizes = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert all(n == size or n & (n - 1) == 0 for n in sizes) and sorted(sequences) == list(range(len(sequences)))
    return sequences, sizes


def test_packing_of_mixed_sources(spark):
    texts = [(i, t, "big" if i % 3 else f"s{i % 7}") for i, t in enumerate(mixed(300, 5) + ["", None])]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(5)
    rows = pack(docs, WORDS, size=64).collect()
    sequences, sizes = check_packing(rows, [(i, t) for i, t, _ in texts], 64)
    total = sum(r.length for r in rows)
    share = {}
    for r in rows:
        share[r.queue] = share.get(r.queue, 0) + r.length / total
    for number in range(total // 64):
        own = {q: sum(r.length for r in sequences[number] if r.queue == q) for q in share}
        assert all(abs(own[q] - 64 * s) < len(share) for q, s in share.items())


@pytest.mark.parametrize("sources", [60, 256])
def test_every_source_has_its_share_of_every_window(spark, sources):
    texts = [(i, t, f"source {i % sources}" if i % sources else None) for i, t in enumerate(mixed(3 * sources, 7))]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(3)
    rows = pack(docs, WORDS, size=2048).collect()
    sequences, _ = check_packing(rows, [(i, t) for i, t, _ in texts], 2048)
    source = {i: s for i, _, s in texts}
    assert len({(source[r.doc_id], r.queue) for r in rows}) == sources == len({r.queue for r in rows})
    total, share = sum(r.length for r in rows), Counter()
    for r in rows:
        share[source[r.doc_id]] += r.length
    for number in range(total // 2048):
        own = Counter()
        for r in sequences[number]:
            own[source[r.doc_id]] += r.length
        assert all(abs(own[s] - 2048 * n / total) <= 2 for s, n in share.items())


def test_packing_of_odd_rows(spark, odd, none):
    assert pack(none, WORDS).count() == 0
    rows = pack(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), WORDS, size=128, with_ids=True).collect()
    check_packing(rows, list(enumerate(ODD)), 128)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_packing_of_repeated_and_null_ids(spark, odd):
    """Every row's ids once, also of rows that share an id: counts by id and checksums of pieces, and gapless sequences."""
    rows = pack(odd, WORDS, size=256, with_ids=True).collect()
    want, got = Counter(), Counter()
    for r in odd.collect():
        want[r.doc_id] += len(LIBRARY[WORDS].encode(r.text or "", add_special_tokens=False).ids) + 1
    ends, sequences = Counter(), {}
    for r in rows:
        got[r.doc_id] += r.length
        ends[r.doc_id] += r.start + r.length == r.doc_tokens
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert got == want and ends == Counter(r.doc_id for r in odd.collect())
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_mixture_serves_ranks_in_order():
    mixture = Mixture({1: 7, 2: 100, 3: 1, 9: 41}, 10)
    before = [0, 0, 0, 0]
    for rank in range(150):
        now = mixture.taken(rank)
        assert sum(now) == min(rank, 149) and all(a <= b <= a + 1 for a, b in zip(before, now))
        before = now
