from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

import curvewalk.llm.substrings as substrings
from curvewalk.llm.substrings import remove_repeats
from curvewalk.llm.suffixes import common_prefixes, repeated_windows, suffix_array


def plain(rows, width=50):
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        for p in range(len(raw) - width + 1):
            first.setdefault(raw[p : p + width], doc)
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - width + 1):
            if first[raw[p : p + width]] < doc:
                gone[p : p + width] = True
        spans = int((gone & ~np.roll(gone, 1)).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc, text] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(n=150, seed=2):
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcdeé漢 ") for _ in range(7)) for _ in range(300)]
    shared = [" ".join(pick.choice(words) for _ in range(pick.randint(6, 30))) for _ in range(8)]
    texts = []
    for i in range(n):
        parts = [" ".join(pick.choice(words) for _ in range(pick.randint(0, 40))) for _ in range(3)]
        if i % 2:
            parts.insert(1, pick.choice(shared))
        texts.append(" ".join(parts))
    return [*texts, texts[0], texts[1][5:], shared[0], shared[0] * 3, "z" * 400, "z" * 2500, "", "z" * 49, "z" * 50]


def test_suffix_arrays_and_common_prefixes():
    pick = random.Random(1)
    for text in [b"", b"a", b"banana", b"aaaaaaaaaaaaaaaaaaaa", bytes(pick.choice(b"ab") for _ in range(500)), bytes(range(256))]:
        data = np.frombuffer(text, np.uint8)
        order, rank = suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        if len(text):
            got = common_prefixes(data, order, rank, np.arange(0, len(text), 7), 10)
            for i in range(1, len(text)):
                a, b = text[order[i - 1] :], text[order[i] :]
                n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert got[i] == min(n, 10)


def test_repeated_windows():
    texts = [b"hello world", b"say hello world", b"world hello", b"wor"]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    least = repeated_windows(np.frombuffer(b"".join(texts), np.uint8), starts, np.array([5, 3, 9, 1]), 5)
    assert least[0] == 3 and least[starts[2]] == 3 and least[starts[3]] == np.iinfo(np.int64).max


@pytest.mark.parametrize("common, block", [(5000, 1 << 22), (2, 4000)])
def test_removal_equals_brute_force(spark, monkeypatch, common, block):
    monkeypatch.setattr(substrings, "COMMON", common)
    monkeypatch.setattr(substrings, "BLOCK", block)
    monkeypatch.setattr(substrings, "RANGE", 2 * block)
    monkeypatch.setattr(substrings, "RUN", 64)
    monkeypatch.setattr(substrings, "SLICE", 5000)
    rows = list(enumerate(passages()))
    random.Random(0).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    text = dict(rows)
    got = remove_repeats(docs, with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id, text[r.doc_id]]
        if hashlib.sha256(r.kept_text.encode()).hexdigest() != r.kept_sha256:  # a letter was cut in two
            assert len(r.kept_text.encode()) > r.n_bytes - r.n_removed


def test_odd_rows(spark, odd, none):
    assert remove_repeats(none).count() == 0
    got = remove_repeats(odd).collect()
    assert len(got) == odd.count()
    rows = [(1 << 62 if r.doc_id is None else r.doc_id, r.text) for r in odd.collect()]
    want = {(d, v) for (d, _), v in plain(rows).items()}
    assert {(1 << 62 if r.doc_id is None else r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got} == want
    twins = spark.createDataFrame([(1, "q" * 80), (1, "q" * 80), (2, "q" * 80), (None, "q" * 80)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in remove_repeats(twins).collect()) == [("1", 0), ("1", 0), ("2", 80), ("None", 80)]
    with pytest.raises(ValueError):
        remove_repeats(odd, width=10)
