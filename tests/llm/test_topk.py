from __future__ import annotations

import numpy as np
import pytest

import curvewalk.llm.topk as topk
from curvewalk.llm.topk import top_k


def plain(rows, k=5, every=50, scale=256.0):
    usable = [
        (i, [int(np.floor(scale * float(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q, (qid, qv) in enumerate(usable):
        if qid % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for c, (i, v) in enumerate(usable) if c != q)
            out += [(qid, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("candidates, queries", [(8192, 2048), (16, 3)])
def test_search_equals_brute_force(spark, monkeypatch, candidates, queries):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "QUERIES", queries)
    random = np.random.default_rng(1)
    rows = [(i, np.where(random.random(6) < 0.3, 0, random.normal(size=6)).round(2).tolist()) for i in range(230)]
    rows += [(300 + i, rows[50][1]) for i in range(20)]  # ties
    rows += [(50, rows[50][1]), (0, [0.0] * 6), (700, None), (701, [1.0, None]), (702, [float("nan")]), (703, [float("inf")])]
    rows += [(None, [1.0]), (800, []), (801, [1.0, 2.0]), (850, [-1.5] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in top_k(df).collect())
    assert got == plain(rows)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [3.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k(df).collect()) == plain([(0, [1.0]), (1, [2.0]), (50, [3.0])])
    assert top_k(df.limit(0)).count() == 0 and top_k(df.limit(1)).count() == 0


def test_scores_that_do_not_fit_raise(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)overflow|fit"):
        top_k(df).collect()


def test_the_least_number_is_seen_as_too_large():
    import numpy as np

    from curvewalk.llm.topk import Block, best_in_block

    least = np.array([np.iinfo(np.int64).min, 3]).tobytes()
    one, two = np.array([1]).tobytes(), np.array([2]).tobytes()
    with pytest.raises(OverflowError):
        best_in_block(Block(one, one, two, least), Block(two, two, two, least), 1)


def test_copies_of_blocks_never_pass_the_driver(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(100)], "vec_id long, embedding array<float>")
    plan = top_k(df)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


@pytest.mark.parametrize("strip, at_once, k", [(8192, 16, 5), (7, 3, 5), (3, 2, 4)])
@pytest.mark.parametrize("largest", [3, 1 << 20])
def test_strips_of_a_block_are_merged(monkeypatch, strip, at_once, k, largest):
    monkeypatch.setattr(topk, "STRIP", strip)
    monkeypatch.setattr(topk, "AT_ONCE", at_once)
    random = np.random.default_rng(2)
    vectors = [random.integers(-largest, largest + 1, n) for n in random.integers(0, 9, 50)]
    vectors = [np.where(np.arange(len(v)) < 3, v, v * (random.random(len(v)) < 0.2)) for v in vectors]  # common and rare terms
    ids, uids = np.arange(50) // 2, random.permutation(50)

    def block(rows):
        weights = np.concatenate([vectors[r] for r in rows])
        lengths = np.array([len(vectors[r]) for r in rows])
        return topk.Block(uids[rows].tobytes(), ids[rows].tobytes(), topk._packed(lengths), topk._packed(weights))

    asked = np.arange(0, 50, 3)
    query, candidate, score = topk.best_in_block(block(asked), block(np.arange(50)), k)
    got = sorted(zip(asked[query].tolist(), candidate.tolist(), score.tolist()))
    want = []
    for q in asked.tolist():
        scores = [(-int(sum(int(a) * int(b) for a, b in zip(vectors[q], vectors[c]))), c) for c in range(50) if c != q]
        want += [(q, c, -s) for s, c in sorted(scores)[:k]]
    assert got == sorted(want)


@pytest.mark.parametrize("values", [[], [0], [-128, 127], [128], [-129], [40000], [-(1 << 31)], [1 << 31], [-(1 << 63), (1 << 63) - 1]])
def test_integers_are_packed_as_they_are(values):
    values = np.array(values, dtype=np.int64)
    assert topk._unpacked(topk._packed(values), len(values)).tolist() == values.tolist()


def test_large_components(spark):
    rows = [(i, [1e4 * (i % 11) - 3e4, 1e3 * i, -2e5]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_k(df).collect()) == plain(rows)
