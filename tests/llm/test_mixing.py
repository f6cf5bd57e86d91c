from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvewalk.llm.mixing import hypergeometric, mix_sources, split_quotas
from curvewalk.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size long, target string, body int"


def plain_targets(sizes, weights=(5, 2, 1), share=1.0, most=3):
    """Targets by sharing again what limits leave over, source by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if most * sizes[s] <= left * weight[s] / whole]
        if not over:
            return target | {s: left * weight[s] / whole for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            open_.remove(s)
        left -= sum(target[s] for s in over)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(mixed, rows, **options):
    got = mixed.documents.collect()
    assert sorted(str((r.doc_id, r.size, r.source)) for r in got) == sorted(str((i, words(t), s)) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want, taken = plain_targets(sizes, **options), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= options.get("most", 3) * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    return got, sizes, taken


def corpus(pick, n=300):
    rows = []
    for i in range(n):
        source = pick.choice(["web"] * 6 + ["books", "Ω", "", None, "a", "z"])
        rows.append((i, " ".join("w" for _ in range(pick.choice([0, 1, 5, 40, 900]))), source))
    return rows + rows[:20] + [(None, "x y", "web"), (7, None, "only empty"), (None, "  ", None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize(("block_words", "shards"), [(256, 16), (3, 5), (10_000, 1)])
def test_targets_and_words_taken(spark, block_words, shards):
    rows = corpus(random.Random(block_words))
    mixed = mix_sources(frame(spark, rows), block_words=block_words, shards=shards)
    _, sizes, taken = check(mixed, rows)
    # The pieces are those words: inside their texts, each word of a source as often as its rounds say, none oftener.
    pieces = mixed.pieces.toPandas()
    assert pieces.words.sum() == sum(taken.values()) and (pieces.shard < shards).all() and (pieces["first"] >= 0).all()
    spans = defaultdict(Counter)
    for p in pieces.itertuples():
        spans[p.source, p.doc_id, p.body, p.copy].update((p.round, w) for w in range(p.first, p.first + p.words))
    assert all(n == 1 for c in spans.values() for n in c.values())
    for s in sizes:
        key = (lambda x: x is None or x != x) if s is None else (lambda x, s=s: x == s)
        per = Counter(w for k, c in spans.items() if key(k[0]) for w in ((k, x) for _, x in c))
        if sizes[s]:
            whole = taken[s] // sizes[s]
            assert set(per.values()) <= {whole, whole + 1}


def test_limits_and_shares(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1000, "b"), (10, "a"), (30, "c"), (5, None), (400, "d")])]
    for options in ({}, {"share": 0.5}, {"share": 9.0}, {"weights": (1, 3), "most": 2}):
        check(mix_sources(frame(spark, rows), **options), rows, **options)


def test_reruns_and_layouts_agree(spark):
    rows = corpus(random.Random(1))
    kinds = [frame(spark, rows), frame(spark, rows[::-1]).repartition(7)]
    first, second = (sorted(map(str, mix_sources(d).documents.collect())) for d in kinds)
    assert first == second
    one, two = (sorted(map(str, mix_sources(d).pieces.collect())) for d in kinds)
    assert one == two


def test_odd_and_empty_tables(odd, none, spark):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    check(mix_sources(odd), rows)
    empty = mix_sources(none)
    assert empty.documents.count() == empty.pieces.count() == empty.quotas.count() == 0
    blank = [(1, None, "a"), (2, " ", None)]
    assert [r.taken for r in mix_sources(frame(spark, blank)).documents.collect()] == [0, 0]


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    got = QUERIES["op13_source_mixture"](spark, SF).collect()
    sizes = Counter()
    for r in docs:
        sizes[r.source] += words(r.text)
    want, taken = plain_targets(sizes), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.target == pytest.approx(want[r.source])
    assert len(got) == len(docs) and all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in want.items())


def test_draws_follow_the_hypergeometric_distribution(spark):
    u = (F.col("id") + 0.5) / 20_000
    for whole, marked, drawn in [(50, 20, 15), (9, 9, 4), (6, 2, 5), (40, 1, 20), (1000, 3, 999)]:
        columns = [F.lit(x).cast("long") for x in (whole, marked, drawn)]
        got = spark.range(20_000).select(hypergeometric(*columns, u).alias("x")).groupBy("x").count().collect()
        for r in got:
            assert r["count"] / 20_000 == pytest.approx(comb(marked, r.x) * comb(whole - marked, drawn - r.x) / comb(whole, drawn), abs=2e-4)


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_splitting_tree_keeps_quotas_and_even_shards(spark, shards):
    quotas = [500, 0, 33, 1, 2000, 7]
    rows = spark.createDataFrame(list(enumerate(quotas)), "place long, quota long")
    leaves = split_quotas(rows, shards, seed=3).toPandas()
    assert leaves.groupby("place").quota.sum().tolist() == quotas and (leaves.quota >= 0).all()
    sizes = leaves.groupby("shard").quota.sum()
    assert len(sizes) == shards and sizes.max() - sizes.min() <= 1


def test_shards_vary_as_drawn_without_replacement(spark):
    rows = spark.createDataFrame([(0, 4000), (1, 6000)], "place long, quota long")
    counts = np.array([r.quota for s in range(2) for r in split_quotas(rows, 40, seed=s).where("place = 0").collect()])
    # Hypergeometric: 250 of 10,000 with 4,000 marked.
    assert counts.mean() == pytest.approx(100) and counts.std() == pytest.approx((250 * 0.4 * 0.6 * 9750 / 9999) ** 0.5, rel=0.3)
