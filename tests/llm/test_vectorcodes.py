from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from curvewalk.llm.queries import ORACLES, QUERIES
from curvewalk.llm.vectorcodes import encode_vectors, grow, nearest

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def plain(rows, parts, entries, rounds):
    """(vec_id, label, codes, error, label_error) by comparing every part with every entry."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in rows), default=0) // parts) * parts
    whole = [[math.floor(256 * float(np.float32(x))) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    step = width // parts
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], e)), n) for n, e in enumerate(books[p])) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        sums = defaultdict(list)
        for x, near in zip(cut, assign()):
            for p in range(parts):
                sums[p, near[p][1]].append(x[p])
        for (p, e), members in sums.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for r, e in zip(rows, errors):
        by_label[r[2]] += e
    return [(r[0], r[2], [n for _, n in f], e, by_label[r[2]]) for r, f, e in zip(rows, found, errors)]


def listed(rows):
    return sorted(str(tuple(r)) for r in rows)


def random_rows(pick, n, length):
    rows = [(i, [round(pick.uniform(-1, 1), pick.choice([1, 2, 6])) for _ in range(length)], pick.choice([None, 0, 1])) for i in range(n)]
    return rows + rows[: n // 10]  # repeated rows


@pytest.mark.parametrize(("length", "parts", "entries", "rounds"), [(12, 4, 64, 2), (10, 4, 7, 3), (3, 16, 64, 2), (8, 1, 256, 1)])
def test_codes_equal_plain_assignment(spark, length, parts, entries, rounds):
    rows = random_rows(random.Random(length), 150, length)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    coded, _ = encode_vectors(docs, parts, entries, rounds)
    assert listed(coded.collect()) == listed(plain(rows, parts, entries, rounds))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 2.0, 3.0, 4.0], 1), (None, [1.0, 2.0, 3.0, 4.5], None), (5, [1.0, 2.0, 3.0, 4.0], 1), (1, None, 1), (2, [1.0, None, 1.0, 1.0], 1),
        (3, [nan, 0.0, 0.0, 0.0], 0), (4, [inf, 0.0, 0.0, 0.0], 0), (6, [], 2), (7, [-0.001, 0.0], 2), (8, [9.0] * 4, None),
    ]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    coded, _ = encode_vectors(docs, 2, 3, 2)
    assert listed(coded.collect()) == listed(plain(rows, 2, 3, 2)) and coded.count() == 6
    assert encode_vectors(docs.limit(0))[0].count() == 0
    assert encode_vectors(docs.where("vec_id = 6"), 2)[0].collect()[0][2:] == ([0, 0], 0, 0)


def test_numbers_too_large_raise(spark):
    docs = spark.createDataFrame([(1, [1e30] * 4, 1, "x", "y")], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        encode_vectors(docs, 2, 3, 1)[0].count()


@pytest.mark.parametrize(("n", "width", "spread"), [(64, 4, 200), (256, 4, 20_000), (200, 2, 5), (64, 3, 1), (9, 4, 50), (1, 4, 9)])
def test_tree_finds_the_nearest_entry_with_ties_to_the_lower_number(n, width, spread):
    pick = np.random.default_rng(n + spread)
    entries, queries = pick.integers(-spread, spread + 1, (n, width)), pick.integers(-spread, spread + 1, (500, width))
    entries[n // 2 :: 7] = entries[0]  # equal entries
    queries[:50] = entries[pick.integers(0, n, 50)]
    d2 = ((queries[:, None] - entries[None]) ** 2).sum(-1)
    number, best, taken = nearest(entries, grow(entries, np.arange(n)), queries)
    assert (number == d2.argmin(axis=1)).all() and (best == d2.min(axis=1)).all() and taken <= d2.size


def test_whole_subtrees_are_ruled_out():
    pick = np.random.default_rng(1)
    centres = pick.integers(-10_000, 10_000, (8, 4))
    entries = (centres[:, None] + pick.integers(-50, 50, (8, 32, 4))).reshape(-1, 4)
    queries = entries[pick.integers(0, 256, 1000)] + pick.integers(-20, 20, (1000, 4))
    _, _, taken = nearest(entries, grow(entries, np.arange(256)), queries)
    assert taken < 0.3 * 256 * 1000


def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = con.execute(ORACLES["op12_vector_codes"]).fetchdf()[names].sort_values("vec_id").values.tolist()
    assert QUERIES["op12_vector_codes"](spark, SF).toPandas()[names].sort_values("vec_id").values.tolist() == want
