from __future__ import annotations

import zlib

import numpy as np
import pytest

from curvewalk.llm.sharding import assign_shards, jump_hash


def jump(key: int, shards: int) -> int:
    at, following, key = 0, 0, key & (1 << 64) - 1
    while following < shards:
        at, key = following, (key * 2862933555777941757 + 1) & (1 << 64) - 1
        following = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def test_jump_hash_and_growth():
    keys = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    for shards in (1, 2, 7, 40, 1000):
        assert jump_hash(keys, shards).tolist() == [jump(int(k), shards) for k in keys]
    now, grown = jump_hash(keys, 40), jump_hash(keys, 41)
    moved = now != grown
    assert (grown[moved] == 40).all() and 0 < moved.mean() < 3 / 41
    with pytest.raises(ValueError):
        jump_hash(keys, 0)


@pytest.mark.parametrize("cell_rows", [1, 20_000])
def test_shards_of_odd_rows(odd, none, cell_rows):
    rows = assign_shards(odd, 4, cell_rows=cell_rows).collect()
    assert assign_shards(none, 4).count() == 0 and len(rows) == odd.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1


def test_one_id_may_hold_all_rows(spark):
    docs = spark.range(500).selectExpr("7L as doc_id", "concat('t', id) as text")
    rows = assign_shards(docs, 8, cell_rows=10).collect()
    assert sorted(r.slot for r in rows) == list(range(500)) and len({r.shard for r in rows}) == 1
