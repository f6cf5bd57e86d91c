from __future__ import annotations

import random

import xxhash

import curvewalk.llm.simhash as simhash
from curvewalk.llm.components import components
from curvewalk.llm.simhash import fingerprint, links, near_duplicates, segments


def plain(text: str) -> int:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(prints: list[tuple[int, int]], distance: int) -> dict[int, int]:
    top = {d: d for d, _ in prints}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for a, p in prints:
        for b, q in prints:
            if a < b and (p ^ q).bit_count() <= distance:
                a_root, b_root = sorted((root(a), root(b)))
                top[b_root] = a_root
    return {d: root(d) for d, _ in prints}


def test_fingerprints(odd):
    for r in odd.collect():
        assert fingerprint(r.text or "") == plain(r.text or "")
    assert fingerprint("ÀB Ab aB ab c") == plain("ÀB Ab aB ab c")


def test_segments_leave_one_bit():
    for distance in range(8):
        assert sum(w for _, w in segments(distance)) == 64 and len(segments(distance)) * 2 > distance


def test_links_and_components_of_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)  # groups of the test are split into tiles
    pick = random.Random(3)
    centre = pick.getrandbits(64)
    prints = {centre}
    for _ in range(120):
        p = pick.choice([*prints])
        for _ in range(pick.randint(1, 5)):
            p ^= 1 << pick.randrange(64)
        prints.add(p)
    prints |= {pick.getrandbits(64) for _ in range(100)}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    nodes = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, doc long")
    found = components(links(nodes.select("fp"), 4), nodes.selectExpr("fp as node", "doc as class_id")).collect()
    want = smallest_reachable(list(enumerate(p & (1 << 64) - 1 for p in signed)), 4)
    assert {r.class_id: r.component_id for r in found} == want
    assert links(nodes.select("fp"), 4).count() < 64 * len(signed)


def test_a_group_of_near_copies_grows_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 64)
    sent = []
    compared = simhash._compared
    monkeypatch.setattr(simhash, "_compared", lambda dealt, distance: (sent.append(dealt.count()), compared(dealt, distance))[1])

    def rows_sent(n):
        pick = random.Random(n)
        centre = pick.getrandbits(62)
        prints = {centre ^ 1 << a ^ 1 << b for a in range(62) for b in range(a)}
        nodes = spark.createDataFrame([(p,) for p in sorted(pick.sample(sorted(prints), n))], "fp long")
        sent.clear()
        found = components(links(nodes, 4), nodes.selectExpr("fp as node", "fp as class_id"))
        assert found.select("component_id").distinct().count() == 1
        return sum(sent)

    assert rows_sent(1600) < 5 * rows_sent(400)


def test_a_long_chain_is_one_component(spark):
    edges = spark.range(200).selectExpr("id * 7919 % 211 as a", "(id + 1) * 7919 % 211 as b")
    nodes = spark.range(211).selectExpr("id as node", "id + 1000 as class_id")
    got = {r.node: r.component_id for r in components(edges, nodes).collect()}
    chain = {i * 7919 % 211 for i in range(201)}
    assert all(got[n] == 1000 + (min(chain) if n in chain else n) for n in range(211))


def test_near_duplicates_of_odd_rows(odd, none):
    rows = near_duplicates(odd).collect()
    assert near_duplicates(none).count() == 0 and len(rows) == odd.count()
    prints = [(r.doc_id, fingerprint(r.text or "")) for r in odd.collect() if r.doc_id is not None]
    want = smallest_reachable(list(dict(prints).items()), 4)
    for r in rows:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and int(r.fingerprint, 16) == dict(prints)[r.doc_id]
        else:
            assert r.component_id == 4


def test_documents_of_the_driver(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    want = smallest_reachable(prints, 4)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == want
