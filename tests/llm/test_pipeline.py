from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from curvewalk.llm.registered import ORACLES, QUERIES

from .test_personal import plain as plain_spans
from .test_quality import plain as plain_counts
from .test_simhash import plain as plain_print, smallest_reachable
from .test_substrings import plain as plain_removal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return [df.toPandas() for df in out]


def test_columns_and_lengths(stages):
    for before in stages[:-1]:
        assert list(before.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
        assert (before.text.str.len() == before.n_chars).all() and before.doc_id.is_unique


def test_quality_keeps_what_passes_the_base_rules(stages):
    raw, kept = stages[0], set(stages[1].doc_id)
    for r in raw.itertuples():
        n_words, _, _, _, repeated = plain_counts(r.text)
        if n_words < 20 or 100 * repeated > 30 * n_words:
            assert r.doc_id not in kept
    assert len(kept) > 0.7 * len(raw)


def test_one_document_of_each_near_duplicate_group_stays(stages):
    prints = [(r.doc_id, plain_print(r.text)) for r in stages[1].itertuples()]
    groups = smallest_reachable(prints, 4)
    assert set(stages[2].doc_id) == set(groups.values())


def test_exactly_one_row_of_a_group_stays(spark):
    base = [f"w{i}" for i in range(400)]
    near = " ".join([*base[:399], "other"])
    rows = [(7, " ".join(base), "a"), (7, " ".join(base), "b"), (7, near, "c"), (9, " ".join(base), "d"), (None, near, "e")]
    rows += [(None, "only here " * 30, "f")] * 3 + [(None, None, "g"), (2, "", "h"), (3, "quite another text", "i")]
    docs = spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in rows], "doc_id long, text string, source string, gone int, doc int, body int")
    assert (plain_print(rows[0][1]) ^ plain_print(near)).bit_count() <= 4
    kept = pipeline.near_duplicate_removal(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    first = min([" ".join(base), near], key=lambda t: spark.sql("select xxhash64(?)", args=[t]).first()[0])
    assert got == sorted([(7, first), (None, "only here " * 30), (2, ""), (3, "quite another text")], key=str)


def test_passages_are_cut_once(stages):
    before, after = stages[2], stages[3].set_index("doc_id").text
    want = plain_removal(list(zip(before.doc_id, before.text)))
    for r in before.itertuples():
        size, removed, _, _ = want[r.doc_id, r.text]
        left = len(after[r.doc_id].encode())
        assert left == len(r.text.encode()) if not removed else size - removed <= left <= size - removed + 8 * 3


def test_personal_data_is_gone(stages):
    before, after = stages[3].set_index("doc_id").text, stages[4].set_index("doc_id").text
    for doc, text in before.items():
        found = sum(plain_spans(text)[0])
        assert (after[doc] == text) == (found == 0)
        assert sum(plain_spans(after[doc])[0]) == 0


def test_every_token_is_packed(stages):
    from .test_tokens import check_packing

    check_packing(list(stages[5].itertuples()), list(zip(stages[4].doc_id, stages[4].text)), 2048)


def test_run_packs_what_its_stages_keep(spark, stages):
    from .test_tokens import check_packing

    got = pipeline.run(spark, SF).toPandas()
    assert list(got.columns) == list(stages[5].columns)
    check_packing(list(got.itertuples()), list(zip(stages[4].doc_id, stages[4].text)), 2048)
    queues = lambda df: set(zip(df.doc_id, df["queue"], df.doc_tokens))
    assert queues(got) == queues(stages[5]) and got.length.sum() == stages[5].length.sum()


def test_stages_take_odd_and_empty_tables(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns and out.count() <= table.count()
        assert (pipeline.STAGES[-1][1](spark, table, SF).agg(F.sum("length")).first()[0] or 0) >= table.count()


def test_one_query_for_each_operator():
    for number in range(1, 14):
        assert sum(name.startswith(f"op{number}_") for name in QUERIES) == 1
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)


def test_topk_against_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    names = ["query_id", "rank", "vec_id", "score"]
    want = con.execute(ORACLES["op3_topk"]).fetchdf()[names].astype("int64")
    got = QUERIES["op3_topk"](spark, SF).toPandas()[names].astype("int64")
    assert want.sort_values(names).values.tolist() == got.sort_values(names).values.tolist()
