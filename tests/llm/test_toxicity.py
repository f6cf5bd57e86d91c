from __future__ import annotations

import math
import random
import zlib

from curvewalk.llm.queries import QUERIES
from curvewalk.llm.toxicity import Lexicon, fit, fold, learn, score_toxicity


def test_folding():
    assert fold("Ｔhe 1d10t, ѕtupіd m0r0n! $cum") == fold("the idiot stupid moron scum")
    assert fold("4111 1111 +1 (988) 555-2485") == " 4111 1111 1 988 555 2485 "
    assert fold("") == fold(" \n!") == "  " and fold("wow!! café") == " wow café "
    assert fold("st​upid") == fold("stupid")


def test_exceptions_cancel_hits():
    lexicon = Lexicon({fold("trash"): 5.0, " " + fold("moron").strip(): 4.0}, [fold("trash can")], [0.0, 1.0, 1.0])
    assert lexicon.hits(fold("a trash can")) == (0.0, 0) and lexicon.hits(fold("what trash, trash!"))[1] == 2
    assert lexicon.hits(fold("morons"))[1] == 1 and lexicon.hits(fold("oxymoron"))[1] == 0


def test_learned_lexicon_ignores_copies_and_labels_of_one_kind():
    names = [f"w{i}x" for i in range(200)]
    clean = [" ".join(names[(i * 7 + j * 3) % 200] for j in range(40)) for i in range(300)]
    toxic = [c + f" grumpo {names[i]}" for i, c in enumerate(clean[:60])] + ["unrelated frobnicator here and there"] * 30
    lexicon = learn(clean + toxic, [0] * 300 + [1] * 90)
    assert any("grump" in t for t in lexicon.weights) and not any("frob" in t for t in lexicon.weights)
    assert lexicon.score(clean[0] + " a grumpo")[0] > lexicon.score(clean[0])[0]
    for texts, y in (([], []), (["a b"], [0]), (["a b"], [1])):
        assert 0.0 <= learn(texts, y).score("anything")[0] <= 1.0


def test_odd_rows(odd, none):
    lexicon = Lexicon({fold("one"): 5.0}, [], [-3.0, 1.0, 1.0])
    rows = score_toxicity(odd, lexicon).collect()
    assert score_toxicity(none, lexicon).count() == 0 and len(rows) == odd.count()
    for r in rows:
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1


def test_held_out_rows_of_the_driver(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.toxic == 1 and r.predicted for r in scored)
    assert hit / sum(r.predicted for r in scored) > 0.97 and hit / sum(r.toxic == 1 for r in scored) > 0.88


def test_labels_with_gaps(spark, odd):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (2, None), (3, 7)], "doc_id long, toxic int")
    assert score_toxicity(odd, fit(odd, labels)).count() == odd.count()
    assert score_toxicity(odd, fit(odd, labels.limit(0))).count() == odd.count()


def plain_hits(lexicon, text):
    """Weights of words hit, by trying every term and every exception at every place."""
    folded, best = fold(text), {}
    for at in range(len(folded)):
        mine = [w for t, w in lexicon.weights.items() if folded.startswith(t, at)]
        if mine:
            best[at] = max(mine)
    for phrase in lexicon.exceptions:
        for at in range(len(folded)):
            if folded.startswith(phrase, at):
                best = {s: w for s, w in best.items() if not at <= s < at + len(phrase) - 1}
    return best


def plain_score(lexicon, text):
    best = plain_hits(lexicon, text)
    words, total = len(fold(text).split()), sum(best.values())
    z = lexicon.curve[0] + lexicon.curve[1] * math.log1p(total) + lexicon.curve[2] * math.log1p(100 * total / (words + 20))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), len(best)


def test_matches_equal_trying_every_term_everywhere():
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("ab") for _ in range(pick.randint(1, 6)))
    for _ in range(60):
        terms = {f" {word()}{pick.choice(['', ' '])}": pick.uniform(1, 5) for _ in range(12)}
        lexicon = Lexicon(terms, [f" {word()} {word()} " for _ in range(6)], [-1.0, 0.5, 0.2])
        for _ in range(10):
            text = " ".join(word() for _ in range(pick.randint(0, 40)))
            best = plain_hits(lexicon, text)
            total, hits = lexicon.hits(fold(text))
            assert hits == len(best) and math.isclose(total, sum(best.values()), abs_tol=1e-9)


def test_whole_query_equals_plain_scores_and_weights(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in QUERIES["op1_toxicity"](spark, folder).collect():
        score, hits = plain_score(lexicon, texts[r.doc_id])
        assert math.isclose(r.score, score, abs_tol=1e-9) and r.hits == hits and r.predicted == int(score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    # Every weight is the log odds of its term among the rows that aren't held out.
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    rows = [(fold(texts[i]), y) for i, y in known.items() if i in texts]
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    assert len(lexicon.weights) > 3
    for term, weight in lexicon.weights.items():
        inside = [sum(term in t for t, y in rows if y == k) for k in (0, 1)]
        contexts = set()
        for t, y in rows:
            words = t.split()
            if y:
                contexts |= {(a, b) for a, w, b in zip(["", *words], words, [*words[1:], ""]) if f" {w} ".startswith(term)}
        want = math.log((min(len(contexts), inside[1]) + 0.5) / n[1]) - math.log((inside[0] + 0.5) / n[0])
        assert math.isclose(weight, want, abs_tol=1e-9), term


def test_repeated_ids_give_one_text_each(spark):
    pick = random.Random(2)
    rows = [(i, " ".join(pick.choice("abcdefgh") * 4 for _ in range(12)) + (" grumpo" if i % 2 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    once, often = fit(docs, labels), fit(docs.unionByName(docs).unionByName(docs), labels)
    assert (once.weights, once.exceptions, once.curve) == (often.weights, often.exceptions, often.curve)
