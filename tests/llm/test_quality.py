from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import curvewalk.llm.quality as quality
from curvewalk.llm.quality import judge_quality
from curvewalk.llm.textstats import repeated_words, statistics


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    inside = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


def test_statistics_equal_plain_counts(odd):
    pick = random.Random(4)
    texts = [r.text or "" for r in odd.collect()]
    texts += [" ".join(pick.choice("ab") for _ in range(pick.randint(0, 80))) for _ in range(100)]
    texts += ["\n".join(pick.choice(["x y", "z", "", " ", "x y"]) for _ in range(9)) for _ in range(30)]
    texts += [("one two three four five six seven eight nine\n") * n for n in range(4)]
    for text in texts:
        assert statistics(text)[:5] == plain(text)
    assert repeated_words([b"a"] * 8) == 0 and repeated_words([b"a"] * 9) == 9


def test_odd_rows(odd, none):
    rows = judge_quality(odd).collect()
    assert judge_quality(none).count() == 0 and len(rows) == odd.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.distance <= 10)


def documents(spark, n=1200):
    pick = random.Random(9)
    words = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = " ".join(pick.choice(words) for _ in range(pick.randint(30, 200))) + "."
        kind = "clean"
        if i % 40 == 0:
            text, kind = re.sub(" ", "### ", text), "symbols"
        elif i % 40 == 1:
            text, kind = text.upper().replace(" ", "!! "), "capitals"
        lang = "en" if i % 3 else "de"
        rows.append((i, text, lang, "hot" if i % 2 else f"s{i % 5}", kind))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string")


def test_outliers_go_and_clean_rows_stay(spark):
    docs = documents(spark)
    judged = {r.doc_id: r for r in judge_quality(docs).collect()}
    for r in docs.collect():
        assert judged[r.doc_id].base_failed is False
        assert judged[r.doc_id].kept == (r.kind == "clean"), (r.kind, judged[r.doc_id])
    assert all(r.distance is not None and r.judged_by[0] == "2" for r in judged.values())


@pytest.mark.parametrize("n", [60, 900])
def test_repeated_lines_and_words_are_rejected_alone(spark, n):
    """In ordinary text otherwise, in groups of any size; a few repeated lines or words are no reason."""
    pick = random.Random(n)
    words = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 9))) for _ in range(4000)]
    line = lambda k: " ".join(pick.choice(words) for _ in range(k))
    rows = []
    for i in range(n):
        lines, kind = [line(pick.randint(6, 14)) for _ in range(25)], "clean"
        if i % 20 == 0:  # 12 of 25 lines are copies, of short lines with no 8-word window
            short = [line(3) for _ in range(4)]
            lines, kind = lines[:9] + short * 4, "lines"
            pick.shuffle(lines)
        elif i % 20 == 1:  # one passage twice: over a quarter of the words, under the base rule's 30 %
            lines = [line(10) for _ in range(22)]
            passage = line(34)
            lines, kind = [*lines[:10], passage, *lines[10:16], passage], "words"
        elif i % 20 == 2:
            lines[3] = lines[7] = line(4)
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string")
    judged = {r.doc_id: r for r in judge_quality(docs).collect()}
    for i, _, _, _, kind in rows:
        assert not judged[i].base_failed and judged[i].kept == (kind == "clean"), (kind, judged[i])


def test_estimates_lie_near_the_least_determinant(spark):
    """One start, whole rings and six rings of steps against all subsets of twelve rows: how far the logarithms lie apart."""
    random_ = np.random.default_rng(3)
    gaps = []
    for seed in range(4):
        rows = random_.normal(size=(12, quality.P)) * 0.3
        rows[:3] += random_.normal(size=(3, quality.P)) * 3  # outliers
        df = spark.createDataFrame([("g", *map(float, r)) for r in rows], ["key", *quality.NAMES])
        found = quality.robust_scatter(df, 1).head()
        floors = np.diag(np.array(list(quality.FLOORS.values())) ** 2)
        least = min(np.linalg.slogdet(1.3 * np.cov(rows[list(c)].T, bias=True) + floors)[1] for c in combinations(range(12), 9))
        gaps.append(np.linalg.slogdet(np.array(found.scatter).reshape(quality.P, quality.P))[1] - least)
    assert all(-1e-9 <= g for g in gaps) and np.median(gaps) < 1.5, gaps


def test_small_groups_lean_on_those_above_them(spark):
    names = ["key", "n", "mean", "scatter", "inverse"]
    eye = np.eye(quality.P)

    def row(key, n, level, spread):
        return (key, n, [level] * quality.P, (eye * spread).ravel().tolist(), eye.ravel().tolist())

    found = spark.createDataFrame([row("0", 10**9, 0.0, 1.0), row("1x", 10**9, 1.0, 1.0), row("2x\0big", 10**9, 5.0, 2.0), row("2x\0few", 200, 5.0, 2.0)], names)
    got = {r.key: r for r in quality.shrunk(found).collect()}
    assert set(got) == {"2x\0big", "2x\0few"}
    assert np.allclose(got["2x\0big"].mean, 5.0, atol=1e-5) and np.allclose(got["2x\0few"].mean, 3.0)
    assert np.allclose(np.linalg.inv(np.array(got["2x\0few"].inverse).reshape(quality.P, -1)), 1.5 * eye + 0.25 * 16)


def test_the_same_verdicts_with_any_layout(spark):
    docs = documents(spark, 600)
    a = sorted((r.doc_id, r.kept) for r in judge_quality(docs).collect())
    b = sorted((r.doc_id, r.kept) for r in judge_quality(docs.repartition(7)).collect())
    assert a == b
