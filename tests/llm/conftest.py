from __future__ import annotations

import pytest

# Texts with the odd cases that every text operator must take.
ODD = [
    None, "", "   \n\t ", "a", "one two three", "don't we'll I'M 'S ''s !'s 'l 'r", "<|endoftext|> a<|endoftext|>b<|startoftext|>",
    "ΑΣ ΣΑΣ Σ İ", "naïve café Å ﬁ Ⅷ ²", "a" * 3000, "ab" * 2000 + " x", "日本語テキスト 漢字", "😀👩‍👩‍👧 🇩🇪", "\x1c\x1d a\x1eb",
    "\t\n \r\n  x\n\n y  \n", "</w> a</w>b Ġ", "Ᲊ x՘ ㆀ", "x y  z   w\n\n\nq ", " \nfoo \n bar\n baz", "1.2.3.4 a@b.co +1 (988) 555-2485, and 4111111111111111",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with repeated rows, a null id and columns whose names clash with results."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "one two three"), (19, ODD[19])]
    rows = [(i, t, "en" if t else None, "src", 1, "x", 2.0) for i, t in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, score double"
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def by_row(df, *columns):
    """Rows as sorted tuples of text."""
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
