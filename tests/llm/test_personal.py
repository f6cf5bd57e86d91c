from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from curvewalk.llm.personal import mask_text, personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        twice = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    spans = {
        kind: [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if passes(kind, m.group())]
        for kind, p in PATTERNS.items()
    }
    return [len(s) for s in spans.values()], ",".join(x for s in spans.values() for x in s)


def hold(rows, texts):
    for r in rows:
        counts, base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)


def test_spans_equal_plain_patterns(spark):
    pick = random.Random(6)
    texts = ["".join(pick.choice("a1.@+- ()%b5") for _ in range(pick.randint(1, 60))) for _ in range(400)]
    texts += ["".join(pick.choice("0123456789 -.+") for _ in range(pick.randint(10, 90))) for _ in range(400)]
    texts += [
        "a@b.c_d@e.f a@b.c@d.e x@y.zz..w a@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.0.0.1 9999999999.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111", "+1 (988) 555-2485 +123456789 +1 2", "é😀 a@b.co 😀 1.1.1.1",
        "1" * 3000, "a" * 2000 + "@" + "b." * 2000 + "c", "a@b.co " * 300,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = personal_data(docs).collect()
    assert len(rows) == len(texts)
    hold(rows, texts)


def test_odd_rows(odd, none):
    rows = personal_data(odd).collect()
    assert personal_data(none).count() == 0 and len(rows) == odd.count()
    hold(rows, {r.doc_id: r.text for r in odd.collect()})
    masked = mask_text(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count() and mask_text(none).count() == 0
    got = {r.text for r in masked.where("doc_id = 19").collect()}
    assert got == {"[IP] [EMAIL] [PHONE], and [CARD]"} and masked.where("text is null").count() == 1


def corpus(spark):
    pick = random.Random(8)
    common = [f"word{chr(97 + i)}" for i in range(20)]
    texts = [" ".join(pick.choice(common) for _ in range(30)) for _ in range(300)]
    for i in range(6):  # a name beside the same address in different contexts
        texts[i] += f" {pick.choice(common)} Zebulon {pick.choice(common)} z.{'q'}@mail.example {pick.choice(common)} {i}th"
    for i in range(6, 12):  # an address in copies of one passage
        texts[i] += " the selfsame boilerplate passage around copy@mail.example repeated everywhere without change at all today"
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_a_disclosing_term_goes_and_other_words_stay(spark):
    docs = corpus(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in personal_data(docs).collect():
        extra = [s.split(":") for s in r.spans.split(",") if s.startswith(("term", "removed"))]
        found = [texts[r.doc_id][int(a) : int(b)] for _, a, b in extra]
        assert found == (["Zebulon"] if r.doc_id < 6 else []) and r.n_terms == len(found)
        assert r.n_email == (r.doc_id < 12)
    masked = {r.doc_id: r.text for r in mask_text(docs).collect()}
    assert "Zebulon" not in masked[0] and "[EMAIL]" in masked[0] and masked[100] == texts[100]


def flagged(spark, texts):
    """Terms masked in each text."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s.startswith(("term", "removed"))] for r in personal_data(docs).collect()}
    return [[texts[i][int(a) : int(b)] for _, a, b in spans[i]] for i in range(len(texts))]


def prose(pick, n):
    return " ".join(pick.choice([f"word{chr(97 + i)}" for i in range(20)]) for _ in range(n))


def test_a_name_far_from_the_address_goes_at_every_place(spark):
    pick = random.Random(12)
    texts = [prose(pick, 60) for _ in range(300)]
    for i in range(6):
        texts[i] = f"{prose(pick, 3)} Zebulon {texts[i]} zebulon {prose(pick, 40)} z.q@mail.example {prose(pick, 4)}"
    found = flagged(spark, texts)
    assert found == [sorted(["Zebulon", "zebulon"])] * 6 + [[]] * 294


def test_names_of_two_words_and_after_a_label_go(spark):
    pick = random.Random(13)
    texts = [prose(pick, 60) for _ in range(300)]
    for i in range(6):
        texts[i] += f" Jane Doe <jane@x.org> {prose(pick, 20)}"
        texts[10 + i] += f" contact: Zebulon z@x.org {prose(pick, 20)}"
        texts[20 + i] += " regards, Quentin Ash <q@y.org>"  # ends the text
    texts[30:36] = [f"Ottilie Bock <o@z.org> {t}" for t in texts[30:36]]  # begins it
    for i in range(40, 46):  # copies of one text, and of a passage
        texts[i] = texts[46] + " Ulrich Voss <u@w.org> " + texts[47]
        texts[i + 10] += " one passage that says Wanda Zorn <w@z.org> and then always goes the very same way again"
    texts[70] = texts[46] + " contact regards"
    found = flagged(spark, texts)
    for i in range(6):
        assert found[i] == ["Jane", "Doe"] and "Zebulon" in found[10 + i]
        assert found[20 + i][-2:] == ["Quentin", "Ash"] and found[30 + i] == ["Ottilie", "Bock"]
        assert found[40 + i] == [] and found[50 + i] == []
    assert not any(found[60:])


GROUPS = {
    "email": lambda v: v.split("@")[-1].lower(),
    "ip": lambda v: ".".join(v.split(".")[:3]),
    "card": lambda v: re.sub("[^0-9]", "", v)[:6],
    "phone": lambda v: re.sub("[^0-9]", "", v)[:5],
}


def plain_terms(texts, alpha=1.25, least=3):
    """Terms masked in each text, by counting every pair of entity and term over all texts."""
    n, held, words, places = len(texts), [], [], []
    for text in texts:
        found = [(k, m.group(), m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m.group())]
        held.append({(k, v) for k, v, _ in found} | {(f"{k}-group", GROUPS[k](v)) for k, v, _ in found})
        blank = list(text)
        for _, _, (a, b) in found:
            blank[a:b] = " " * (b - a)
        terms = [(m.group().lower(), m.start(), m.group()) for m in re.finditer(r"[^\W_]{3,}", "".join(blank))]
        places.append(terms)
        words.append({w for w in re.findall(r"[^\W_]{3,}", text.lower())})
    entities = Counter(e for h in held for e in h)
    entities = {e: c for e, c in entities.items() if c >= least and (not e[0].endswith("-group") or -math.log2(c / n) >= 6)}
    counts = Counter(w for t in words for w in t)
    both, before, after = Counter(), defaultdict(set), defaultdict(set)
    for i, h in enumerate(held):
        mine = [w for w, _, _ in places[i]]
        for e in h & entities.keys():
            for w in set(mine):
                both[e, w] += 1
                at = [j for j, x in enumerate(mine) if x == w]
                side = lambda j, step: tuple(mine[j + step * k] if 0 <= j + step * k < len(mine) else None for k in range(1, 6))
                before[e, w].add(tuple(sorted({(side(j, -1), texts[i] if j < 5 else "") for j in at}, key=str)))
                after[e, w].add(tuple(sorted({(side(j, 1), texts[i] if len(mine) - 1 - j < 5 else "") for j in at}, key=str)))
    out = []
    for i, h in enumerate(held):
        spots = set()
        for e in h & entities.keys():
            content = -math.log2(entities[e] / n)
            for w, at, raw in places[i]:
                told = math.log2(both[e, w] * n / (counts[w] * entities[e])) if both[e, w] else -1
                if content > 0 and both[e, w] >= least and told >= content / alpha and min(len(before[e, w]), len(after[e, w])) >= least:
                    spots.add((at, raw))
        out.append([raw for _, raw in sorted(spots)])
    return out


def test_terms_equal_counting_every_pair(spark):
    pick = random.Random(21)
    texts = [prose(pick, pick.randint(5, 60)) for _ in range(400)]
    names = [f"Name{chr(97 + i)}" for i in range(12)]
    for _ in range(150):
        i, who = pick.randrange(400), pick.randrange(12)
        value = pick.choice([f"u{pick.randrange(4)}@host{who}.org", f"10.{who}.7.{pick.randrange(5)}", f"+49 30 12{who:02d} 55{pick.randrange(3)}1"])
        texts[i] = f"{prose(pick, 7)} {names[who]} {prose(pick, pick.randint(5, 9))} {value} {texts[i]}"
    got, want = flagged(spark, texts), plain_terms(texts)
    assert got == want and sum(map(len, want)) > 20


def test_a_name_beside_many_addresses_of_one_host_goes(spark):
    pick = random.Random(14)
    texts = [prose(pick, 60) for _ in range(600)]
    for i in range(6):  # no address occurs twice
        texts[i] += f" {prose(pick, 5)} Zebulon {prose(pick, 6)} user{i}@zebulon.example {prose(pick, 6)}"
    found = flagged(spark, texts)
    assert found == [["Zebulon"]] * 6 + [[]] * 594


def test_repeated_rows_change_no_flags(spark):
    docs = corpus(spark)
    tripled = docs.unionByName(docs).unionByName(docs)
    once, thrice = ({(r.doc_id, r.spans) for r in personal_data(d).collect()} for d in (docs, tripled))
    assert once == thrice and any("removed" in s or "term" in s for _, s in once)
    assert mask_text(tripled).count() == 3 * docs.count()


def test_columns_whose_names_clash_stay_as_they_are(spark):
    rows = [(i, f"mail a{i}@b.co and +49 30 1234 5678 end", 7, "k", [1], 0.5) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key1 int, key1_ string, spans_found array<int>, KEY2 double")
    masked = mask_text(docs)
    assert masked.columns == docs.columns
    assert [tuple(r)[1:] for r in masked.collect()] == [("mail [EMAIL] and [PHONE] end", 7, "k", [1], 0.5)] * 3


def test_many_spans_in_a_long_text(spark):
    text = "é " + "a@b.co, 1.2.3.4 ünd " * 3000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert mask_text(docs).head().text == "é " + "[EMAIL], [IP] ünd " * 3000
