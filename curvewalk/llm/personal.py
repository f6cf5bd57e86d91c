"""Personal data: fixed patterns, and terms that give away what the patterns protect.

A found value is a protected entity, and so is the group it belongs to: a mail host, the prefix of an address or a
number; a value too rare for evidence of its own borrows that of its group. An entity's information content is -log2 of the share of texts it is in; what a term
tells about it is their pointwise mutual information over the corpus, log2 of p(term, entity) / (p(term) p(entity)).
A term whose information comes within a factor of the entity's content would let a reader infer the entity after
its value is masked, so it is masked too wherever it stands in the entity's documents: removed if it tells nearly
all, replaced by a general word otherwise. Everything here is column expressions and joins; no Python runs on executors.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewalk.llm.tables import free_name
from curvewalk.sources.tables import materialize

# Kinds in the order of the result, with patterns that match what the plain ones match. Possessive
# counts and the start conditions keep long runs of letters or digits from being tried from each of their places.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: A letter each of these texts must have, checked before the pattern is tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}
TERM = r"[\p{L}\p{N}]{3,}+"
#: Terms on each side of a term that tell its surroundings apart.
AROUND = 5
#: Bits of information content from which a group counts as an entity: at most one text in 64 has it.
LEAST_CONTENT = 6.0
#: Bits of the map of hashes that wanted terms are looked up in before words are counted; its size is fixed.
MAP_BITS = 1 << 23
_PART = 64

SPAN = "struct<kind:string,start:int,end:int>"


def _lengths_before(lengths: Column) -> Column:
    """Running sums of an array, each without its own element; linear but for a part's size."""
    parts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _PART).cast("int"))
    empty = F.array().cast("array<int>")

    def run(values: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("sum"), empty.alias("before"))
        return F.aggregate(
            values,
            start,
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before")),
            lambda a: a["before"],
        )

    def part(p: Column) -> Column:
        return F.slice(lengths, p * _PART + 1, F.lit(_PART))

    sums = F.transform(parts, lambda p: F.aggregate(part(p), F.lit(0), lambda a, x: a + x))
    bases = run(sums, F.lit(0))
    return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), bases.alias("b")), lambda x: run(part(x["p"]), x["b"])))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of all matches, leftmost and non-overlapping, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    gaps = F.transform(F.slice(between, 1, F.size(found)), lambda x: F.length(x))
    sizes = F.transform(found, lambda x: F.length(x))
    before = _lengths_before(F.zip_with(gaps, sizes, lambda a, b: a + b))
    starts = F.zip_with(before, gaps, lambda a, b: a + b)
    spans = F.zip_with(
        starts,
        found,
        lambda s, v: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")),
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(F.size(found) > 0, spans).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(digit: Column, place: Column) -> Column:
        twice = digit.cast("int") * 2
        return F.when(place % 2 == 0, digit.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: worth(d, i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match passes its kind's test."""
    if kind == "ip":
        small = lambda part: F.regexp_replace(part, "^0+", "")
        fits = lambda part: (F.length(small(part)) <= 3) & (F.lpad(small(part), 3, "0") <= "255")
        return F.forall(F.split(value, r"\."), fits)
    if kind == "card":
        digits = _digits(value)
        return (F.length(digits) <= 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _passes(kind: str, span: Column) -> Column:
    return _holds(kind, span["value"])


def _group(span: Column) -> Column:
    """The group of a found value as (kind, value): mail host, first three parts of an address, first digits of a number."""
    kind, value = span["kind"], span["value"]
    shared = (
        F.when(kind == "email", F.lower(F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.substring_index(value, ".", 3))
        .when(kind == "card", F.substring(_digits(value), 1, 6))
        .otherwise(F.substring(_digits(value), 1, 5))
    )
    return F.struct(F.concat(kind, F.lit("-group")).alias("kind"), shared.alias("value"))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind that pass its test."""
    out = {}
    for kind, pattern in PATTERNS.items():
        possible = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
        found = F.filter(matches(text, pattern, kind), partial(_passes, kind))
        none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
        out[kind] = F.when(possible, found).otherwise(none)
    return out


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans, so that places stay and an entity's own words are no terms."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(done: Column, span: Column) -> Column:
        begin, end = F.greatest(span["start"], done["at"]), F.greatest(span["end"], done["at"])
        kept = F.substring(text, done["at"] + 1, begin - done["at"])
        return F.struct(F.concat(done["out"], kept, F.repeat(F.lit(" "), end - begin)).alias("out"), end.alias("at"))

    return F.aggregate(
        by_place, start, put, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    )


def _places(words: Column, starts: Column, ends: Column, text: Column) -> Column:
    """Each term of a text with its place and hashes of the AROUND terms on each side; entities are passed over.

    Fewer terms at an end of the text are told apart by the text, so only its exact copies have the same hash.
    """

    def around(i: Column, step: int, there: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + step * k) for k in range(1, AROUND + 1)], F.when(there < AROUND, text))

    return F.transform(
        words,
        lambda w, i: F.struct(
            w.alias("term"),
            F.get(starts, i).alias("start"),
            F.get(ends, i).alias("end"),
            around(i, -1, i).alias("before"),
            around(i, 1, F.size(words) - 1 - i).alias("after"),
        ),
    )


def find_spans(
    docs: DataFrame, alpha: float = 1.25, least_contexts: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: (doc_id, key1, key2, email, ip, card, phone, terms), arrays of spans.

    A term of the documents with an entity is masked wherever it stands in them, if at least least_contexts
    of them differ in what stands before it and as many in what stands after it, and its information reaches the
    entity's content divided by alpha. What stands there are the AROUND terms on that side, at all the term's places in
    the document: copies of a text count once, and so do copies of a passage of over 2 * AROUND terms, but a first name
    or a label beside the term is no reason to keep it. Its kind is 'removed' if it reaches 95 % of the content, 'term'
    otherwise. Frequencies are shares of all rows, repeated ones included. An entity in fewer than least_contexts rows
    has no such terms of its own; its group, if rare enough to tell something (LEAST_CONTENT), stands for it.
    key1 and key2 name a row's id and text for joins. A null text counts as empty and has no spans.
    """
    slim = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    text = F.col("text")
    found = slim.select("doc_id", "text", *row_keys(), *[c.alias(k) for k, c in base_spans(text).items()])
    every = F.concat(*KINDS)
    some = F.when(F.size(every) > 0, F.col("text")).alias("held_text")
    found = materialize(found.select("doc_id", "key1", "key2", *KINDS, some), "personal")
    n = found.count()
    held, entities = _held(found, every, least_contexts, n)
    pairs = _disclosing(held, entities, slim, n, alpha, least_contexts)
    mine = held.select("key1", "key2", F.explode("entities").alias("e")).select("key1", "key2", "e.*")
    mine = mine.join(pairs, ["kind", "value"])
    places = held.select("key1", "key2", F.explode(_places(*map(F.col, ("words", "starts", "ends", "body")))).alias("t"))
    places = places.select("key1", "key2", "t.*").join(pairs.select("term").distinct(), "term", "left_semi")
    seen = materialize(places.join(mine, ["key1", "key2", "term"]), "personal-seen")
    sides = [F.xxhash64(F.array_sort(F.collect_set(c))).alias(c) for c in ("before", "after")]
    texts = seen.groupBy("kind", "value", "term", "key1", "key2").agg(*sides)
    together = texts.groupBy("kind", "value", "term").agg(
        F.least(F.countDistinct("before"), F.countDistinct("after")).alias("contexts")
    )
    flagged = together.where(F.col("contexts") >= least_contexts).select("kind", "value", "term")
    spots = (
        seen.join(flagged, ["kind", "value", "term"])
        .groupBy("key1", "key2", "start", "end")
        .agg(F.min("mask").alias("mask"))
        .groupBy("key1", "key2")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("mask").alias("kind"), "start", "end"))).alias("terms"))
    )
    none = F.array().cast(f"array<{SPAN}>")
    return (
        found.join(spots, ["key1", "key2"], "left")
        .withColumn("terms", F.coalesce("terms", none))
        .select("doc_id", "key1", "key2", *KINDS, "terms")
    )


def row_keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("key1"), F.hash("text", "doc_id").alias("key2")]


def _held(found: DataFrame, every: Column, least: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Texts with an entity that least rows have, as lists of terms, and the entities (kind, value, n_entity).

    Repeated rows are one text that counts times, like in all other counts of rows.
    """
    some = found.where(F.col("held_text").isNotNull()).groupBy("key1", "key2")
    rows = some.agg(F.count("*").alias("times"), F.first("held_text").alias("held_text"), *[F.first(k).alias(k) for k in KINDS])
    own = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value")))
    values = F.array_distinct(F.concat(own, F.transform(every, _group)))
    each = rows.select("key1", "key2", "times", F.explode(values).alias("e")).select("key1", "key2", "times", "e.*")
    entities = each.groupBy("kind", "value").agg(F.sum("times").alias("n_entity")).where(F.col("n_entity") >= least)
    content = -F.log2(F.col("n_entity") / float(n))
    entities = entities.where(~F.col("kind").endswith("-group") | (content >= LEAST_CONTENT))
    entities = materialize(entities, "personal-entities")
    known = each.join(entities, ["kind", "value"]).groupBy("key1", "key2")
    known = known.agg(F.collect_list(F.struct("kind", "value")).alias("entities"))
    blanked = _blanked(F.col("held_text"), every).alias("blanked")
    texts = rows.select("key1", "key2", "times", F.xxhash64("held_text").alias("body"), blanked).join(known, ["key1", "key2"])
    texts = texts.select("key1", "key2", "times", "body", "entities", matches(F.col("blanked"), TERM, "term").alias("terms"))
    held = texts.select(
        "key1", "key2", "times", "body", "entities",
        F.transform("terms", lambda s: F.lower(s["value"])).alias("words"),
        F.col("terms.start").alias("starts"),
        F.col("terms.end").alias("ends"),
    )
    return materialize(held, "personal-held"), entities


def _spot(term: Column) -> Column:
    """A term's bit in the map of hashes."""
    return F.pmod(F.xxhash64(term, F.lit(3)), F.lit(MAP_BITS))


def _maybe(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """words (term) whose hash is that of a wanted term.

    The hashes of the wanted terms are a map of MAP_BITS bits, 64 to a row: at most 131,072 rows, whatever the corpus, so
    every task gets them. A few other words pass; the more terms are wanted, the more do.
    """
    spots = wanted.select(_spot(F.col("term")).alias("spot")).distinct()
    bits = spots.groupBy(F.expr("spot div 64").alias("block")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("bits"))
    spotted = words.withColumn("spot", _spot(F.col("term"))).withColumn("block", F.expr("spot div 64"))
    there = F.expr("(shiftrightunsigned(bits, cast(spot % 64 as int)) & 1L) = 1")
    return spotted.join(F.broadcast(bits), "block").where(there).select("term")


def _disclosing(held: DataFrame, entities: DataFrame, slim: DataFrame, n: int, alpha: float, least: int) -> DataFrame:
    """(kind, value, term, mask) of the pairs in least rows whose mutual information is too high.

    The rows with a term and any entity are a lower bound of those with the term. It rules out nearly all
    pairs before words of other texts are counted. Those are counted within each task before they are shuffled.
    """
    terms = held.select("entities", "times", F.array_distinct("words").alias("words"))
    each = terms.select("entities", "times", F.explode("words").alias("term"))
    near = each.groupBy("term").agg(F.sum("times").alias("n_near"))
    both = each.select(F.explode("entities").alias("e"), "times", "term").groupBy("e.kind", "e.value", "term")
    together = both.agg(F.sum("times").alias("n_both")).where(F.col("n_both") >= least)
    content = -F.log2(F.col("n_entity") / float(n))

    def told(count: str) -> Column:
        return F.log2(F.col("n_both") * float(n) / (F.col(count) * F.col("n_entity")))

    pairs = together.join(entities, ["kind", "value"]).join(near, "term")
    pairs = materialize(pairs.where((content > 0) & (told("n_near") >= content / alpha)), "personal-pairs")
    wanted = pairs.select("term").distinct()
    words = slim.select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term")
    )
    counts = _maybe(words, wanted).groupBy("term").agg(F.count("*").alias("n_term"))
    mask = F.when(told("n_term") >= 0.95 * content, "removed").otherwise("term").alias("mask")
    disclosing = pairs.join(counts, "term").where(told("n_term") >= content / alpha)
    return materialize(disclosing.select("kind", "value", "term", mask), "personal-disclosing")


def _listed(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms).

    spans lists kind:start:end, in code points, end exclusive: the four base kinds in this order, then masked terms
    ('removed' before 'term'), each by start. base_sha256 is the digest of the base part. Repeated rows are rows of
    their own; an empty table gives none. Other columns are ignored.
    """
    found = find_spans(docs, id_col=id_col, text_col=text_col, **options)
    base = F.concat(*[_listed(F.col(k)) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _listed(F.col("terms"))), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )


def mask_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with personal data in the text replaced by its kind's mask; other columns stay.

    Overlapping spans become one, under the mask of the first. A null text stays null.
    """
    found = find_spans(docs, id_col=id_col, text_col=text_col, **options)
    spans = F.concat(*[F.transform(k, lambda s: s.dropFields("value")) for k in KINDS], F.col("terms"))
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    first, second, listed = (free_name(docs.columns, c) for c in ("key1", "key2", "spans_found"))
    some = found.where(F.size(spans) > 0).groupBy("key1", "key2").agg(F.first(by_place).alias(listed))
    some = some.withColumnsRenamed({"key1": first, "key2": second})
    text, own = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`").cast("long")
    keyed = docs.withColumns({first: F.xxhash64(own, text), second: F.hash(text, own)})
    joined = keyed.join(some, [first, second], "left")
    changed = F.when(F.col(listed).isNull(), F.col(f"`{text_col}`")).otherwise(_replaced(text, F.col(listed)))
    return joined.withColumn(text_col, changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def _replaced(text: Column, spans: Column) -> Column:
    """The text with masks in place of the spans, which are in order; what overlaps goes with the first.

    What is left of the text is passed on from span to span, so no span is looked for from the text's begin.
    """
    masks = F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair])
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit(0).alias("at"), text.alias("rest"))

    def put(done: Column, span: Column) -> Column:
        ahead = span["start"] - done["at"]
        there = F.struct(
            F.concat(done["out"], F.array(F.substring(done["rest"], F.lit(1), ahead), masks[span["kind"]])).alias("out"),
            span["end"].alias("at"),
            F.substring(done["rest"], span["end"] - done["at"] + 1, F.lit(2**31 - 1)).alias("rest"),
        )
        more = F.greatest(span["end"], done["at"])
        passed = F.struct(
            done["out"].alias("out"), more.alias("at"), F.substring(done["rest"], more - done["at"] + 1, F.lit(2**31 - 1)).alias("rest")
        )
        return F.when(ahead >= 0, there).otherwise(passed)

    return F.aggregate(spans, start, put, lambda done: F.concat(F.array_join(done["out"], ""), done["rest"]))
