"""Near-duplicates by SimHash, found through deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvewalk.llm.components import components
from curvewalk.llm.tables import _arrow_schema, body_key, id_and_text, map_columns
from curvewalk.sources.tables import materialize

BITS = 64
#: Fingerprints compared with each other at once; groups beyond it are split into tiles.
TILE = 4096


def fingerprint(text: str, width: int = 4) -> int:
    """64 bits: each is 1 if over half of the hashes of the text's word shingles have it set."""
    words = text.encode().lower().split()  # of bytes: A to Z alone, and cut at 20 and 09 to 0D
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(s, 42) for s in shingles])
    hashes = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8)
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body, fp): the fingerprint of each text as a signed long; 0 for texts without words."""

    def run(doc_id, text, body) -> dict:
        prints = np.array([fingerprint(t, width) for t in text.to_pylist()], dtype=np.uint64)
        return {"doc_id": doc_id, "body": body, "fp": prints.view(np.int64)}

    slim = id_and_text(docs, id_col, text_col).withColumn("body", body_key())
    return map_columns(slim, run, "doc_id long, body long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of which one differs by at most one bit."""
    count = distance // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def signatures(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, key): each fingerprint under each of its segments with one bit deleted, 64 keys in all.

    A key names the segment, the deleted bit and the remaining bits.
    """
    keys = []
    for low, width in segments(distance):
        mask = (1 << width) - 1
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask))
        for bit in range(width):
            rest = part.bitwiseAND(F.lit(mask & ~(1 << bit)))
            keys.append(rest.bitwiseOR(F.lit((low + bit) << 48)))
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(prints: DataFrame, distance: int) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all within the distance into components.

    Rows meet by equality of a signature. A group's rows are dealt to tiles and first compared inside them: one copy
    a row. What that joins is taken as known. Only in a group beyond a tile whose rows aren't one component by then
    do the tiles meet in pairs, and those look for links between different components alone. Of the pairs found in a
    tile only a spanning forest leaves it, never all pairs of a group.
    """
    keyed = signatures(prints, distance)
    large = keyed.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > TILE)
    large = materialize(large, "large-groups")
    tiles = F.ceil(F.coalesce("m", F.lit(1)) / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    inside = keyed.join(large, "key", "left")
    inside = inside.select("key", own.alias("t1"), own.alias("t2"), "fp", F.col("fp").alias("known"))
    found = materialize(_compared(inside, distance), "tile-links")
    if large.isEmpty():
        return found
    rows = materialize(keyed.join(large, "key"), "large-rows")
    nodes = rows.select(F.col("fp").alias("node"), F.col("fp").alias("class_id")).distinct()
    known = components(found, nodes).select(F.col("node").alias("fp"), F.col("component_id").alias("known"))
    rows = rows.join(known, "fp")
    apart = rows.groupBy("key").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low <> high")
    dealt = (
        rows.join(apart.select("key"), "key", "left_semi")
        .withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), tiles - 1))})
        .where("own <> other")
        .select("key", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "fp", "known")
    )
    return found.unionByName(_compared(dealt, distance)).distinct()


def _compared(dealt: DataFrame, distance: int) -> DataFrame:
    """(a, b): a forest of each tile or pair of tiles of rows (key, t1, t2, fp, known)."""
    tile = Window.partitionBy("key", "t1", "t2")  # at most two tiles' rows
    dealt = dealt.withColumn("met", F.count("*").over(tile)).where("met > 1").drop("met")
    dealt = dealt.sortWithinPartitions("key", "t1", "t2")
    return dealt.mapInArrow(_forest_of(distance, _arrow_schema(dealt, "a long, b long")), "a long, b long").distinct()


def _forest_of(distance: int, fields: pa.Schema):
    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = np.stack([c.astype(np.int64) for c in columns], axis=1)
            if not len(rows):
                continue
            rows = np.concatenate([*held, rows])
            change = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
            starts = np.r_[0, 1 + np.flatnonzero(change)]
            yield _out(_forests(rows[: starts[-1]], starts, distance), fields)
            held = [rows[starts[-1] :]]  # the last group may go on in the next batch
        if held:
            yield _out(_forests(held[0], np.r_[0, len(held[0])], distance), fields)

    return run


def _out(edges: list[tuple[int, int]], fields: pa.Schema) -> pa.RecordBatch:
    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=fields)


def _forests(rows: np.ndarray, starts: np.ndarray, distance: int) -> list[tuple[int, int]]:
    edges: set[tuple[int, int]] = set()
    sizes = np.diff(starts)
    pairs = starts[:-1][sizes == 2]
    if len(pairs):  # most groups: two fingerprints, compared all at once
        a, b = rows[pairs, 3], rows[pairs + 1, 3]
        near = (np.bitwise_count((a ^ b).view(np.uint64)) <= distance) & (rows[pairs, 4] != rows[pairs + 1, 4])
        edges.update(zip(np.minimum(a, b)[near].tolist(), np.maximum(a, b)[near].tolist()))
    for begin, size in zip(starts[:-1][sizes > 2], sizes[sizes > 2]):
        prints, first = np.unique(rows[begin : begin + size, 3], return_index=True)
        edges.update(_forest(prints, rows[begin : begin + size, 4][first], distance))
    return list(edges)


def _forest(prints: np.ndarray, known: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the known components of the fingerprints wherever two are within the distance.

    Breadth first: a component is taken up whole as soon as one of its fingerprints is reached.
    """
    bits, left, edges = prints.view(np.uint64), np.arange(len(prints)), []
    while len(left):
        mine = known[left] == known[left[0]]
        queue, left = left[mine].tolist(), left[~mine]
        while queue and len(left):
            at = queue.pop()
            hits = left[np.bitwise_count(bits[left] ^ bits[at]) <= distance]
            if not len(hits):
                continue
            reached, one = np.unique(known[hits], return_index=True)
            edges += [(int(min(prints[at], prints[i])), int(max(prints[at], prints[i]))) for i in hits[one]]
            taken = np.isin(known[left], reached)
            queue += left[taken].tolist()
            left = left[~taken]
    return edges


def near_duplicates(
    docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id, class_id, body, group).

    Texts are linked if their fingerprints differ in at most distance bits; component_id is the smallest doc_id
    reachable over links, class_id the smallest one with the same fingerprint, body a hash of the text, group names the
    component whatever the ids are. Texts without words (null ones included) have fingerprint 0 and are linked like any other. Repeated rows are one node each under their id;
    an empty table gives no rows. A null doc_id stays null and counts as larger than any other. Other columns
    are ignored.

    Equal fingerprints become one class by a pre-aggregated minimum, so exact copies never meet in a group.
    """
    prints = materialize(fingerprints(docs, width, id_col, text_col), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("class_id")), "simhash-classes")
    labels = components(links(classes.select("fp"), distance), classes.select(F.col("fp").alias("node"), "class_id"))
    return (
        prints.join(labels.withColumnRenamed("node", "fp"), "fp")
        .select(
            "doc_id",
            F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
            "component_id",
            "class_id",
            "body",
            "group",
        )
    )
