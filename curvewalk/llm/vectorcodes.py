"""Compressing vectors to codes of their parts, with nearest entries found through a GNAT over each codebook.

A geometric near-neighbour access tree has split points; every other entry belongs to its nearest split point, and
for each pair of a split point and a child the range of distances between the two is kept. A query's distance to one
split point rules out every child whose range it can't reach within the best distance so far. Only what is surely
farther is ruled out: ranges are widened by more than rounding can take away, and what remains is compared in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvewalk.llm.tables import _arrow_schema
from curvewalk.sources.tables import materialize

#: Split points of a node; a node with at most LEAF entries is compared entry by entry.
DEGREE, LEAF = 8, 8
#: By how much distances may be off: far above the rounding of a square root of an integer below 2^63.
SLACK = 1e-9
#: Vectors taken up at a time, and parts of a label's sum that different tasks join.
BATCH, SALTS = 4096, 32


@dataclass(frozen=True)
class Node:
    """Split points as entry numbers, children, and low[i, j], high[i, j]: distances from split point i to child j.

    Child j holds split point j and the entries nearest to it; its subtree is None if it holds nothing else.
    """

    points: np.ndarray
    children: list["Node | None"]
    low: np.ndarray
    high: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=-1)


def grow(entries: np.ndarray, members: np.ndarray, degree: int = DEGREE, leaf: int = LEAF) -> Node | None:
    """The tree over the entries with these numbers. Split points are spread out: each is far from those before."""
    if not len(members):
        return None
    if len(members) <= max(leaf, degree):
        none = np.zeros((len(members), 0))
        return Node(members, [], none, none)
    points = [int(members[0])]
    nearest = squared(entries[members], entries[points[0]])
    while len(points) < degree and nearest.max() > 0:
        points.append(int(members[nearest.argmax()]))
        nearest = np.minimum(nearest, squared(entries[members], entries[points[-1]]))
    if len(points) == 1:  # all entries are equal
        none = np.zeros((len(members), 0))
        return Node(members, [], none, none)
    split = np.array(points)
    far = np.sqrt(np.stack([squared(entries[members], entries[p]) for p in points]).astype(float))
    owner = far.argmin(axis=0)
    low, high, children = np.zeros((len(points),) * 2), np.zeros((len(points),) * 2), []
    for j in range(len(points)):
        mine = owner == j
        low[:, j], high[:, j] = far[:, mine].min(axis=1), far[:, mine].max(axis=1)
        children.append(grow(entries, np.setdiff1d(members[mine], split), degree, leaf))
    return Node(split, children, low * (1 - SLACK), high * (1 + SLACK))


def nearest(entries: np.ndarray, tree: Node, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry number, squared distance) of each query's nearest entry, ties to the lower number, and distances taken."""
    best = np.full(len(queries), np.iinfo(np.int64).max)
    number = np.full(len(queries), len(entries))
    taken = 0

    def meet(rows: np.ndarray, entry: int) -> np.ndarray:
        nonlocal taken
        taken += len(rows)
        d2 = squared(queries[rows], entries[entry])
        closer = (d2 < best[rows]) | ((d2 == best[rows]) & (entry < number[rows]))
        best[rows[closer]], number[rows[closer]] = d2[closer], entry
        return d2

    def search(node: Node, rows: np.ndarray) -> None:
        if not node.children:
            for entry in node.points:
                meet(rows, int(entry))
            return
        alive = np.ones((len(node.points), len(rows)), dtype=bool)
        for i, entry in enumerate(node.points):
            # A split point whose own child is ruled out is farther than the best, and needs no distance either.
            there = np.flatnonzero(alive[i])
            if not len(there):
                continue
            far = np.sqrt(meet(rows[there], int(entry)).astype(float))
            reach = np.sqrt(best[rows[there]].astype(float)) * (1 + SLACK) + SLACK
            beyond = (far[None] * (1 - SLACK) - reach[None] > node.high[i][:, None]) | (
                far[None] * (1 + SLACK) + reach[None] < node.low[i][:, None]
            )
            alive[:, there] &= ~beyond
        for j, child in enumerate(node.children):
            if child is not None and len(there := np.flatnonzero(alive[j])):
                search(child, rows[there])

    search(tree, np.arange(len(queries)))
    return number, best, taken


class Codebooks:
    """Entries of all parts: books[p] is an array (entries, width), with a tree over it."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.trees = [grow(b, np.arange(len(b))) for b in books]
        self.edges = np.cumsum([0, *[b.shape[1] for b in books]])

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), both with a column for each part."""
        codes, errors = (np.zeros((len(vectors), len(self.books)), dtype=np.int64) for _ in range(2))
        for p, (book, tree) in enumerate(zip(self.books, self.trees)):
            part = vectors[:, self.edges[p] : self.edges[p + 1]]
            codes[:, p], errors[:, p], _ = nearest(book, tree, part)
        return codes, errors

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def _fitting(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    x = F.col("v")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    slim = vectors.select(
        F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    return slim.where(x.isNotNull() & ~odd)


def whole_numbers(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, a row a vector; shorter vectors are filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    # A part's squared distance is a sum of at most width squares of twice the largest component.
    if len(flat) and np.abs(flat).max() >= np.sqrt(2.0**60 / max(width, 1)):
        raise OverflowError("squared distances of these vectors don't fit in 64 bits")
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def train_codebooks(rows: DataFrame, parts: int, entries: int, rounds: int, scale: float) -> tuple[Codebooks, int]:
    """Codebooks of rows (vec_id, v), and the width to which vectors are filled up.

    They begin as the parts of the entries smallest ids' vectors. In a round each task sums up what it assigns, so
    entries x parts rows of sums leave it; the driver holds the codebooks, whose size is a parameter.
    """
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    begun = whole_numbers(first["v"].combine_chunks(), width, scale) if len(first) else np.zeros((0, width), dtype=np.int64)
    step = width // parts
    books = Codebooks([begun[:, p * step : (p + 1) * step] for p in range(parts)])
    schema = "part int, entry int, n long, total array<long>"
    fields = _arrow_schema(rows, schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, len(begun)), dtype=np.int64)
        total = np.zeros((parts, len(begun), step), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                x = whole_numbers(batch.column(0).slice(at, BATCH), width, scale)
                codes, _ = books.encode(x)
                for p in range(parts):
                    n[p] += np.bincount(codes[:, p], minlength=len(begun))
                    np.add.at(total[p], codes[:, p], x[:, p * step : (p + 1) * step])
        p, e = np.nonzero(n)
        columns = [p, e, n[p, e], total[p, e].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields)

    for _ in range(rounds):
        if not len(begun):
            break
        partly = rows.select("v").mapInArrow(sums, schema)
        added = F.transform(F.sequence(F.lit(0), F.lit(max(step - 1, 0))), lambda i: F.get("total", i))
        spread = partly.select("part", "entry", "n", F.posexplode(added).alias("i", "x"))
        spread = spread.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        moved = [b.copy() for b in books.books]
        if step:
            for r in spread.collect():  # one row for each component of the codebooks
                moved[r.part][r.entry, r.i] = r.x // r.n
        books = Codebooks(moved)
    return books, width


def encode_vectors(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, codes, error, label_error) of each vector, and the codebooks.

    A component x becomes floor(scale * x). Vectors are cut into equal consecutive parts; a part's code is the number
    of the nearest of its codebook's entries, ties to the lower number, error the squared distances summed over parts,
    label_error the errors summed over rows of the same label, null labels together. Codebooks begin with the entries
    smallest ids (null ids last, equal ids in order of their components) and are moved to their parts' means, rounded
    down, in each round; entries without parts stay.

    Vectors that are null or hold a null or non-finite component are dropped. Vectors shorter than the longest one,
    and a length that the parts don't divide, are filled up with zeros. Repeated rows are rows of their own. Numbers too
    large for 64 bits raise an error. An empty table gives no rows; other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte, so there can be 1 to 256 entries")
    rows = _fitting(vectors, id_col, vector_col, label_col)
    books, width = train_codebooks(rows, parts, entries, rounds, scale)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long"
    fields = _arrow_schema(rows, schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                ids, labels, v = (c.slice(at, BATCH) for c in batch.columns)
                codes, errors = books.encode(whole_numbers(v, width, scale))
                columns = [ids, labels, pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(errors.sum(axis=1))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], schema=fields)

    coded = materialize(rows.mapInArrow(encode, schema), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "label_")
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt_", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    joined = salted.join(sums, salted["label"].eqNullSafe(sums["label_"]) & (salted["salt_"] == sums["salt"]))
    return joined.select("vec_id", "label", "codes", "error", "label_error"), books
