"""Exact top-k search by inner product: term-at-a-time accumulation over blocks, selection, merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvewalk.llm.tables import _arrow_schema
from curvewalk.session import task_count
from curvewalk.sources.tables import materialize

#: Rows of a block of candidates and of one of queries, and components of either: what one task holds, whatever the table's size.
CANDIDATES, QUERIES, COMPONENTS = 65536, 2048, 1 << 22
#: Blocks of candidates get smaller to give every core four, down to so many rows.
FEWEST = 1024
#: Queries and candidates whose dense score arrays a task keeps at a time.
AT_ONCE, STRIP = 16, 8192


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(uid, vec_id, v): components as floor(scale * x). Vectors that are null, or hold a null or non-finite
    component, or have a null id take no part. uid tells rows with equal ids apart."""
    x = F.col("v")
    slim = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return slim.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~odd).select(
        F.monotonically_increasing_id().alias("uid"), "vec_id", F.transform(x, lambda e: F.floor(e * scale)).alias("v")
    )


def _packed(values: np.ndarray) -> bytes:
    """The smallest integers that hold all values."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    kinds = (np.int8, np.int16, np.int32, np.int64)
    return values.astype(next(k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max)).tobytes()


def _unpacked(stored: bytes, number: int) -> np.ndarray:
    return np.frombuffer(stored, np.dtype(f"i{len(stored) // max(number, 1) or 8}"))


def _blocks(rows: DataFrame, number: int, name: str) -> DataFrame:
    """One row per block: its number, ids, and components of all its vectors with their lengths."""
    schema = f"{name} int, uids binary, ids binary, lengths binary, weights binary"
    fields = _arrow_schema(rows, schema)

    def pack(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["uid"].to_numpy(), table["vec_id"].to_numpy()))
        table = table.take(pa.array(order))
        vectors = table["v"].combine_chunks()
        parts = [np.ascontiguousarray(table[c].to_numpy(), dtype=np.int64).tobytes() for c in ("uid", "vec_id")]
        parts += [_packed(vectors.value_lengths().to_numpy()), _packed(vectors.flatten().to_numpy())]
        row = [[table[name][0].as_py()], *([p] for p in parts)]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(row, fields)], schema=fields)

    block = F.pmod(F.xxhash64("uid"), F.lit(number)).cast("int")
    return rows.withColumn(name, block).groupBy(name).applyInArrow(pack, schema)


class Block:
    def __init__(self, uids: bytes, ids: bytes, lengths: bytes, weights: bytes):
        self.uids, self.ids = np.frombuffer(uids, np.int64), np.frombuffer(ids, np.int64)
        lengths = _unpacked(lengths, len(self.ids)).astype(np.int64)
        weights = _unpacked(weights, int(lengths.sum()))
        self.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.term = (np.arange(len(weights)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        self.weight = weights
        self.largest = max(int(weights.max(initial=0)), -int(weights.min(initial=0)))  # the least 64-bit number has no abs
        self.terms = int(lengths.max(initial=0))
        self.strips: dict[type, list[list[tuple[np.ndarray | None, np.ndarray]]]] = {}

    def postings(self, kind: type) -> list[list[tuple[np.ndarray | None, np.ndarray]]]:
        """For each strip of STRIP rows and each term (dimension), the rows in which it isn't zero, counted from the
        strip's first, and its weights there. Of a term that most rows of the strip have, the weights of all, without rows."""
        if kind not in self.strips:
            used = np.flatnonzero(self.weight)
            order = used[np.argsort(self.term[used], kind="stable")]
            edges = np.searchsorted(self.term[order], np.arange(self.terms + 1))
            rows, weights = self.row[order], self.weight[order].astype(kind)
            cut = [0] * self.terms
            self.strips[kind] = []
            for begin in range(0, len(self.ids), STRIP):
                size, strip = min(STRIP, len(self.ids) - begin), []
                for term in range(self.terms):
                    first, last = edges[term] + cut[term], edges[term + 1]
                    cut[term] += (number := int(np.searchsorted(rows[first:last], begin + size)))
                    at, posted = rows[first : first + number] - begin, weights[first : first + number]
                    if 2 * number > size:
                        column = np.zeros(size, dtype=kind)
                        column[at] = posted
                        at, posted = None, column
                    strip.append((at, posted))
                self.strips[kind].append(strip)
        return self.strips[kind]

    def dense(self, begin: int, end: int, kind: type) -> np.ndarray:
        low, high = np.searchsorted(self.row, [begin, end])
        out = np.zeros((end - begin, self.terms), dtype=kind)
        out[self.row[low:high] - begin, self.term[low:high]] = self.weight[low:high]
        return out


def best_in_block(queries: Block, block: Block, k: int) -> tuple[np.ndarray, ...]:
    """(query's row, candidate's row, score) of each query's k best candidates of a block."""
    size, terms = len(block.ids), min(queries.terms, block.terms)
    most = max(queries.largest, 1) * max(block.largest, 1) * max(terms, 1)
    if (most + 1) * (min(size, STRIP) + 1) >= 1 << 62:
        raise OverflowError("scores of these vectors don't fit in 64 bits")
    kind = np.int32 if most < 1 << 31 else np.int64
    own = {int(u): i for i, u in enumerate(block.uids)}
    found: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, len(queries.ids), AT_ONCE):
        end = min(begin + AT_ONCE, len(queries.ids))
        weights = queries.dense(begin, end, kind)
        asked = [(term, uses) for term in range(terms) if len(uses := np.flatnonzero(weights[:, term]))]
        selves = [own.get(int(u), -1) for u in queries.uids[begin:end]]
        best: list[tuple[np.ndarray, np.ndarray]] = []
        for first, strip in zip(range(0, size, STRIP), block.postings(kind)):
            width = min(STRIP, size - first)
            scores, products = np.zeros((2, end - begin, width), dtype=kind)
            for term, uses in asked:
                rows, posted = strip[term]
                if rows is not None:
                    scores[np.ix_(uses, rows)] += weights[uses, term, None] * posted
                elif 2 * len(uses) > end - begin:
                    scores += np.multiply(weights[:, term, None], posted, out=products)
                else:
                    scores[uses] += weights[uses, term, None] * posted
            # Rows of a block are in order of id, so one number ranks by score, then by smaller id.
            rank = scores.astype(np.int64) * (width + 1) - np.arange(width)
            for i, at in enumerate(selves):
                if first <= at < first + width:
                    rank[i, at - first] = np.iinfo(np.int64).min
            top = np.argpartition(rank, width - k, axis=1)[:, width - k :] if width > k else np.tile(np.arange(width), (end - begin, 1))
            best.append((top + first, np.take_along_axis(scores, top, axis=1).astype(np.int64)))
        candidate, score = (np.concatenate(x, axis=1) for x in zip(*best))
        others = queries.uids[begin:end, None] != block.uids[candidate]
        order = np.lexsort((candidate, -score, ~others), axis=-1)[:, :k]
        candidate, score, others = (np.take_along_axis(x, order, axis=1) for x in (candidate, score, others))
        found.append((np.nonzero(others)[0] + begin, candidate[others], score[others]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _search(k: int, fields: pa.Schema):
    """Over blocks in order of c, each block of candidates before the blocks of queries that meet it."""

    def run(batches):
        held, block = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                c, q, *parts = (column[at].as_py() for column in batch.columns)
                if q < 0:
                    held, block = c, Block(*parts)
                elif c == held:
                    queries = Block(*parts)
                    query, candidate, score = best_in_block(queries, block, k)
                    columns = [queries.uids[query], queries.ids[query], block.ids[candidate], block.uids[candidate], score]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=fields)

    return run


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with all other rows, exactly.

    Queries are the rows whose id is divisible by every. Vectors may differ in length; missing components
    count as zero, an empty vector scores 0 with all. Rows are apart even with equal ids: a query meets every
    row but itself. Ties go to the smaller id. Scores beyond 64 bits raise an error. Empty tables give no rows;
    other columns are ignored.

    Every block of queries meets every block of candidates once: it is sent to all block numbers, and where a number is
    dealt its block of candidates waits, which is sent once. Without a join, no copies can be broadcast by way of the
    driver. A task holds one pair of blocks, and k rows a query and block leave it.
    """
    rows = materialize(quantised(vectors, id_col, vector_col, scale), "vectors")
    asked, cores = rows.where(F.col("vec_id") % every == 0), rows.sparkSession.sparkContext.defaultParallelism
    sizes = F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))
    (n, n_components), (m, m_components) = rows.agg(*sizes).first(), asked.agg(*sizes).first()
    n_candidates = max(1, -(-n // CANDIDATES), -(-n_components // COMPONENTS), min(4 * cores, -(-n // FEWEST)))
    n_queries = max(1, -(-m // QUERIES), -(-m_components // COMPONENTS))
    candidates = _blocks(rows, n_candidates, "c").withColumn("q", F.lit(-1))
    queries = _blocks(asked, n_queries, "q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))
    columns = ["c", "q", "uids", "ids", "lengths", "weights"]
    met = candidates.select(columns).union(queries.select(columns)).repartition(task_count(rows), "c")
    met = met.sortWithinPartitions("c", "q")
    schema = "query_uid long, query_id long, vec_id long, uid long, score long"
    best = met.mapInArrow(_search(k, _arrow_schema(vectors, schema)), schema)
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
