"""Mixture-controlled packing: deficit round-robin over source queues, with documents cut at window quotas.

Each source is a queue of tokens. Every window takes from each queue its quantum, the window size times the
queue's share of all tokens; the fraction that can't be taken is the queue's deficit and is carried to the next
window. Run as a loop that is sequential. Here the deficits have a closed form: number the tokens of a queue,
give token t of a queue with n tokens the virtual time (t + 1/2) / n, and serve tokens in the order of
(virtual time, queue). Window k holds ranks k * size to (k + 1) * size, and a token's rank is a sum over queues
of floor(n * time + 1/2), so any task can tell which window and place its tokens have from the queue totals and
the count of earlier tokens in the queue. What one partition ends with, the next one starts from: the deficit
carried across windows and partitions is the difference of two such sums.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvewalk.llm.merging import CHUNKS, WORDS, batch_coder
from curvewalk.llm.tables import _arrow_schema, numbered
from curvewalk.sources.tables import materialize

#: Queues at most. Sources are numbered and each has a queue of its own up to there; of more, those that are so many
#: numbers apart share one. It bounds the table of totals.
QUEUES = 256
#: Rows of the table of queue positions up to which it is broadcast; beyond, the join is left to Spark.
SMALL = 200_000


class Mixture:
    """Ranks of queue tokens in the common order, and windows of ranks, from the queue totals alone."""

    def __init__(self, totals: dict[int, int], size: int):
        self.names = sorted(q for q, n in totals.items() if n)
        self.place = {q: i for i, q in enumerate(self.names)}
        self.n = [int(totals[q]) for q in self.names]
        self.total, self.size = sum(self.n), size

    def taken(self, rank: int) -> list[int]:
        """How many tokens of each queue are among the first rank tokens of the order."""
        if rank >= self.total:
            return list(self.n)
        # The time of a token is (2t + 1) / (2n). Search over a common scale in exact integers.
        # By a time x, total * x tokens are served, give or take half a token a queue; so the search is short.
        scale, around = 2 * self.total, len(self.n) + 2
        low, high = max(0, 2 * rank - around), min(scale, 2 * rank + around)
        while low < high:  # the least time, in units of 1 / scale, by which rank tokens are served
            middle = (low + high) // 2
            if sum(self._served(n, middle, scale) for n in self.n) >= rank:
                high = middle
            else:
                low = middle + 1
        counts = [self._served(n, low - 1, scale) if low else 0 for n in self.n]
        missing = rank - sum(counts)
        # Tokens in the last unit of time are served in queue order.
        for i, n in enumerate(self.n):
            more = min(missing, self._served(n, low, scale) - counts[i])
            counts[i] += more
            missing -= more
        return counts

    @staticmethod
    def _served(n: int, time: int, scale: int) -> int:
        """Tokens of a queue of n with (2t + 1) / 2n <= time / scale."""
        return min(n, (2 * n * time // scale + 1) // 2)

    def cuts(self, queue: int, firsts: np.ndarray, end: int, known: dict[int, list[int]]) -> tuple[np.ndarray, ...]:
        """Pieces of texts that follow each other in a queue from firsts on, up to end.

        Arrays over the pieces: the text, the first token in the queue, the length, the window and the place there.
        """
        i, low = self.place[queue], int(firsts[0])
        window = self._window_of(i, low, known)
        taken = [self._taken(window, known)]
        while taken[-1][i] < end:
            taken.append(self._taken(window + len(taken), known))
        counts = np.array(taken, dtype=np.int64)
        own = counts[:, i]
        at = np.unique(np.concatenate([firsts, own[(own > low) & (own < end)]]))
        inside = np.searchsorted(own, at, side="right") - 1
        others = (counts[1:, :i] - counts[:-1, :i]).sum(axis=1)
        text = np.searchsorted(firsts, at, side="right") - 1
        return text, at, np.diff(np.append(at, end)), window + inside, others[inside] + at - own[inside]

    def _window_of(self, i: int, at: int, known: dict[int, list[int]]) -> int:
        """The first window that holds token at of the i-th queue."""
        near = max(0, (2 * at + 1) * self.total // (2 * self.n[i]) // self.size - 1)
        while near and self._taken(near, known)[i] > at:
            near -= 1
        while self._taken(near + 1, known)[i] <= at:
            near += 1
        return near

    def _taken(self, window: int, known: dict[int, list[int]]) -> list[int]:
        if window not in known:
            if len(known) > 50_000:
                known.clear()
            known[window] = self.taken(window * self.size)
        return known[window]

    def sequences(self, window: int, offset: int, length: int) -> list[tuple[int, int, int, int]]:
        """Parts of a piece as (skip, length, sequence, offset).

        All windows but the last are full and are one sequence. The last one, with the rest of all tokens, is
        cut into powers of two, which need no padding: sequences of these lengths from the largest on.
        """
        full, rest = divmod(self.total, self.size)
        if window < full:
            return [(0, length, window, offset)]
        out, begin, sequence = [], 0, full
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                low, high = max(offset, begin), min(offset + length, begin + (1 << bit))
                if low < high:
                    out.append((low - offset, high - low, sequence, low - begin))
                begin, sequence = begin + (1 << bit), sequence + 1
        return out


def tokens_by_queue(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    id_col: str,
    text_col: str,
    source_col: str,
    remembered: tuple[int, int] = (CHUNKS, WORDS),
) -> DataFrame:
    """Ids of every text with the closing id, written once: (doc_id, queue, part, before, n_tokens, ids).

    before counts the tokens of the queue in earlier rows of the same part of the file.
    """
    source = F.col(f"`{source_col}`").cast("string").alias("source")
    numbers = materialize(numbered(docs.select(source).distinct(), "source"), "sources")
    numbers = numbers.select(F.col("source").alias("own"), (F.col("place") % QUEUES).cast("int").alias("queue"))
    slim = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), source
    )
    slim = slim.join(numbers, slim["source"].eqNullSafe(numbers["own"])).select("doc_id", "text", "queue", F.spark_partition_id().alias("part"))
    schema = "doc_id long, queue int, part int, before long, n_tokens long, ids binary"
    fields = _arrow_schema(docs, schema)
    closing = end_id.to_bytes(4, "little")

    def run(batches):
        code, counts = batch_coder(vocabulary, *remembered), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids = [x + closing for x in code.encode(batch.column(1).to_pylist())]
                queues, parts, before = batch.column(2).to_pylist(), batch.column(3), []
                for q, x in zip(queues, ids):
                    before.append(counts.get(q, 0))
                    counts[q] = before[-1] + len(x) // 4
                sizes = [len(x) // 4 for x in ids]
                columns = [batch.column(0), batch.column(2), parts, before, sizes, [_narrow(x) for x in ids]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields)

    return materialize(slim.mapInArrow(run, schema), "tokens")


def _narrow(ids: bytes) -> bytes:
    """Ids as 16-bit integers where all fit, else as 32-bit ones; a leading byte tells which."""
    wide = np.frombuffer(ids, dtype="<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\x04" + ids


def _widen(ids: bytes) -> bytes:
    return np.frombuffer(ids, dtype="<u2", offset=1).astype("<u4").tobytes() if ids[0] == 2 else ids[1:]


def pack(
    docs: DataFrame,
    vocabulary: str,
    size: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = False,
    remembered: tuple[int, int] = (CHUNKS, WORDS),
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue[, ids]).

    Each text's ids and end_id are cut into pieces that fill sequences of size tokens, each in the token
    proportions of the sources (deficit round-robin; a queue's tokens in a window differ from its exact share
    by less than the number of queues). Each id lies in one piece; sequences are gapless. Only the last
    window can fall short; it is cut into sequences of power-of-two lengths, so nothing is padded. A null text
    counts as empty and has end_id alone; a null source is a source of its own. Of more than QUEUES
    sources some share a queue. Repeated rows are packed each; an empty table gives no rows. Other columns
    are ignored.

    Texts are encoded once; remembered bounds the chunks and words whose ids a worker keeps, in each of two generations,
    and trades its memory for time. Positions in a queue come from counts per file part, so a hot source is spread
    over all parts; the totals of at most QUEUES queues are all the driver sees.
    """
    tokens = tokens_by_queue(docs, vocabulary, end_id, id_col, text_col, source_col, remembered)
    parts = tokens.groupBy("queue", "part").agg(F.sum("n_tokens").alias("tokens"))
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("queue", "part", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))
    sums = parts.groupBy("queue").agg(F.sum("tokens").alias("n"), F.count("*").alias("parts")).collect()
    totals = {r.queue: r.n for r in sums}
    # One row per part and queue: sent to all tasks while it is small, so that ids need no shuffle.
    if sum(r.parts for r in sums) <= SMALL:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["queue", "part"]).select(
        "doc_id", "queue", (F.col("base") + F.col("before")).alias("first"), "n_tokens", "ids"
    )
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, queue int"
        + (", ids binary" if with_ids else "")
    )
    fields = _arrow_schema(docs, schema)
    return placed.mapInArrow(partial(_pieces, Mixture(totals, size), fields, with_ids), schema)


def _pieces(mixture: Mixture, fields: pa.Schema, with_ids: bool, batches):
    known: dict[int, list[int]] = {}
    full = mixture.total // mixture.size
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            part = batch.slice(low, 2000)
            texts = [memoryview(_widen(x)) for x in part.column(4).to_pylist()]
            queues, firsts, sizes = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            order = np.lexsort((firsts, queues))
            ends = (firsts + sizes)[order]
            new = np.concatenate([[True], (queues[order][1:] != queues[order][:-1]) | (firsts[order][1:] != ends[:-1])])
            heads = np.flatnonzero(new)
            found: list[tuple[np.ndarray, ...]] = []
            for begin, stop in zip(heads, np.append(heads[1:], len(order))):
                rows = order[begin:stop]
                text, at, length, window, offset = mixture.cuts(int(queues[rows[0]]), firsts[rows], int(ends[stop - 1]), known)
                found.append((rows[text], at - firsts[rows[text]], length, window, offset))
            row, start, length, window, offset = (np.concatenate(x) for x in zip(*found))
            whole = window < full
            if not whole.all():
                tail = [
                    (r, s + skip, n, sequence, place)
                    for r, s, size, w, o in zip(*(x[~whole].tolist() for x in (row, start, length, window, offset)))
                    for skip, n, sequence, place in mixture.sequences(w, o, size)
                ]
                parts = (x[whole] for x in (row, start, length, window, offset))
                row, start, length, window, offset = (np.concatenate([x, y]) for x, y in zip(parts, np.array(tail).T))
            spans = list(zip(row.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist()))
            sums = [zlib.crc32(texts[r][a:b]) for r, a, b in spans]
            columns = [part.column(0).take(pa.array(row)), start, length, sums, sizes[row], window, offset, queues[row]]
            if with_ids:
                columns.append([bytes(texts[r][a:b]) for r, a, b in spans])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields)
