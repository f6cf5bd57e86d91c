"""Removal of byte strings that an earlier document already has: suffix arrays over shards of shared passages.

Equal windows must meet in one shard, without a shuffle of all suffixes. Every window has an anchor, the least hash
of the short strings in it, which depends on the window alone; so equal windows have equal anchors.

1. Each block of documents lists its distinct anchors. Lists are compared by ranges of the hash, and a block learns
   which of its anchors another document has too. Other windows are unique and go no further.
2. Runs of windows with one such anchor are sent, as text and once per block, to the shard that the anchor names.
3. A shard sorts the suffixes of its distinct runs, takes common prefixes, and gives every run the smallest document
   of each of its windows.
4. Blocks mark the bytes of windows whose smallest document is smaller than their own.

An anchor in very many documents could fill a shard with runs that only touch it (a common line between different
neighbours). Step 1 counts documents, and runs of such anchors are cut into single windows, sent to the shard that
the window's own hash names. All steps are exact for any size of group; hashes only route.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvewalk.llm.suffixes import repeated_windows
from curvewalk.llm.tables import _arrow_schema, body_key

#: Length of the strings an anchor is chosen from.
GRAM = 20
#: UTF-8 bytes of a block of documents, and of text for each range of anchors.
BLOCK, RANGE = 4 << 20, 32 << 20
#: Documents from which on an anchor's windows are sent one by one.
COMMON = 5_000
#: Windows looked at together, and windows in a run at most.
SLICE, RUN = 1 << 20, 1024

LAST = np.iinfo(np.int64).max
_FACTOR = 0x9E3779B97F4A7C15
_MIXER = np.uint64(0xFF51AFD7ED558CCD)


class Block:
    """Texts of a block as one array of bytes, in order of id and text."""

    def __init__(self, table: pa.Table):
        ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        keys = [LAST if i is None else i for i in ids]
        order = sorted(range(len(ids)), key=lambda i: (keys[i], texts[i]))
        self.order = pa.array(order, pa.int64())
        self.ids = [ids[i] for i in order]
        bodies = table["body"].to_pylist()
        self.bodies = [bodies[i] for i in order]
        self.keys = np.array([keys[i] for i in order], dtype=np.int64)
        self.raw = [texts[i].encode() for i in order]
        self.bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.sizes = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def runs(self, width: int):
        """Slice by slice: (first window, row, anchor, windows) of maximal runs with one anchor in one text."""
        total = len(self.bytes)
        for low in range(0, total, SLICE):
            high = min(low + SLICE, total)
            part = self.bytes[low : min(high + width - 1, total)]
            count = len(part) - width + 1
            if count < 1:
                continue
            anchors = _least(_rolling(part, GRAM), width - GRAM + 1)[:count]
            row = np.searchsorted(self.ends, np.arange(low, low + count), side="right")
            valid = np.arange(low, low + count) + width <= self.ends[row]
            change = np.ones(count, dtype=bool)
            change[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
            heads = np.flatnonzero(change)
            sizes = np.diff(np.concatenate([heads, [count]]))
            if sizes.max() > RUN:  # one anchor over and over, as in a text of one letter
                pieces = -(-sizes // RUN)
                inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                left = np.repeat(sizes, pieces) - inside * RUN
                heads, sizes = np.repeat(heads, pieces) + inside * RUN, np.minimum(left, RUN)
            heads, sizes = heads[valid[heads]], sizes[valid[heads]]
            yield low + heads, row[heads], anchors[heads], sizes


def _rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every string of so many bytes."""
    step, done, have = (values.astype(np.uint64) + np.uint64(1)) * _MIXER, None, 0
    size, left = 1, width
    while True:
        if left & 1:
            if done is None:
                done, have = step, size
            else:
                n = len(values) - have - size + 1
                done = done[: max(n, 0)] * np.uint64(pow(_FACTOR, size, 1 << 64)) + step[have : have + max(n, 0)]
                have += size
        left >>= 1
        if not left:
            break
        n = max(len(values) - 2 * size + 1, 0)
        step = step[:n] * np.uint64(pow(_FACTOR, size, 1 << 64)) + step[size : size + n]
        size *= 2
    done = (done ^ (done >> np.uint64(29))) * _MIXER
    return done ^ (done >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every so many neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def _names(anchors: np.ndarray, ranges: int) -> np.ndarray:
    """A range of anchors and 32 more bits, in one number; what two anchors may share only sends more text."""
    return ((anchors & np.uint64(0xFFFFFFFF)) % np.uint64(ranges)) << np.uint64(32) | anchors >> np.uint64(32)


def _rows(fields: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields)


def _joined(table: pa.Table, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(_expand(x) for x in table[column].to_pylist() if x is not None), dtype=dtype)


def _squeeze(values: np.ndarray | bytes) -> bytes:
    """Compressed bytes after their length: what goes through the shuffle."""
    raw = values if isinstance(values, bytes) else values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


ANCHORS = "range int, block int, names binary, documents binary"
SHARED = "block int, names binary, common binary"
MESSAGES = "dest long, block int, segments binary, routes binary, sizes binary, owners binary, many binary, text binary"


def _list_anchors(width: int, ranges: int, fields: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        block, names, rows = Block(table), [], []
        for _, row, anchor, _ in block.runs(width):
            names.append(_names(anchor, ranges))
            rows.append(row)
        if not names:
            return _rows(fields, [])
        name, key = np.concatenate(names), block.keys[np.concatenate(rows)]
        order = np.lexsort((key, name))
        name, key = name[order], key[order]
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (key[1:] != key[:-1])])
        name = name[new]
        heads = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        count = np.minimum(np.diff(np.concatenate([heads, [len(name)]])), 65535).astype(np.uint16)
        name = name[heads]
        part = name >> np.uint64(32)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        number = table["block"][0].as_py()
        out = []
        for low, high in zip(cuts, np.concatenate([cuts[1:], [len(name)]])):
            low32 = (name[low:high] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out.append((int(part[low]), number, _squeeze(low32), _squeeze(count[low:high])))
        return _rows(fields, out)

    return run


def _compare_anchors(fields: pa.Schema):
    """Which anchors of a range are in two documents or more, for each block that has them."""

    def run(table: pa.Table) -> pa.Table:
        names, counts = _joined(table, "names", np.uint32), _joined(table, "documents", np.uint16).astype(np.int64)
        order = np.argsort(names, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]]))
        sums = np.add.reduceat(counts[order], heads)
        total = np.empty(len(names), dtype=np.int64)
        total[order] = np.repeat(sums, np.diff(np.concatenate([heads, [len(names)]])))
        part, at, out = np.uint64(table["range"][0].as_py()) << np.uint64(32), 0, []
        for block, packed in zip(table["block"].to_pylist(), table["names"].to_pylist()):
            size = int.from_bytes(packed[:8], "little") // 4
            mine, here = names[at : at + size], total[at : at + size]
            shared = here > 1
            full = mine[shared].astype(np.uint64) | part
            if shared.any():
                out.append((block, _squeeze(full), _squeeze((here[shared] > COMMON).astype(np.uint8))))
            at += size
        return _rows(fields, out)

    return run


def _send_runs(width: int, ranges: int, shards: int, fields: pa.Schema):
    """Runs of a block whose anchors are shared: each distinct text once to its shard, and where they are to itself."""

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows or not shared.num_rows:
            return _rows(fields, [])
        names, common = _joined(shared, "names", np.uint64), _joined(shared, "common", np.uint8)
        order = np.argsort(names)
        names, common = names[order], common[order]
        block = Block(table)
        raw, keys = block.bytes.tobytes(), block.keys.tolist()
        number: dict[tuple[int, bytes], int] = {}
        owners, many, places = [], [], []
        for head, row, anchor, size in block.runs(width):
            name = _names(anchor, ranges)
            found = np.minimum(np.searchsorted(names, name), len(names) - 1)
            mine = names[found] == name
            split = mine & (common[found] == 1)
            head, row, anchor, size, split = (x[mine] for x in (head, row, anchor, size, split))
            if split.any():
                n = size[split]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                single = np.repeat(head[split], n) + inside
                hashes = _rolling(block.bytes[single[0] : single[-1] + width], width)[single - single[0]]
                keep = ~split
                head = np.concatenate([head[keep], single])
                row = np.concatenate([row[keep], np.repeat(row[split], n)])
                anchor = np.concatenate([anchor[keep], hashes])
                size = np.concatenate([size[keep], np.ones(len(single), dtype=size.dtype)])
            for h, r, a, s in zip(head.tolist(), row.tolist(), anchor.tolist(), size.tolist()):
                text = raw[h : h + s + width - 1]
                seg = number.setdefault((a, text), len(owners))
                if seg == len(owners):
                    owners.append(keys[r])
                    many.append(0)
                elif owners[seg] != keys[r]:  # rows come in order of id
                    many[seg] = 1
                places.append((seg, r, h, s))
        if not places:
            return _rows(fields, [])
        this = table["block"][0].as_py()
        # Column by column: neighbours differ little, so they compress well.
        out = [(-1 - this, this, _squeeze(np.ascontiguousarray(np.array(places, np.int32).T)), *[None] * 5)]
        dealt: dict[int, list[tuple[int, int, bytes]]] = {}
        for (route, text), seg in number.items():
            dealt.setdefault((route >> 7) % shards, []).append((seg, route, text))
        for shard, segs in dealt.items():
            ids, routes, texts = zip(*segs)
            out.append(
                (
                    shard,
                    this,
                    _squeeze(np.array(ids, np.int32)),
                    _squeeze((np.array(routes, np.uint64) >> np.uint64(32)).astype(np.uint32)),
                    _squeeze(np.array([len(t) for t in texts], np.int32)),
                    _squeeze(np.array([owners[i] for i in ids], np.int64)),
                    _squeeze(np.array([many[i] for i in ids], np.uint8)),
                    _squeeze(b"".join(texts)),
                )
            )
        return _rows(fields, out)

    return run


def _sort_shard(width: int, fields: pa.Schema):
    """Answers to blocks: (segment, first window, windows, smallest document) where a document could lose bytes."""

    def run(table: pa.Table) -> pa.Table:
        if table["dest"][0].as_py() < 0:
            return table.select(fields.names).cast(fields)
        distinct: dict[tuple[int, bytes], int] = {}
        owners: list[int] = []
        asked: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[int]]] = []
        for row in table.to_pylist():
            segs = np.frombuffer(_expand(row["segments"]), np.int32)
            routes = np.frombuffer(_expand(row["routes"]), np.uint32).tolist()
            ends = np.cumsum(np.frombuffer(_expand(row["sizes"]), np.int32)).tolist()
            own, text, at, mine = np.frombuffer(_expand(row["owners"]), np.int64), _expand(row["text"]), 0, []
            for route, end, owner in zip(routes, ends, own.tolist()):
                seg = distinct.setdefault((route, text[at:end]), len(owners))
                if seg == len(owners):
                    owners.append(owner)
                elif owner < owners[seg]:
                    owners[seg] = owner
                mine.append(seg)
                at = end
            asked.append((row["block"], segs, own, np.frombuffer(_expand(row["many"]), np.uint8), mine))
        texts = [text for _, text in distinct]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        own = np.array(owners, dtype=np.int64)
        # A run whose anchor no other distinct run has: its windows are where the run is.
        routes = np.array([route for route, _ in distinct], dtype=np.uint32)
        _, route, alike = np.unique(routes, return_inverse=True, return_counts=True)
        several = np.flatnonzero(alike[route] > 1)
        starts = np.cumsum(sizes[several]) - sizes[several]
        joined = np.frombuffer(b"".join(texts[i] for i in several), dtype=np.uint8)
        least = repeated_windows(joined, starts, own[several], width)
        answer: list[list[tuple[int, int, int]]] = [[(0, int(n - width + 1), int(o))] for n, o in zip(sizes, own)]
        for i, begin in zip(several.tolist(), starts.tolist()):
            values = least[begin : begin + int(sizes[i]) - width + 1]
            heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            lengths = np.diff(np.concatenate([heads, [len(values)]]))
            answer[i] = list(zip(heads.tolist(), lengths.tolist(), values[heads].tolist()))
        out = []
        for block, segs, local, many, mine in asked:
            found = [
                (seg, first, count, least_doc)
                for seg, owner, repeated, i in zip(segs.tolist(), local.tolist(), many.tolist(), mine)
                for first, count, least_doc in answer[i]
                if repeated or least_doc < owner
            ]
            if found:
                out.append((0, block, _squeeze(np.array(found, dtype=np.int64))))
        return _rows(fields, out)

    return run


def _cut(width: int, fields: pa.Schema, with_text: bool, carried: list[str]):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(fields, [])
        block = Block(table)
        marks = np.zeros(len(block.bytes) + 1, dtype=np.int32)
        if answers.num_rows:
            own = np.array(answers["dest"].to_pylist()) < 0
            places = _joined(answers.filter(pa.array(own)), "segments", np.int32).reshape(4, -1).T.astype(np.int64)
            found = _joined(answers.filter(pa.array(~own)), "segments", np.int64).reshape(-1, 4)
            found = found[np.argsort(found[:, 0], kind="stable")]
            low = np.searchsorted(found[:, 0], places[:, 0], side="left")
            n = np.searchsorted(found[:, 0], places[:, 0], side="right") - low
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit, place = found[np.repeat(low, n) + inside], np.repeat(places, n, axis=0)
            earlier = hit[:, 3] < block.keys[place[:, 1]]
            begin = (place[:, 2] + hit[:, 1])[earlier]
            np.add.at(marks, begin, 1)
            np.add.at(marks, begin + hit[earlier, 2] + width - 1, -1)
        gone = np.cumsum(marks[:-1]) > 0
        out = []
        for doc, body, raw, start, end in zip(block.ids, block.bodies, block.raw, block.starts.tolist(), block.ends.tolist()):
            mask = gone[start:end]
            removed = int(mask.sum())
            if removed:
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
            else:
                spans, kept = 0, raw
            row = (doc, body, len(raw), removed, spans, hashlib.sha256(kept).hexdigest())
            out.append((*row, _whole_characters(raw, mask) if removed else raw.decode()) if with_text else row)
        own = len(fields) - len(carried)
        done = _rows(pa.schema([fields.field(i) for i in range(own)]), out)
        for i, name in enumerate(carried):
            done = done.append_column(fields.field(own + i), table[name].take(block.order).cast(fields.field(own + i).type))
        return done

    return run


def _whole_characters(raw: bytes, gone: np.ndarray) -> str:
    """The text without the characters all of whose bytes are gone."""
    data = np.frombuffer(raw, np.uint8)
    letter = np.cumsum((data & 0xC0) != 0x80) - 1
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    lost = np.logical_and.reduceat(gone, heads)
    return data[~lost[letter]].tobytes().decode()


def remove_repeats(
    docs: DataFrame,
    width: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per document: (doc_id, body, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]).

    Removed is every byte covered by a string of width UTF-8 bytes that also starts in a document with a smaller
    doc_id, judged on the input. The first document with a passage keeps it; strings never cross documents, and
    rows with equal ids don't count against each other. n_spans counts maximal removed runs, body is a hash of
    the text. kept_text drops a
    character only if all its bytes are removed, so it stays valid UTF-8. A null text counts as empty; texts
    shorter than width lose nothing; a null doc_id counts as larger than any other. An empty table gives no rows;
    of other columns, those in carry
    reach the result under the names given there.
    """
    if width <= GRAM:
        raise ValueError(f"width must exceed {GRAM} bytes")
    carry = carry or {}
    slim = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        body_key(text_col).alias("body"),
        *[column.alias(name) for name, column in carry.items()],
    )
    total = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks, ranges = max(1, -(-total // BLOCK)), max(1, -(-total // RANGE))
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    # Three steps read the blocks; Spark runs the equal exchange once.
    dealt = max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_block = slim.withColumn("block", F.pmod(key, F.lit(blocks)).cast("int")).repartition(dealt, "block")
    anchors = by_block.groupBy("block").applyInArrow(_list_anchors(width, ranges, _arrow_schema(docs, ANCHORS)), ANCHORS)
    shared = anchors.groupBy("range").applyInArrow(_compare_anchors(_arrow_schema(docs, SHARED)), SHARED)
    send = _send_runs(width, ranges, blocks, _arrow_schema(docs, MESSAGES))
    sent = by_block.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, MESSAGES)
    answer_schema = "dest long, block int, segments binary"
    answers = sent.groupBy("dest").applyInArrow(_sort_shard(width, _arrow_schema(docs, answer_schema)), answer_schema)
    schema = "doc_id long, body long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    schema += "".join(f", `{name}` {slim.schema[name].dataType.simpleString()}" for name in carry)
    cut = _cut(width, _arrow_schema(docs, schema), with_text, list(carry))
    return by_block.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, schema)
