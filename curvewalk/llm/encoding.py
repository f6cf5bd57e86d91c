"""Exact byte-pair ids of whole texts by per-prefix dynamic programming, and their text back."""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame

from curvewalk.llm.bpe import Tokenizer, _Memory, tokenizer
from curvewalk.llm.tables import id_and_text, map_columns


class Coder:
    """Encodes and decodes with one vocabulary, remembering chunks."""

    def __init__(self, vocabulary: Tokenizer):
        self.vocabulary = vocabulary
        self.known = _Memory(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        return _little_endian(self.vocabulary.chunk_ids(chunk))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, parts = self.known, []
        for piece, special in self.vocabulary.pieces(text):
            if special is not None:
                parts.append(_little_endian([special]))
            else:
                parts += map(known.__getitem__, self.vocabulary.chunks(piece))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def _little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if out.itemsize != 4:
        raise RuntimeError("this platform's unsigned int isn't 32 bits wide")
    return out.tobytes()


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    return Coder(tokenizer(path))


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text. A null or empty text has no ids. Other columns are ignored."""

    def run(doc_id, text) -> dict:
        code = coder(vocabulary)
        return {"doc_id": doc_id, "ids": [list(memoryview(code.encode(t)).cast("I")) for t in text.to_pylist()]}

    return map_columns(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids array<int>); null ids give a null text."""

    def run(doc_id, ids) -> dict:
        code = coder(vocabulary)
        return {"doc_id": doc_id, "text": [None if x is None else code.decode(_little_endian(x)) for x in ids.to_pylist()]}

    return map_columns(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids and the text decoded from them, as digests.

    One row per input row, repeated ids and texts included; a null text counts as empty, an empty one has
    no ids and the digests of nothing. Very long words take time in proportion to their length.
    """

    def run(doc_id, text) -> dict:
        code, counts, ids_sha, text_sha = coder(vocabulary), [], [], []
        for t in text.to_pylist():
            ids = code.encode(t)
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(code.decode(ids).encode("utf-8")).hexdigest())
        return {"doc_id": doc_id, "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_columns(id_and_text(docs, id_col, text_col), run, schema)
