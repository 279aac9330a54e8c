"""Byte-level BPE by reduction of a monoid over a balanced tree of text segments.

An element is a segment's tokens; two neighbours are joined by encoding the window about their boundary again. A match of the
pattern holds white space only before all else or alone, and letters only behind one space or an apostrophe. So, whatever stands
further off, a match ends where white space follows something else, where a line break or tab is followed by something else, and
where a letter is followed by a mark. Tokens left of the last such place in the left segment, and right of the first one in the
right segment, cannot change, and the window runs between the two; where there is none within reach the window grows, at most to
the whole segments, and the join stays exact; a segment that has no such place at all is a leaf, as is every text where another
pattern is given. Joining is associative, so the tree's shape is free; the segments' size bounds what
one call of the encoder sees, and decoding concatenates up the same tree.

Edge cases: a null text is empty and has no tokens; ids may be null or repeat, each row stands for itself; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import ship, table

#: Characters of a leaf of the tree.
LEAF = 8192
#: Characters on each side of a boundary that the first window may hold.
REACH = 64
#: Where a match of the pattern always ends; each place is told by the two characters beside it. Letters and marks are such as all versions of Unicode agree on.
_EDGE = re.compile(r"(?<=\S)(?=[ \n\r\t])|(?<=[\n\r\t])(?=\S)|(?<=[A-Za-z\u4e00-\u9fa5\u3041-\u3096\u30a1-\u30fa\uac00-\ud7a3])(?=[.,;:!?\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


def ranks_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TreeEncoder:
    """Encodes and decodes texts by the ranks of a tiktoken file and a pattern that is matched piece by piece."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.inner = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = [0] * (max(ranks.values()) + 1)
        self.decimal = [""] * len(self.size)
        for token, k in ranks.items():
            self.size[k], self.decimal[k] = len(token), str(k)
        import public_tokenizers

        self.leaf = leaf if pattern == public_tokenizers.PATTERN else sys.maxsize  # the places are proved for this pattern; a text of another is one leaf

    def encode(self, text: str) -> list[int]:
        return self._reduced(text, 0, len(text))

    def _reduced(self, text: str, i: int, j: int) -> list[int]:
        if j - i <= self.leaf or not _EDGE.search(text, i + 1, j):  # without such a place, halves would only be encoded again as a whole
            return self.inner.encode_ordinary(text[i:j])
        m = (i + j) // 2
        return self._joined(text, i, m, j, self._reduced(text, i, m), self._reduced(text, m, j))

    def _joined(self, text: str, i: int, m: int, j: int, left: list[int], right: list[int]) -> list[int]:
        p, q = self._stable_left(text, i, m), self._stable_right(text, m, j)
        window = self.inner.encode_ordinary(text[p:q])
        return left[: len(left) - self._tokens(left, text[p:m], -1)] + window + right[self._tokens(right, text[m:q], 1) :]

    @staticmethod
    def _stable_left(text: str, i: int, m: int) -> int:
        reach = REACH
        while True:
            low, p = max(i + 1, m - reach), -1
            for found in _EDGE.finditer(text, low, m):
                p = found.start()
            if p >= 0:
                return p
            if low == i + 1:
                return i
            reach *= 4

    @staticmethod
    def _stable_right(text: str, m: int, j: int) -> int:
        found = _EDGE.search(text, m + 1, j)
        return found.start() if found else j

    def _tokens(self, ids: list[int], part: str, step: int) -> int:
        """How many tokens at an end of ``ids`` make up ``part``."""
        left, n = len(part.encode()), 0
        for k in reversed(ids) if step < 0 else ids:
            if not left:
                break
            left -= self.size[k]
            n += 1
        assert not left, "a stable place is a token's edge"
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.inner.decode_bytes(ids)
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])

    def decimals(self, ids: list[int]) -> str:
        if len(ids) < 2:
            return "".join(self.decimal[k] for k in ids)
        return ",".join(itemgetter(*ids)(self.decimal))


@cache
def tree_encoder(path: str, pattern: str, leaf: int = LEAF) -> TreeEncoder:
    """One for each Python worker."""
    return TreeEncoder(path, pattern, leaf)


def _digests(path: str, pattern: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tree_encoder(path, pattern, leaf)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = enc.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(enc.decimals(ids).encode()).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, pattern: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tree_encoder(path, pattern, leaf)
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: its ids may be many
                yield pa.record_batch([batch.column(0)[k : k + 1], pa.array([enc.encode(batch.column(1)[k].as_py() or "")], pa.list_(pa.int32()))], ["id", "ids"])

    return run


def _default(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or ranks_path(), pattern or public_tokenizers.PATTERN


def bpe_encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(id, ids) of every whole text."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_ids(*_default(path, pattern), leaf), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, then decoded."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digests(*_default(path, pattern), leaf), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))
