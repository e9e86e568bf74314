"""Packing: best-fit decreasing into fixed windows, with a segment tree indexed by remaining capacity.

``cut_documents`` turns each text into token ids and cuts overlong documents into full windows; what is left of a
document is one piece that is shorter than a window.  ``place`` deals the pieces into groups of bounded size and packs
each group by itself: the pieces go by falling length, each into the open window that it leaves the least room in.
A group leaves at most a window or so of padding more than one packing of everything would.

Defined cases: a null or empty text is the end id alone; rows that repeat are packed as often; an empty table gives no
pieces.  Columns besides those that are named here are kept by ``place``, but for sequence_id and offset, which the
results replace.  Pieces that agree in all columns are of one group.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, documents

WINDOW = 2048
END_ID = 1
#: The special token of the vocabulary file; in a text it is one id.
END_OF_TEXT = "<|endoftext|>"
#: Documents that are packed together, about.
GROUP_DOCS = 20_000
#: Tokens that one row batch of pieces may hold.
BATCH_TOKENS = 1_000_000


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level BPE of a rank file, whose end-of-text token follows the last rank.  ``encode_ordinary`` reads it as text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


def cut_documents(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, ranks: str | None = None) -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit)."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(path)
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                ids = np.array([*coder.encode(text if isinstance(text, str) else "", allowed_special="all"), end_id], dtype="<u4")
                rows += [(doc_id, at, min(window, len(ids) - at), len(ids), ids[at : at + window].tobytes()) for at in range(0, len(ids), window)]
                held += len(ids)
                if held >= BATCH_TOKENS:
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


class OpenWindows:
    """Open windows by remaining capacity; a segment tree finds the least capacity that suffices."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, window: int, capacity: int) -> None:
        self.at[capacity].append(window)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes the tightest window that holds ``length``: its number and capacity."""
        node = length + self.size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return self.at[capacity].pop(), capacity


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; the lengths fall."""
    open_, windows, offsets, n = OpenWindows(window), [], [], 0
    for length in lengths:
        found = open_.take(length) if length < window else None
        if found is None:
            found, n = (n, window), n + 1
        number, capacity = found
        windows.append(number)
        offsets.append(window - capacity)
        if capacity > length:
            open_.put(number, capacity - length)
    return windows, offsets


def place(pieces: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """``pieces`` (doc_id, start, length and any more columns) with sequence_id and offset."""
    pieces = pieces.drop("sequence_id", "offset")
    own = next(name for n in count() if (name := f"group_{n}") not in pieces.columns)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        windows, offsets = best_fit(part["length"].tolist(), window)
        group = part.pop(own).iloc[0]
        return part.assign(sequence_id=np.array(windows, dtype="int64") * groups + group, offset=np.array(offsets, dtype="int64"))

    # by all columns that a piece has, so that many documents under one id, or under none, go to many groups
    dealt = pieces.withColumn(own, F.pmod(F.xxhash64(*pieces.columns), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy(own).applyInPandas(pack, f"{schema}, sequence_id long, offset long")


def group_count(docs: DataFrame) -> int:
    return max(1, -(-docs.count() // GROUP_DOCS))


def crc32_of(ids: Column) -> Column:
    return F.crc32(ids)


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, ranks: str | None = None) -> DataFrame:
    """All pieces of ``docs`` with their ids and places."""
    return place(cut_documents(docs, window, end_id, ranks), group_count(docs), window)


def packed_digests(docs: DataFrame) -> DataFrame:
    """As ``pack``, with a checksum in place of the ids."""
    pieces = cut_documents(docs).select("doc_id", "start", "length", crc32_of(F.col("ids")).alias("ids_crc32"), "doc_tokens")
    return place(pieces, group_count(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark, 256)
    return packed_digests(documents(spark, sf_dir))
