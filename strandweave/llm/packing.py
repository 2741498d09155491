"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Documents longer than a window are first cut into full windows; what remains of
each is one piece.  The pieces of one packing group are taken from the longest to
the shortest, and each goes to the open window with the least sufficient room,
which a segment tree indexed by remaining capacity finds in a logarithm of the
window size.  Groups are hash ranges of bounded size, so packing is spread over
as many tasks as there are groups; each group leaves a few windows unfilled.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandweave.llm._common import cut, pieces_by_bytes

WINDOW = 2048
#: About so many documents are packed together by one task.
GROUP_DOCS = 20_000
END_ID = 1


class RoomTree:
    """Multiset of open windows by remaining room, for the least room that suffices."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) with the least room of at least ``need``."""
        count, at = self.count, need + self.size
        if not count[at]:
            # Up to the first left child whose right sibling has windows, then down that sibling.
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        window = self.open[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece, and the number of windows."""
    tree, windows = RoomTree(capacity), 0
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        if need == capacity:
            place[i], offset[i], windows = windows, 0, windows + 1
            continue
        room, window = tree.take(need) or (capacity, windows)
        windows += window == windows
        place[i], offset[i] = window, capacity - room
        if room > need:
            tree.add(room - need, window)
    return place, offset, windows


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Function from text to an array of unsigned 32-bit ids for a byte-level BPE of the tokenizers library.

    The merges are run by tiktoken with the ranks read from the same file, which
    gives the same ids about five times as fast.  The file's added tokens are found in
    a text before all else, as the library does whether or not it is to add special
    tokens of its own; those with flags that widen or narrow the match are refused.
    The pattern's matcher gives up on several 100,000 characters of white space in a row;
    texts with such a run are encoded by the tokenizers library itself.  A worker process
    keeps the encoder.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if any(t.get(k) for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or file["normalizer"]:
        raise ValueError("only plain added tokens and no normalizer are known here")
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added and all(c in to_byte for c in token)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    whole = functools.cache(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(whole().encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def pieces_of(ids: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of full windows and the remainder."""
    raw = ids.astype("<u4", copy=False).tobytes()
    return [(a, min(window, len(ids) - a), zlib.crc32(raw[4 * a : 4 * (a + window)])) for a in range(0, len(ids), window)]


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32 and doc_tokens."""
    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(F.col(id_col), F.col(text_col).alias("_sw_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in (piece for big in batches for piece in pieces_by_bytes(big, "_sw_text")):
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                rows += [(i, *p, len(ids)) for p in pieces_of(ids, window)]
            at, *rest = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, rest)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])

    return frame.mapInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece of each document, with its place.

    Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A
    document's ids are those of its text followed by the end id; a null text is
    empty and has that id alone.  Repeated rows and null ids are packed like any
    others, so a row's group follows from its place in the partitions: the same rows
    in another layout have the same pieces, but may share sequences with other ones.
    An empty table gives an empty one.  Columns of ``docs`` other than these two are not used.
    """
    pieces = cut(tokenised_pieces(docs, tokenizer, id_col, text_col, window))
    groups = max(1, -(-pieces.count() // group_docs))
    # By row, not by id: rows that repeat are dealt out like any others.
    placed = pieces.withColumn("_sw_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("bigint"))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", id_col, "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        place, offset, _ = best_fit_decreasing(frame["length"].to_numpy(), window)
        out = frame[names].copy()
        out["sequence_id"] = (int(frame["_sw_group"].iloc[0]) << 32) + place
        out["offset"] = offset
        return out

    return placed.groupBy("_sw_group").applyInPandas(
        run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
