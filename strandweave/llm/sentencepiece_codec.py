"""SentencePiece BPE encoding by a prefix table, and decoding.

A byte-pair segmentation is valid exactly if every two neighbouring pieces are
compatible, that is, if their concatenation alone segments into those two.  So
each prefix of a text has one possible last piece: among the pieces that an
automaton finds ending there, the one compatible with the last piece of the
prefix before it.  One pass fills that table, and the ids are read off backwards.

No piece holds a space mark after another character, so a text falls into
independent stretches, each with its leading space marks.  Stretches repeat and are
remembered in a bounded cache, which a worker process keeps from task to task; the
new ones of a batch are run through the automaton together.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm._common import pieces_by_bytes

MARK = "▁"
#: Stretches remembered by a worker, in each of two generations, and code points of the longest one.
CACHE, CACHED_CHARS = 400_000, 64
#: Pairs remembered by a worker, and bits of the places of its table of pairs.
PAIRS, TABLE_BITS = 600_000, 20
#: Code points of the longest stretch that is encoded in step with others.
IN_STEP = 256
#: Bytes of text that are encoded together.
BATCH_BYTES = 2 << 20
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Codec:
    """Encoder and decoder for one SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str, cache: int = CACHE):
        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(MARK in piece.lstrip(MARK) for piece in self.score):
            raise ValueError("a piece of this model holds a space mark after another character")
        bytes_at = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_ids = [bytes_at[b] for b in range(256)]
        self.spelled = [b""] * n
        for i in plain:
            self.spelled[i] = model.id_to_piece(i).replace(MARK, " ").encode()
        for b, i in bytes_at.items():
            self.spelled[i] = bytes([b])
        # Pieces by number: those of the model, then characters that only occur within pieces; the last number is "no piece yet".
        chars = {c for piece in self.score for c in piece}
        self.pieces = [*self.score, *sorted(chars - set(self.score))]
        ids = dict(zip(self.score, plain, strict=True))
        self.packed = [ids[p].to_bytes(4, "little") if p in ids else self._fallback(p) for p in self.pieces]
        self.length = list(map(len, self.pieces))
        self.lengths, self.ids = np.array(self.length), np.array([ids.get(p, -1) for p in self.pieces])
        self.empty = len(self.pieces)
        self.automaton = ahocorasick.Automaton()
        for k, piece in enumerate(self.pieces):
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        self.unknown = re.compile("([^" + "".join(re.escape(c) for c in sorted(chars)) + "])")
        self.between = next(c for c in map(chr, range(0x110000)) if c not in chars)
        self.fits: dict[int, bool] = {}
        self.table, self.table_fits = np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(1 << TABLE_BITS, bool)
        self.limit, self.known, self.older = cache, {}, {}

    def _fallback(self, char: str) -> bytes:
        return np.array([self.byte_ids[b] for b in char.encode()], "<u4").tobytes()

    def _settles(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` ends in exactly these two parts (``left`` may be empty)."""
        parts, edge, score = list(left + right), len(left), self.score
        while len(parts) > 1:
            best, at, begin = None, 0, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            begin = sum(map(len, parts[:at]))
            if begin < edge < begin + len(parts[at]) + len(parts[at + 1]):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == ([left, right] if left else [right])

    def _learn(self, pair: int) -> bool:
        """Whether a pair of pieces is compatible; behind no piece, whether one may come first."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        left, right = divmod(pair, self.empty + 1)
        found = self.fits[pair] = self._settles("" if left == self.empty else self.pieces[left], self.pieces[right])
        return found

    def compatible(self, left: str, right: str) -> bool:
        number = {p: k for k, p in enumerate(self.pieces)}
        return self._learn((number[left] if left else self.empty) * (self.empty + 1) + number[right])

    def _fitting(self, pairs: np.ndarray) -> np.ndarray:
        """Which pairs are compatible: from a table with one place for each hash, behind it from what was learned."""
        with np.errstate(over="ignore"):
            at = ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out, miss = self.table_fits[at], np.flatnonzero(self.table[at] != pairs)
        if len(miss):
            fits, learn = self.fits, self._learn
            each, back = np.unique(pairs[miss], return_inverse=True)
            found = np.array([learn(p) if (fit := fits.get(p)) is None else fit for p in each.tolist()], bool)
            out[miss] = found[back]
            self.table[at[miss]], self.table_fits[at[miss]] = pairs[miss], out[miss]
        return out

    def _long(self, text: str) -> bytes:
        """Packed ids of one text of known characters."""
        last, empty, width = [-1] * (len(text) + 1), self.empty, self.empty + 1
        last[0] = empty
        fits, learn, length = self.fits, self._learn, self.length
        for end, piece in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                left = last[end - length[piece]]
                if left >= 0:
                    pair = left * width + piece
                    fit = fits.get(pair)
                    if fit or (fit is None and learn(pair)):
                        last[end] = piece
        at, ids = len(text), []
        while at:
            piece = last[at]
            assert 0 <= piece < empty
            ids.append(self.packed[piece])
            at -= length[piece]
        return b"".join(reversed(ids))

    def _segments(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text of known characters; the tables of all short ones are filled in step, by length of prefix."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        if len(texts) and size.max() > IN_STEP:
            short = iter(self._segments([t for t in texts if len(t) <= IN_STEP]))
            return [next(short) if len(t) <= IN_STEP else self._long(t) for t in texts]
        matches = np.fromiter(chain.from_iterable(self.automaton.iter(self.between.join(texts))), np.int64)
        end, piece = matches[::2] + 1, matches[1::2]
        begin = end - self.lengths[piece]
        start = np.cumsum(size + 1) - (size + 1)
        # Places 0 to len(text) of each text follow each other; the first stands for no piece.
        depth = (end - np.repeat(start, size + 1)[end]).astype(np.uint16)
        order = np.argsort(depth, kind="stable")
        upto = np.cumsum(np.bincount(depth, minlength=1))
        last = np.full(int((size + 1).sum()), -1, np.int64)
        last[start] = self.empty
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            now = order[a:b]
            left = last[begin[now]]
            now, left = now[left >= 0], left[left >= 0]
            now = now[self._fitting(left * (self.empty + 1) + piece[now])]
            last[end[now]] = piece[now]
        at, open_, steps = start + size, np.flatnonzero(size), []
        while len(open_):
            held = last[at[open_]]
            assert (held >= 0).all()
            steps.append((open_, held))
            at[open_] -= self.lengths[held]
            open_ = open_[at[open_] > start[open_]]
        if not steps:
            return [b""] * len(texts)
        text = np.concatenate([t for t, _ in steps])
        order = np.lexsort((-np.repeat(np.arange(len(steps)), [len(t) for t, _ in steps]), text))
        held = np.concatenate([h for _, h in steps])[order]
        ids = self.ids[held]
        bound = [0, *np.cumsum(np.bincount(text, minlength=len(texts))).tolist()]
        raw = np.maximum(ids, 0).astype("<u4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
        for i in np.unique(text[order][ids < 0]).tolist():
            out[i] = b"".join(self.packed[p] for p in held[bound[i] : bound[i + 1]].tolist())
        return out

    def stretches(self, keys: list[str]) -> list[bytes]:
        """Packed ids of the stretches that ``keys`` make behind one space mark."""
        split, segments = [], []
        for key in keys:
            text = MARK + key
            parts = [text] if self.unknown.search(text) is None else self.unknown.split(text)
            split.append(parts)
            segments += [p for p in parts[::2] if p]
        found = iter(self._segments(segments))
        return [b"".join([self._fallback(p) if i % 2 else next(found) if p else b"" for i, p in enumerate(parts)]) for parts in split]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without begin and end."""
        split = []
        for text in texts:
            if not text:
                split.append([])
            elif "  " in text or text[0] == " " or MARK in text:
                split.append([s[1:] for s in _STRETCH.findall(MARK + text.replace(" ", MARK))])
            else:
                split.append(text.split(" "))
        if len(self.known) >= self.limit:  # what was not asked for since is forgotten
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set().union(*split) - known.keys()
        again = new & older.keys()
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        new = list(new - again)
        known.update(zip(new, self.stretches(new), strict=True))
        out = [b"".join(map(known.__getitem__, keys)) for keys in split]
        for key in new:
            if len(key) > CACHED_CHARS:
                del known[key]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def with_ends(self, ids: bytes) -> bytes:
        return self.bos.to_bytes(4, "little") + ids + self.eos.to_bytes(4, "little")

    def decode(self, ids: bytes) -> str:
        """What the library's ``decode`` gives for these ids."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.spelled.__getitem__, numbers))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return self.model.decode(numbers)
        return text[1:] if text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """The codec that a worker process keeps."""
    return Codec(path)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit,
    with begin and end ids) and ``decoded``.

    Null text counts as empty and has the two end ids only.  Rows with a null or
    repeated id are encoded like any others.  Columns of ``docs`` other than these
    two are not used.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for big in batches:
            for batch in pieces_by_bytes(big, "_sw_text", BATCH_BYTES):
                ids = [codec.with_ends(x) for x in codec.encode_batch([text or "" for text in batch.column(1).to_pylist()])]
                decoded = [codec.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col(id_col), F.col(text_col).alias("_sw_text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary, decoded string")
