"""Quality rules by compression.

A text's zstandard ratio (bytes to compressed bytes) is taken over the whole
document and over fixed chunks of it.  Text that compresses far better than
prose is repetitive, text that hardly compresses is noise; how far it may go
depends on the length, since short texts compress less.  A document is rejected
if the whole breaks the band of its length, or if more than ``CHUNK_SHARE`` of its
chunks break the chunks' band.  The last chunk ends with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm._common import pieces_by_bytes, utf8_of
from strandweave.llm._words import runs, words_of

#: (bytes below which it holds, least ratio): between clean prose and random letters and digits.  Below 128 bytes the two cannot be told apart.
FLOORS = ((128, 0.0), (192, 1.0), (256, 1.12), (384, 1.18), (512, 1.25), (768, 1.32), (1024, 1.4), (1536, 1.52), (2048, 1.56), (4096, 1.6), (1 << 62, 1.7))
#: (bytes, largest ratio), on a line between them by the length's logarithm.  It lies above clean prose (1.5 to 2.8) and above prose of few syllables (2 at
#: 300 bytes, up to 3.6 at 1 KiB and 3.9 later).  So each word two or three times in a row passes, five times does not; four times lies about the line.
CEILINGS = ((128, 1.9), (192, 2.0), (256, 2.2), (384, 2.4), (512, 2.65), (768, 3.1), (1024, 3.6), (2048, 4.2), (4096, 4.2), (16384, 4.3), (65536, 4.4), (1 << 20, 4.5))
_CEILING_AT, _CEILING = np.log2([n for n, _ in CEILINGS]), [r for _, r in CEILINGS]
CHUNK = 4096
CHUNK_BAND = (1.65, 4.2)
#: Texts of more bytes a code point than this have a least ratio smaller by WIDE_FLOOR: words of a few letters from a large set look like noise.
WIDE, WIDE_FLOOR = 1.5, 1.3
CHUNK_SHARE = 0.5
LEVEL = 3
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, ratio double, chunk_low bigint, chunk_high bigint, n_chunks bigint"
)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
#: Every byte of UTF-8 but the continuation bytes begins a code point.
_BEGINS = (np.arange(256) & 0xC0) != 0x80
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(hashes: np.ndarray, first: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """For each text the number of words that lie in a window found twice or more in it."""
    counts = np.zeros(len(first) - 1, np.int64)
    if len(hashes) < width:
        return counts
    grams = runs(hashes, width)
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a <= width:
            continue
        own = grams[a : b - width + 1]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            continue
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(b - a + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(step, at, 1)
        np.add.at(step, at + width, -1)
        counts[i] = int((np.cumsum(step)[:-1] > 0).sum())
    return counts


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def compression(text: bytes, press: zstandard.ZstdCompressor) -> tuple[bool, float, int, int, int]:
    """Verdict, whole ratio, chunks below and above their band, number of chunks."""
    n = len(text)
    least = next(r for at, r in FLOORS if n < at)
    most = float(np.interp(np.log2(max(n, 1)), _CEILING_AT, _CEILING))
    whole = n / len(press.compress(text)) if n else 0.0
    # Scripts of two or three bytes a letter compress the better for it.
    wide = n / max(1, len(text.decode("utf-8", "replace")))
    floor = WIDE_FLOOR if wide > WIDE else 1.0
    low = high = chunks = 0
    if n > CHUNK:
        for at in range(0, n, CHUNK):
            at = min(at, n - CHUNK)
            ratio = CHUNK / len(press.compress(text[at : at + CHUNK]))
            chunks += 1
            low += ratio < CHUNK_BAND[0] / floor
            high += ratio > CHUNK_BAND[1] * wide
    good = least / floor <= whole <= most * wide
    return good and low + high <= CHUNK_SHARE * chunks, whole, low, high, chunks


def judge_batch(data: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
    found = words_of(data, offsets)
    n_words = np.diff(found.first)
    repeats = repeat_words(found.hashes(), found.first)
    out: dict[str, list] = {
        "n_words": n_words,
        "word_chars": _sums(_BEGINS[data] & ~_SPACE[data], offsets),
        "n_symbols": _sums(_IS_SYMBOL[data], offsets),
        "n_repeat_words": repeats,
    }
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    press = zstandard.ZstdCompressor(level=LEVEL)
    raw = data.tobytes()
    rows = []
    for i in range(len(offsets) - 1):
        text = raw[offsets[i] : offsets[i + 1]]
        rows.append((dup_lines(text), *compression(text, press)))
    dup, good, ratio, low, high, chunks = zip(*rows, strict=True) if rows else ((),) * 6
    return out | {
        "n_dup_lines": dup,
        "base_failed": failed,
        "kept": np.array(good, bool) & ~failed,
        "ratio": ratio,
        "chunk_low": low,
        "chunk_high": high,
        "n_chunks": chunks,
    }


def judge_quality(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with the rules' counts and verdict.

    Null and empty texts have no words and fail the base rules.  Repeated rows are
    judged alike.  Of clashing names, the columns made here win; the text column
    may not bear one of those names unless it is left out of ``keep``.
    """
    made = [f.split()[0] for f in SCHEMA.split(", ")]
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    frame = docs.select(*names, F.col(text_col).alias("_sw_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema] + [SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces_by_bytes(big, "_sw_text"):
                counts = judge_batch(*utf8_of(batch.column("_sw_text")))
                columns = [batch.column(c) for c in names]
                for f in SCHEMA.split(", "):
                    name, kind = f.split()
                    columns.append(pa.array(counts[name], {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[kind]))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *made])

    return frame.mapInArrow(run, schema)
