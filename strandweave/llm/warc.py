"""WARC archives, and a fixity audit of replicas by Merkle trees over ranges of offsets.

Records lie one behind the other in archives.  A record's place is the archive and
the byte offset at which it starts.  The records that start within ``RANGE_BYTES`` of
an archive make a range, whose hash is that of their offsets, lengths and SHA-256 in
order; ``FANOUT`` consecutive nodes make one of the level above, up to the archive's root, in
as many levels as the longest archive needs.  Every node has at most ``FANOUT`` children, so none
gathers an archive.  The nodes of both replicas are built once.  Roots are compared first, then
level by level the children of nodes that differ, and only the records of differing ranges, so
an intact archive costs one comparison.  Offsets are hashed too, so records that moved or were
padded are found.
"""

from __future__ import annotations

import itertools
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm._common import cut

FANOUT = 16
RANGE_BYTES = 64 << 10
#: A record that starts beyond this many bytes goes to the next archive.
ARCHIVE_BYTES = RANGE_BYTES * FANOUT * FANOUT
_MAGIC = "WARC/1.0\r\n"
#: What the first line of every record begins with, whatever the version.
_SEPARATOR = "WARC/1."
_FIRST_LINE = re.compile(rb"WARC/1\.\d\r\n")
#: Bytes of records that the reader passes on at a time.
BATCH_BYTES = 4 << 20
#: A record whose head announces more than this counts as truncated.
RECORD_BYTES = 1 << 30
_LENGTH = re.compile(rb"^Content-Length: *(\d{1,18}) *\r?$", re.I | re.M)
_ID = re.compile(rb"^WARC-Record-ID: *<?([^>\r\n]*)>? *\r?$", re.I | re.M)
_OWN_ID = re.compile(r"urn:page:(-?\d{1,18})")
_URL = re.compile(rb"^WARC-Target-URI: *([^\r\n]*)", re.I | re.M)


def record(id_: Column, url: Column, payload: Column) -> Column:
    """A WARC resource record as text; nulls are empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit(_MAGIC + "WARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(id_.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def hashed(records: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """Columns id, length (bytes) and sha256 of each record."""
    return records.select(F.col(id_col).alias("id"), F.octet_length(record_col).cast("bigint").alias("length"), F.sha2(F.col(record_col).cast("binary"), 256).alias("sha256"))


def lay_out(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``records`` (with id, length, sha256 and any other columns) with ``archive`` and ``offset``.

    Records follow each other by id (nulls first), then hash; a record starts in the archive that its distance
    from the first one names, and offsets count from the archive's first record.  Rows that repeat
    lie one behind the other.  Records are sorted by range partition, and only the bytes of each
    partition are passed on.  Of clashing names, the columns made here win.
    """
    order = ["id", "sha256", "_sw_tie"]
    base = cut(records.drop("archive", "offset")).withColumn("_sw_tie", F.xxhash64(F.monotonically_increasing_id()))
    parts = cut(base.repartitionByRange(*order).withColumn("_sw_part", F.spark_partition_id()))
    # One row for each partition.
    before = F.sum("bytes").over(Window.orderBy("_sw_part").rowsBetween(Window.unboundedPreceding, -1))
    carry = parts.groupBy("_sw_part").agg(F.sum("length").alias("bytes")).select("_sw_part", F.coalesce(before, F.lit(0)).alias("_sw_before"))
    inner = F.sum("length").over(Window.partitionBy("_sw_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.withColumn("_sw_inner", F.coalesce(inner, F.lit(0))).join(F.broadcast(carry), "_sw_part").withColumn("_sw_start", F.col("_sw_before") + F.col("_sw_inner"))
    placed = placed.withColumn("archive", F.floor(F.col("_sw_start") / archive_bytes).cast("bigint"))
    placed = placed.withColumn("offset", F.col("_sw_start") - F.min("_sw_start").over(Window.partitionBy("archive")))
    return cut(placed.drop("_sw_tie", "_sw_part", "_sw_before", "_sw_inner", "_sw_start"))


def write_archives(records: DataFrame, path: str, column: str = "record") -> None:
    """Writes records (archive, offset and ``column``) one behind the other, a folder with one file for each archive.

    The writer's line separator is the two line ends that close every record.
    """
    body = F.expr(f"substring(`{column}`, 1, length(`{column}`) - 4)")
    dealt = records.repartition("archive").sortWithinPartitions("archive", "offset")
    dealt.select("archive", body.alias(column)).write.partitionBy("archive").option("lineSep", "\r\n\r\n").text(path)


def frames(segments: Iterator[bytes]) -> Iterator[tuple[int, bytes, int, str | None]]:
    """Offset, bytes, start of the payload in them and flaw of each record of an archive; together they cover all of its bytes.

    ``segments`` are the archive cut before each ``WARC/1.``.  Records are framed by their Content-Length, so a payload may hold
    anything.  Where that does not lead to the record's closing line ends, the record is ``truncated`` and ends before the
    next first line of a record; bytes that no record's head begins are ``garbage``.  Beyond one record, nothing is held.
    """
    ahead: deque[bytes] = deque()

    def taken() -> bytes | None:
        return ahead.popleft() if ahead else next(segments, None)

    at = 0
    while (own := taken()) is not None:
        # What does not begin a record belongs to what is before it.
        parts = [own]
        while (more := taken()) is not None and not _FIRST_LINE.match(more):
            parts.append(more)
        if more is not None:
            ahead.appendleft(more)
        own = b"".join(parts)
        if not own:
            continue
        head = own.find(b"\r\n\r\n") if _FIRST_LINE.match(own) else -1
        length = _LENGTH.search(own, 0, head + 2) if head >= 0 else None
        body, flaw = (head + 4, "truncated") if length else (0, "garbage")
        if length and int(length[1]) <= RECORD_BYTES:
            end = body + int(length[1]) + 4
            whole, size = [own], len(own)
            while size < end and (more := taken()) is not None:
                whole.append(more)
                size += len(more)
            joined = b"".join(whole)
            if joined[end - 4 : end] == b"\r\n\r\n":
                own, flaw = joined[:end], None
                if joined[end:]:
                    ahead.appendleft(joined[end:])
            else:
                ahead.extendleft(reversed(whole[1:]))
        yield at, own, body, flaw
        at += len(own)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, plain or compressed by gzip (one member or many), of any size.

    Columns: archive (of the folder ``archive=...``, else the path), offset (of a compressed archive: in what it holds), record_id (what stands in
    the head's WARC-Record-ID without its brackets), id (the number in an id that ``record`` made, else null), url, record (binary), payload
    (binary) and flaw, null for a sound record; see ``frames``.  Flawed ones are returned like the others.  A record is a row, so
    one of more than ``RECORD_BYTES`` counts as truncated.  An archive is read in parts, which one task puts together again as they
    stream by; a first line that ends a compressed archive without anything behind it is not seen.
    """
    # Spark cuts the files before each separator, which it takes out.
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", _SEPARATOR).text(path)
    cut_up = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("n"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"),
    )
    dealt = cut_up.repartition("path").sortWithinPartitions("path", "part", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("path", "offset", "record_id", "id", "url", "record", "payload", "flaw")
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string())
        said = lambda found: found[1].decode("utf-8", "replace") if found else None

        def segments(lines: Iterator[tuple[str, int, bytes]]) -> Iterator[bytes]:
            """One file's bytes, each separator before what it begins."""
            total, size, compressed = -len(_SEPARATOR), 0, False
            for name, size, value in lines:
                compressed = name.endswith(".gz")
                yield value if total < 0 else _SEPARATOR.encode() + value
                total += len(_SEPARATOR) + len(value)
            if not compressed and 0 <= total < size:
                yield _SEPARATOR.encode()

        rows = ((name, size, value.as_py()) for batch in batches for name, size, value in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), batch.column("value"), strict=True))
        for name, lines in itertools.groupby(rows, key=lambda r: r[0]):
            out, held = [], 0
            for at, data, body, flaw in frames(segments(lines)):
                head = data[:body]
                record_id = said(_ID.search(head))
                own = _OWN_ID.fullmatch(record_id or "")
                payload = data[body : len(data) if flaw else -4] if body else b""
                out.append((name, at, record_id, int(own[1]) if own else None, said(_URL.search(head)), data, payload, flaw))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    found = dealt.mapInArrow(run, "path string, offset bigint, record_id string, id bigint, url string, record binary, payload binary, flaw string")
    named = F.regexp_extract("path", "/archive=([^/]*)/[^/]*$", 1)
    return found.select(F.when(named != "", named).otherwise(F.col("path")).alias("archive"), "offset", "record_id", "id", "url", "record", "payload", "flaw")


def leaves(read: DataFrame, id_col: str = "id") -> DataFrame:
    """Columns archive, offset, length, sha256 and id of records with ``archive`` and ``offset``."""
    return read.select("archive", "offset", F.octet_length("record").cast("bigint").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("sha256"), F.col(id_col).alias("id"))


def _digest(children: Column, text) -> Column:
    return F.sha2(F.array_join(F.transform(children, text), ";"), 256)


def ranges_of(records: DataFrame, keys: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lowest nodes (keys, node, hash) of leaves."""
    at = F.floor(F.col("offset") / range_bytes).cast("bigint").alias("node")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "sha256")))
    return records.groupBy(*keys, at).agg(_digest(ordered, lambda r: F.concat_ws(":", r.offset.cast("string"), r.length.cast("string"), r.sha256)).alias("hash"))


def level_above(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of which each has at most ``FANOUT`` of ``nodes`` as children."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    parent = F.shiftright("node", FANOUT.bit_length() - 1).alias("node")
    return nodes.groupBy(*keys, parent).agg(_digest(children, lambda c: F.concat_ws(":", c.node.cast("string"), c.hash)).alias("hash"))


def tree(records: DataFrame, keys: list[str], range_bytes: int = RANGE_BYTES) -> list[DataFrame]:
    """Levels of nodes (keys, node, hash), from ranges to roots, each written down; the driver sees only the largest node number."""
    levels = [cut(ranges_of(records, keys, range_bytes))]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last:
        levels.append(cut(level_above(levels[-1], keys)))
        last //= FANOUT
    return levels


def mismatches(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Places (archive, offset) whose records differ, and the fault of the right side.

    ``missing``: nothing starts there; ``corrupt``: another record does; ``moved``: one of the two, but the record
    stands elsewhere in the archive, where the left side has another; ``extra``: only the right side has one.
    """
    sides = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))

    def compared(found: DataFrame) -> DataFrame:
        by_side = [F.max(F.when(F.col("side") == k, F.col("hash"))).alias(f"h{k}") for k in (0, 1)]
        return found.groupBy("archive", "node").agg(*by_side).where(~F.col("h0").eqNullSafe(F.col("h1"))).select("archive", "node")

    *below, roots = tree(sides, ["archive", "side"], range_bytes)
    ranges = compared(roots)
    for nodes in reversed(below):
        parents = ranges.withColumnRenamed("node", "parent")
        ranges = compared(nodes.withColumn("parent", F.shiftright("node", FANOUT.bit_length() - 1)).join(parents, ["archive", "parent"], "left_semi"))
    ranges = cut(ranges)
    near = sides.withColumn("node", F.floor(F.col("offset") / range_bytes).cast("bigint")).join(ranges, ["archive", "node"], "left_semi")
    what = F.struct("length", "sha256")
    found = near.groupBy("archive", "offset").agg(
        F.max(F.when(F.col("side") == 0, what)).alias("own"), F.min(F.when(F.col("side") == 1, what)).alias("lo"), F.max(F.when(F.col("side") == 1, what)).alias("hi")
    )
    found = cut(found.where(~(F.col("own").eqNullSafe(F.col("lo")) & F.col("own").eqNullSafe(F.col("hi")))))
    stray = found.select("archive", F.explode(F.array("lo", "hi")).alias("own")).where("own is not null").distinct().withColumn("_sw_stray", F.lit(True))
    fault = F.when(F.col("own").isNull(), "extra").when(F.col("_sw_stray"), "moved").when(F.col("hi").isNull(), "missing").otherwise("corrupt")
    return found.join(stray, ["archive", "own"], "left").select("archive", "offset", fault.alias("fault"))


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The primary's leaves (archive, offset, length, sha256, id) with ``status``: ``intact`` or the fault found in the replica.

    Both sides are leaves, as ``lay_out`` or ``leaves`` give them; ``extra`` records of the replica have no row.
    Rows with a null id or an id that repeats have places of their own and are judged like any others.  An
    empty primary gives an empty table; against an empty replica everything is ``missing``.  Records of any
    length are one leaf.  Columns other than these five are not used.
    """
    names = ["archive", "offset", "length", "sha256", "id"]
    primary, replica = primary.select(*names), replica.select(*names)
    faults = mismatches(primary, replica, range_bytes)
    return primary.join(faults, ["archive", "offset"], "left").select(*names, F.coalesce("fault", F.lit("intact")).alias("status"))
