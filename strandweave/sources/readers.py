"""Readers.  Schemas are given, not inferred; bad input raises."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from strandweave.errors import IntegrityError, SchemaError
from strandweave.operators.ordered import positions
from strandweave.schema import edge_columns, normalised_ids


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet shards with only the wanted columns; unsigned ids become bigint."""
    df = spark.read.parquet(path)
    return normalised_ids(df.select(*columns) if columns else df)


def edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """An edge table under whichever aliases its header uses."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    return edge_columns(raw)


def view(spark: SparkSession, name: str, path: str) -> DataFrame:
    df = parquet(spark, path)
    df.createOrReplaceTempView(name)
    return df


def trace_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, an empty trace is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise IntegrityError(f"{path} holds no trace")
    return df


def numbers(spark: SparkSession, path: str, header: bool = False, scale: float = 1.0) -> DataFrame:
    """(line, value) of a text file with one number to a line; anything else is an error."""
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("_row", F.monotonically_increasing_id())
    rows = positions(raw, ["file_path", "file_block_start", "_row"], "line").select(F.col("line").cast("int").alias("line"), F.regexp_replace("value", "\r$", "").alias("text")).where("trim(text) <> ''")
    rows = rows.where("line > 0") if header else rows
    found = rows.select("line", F.trim("text").alias("text"), F.expr("try_cast(trim(text) AS double)").alias("value"))
    bad = found.where("value IS NULL").limit(1).collect()
    if bad:
        raise IntegrityError(f"line {bad[0]['line']}: {bad[0]['text']!r} is not a number")
    return found.select("line", (F.col("value") * scale).alias("value"))


def matrix(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(line, column, value) of a text file with numbers in columns, as many in each line; anything else is an error."""
    raw = spark.read.text(path).where("trim(value) <> ''").select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("_row", F.monotonically_increasing_id())
    lines = positions(raw, ["file_path", "file_block_start", "_row"], "line")
    cells = F.split(F.regexp_replace("value", "\r$", ""), re.escape(separator), -1)
    found = lines.select("line", F.size(cells).alias("_n"), F.posexplode(cells).alias("column", "_text")).select("line", "_n", "column", F.expr("try_cast(trim(_text) AS double)").alias("value"))
    bad = found.agg(F.min("_n").alias("least"), F.max("_n").alias("most"), F.min(F.when(F.col("value").isNull(), F.col("line"))).alias("line")).first()
    if bad["line"] is not None:
        raise IntegrityError(f"line {bad['line']} holds something that is not a number")
    if bad["least"] != bad["most"]:
        raise IntegrityError(f"lines of {bad['least']} and of {bad['most']} columns")
    return found.select("line", "column", "value")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, digest, bytes) of files: name, SHA-256 of the stored bytes, and their number, a file in a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("artifact"), F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))


def swc(spark: SparkSession, path: str) -> DataFrame:
    """(file, node, kind, x, y, z, radius, parent) of SWC trees; comments and blank lines are skipped."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("v")).where("v <> '' AND v NOT LIKE '#%'")
    p = F.split("v", "\\s+")
    kinds = ("bigint", "int", "double", "double", "double", "double", "bigint")
    names = ("node", "kind", "x", "y", "z", "radius", "parent")
    return raw.select("file", *[F.get(p, F.lit(i)).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])


def swc_faults(tree: DataFrame) -> DataFrame:
    """(file, node, fault): repeated nodes, parents that do not exist, radii that are not positive, nodes on or above a cycle.

    A skeleton's file is one group for the last.
    """

    def cycles(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, parent = frame["node"].to_numpy(), frame["parent"].to_numpy()
        order = np.argsort(nodes, kind="stable")
        at = np.minimum(np.searchsorted(nodes[order], parent), len(nodes) - 1)
        known = nodes[order][at] == parent
        up = np.where(known, order[at], -1)
        for _ in range(len(nodes).bit_length()):  # twice as far up each time
            up = np.where(up >= 0, up[up], -1)
        bad = nodes[up >= 0]
        text = lambda x: pd.Series([x] * len(bad), dtype=object)
        return pd.DataFrame({"file": text(frame["file"].iloc[0]), "node": bad, "fault": text("cycle")})

    nodes = tree.select("file", F.col("node").alias("parent"))
    lost = tree.where("parent <> -1").join(nodes, ["file", "parent"], "left_anti").select("file", "node", F.lit("parent").alias("fault"))
    twice = tree.groupBy("file", "node").count().where("count > 1").select("file", "node", F.lit("repeated").alias("fault"))
    thin = tree.where("radius <= 0").select("file", "node", F.lit("radius").alias("fault"))
    ring = tree.where("node is not null and parent is not null").groupBy("file").applyInPandas(cycles, "file string, node bigint, fault string")
    return lost.unionByName(twice).unionByName(thin).unionByName(ring)


def _cell_column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_rows(content: bytes, sheet: str | None = None) -> list[list[str]]:
    """A worksheet as a dense grid of texts, by the standard library alone; the first sheet by default."""
    main, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(main + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(main + "si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(rel + "id")] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(main + "sheet")}
        if sheet is not None and sheet not in sheets:
            raise SchemaError(f"no sheet {sheet!r}; found {', '.join(sheets)}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        tree = ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/")))
    grid: list[list[str]] = []
    for row in tree.iter(main + "row"):
        values: dict[int, str] = {}
        for cell in row.iter(main + "c"):
            v = cell.find(main + "v")
            text = "".join(t.text or "" for t in cell.iter(main + "t")) if cell.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
            values[_cell_column(cell.get("r"))] = shared[int(text)] if cell.get("t") == "s" and text else text
        grid.append([values.get(i, "") for i in range(max(values, default=-1) + 1)])
    return grid


def xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(file, row, cells) of workbooks, one task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grid = xlsx_rows(content, sheet)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grid)), pa.array(range(len(grid)), pa.int32()), pa.array(grid, pa.list_(pa.string()))], names=["file", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row int, cells array<string>")


def zip_member_csv(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(file, row, cells) of one CSV member of zip archives; it must be there exactly once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [n for n in z.namelist() if n == member or n.endswith("/" + member)]
                    if len(found) != 1:
                        raise IntegrityError(f"{name}: {len(found)} members named {member}")
                    grid = list(csv.reader(io.StringIO(z.read(found[0]).decode())))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grid)), pa.array(range(len(grid)), pa.int32()), pa.array(grid, pa.list_(pa.string()))], names=["file", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row int, cells array<string>")


def _plain(schema: pa.Schema) -> pa.Schema:
    """Unsigned integers become 64-bit ones and dictionaries their values."""
    kind = lambda t: pa.int64() if pa.types.is_unsigned_integer(t) else t.value_type if pa.types.is_dictionary(t) else t
    return pa.schema([pa.field(f.name, kind(f.type), f.nullable) for f in schema])


def _tables(spark: SparkSession, path: str, columns: list[str] | None, opened: Callable[[bytes, list[str] | None], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows of files that ``opened`` turns into record batches, a file in a task; only Spark touches the store."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def schema(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                first = next(opened(content.as_py(), columns))
                yield pa.RecordBatch.from_arrays([pa.array([_plain(first.schema).serialize().to_pybytes()])], names=["schema"])

    found = files.mapInArrow(schema, "schema binary").first()
    if found is None:
        raise IntegrityError(f"{path} holds no file")
    plain = pa.ipc.read_schema(pa.py_buffer(bytes(found["schema"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part in opened(content.as_py(), columns):
                    arrays = [(c.dictionary_decode() if pa.types.is_dictionary(c.type) else c).cast(f.type) for c, f in zip(part.columns, plain, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=plain)

    return files.mapInArrow(run, from_arrow_schema(plain))


def _ipc_batches(content: bytes, columns: list[str] | None) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_file(pa.py_buffer(content)) as f:
        names = f.schema.names
    options = pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns] if columns else None)
    with pa.ipc.open_file(pa.py_buffer(content), options=options) as f:
        order = [f.schema.names.index(c) for c in columns] if columns else list(range(len(f.schema.names)))
        if not f.num_record_batches:
            yield pa.RecordBatch.from_pylist([], _plain(f.schema)).select(order)
        for k in range(f.num_record_batches):
            yield f.get_batch(k).select(order)


def ipc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Feather and Arrow IPC files in any store that Spark reads, with only the wanted columns; unsigned integers become bigint."""
    return _tables(spark, path, columns, _ipc_batches)


def zip_member_parquet(spark: SparkSession, path: str, member: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of one Parquet member of zip archives; it must be there exactly once."""

    def opened(content: bytes, columns: list[str] | None) -> Iterator[pa.RecordBatch]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            found = [n for n in z.namelist() if n == member or n.endswith("/" + member)]
            if len(found) != 1:
                raise IntegrityError(f"{len(found)} members named {member}")
            data = z.read(found[0])
        f = pq.ParquetFile(pa.py_buffer(data))
        yield from f.iter_batches(columns=columns)
        if not f.metadata.num_rows:
            yield from pa.Table.from_batches([], f.schema_arrow).select(columns or f.schema_arrow.names).combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], f.schema_arrow)]

    return _tables(spark, path, columns, opened)


def describe_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, member, columns, rows) of CSV files, of the CSV members of zip archives and of the first sheets of workbooks: header and number of
    rows, no values.  Other members have null columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shape(grid: Iterator[list[str]]) -> tuple[list[str], int]:
            return next(grid, []), sum(1 for _ in grid)

        for batch in batches:
            rows: list[tuple] = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name.lower().endswith(".xlsx"):
                    rows.append((name, None, *shape(iter(xlsx_rows(content)))))
                elif name.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for n in z.namelist():
                            rows.append((name, n, *(shape(csv.reader(io.StringIO(z.read(n).decode()))) if n.lower().endswith(".csv") else (None, None))))
                else:
                    rows.append((name, None, *shape(csv.reader(io.StringIO(content.decode())))))
            types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=["file", "member", "columns", "rows"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, member string, columns array<string>, rows bigint")


def describe_csv(spark: SparkSession, path: str) -> dict:
    """Header and number of rows, no values."""
    df = spark.read.option("header", True).csv(path)
    return {"columns": df.columns, "rows": df.count()}


class _Batch(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _ArrowReader(DataSourceReader):
    """One task for each record batch of an Arrow IPC file, which is memory-mapped."""

    def __init__(self, options: dict):
        self.paths = options["path"].split(",")

    def partitions(self) -> list[_Batch]:
        out = []
        for path in self.paths:
            with pa.memory_map(path) as f:
                out += [_Batch(path, i) for i in range(pa.ipc.open_file(f).num_record_batches)]
        return out

    def read(self, partition: _Batch) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(partition.path) as f:
            batch = pa.ipc.open_file(f).get_batch(partition.number)
            columns = []
            for c in batch.columns:
                c = c.dictionary_decode() if pa.types.is_dictionary(c.type) else c
                columns.append(c.cast(pa.int64()) if pa.types.is_unsigned_integer(c.type) else c)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


class ArrowFile(DataSource):
    """``spark.read.format("arrow_file")``: Feather and Arrow IPC files in a folder that every executor sees.

    Unsigned integers are read as bigint and dictionaries decoded.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_file"

    def schema(self) -> StructType:
        with pa.memory_map(self.options["path"].split(",")[0]) as f:
            schema = pa.ipc.open_file(f).schema
        plain = lambda t: pa.int64() if pa.types.is_unsigned_integer(t) else t.value_type if pa.types.is_dictionary(t) else t
        return from_arrow_schema(pa.schema([pa.field(f.name, plain(f.type), f.nullable) for f in schema]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrowReader(self.options)


def arrow_file(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowFile)
    return spark.read.format("arrow_file").load(path)
