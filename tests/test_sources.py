import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.errors import IntegrityError
from strandweave.sources import imports, readers


def test_arrow_file(spark, tmp_path, rows):
    path = str(tmp_path / "t.arrow")
    table = pa.table({"point_id": pa.array([1, 2, 3], pa.uint64()), "kind": pa.array(["pre", "post", "pre"]).dictionary_encode(), "conf": pa.array([0.5, None, 0.25], pa.float32())})
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        for b in table.to_batches(max_chunksize=2):
            w.write_batch(b)
    df = readers.arrow_file(spark, path)
    assert df.schema["point_id"].dataType.simpleString() == "bigint"
    assert rows(df) == [(1, "pre", 0.5), (2, "post", None), (3, "pre", 0.25)]


def test_numbers(spark, tmp_path):
    p = tmp_path / "n.txt"
    p.write_text("head\n1.5\n\n2\n")
    assert [r["value"] for r in readers.numbers(spark, str(p), header=True, scale=2.0).collect()] == [3.0, 4.0]
    p.write_text("1\nx\n")
    with pytest.raises(IntegrityError, match="not a number"):
        readers.numbers(spark, str(p))


def test_swc(spark, tmp_path, rows):
    p = tmp_path / "a.swc"
    p.write_text("# comment\n1 1 0 0 0 1 -1\n2 3 1 0 0 0.5 1\n3 3 2 0 0 0 9\n")
    tree = readers.swc(spark, str(p))
    assert tree.count() == 3
    assert rows(readers.swc_faults(tree).select("node", "fault")) == [(3, "parent"), (3, "radius")]


def test_xlsx(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(buffer.getvalue())
    assert readers.xlsx(spark, str(tmp_path / "b.xlsx"), "S").first()["cells"] == ["name", "", "2.5"]


def test_zip_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("deep/x.csv", "a,b\n1,2\n")
    assert [r["cells"] for r in readers.zip_member_csv(spark, str(tmp_path / "c.zip"), "x.csv").orderBy("row").collect()] == [["a", "b"], ["1", "2"]]


def test_trace_json(spark, tmp_path):
    from pyspark.sql.types import StructType

    p = tmp_path / "t.jsonl"
    p.write_text('{"t_us": 1}\n\n{"t_us": 2}\n')
    schema = StructType.fromDDL("t_us bigint")
    assert readers.trace_json(spark, str(p), schema).count() == 2
    p.write_text("")
    with pytest.raises(IntegrityError):
        readers.trace_json(spark, str(p), schema)


def test_import_is_sorted_and_refuses_overwriting(spark, tmp_path):
    raw = spark.createDataFrame([(2, 1, 1), (1, 2, 2), (1, 2, 3)], "src long, dst long, weight long")
    out = imports.import_edges(raw, str(tmp_path / "e"))
    assert sorted(map(tuple, out.collect())) == [(1, 2, 5), (2, 1, 1)]
    with pytest.raises(Exception, match="exist"):
        imports.import_edges(raw, str(tmp_path / "e"))
    with pytest.raises(IntegrityError, match="negative"):
        imports.import_contacts(spark.createDataFrame([(-1, 0)], "body long, x int"), str(tmp_path / "n"), ["body"])
    shards = imports.import_contacts(spark.range(10).select(F.col("id").alias("point_id")), str(tmp_path / "p"), ["point_id"], rows_per_file=4)
    assert shards.count() == 10


def test_ipc_files_with_column_pruning(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"body": pa.array([1, 2, 3], pa.uint64()), "kind": pa.array(["a", "b", "a"]).dictionary_encode(), "conf": pa.array([0.5, None, 1.0])})
    for k in range(2):
        with pa.OSFile(str(tmp_path / f"{k}.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
            w.write_table(t, max_chunksize=2)
    df = readers.ipc(spark, str(tmp_path / "*.arrow"), ["conf", "body"])
    assert df.dtypes == [("conf", "double"), ("body", "bigint")]
    assert sorted((r["body"], r["conf"]) for r in df.collect() if r["conf"]) == [(1, 0.5), (1, 0.5), (3, 1.0), (3, 1.0)]
    assert readers.ipc(spark, str(tmp_path / "*.arrow")).select("kind").distinct().count() == 2
    with pa.OSFile(str(tmp_path / "empty.feather"), "wb") as f, pa.ipc.new_file(f, t.schema):
        pass
    assert readers.ipc(spark, str(tmp_path / "empty.feather")).count() == 0


def test_zip_members_and_descriptions(spark, tmp_path):
    import io
    import zipfile

    import pyarrow as pa
    import pyarrow.parquet as pq
    from strandweave.errors import IntegrityError

    data = io.BytesIO()
    pq.write_table(pa.table({"a": [1, 2], "b": ["x", "y"]}), data)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/one.parquet", data.getvalue())
        z.writestr("two.csv", "p,q\n1,2\n3,4\n")
    assert [tuple(r) for r in readers.zip_member_parquet(spark, str(tmp_path / "z.zip"), "one.parquet", ["b"]).collect()] == [("x",), ("y",)]
    with pytest.raises(Exception, match="members named"):
        readers.zip_member_parquet(spark, str(tmp_path / "z.zip"), "none.parquet").collect()
    got = {r["member"]: (r["columns"], r["rows"]) for r in readers.describe_files(spark, str(tmp_path / "z.zip")).collect()}
    assert got == {"in/one.parquet": (None, None), "two.csv": (["p", "q"], 2)}
    assert issubclass(IntegrityError, Exception)


def test_long_number_files_are_split(spark, tmp_path):
    (tmp_path / "n.txt").write_text("head\r\n" + "".join(f"{i}.5\r\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.numbers(spark, str(tmp_path / "n.txt"), header=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["line"], r["value"]) for r in rows) == [(i + 1, i + 0.5) for i in range(5000)]


def test_skeletons_with_cycles(spark):
    rows = [("f", 1, -1), ("f", 2, 1), ("f", 3, 4), ("f", 4, 5), ("f", 5, 3), ("f", 6, 5), ("g", 1, -1)]
    tree = spark.createDataFrame([(f, n, 1, 0.0, 0.0, 0.0, 1.0, p) for f, n, p in rows], "file string, node long, kind int, x double, y double, z double, radius double, parent long")
    assert sorted((r["file"], r["node"], r["fault"]) for r in readers.swc_faults(tree).collect()) == [("f", n, "cycle") for n in (3, 4, 5, 6)]


def test_sharded_import_resumes(spark, tmp_path):
    from strandweave.errors import IntegrityError
    from strandweave.sources import imports

    raw = spark.createDataFrame([(i % 50, i, float(i)) for i in range(400)], "body_pre long, body_post long, w double")
    path = str(tmp_path / "out")
    assert imports.import_sharded(raw, path, ["body_pre", "body_post"], 6).count() == 400
    manifest = sorted(tmp_path.glob("out/_manifest/*.json"))
    lines = [x for f in manifest for x in f.read_text().splitlines()]
    assert len(lines) == 6
    # As if the run had ended after four shards: the others are written again, those stay.
    kept = {int(f.parent.name.split("=")[1]): f.stat().st_mtime_ns for f in tmp_path.glob("out/data/shard=*/*.parquet")}
    for f in [*manifest, *tmp_path.glob("out/_manifest/.*.crc")]:
        f.unlink()
    (tmp_path / "out/_manifest/a.json").write_text("\n".join(lines[:4]))
    assert imports.import_sharded(raw, path, ["body_pre", "body_post"], 6).count() == 400
    import json

    old = {json.loads(x)["shard"] for x in lines[:4]}
    now = {int(f.parent.name.split("=")[1]): f.stat().st_mtime_ns for f in tmp_path.glob("out/data/shard=*/*.parquet")}
    assert {k for k in now if now[k] == kept[k]} == old & set(now)
    assert imports.import_sharded(raw, path, ["body_pre", "body_post"], 6).count() == 400
    (tmp_path / "out/_manifest/b.json").write_text('{"shard": 0, "rows": 1, "digest": "5"}')
    with pytest.raises(IntegrityError):
        imports.import_sharded(raw, path, ["body_pre", "body_post"], 6)


def test_graphs_are_checked_when_loaded(spark, tmp_path):
    from strandweave.errors import IntegrityError
    from strandweave.sources import imports

    nodes, edges = spark.range(5).withColumnRenamed("id", "node"), spark.createDataFrame([(0, 1, 2), (3, 4, 5)], "src long, dst long, weight long")
    imports.write_graph(nodes, edges, str(tmp_path / "g"))
    a, b = imports.load_graph(spark, str(tmp_path / "g"))
    assert a.count() == 5 and b.count() == 2
    edges.limit(1).write.mode("append").parquet(str(tmp_path / "g/edges"))
    with pytest.raises(IntegrityError):
        imports.load_graph(spark, str(tmp_path / "g"))


def test_matrices_and_file_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "m.csv").write_text("1, 2.5,3\r\n\r\n4,5,-6e1\n")
    got = {(r["line"], r["column"]): r["value"] for r in readers.matrix(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.5, (0, 2): 3.0, (1, 0): 4.0, (1, 1): 5.0, (1, 2): -60.0}
    for bad in ("1,2\n3\n", "1,x\n2,3\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(IntegrityError):
            readers.matrix(spark, str(tmp_path / "bad.csv"))
    r = readers.file_digests(spark, str(tmp_path / "m.csv")).first()
    data = (tmp_path / "m.csv").read_bytes()
    assert (r["artifact"], r["digest"], r["bytes"]) == ("m.csv", hashlib.sha256(data).hexdigest(), len(data))


def test_only_wanted_columns_are_read(spark, tmp_path):
    spark.range(5).selectExpr("id AS body", "id * 2 AS x", "id * 3 AS y").write.parquet(str(tmp_path / "p"))
    plan = readers.parquet(spark, str(tmp_path / "p"), ["body", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<body:bigint,y:bigint>" in plan
