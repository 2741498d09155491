"""Hard negatives against brute force: ties, repeated rows, odd vectors and labels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import negatives, queries


def brute(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    """``rows`` are (id, label, whole numbers); ids that are null come last."""
    known = sorted({(i, label, tuple(v)) for i, label, v in rows}, key=repr)
    place = lambda i: (i is None, i)
    out = []
    for a in known:
        if not is_anchor(a[0]):
            continue
        scored = [(sum(int(x) * int(y) for x, y in zip(a[2], b[2], strict=False)), b) for b in known if b is not a]
        scored.sort(key=lambda s: (-s[0], place(s[1][0])))
        for p, b in [x for x in scored if x[1][1] == a[1]][:positives]:
            fit = [x for x in scored if x[1][1] != a[1] and low * p <= high * x[0] <= high * p][:negatives]
            out += [(a[0], b[0], k + 1, n[0], p, s) for k, (s, n) in enumerate(fit)]
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd_embeddings():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 12))
    rows = [(i, (centre[i % 4] + rng.normal(size=12) * 0.4).round(2).tolist(), i % 4 if i % 3 else 9) for i in range(260)]
    rows += [(i, rows[8][1], i % 3) for i in range(300, 460)]  # many equal vectors, so many ties
    rows += [(1000, None, 1), (1001, [0.5] * 12, None), (1002, [0.1] * 11 + [None], 1), (1003, [float("nan")] * 12, 1), (1004, [float("inf")] * 12, 1)]
    rows += [(1100, [0.0] * 12, 1), (1200, [0.3, 0.2], 2), (1300, [], 2), (None, rows[5][1], 3), (None, [0.25] * 12, 1), (100, [0.2] * 12, 1)]
    return rows + [rows[0], rows[0], rows[77], (77, rows[78][1], 3)]


def whole(rows):
    keep = [(i, v, label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    moved = lambda i, label: (label + 1) % 10 if i is not None and i % 7 == 0 else label
    return [(i, moved(i, label), [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in keep]


def test_query_is_brute_force(spark, tmp_path, odd_embeddings):
    frame = spark.createDataFrame(odd_embeddings, "vec_id long, embedding array<float>, label int")
    frame.withColumns({"row": F.lit("x"), "v": F.lit(1), "id": F.lit("y"), "block": F.lit(None)}).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = as_rows(queries.op13_hard_negatives(spark, str(tmp_path)))
    assert got == sorted(brute(whole(odd_embeddings), lambda i: i is not None and i % 100 == 0), key=repr)


def test_brackets_hold_and_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.integers(-60, 60, (6, 16))
    rows = [(i, (centre[i % 6] + rng.integers(-25, 25, 16)).astype(float).tolist(), i % 3) for i in range(900)]
    frame = spark.createDataFrame(rows, "id long, v array<double>, label int")
    want = sorted(brute([(i, label, v) for i, v, label in rows], lambda i: i % 50 == 3), key=repr)
    mined = lambda: as_rows(negatives.mine(frame, F.col("id") % 50 == 3))
    assert mined() == want
    shape = negatives.shape_of(negatives.prepared(frame, "id", "v", "label"))
    v = np.array([r[1] for r in rows])
    part = lambda far: negatives.Part(np.arange(900), np.arange(900), np.zeros(900), v.astype(shape.exact), far)
    below, above = negatives.brackets(part(shape.distances(v, True)), part(shape.distances(v, False)), shape)
    assert (below <= v @ v.T).all() and (v @ v.T <= above).all()
    assert ((above - below) < 2 * shape.square).mean() > 0.3  # tighter than what the norms alone tell
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 8192)
    monkeypatch.setattr(negatives, "TILE_BYTES", 4096)
    assert mined() == want


def test_empty_small_and_too_large(spark):
    frame = spark.createDataFrame([(100, [1.0], 1)], "id long, v array<double>, label int")
    anchor = F.col("id") % 100 == 0
    assert negatives.mine(frame, anchor).collect() == [] and negatives.mine(frame.limit(0), anchor).collect() == []
    assert negatives.mine(frame.withColumn("v", F.array().cast("array<double>")), anchor).collect() == []
    with pytest.raises(ValueError, match="norms"):
        negatives.mine(frame.withColumn("v", F.array(F.lit(1e9))), anchor)
