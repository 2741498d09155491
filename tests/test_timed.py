"""Streams of files with late, missing and delayed rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandweave.errors import CausalityError
from strandweave.streaming import timed

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def files(spark, folder, schema, *batches):
    """A stream that takes one file at a time, in order."""
    for k, rows in enumerate(batches):
        target = folder / f"{k:03d}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(target))
        for f in target.glob("*.parquet"):
            f.rename(folder / f"{k:03d}.parquet")
    import os

    for k in range(len(batches)):
        os.utime(folder / f"{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(folder))


CLAIM = "key long, ts timestamp, state string"


def test_claims_without_a_record(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "r").mkdir()
    claims = files(spark, tmp_path / "c", CLAIM, [(1, at(0), "a"), (1, at(1), "b"), (2, at(2), "c"), (3, at(3), None)], [(1, at(100), "a")], [(9, at(1000), "end")])
    records = files(spark, tmp_path / "r", CLAIM, [(1, at(0), "a")], [(1, at(1), "x"), (3, at(3), None), (1, at(95), "a")], [(9, at(1000), "end")])
    out, states = timed.run_strict(timed.unmatched_claims(claims, records, "10 seconds"), spark, str(tmp_path / "q"))
    assert sorted((r["key"], r["ts"], r["state"], r["fault"]) for r in out.collect()) == [(1, at(1), "b", "state"), (1, at(100), "a", "absent"), (2, at(2), "c", "absent")]
    assert states[-1] <= 4 < max(states)  # what is settled has left the state


def test_rows_behind_the_watermark_are_an_error(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "r").mkdir()
    batches = [[(1, at(0), "a")], [(1, at(500), "a")], [(1, at(600), "a")], [(1, at(5), "late")]]
    claims, records = (files(spark, tmp_path / d, CLAIM, *batches) for d in "cr")
    with pytest.raises(CausalityError, match="behind the watermark"):
        timed.run_strict(timed.unmatched_claims(claims, records, "10 seconds"), spark, str(tmp_path / "q"))


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timed.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_samples_leave_when_they_are_due(spark, tmp_path, rocksdb):
    schema = "channel long, ts timestamp, value double"
    (tmp_path / "s").mkdir()
    batches = [[(k % 3, at(10 * b + k / 10), float(k)) for k in range(60)] for b in range(5)] + [[(0, at(500), -1.0), (1, at(500), -1.0), (2, at(500), -1.0)]]
    stream = files(spark, tmp_path / "s", schema, *batches)
    out, states = timed.run_strict(timed.delayed_bus(stream, {0: 0, 1: 15_000_000}, "1 second"), spark, str(tmp_path / "q"))
    got = sorted((r["channel"], r["source_us"], r["due_us"], r["value"]) for r in out.collect())
    micros = lambda t: round((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    delay = {0: 0, 1: 15_000_000}
    want = sorted((c, micros(t), -(-(micros(t) + delay[c]) // 1000) * 1000, v) for rows in batches[:-1] for c, t, v in rows if c in delay)
    assert got == want
    assert states[-1] < max(states)
    with pytest.raises(CausalityError):
        timed.delayed_bus(stream, {0: -1}, "1 second")
    assert timed.delayed_bus(stream.where(F.lit(False)), {}, "1 second").isStreaming
