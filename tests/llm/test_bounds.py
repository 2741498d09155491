"""Sizes at which an operator used to stop, lose rows or gather too much in one task."""

import collections
import gzip
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandweave.llm import langid, packing, sharding, urlfilter, warc


def test_long_white_space_is_encoded_as_the_library_does(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encode = Tokenizer.from_file(path), packing.encoder(path)
    runs = [" " * 1_000_000, "\n" * 1_000_000, "\t" * 1_000_000, " \n" * 500_000, "\r\n\t " * 300_000]
    for text in [*runs, "ab" + runs[0] + "cd", runs[3] + "end.", "<|endoftext|>" + runs[2] + " x", "　" * 1_000_000]:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, "plain text"), (2, runs[0]), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(docs, path).collect()}
    assert got == {1: 3, 2: len(library.encode(runs[0]).ids) + 1, 3: 1}


def test_language_of_long_texts_only_is_learned(spark):
    rnd = random.Random(3)
    en, es = ["the", "of", "and", "thing", "when", "house"], ["que", "los", "ción", "para", "mañana", "niño"]
    rows = [(i, " ".join(rnd.choice(en) for _ in range(200)), "en") for i in range(20)] + [(100 + i, " ".join(rnd.choice(es) for _ in range(6000)), "es") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(docs).collect()
    assert collections.Counter(r["l"] for r in sample) == {"en": 20, "es": 20} and max(len(r["t"]) for r in sample) == langid.TRAIN_CHARS
    model = langid.fit(docs, epochs=8)
    assert model.langs == ["en", "es"]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()} == {i: lang for i, _, lang in rows}
    # A text of a million characters, without and with spaces.
    odd = spark.createDataFrame([(1, "x" * 1_000_000), (2, "mañana que " * 90_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()}[2] == "es"


def test_training_of_many_languages_is_bounded(monkeypatch):
    rnd = random.Random(1)
    langs = [f"l{k:03d}" for k in range(200)]
    own = {lang: ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(30)] for lang in langs}
    # As much text as the sample may have for so many.
    size = min(langid.TRAIN_TOTAL, langid.TRAIN_CELLS // len(langs)) // len(langs)
    rows = [(" ".join(rnd.choice(own[lang]) for _ in range(size // 6)), lang) for lang in langs]
    tracemalloc.start()
    model = langid.train(rows, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.langs) == 200 and peak < 1 << 30
    # In batches, the gradient is that of all chains at once.
    few = [(t, lang) for t, lang in rows[:6]]
    whole = langid.train(few, epochs=3)
    monkeypatch.setattr(langid, "BATCH_CELLS", 50)
    parts = langid.train(few, epochs=3)
    assert np.allclose(whole.lexicon, parts.lexicon, atol=1e-3) and np.allclose(whole.trans, parts.trans, atol=1e-3)


@pytest.fixture
def without_broadcasts(spark, monkeypatch):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(urlfilter, "BROADCAST_BLOCKS", 0)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_null_and_popular_urls_do_not_meet_in_one_task(spark, without_broadcasts):
    urls = [None] * 700 + ["no scheme"] * 100 + ["http://popular.net/x"] * 600 + [f"http://h{i}.net/{i}" for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = pages.where("page_id >= 1400 and page_id % 3 = 0 or page_id = 900").select("url")
    out = urlfilter.listed_hits(pages, listed)
    want = {i for i, u in enumerate(urls) if u == "http://popular.net/x" or (i >= 1400 and i % 3 == 0)}
    assert {r["page_id"] for r in out.where("is_listed").collect()} == want and out.count() == len(urls)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line and "_sw_probe" in line]
    assert joins and all("_sw_salt" in line for line in joins)
    # What goes into the shuffled probe has a key.
    assert "isnotnull" in plan.lower() or "IS NOT NULL" in plan
    placed = urlfilter._dealt_join(pages.where("url is not null").withColumn("k", F.col("url")), listed.distinct().withColumnRenamed("url", "l"), "k", "l")
    assert placed.where("url = 'http://popular.net/x'").count() == 600


def test_copies_of_one_text_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANK_ROWS", 200)
    rows = [(i, "one text", None) for i in range(2700)] + [(5000 + i, f"group {i // 3}", None) for i in range(150)] + [(9000 + i, f"single {i}", None) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sharding.balanced_shards(docs, 6).collect()
    counts = collections.Counter(r["shard"] for r in got)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows) and set(counts.values()) == {500}
    base = docs.select(F.col("doc_id").alias("id"), F.struct(F.xxhash64("text").alias("g"), F.lit(1).alias("g2")).alias("g"), F.xxhash64("doc_id").alias("h"))
    plan = base.groupBy("g").agg(F.count("*").alias("group_n")).where("group_n > 1")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = sharding._with_plan(base, plan)
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert joined.count() == 3000 and joined.where("group_n is null").count() == 150 and max(sizes) < 1500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def warc_record(body, record_id="<urn:uuid:6d0b1c6e-0000-4000-8000-000000000001>", version="1.0"):
    return f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: http://x/\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_real_archives_are_read(spark, tmp_path):
    bodies = [b"hello", b"", bytes(range(256)) * 40, b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"see WARC/1.x and WARC/1.", "é\r\n\r\n".encode() * 300]
    parts = [warc_record(b, f"<urn:uuid:{k}>", "1.1" if k % 2 else "1.0") for k, b in enumerate(bodies)]
    (tmp_path / "one.warc").write_bytes(b"".join(parts))
    (tmp_path / "many.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "single.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = warc.read_archives(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["offset"]):
        by_file[r["archive"].rsplit("/", 1)[1]].append(r)
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]]).tolist()
    for rows in by_file.values():
        assert [(r["offset"], r["record_id"], r["id"], r["url"], bytes(r["payload"]), bytes(r["record"]), r["flaw"]) for r in rows] == [
            (at, f"urn:uuid:{k}", None, "http://x/", b, p, None) for k, (at, b, p) in enumerate(zip(starts, bodies, parts, strict=True))
        ]
    assert set(by_file) == {"one.warc", "many.warc.gz", "single.warc.gz"}


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"", []),
        (b"noise", [(5, "garbage")]),
        (b"noise" + warc_record(b"a"), [(5, "garbage"), (len(warc_record(b"a")), None)]),
        (warc_record(b"a") + b"pad" + warc_record(b"b"), [(len(warc_record(b"a")), None), (3, "garbage"), (len(warc_record(b"b")), None)]),
        (warc_record(b"abc")[:-6] + warc_record(b"b"), [(len(warc_record(b"abc")) - 6, "truncated"), (len(warc_record(b"b")), None)]),
        (warc_record(b"a") + b"WARC/1.", [(len(warc_record(b"a")), None), (7, "garbage")]),
        (b"WARC/1.0\r\nContent-Length: 99999999999999999\r\n\r\nx" + warc_record(b"b"), [(48, "truncated"), (len(warc_record(b"b")), None)]),
        (b"WARC/1.0\r\nno end of the head " + warc_record(b"b"), [(29, "garbage"), (len(warc_record(b"b")), None)]),
        (warc_record(b"x" * 50)[:-30] + warc_record(b"y") + warc_record(b"z"), [(len(warc_record(b"x" * 50)) - 30, "truncated"), (len(warc_record(b"y")), None), (len(warc_record(b"z")), None)]),
    ],
)
def test_flawed_archives_are_covered(spark, tmp_path, data, want):
    (tmp_path / "a.warc").write_bytes(data)
    got = sorted(warc.read_archives(spark, str(tmp_path)).collect(), key=lambda r: r["offset"])
    assert [(len(r["record"]), r["flaw"]) for r in got] == want
    assert b"".join(bytes(r["record"]) for r in got) == data


def test_tree_has_as_many_levels_as_an_archive_needs(spark):
    n = 100_000
    leaf = spark.range(n).select(F.lit("big").alias("archive"), (F.col("id") * 100).alias("offset"), F.lit(100).cast("bigint").alias("length"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("sha256"), "id")
    levels = warc.tree(leaf, ["archive"], 100)
    assert [x.count() for x in levels] == [100_000, 6250, 391, 25, 2, 1]
    plan = warc.level_above(levels[0], ["archive"])._jdf.queryExecution().toString()
    assert "collect_list" in plan
    assert levels[0].groupBy("archive", F.shiftright("node", 4)).count().agg(F.max("count")).first()[0] == warc.FANOUT
    hurt = leaf.where("id <> 77777").withColumn("sha256", F.when(F.col("id") == 5, F.lit("other")).otherwise(F.col("sha256")))
    got = {(r["offset"], r["fault"]) for r in warc.mismatches(leaf, hurt, 100).collect()}
    assert got == {(500, "corrupt"), (7777700, "missing")}
