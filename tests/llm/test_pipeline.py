import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    syllables = {"en": ["the", "ing", "tion", "with", "er", "and"], "es": ["ción", "que", "mente", "ado", "los", "ñas"]}
    prose = lambda lang, n: ". ".join(" ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(12)) for _ in range(n))
    rows = [(i, prose(lang, 20), lang, f"s{i % 3}", 0) for i in range(40) for lang in [rnd.choice(["en", "es"])]]
    clean = rows[0][1]
    near = clean.split(" ")
    near[30] = "changed"
    rows += [(100, clean, "en", "s", 1), (101, " ".join(near), "en", "s", 1), (102, "few words", "en", "s", 1), (103, "again and again " * 60, "en", "s", 1)]
    rows += [(104, " ".join(str(rnd.randint(0, 10**6)) for _ in range(80)), None, "s", 1), (105, None, None, None, None), (106, "", "en", "s", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r["doc_id"] for r in out.collect()})
        docs = out
    clean = set(range(40))
    assert kept[0] == clean | {100, 101, 104}
    assert kept[1] == clean | {100, 101}
    assert kept[2] == kept[1]
    assert kept[3] >= clean
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in pieces.collect()} == kept[3]


def test_near_copies_leave_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {r["doc_id"] for r in corpus_pipeline.STAGES[3][1](spark, docs, folder).collect()}
    assert 0 in out and not out & {100, 101}
    assert len(out & set(range(40))) == 40


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.select("doc_id").distinct().count() >= 40


def test_stages_take_odd_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ("n_words", "kept", "ratio", "lang_pred", "score", "kept_text", "n_lines", "n_dropped", "_sw_text", "component_id", "a", "id")
    rows = docs.collect()
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.where("doc_id = 5").selectExpr("7L as doc_id", "text", "lang", "source", "n_chars"))
    odd = odd.unionByName(docs.where("doc_id = 6").selectExpr("cast(null as bigint) as doc_id", "text", "cast(null as string) as lang", "source", "n_chars"))
    for n in names:
        odd = odd.withColumn(n, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, odd.limit(0), folder)
        assert empty.count() == 0, name
        out = stage(spark, odd, folder)
        if name != "packing":
            assert out.columns == odd.columns, name
            assert all(r[n] == "x" for r in out.collect() for n in names), name
        ids = collections.Counter(r["doc_id"] for r in out.collect())
        if name == "ngram_jaccard_join":
            assert max(ids.values()) == 1 and ids[None] == 1
    assert len(rows) == docs.count()
