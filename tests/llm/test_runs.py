"""Periodic runs against a brute-force search, over texts with every odd row."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=12):
    """Every maximal stretch whose smallest period fits twice, by trying all periods."""
    n, found = len(words), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            own = words[start : start + length]
            if i > start and length >= max(least, 2 * p) and not any(own[q:] == own[:-q] for q in range(1, p)):
                found.add((start, length, p))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_row(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    found = brute_runs(words)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    s, n, p = min(((s, n, p) for s, n, p in found), key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines, left = "".join(f"{a},{b},{c}\n" for a, b, c in found), " ".join(w for k, w in enumerate(words) if k not in gone)
    return doc_id, len(found), s, n, p, None if p is None else 1000 * n // p, sha(lines), sha(left)


def test_runs_are_those_of_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(1, 6)):
            words = rng.integers(1, rng.integers(2, 5), rng.integers(0, 70))
            if rng.random() < 0.5 and len(words) > 3:
                a = rng.integers(len(words))
                words = words[np.where(np.arange(len(words)) < a, np.arange(len(words)), a + (np.arange(len(words)) - a) % rng.integers(1, 9))]
            texts.append(words)
        least = int(rng.integers(2, 13))
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = [tuple(map(int, r)) for r in runs.runs_of(np.concatenate(texts).astype(np.int64), first, least)]
        assert got == [(t, *r) for t, x in enumerate(texts) for r in brute_runs(x.tolist(), least)]


def test_long_texts_have_their_runs():
    for n, words, want in [
        (200_000, np.ones(200_000, np.int64), [(0, 0, 200_000, 1)]),
        (200_000, np.resize(np.random.default_rng(1).permutation(777) + 1, 200_000), [(0, 0, 200_000, 777)]),
        (200_000, np.arange(1, 200_001), []),
    ]:
        assert [tuple(map(int, r)) for r in runs.runs_of(words, np.array([0, n]))] == want


def test_range_minima():
    rng = np.random.default_rng(0)
    for n in (1, 15, 16, 17, 300, 5000):
        values = rng.integers(0, 1000, n).astype(np.int32)
        a, b = np.sort(rng.integers(0, n, (2, 200)), axis=0)
        assert runs.RangeMin(values).of(a, b).tolist() == [values[x : y + 1].min() for x, y in zip(a, b, strict=True)]


@pytest.fixture(scope="module")
def odd_rows():
    rnd = random.Random(5)
    some = lambda n, k: " ".join(rnd.choice("aé中xyz$"[:k]) for _ in range(n))
    rows = [(i, some(rnd.choice([0, 1, 5, 40, 150]), rnd.choice([1, 2, 3, 7])), "en") for i in range(120)]
    rows += [(500, None, None), (501, "", "x"), (502, " \t\n\x0b ", "x"), (None, "no id " * 9, "x"), (503, " a b c " * 30, "x"), (504, "w " * 4000, "x")]
    return rows + [rows[3], rows[3], rows[-1]]


def test_query_is_brute_force(spark, tmp_path, odd_rows, rows):
    spark.createDataFrame(odd_rows, "doc_id long, text string, lang string").withColumns({"runs": F.lit(1), "n_runs": F.lit("a"), "collapsed": F.lit(0)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.op12_word_runs(spark, str(tmp_path)))
    assert got == sorted((brute_row(i, t) for i, t, _ in odd_rows), key=repr)


def test_operator_gives_runs_and_texts(spark):
    docs = spark.createDataFrame([(1, "say it again " * 5 + "done"), (2, None)], "doc_id long, text string")
    one, two = sorted(runs.find_runs(docs).collect(), key=lambda r: r["doc_id"])
    assert one["runs"][0].asDict() == {"start": 0, "length": 15, "period": 3} and one["n_runs"] == 1 and one["collapsed"] == "say it again done"
    assert two["runs"] == [] and two["collapsed"] == ""
    assert runs.find_runs(docs.limit(0)).collect() == []
    assert runs.find_runs(docs, least=16).where("n_runs > 0").count() == 0
