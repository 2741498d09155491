"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import random
import re
import shutil
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandweave.llm import components, fingerprint, jaccard, langid, line_dedup, packing, quality, sentencepiece_codec, sharding, urlfilter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    rnd = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "été", "中文", "ñandú", "x" * 30, "b.", "$$$"]
    text = lambda n: " ".join(rnd.choice(words) + str(rnd.randint(0, 60)) for _ in range(n))
    base = [text(rnd.choice([1, 3, 6, 30, 120])) for _ in range(24)]
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(base)]
    rows += [(100 + i, base[20], "en") for i in range(12)]
    long = text(120)
    for i in range(12):
        w = long.split(" ")
        w[rnd.randrange(len(w))] = "edit"
        rows.append((200 + i, " ".join(w), "en"))
    rows += [(300, "A shared line of text\n\nunique one\n a SHARED line of text \nshort", "en"), (301, "a shared LINE of text\nother", None), (302, "short\nunique one more", "fr")]
    rows += [(400, None, "en"), (401, "", "en"), (402, " \n\t ", None), (None, "no id here at all\nA shared line of text", "en"), (403, text(6000), "en"), (404, "same words " * 50, "en")]
    rows += [rows[3], rows[3], (500, "\n".join(["line number %d of many" % i for i in range(200)]), "en"), (501, "\n".join(["line number %d of many" % i for i in range(0, 200, 3)]), "en")]
    return rows


ROWS = documents()
EMPTY: list = []


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sentencepiece_is_the_library(frame):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_codec.encode_decode(frame(ROWS), path).collect()
    got = sorted(((r["doc_id"] or -1, bytes(r["ids"]), r["decoded"]) for r in out))
    want = []
    for i, t, _ in ROWS:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i or -1 if i is not None else -1, np.array(ids, "<u4").tobytes(), sp.decode(ids)))
    assert [(a, b, c) for a, b, c in got] == sorted((-1 if a in (None, 0) else a, b, c) for a, b, c in want)
    assert sentencepiece_codec.encode_decode(frame(EMPTY), path).count() == 0


def test_sentencepiece_fuzz():
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec = sentencepiece_codec.Codec(path, cache=50)
    rnd = random.Random(1)
    for alphabet in ("ab A▁\n\t  é中𝒳'.,01  ", "  ▁a", "therinosd ", "\x00 a​﻿</s><unk>"):
        for _ in range(400):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            ids = codec.model.encode(t, add_bos=True, add_eos=True)
            packed = codec.with_ends(codec.encode(t))
            assert np.frombuffer(packed, "<u4").tolist() == ids, t
            assert codec.decode(packed) == codec.model.decode(ids), t
    texts = ["".join(rnd.choice("therinosdé") for _ in range(n)) for n in (255, 256, 257, 3000)] + ["a " * 5000, "▁" * 300, "é" * 700, "", " "]
    for t, packed in zip(texts * 2, codec.encode_batch(texts * 2), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == codec.model.encode(t), t[:50]
    odd = np.array([codec.byte_ids[0xC3], codec.byte_ids[0x28], 450], "<u4")
    assert codec.decode(odd.tobytes()) == codec.model.decode(odd.tolist())


def test_line_dedup(frame):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = collections.defaultdict(set)
    for i, t, _ in ROWS:
        if i is not None and t is not None:
            for x in t.split("\n"):
                if len(key(x)) >= 10:
                    holders[key(x)].add(i)
    want = []
    for i, t, _ in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or t is None or len(key(x)) < 10 or i == min(holders[key(x)])]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = line_dedup.dedup_lines(frame(ROWS))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert line_dedup.dedup_lines(frame(EMPTY)).count() == 0


def test_drop_bitmaps_are_sparse(frame):
    maps = {r["doc_id"]: r for r in line_dedup.drop_bitmaps(frame(ROWS)).collect()}
    assert maps[501]["n_dropped"] == 67
    assert [w["word"] for w in maps[501]["drop_words"]] == [0, 1]


@pytest.mark.parametrize("rows", [ROWS, EMPTY, [(i, "one text", None) for i in range(50)], [(1, None, None)]])
def test_sharding(frame, rows):
    out = sharding.balanced_shards(frame(rows), 5).collect()
    assert len(out) == len(rows)
    counts = collections.Counter(r["shard"] for r in out)
    assert not rows or max(counts.values()) - min([counts[s] for s in range(5)]) <= 1
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert want == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)


def test_sharding_keeps_groups_together(frame):
    rows = [(i, f"group {i // 4}" if i < 80 else f"single {i}", None) for i in range(240)]
    shard = {r["doc_id"]: r["shard"] for r in sharding.balanced_shards(frame(rows), 6).collect()}
    whole = sum(len({shard[4 * g + k] for k in range(4)}) == 1 for g in range(20))
    assert whole >= 18


def test_sharding_cuts_far_fewer_groups_than_chance(frame):
    rnd = random.Random(9)
    rows = [(i, f"group {rnd.randrange(150)}", None) for i in range(900)] + [(1000 + i, f"single {i}", None) for i in range(300)]
    text = {i: t for i, t, _ in rows}
    shard = {r["doc_id"]: r["shard"] for r in sharding.balanced_shards(frame(rows), 8).collect()}

    def cut(place):
        """Pairs of equal texts in different shards."""
        whole, own = collections.Counter(), collections.Counter()
        for i, t in text.items():
            whole[t] += 1
            own[t, place[i]] += 1
        return sum(n * (n - 1) // 2 for n in whole.values()) - sum(n * (n - 1) // 2 for n in own.values())

    assert cut(shard) <= 0.2 * cut({i: rnd.randrange(8) for i in text})


def test_language_id(frame):
    rnd = random.Random(3)
    make = {"en": lambda: "the " + rnd.choice(["thing", "other", "that", "with"]), "es": lambda: "la " + rnd.choice(["ción", "mente", "niño", "que"])}
    rows = [(i, " ".join(make[lang]() for _ in range(rnd.randint(5, 200))), lang) for i in range(60) for lang in [rnd.choice(["en", "es"])]]
    model = langid.fit(frame(rows), epochs=10)
    odd = [(900, None, None), (901, "", None), (902, "12 34 $$", None), (903, "the thing " * 40 + "la mente que " * 3, None), (904, "ß", None)]
    got = {r["doc_id"]: r for r in langid.identify(frame(rows + odd), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows) >= 58
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903]["lang_pred"] == "en" and got[903]["score"] < got[rows[0][0]]["score"]
    assert got[904]["lang_pred"] in ("en", "es")
    assert langid.identify(frame(EMPTY), model).count() == 0
    nothing = langid.fit(frame(odd))
    assert {r["lang_pred"] for r in langid.identify(frame(rows), nothing).collect()} == {"und"}


def test_forward_backward_is_one_pass_along_each_chain():
    rng = np.random.default_rng(0)
    lengths = [0, 1, 5, 63, 64, 65, 200, 0, 500]
    first = np.concatenate([[0], np.cumsum(lengths)])
    e, a = rng.normal(size=(first[-1], 3)) * 2, rng.normal(size=(3, 3))
    got = langid.posteriors(e, a, first)
    for lo, hi in zip(first[:-1], first[1:]):
        x, ahead = np.full(3, 1 / 3), []
        for t in range(lo, hi):
            x = (x @ np.exp(a)) * np.exp(e[t])
            x /= x.sum()
            ahead.append(x)
        y = np.ones(3)
        for t in range(hi - 1, lo - 1, -1):
            want = ahead[t - lo] * y
            assert got[t] == pytest.approx(want / want.sum())
            y = np.exp(a) @ (np.exp(e[t]) * y)
            y /= y.sum()


def test_rejected_pages_skip_the_exact_join(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.net/{i}") for i in range(400)] + [(900, None), (901, "no scheme")], "page_id long, url string")
    listed = pages.where("page_id between 10 and 30").select("url")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = urlfilter.listed_hits(pages, listed)
        assert {r["page_id"] for r in out.where("is_listed").collect()} == set(range(10, 31)) and out.count() == 402
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        exact = plan[plan.index("Join LeftOuter, (_sw_key") :]
        # What goes into the exact join comes from a filter on the mask of the Bloom filter's block.
        assert "_sw_mask" in exact.split("Filter", 1)[1].split("\n", 1)[0] or "_sw_maybe" in exact.split("Filter", 1)[1].split("\n", 1)[0], plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    first = np.array([0, 3, 3, 4, 74])
    e, a, labels = rng.normal(size=(74, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, 74)
    by_e, by_a = langid.gradient(e, a, first, labels)
    for x, got in ((e, by_e), (a, by_a)):
        for at in [tuple(rng.integers(0, n) for n in x.shape) for _ in range(8)]:
            old, ends = x[at], []
            for step in (1e-5, -1e-5):
                x[at] = old + step
                ends.append(langid.log_likelihood(e, a, first, labels))
            x[at] = old
            inside = got[at]
            if x is a:  # the likelihood also has the step into a chain's first word, which ``gradient`` leaves out
                share = np.exp(a) / np.exp(a).sum(0)
                post = langid.posteriors(e, a, first)
                opening = first[:-1][np.diff(first) > 0]
                inside += share[at] * sum((labels[t] == at[1]) - post[t, at[1]] for t in opening)
            assert inside == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-4)


def test_words_of_mixed_texts_get_their_own_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.where("text is not null and lang is not null").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    model = langid.fit(docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) != 1))
    assert (model.trans[~np.eye(len(model.langs), dtype=bool)] < 0).all() and np.diag(model.trans).min() > 0
    out = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    own = [(i, lang) for i, _, lang in rows if held(i)]
    assert sum(out[i]["lang_pred"] == lang for i, lang in own) >= 0.98 * len(own)
    chains = langid.mixed_chains([(t, lang) for i, t, lang in rows if held(i)], seed=5)
    mixed = spark.createDataFrame([(k, " ".join(t for t, _ in c), "x") for k, c in enumerate(chains)], "doc_id long, text string, words string")
    words = {r["doc_id"]: r for r in langid.label_words(mixed, model).collect()}
    switches = {r["doc_id"]: r["n_switches"] for r in langid.identify(mixed, model).collect()}
    right = total = found = 0
    for k, chain in enumerate(chains):
        text, truth = words[k]["text"], [lang for t, lang in chain for _ in range(len(t) + 1)]
        for w in words[k]["words"]:
            assert re.fullmatch(r"[a-zA-Z\x80-\U0010ffff]+", text[w["start"] : w["end"]]) and 0.0 <= w["probability"] <= 1.0
            right += w["label"] == truth[w["start"]]
        total += len(words[k]["words"])
        labels = [w["label"] for w in words[k]["words"]]
        assert switches[k] == sum(x != y for x, y in zip(labels, labels[1:]))
        found += len(set(labels)) > 1
    assert right >= 0.96 * total and found >= 0.9 * len(chains)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 $")], "doc_id long, text string")
    assert [r["words"] for r in langid.label_words(odd, model).collect()] == [[], [], []]
    assert langid.label_words(odd.limit(0), model).count() == 0


def test_training_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_DOCS", 5)
    monkeypatch.setattr(langid, "TRAIN_TOTAL", 400)
    rows = [(i, "same text", "en") for i in range(300)] + [(i, f"texte {i} " * 5, "fr") for i in range(300, 400)] + [(1, "y" * 5000, "de"), (2, "x", None), (3, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collections.Counter(r["l"] for r in langid.training_sample(docs).collect())
    assert got["en"] == 1 and 1 <= got["fr"] <= 3 and got["de"] == 1 and len(got) == 3
    assert sorted(map(tuple, langid.training_sample(docs.repartition(7)).collect())) == sorted(map(tuple, langid.training_sample(docs).collect()))
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    with pytest.raises(ValueError):
        langid.training_sample(docs)


def brute_faults(left, right):
    """Statuses of the left side's (archive, offset, length, hash), by looking at each place."""
    there = collections.defaultdict(set)
    for a, o, n, h in right:
        there[(a, o)].add((n, h))
    own = {(a, o): (n, h) for a, o, n, h in left}
    wrong = {k for k in {*own, *there} if there[k] != ({own[k]} if k in own else set())}
    stray = {(k[0], x) for k in wrong for x in there[k]}
    status = lambda k: "intact" if k not in wrong else "moved" if (k[0], own[k]) in stray else "corrupt" if there[k] else "missing"
    return {k: status(k) for k in own}


def test_warc_audit(spark):
    rnd = random.Random(6)
    rows = [(None, None, None), (None, "u", "x"), (7, "u", ""), (7, "u", ""), (8, "u", "é" * 50_000), *((i, f"http://h/{i}", "body " * rnd.randint(0, 80)) for i in range(20, 400))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("x")).withColumn("node", F.lit("x"))
    records = pages.select("page_id", "archive", "node", warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    laid = warc.lay_out(warc.hashed(records), 20_000)
    left = sorted((r["archive"], r["offset"], r["length"], r["sha256"]) for r in laid.collect())
    assert len(left) == len(rows)
    for k, (a, o, n, _) in enumerate(left):
        assert o == 0 if k == 0 or left[k - 1][0] != a else o == left[k - 1][1] + left[k - 1][2]
    hurt = [(a, o, n, h if rnd.random() > 0.05 else "0" + h[1:]) for a, o, n, h in left if rnd.random() > 0.03]
    shifted = [(a, o + 3 if a == 2 else o, n, h) for a, o, n, h in left if (a, o) != left[30][:2]]  # all of one archive moved
    closed_up = [(a, o - left[30][2] if a == left[30][0] and o > left[30][1] else o, n, h) for a, o, n, h in left if (a, o) != left[30][:2]]
    for right in (hurt, shifted, closed_up, left, [], left + left[:5], hurt + [(99, 0, 5, "x")]):
        other = spark.createDataFrame([(*r, None) for r in right], "archive long, offset long, length long, sha256 string, id long")
        got = {(r["archive"], r["offset"]): r["status"] for r in warc.audit(laid, other, 500).collect()}
        assert got == brute_faults(left, right)
    other = spark.createDataFrame([(*r, None) for r in left[:-1]], "archive long, offset long, length long, sha256 string, id long")
    assert [tuple(r) for r in warc.mismatches(other, laid.select(*other.columns), 500).collect()] == [(*left[-1][:2], "extra")]
    assert warc.audit(laid.limit(0), laid).count() == 0


def test_warc_archives(spark, tmp_path):
    rows = [(1, "http://a/", "line\r\n\r\nmore é"), (2, "http://b/", ""), (3, "", "WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 900\r\n\r\nx"), *((i, f"u{i}", "y" * i) for i in range(4, 60))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rec = pages.select("page_id", warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    laid = warc.lay_out(rec.select(F.col("page_id").alias("id"), F.octet_length("record").cast("bigint").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("sha256"), "record"), 3000)
    warc.write_archives(laid, str(tmp_path / "w"))
    back = warc.read_archives(spark, str(tmp_path / "w"))
    assert sorted((r["id"], r["url"], bytes(r["payload"]).decode(), r["flaw"]) for r in back.collect()) == [(*r, None) for r in rows]
    key = lambda df: sorted((int(r["archive"]), r["offset"], r["length"], r["sha256"], r["id"]) for r in df.select("archive", "offset", "length", "sha256", "id").collect())
    assert key(warc.leaves(back)) == key(laid)
    # A cut-off file, a flipped byte, and padding between records.
    shutil.copytree(tmp_path / "w", tmp_path / "v")
    files = sorted((int(f.parent.name.split("=")[1]), f) for f in (tmp_path / "v").rglob("*.txt"))
    for n, (_, f) in enumerate(files[:3]):
        data = f.read_bytes()
        f.write_bytes([data[:-9], data.replace(b"yyyy", b"yyzy", 1), data.replace(b"WARC/1.0", b"pad WARC/1.0", 2)][n])
    for crc in (tmp_path / "v").rglob(".*.crc"):
        crc.unlink()
    other = warc.read_archives(spark, str(tmp_path / "v"))
    flaws = collections.Counter((int(r["archive"]), r["flaw"]) for r in other.where("flaw is not null").collect())
    assert flaws[(files[0][0], "truncated")] == 1 and flaws[(files[2][0], "garbage")] == 2 and (files[1][0], "truncated") not in flaws
    left, right = (sorted((r["archive"], r["offset"], r["length"], r["sha256"]) for r in warc.leaves(x).collect()) for x in (back, other))
    got = {(r["archive"], r["offset"]): r["status"] for r in warc.audit(warc.leaves(back), warc.leaves(other), 500).collect()}
    assert got == brute_faults(left, right)
    assert {"corrupt", "moved"} <= set(got.values())


def brute_links(rows):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    for i, _ in sets:
        root(i)
    for x, (i, s) in enumerate(sets):
        for j, u in sets[x + 1 :]:
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in sets}


def test_stars():
    rnd = random.Random(8)
    for _ in range(50):
        edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(rnd.randint(0, 40))]
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        u, v = components.stars(*np.array(edges, np.int64).reshape(-1, 2).T)
        assert dict(zip(u.tolist(), v.tolist())) == {x: root(x) for e in edges for x in e if root(x) != x}


@pytest.mark.parametrize("task_edges", [10, 1000])
def test_components(spark, task_edges):
    rnd = random.Random(12)
    edges = [(i, i + 1) for i in range(0, 90) if i % 30 < 29] + [(500, 600 + i) for i in range(40)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)] + [(7, None), (None, 3), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r["node"]: r["component"] for r in components.components(df, task_edges=task_edges).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(df.limit(0)).count() == 0


def test_clashing_class_keys_are_told_apart(frame):
    sets = [np.arange(k, k + 9, dtype=np.uint64) for k in range(40)]
    assert jaccard.class_keys([sets[0][:0], *sets]) == [jaccard.class_key(s) for s in [sets[0][:0], *sets]]
    keys = [(one % 5, other) for one, other in jaccard.class_keys(sets)]
    clash = {one for one, _ in keys if len({b for a, b in keys if a == one}) > 1}
    assert clash and len({b if a in clash else a for a, b in keys}) == 40
    spark = frame([]).sparkSession
    survey = spark.createDataFrame([(0, a, b, 9) for a, b in keys], "kind int, cls long, other long, n long")
    assert jaccard._clashes(survey) == clash


@pytest.mark.parametrize("frequent", [1, 8, 1000])
def test_jaccard_join(frame, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    want = brute_links(ROWS)
    out = jaccard.link_documents(frame(ROWS)).collect()
    assert len(out) == len(ROWS)
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(i, want.get(i)) for i, _, _ in ROWS}
    assert sorted((r["doc_id"] or 0, r["n_shingles"]) for r in out) == sorted((i or 0, len(shingles(t))) for i, t, _ in ROWS)
    assert jaccard.link_documents(frame(EMPTY)).count() == 0


@pytest.mark.parametrize("hot, ordered, block, rounds, frequent", [(2, 3, 4, 0, 1), (2, 1000, 2, 1, 4), (5, 4, 100, 2, 1000), (10**6, 2, 5, 0, 2)])
def test_families_around_the_threshold(frame, monkeypatch, hot, ordered, block, rounds, frequent):
    """Near copies with all numbers of edits, whose lists and blocks are divided as those of large families are."""
    for name, value in (("HOT", hot), ("ORDERED", ordered), ("BLOCK", block), ("ROUNDS", rounds), ("FREQUENT", frequent), ("LISTS", 3), ("MEMBERS", 7), ("CHUNK", 2), ("HELD_BYTES", 200)):
        monkeypatch.setattr(jaccard, name, value)
    rnd = random.Random(hot + block)
    rows = []
    for family in range(5):
        n = rnd.choice([25, 40, 90])
        base = [f"f{family}w{k}" for k in range(n)]
        for _ in range(28):
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(n)] = f"e{rnd.randrange(40)}"
            rows.append((len(rows), " ".join(words[rnd.randint(0, 3) :]), None))
    want = brute_links(rows)
    out = jaccard.link_documents(frame(rows).repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert 5 < len(set(want.values())) < len(rows)


def test_similar_sets_share_entries():
    """Any two sets that are similar enough have an index entry in common, whatever tokens count as frequent."""
    rng = np.random.default_rng(4)
    for _ in range(3000):
        n = int(rng.integers(3, 60))
        pool = np.unique(rng.integers(0, 1 << 63, 3 * n).astype(np.uint64) * np.uint64(2))
        often = set(pool[rng.random(len(pool)) < rng.choice([0.0, 0.3, 0.9, 1.0])].tolist())
        x = np.sort(rng.choice(pool, n, replace=False))
        drop = int(rng.integers(0, n // 4 + 1))
        kept = np.sort(rng.choice(x, n - drop, replace=False))
        rest = np.setdiff1d(pool, x)
        y = np.union1d(kept, rng.choice(rest, min(len(rest), int(rng.integers(0, n // 4 + 1))), replace=False))
        common = len(np.intersect1d(x, y))
        if 100 * common < 75 * (len(x) + len(y) - common) or np.array_equal(x, y):
            continue
        (ex, _), (ey, _) = (jaccard.index_entries(s, np.array([t in often for t in s.tolist()], bool)) for s in (x, y))
        shared = len(np.intersect1d(ex, ey))
        assert shared, (n, len(y), common)
        assert shared >= jaccard.least_common(np.array([min(len(x), len(y))]), np.array([max(len(x), len(y))]))[0]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://a.EXAMPLE.com/en/x", "http://www.example.com/en/", "http://x.net/es/1", "http://net", "http://bad.org/p/?b=2&a=1&utm_x=3#f", "https://BAD.org/p?a=1&b=2", "http://bad.org/p", "http://com", "http://notexample.com/en/", "http://ok.org/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(3, urls[3], "clash")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://bad.org/p?a=1&b=2",), (None,), ("http://bad.org/p?a=1&b=2",)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, listed).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.com", "/en/x", "example.com/en/", "block"),
        4: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 5: ("x.net", "/es/1", "net/es/", "block"), 6: ("net", "", None, "allow"),
        7: ("bad.org", "/p/", None, "block"), 8: ("bad.org", "/p", None, "block"), 9: ("bad.org", "/p", None, "allow"), 10: ("com", "", None, "allow"),
        11: ("notexample.com", "/en/", "com/", "allow"), 12: ("ok.org", "/", None, "allow"),
    }
    assert urlfilter.judge_urls(pages.limit(0), listed).count() == 0
    assert urlfilter.judge_urls(pages, listed.limit(0)).where("verdict = 'block' and rule is null").count() == 0


def test_bloom_has_no_false_negatives(spark):
    listed = spark.range(5000).select(F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".org/"), "id").alias("url"))
    probe = listed.unionByName(spark.range(5000).select(F.concat(F.lit("http://other.org/"), "id").alias("url")))
    hits = urlfilter.listed_hits(probe, listed)
    assert hits.where("is_listed").count() == 5000


def test_junk_labels_decide_pages_without_a_rule(spark, tmp_path):
    from strandweave.llm import queries

    hosts = ["blog.adult-x.example.net", "cheap-pills.org", "a.free-bets.org", "ads-track.org", "spam-farm.org", "x.casino-win.org", "ok.org", "notspam-farm.org"]
    spark.createDataFrame([(i, f"http://{h}/en/{i}.html", "") for i, h in enumerate(hosts)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["is_listed"]) for r in queries.queries()["op7_url_filter_junk_labels"](spark, str(tmp_path)).collect()}
    assert got == {i: (None, "block" if i < 6 else "allow", i < 6) for i in range(len(hosts))}


def test_quality_counts(frame):
    out = quality.judge_quality(frame(ROWS), keep=("doc_id", "text")).collect()
    assert len(out) == len(ROWS)
    for r in out:
        t = r["text"] or ""
        w = WORD.findall(t)
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.judge_quality(frame(EMPTY)).count() == 0


def test_compression_bands():
    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    rnd = random.Random(2)
    prose = " ".join(rnd.choice(["the", "cat", "sat", "on", "mat", "with"]) + rnd.choice("abcdefghij") * rnd.randint(1, 3) + str(rnd.randint(0, 99)) for _ in range(3000))
    noise = bytes(rnd.randrange(256) for _ in range(20000))
    assert quality.compression(prose.encode(), press)[0]
    assert not quality.compression(noise, press)[0]
    assert not quality.compression(b"word again " * 2000, press)[0]
    mostly = prose.encode()[:8192] + noise
    assert quality.compression(mostly, press)[2] >= 3


def _words(rnd, n):
    return ["".join(rnd.choices("etaoinshrdlu", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3], k=rnd.randint(2, 9))) for _ in range(n)]


def test_compression_rejects_word_runs():
    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    rnd = random.Random(3)
    for copies in range(5, 9):
        for n in (180, 240, 300, 700, 1500, 3000, 8000, 40000):
            runs = " ".join(" ".join([w] * copies) for w in _words(rnd, n // copies))[:n]
            assert not quality.compression(runs.encode(), press)[0], (copies, n)
            assert quality.compression(" ".join(_words(rnd, n))[:n].encode(), press)[1] < 2.2
    plain = " ".join(_words(rnd, 4000))
    assert quality.compression(plain[:5000].encode(), press)[2:] == (0, 0, 2)
    assert quality.compression((plain[:4096] + "again " * 600).encode(), press)[2:] == (0, 1, 2)
    assert quality.compression("".join(rnd.choices("абвгдежзиклмнопрст ", range(19, 0, -1), k=3000)).encode(), press)[0]


def test_ceilings_rise_without_a_jump():
    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    rnd = random.Random(4)
    few = ["ba", "lo", "mi", "ka", "te"]
    for n in (200, 300, 450, 600, 760, 780, 900, 1000, 1030, 1200, 1500, 1700, 2500, 6000, 20000):
        ceiling = lambda size: np.interp(np.log2(size), quality._CEILING_AT, quality._CEILING)
        assert 0 <= ceiling(1.05 * n) - ceiling(n) < 0.1, n
        for _ in range(5):
            # Prose of few syllables is kept, and so is each word twice in a row; from five times on it is not.
            prose = " ".join("".join(rnd.choices(few, k=rnd.randint(1, 4))) for _ in range(n))[:n]
            twice, often = (" ".join(" ".join([w] * k) for w in _words(rnd, n // k))[:n] for k in (2, 5))
            assert quality.compression(prose.encode(), press)[0] and quality.compression(twice.encode(), press)[0], n
            assert not quality.compression(often.encode(), press)[0], n


def test_compression_rejects_noise_in_letters():
    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    rnd = random.Random(5)
    letters = string.ascii_letters + string.digits
    for n in (300, 406, 600, 949, 1300, 1800, 2700, 5000, 8192, 30000, 81000):
        alnum = " ".join("".join(rnd.choices(letters, k=rnd.randint(3, 10))) for _ in range(n // 3))[:n]
        for noise in (base64.encodebytes(rnd.randbytes(n))[:n], alnum.encode(), bytes(rnd.choices(range(33, 127), k=n))):
            good, _, low, _, chunks = quality.compression(noise, press)
            assert not good and low == chunks, n
        # Hex has 4 bits a letter and compresses like prose: no ratio tells it from clean text.
        assert quality.compression(rnd.randbytes(n).hex().encode()[:n], press)[1] > 1.5
    han = [chr(0x4E00 + 7 * i) for i in range(2500)]
    for n in (60, 200, 1000, 5000):
        text = "".join(rnd.choices(han, [1 / (i + 5) for i in range(2500)], k=n))
        assert quality.compression(text.encode(), press)[0], n


def test_fingerprints(frame):
    own = [r for r in ROWS if r[0] not in (3,)]
    out = {r["doc_id"]: r for r in fingerprint.compare_with_next(frame(own)).collect()}
    ring = sorted((i, t or "") for i, t, _ in own if i is not None)
    for k, (i, t) in enumerate(ring):
        n = len(t) // 4
        edited = t[: len(t) - n] + ring[(k + 1) % len(ring)][1][:n]
        assert out[i]["n_chars"] == len(t)
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert len({out[100 + i]["fingerprint"] for i in range(12)}) == 1
    assert [out[100 + i]["near_next"] for i in range(11)] == [1.0] * 11
    assert out[401]["fingerprint"] == out[400]["fingerprint"] == ""
    assert all(out[i]["fingerprint"] for i, t in ring if WORD.search(t))
    a, b = (shingles_cased(t) for t in (dict(ring)[403], ring[[i for i, _ in ring].index(404)][1]))
    assert abs(out[403]["near_next"] - len(a & b) / len(a | b)) < 0.05
    assert fingerprint.compare_with_next(frame(EMPTY)).count() == 0
    assert fingerprint.compare_with_next(frame(ROWS)).count() == len(ROWS)


def shingles_cased(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketches_merge(spark):
    # x and y share four words, so the shingles of the whole are those of the two parts.
    rnd, rows = random.Random(4), []
    for case in range(120):
        m, n = rnd.choice([(5, 5), (5, 6), (6, 200), (5, 200), (40, 7), (150, 300)])
        w = [f"w{case}x{i}" for i in range(m + n - 4)]
        rows.append((" ".join(w[:m]), " ".join(w[m - 4 :]), " ".join(w)))
    rows += [("", "a b c d e", "a b c d e"), ("", "", "")]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    for c in "xyz":
        df = fingerprint.with_sketch(df, c, "s" + c)
    x, y, z = map(F.col, ("sx", "sy", "sz"))
    out = df.select("sx", "sy", "sz", fingerprint.merged(x, y).alias("m"), fingerprint.likeness(x, z).alias("like"), fingerprint.containment(x, z).alias("in_z"), fingerprint.containment(z, x).alias("in_x")).collect()
    limit = fingerprint._limit(fingerprint.SCALE)
    for r in out:
        assert r["m"] == r["sz"]
        below = [{h for h in r[c] if h < limit} for c in ("sx", "sz")]
        if below[0]:
            assert r["in_z"] == 1.0 and r["like"] == r["in_x"] == len(below[0]) / len(below[1])
        elif r["sx"] and below[1]:
            assert r["in_z"] is None and r["like"] == 0.0
    assert (out[-1]["like"], out[-1]["in_z"]) == (1.0, 1.0)


def test_packing(frame):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    rows = [*ROWS, (9001, "x <|endoftext|>y<|endoftext|>", None), (9002, "<|endoftext|>" + "long word " * 20_000, None)]
    out = packing.pack(frame(rows), path, window=64, group_docs=20).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 64):
            want[(i, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes()), len(ids))] += 1
    assert want == collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out)
    windows = collections.defaultdict(list)
    for r in out:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(frame(EMPTY), path).count() == 0
    # In another layout the pieces are the same, and about as many windows are opened.
    other = packing.pack(frame(rows).repartition(7), path, window=64, group_docs=20).collect()
    assert want == collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in other)
    assert abs(len({r["sequence_id"] for r in other}) - len(windows)) <= 0.05 * len(windows) + 3


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 65, 200)
        place, offset, count = packing.best_fit_decreasing(lengths, 64)
        room, at = [], np.argsort(-lengths, kind="stable")
        for i in at:
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - lengths[i])
            else:
                room.append(64 - lengths[i])
        assert count == len(room)
        filled = np.bincount(place, lengths, count)
        assert sorted(64 - filled) == sorted(room)


def test_encoder_is_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    encode = packing.encoder(path)
    rnd = random.Random(1)
    for _ in range(1500):
        t = "".join(rnd.choice("ab AB\n\t  é中文𝒳'’.,;!?0123   \r\n<|endoftext|>'s'lĺß") for _ in range(rnd.randint(0, 60)))
        assert encode(t).tolist() == tk.encode(t, add_special_tokens=False).ids, t
    parts = ["<|endoftext|>", "<|endoftext|", "|>", "<|", " ", "  ", "\n", "ab", "'s", "12", "é", "中"]
    for _ in range(1500):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert encode(t).tolist() == tk.encode(t, add_special_tokens=False).ids, t
    assert encode("hello <|endoftext|> x").tolist() == [31373, 220, 50256, 2124]
