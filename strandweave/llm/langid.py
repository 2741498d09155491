"""Language identification by a linear-chain conditional random field over words.

Each word's emission is the sum of learned weights of its byte trigrams (those
at its ends hold the boundary), its affixes and its entry in a hashed lexicon;
learned transitions tie neighbouring words together, so that a passage in another
language inside a text gets its own label.  Forward-backward gives every word's
label probabilities (``label_words``); a document's language is the one with the
largest mean, and that mean is the score.

The training texts have one language each.  So that the transitions see switches,
chains of code-switched text are made of passages of several of them, in a fixed
random order, beside the texts themselves.

Chains are long and short, so they are cut into chunks that advance in lockstep:
first every chunk's transfer matrix, then the states at the chunk edges, then the
states inside.  The result is that of one pass along the whole text.  With many languages
whole chains advance in lockstep.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from strandweave.llm._common import pieces_by_bytes, utf8_of
from strandweave.llm._words import Words, words_of

#: Bounds of the training sample: documents for each language, code points of a document (a passage of a longer one), of all together,
#: and of all together times the number of languages.
TRAIN_DOCS = 150
TRAIN_CHARS = 20_000
TRAIN_TOTAL = 4_000_000
TRAIN_CELLS = 64_000_000
#: Words times languages whose states training holds at a time, unless one text has more.
BATCH_CELLS = 1 << 21
#: More labels than this are refused.
MAX_LANGS = 200
#: Bytes of text times languages whose states a task holds at a time, unless one text has more.
PIECE_CELLS = 1 << 23
#: Code-switched chains for each training text, passages in one, and words of a passage.
MIXED, PASSAGES, PASSAGE_WORDS = 0.5, 4, (2, 40)
EPOCHS = 25
RATE = 0.3
DECAY = 1e-4
GRAM_BITS, AFFIX_BITS, LEXICON_BITS = 16, 15, 16
#: Words of a chunk of a chain; a chunk's transfer matrix costs the cube of the number of languages, so beyond CHUNK_LANGS chains stay whole.
CHUNK, CHUNK_LANGS = 64, 16
UNKNOWN = "und"

#: Lower-cased letters and all bytes beyond ASCII stay, everything else parts words.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


@dataclass
class Features:
    """Feature numbers: ``grams`` for the bytes of all words one after the other, the rest for each word."""

    grams: np.ndarray
    gram_word: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray
    first: np.ndarray


def _hashed(values: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((values.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int32)


def features_of(data: np.ndarray, offsets: np.ndarray) -> Features:
    text = _LETTERS[data]
    found: Words = words_of(text, offsets)
    padded = np.concatenate([[0x20], text, [0x20, 0x20, 0x20]]).astype(np.uint32)
    inside = text != 0x20
    at = np.flatnonzero(inside)
    before, here, behind = padded[at], padded[at + 1], padded[at + 2]
    # A text's first and last bytes have the next text as neighbour unless it is masked.
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(text))]
    if len(edge):
        place = np.searchsorted(at, edge)
        hit = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == edge) if len(at) else np.zeros(0, bool)
        before[place[hit]] = 0x20
        place = np.searchsorted(at, edge - 1)
        hit = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == edge - 1) if len(at) else np.zeros(0, bool)
        behind[place[hit]] = 0x20
    grams = _hashed(before << np.uint32(16) | here << np.uint32(8) | behind, GRAM_BITS)
    size = found.end - found.start
    first_at = np.searchsorted(at, found.start)

    def end_bytes(reverse: bool) -> np.ndarray:
        value = np.zeros(len(size), np.uint32)
        for k in range(4):
            byte = padded[1 + (found.end - 1 - k if reverse else np.minimum(found.start + k, found.end - 1))]
            value = value << np.uint32(8) | np.where(size > k, byte, 0).astype(np.uint32)
        return _hashed(value, AFFIX_BITS)

    lexicon = (found.hashes() >> np.uint64(64 - LEXICON_BITS)).astype(np.int32)
    return Features(grams, first_at, end_bytes(False), end_bytes(True), lexicon, found.first)


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray
    trans: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        if not len(f.prefix):
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.add.reduceat(self.grams[f.grams], f.gram_word, axis=0)
        return out + self.prefix[f.prefix] + self.suffix[f.suffix] + self.lexicon[f.lexicon]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.reshape(len(x), -1).sum(1).reshape((-1,) + (1,) * (x.ndim - 1))


def forward_backward(emissions: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word the scaled forward and backward vectors and exp(emission).

    ``first`` holds the word offsets of the chains (length chains + 1).
    """
    n, k = emissions.shape
    weight = np.exp((emissions - emissions.max(1, keepdims=True)).astype(np.float64))
    step = np.exp(trans.astype(np.float64))
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    lengths = np.diff(first)
    chunk = CHUNK if k <= CHUNK_LANGS else max(1, int(lengths.max(initial=0)))
    per = -(-lengths // chunk)
    chain = np.repeat(np.arange(len(lengths)), per)
    begin_chunk = np.concatenate([[0], np.cumsum(per)])
    number = np.arange(len(chain)) - begin_chunk[chain]
    start = first[chain] + number * chunk
    size = np.minimum(chunk, first[chain + 1] - start)
    order = np.argsort(-size, kind="stable")
    start_o, size_o = start[order], size[order]
    alive = np.searchsorted(-size_o, -np.arange(chunk + 1), side="left").tolist()  # chunks of more than t words
    most = int(size.max()) if len(size) else 0
    # Transfer matrices, only of chains with several chunks.
    enter_a = np.full((len(chain), k), 1.0 / k)
    enter_b = np.ones((len(chain), k))
    if len(per) and per.max() > 1:
        matrix = np.broadcast_to(np.eye(k), (len(chain), k, k)).copy()
        for t in range(most):
            m = alive[t]
            got = (matrix[:m] @ step) * weight[start_o[:m] + t][:, None, :]
            matrix[:m] = got / got.sum((1, 2), keepdims=True)
        by_chunk = np.empty_like(matrix)
        by_chunk[order] = matrix
        long = np.flatnonzero(per > 1)
        long = long[np.argsort(-per[long], kind="stable")]
        for t in range(1, int(per.max())):
            now = begin_chunk[long[: int(np.searchsorted(-per[long], -t, side="left"))]] + t
            enter_a[now] = _scaled(np.einsum("ci,cij->cj", enter_a[now - 1], by_chunk[now - 1]))
        for t in range(int(per.max()) - 1, 0, -1):
            # What lies behind chunk t - 1 is chunk t and what lies behind that.
            now = begin_chunk[long[: int(np.searchsorted(-per[long], -t, side="left"))]] + t
            enter_b[now - 1] = _scaled(np.einsum("cij,cj->ci", by_chunk[now], enter_b[now]))
    state = enter_a[order]
    for t in range(most):
        m = alive[t]
        state = _scaled((state[:m] @ step) * weight[start_o[:m] + t])
        alpha[start_o[:m] + t] = state
    behind = enter_b[order]
    for t in range(most - 1, -1, -1):
        m = alive[t]
        beta[start_o[:m] + t] = behind[:m]
        behind[:m] = _scaled((behind[:m] * weight[start_o[:m] + t]) @ step.T)
    return alpha, beta, weight


def posteriors(emissions: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    alpha, beta, _ = forward_backward(emissions, trans, first)
    return _scaled(alpha * beta) if len(alpha) else alpha


def mixed_chains(rows: list[tuple[str, str]], seed: int = 7) -> list[list[tuple[str, str]]]:
    """Chains of passages (text, lang) from texts of different languages, in a fixed random order; no more words than the texts have."""
    rng = np.random.default_rng(seed)
    words = [(lang, parts) for text, lang in rows if (parts := text.split())]
    if len({lang for lang, _ in words}) < 2:
        return []
    chains = []
    most = sum(len(parts) for _, parts in words) // (PASSAGES * PASSAGE_WORDS[1] // 2)
    for _ in range(min(int(MIXED * len(words)), max(1, most))):
        chain: list[tuple[str, str]] = []
        while len(chain) < PASSAGES:
            lang, parts = words[rng.integers(len(words))]
            if not chain or chain[-1][1] != lang:
                size, start = rng.integers(*PASSAGE_WORDS), rng.integers(len(parts))
                chain.append((" ".join(parts[start : start + size]), lang))
        chains.append(chain)
    return chains


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS) -> Model:
    """A model of texts with one language each, by full-batch adaptive gradient ascent."""
    langs = sorted({lang for _, lang in rows})
    chains = [[row] for row in rows] + mixed_chains(rows)
    raw = [(text + " ").encode() for chain in chains for text, _ in chain]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    f = features_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
    first = f.first[np.concatenate([[0], np.cumsum([len(chain) for chain in chains])]).astype(np.int64)]
    k = len(langs)
    model = Model(
        langs,
        np.zeros((1 << GRAM_BITS, k), np.float32),
        np.zeros((1 << AFFIX_BITS, k), np.float32),
        np.zeros((1 << AFFIX_BITS, k), np.float32),
        np.zeros((1 << LEXICON_BITS, k), np.float32),
        np.zeros((k, k), np.float32),
    )
    n = len(f.prefix)
    if not n:
        return model
    number = {lang: j for j, lang in enumerate(langs)}
    word_label = np.repeat(np.array([number[lang] for chain in chains for _, lang in chain]), np.diff(f.first))
    bounds = np.append(f.gram_word, len(f.grams))
    params = [model.grams, model.prefix, model.suffix, model.lexicon, model.trans]
    squares = [np.full_like(t, 1e-8) for t in params]
    # Batches of whole chains, of bounded size in words times languages.
    edges = [0]
    for c in range(1, len(first)):
        if (first[c] - first[edges[-1]]) * k > BATCH_CELLS and c - 1 > edges[-1]:
            edges.append(c - 1)
    edges.append(len(first) - 1)
    for _ in range(epochs):
        grads = [np.zeros(t.shape, np.float32) for t in params]
        for c0, c1 in zip(edges[:-1], edges[1:], strict=True):
            a, b = int(first[c0]), int(first[c1])
            if a == b:
                continue
            own = Features(f.grams[bounds[a] : bounds[b]], f.gram_word[a:b] - bounds[a], f.prefix[a:b], f.suffix[a:b], f.lexicon[a:b], first[c0 : c1 + 1] - a)
            error, trans = gradient(model.emissions(own), model.trans, own.first, word_label[a:b])
            gram_word = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(bounds[a : b + 1]))
            for g, ids, words in zip(grads, (own.grams, own.prefix, own.suffix, own.lexicon), (gram_word, None, None, None), strict=False):
                for j in range(k):  # one label at a time
                    x = np.ascontiguousarray(error[:, j])
                    g[:, j] += np.bincount(ids, x if words is None else x[words], len(g))
            grads[-1] += trans
        for t, g, s in zip(params, grads, squares, strict=True):
            g /= n
            g -= DECAY / 5 * t
            s += g * g
            t += RATE * g / np.sqrt(s)
    return model


def log_likelihood(emissions: np.ndarray, trans: np.ndarray, first: np.ndarray, labels: np.ndarray) -> float:
    """Of the labels of all chains, by a plain forward pass; the first state is uniform behind a uniform one."""
    total, k = 0.0, emissions.shape[1]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            state = np.log(np.exp(trans.astype(np.float64)).sum(0) / k) + emissions[a]
            own = np.log(np.exp(trans.astype(np.float64)).sum(0) / k)[labels[a]] + emissions[a, labels[a]]
            for t in range(a + 1, b):
                state = np.logaddexp.reduce(state[:, None] + trans, axis=0) + emissions[t]
                own += trans[labels[t - 1], labels[t]] + emissions[t, labels[t]]
            total += own - np.logaddexp.reduce(state)
    return total


def gradient(emissions: np.ndarray, trans: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the labels' log-likelihood, by the emissions and by the transitions between words."""
    n, k = emissions.shape
    alpha, beta, weight = forward_backward(emissions, trans, first)
    error = -_scaled(alpha * beta)
    error[np.arange(n), labels] += 1.0
    opening = np.zeros(n, bool)
    opening[first[:-1][np.diff(first) > 0]] = True
    follows = np.flatnonzero(~opening)
    left, right, step = alpha[follows - 1], (weight * beta)[follows], np.exp(trans.astype(np.float64))
    mass = ((left @ step) * right).sum(1, keepdims=True)
    seen = np.zeros((k, k))
    np.add.at(seen, (labels[follows - 1], labels[follows]), 1.0)
    return error, seen - ((left / mass).T @ right) * step


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The bounded sample (d, t, l): for each language at most ``TRAIN_DOCS`` different texts of smallest hash of id and
    text, ``TRAIN_TOTAL`` code points in all, and no more than ``TRAIN_CELLS`` over the number of languages (but one text a language at least).

    Of a text above ``TRAIN_CHARS`` code points a passage of that length is taken, at a place that its hash tells, so a language that has
    only long texts is learned too.  Rows without a text or a language are left out; without any others the sample is empty.  The filter on the
    hash is set from the language's row count, so no more than a small multiple of the sample is ever moved.
    """
    fit = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in fit.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    where = F.lit(False)
    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30))
    langs = max(1, len(counts))
    share = min(TRAIN_TOTAL, TRAIN_CELLS // langs) // langs
    over = F.greatest(F.length(text_col) - TRAIN_CHARS, F.lit(0)) + 1
    passage = F.substring(F.col(text_col), (F.pmod(F.xxhash64(text_col), over) + 1).cast("int"), F.lit(TRAIN_CHARS))
    for lang, n in counts.items():
        where = where | ((F.col(lang_col) == lang) & (draw < int(min(1.0, 1.5 * TRAIN_DOCS / n + 20 / n) * (1 << 30))))
    got = fit.where(where).groupBy(F.col(lang_col).alias("l"), passage.alias("t")).agg(F.min(draw).alias("d"))
    upto = F.sum(F.length("t")).over(Window.partitionBy("l").orderBy("d", "t"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("d", "t"))
    kept = got.withColumn("upto", upto).withColumn("place", place).where((F.col("place") <= TRAIN_DOCS) & ((F.col("upto") <= share) | (F.col("place") == 1)))
    return kept.select("d", "t", "l")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", epochs: int = EPOCHS) -> Model:
    """A model trained on the bounded sample of ``docs``, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(tuple(r.values()) for batch in batches for r in batch.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(t, lang) for lang, _, t in rows], epochs))], pa.binary())], names=["model"])

    sample = training_sample(docs, id_col, text_col, lang_col).select("l", "d", "t")
    made = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else train([])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict_batch(model: Model, data: np.ndarray, offsets: np.ndarray, f: Features | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and number of switches between words of each text; texts without a letter get ``und`` and 0.

    ``f`` are the texts' features where they are known already.
    """
    f = features_of(data, offsets) if f is None else f
    n = len(offsets) - 1
    means, switches = np.zeros((n, len(model.langs))), np.zeros(n, np.int64)
    if len(f.prefix):
        probability = posteriors(model.emissions(f), model.trans, f.first)
        total = np.concatenate([np.zeros((1, probability.shape[1])), np.cumsum(probability, 0)])
        count = np.diff(f.first)
        some = count > 0
        means[some] = (total[f.first[1:]] - total[f.first[:-1]])[some] / count[some, None]
        label = probability.argmax(1)
        turns = np.concatenate([[0, 0], np.cumsum(label[1:] != label[:-1])])  # before each word, the last before the text's end
        switches[some] = turns[f.first[1:][some]] - turns[f.first[:-1][some] + 1]
    best = means.argmax(1)
    score = np.clip(means[np.arange(n), best], 0.0, 1.0)
    names = [model.langs[b] for b in best]
    for i in range(n):
        # ASCII letters are told by their bytes; other texts are looked at as code points.
        own = data[offsets[i] : offsets[i + 1]]
        if score[i] == 0.0 or (not ((own | 0x20) - np.uint8(97) < 26).any() and not has_letter(own.tobytes().decode())):
            names[i], score[i], switches[i] = UNKNOWN, 0.0, 0
    return names, score, switches


def word_labels(model: Model, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """For each text its words: start and end as code points, label and its probability."""
    f = features_of(data, offsets)
    if not len(f.prefix):
        return [[] for _ in offsets[1:]]
    probability = posteriors(model.emissions(f), model.trans, f.first)
    found = words_of(_LETTERS[data], offsets)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(f.first))
    start, end = (before[x] - before[offsets[text]] for x in (found.start, found.end))
    label = probability.argmax(1)
    rows = [{"start": a, "end": b, "label": model.langs[j], "probability": p} for a, b, j, p in zip(start.tolist(), end.tolist(), label.tolist(), probability.max(1).tolist(), strict=True)]
    return [rows[a:b] for a, b in zip(f.first[:-1].tolist(), f.first[1:].tolist(), strict=True)]


def over_batches(docs: DataFrame, model, langs: int, text_col: str, keep: tuple[str, ...] | None, made: dict[str, str], work) -> DataFrame:
    """``keep`` columns of ``docs`` with those that ``work(model, bytes, offsets)`` makes, as lists by name, for a model of ``langs`` languages."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    frame = docs.select(*names, F.col(text_col).alias("_sw_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema] + [f"{c} {t}" for c, t in made.items()])
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(", ".join(f"{c} {t}" for c, t in made.items())))]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    limit = min(1 << 20, PIECE_CELLS // max(1, langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces_by_bytes(big, "_sw_text", limit):
                values = work(shared.value, *utf8_of(batch.column("_sw_text")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, values, types)], names=[*names, *made])

    return frame.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with ``lang_pred``, ``score`` and ``n_switches``, how often
    neighbouring words differ in label.

    Null texts and texts without a letter are ``und`` with score 0; so is every
    text if the model knows no language.  Repeated rows are labelled alike.  Of
    clashing names, the columns made here win.
    """

    def work(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple:
        if model.langs:
            return predict_batch(model, data, offsets)
        n = len(offsets) - 1
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)

    return over_batches(docs, model, len(model.langs), text_col, keep, {"lang_pred": "string", "score": "double", "n_switches": "bigint"}, work)


def label_words(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with ``words``: start and end (code points, from 0), label and
    probability of each word, in order.

    Words are runs of letters and of code points beyond ASCII.  Null texts, texts without words and all
    texts if the model knows no language have none.  Of clashing names, ``words`` made here wins.
    """

    def work(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple:
        return ((word_labels(model, data, offsets) if model.langs else [[] for _ in offsets[1:]]),)

    return over_batches(docs, model, len(model.langs), text_col, keep, {"words": "array<struct<start: bigint, end: bigint, label: string, probability: double>>"}, work)
