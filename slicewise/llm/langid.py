"""Language identification with interpolated Kneser-Ney character models.

For every language a model of order ``ORDER`` over the lower-cased letters of words, a
word by itself between boundary signs.  Highest-order counts are raw, lower orders
count distinct left contexts, every order is discounted and interpolated with the one
below, the lowest with a uniform share for letters never seen.  N-grams and contexts
are 64-bit hashes in sorted arrays, one per order for all languages, with a directory
by leading bits; a row of values per language goes with each.

The prediction is the language of the lowest cross-entropy per letter.  A softmax of
the negative cross-entropies, its temperature fitted on labelled rows that the models
don't see, gives the score; texts above the cross-entropy that ``ACCEPT`` of those
rows stay under are marked as not accepted (rejected), the best language still named.

Learning reads about ``TRAIN_DOCS`` + ``CALIBRATION_DOCS`` labelled documents per
language at most, and fewer where these would have more than ``SAMPLE_BYTES``, chosen by
a hash of the id: the classifier's documented bound.  Scoring reads every whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0; without
labelled rows every text is ``und``; equal texts get equal predictions; an empty table
gives an empty result; rows with a null language or a null id are predicted but not learnt
from, and a null id is not held out; columns other than those named are not read, so their
names can't clash.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, mix, pieces_of, shipped, span_hashes, text_buffer

ORDER, TRAIN_DOCS, CALIBRATION_DOCS, ACCEPT = 4, 500, 200, 0.995
SAMPLE_BYTES = 32 << 20  # of a language's texts, for learning and for calibration
START, END = 1, 2

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Lower case of every code point that is a letter, 0 for the others."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def letter_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of a text column, and first, end and row of each run of letters."""
    flat, at = text_buffer(column)
    points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.append(0, np.cumsum((flat & 0xC0) != 0x80))
    cut = heads[at]
    low = letter_table()[points]
    word = low > 0
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = cut[(cut > 0) & (cut < len(points))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return low, starts, stops, np.searchsorted(cut, starts, side="right") - 1


class HashArray:
    """Sorted 64-bit hashes with a row of values each, and a directory by their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        order = np.argsort(keys)
        self.keys, bits = keys[order], max(1, int(np.ceil(np.log2(len(keys) + 1))))
        self.values = np.concatenate([values[order], np.full((1, values.shape[1]), missing)]).astype(np.float32)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)
        self.keys = np.append(self.keys, np.uint64(0))
        self.most = int(np.diff(self.first).max(initial=0))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        top = (keys >> self.shift).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(keys), len(self.keys) - 1, np.int64)
        open_ = np.flatnonzero(at < end)
        at, end, want = at[open_], end[open_], keys[open_]
        for _ in range(self.most):
            hit = self.keys[at] == want
            out[open_[hit]] = at[hit]
            at = at + 1
            live = ~hit & (at < end)
            if not live.any():
                break
            open_, at, end, want = open_[live], at[live], end[live], want[live]
        return self.values[out]


def gram_keys(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols up to and with each place (the places from k - 1 on are meaningful)."""
    total = np.full(len(symbols), (k * 0x9E3779B97F4A7C15) % (1 << 64), np.uint64)
    for i in range(k - 1, -1, -1):
        shifted = symbols if i == 0 else np.concatenate([np.zeros(i, symbols.dtype), symbols[:-i]])
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + shifted.astype(np.uint64))
    return total


def _one_key(gram: str) -> int:
    return int(gram_keys(np.array([ord(c) for c in gram], np.uint32), len(gram))[-1]) if gram else 0


class LanguageModels:
    """Kneser-Ney models of all languages from counts of ORDER-grams (boundary signs included)."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        n = len(self.langs)
        self.temperature, self.limit = 1.0, math.inf
        letters = {c for table in counts.values() for g in table for c in g}
        self.uniform = 1.0 / (len(letters) + 1)
        self.grams, self.contexts = [], []
        values: list[dict[str, list[float]]] = [defaultdict(lambda: [0.0] * n) for _ in range(ORDER)]
        weights: list[dict[str, list[float]]] = [defaultdict(lambda: [1.0] * n) for _ in range(ORDER)]
        for at, lang in enumerate(self.langs):
            table = counts[lang]
            for k in range(ORDER, 0, -1):
                ones, twos = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
                discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
                total, kinds = Counter(), Counter()
                for g, c in table.items():
                    total[g[:-1]] += c
                    kinds[g[:-1]] += 1
                for g, c in table.items():
                    values[k - 1][g][at] = (c - discount) / total[g[:-1]] if c > discount else 0.0
                for ctx, c in total.items():
                    weights[k - 1][ctx][at] = discount * kinds[ctx] / c
                lower = Counter(g[1:] for g in table)  # distinct left contexts
                table = {g: c for g, c in lower.items() if not g.endswith(chr(START))}
        for k in range(ORDER):
            for store, rows, missing in ((self.grams, values[k], 0.0), (self.contexts, weights[k], 1.0)):
                keys = np.array([_one_key(g) for g in rows], np.uint64)
                store.append(HashArray(keys, np.array(list(rows.values()), np.float64).reshape(len(rows), n), missing))

    def word_bits(self, low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Minus log2 of each word's probability, boundary sign included, per language."""
        pad = ORDER - 1
        size = stops - starts
        width = size + pad + 1
        ends = np.cumsum(width)
        symbols = np.full(int(ends[-1]), START, np.uint32)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        symbols[np.repeat(ends - width + pad, size) + inner] = low[np.repeat(starts, size) + inner]
        symbols[ends - 1] = END
        scored = np.ones(len(symbols), bool)
        for i in range(pad):
            scored[ends - width + i] = False
        p = np.full((int(scored.sum()), len(self.langs)), self.uniform, np.float32)
        for k in range(1, ORDER + 1):
            before = np.zeros(len(p), np.uint64) if k == 1 else np.append(np.uint64(0), gram_keys(symbols, k - 1)[:-1])[scored]
            p = self.grams[k - 1](gram_keys(symbols, k)[scored]) + self.contexts[k - 1](before) * p
        return np.add.reduceat(-np.log2(p), np.cumsum(size + 1) - (size + 1), axis=0)

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol of every text and language, and whether it has a letter."""
        low, starts, stops, row = letter_words(column)
        bits = np.zeros((len(column), len(self.langs)))
        if not len(starts):
            return bits, np.zeros(len(column), bool)
        values = low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, first, which = np.unique(span_hashes(values ^ (values >> np.uint64(31)), starts, stops), return_index=True, return_inverse=True)
        words = self.word_bits(low, starts[first], stops[first])
        symbols = np.bincount(row, weights=stops - starts + 1, minlength=len(column))
        for i in range(len(self.langs)):
            bits[:, i] = np.bincount(row, weights=words[which, i], minlength=len(column))
        return bits / np.maximum(symbols, 1)[:, None], symbols > 0

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """Softmax of the negative cross-entropies at the fitted temperature."""
        x = np.exp(-(bits - bits.min(axis=1, keepdims=True)) * self.temperature)
        return x / x.sum(axis=1, keepdims=True)

    def calibrate(self, bits: np.ndarray, truth: np.ndarray) -> None:
        """Fit temperature (least log loss) and the limit of acceptance."""
        if not len(truth):
            return

        def loss(t):
            self.temperature = t
            return -np.log(np.maximum(self.scores(bits)[np.arange(len(truth)), truth], 1e-9)).mean()

        self.temperature = min((2.0**e for e in range(-2, 9)), key=loss)
        self.limit = float(np.quantile(bits[np.arange(len(truth)), truth], ACCEPT))


def _counted(batches):
    """(lang, gram, n) of the ORDER-grams in each batch of (lang, text)."""
    for batch in batches:
        langs, tables = batch.column(0).to_pylist(), defaultdict(Counter)
        for part_at, part in _with_start(pieces_of(batch, "text")):
            low, starts, stops, row = letter_words(part.column(1))
            text = low.tobytes().decode("utf-32-le")
            words: dict[str, Counter] = defaultdict(Counter)
            for s, e, r in zip(starts.tolist(), stops.tolist(), row.tolist(), strict=True):
                words[langs[part_at + r]][text[s:e]] += 1
            for lang, table in words.items():
                for w, c in table.items():
                    padded = chr(START) * (ORDER - 1) + w + chr(END)
                    for i in range(len(w) + 1):
                        tables[lang][padded[i : i + ORDER]] += c
        rows = [(lang, g, c) for lang, t in tables.items() for g, c in t.items()]
        yield pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "gram": [r[1] for r in rows], "n": [r[2] for r in rows]}, schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))


def _with_start(parts):
    at = 0
    for p in parts:
        yield at, p
        at += p.num_rows


def fold(id_col: str):
    return F.crc32(col(id_col).cast("string").cast("binary")) % 4


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> LanguageModels:
    """Models from labelled documents whose fold is 0 or 1, calibrated on fold 3; fold 2 is never read."""
    known = shipped(docs).where(col(lang_col).isNotNull() & col(id_col).isNotNull()).select(col(lang_col).alias("lang"), fold(id_col).alias("f"), col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    # A count per language and role comes to the driver, so that texts are picked in the scan and move nowhere.
    sizes = known.groupBy("lang").agg(F.count_if(F.col("f") < 2).alias("train"), F.count_if(F.col("f") == 3).alias("held"), F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).collect()
    draw, chosen = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(5)), F.lit(1_000_000)), F.lit(False)
    for r in sizes:
        for some, count, bound in ((F.col("f") < 2, r.train, train_docs), (F.col("f") == 3, r.held, calibration_docs)):
            bound = min(bound, SAMPLE_BYTES * r.n / max(1, r.bytes or 0))  # documents of the language's mean size
            chosen = chosen | ((F.col("lang") == r.lang) & some & (draw * count < 1_000_000 * bound))
    picked = known.where(chosen).select("lang", "text", "f")
    grams = picked.where("f < 2").select("lang", "text").mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, g, n in zip(grams["lang"].to_pylist(), grams["gram"].to_pylist(), grams["n"].to_pylist(), strict=True):
        counts[lang][g] = n
    models = LanguageModels(counts)
    if models.langs:
        place = {lang: i for i, lang in enumerate(models.langs)}
        shared = docs.sparkSession.sparkContext.broadcast(models)

        def score(batches):
            for batch in batches:
                for at, part in _with_start(pieces_of(batch, "text")):
                    bits, letters = shared.value.entropies(part.column(1))
                    langs = batch.column(0).slice(at, part.num_rows).to_pylist()
                    keep = [i for i, lang in enumerate(langs) if letters[i] and lang in place]
                    yield pa.RecordBatch.from_arrays([pa.array([place[langs[i]] for i in keep], pa.int64()), pa.array([bits[i].tolist() for i in keep], pa.list_(pa.float64()))], names=["truth", "bits"])

        held = picked.where("f = 3").select("lang", "text").mapInArrow(score, "truth long, bits array<double>").toArrow()
        models.calibrate(np.array(held["bits"].to_pylist(), np.float64).reshape(-1, len(place)), held["truth"].to_numpy())
    return models


def predict(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, accepted and bits (cross-entropy per symbol of the language named)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, "text"):
                m, n = shared.value, part.num_rows
                lang, score, best, ok = np.full(n, "und", object), np.zeros(n), np.zeros(n), np.zeros(n, bool)
                if m.langs:
                    bits, letters = m.entropies(part.column(1))
                    at = bits.argmin(axis=1)
                    lang = np.where(letters, np.array(m.langs, object)[at], "und")
                    best = np.where(letters, bits.min(axis=1), 0.0)
                    score = np.where(letters, m.scores(bits).max(axis=1), 0.0)
                    ok = letters & (best <= m.limit)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(ok), pa.array(best)], names=["id", "lang_pred", "score", "accepted", "bits"])

    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("accepted", T.BooleanType()), ("bits", T.DoubleType())]
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return shipped(rows).mapInArrow(run, T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(*f) for f in fields]]))


def op5_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted", "bits")
