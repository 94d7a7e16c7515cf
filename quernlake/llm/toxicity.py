"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features: densities of a lexicon learned from labelled texts, how near its words stand to second-person words, and rates of capitals,
punctuation, digits, repeated letters and obfuscated words. Labels train the lexicon, the trees and the calibration on three separate
parts of a bounded sample of labelled rows; every document is scored, on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import char_table, held_out

#: Labelled rows that the model is fitted on, about (rows are chosen by a hash of their id).
SAMPLE_ROWS = 24_000
#: Words of the lexicon, at most.
LEXICON_WORDS = 2_000
#: Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset(x.encode() for x in "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen euch ihr euer sie ti tú tus usted ustedes vosotros".split())
_UNLEET = bytes.maketrans(b"@013457$!|", b"aoieastsii")
_KEEP = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TO_SPACE = bytes(b if b in _KEEP else 32 for b in range(256))
_LEET_KEPT = bytes(b if b in _KEEP or b in b"@$!|*" else 32 for b in range(256))
_UPPER, _DIGIT, _ALPHA = char_table(bytes(range(65, 91))), char_table(bytes(range(48, 58))), char_table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_SPACE = char_table(b" \t\n\x0b\x0c\r")
_PUNCT = ~(_ALPHA | _DIGIT | _SPACE)
FEATURES = ("words", "lexicon_share", "lexicon_count", "lexicon_distinct", "weight_sum", "weight_max", "weight_share", "near_second_person", "second_person_share", "capitals", "punctuation", "exclamations", "digits", "symbols", "repeats", "obfuscated", "obfuscated_lexicon", "capital_words")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="surrogatepass").lower().translate(_TO_SPACE).split()


def features(text: str | None, lexicon: dict[bytes, float]) -> list[float]:
    """The dense features of a text, in the order of FEATURES; a null text is empty, all of whose features are 0."""
    data = (text or "").encode(errors="surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    low = data.lower()
    words = low.translate(_TO_SPACE).split()
    n = max(1, len(words))
    weights = list(map(lexicon.get, words))
    hits = [(i, w) for i, w in enumerate(weights) if w is not None]
    found = [w for _, w in hits]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
    near = 0.0
    if second:
        at = np.array([i for i, _ in hits])
        k = np.searchsorted(second, at)
        s = np.array([-1000, *second, 1_000_000_000])
        near = float(np.max(np.array(found) / (1.0 + np.minimum(at - s[k], s[k + 1] - at))))
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, letters = len(data), max(1, int(histogram[_ALPHA].sum()))
    odd = low.translate(_LEET_KEPT).split() if histogram[[64, 36, 42, 33, 124]].any() or histogram[_DIGIT].any() else []
    masked = [w for w in odd if not w.isalpha() and any(97 <= c <= 122 for c in w)]
    plain = [lexicon.get(w.translate(_UNLEET, b"*")) for w in masked]
    repeats = sum(low.count(c * 3) for c in (b"a", b"e", b"i", b"o", b"u", b"s", b"n", b"l", b"r", b"t"))
    upper = int(histogram[_UPPER].sum())
    shouts = sum(1 for w in data.split() if len(w) > 2 and w.isupper()) if upper > 0.05 * letters else 0
    return [
        float(np.log1p(len(words))), len(hits) / n, float(len(hits)), float(len({words[i] for i, _ in hits})), sum(found), max(found, default=0.0), sum(found) / n, near, len(second) / n,
        upper / letters, int(histogram[_PUNCT].sum()) / size, int(histogram[33]) / size, int(histogram[_DIGIT].sum()) / size, int(histogram[[35, 36, 37, 38, 42, 64]].sum()) / size,
        repeats / size, len(masked) / n, float(sum(w is not None for w in plain)), shouts / n,
    ]


@dataclass
class Trees:
    """Boosted trees on binned features: logistic loss, second-order gains, depth-wise growth."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 32
    ridge: float = 1.0
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(v[v != 0], np.linspace(0, 1, self.bins - 1))) if (v := x[:, j]).any() else np.array([0.5]) for j in range(x.shape[1])]
        b, d = self._binned(x), x.shape[1]
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            feature, cut, node = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, np.int64), np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-6)
                local = node - first
                for j in range(d):
                    key, width = local * self.bins + b[:, j], many * self.bins
                    gs, hs = (np.cumsum(np.bincount(key, v, width).reshape(many, self.bins), axis=1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(many), k] > best
                    best[better] = gain[better, k[better]]
                    feature[first : first + many][better], cut[first : first + many][better] = j, k[better]
                node = self._down(node, b, feature, cut)
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    @staticmethod
    def _down(node: np.ndarray, b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        f = feature[node]
        right = (f >= 0) & (b[np.arange(len(node)), np.maximum(f, 0)] > cut[node])
        return 2 * node + 1 + right

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = self._down(node, b, feature, cut)
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising scores, and the non-decreasing rates fitted at them, by least squares. Equal scores are one."""
    s, at = np.unique(score, return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []
    for i in range(len(s)):
        blocks.append([weight[i], total[i], i])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, t, i_last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + t, i_last]
    rates = np.empty(len(s))
    begin = 0
    for w, t, last in blocks:
        rates[begin : int(last) + 1] = t / w
        begin = int(last) + 1
    return s, rates


@dataclass
class ToxicityModel:
    lexicon: dict[bytes, float]
    trees: Trees | None
    at: np.ndarray
    rates: np.ndarray
    prior: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.prior)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts]))
        plain = 1 / (1 + np.exp(-margin))
        # A hundredth of the trees' own probability tells apart what isotonic regression gives one rate.
        return 0.99 * np.clip(np.interp(margin, self.at, self.rates), 0, 1) + 0.01 * plain if len(self.at) else plain


def _words_in_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word with the word before it, by label, once for each batch."""
    for batch in batches:
        found = {(y, *pair) for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True) for words in [words_of(text)] for pair in zip([b"", *words], words, strict=False)}
        ys, before, words = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(before, pa.binary()), pa.array(words, pa.binary())], names=["y", "before", "word"])


def learn_lexicon(rows: DataFrame, most: int = LEXICON_WORDS, least: int = 5) -> dict[bytes, float]:
    """The words that speak for label 1 most, with smoothed log odds: the `most` strongest of those in texts (text, y) that follow enough
    different words in texts of label 1. Counting words that come before, not texts, keeps what only copies of one text share out of the lexicon."""
    total = rows.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in total}
    if not n.get(1) or not n.get(0):
        return {}
    pairs = rows.select("text", "y").mapInArrow(_words_in_context, "y int, before binary, word binary").distinct()
    words = pairs.groupBy("word").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    odds = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))
    strong = words.where(F.col("n1") >= least).withColumn("odds", odds).where("odds > 1").orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "word").limit(most)
    return {bytes(r.word): float(r.odds) for r in strong.collect()}


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on labelled rows that are not held out: at most about sample_rows of them, taken by a hash of the id.

    docs has doc_id and text, labels has doc_id and the integer toxic; rows without a label of 0 or 1 teach nothing. Where one of the
    labels is missing, every text gets the share of label 1 as its score (0 without labels). An id that labels repeats has label 1 if any row says so;
    rows of docs that repeat an id are learned from each.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = known.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20))
    picked = known.where(part < int((1 << 20) * min(1.0, sample_rows / max(1, n)))).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # about sample_rows small rows are broadcast
    lexicon = learn_lexicon(rows.where("part < 2"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("part"), pa.array(x, pa.list_(pa.float64()))], names=["y", "part", "x"])

    got = rows.where("part >= 2").select("text", "y", "part").mapInArrow(measured, "y int, part bigint, x array<double>").toPandas()
    y, part = got["y"].to_numpy(float), got["part"].to_numpy()
    prior = float(y.mean()) if len(y) else 0.0
    if len(np.unique(y[part < 4])) < 2:
        return ToxicityModel({}, None, np.empty(0), np.empty(0), prior)
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort((*x.T, y))  # the order in which rows arrive doesn't matter
    x, y, part = x[order], y[order], part[order]
    trees = Trees().fit(x[part < 4], y[part < 4])
    at, rates = isotonic(np.round(trees.margin(x[part == 4]), 6), y[part == 4]) if len(np.unique(y[part == 4])) == 2 else (np.empty(0), np.empty(0))
    return ToxicityModel(lexicon, trees, at, rates, prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text; other columns are ignored). Null texts are scored as empty ones, rows that repeat an id each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON_WORDS words and a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
