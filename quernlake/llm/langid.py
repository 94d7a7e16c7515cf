"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams of 1 to 3 characters over all training texts, by falling count. A
document's own list is held against each profile: the distance is the sum over the document's n-grams of how far each is
out of place, an n-gram that a profile lacks counting as far as can be. The nearest profile names the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import held_out

UNDETERMINED = "und"
#: N-grams in a profile, of a language or a document.
PROFILE = 400
#: Characters and texts whose n-grams are held in arrays at once; longer texts are taken whole, alone.
CHUNK_CHARS, CHUNK_TEXTS = 1 << 19, 1 << 12
_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    """Which code points are letters, as str.isalpha says."""
    if not _LETTER[65]:
        _LETTER[:] = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    return _LETTER


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of at most CHUNK_TEXTS texts that together have about CHUNK_CHARS characters; a longer text is one of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and (size + len(t or "") > CHUNK_CHARS or i - a >= CHUNK_TEXTS):
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if texts:
        yield a, len(texts)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted keys, and how often each occurs."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


class Ngrams:
    """N-grams of 1 to 3 characters of all texts, as keys: the text's number above, the n-gram's `width` bits below.

    Letters are lower-cased; any run of other characters is one space, which counts at word edges, never as a 1-gram.
    Within a key, letters are numbers in `alphabet`, those of these texts, in order of code point.
    """

    def __init__(self, texts: list[str | None], owners: bool = True) -> None:
        points = np.frombuffer(" ".join((t or "").lower().replace("\0", " ") + " \0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        self.alphabet = np.r_[32, np.flatnonzero(seen & _letters())].astype(np.uint64)
        codes = np.zeros(0x110000, np.uint32)
        codes[self.alphabet[1:]] = np.arange(1, len(self.alphabet))
        self.bits = np.uint64(max(1, int(len(self.alphabet)).bit_length()))
        self.width = np.uint64(3) * self.bits
        c, ends = codes[points], points == 0
        keep = (c > 0) | ends
        keep[1:] |= c[:-1] > 0
        keep[:1] = True
        owner = (np.cumsum(ends)[keep] - ends[keep]).astype(np.uint64) if owners else None
        edge, c = ends[keep], c[keep].astype(np.uint64)
        found = []
        for n in (1, 2, 3):
            m = len(c) - n + 1
            if m <= 0:
                continue
            gram = c[:m].copy()
            for i in range(1, n):
                gram = (gram << self.bits) | c[i : m + i]
            whole = c[n // 2 : n // 2 + m] > 0  # a letter in the middle (of two: the second, or else the first)
            if n == 2:
                whole |= c[:m] > 0
            for i in range(n - 1):
                whole &= ~edge[i : m + i]
            if owners:
                gram |= owner[:m] << self.width
            found.append(gram[whole])
        self.keys = np.sort(np.concatenate(found)) if found else np.empty(0, np.uint64)

    def decoded(self, keys: np.ndarray) -> np.ndarray:
        """N-grams by code points, 21 bits each, without the text's number."""
        out, mask = np.zeros(len(keys), np.uint64), (np.uint64(1) << self.bits) - np.uint64(1)
        grams = keys & ((np.uint64(1) << self.width) - np.uint64(1))
        for i in (2, 1, 0):
            code = (grams >> (np.uint64(i) * self.bits)) & mask
            point = self.alphabet[code.astype(np.int64)]
            # a leading zero is no space but a shorter n-gram, except for an n-gram's own first place; both read as 32, alike in profiles and documents
            out = (out << np.uint64(21)) | point
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, summed over what the task has read."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        unique, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return unique, np.bincount(at, np.concatenate([n for _, n in parts]), len(unique)).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            gram, count = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(count)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for a, b in chunks(own):
                grams = Ngrams(own[a:b], owners=False)
                keys, counts = runs(grams.keys)
                held.setdefault(lang, []).append((grams.decoded(keys), counts))
                size += len(keys)
                if size > 1_000_000:
                    held = {k: [merged(v)] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > 500_000:
                        yield from flush()
                        size = 0
    yield from flush()


def learn_profiles(train: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles by language from all rows of (text, lang); rows with a null text or lang teach nothing. Ties go to the smaller n-gram.

    The result has `size` numbers for each language: no more than that reaches the driver.
    """
    counts = train.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The largest of each of many parts, then the largest of all, so that no task gets a language's whole list.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(F.desc("n"), "gram")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= size).withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= size)
    out: dict[str, dict[int, int]] = {}
    for row in top.select("lang", "gram", "rank").collect():
        out.setdefault(row.lang, {})[row["rank"]] = row.gram
    return {lang: np.array([out[lang][k] for k in sorted(out[lang])], np.uint64) for lang in sorted(out)}


class RankOrder:
    """Places of each known n-gram in each profile."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE) -> None:
        self.langs, self.size = list(profiles), size
        self.grams = np.unique(np.concatenate([np.empty(0, np.uint64), *profiles.values()]))
        self.ranks = np.full((len(self.grams) + 1, len(profiles)), -1, np.int32)
        for k, profile in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.grams, profile), k] = np.arange(len(profile))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. The score is 1 - nearest / next distance, between 0 (a tie) and 1, halved and raised by a half."""
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.langs or not texts:
            return langs, scores
        grams = Ngrams(texts)
        keys, count = runs(grams.keys)
        # By text, then falling count, then n-gram: the three in one number if they fit, its place among the keys standing for the n-gram.
        owner = keys >> grams.width
        if len(keys) < 1 << 28 and count.max(initial=0) < 1 << 22:
            fall = np.uint64((1 << 22) - 1) - count.astype(np.uint64)
            ranked = (np.sort((owner << np.uint64(50)) | (fall << np.uint64(28)) | np.arange(len(keys), dtype=np.uint64)) & np.uint64((1 << 28) - 1)).astype(np.int64)
        else:
            ranked = np.lexsort((-count, owner))
        owner = owner[ranked].astype(np.int64)
        rank = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(texts)))[owner]
        near = rank < self.size
        owner, rank, gram = owner[near], rank[near], grams.decoded(keys[ranked[near]])
        at = np.searchsorted(self.grams, gram)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != gram)] = len(self.grams)
        place = self.ranks[at]
        away = np.where(place < 0, self.size, np.abs(place - rank[:, None]))
        total = np.stack([np.bincount(owner, away[:, k], len(texts)) for k in range(len(self.langs))], axis=1)
        some = np.bincount(owner, minlength=len(texts)) > 0
        best = total.argmin(axis=1)
        nearest = total[np.arange(len(texts)), best]
        if len(self.langs) > 1:
            second = np.partition(total, 1, axis=1)[:, 1]
            scores = np.where(second > 0, 1 - 0.5 * nearest / np.maximum(second, 1e-9), 0.5)
        else:
            scores = 1 - nearest / np.maximum(1, self.size * np.bincount(owner, minlength=len(texts)))
        return [self.langs[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)], np.where(some, scores, 0.0)


def identify(docs: DataFrame, model: RankOrder, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the predicted language and its score to docs, whose other columns stay.

    Each row is judged by its own text, also rows that repeat an id. Of languages at equal distance the first by name is taken. A text that is null or has no letter is `und` with score 0. The score is at least 0.5 otherwise (one language alone: it falls with distance).
    An empty table gives an empty result. lang_col and score_col replace columns of these names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages * PROFILE numbers
    kept = docs.drop(lang_col, score_col)
    schema = StructType([*kept.schema.fields]).add(lang_col, "string").add(score_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            langs: list[str] = []
            scores = [np.empty(0)]
            for a, b in chunks(texts):
                found, score = shared.value.predict(texts[a:b])
                langs += found
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=[*batch.schema.names, lang_col, score_col])

    return kept.mapInArrow(run, schema)


def train_on(docs: DataFrame) -> RankOrder:
    """Profiles from the documents that are not held out."""
    return RankOrder(learn_profiles(docs.where(~held_out(F.col("doc_id")))))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_on(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
