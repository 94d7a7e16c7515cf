"""Scans for secrets: base patterns, and a character convolutional network over every further candidate with its context.

The base patterns find what they define. The network judges every run of key-like characters that no base finding covers, by overlapping windows over its
whole length, of which the largest score counts. It is trained on labelled findings (the base findings of all documents, against all
candidates that no base finding touches), its scores are calibrated, and its threshold is the highest that keeps a stated recall on findings that were held back,
or, where the scores of all candidates that were held back are lower, a quarter of the way from them to that. It only adds spans.

Training reads every finding: they are dealt into shards, each task goes on from the same weights over a slice of its shard, and the mean of what the
tasks arrive at is where the next slices begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, write_and_reread

#: The base patterns, least lengths (of group 2 for assign), in their order within equal starts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "network")
LEAST = {"assign": 12, "access": 18, "hex": 16}
WORDS = ("passwd", "password", "secret", "token", "apikey", "api_key")
#: A candidate for the network: a run of key-like characters of at least so many.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Characters before, of, and after a window of a candidate that the network sees, and those from one window to the next.
BEFORE, WITHIN, AFTER, STEP = 24, 64, 8, 32
SEEN = BEFORE + WITHIN + AFTER
#: Characters of text whose candidates are judged together.
GROUP_CHARS = 1 << 22
#: Rows of a shard, the most shards, and rows (about) that a task goes over between two means; a table of one shard is gone over several times, PASSES at most.
SHARD_ROWS, SHARDS, SLICE_ROWS, PASSES = 48_000, 256, 6_000, 12
#: Scores of held-back findings are counted in bins of 1 / BINS, up to MOST_SCORE either way.
BINS, MOST_SCORE = 256, 64
RECALL = 0.98
N_CLASSES = 75
_CLASSES = np.full(129, N_CLASSES - 1, np.uint8)  # the last one stands for all beyond ASCII
for _i in range(128):
    _c = chr(_i)
    _CLASSES[_i] = 1 + (ord(_c) - 97 if "a" <= _c <= "z" else 26 + ord(_c) - 65 if "A" <= _c <= "Z" else 52 + int(_c) if "0" <= _c <= "9" else 62 + "+/_.=-:'\" \n".find(_c) if _c in "+/_.=-:'\" \n" else 73)


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Base findings as (start, number of the kind, end). runs are the text's runs of 12 or more key-like characters, within which access and hex findings lie."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for a, b in runs:
        for kind, pattern, name in ((1, ACCESS, "access"), (2, HEX, "hex")):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text, a, b) if m.end() - m.start() >= LEAST[name]]
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Base findings of a text, the candidates that reach beyond the findings that they touch, and those that touch none."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    base = base_spans(text, runs)
    if not base:
        return base, [], runs
    touched = [(a, b, [(s, e) for s, _, e in base if s < b and a < e]) for a, b in runs]
    wider = [(a, b) for a, b, by in touched if by and not any(s <= a and b <= e for s, e in by)]
    return base, wider, [(a, b) for a, b, by in touched if not by]


def classes(text: str) -> np.ndarray:
    """A class for each character."""
    return _CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def cuts(a: int, b: int) -> list[tuple[int, int]]:
    """The windows over a candidate: WITHIN characters every STEP, the last one ending with it."""
    if b - a <= WITHIN:
        return [(a, b)]
    return [(s, s + WITHIN) for s in range(a, b - WITHIN, STEP)] + [(b - WITHIN, b)]


def windows(texts: list[str], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Character classes of spans (number of the text, start, end) in their contexts, at fixed places; 0 where there is nothing."""
    gap = np.zeros(SEEN, np.uint8)
    parts, begins, size = [gap], [], len(gap)
    for t in texts:
        begins.append(size)
        parts += [classes(t), gap]
        size += len(parts[-2]) + len(gap)
    flat = np.concatenate(parts)
    where = np.array(spans, np.int64).reshape(-1, 3)
    first = np.array(begins, np.int64)[where[:, 0]]
    a, b = (first + where[:, 1])[:, None], (first + where[:, 2])[:, None]
    inside = a + np.arange(WITHIN)
    return np.concatenate([flat[a - BEFORE + np.arange(BEFORE)], np.where(inside < b, flat[np.minimum(inside, size - 1)], 0), flat[b + np.arange(AFTER)]], axis=1)


#: What is added to the classes of a window's context, so that the network tells a candidate from what stands beside it.
_BESIDE = np.r_[np.full(BEFORE, N_CLASSES), np.zeros(WITHIN, int), np.full(AFTER, N_CLASSES)].astype(np.uint8)


def placed(x: np.ndarray) -> np.ndarray:
    """The classes of windows, those of the context being others than those of the candidate; 0 stays."""
    return x + _BESIDE * (x > 0)


def window(text: str, a: int, b: int) -> np.ndarray:
    """The first window of one span."""
    return windows([text], [(0, a, min(b, a + WITHIN))])[0]


@dataclass
class CharCnn:
    """Embedding (of its own for the context), one convolution over characters, the largest activation of each filter, one linear layer."""

    filters: int = 24
    width: int = 5
    size: int = 8
    threshold: float = 2.0
    slope: float = 1.0
    shift: float = 0.0

    def start(self, seed: int = 3) -> CharCnn:
        g = np.random.Generator(np.random.PCG64(seed))
        self.w = {"embed": g.normal(0, 0.5, (2 * N_CLASSES, self.size)), "conv": g.normal(0, 0.3, (self.width * self.size, self.filters)), "bias": np.zeros(self.filters), "out": g.normal(0, 0.2, self.filters), "last": np.zeros(1)}
        self.w["embed"][0] = 0
        return self

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        e = self.w["embed"][placed(x)]
        views = np.lib.stride_tricks.sliding_window_view(e, self.width, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, self.width * self.size)
        z = views @ self.w["conv"] + self.w["bias"]
        top = z.argmax(axis=1)
        best = np.take_along_axis(z, top[:, None, :], 1)[:, 0, :]
        act = np.maximum(best, 0)
        return views, top, best, act, act @ self.w["out"] + self.w["last"][0]

    def logits(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        """As _forward, the embedding and the convolution being one table for each place of a filter."""
        taps = [(self.w["embed"] @ self.w["conv"][k * self.size : (k + 1) * self.size]).astype(np.float32) for k in range(self.width)]
        out, m = [np.empty(0)], x.shape[1] - self.width + 1
        for i in range(0, len(x), batch):
            own = placed(x[i : i + batch])
            z = taps[0][own[:, :m]]
            for k in range(1, self.width):
                z += taps[k][own[:, k : k + m]]
            out.append(np.maximum(z.max(axis=1) + self.w["bias"], 0) @ self.w["out"] + self.w["last"][0])
        return np.concatenate(out)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.01, batch: int = 64, seed: int = 5, share: float | None = None) -> CharCnn:
        """Adam on the logistic loss, both labels weighing alike; share is that of label 1 in all rows, where these are a part of them. Of half of the rows, drawn anew each time, the context is hidden, so that candidates count by themselves too."""
        g = np.random.Generator(np.random.PCG64(seed))
        share = y.mean() if share is None else share
        weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(u) for k, u in self.w.items()}
        t = 0
        for _ in range(epochs):
            order = g.permutation(len(y))
            for i in range(0, len(y), batch):
                at = order[i : i + batch]
                own = x[at]
                hidden = g.random(len(at)) < 0.5
                own[hidden, :BEFORE] = 0
                own[hidden, BEFORE + WITHIN :] = 0
                views, top, best, act, logit = self._forward(own)
                own = placed(own)
                d = weight[at] * (1 / (1 + np.exp(-logit)) - y[at]) / len(at)
                d_best = d[:, None] * self.w["out"] * (best > 0)
                rows = np.arange(len(at))[:, None]
                picked = views[rows, top]  # batch, filters, width * size
                grad = {"out": act.T @ d, "last": np.array([d.sum()]), "bias": d_best.sum(0), "conv": np.einsum("bfk,bf->kf", picked, d_best)}
                d_view = (d_best[:, :, None] * self.w["conv"].T[None]).reshape(len(at), self.filters, self.width, self.size)
                d_embed = np.zeros_like(self.w["embed"])
                for k in range(self.width):
                    np.add.at(d_embed, own[rows, top + k], d_view[:, :, k])
                d_embed[0] = 0
                grad["embed"] = d_embed
                t += 1
                for k, u in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * u
                    v[k] = 0.999 * v[k] + 0.001 * u * u
                    self.w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> CharCnn:
        """Platt scaling on findings that were held back, and the highest threshold that keeps the recall on them; where
        all others' scores are below it, it lies a quarter of the way from the highest of these to it."""
        return self.calibrate_counts(self.logits(x), y, np.ones(len(y)), recall)

    def calibrate_counts(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float = RECALL) -> CharCnn:
        """As calibrate, from how many findings have each score and label."""
        a, b, share = 1.0, 0.0, n / max(n.sum(), 1)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + b)))
            h = np.maximum(p * (1 - p), 1e-6) * share
            g1, g0 = ((p - y) * z * share).sum() + 0.01 * (a - 1), ((p - y) * share).sum() + 0.01 * b
            a, b = a - 0.5 * g1 / ((h * z * z).sum() + 0.05), b - 0.5 * g0 / (h.sum() + 0.05)
        self.slope, self.shift = max(a, 1e-3), b
        good = np.argsort(z[y == 1], kind="stable")
        upto = np.cumsum(n[y == 1][good])
        if len(upto):
            at = np.searchsorted(upto, int((1 - recall) * upto[-1] + 1e-9), side="right")
            least, other = z[y == 1][good[at]], z[y == 0].max(initial=-np.inf)
            cut = other + (least - other) / 4 if -np.inf < other < least else least  # nearer to them: kinds not seen in training score lower
            self.threshold = float(1 / (1 + np.exp(-(self.slope * cut + self.shift))))
        else:
            self.threshold = 2.0
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(x) + self.shift)))


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of base findings (label 1) and of candidates that none touches (label 0), with the finding's kind."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        spans, y, kinds = [], [], []
        for i, text in enumerate(texts):
            base, _, rest = scan(text)
            for a, kind, b in base:
                if kind == 0:
                    a = ASSIGN.match(text, a).start(2)
                own = cuts(a, b)
                spans += [(i, s, e) for s, e in own]
                y += [1] * len(own)
                kinds += [KINDS[kind]] * len(own)
            own = [(i, s, e) for a, b in rest for s, e in cuts(a, b)]
            spans += own
            y += [0] * len(own)
            kinds += ["none"] * len(own)
        x = windows(texts, spans)
        yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary()), pa.array(y, pa.int32()), pa.array(kinds, pa.string())], names=["x", "y", "kind"])


def labelled_findings(docs: DataFrame) -> DataFrame:
    """The distinct findings (x, y, kind) of all documents: base findings, and all candidates that none touches. Written, since training reads them in slices."""
    return write_and_reread(docs.select("text").mapInArrow(_findings, "x binary, y int, kind string").distinct(), "findings")


def _rows(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The windows of findings and their labels."""
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, SEEN)
    return x, np.array(batch.column("y").to_pylist(), float)


def _hash(seed: int, n: int):
    """A number below n for each finding, by its window."""
    return F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(n)).cast("int")


def _fit_slice(model: CharCnn, epochs: int, rate: float, share: float):
    """What a task does with its slice of a shard: the weights that it arrives at from the model's, and the number of its rows."""

    def run(table: pa.Table) -> pa.Table:
        x, y = _rows(table.sort_by([("x", "ascending"), ("y", "ascending"), ("kind", "ascending")]))
        own = CharCnn()
        own.w = {k: v.copy() for k, v in model.w.items()}
        own.fit(x, y, epochs, rate, share=share)
        flat = np.concatenate([v.ravel() for v in own.w.values()])
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(y)], pa.int64()), "w": pa.array([flat.tolist()], pa.list_(pa.float64()))})

    return run


def _scores(model: CharCnn):
    """How many findings of each label have each score (the bin's lower edge, in bins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _rows(batch)
            most = BINS * MOST_SCORE
            at, n = np.unique(np.clip(np.floor(model.logits(x) * BINS), -most, most).astype(np.int64) * 2 + y.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 1, pa.int64()), pa.array(at & 1, pa.int64()), pa.array(n, pa.int64())], names=["bin", "y", "n"])

    return run


def _found(model: CharCnn):
    """How many findings of each label there are, and how many the model finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _rows(batch)
            hit = model.probability(x) >= model.threshold
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.array([int((y == k).sum()) for k in (0, 1)], pa.int64()), pa.array([int((hit & (y == k)).sum()) for k in (0, 1)], pa.int64())], names=["y", "n", "hit"])

    return run


def train(findings: DataFrame) -> CharCnn:
    """A network fitted on all findings (x, y, kind), every fifth by its hash being held back for calibration. Without both labels, a network that finds nothing.

    The driver gets one set of weights (18 KB) from each shard of a slice, SHARDS at most, and counts of scores.
    """
    model = CharCnn().start()
    told = findings.where(_hash(1, 5) != 0).agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good")).first()
    if not 0 < told.good < told.n:
        return model
    shards = min(SHARDS, -(-told.n // SHARD_ROWS))
    slices = 1 if shards == 1 else -(-told.n // (shards * SLICE_ROWS))
    passes = min(PASSES, -(-SHARD_ROWS // told.n))  # 1 for several shards
    dealt = findings.withColumn("shard", _hash(2, shards)).withColumn("slice", F.when(_hash(1, 5) == 0, -1).otherwise(_hash(3, slices)))
    path = scratch_path(findings.sparkSession, "slices")
    spread = 1 + told.n // (slices * SHARD_ROWS)  # a slice, and what is held back, over several tasks and files
    dealt.repartition((slices + 1) * spread, "slice", _hash(5, spread * (1 + slices // 4))).write.partitionBy("slice").parquet(path)
    dealt = findings.sparkSession.read.schema(dealt.schema).parquet(path)
    for i in range(slices):
        run = _fit_slice(model, passes, 0.01 * (1 - 0.9 * i / slices), told.good / told.n)
        got = sorted(dealt.where(F.col("slice") == i).groupBy("shard").applyInArrow(run, "shard int, n long, w array<double>").collect())
        if got:
            mean = np.average(np.array([r.w for r in got]), axis=0, weights=[r.n for r in got])
            ends = np.cumsum([v.size for v in model.w.values()])[:-1]
            model.w = {k: part.reshape(v.shape) for (k, v), part in zip(model.w.items(), np.split(mean, ends), strict=True)}
    counts = dealt.where("slice = -1").mapInArrow(_scores(model), "bin long, y long, n long").groupBy("bin", "y").agg(F.sum("n").alias("n"))
    z, y, n = np.array(sorted(map(tuple, counts.collect())), float).reshape(-1, 3).T
    return model.calibrate_counts(z / BINS, y, n)


def unseen_kinds(findings: DataFrame) -> list[tuple[str, int, float, float]]:
    """What the network adds to the patterns: for each kind, fitted without it and without half of the candidates of no kind, how many findings of
    that kind there are, the share of them that it finds (recall), and the share of such findings in all that it finds (precision)."""
    out = []
    for kind in KINDS[:3]:
        unseen = (F.col("kind") == kind) | (F.col("kind") == "none") & (_hash(4, 2) == 0)
        counts = findings.where(unseen).mapInArrow(_found(train(findings.where(~unseen))), "y long, n long, hit long")
        told = {r.y: (r.n, r.hit) for r in counts.groupBy("y").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).collect()}
        (n, hit), false = told.get(1, (0, 0)), told.get(0, (0, 0))[1]
        out.append((kind, n, hit / max(1, n), hit / max(1, hit + false)))
    return out


def _secrets(network: CharCnn, texts: list[str], held: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The candidates (text, start, end) one of whose windows the network takes for a secret."""
    own = [cuts(a, b) for _, a, b in held]
    spans = [(h[0], s, e) for h, c in zip(held, own, strict=True) for s, e in c]
    if not spans or network.threshold > 1:
        return []
    p = np.maximum.reduceat(network.probability(windows(texts, spans)), np.cumsum([0, *map(len, own[:-1])]))
    return [held[i] for i in np.flatnonzero(p >= network.threshold).tolist()]


def scan_secrets(docs: DataFrame, model: CharCnn) -> DataFrame:
    """All findings of each row of docs: doc_id, and spans, an array of (kind, start, end) in code points by start, then kind.

    docs has doc_id and text; other columns are ignored. Null and empty texts have none. Rows that repeat an id are scanned each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    kind_of = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found: list[list[tuple[int, int, int]]] = []
            held: list[tuple[int, int, int]] = []  # candidates: text, start, end
            begin = size = 0
            for i, text in enumerate(texts):
                base, wider, rest = scan(text)
                found.append(base)
                held += [(i, a, b) for a, b in wider + rest]
                size += len(text)
                if size >= GROUP_CHARS or i == len(texts) - 1:
                    for j, a, b in _secrets(network, texts[begin : i + 1], [(j - begin, a, b) for j, a, b in held]):
                        found[begin + j].append((a, 3, b))
                    begin, size, held = i + 1, 0, []
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, span)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs, train(labelled_findings(docs)))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "network")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
