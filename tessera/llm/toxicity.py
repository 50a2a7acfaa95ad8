"""Operator 3: convolutional text classifier for toxicity.

Words are hashed into an embedding table (a second table takes their first letters, so that
inflected forms share what they have in common). Filters of width one to three run over the
words, each filter's maximum over the whole text goes into a logistic layer. Everything is trained in
NumPy from a bounded sample of labelled rows, whose whole texts executors turn into bucket numbers, and applied
to whole texts in Arrow batches. One task trains on all of the sample; others leave out a fold each, and their answers
there calibrate the scores. Scores never see the language; decision thresholds are calibrated by it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V

U64 = np.uint64
BUCKET_BITS = 16
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
STEM_BYTES = 4
#: Labelled rows of each class that the model is fitted on at most; their texts are read whole.
MAX_ROWS = 2500
FOLDS = 4
THRESHOLD = 0.3


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of its stem, and where each text's words begin."""
    w = V.words(data, offsets, V.PUNCTUATION)
    cut = np.minimum(w.end, w.start + STEM_BYTES)
    stem = np.zeros(len(w.start), U64)
    for i in range(STEM_BYTES):
        at = np.minimum(w.start + i, cut - 1)
        stem = stem * U64(257) + np.where(w.start + i < cut, V._LOWER[data[at]] if len(data) else 0, 0).astype(U64)
    shift = U64(64 - BUCKET_BITS)
    return (w.hash >> shift).astype(np.int32), (V.mix(stem + U64(1)) >> shift).astype(np.int32), w.first


@dataclass
class Network:
    """Two embedding tables, filters and a logistic output; ``scale`` and ``shift`` calibrate it."""

    words: np.ndarray
    stems: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        table = lambda: r.normal(0, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32)
        filters = [r.normal(0, (2 / (k * DIM)) ** 0.5, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        return cls(table(), table(), filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    def maps(self, w: np.ndarray, s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of all words and the filters' answers at each; beyond a text's end words are zero."""
        x = self.words[w] + self.stems[s]
        n = len(x)
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words from here to the text's end
        out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for i, k in enumerate(WIDTHS):
            block = x @ self.filters[i][0] + self.biases[i]
            for j in range(1, min(k, n)):
                block[:-j] += (x[j:] @ self.filters[i][j]) * (left[:-j] > j)[:, None]
            out[:, i * FILTERS : (i + 1) * FILTERS] = block
        return x, out

    def raw(self, w: np.ndarray, s: np.ndarray, first: np.ndarray) -> np.ndarray:
        pooled = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            pooled[full] = np.maximum(np.maximum.reduceat(self.maps(w, s, first)[1], first[full], axis=0), 0)
        return pooled @ self.out + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.raw(*tokens(data, offsets)).astype(np.float64) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 3, epochs: int = 20, batch: int = 32, rate: float = 0.15) -> Network:
    """Fit to texts' word and stem buckets by AdaGrad; only the words at the filters' maxima get gradients."""
    net, r = Network.new(seed), np.random.default_rng(seed)
    used = [i for i in range(len(docs)) if len(docs[i][0])]
    dense = [*net.filters, *net.biases, net.out]
    memory = [np.full_like(p, 1e-6) for p in dense]
    rows_memory = [np.full(1 << BUCKET_BITS, 1e-6, np.float32) for _ in range(2)]
    bias_memory = 1e-6
    balance = np.where(labels == 1, len(labels) / max(1, 2 * labels.sum()), len(labels) / max(1, 2 * (labels == 0).sum()))
    for _ in range(epochs):
        order = r.permutation(used)
        for b in range(0, len(order), batch):
            pick = order[b : b + batch]
            first = np.r_[0, np.cumsum([len(docs[i][0]) for i in pick])]
            w, s = (np.concatenate([docs[i][k] for i in pick]) for k in (0, 1))
            x, maps = net.maps(w, s, first)
            at = np.stack([maps[a:c].argmax(0) + a for a, c in zip(first[:-1].tolist(), first[1:].tolist())])
            top = maps[at, np.arange(maps.shape[1])]
            pooled = np.maximum(top, 0)
            delta = (_sigmoid(pooled @ net.out + net.bias) - labels[pick]) * balance[pick] / len(pick)
            grads = [np.zeros_like(p) for p in dense]
            grads[-1] += pooled.T @ delta.astype(np.float32)
            back = (delta[:, None] * net.out * (top > 0)).astype(np.float32)
            ends = first[1:]
            where, change = [], []
            for i, k in enumerate(WIDTHS):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                grads[len(WIDTHS) + i] += back[:, cols].sum(0)
                for j in range(k):
                    pos = at[:, cols] + j
                    g = back[:, cols] * (pos < ends[:, None])
                    pos = np.minimum(pos, len(w) - 1)
                    grads[i][j] += np.einsum("bfd,bf->df", x[pos], g)
                    where.append(pos.reshape(-1))
                    change.append((g[:, :, None] * net.filters[i][j].T[None]).reshape(-1, DIM))
            where, change = np.concatenate(where), np.concatenate(change)
            for table, ids, mem in ((net.words, w, rows_memory[0]), (net.stems, s, rows_memory[1])):
                by = np.argsort(ids[where], kind="stable")
                sorted_ids = ids[where][by]
                begins = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
                rows, total = sorted_ids[begins], np.add.reduceat(change[by], begins, axis=0)
                mem[rows] += (total**2).mean(1)
                table[rows] -= rate * total / np.sqrt(mem[rows])[:, None]
            for p, g, m in zip(dense, grads, memory):
                m += g * g
                p -= 0.5 * rate * g / np.sqrt(m)
            g = float(delta.sum())
            bias_memory += g * g
            net.bias -= 0.5 * rate * g / bias_memory**0.5
    return net


def calibrate(net: Network, raw: np.ndarray, labels: np.ndarray, weight: np.ndarray, langs: list, least: int = 20) -> None:
    """Fit the score's scale and shift to answers to rows that were left out, and a threshold for each language.

    A language with fewer than ``least`` rows of either class keeps the common threshold."""
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps of a ridge-regularised logistic fit
        p = _sigmoid(a * raw + b)
        g = np.array([(weight * (p - labels) * raw).sum() + 0.01 * (a - 1), (weight * (p - labels)).sum() + 0.01 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * raw * raw).sum() + 0.01, (v * raw).sum()], [(v * raw).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    net.scale, net.shift = (a, b) if a > 0 else (1.0, 0.0)
    score = _sigmoid(net.scale * raw + net.shift)
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if min((labels[own] == 1).sum(), (labels[own] == 0).sum()) >= least:
            cuts = np.unique(np.r_[THRESHOLD, score[own]])
            f1 = [2 * (hit := (weight * own * (score >= c) * labels).sum()) / max(1e-9, (weight * own * (score >= c)).sum() + (weight * own * labels).sum()) for c in cuts]
            best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
            net.thresholds[lang] = float(cuts[best[np.argmin(np.abs(cuts[best] - THRESHOLD))]])


def held_out(key) -> F.Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame, sample: DataFrame, key: str, text: str, lang: str, seed: int, limit: int) -> list:
    """Rows ``y``, ``lang``, ``w``, ``s`` (buckets as bytes) of labelled documents, in a seeded order."""
    lkind = docs.schema[lang].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in V.chunks(batch.column(3)):
                w, stems, first = tokens(data, offsets)
                cut = lambda x: pa.array([x[i:j].astype(np.uint16).tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), cut(w), cut(stems)], ["h", "y", "lang", "w", "s"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(sample), "id")
    rows = rows.select(F.xxhash64("id", F.lit(seed)).alias("h"), "y", "lang", "text").mapInArrow(run, f"h long, y int, lang {lkind}, w binary, s binary")
    return rows.orderBy("h", "w", "s", "y", "lang").limit(limit).drop("h").collect()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", max_rows: int = MAX_ROWS, seed: int = 3) -> Network | float:
    """A network from at most ``max_rows`` labelled rows of each class, calibrated on answers to left-out folds; where
    a class is missing, the labels' share of ones instead.

    The sample is chosen by a hash of the key, its texts are read whole. A key labelled more than once counts as 1 if any
    of its labels is; null labels and keys are left out; of rows that repeat keys at most ``4 * max_rows`` are learnt from.
    Other columns, whatever their names, aren't read."""
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    share = known.agg(F.avg("y"), F.count("*")).first()
    ranked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_rows) for y in (0, 1)]
    rows = _labelled(docs, ranked[0].unionByName(ranked[1]), key, text, lang, seed + 1, 4 * max_rows)  # narrow rows, 2 * max_rows keys at most
    y = np.array([r["y"] for r in rows])
    if not len(y) or y.min() == y.max():
        return float(share[0] or 0.0)
    fold = np.zeros(len(y), int)  # by turns within each class
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    data = spark.sparkContext.broadcast((y, fold, [(r["w"], r["s"]) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, fold, texts = data.value
        texts = [tuple(np.frombuffer(x, np.uint16).astype(np.int32) for x in t) for t in texts]
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            learn = fold != k  # the last task leaves nothing out
            if k < FOLDS and y[learn].min() == y[learn].max():
                learn = np.ones(len(y), bool)
            net = train([t for t, x in zip(texts, learn) if x], y[learn], seed + k)
            raw = np.array([net.raw(*t, np.array([0, len(t[0])]))[0] for t, f in zip(texts, fold) if f == k])
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(raw if k < FOLDS else net)], pa.binary())], ["k", "found"])

    tasks = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(run, "k long, found binary").collect()
    found = {r["k"]: pickle.loads(r["found"]) for r in tasks}
    raw = np.empty(len(y))
    for k in range(FOLDS):
        raw[fold == k] = found[k]
    net = found[FOLDS]
    weight = np.where(y == 1, share[0] / y.mean(), (1 - share[0]) / (1 - y.mean()))
    calibrate(net, raw, y, weight, [r["lang"] for r in rows])
    return net


def score(docs: DataFrame, model: Network | float, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Key, ``held_out``, ``score``, ``predicted`` (score of ``THRESHOLD`` or more), ``threshold`` of the row's
    language and ``flagged`` by it, for every row of ``docs``.

    Whole texts are read, null as empty; a text without words gets the score that no filter's answer
    gives. Repeated rows and null keys give a row each, an empty table none; a null or unknown language has the common threshold.
    Other columns, whatever their names, are neither read nor returned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            parts = [net.scores(d, o) if isinstance(net, Network) else np.full(b - a, net) for a, b, d, o in V.chunks(batch.column(2), 1 << 18)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(parts) if parts else np.empty(0))], ["id", "lang", "score"])

    kind, lkind = docs.schema[key].dataType.simpleString(), docs.schema[lang].dataType.simpleString()
    out = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, lang {lkind}, score double")
    limit = F.lit(THRESHOLD)
    for name, cut in sorted(getattr(model, "thresholds", {}).items()):
        limit = F.when(F.col("lang") == name, F.lit(cut)).otherwise(limit)
    out = out.withColumns({"predicted": (F.col("score") >= THRESHOLD).cast("int"), "threshold": limit})
    out = out.withColumnRenamed("id", key) if key != "id" else out
    return out.select(key, held_out(key).alias("held_out"), "score", "predicted", "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
