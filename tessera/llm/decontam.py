"""Operator 9: benchmark decontamination by spaced-seed hashing.

Fixed masks choose some of the words of a window and ignore the others, so a substituted word
at an ignored position leaves the hash as it is. Hashes of the benchmark and of all documents are
joined (through a broadcast index of the benchmark while that is small); around each hit the two texts are laid side by side and the best of their stretches of
``min_words`` words or more is measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .store import Workspace, free

U64 = np.uint64
#: Six chosen words each; the first is contiguous and finds every run of six equal words. Together they hit
#: every stretch of 13 words or more of which 80 % are equal (longer ones than 25 words hold a shorter such one).
MASKS = ("111111", "11011011", "101101011", "1100101011", "1010110011", "10010101101", "1111011")
MIN_WORDS = 13
MIN_IDENTITY = 0.8
#: Bytes of benchmark text up to which its index (about 20 times as large) is broadcast; a larger benchmark's seeds are joined.
INDEX_BYTES = 4 << 20
_FILTER_BITS = 22
_up = np.array([pow(0xD1342543DE82EF95, i, 1 << 64) for i in range(64)], U64)


def hits_name(columns: list[str]) -> str:
    """The name of ``mark``'s array beside such columns."""
    return free("_d_hits", columns)


def _positions(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(w: V.Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word number of every placement of ``mask`` within a text."""
    n = len(w.hash) - len(mask) + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    at = np.flatnonzero(w.doc[:n] == w.doc[len(mask) - 1 :])
    h = np.zeros(len(at), U64)
    for i in _positions(mask):
        h += w.hash[at + i] * _up[i]
    return V.mix(h + U64(int(mask, 2))), at


@dataclass
class Index:
    """Seeds of a block of the benchmark."""

    ids: list
    words: V.Words
    masks: list[str]
    keys: list[np.ndarray]
    places: list[np.ndarray]
    known: np.ndarray

    @classmethod
    def build(cls, ids: list, texts: list[str], min_identity: float = MIN_IDENTITY) -> Index:
        data, offsets = V.texts(pa.array(texts, pa.large_string()))
        w = V.words(data, offsets, V.PUNCTUATION)
        # a shorter item than the masks are made for is cut in one piece more than it may have unequal words
        pieces: dict[int, list[int]] = {}
        for i in np.flatnonzero((w.counts > 0) & (w.counts < MIN_WORDS)):
            n = int(w.counts[i])
            parts = int((1 - min_identity) * n + 1e-9) + 1
            cuts = [n * k // parts for k in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    pieces.setdefault(b - a, []).append(int(w.first[i]) + a)
        masks = [*MASKS, *("1" * n for n in sorted(pieces))]
        keys, places = [], []
        known = np.zeros(1 << _FILTER_BITS, bool)
        for k, m in enumerate(masks):
            h, at = seeds(w, m)
            if k >= len(MASKS):
                piece = np.isin(at, pieces[len(m)])
                h, at = h[piece], at[piece]
            order = np.argsort(h, kind="stable")
            keys.append(h[order])
            places.append(at[order])
            known[(h >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls(ids, V.Words(w.data, w.offsets, w.start, w.end, w.doc, w.hash, w.first), masks, keys, places, known)

    def hits(self, w: V.Words) -> np.ndarray:
        """Distinct rows of text, item and the item's shift in the text's words."""
        out = []
        for m, keys, places in zip(self.masks, self.keys, self.places):
            h, at = seeds(w, m)
            maybe = self.known[(h >> U64(64 - _FILTER_BITS)).astype(np.int64)]
            h, at = h[maybe], at[maybe]
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = hi - lo
            if n.sum():
                at, place = np.repeat(at, n), places[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                out.append(np.stack([w.doc[at], self.words.doc[place], at - w.first[w.doc[at]] - (place - self.words.first[self.words.doc[place]])], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 3), np.int64)


def best_stretch(same: np.ndarray, min_identity: float, least: int) -> tuple[int, int, int] | None:
    """Start, end and equal words of the stretch of ``least`` words or more that has the most equal words
    beyond the share ``min_identity``; None if no such stretch reaches that share."""
    if len(same) < least:
        return None
    total = np.r_[0.0, np.round(np.cumsum(same) - min_identity * np.arange(1, len(same) + 1), 9)]
    low = np.minimum.accumulate(total[: len(total) - least])
    gain = np.round(total[least:] - low, 9)
    at = int(np.argmax(gain))
    if gain[at] < 0:
        return None
    start = int(np.flatnonzero(total[: at + 1] == low[at])[-1])
    return start, at + least, int(same[start : at + least].sum())


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (all by default) of every row of ``docs`` and ``_d_hits``, an array of item, start, end
    (code points), words, equal: the best overlap with each item that has ``min_words`` words (or all of
    a shorter item's) at ``min_identity`` or more. No such overlap is missed with limits of ``MIN_WORDS`` and
    ``MIN_IDENTITY`` or above; below them the masks may pass over some.

    Words are runs of characters other than ASCII punctuation and spaces, A-Z as a-z. Null and empty texts
    and items have no hits, equal items are found under each id, null ids as null. Of an item's equally good overlaps that at
    the smallest shift is shown. Rows that repeat are marked each; other columns pass as they are. Where one begins with ``_d_hits``
    the array's name is another, ``hits_name(docs.columns)``.

    A benchmark of up to ``INDEX_BYTES`` is broadcast as an index and nothing is shuffled. Seeds of a larger one are
    joined with those of distinct texts, and pairs of text and item that share one are verified."""
    hit_column, text_column = hits_name(docs.columns), free("_d_text", docs.columns)
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    carry = docs.columns if carry is None else carry
    kind = items.schema["item"].dataType
    arrow = pa.int64() if kind.typeName() in ("long", "integer", "short", "byte") else pa.string()
    hits = f"array<struct<item:{'bigint' if arrow == pa.int64() else 'string'},start:bigint,end:bigint,words:bigint,equal:bigint>>"
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > INDEX_BYTES:
        return _joined(docs, items, text, carry, hits, hit_column, min_words, min_identity)
    rows = items.collect()
    index = docs.sparkSession.sparkContext.broadcast(Index.build([r["item"] for r in rows], [r["text"] for r in rows], min_identity))
    out = docs.select(*carry, F.col(text).alias(text_column), F.expr(f"cast(array() as {hits})").alias(hit_column))
    return out.mapInArrow(_finder(index, min_words, min_identity, arrow), out.schema).drop(text_column)


def _joined(docs: DataFrame, items: DataFrame, text: str, carry: list[str], hits: str, hit_column: str, min_words: int, min_identity: float) -> DataFrame:
    """``mark`` by a distributed join of seeds. Texts and items stand for themselves by a digest, equal ones once."""
    ws = Workspace(docs.sparkSession, "decontamination")
    body, digest = F.col(text), F.unhex(F.md5(F.col(text).cast("binary")))
    texts = docs.where(F.octet_length(body) > 0).select(digest.alias("t"), body.alias("text"))
    named = ws.save(items.select("item", F.unhex(F.md5(F.col("text").cast("binary"))).alias("b"), "text"), "items")

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                index = Index.build([0], [batch.column(1)[i].as_py()], min_identity)
                for mask, keys in zip(index.masks, index.keys):
                    h = np.unique(keys)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(h), i))), pa.array(np.full(len(h), mask)), pa.array(h.view(np.int64))], ["b", "mask", "h"])

    known = ws.save(named.select("b", "text").dropDuplicates(["b"]).mapInArrow(item_seeds, "b binary, mask string, h long"), "item-seeds")
    cells = known.select(F.shiftrightunsigned("h", 64 - _FILTER_BITS).cast("int").alias("c")).distinct().toArrow()
    filled = np.zeros(1 << _FILTER_BITS, bool)  # of a fixed size, whatever the benchmark's
    filled[cells.column(0).to_numpy()] = True
    masks = [r["mask"] for r in known.select("mask").distinct().collect()]  # those of MASKS and one per length below MIN_WORDS
    shared = docs.sparkSession.sparkContext.broadcast((filled, masks))

    def text_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, masks = shared.value
        for batch in batches:
            for a, _, data, offsets in V.chunks(batch.column(1)):
                w = V.words(data, offsets, V.PUNCTUATION)
                for mask in masks:
                    h, at = seeds(w, mask)
                    maybe = filled[(h >> U64(64 - _FILTER_BITS)).astype(np.int64)]
                    h, doc = h[maybe], w.doc[at[maybe]]
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[new] + a)), pa.array(h[new].view(np.int64))], ["t", "h"])

    pairs = texts.mapInArrow(text_seeds, "t binary, h long").join(known.select("b", "h"), "h").select("t", "b").distinct()
    pairs = ws.save(pairs, "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("t", pa.binary()), ("b", pa.binary()), *((n, pa.int64()) for n in ("start", "end", "words", "equal"))])
        for batch in batches:
            for x in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                data, offsets = V.texts(pa.array([x["text"]]))
                found = _best(Index.build([0], [x["itext"]], min_identity), V.words(data, offsets, V.PUNCTUATION), data, offsets, min_words, min_identity)
                yield pa.RecordBatch.from_pylist([{"t": x["t"], "b": x["b"], **{k: v for k, v in h.items() if k != "item"}} for h in found.get(0, {}).values()], shape)

    wanted = texts.join(pairs.select("t").distinct(), "t", "left_semi").dropDuplicates(["t"])
    both = pairs.join(wanted, "t").join(named.select("b", F.col("text").alias("itext")).dropDuplicates(["b"]), "b")
    found = both.select("t", "b", "text", "itext").mapInArrow(verify, "t binary, b binary, start long, end long, words long, equal long")
    found = found.join(named.select("item", "b"), "b").select("t", F.struct("item", "start", "end", "words", "equal").alias("h"))
    found = ws.save(found.groupBy("t").agg(F.sort_array(F.collect_list("h")).cast(hits).alias("h")), "hits")
    plain = {c: f"c{i}" for i, c in enumerate(carry)}  # names that can't clash with those of the hits
    out = docs.select(*[F.col(c).alias(n) for c, n in plain.items()], digest.alias("d")).join(found, F.col("d") == F.col("t"), "left")
    return out.select(*[F.col(n).alias(c) for c, n in plain.items()], F.coalesce("h", F.expr(f"cast(array() as {hits})")).alias(hit_column))


def _finder(index, min_words: int, min_identity: float, arrow: pa.DataType):
    shape = pa.list_(pa.struct([(n, arrow if n == "item" else pa.int64()) for n in ("item", "start", "end", "words", "equal")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            found: dict[int, dict[int, dict]] = {}
            for a, _, data, offsets in V.chunks(batch.column(batch.num_columns - 2)):
                w = V.words(data, offsets, V.PUNCTUATION)
                found |= {a + doc: v for doc, v in _best(ix, w, data, offsets, min_words, min_identity).items()}
            at = batch.num_columns - 1
            hits = pa.array([[h for _, h in sorted(found.get(i, {}).items())] for i in range(batch.num_rows)], shape)
            yield pa.RecordBatch.from_arrays([c if i != at else hits for i, c in enumerate(batch.columns)], batch.schema.names)

    return run


def _best(ix: Index, w: V.Words, data: np.ndarray, offsets: np.ndarray, min_words: int, min_identity: float) -> dict[int, dict[int, dict]]:
    """By text and item number the best overlap of those that seeds propose."""
    found: dict[int, dict[int, dict]] = {}
    points = None
    for doc, it, shift in ix.hits(w).tolist():
        f0, f1, g0, g1 = w.first[doc], w.first[doc + 1], ix.words.first[it], ix.words.first[it + 1]
        lo, hi = max(0, -shift), min(g1 - g0, f1 - f0 - shift)
        best = best_stretch(ix.words.hash[g0 + lo : g0 + hi] == w.hash[f0 + shift + lo : f0 + shift + hi], min_identity, max(1, min(min_words, g1 - g0)))
        old = found.get(doc, {}).get(it)
        if best and (not old or best[2] > old["equal"]):
            s, e, equal = best
            points = V.code_points(data) if points is None else points
            first, last = f0 + shift + lo + s, f0 + shift + lo + e - 1
            base = points[offsets[doc]]
            found.setdefault(doc, {})[it] = {"item": ix.ids[it], "start": int(points[w.start[first]] - base), "end": int(points[w.end[last]] - base), "words": int(e - s), "equal": equal}
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", **limits) -> DataFrame:
    """A row per document and benchmark item that overlap: key, item, ``start``, ``end``, ``n_words``, ``n_equal``.

    As in ``mark``; other columns, whatever their names, are neither read nor returned."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = mark(rows, benchmark, "_text", item, item_text, carry=["_key"], **limits)
    return found.select(F.col("_key").alias(key), F.explode("_d_hits").alias("h")).select(key, F.col("h.item").alias(item), F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("h.words").alias("n_words"), F.col("h.equal").alias("n_equal"))
