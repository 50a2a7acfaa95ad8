"""Operator 2: repeated passages by paragraph MinHash banding.

Paragraphs are a text's lines of ``MIN_WORDS`` words or more, those that hold a shingle. Equal ones are one class.
Classes' 5-word shingles get 36 MinHash values in 12 bands of three; colliding classes are joined, confirmed by
exact Jaccard of 0.8 or more and clustered by components.

A passage that is put inside a longer line is no paragraph, and no similarity of whole lines
shows it. So content-anchored windows are proposed as paragraphs as well: of the hashes of all
``WIDTH``-word windows those that are least within ``REACH`` consecutive ones. Any passage of
``WIDTH + REACH - 1`` = 51 words that two documents share has such a window in both, at the same
words. Near a passage's ends the words around it decide which windows are proposed: such a window may be
proposed in some of the copies only, and its first place is then among those. Windows that stand in one document only are put aside; all others are classes like those of lines and go
through the same bands, the same exact Jaccard and the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from . import vectext as V
from .components import components
from .neardup import link
from .store import Workspace

U64 = np.uint64
K = 5
MIN_WORDS = K
#: Tuned for recall: a pair at 0.8 shares a band with probability 1 - (1 - 0.8**3)**12 = 0.9998.
BANDS, ROWS = 12, 3
WIDTH, REACH = 20, 32
_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all lines of the texts and the text of each line."""
    breaks = np.flatnonzero(data == 10) + 1
    bounds = np.unique(np.concatenate([offsets, breaks]))
    return bounds, np.searchsorted(offsets, bounds[:-1], "right") - 1


def bands(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys per shingle set (sets are not empty)."""
    n = len(bounds) - 1
    keys = np.zeros((n, BANDS), U64)
    if n:
        for i in range(BANDS * ROWS):
            h = values * _MUL[i] + _ADD[i]
            least = np.minimum.reduceat(h ^ (h >> U64(32)), bounds[:-1])
            keys[:, i // ROWS] = V.mix(keys[:, i // ROWS] * U64(0x2545F4914F6CDD1D) + least + U64(i))
    return keys


def anchors(w: V.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes and first word of the ``WIDTH``-word windows that are least (rightmost on ties) of some
    ``REACH`` consecutive windows of their text; of a text with fewer windows, the least of all."""
    h, at = w.windows(WIDTH)
    other_h, _ = w.windows(WIDTH, salt=0x6A09E667F3BCC908)
    if not len(h):
        return h, h, at
    doc = w.doc[at]
    n = len(h)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[first, n])
    best = np.arange(n)  # position of the least of the windows from here on, doubled in reach
    span, last = 1, np.repeat(first + size - 1, size)
    idx = np.arange(n)
    while span < REACH:
        step = min(span, REACH - span)
        other = best[np.minimum(idx + step, n - 1)]
        valid = idx + step <= last
        best = np.where(valid & (h[other] <= h[best]), other, best)
        span += step
    whole = (idx + REACH - 1 <= last) | ((size < REACH).repeat(size) & (idx == first.repeat(size)))
    chosen = np.unique(best[whole])
    # periodic texts choose equal windows over and over: of those in a row so many stay as overlap
    new = np.ones(len(chosen), bool)
    new[1:] = (h[chosen][1:] != h[chosen][:-1]) | (doc[chosen][1:] != doc[chosen][:-1])
    part = (chosen - chosen[new][np.cumsum(new) - 1]) // (WIDTH - 4)
    new[1:] |= part[1:] != part[:-1]
    return h[chosen[new]], other_h[chosen[new]], at[chosen[new]]


def units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per paragraph: ``doc``, ``row`` (a hash of the text), ``nth`` (windows: number in a row), ``start``, ``end`` (code points), ``words``,
    identity ``s1``/``s2``, band keys ``keys`` (none for windows) and whether it is a ``window``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in V.chunks(batch.column(1)):
                points = V.code_points(data)
                bounds, owner = _line_offsets(data, offsets)
                w = V.words(data, bounds)
                count = w.counts
                long = np.flatnonzero(count >= MIN_WORDS)
                h, b = w.shingles(K)
                pick = np.concatenate([np.arange(b[i], b[i + 1]) for i in long]) if len(long) else np.empty(0, np.int64)
                sub = np.r_[0, np.cumsum((b[1:] - b[:-1])[long])].astype(np.int64)
                h = h[pick]
                sums = [np.r_[U64(0), np.cumsum(V.mix(h ^ U64(c)))] for c in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]
                s1, s2 = ((s[sub[1:]] - s[sub[:-1]]).view(np.int64) for s in sums)
                ls, le = w.start[w.first[long]], w.end[w.first[long + 1] - 1]
                ld, lw = owner[long], count[long]
                v = V.words(data, offsets)
                wh, wg, wa = anchors(v)
                ws, we = v.start[wa], v.end[wa + WIDTH - 1]
                rows = np.r_[ld, v.doc[wa]] + a
                start = np.r_[ls, ws]
                base = points[offsets[np.r_[ld, v.doc[wa]]]]
                keys = bands(h, sub).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        batch.column(2).take(pa.array(rows)),
                        pa.array(np.r_[np.full(len(long), -2), np.arange(len(wh))].astype(np.int32)),
                        pa.array((points[start] - base).astype(np.int32)),
                        pa.array((points[np.r_[le, we]] - base).astype(np.int32)),
                        pa.array(np.r_[lw, np.full(len(wh), WIDTH)].astype(np.int32)),
                        pa.array(np.r_[s1, wh.view(np.int64)]),
                        pa.array(np.r_[s2, wg.view(np.int64)]),
                        V.lists(keys.reshape(-1), np.r_[np.arange(len(long) + 1) * BANDS, np.full(len(wh), len(long) * BANDS)], pa.int64()),
                        pa.array(np.r_[np.zeros(len(long), bool), np.ones(len(wh), bool)]),
                    ],
                    ["doc", "row", "nth", "start", "end", "words", "s1", "s2", "keys", "window"],
                )

    kind = docs.schema[key].dataType.simpleString()
    shape = f"doc {kind}, row long, nth int, start int, end int, words int, s1 long, s2 long, keys array<long>, window boolean"
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), _row(text).alias("row")).where("doc is not null").mapInArrow(run, shape)


def _paragraph_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, names: DataFrame) -> DataFrame:
    """``id`` and shingle set ``items`` of the classes ``wanted`` (``id``), read at the class's place ``rep`` of ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in V.chunks(batch.column(0)):
                points = V.code_points(data)
                bounds, owner = _line_offsets(data, offsets)
                lines, whole = V.words(data, bounds), V.words(data, offsets)
                sets, b = lines.shingles(K)
                grams, at = whole.windows(K)
                # places of lines and of words by text and code point
                base = points[offsets]
                long = np.flatnonzero(lines.counts >= MIN_WORDS)
                line_place = points[lines.start[lines.first[long]]] - base[owner[long]]
                line_first = np.searchsorted(owner[long], np.arange(len(offsets)))
                place = points[whole.start] - base[whole.doc]
                ids, items = [], []
                for doc, row in enumerate(batch.column(1).slice(a, len(offsets) - 1).to_pylist()):
                    lo, hi = whole.first[doc], whole.first[doc + 1]
                    for x in row:
                        if x["window"]:
                            first = lo + int(np.searchsorted(place[lo:hi], x["start"]))
                            g = int(np.searchsorted(at, first))
                            found = np.unique(grams[g : g + WIDTH - K + 1])
                        else:
                            c, d = line_first[doc : doc + 2]
                            i = long[c + int(np.searchsorted(line_place[c:d], x["start"]))]
                            found = sets[b[i] : b[i + 1]]
                        ids.append(x["id"])
                        items.append(found.view(np.int64))
                flat = np.concatenate(items) if items else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), V.lists(flat, np.r_[0, np.cumsum([len(x) for x in items])].astype(np.int64), pa.int64())], ["id", "items"])

    starts = names.join(wanted, "id", "left_semi").groupBy("rep.doc", "rep.row").agg(F.collect_list(F.struct("rep.start", "id", "window")).alias("starts"))
    rows = docs.select(F.col(key).alias("doc"), _row(text).alias("row"), F.col(text).alias("text")).join(starts, ["doc", "row"])
    return rows.select("text", "starts").mapInArrow(run, "id long, items array<long>")


def _row(text: str) -> F.Column:
    """Tells texts under one key apart."""
    return F.xxhash64(text)


def _window_bands(items: DataFrame) -> DataFrame:
    """``id`` and ``k`` for each band of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n = pc.list_value_length(x.column(1)).to_numpy().astype(np.int64)
            keys = bands(x.column(1).flatten().to_numpy().view(U64), np.r_[0, np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(np.repeat(np.arange(len(n)), BANDS))), pa.array(keys.view(np.int64).reshape(-1))], ["id", "k"])

    return items.mapInArrow(run, "id long, k long")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Passages that repeat across documents, a row for each place, with the place to keep marked.

    Whole texts are read, of any length; null or empty ones have no passage, and rows with a null key can't be
    told apart and are left out of the result. Repeats inside one document alone are not across documents
    and give no row. Rows that repeat a key count as one document. Ties go to the smallest key
    and then to the earliest place. An empty table gives no row. Other columns, whatever their names, are neither
    read nor returned.

    Returns the key, ``start``, ``end`` (code points; overlapping paragraphs of a document are merged),
    ``n_words`` (of its largest paragraph), ``component_id`` (of all passages that overlap in some document: the key of the first document
    and the start there of the first place, as text) and ``kept`` (the passage's paragraphs are the first of their like).
    """
    ws = Workspace(docs.sparkSession, "paragraphs")
    base = ws.save(units(docs, key, text), "units", by="window")
    same = [F.min(F.struct("doc", "start", "end", "row")).alias("rep"), F.max("doc").alias("last")]

    # Equal paragraphs are one class, numbered once its table is written.
    lines = base.where("not window").groupBy("s1", "s2").agg(*same, F.first("keys").alias("keys"))
    lines = ws.save(lines.withColumns({"id": F.monotonically_increasing_id() * 2, "window": F.lit(False)}), "lines")
    windows = base.where("window").groupBy("s1", "s2").agg(*same).where("rep.doc < last")
    windows = ws.save(windows.withColumns({"id": F.monotonically_increasing_id() * 2 + 1, "window": F.lit(True)}), "windows")
    classes = lines.drop("keys").unionByName(windows)

    names = classes.select("id", "rep", "window")
    proposed = ws.save(_paragraph_sets(docs, key, text, windows.select("id"), names.where("window")), "window-sets")
    keys = lines.select("id", F.explode("keys").alias("k")).unionByName(_window_bands(proposed))

    kept: list[DataFrame] = []

    def fetch(ids: DataFrame) -> DataFrame:
        """Texts are read for the first call only, which asks for every class that shares a bucket."""
        if not kept:
            kept.append(ws.save(_paragraph_sets(docs, key, text, ids.where("id % 2 = 0"), names.where("not window")), "line-sets").unionByName(proposed))
        return kept[0].join(ids, "id", "left_semi")

    labels = link(lambda pairs: pairs, fetch, keys, ws, percent, stored=True)

    # A component keeps its first place, and windows of its like that overlap it; what it repeats in another document is shown.
    named = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("near", F.coalesce("component", "id"))
    spans = ws.save(named.groupBy("near").agg(F.min("rep").alias("place"), F.max("last").alias("last_doc")).where("place.doc < last_doc"), "spans")
    # written, so that the planner knows its size, broadcasts it if small and splits hot passages if not
    shared = ws.save(named.join(spans, "near").select("s1", "s2", "window", "near", "place"), "shared")
    places = base.drop("keys").join(shared, ["s1", "s2", "window"])
    places = places.select("doc", "nth", "start", "end", "words", "near", F.col("place.doc").alias("fdoc"), F.expr("doc = place.doc and start < place.end").alias("kept"))

    # Paragraphs of a document that overlap, and share a fate, are one passage; so are a document's windows
    # that follow each other without another between and repeat the same document.
    whole, own = W.partitionBy("doc").orderBy("start", "end", "nth"), W.partitionBy("doc", "kept").orderBy("start", "end", "nth")
    before = lambda order: order.rowsBetween(W.unboundedPreceding, -1)
    follows = (F.lag("nth").over(own) + 1 == F.col("nth")) & (F.lag("fdoc").over(own) == F.col("fdoc"))
    running = lambda first, order: F.count_if(first).over(order.rowsBetween(W.unboundedPreceding, 0))
    apart = lambda order: ~F.coalesce(F.max("end").over(before(order)) > F.col("start"), F.lit(False))
    islands = places.withColumns({"a": apart(whole), "b": apart(own) & ~F.coalesce(follows, F.lit(False))})
    islands = islands.withColumns({"heap": running(F.col("a"), whole), "island": running(F.col("b"), own)})
    least = [F.min("near").over(W.partitionBy("doc", "heap")).alias("beside"), F.min("near").over(W.partitionBy("doc", "kept", "island")).alias("within")]
    islands = ws.save(islands.select("doc", "start", "end", "words", "near", "kept", "island", *least), "islands")

    # What overlaps in some document is one component, named by its first place.
    met = [islands.select(F.col("near").alias("a"), F.col(c).alias("b")) for c in ("beside", "within")]
    joint = components(met[0].unionByName(met[1]), ws, "joint").withColumnRenamed("node", "near")
    names = spans.join(joint, "near", "left").select("near", "place", F.coalesce("component", "near").alias("component"))
    firsts = names.groupBy("component").agg(F.min("place").alias("first"))
    names = ws.save(names.join(firsts, "component").select("near", F.concat_ws(":", "first.doc", "first.start").alias("component_id")), "names")
    out = islands.join(names, "near").repartition("doc").groupBy("doc", "kept", "island").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.max("words").cast("long").alias("n_words"), F.min("component_id").alias("component_id"))
    # a window that only later copies propose lies inside a passage that goes: it isn't shown as one that stays
    gone = F.max(F.when(~F.col("kept"), F.col("end"))).over(W.partitionBy("doc").orderBy("start"))
    out = out.withColumn("gone", gone).where("not kept or gone is null or gone < end")
    out = ws.save(out.select(F.col("doc").alias(key), "start", "end", "n_words", "component_id", "kept"), "passages")
    ws.drop("units", "lines", "windows", "window-sets", "line-sets", "spans", "shared", "islands", "names")
    return out
