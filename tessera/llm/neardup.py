"""Operator 6: near-duplicate documents by HyperMinHash.

One hash per shingle picks a bucket (top bits); of the rest a bucket keeps only what
its smallest value shows in a few bits: the count of leading zeros and the mantissa
bits that follow. These compressed registers are banded, colliding documents are screened by a Jaccard estimate corrected for
accidental register collisions, and what passes is confirmed on full shingle sets.

The work per document is linear and no group of copies is expanded into pairs:

1. documents with the same set are one node (``groupBy`` on a 128-bit set identity);
2. in each band bucket every node is compared with the bucket's smallest and its most central node only;
3. in buckets that hold several components after that, nodes outside the largest one look for their links by a
   prefix join of their rarest shingles, exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .components import components
from .store import Workspace

U64 = np.uint64
BUCKET_BITS = 8
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
ROWS, BANDS = 6, 42
#: A pair at 0.8 shares no band with probability (1 - 0.8**6)**42, below 3e-6; one at 0.3 shares one with 0.03.
_order = np.random.default_rng(6).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1)


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, a row per set; only empty sets have 0.

    ``values`` are sorted within each set, so a bucket's first value is its smallest. A register is
    ``(leading zeros + 1) << 10 | mantissa`` of the value's lower bits. A bucket without a value borrows the
    register of another, the first that has one in an order fixed for each bucket: so short
    sets' registers agree with the same probability as long ones'."""
    n = len(bounds) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    if not len(values):
        return out
    owner = np.repeat(np.arange(n), np.diff(bounds))
    bucket = (values >> U64(64 - BUCKET_BITS)).astype(np.int64)
    cell = owner * REGISTERS + bucket
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    rest = (values[first] << U64(BUCKET_BITS)) >> U64(12)  # 52 bits: exact as a double
    _, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.minimum(52 - exponent, 52 - MANTISSA_BITS)
    mantissa = (rest >> np.maximum(51 - zeros - MANTISSA_BITS, 0).astype(U64)) & U64((1 << MANTISSA_BITS) - 1)
    out.reshape(-1)[cell[first]] = ((zeros.astype(U64) + U64(1)) << U64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    row, col = np.nonzero((out == 0) & (np.diff(bounds) > 0)[:, None])
    own = out.copy()
    for step in range(REGISTERS):
        if not len(row):
            break
        found = own[row, _order[col, step]]
        out[row, col] = found
        row, col = row[found == 0], col[found == 0]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band of each row of registers."""
    keys = np.empty((len(regs), BANDS), U64)
    for j in range(BANDS):
        h = np.full(len(regs), j + 1, U64)
        for i in range(ROWS):
            h = V.mix(h) ^ regs[:, j * ROWS + i].astype(U64)
        keys[:, j] = V.mix(h)
    return keys


def chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Probability that registers of two independent sets agree by accident."""
    a, b = (np.maximum(x / REGISTERS, 1.0) for x in (na, nb))
    total = np.zeros(len(a))
    for i in range(1, 40):
        width = 2.0 ** -(i + MANTISSA_BITS)
        total += a * b * width * (np.exp(-(a + b) * 2.0**-i) - np.exp(-(a + b) * 2.0 ** -(i - 1))) / (a + b)
    return total


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of aligned register rows."""
    p = chance(na, nb)
    return ((ra == rb).mean(1) - p) / (1 - p)


def passes(ra, rb, na, nb, threshold: float) -> np.ndarray:
    """Pairs whose estimate is not five standard errors below the threshold. The error is that of as
    many draws as the larger set fills buckets, and of the borrowed registers besides."""
    larger = np.maximum(na, nb)
    filled = REGISTERS * -np.expm1(-larger / REGISTERS)
    error = np.sqrt(threshold * (1 - threshold) * (1 / np.maximum(filled, 1) + 1 / REGISTERS))
    return estimate(ra, rb, na, nb) >= threshold - 5 * error


def _registers_of(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(-1, REGISTERS)


def sketches(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """``id``, ``n`` (set size), ``s1``/``s2`` (identity of the set) and ``regs`` (registers as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in V.chunks(batch.column(1)):
                h, bounds = V.words(data, offsets).shingles(k)
                n = np.diff(bounds)
                total = np.zeros((2, len(h) + 1), U64)
                np.cumsum(V.mix(h ^ U64(0x1F83D9ABFB41BD6B)), out=total[0, 1:])
                np.cumsum(V.mix(h ^ U64(0x5BE0CD19137E2179)), out=total[1, 1:])
                s1, s2 = ((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total)
                regs = [r.tobytes() for r in registers(h, bounds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), pa.array(regs, pa.binary())],
                    ["id", "n", "s1", "s2", "regs"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n long, s1 long, s2 long, regs binary")


def sets(docs: DataFrame, k: int) -> DataFrame:
    """``id`` and the sorted distinct shingle hashes ``items`` of its whole ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in V.chunks(batch.column(1)):
                h, bounds = V.words(data, offsets).shingles(k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), V.lists(h.view(np.int64), bounds, pa.int64())], ["id", "items"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, items array<long>")


#: Most cells of the filter that ``among`` lays before its join: 4 MB, whatever the input.
FILTER_CELLS = 1 << 25


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``id`` is in ``ids`` (distinct).

    Where ``ids`` are too many to broadcast a join deals out every row of ``docs``, texts and all, though few are asked for. A
    filter of one bit for each hashed id, 16 to 32 cells an id up to FILTER_CELLS, stops most others before; the join decides.
    Collated ids can be equal and have other hashes: they have no filter."""
    if "collate" in docs.schema["id"].dataType.simpleString():
        return docs.join(ids, "id", "left_semi")
    cells = min(FILTER_CELLS, max(1 << 10, 1 << (16 * ids.count()).bit_length()))
    cell = F.shiftrightunsigned(F.xxhash64("id"), 65 - cells.bit_length())
    word, at = F.shiftright(cell, 6).cast("int"), cell.bitwiseAND(F.lit(63)).cast("int")
    given = ids.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at).alias("bits"))
    every = ids.sparkSession.range(cells >> 6).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("bits"))
    words = given.unionByName(every).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    table = words.agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).getField("bits"))
    return docs.where(F.getbit(F.get(table.scalar(), word), at) == 1).join(ids, "id", "left_semi")


def collisions(reps: DataFrame) -> DataFrame:
    """``id`` and key ``k`` of every band."""
    kind = reps.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keys = band_keys(_registers_of(x.column(1)))
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(np.repeat(np.arange(len(keys)), BANDS))), pa.array(keys.view(np.int64).reshape(-1))], ["id", "k"])

    return reps.where("n > 0").select("id", "regs").mapInArrow(run, f"id {kind}, k long")


def screen(pairs: DataFrame, reps: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Candidate pairs ``a``, ``b`` whose registers don't rule the link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                na, nb = (x.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 4))
                keep = passes(_registers_of(x.column(3)), _registers_of(x.column(5)), na, nb, threshold)
                yield x.select(["a", "b"]).filter(pa.array(keep))

    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "ra", "nb", "rb").mapInArrow(run, f"a {kind}, b {kind}")


def confirm(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union| on full sets."""
    side = lambda c: items.select(F.col("id").alias(c), F.col("items").alias(f"i{c}"))
    both = F.size(F.array_intersect("ia", "ib"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("x"), (F.size("ia") + F.size("ib")).alias("t"))
    return joined.where(f"100L * x >= {percent}L * (t - x)").select("a", "b")


def hubs(buckets: DataFrame, ws: Workspace) -> DataFrame:
    """Pairs ``a``, ``b``: every node with the least and with the centre of each of its buckets (``k``, ``id``, ``head``, ``m``).

    The centre is the member that meets most others in all its buckets: variants of a text are often closer to their
    origin than to each other. Ties are drawn for each bucket by itself."""
    large = buckets.where("m > 2")
    met = ws.save(large.groupBy("id").agg(F.sum("m").alias("met")), "met")
    centres = large.join(met, "id").groupBy("k").agg(F.max(F.struct("met", F.xxhash64("k", "id").alias("drawn"), "id")).alias("x"))
    centres = ws.save(centres.select("k", F.col("x.id").alias("centre")), "centres")
    pairs = buckets.select("id", F.col("head").alias("other")).unionByName(large.join(centres, "k").select("id", F.col("centre").alias("other")))
    return pairs.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def residue(buckets: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame | None:
    """What hubs don't show: nodes ``id`` of buckets that hold several components, their ``comp`` and whether they lie
    outside the largest one of some bucket (``seeks``). One bucket stands for all with the same members. None if
    there are no such buckets."""
    named = buckets.where("m > 2").select("k", "id", "m").join(labels.withColumnRenamed("node", "id"), "id", "left").select("k", "id", "m", F.coalesce("component", "id").alias("comp"))
    members = [F.first("m").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64(F.lit(7), "id").cast("decimal(20)")).alias("s")]
    mixed = named.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *members)
    mixed = ws.save(mixed.where("lo <> hi").groupBy("x", "m", "s").agg(F.min("k").alias("k")).select("k"), "mixed")
    if mixed.isEmpty():
        return None
    chosen = ws.save(named.join(mixed, "k").drop("m"), "chosen")
    sizes = chosen.groupBy("k", "comp").agg(F.count("*").alias("c"))
    leads = ws.save(sizes.groupBy("k").agg(F.max_by("comp", F.struct("c", "comp")).alias("lead")), "leads")
    return chosen.join(leads, "k").groupBy("id").agg(F.first("comp").alias("comp"), F.bool_or(F.expr("comp <> lead")).alias("seeks"))


#: Counters by which shingles are told rare from frequent: 2 ** COUNTER_BITS bytes, whatever the input.
COUNTER_BITS = 18


def rarity(items: DataFrame) -> np.ndarray:
    """How frequent shingles are, by a hash of COUNTER_BITS bits, as eighths of a power of two. Any order of shingles
    gives exact results; one that puts rare ones first gives few candidates."""
    cell = F.shiftrightunsigned(F.xxhash64("t"), 64 - COUNTER_BITS).cast("int")
    counts = items.select(F.explode("items").alias("t")).groupBy(cell.alias("c")).count().toArrow()
    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    out[counts.column(0).to_numpy()] = np.minimum(255, np.round(8 * np.log2(counts.column(1).to_numpy() + 1.0)))
    return out


def prefixes(items: DataFrame, table: np.ndarray, percent: int) -> DataFrame:
    """Rows ``id``, ``comp``, ``seeks``, ``n``, ``t``, ``at``, ``short``: a set's rarest shingles and their places.

    Sets are put in one order, rare shingles first. Two sets with Jaccard >= percent / 100 share a shingle that is
    among the first n - ceil(p n) + 1 of the larger and the first n - ceil(2 p n / (1 + p)) + 1 (``short``)
    of the smaller."""
    kind = items.schema["id"].dataType.simpleString()
    shared = items.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a in range(0, x.num_rows, 256):
                part = x.slice(a, 256)
                column = part.column(3)
                n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = column.flatten().to_numpy()
                cells = pc.list_flatten(part.column(4)).to_numpy()
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((flat, shared.value[cells], owner))
                at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                size = n[owner]
                keep = at <= size - -(-percent * size // 100)
                order, own, at, size = order[keep], owner[keep], at[keep], size[keep]
                short = at <= size - -(-2 * percent * size // (100 + percent))
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), part.column(1).take(own), part.column(2).take(own), pa.array(size), pa.array(flat[order]), pa.array(at), pa.array(short)],
                    ["id", "comp", "seeks", "n", "t", "at", "short"],
                )

    cells = F.transform("items", lambda t: F.shiftrightunsigned(F.xxhash64(t), 64 - COUNTER_BITS).cast("int"))
    rows = items.select("id", "comp", "seeks", "items", cells.alias("cells"))
    return rows.mapInArrow(run, f"id {kind}, comp {kind}, seeks boolean, n long, t long, at long, short boolean")


def exact_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of different components, one of which seeks, that share a shingle of their prefixes at places
    that leave room for a link: a superset of their links (prefix and position filters)."""
    p = rows.select(*[F.col(c).alias(f"p{c}") for c in ("id", "comp", "seeks", "n", "at")], "t")
    q = rows.where("short").select(*[F.col(c).alias(f"q{c}") for c in ("id", "comp", "seeks", "n", "at")], "t")
    fits = F.expr(f"pid <> qid and pcomp <> qcomp and (pseeks or qseeks) and qn <= pn and 100L * qn >= {percent}L * pn and {100 + percent}L * least(pn - pat, qn - qat) >= {percent}L * (pn + qn)")
    return p.join(q, (p["t"] == q["t"]) & fits).select(F.least("pid", "qid").alias("a"), F.greatest("pid", "qid").alias("b")).distinct()


def link(pairs_of: Callable[[DataFrame], DataFrame], fetch: Callable[[DataFrame], DataFrame], keys: DataFrame, ws: Workspace, percent: int = 80, given: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """Components of nodes under Jaccard >= percent / 100 of their sets; work is linear in the bucket rows.

    ``keys`` holds ``id``, ``k`` for each band, ``pairs_of(pairs)`` drops pairs that a cheap look rules out, ``fetch(ids)`` returns ``id``,
    ``items`` of the nodes asked for (out of a table already, if ``stored``; the first call asks for all that later ones do unless
    ``pairs_of`` drops pairs); links ``given`` count as they are. No link between nodes that share
    a bucket is lost:

    1. every node meets the least and the centre of each of its buckets;
    2. of buckets that still hold several components, nodes outside the largest seek their links by prefix joins, exactly.

    Returns ``node``, ``component`` of linked nodes."""

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = ws.save(pairs_of(pairs), f"{name}-pairs")
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        items = fetch(ids) if stored else ws.save(fetch(ids), f"{name}-items")
        edges = ws.save(confirm(pairs, items, percent), f"{name}-edges")
        ws.drop(f"{name}-pairs", f"{name}-items")
        return edges

    # written, so that the planner knows its size, broadcasts it if small and splits hot buckets if not
    heads = ws.save(keys.groupBy("k").agg(F.min("id").alias("head"), F.count("*").alias("m")).where("m > 1"), "heads")
    buckets = ws.save(keys.join(heads, "k"), "buckets")
    edges = confirmed(hubs(buckets, ws), "first")
    labels = ws.save(components(edges.unionByName(given) if given is not None else edges, ws), "labels")

    sought = residue(buckets, labels, ws)
    if sought is None:
        return labels
    sought = ws.save(sought, "sought")
    ws.drop("buckets", "heads", "met", "centres", "mixed", "chosen", "leads")
    items = ws.save(fetch(sought.select("id")).join(sought, "id"), "sets")
    rows = ws.save(prefixes(items, rarity(items), percent), "prefixes")
    edges = confirmed(exact_pairs(rows, percent), "last")
    ws.drop("prefixes", "sets", "sought")
    if edges.isEmpty():
        return labels
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))  # stars already
    return ws.save(components(known.unionByName(edges), ws, "last-cc"), "last-labels")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of ``k``-word shingles have Jaccard >= ``percent`` / 100.

    A-Z count as a-z and words are separated by space and \\x09-\\x0D. A text of fewer than
    ``k`` words has its whole sequence as one shingle; an empty or null text has none
    and is linked with nothing. A row with a null key can't be linked: it stays alone, with a
    null component. Rows that repeat a key count as one document: links of
    any of its texts are its own, and its rows share a component. Ties go to the smallest key. Other columns of ``docs`` are neither read nor returned.

    Returns per row: the key, ``n_shingles``, ``component_id`` (smallest key reachable) and
    ``kept`` (the key is that of its component).
    """
    ws = Workspace(docs.sparkSession, "near-duplicates")
    base = ws.save(sketches(docs, key, text, k), "sketches")
    reps = ws.save(base.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.first("regs").alias("regs")), "reps")

    def fetch(ids: DataFrame) -> DataFrame:
        return sets(among(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), ids), k)

    names = reps.select("s1", "s2", "n", F.col("id").alias("rep"))
    rows = ws.save(base.select("id", "n", "s1", "s2").join(names, ["s1", "s2", "n"], "left").select("id", "n", "rep"), "rows")
    # a key with several texts holds their classes together
    several = rows.where("id is not null and rep is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi").select("id", "a")
    same = rows.where("rep is not null").join(several, "id").select(F.col("rep").alias("a"), F.col("a").alias("b")).where("a <> b")
    kind = docs.schema[key].dataType.simpleString()
    labels = link(lambda pairs: screen(pairs, reps, kind, percent / 100), fetch, collisions(reps), ws, percent, same)
    out = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("found", F.coalesce("component", "rep"))
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
