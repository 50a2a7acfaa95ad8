"""Exact nearest rows between packed blocks of vectors, by matrix products.

A product gives a lower bound of each squared distance, below it by more than rounding can be off (single precision, or double where
that tells too little); pairs whose bound doesn't exceed the best distance so far are measured place by place. Rows that a product can't bound (missing, infinite or vast
numbers) are measured against all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a block's matrix, whatever its number of rows; rows of a block that one product takes; pairs measured at once.
BLOCK_BYTES, STRIP, PAIRS = 4 << 20, 256, 1 << 14
#: Squared lengths beyond which sums may overflow, in double and single precision, and what underflow may take from a sum.
VAST, VAST_SINGLE, TINY = 1e300, 1e30, {np.float32: 1e-30, np.float64: 1e-290}
#: Pairs to be measured per row beyond which single precision tells too little, and the product is taken in double.
MANY = 8
#: Kinds of distance, in their order: a number, NaN, none (no place that both rows have), no row met.
NAN, NONE, UNMET = 1, 2, 3


def _matrix(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows of lists side by side, filled up with zeros, and where numbers are missing (None: nowhere)."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, width = column.flatten(), int(n.max(initial=0))
    numbers = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    if not flat.null_count and (n == width).all():
        return numbers.reshape(len(n), width).astype(dtype, copy=False), None
    row, at = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    values, missing = np.zeros((len(n), width), dtype), np.ones((len(n), width), bool)
    values[row, at], missing[row, at] = numbers, pc.is_null(flat).to_numpy(zero_copy_only=False)
    return values, missing


def packer(block: int, dtype: str, once: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``id``, ``v`` into blocks ``ids``, ``width``, ``v``, ``missing``. ``once``: of equal vectors in a block the first stays."""

    def packed(ids: pa.Array, column: pa.Array) -> Iterator[pa.RecordBatch]:
        width = max(pc.max(pc.list_value_length(column)).as_py() or 0, 1)
        step = max(1, min(block, BLOCK_BYTES // (8 * width)))
        for a in range(0, len(ids), step):
            values, missing = _matrix(column.slice(a, step), dtype)
            part = ids.slice(a, step)
            if once and values.shape[1]:
                whole = np.ascontiguousarray(values).view(np.uint8) if missing is None else np.hstack([values.view(np.uint8), missing.view(np.uint8)])
                keep = np.sort(np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_index=True)[1])
                part, values, missing = part.take(pa.array(keep)), values[keep], missing if missing is None else missing[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), pa.array([values.shape[1]], pa.int32()), pa.array([values.tobytes()], pa.binary()), pa.array([None if missing is None else missing.tobytes()], pa.binary())],
                ["ids", "width", "v", "missing"],
            )

    def run(batches):
        held, n = [], 0
        for x in chain(batches, [None]):
            if x is not None and x.num_rows:
                held.append(x)
                n += x.num_rows
            if held and (x is None or n >= block):
                ids, column = (pa.concat_arrays([h.column(i) for h in held]) for i in (0, 1))
                whole = n if x is None else n - n % block
                yield from packed(ids.slice(0, whole), column.slice(0, whole))
                held, n = ([pa.RecordBatch.from_arrays([ids.slice(whole), column.slice(whole)], ["id", "v"])], n - whole) if n > whole else ([], 0)

    return run


class _Block:
    def __init__(self, x: pa.RecordBatch, r: int, side: str, dtype: str):
        get = lambda name: x.column(f"{side}_{name}")[r]
        self.ids, width, missing = get("ids").values, get("width").as_py(), get("missing")
        shape = (len(self.ids), width)
        self.v = np.frombuffer(get("v").as_buffer(), dtype).astype(np.float64).reshape(shape)
        self.missing = np.frombuffer(missing.as_buffer(), bool).reshape(shape) if missing.is_valid else np.broadcast_to(False, shape)
        self.whole = not missing.is_valid

    def lengths(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared lengths of the first ``d`` places, and which rows a product can bound."""
        n = np.einsum("ij,ij->i", self.v[:, :d], self.v[:, :d])
        return n, (n < VAST) & (True if self.whole else ~self.missing[:, :d].any(axis=1))


class _Best:
    """The best row met so far for each row of one block."""

    def __init__(self, left: _Block):
        n = len(left.ids)
        self.left, self.seen, self.size = left, [], 0
        self.kind, self.dist, self.at = np.full(n, UNMET), np.zeros(n), np.zeros(n, np.int64)

    def _measure(self, right: _Block, d: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kind and distance of pairs, squares added up from the first place to the last."""
        kind, dist = np.zeros(len(i), np.int64), np.zeros(len(i))
        for p in range(0, len(i), PAIRS):
            at = slice(p, p + PAIRS)
            steps = self.left.v[i[at], :d] - right.v[j[at], :d]
            squares = np.ascontiguousarray((steps * steps).T)
            there = np.ones(squares.shape[1], bool) if d else np.zeros(squares.shape[1], bool)
            if not (self.left.whole and right.whole):
                gone = (self.left.missing[i[at], :d] | right.missing[j[at], :d]).T
                squares[gone], there = 0, ~gone.all(axis=0)
            total = np.zeros(squares.shape[1])
            for row in squares:
                total += row
            far = np.sqrt(total)
            kind[at] = np.where(there, np.where(np.isnan(far), NAN, 0), NONE)
            dist[at] = np.where(kind[at] == 0, far, 0)
        return kind, dist

    def _offer(self, right: _Block, d: int, i: np.ndarray, j: np.ndarray, ties: list) -> None:
        """Measure pairs (``j`` ascends within ``i``) and keep the best of each ``i``."""
        kind, dist = self._measure(right, d, i, j)
        order = np.lexsort((j, dist, kind, i))
        first = order[np.r_[True, np.diff(i[order]) > 0]] if len(order) else order
        i, j, kind, dist = i[first], j[first] + self.size, kind[first], dist[first]
        same = (kind == self.kind[i]) & (dist == self.dist[i])
        better = (kind < self.kind[i]) | (kind == self.kind[i]) & (dist < self.dist[i])
        ties.append((i[same], j[same], kind[same], dist[same]))
        i, j, kind, dist = i[better], j[better], kind[better], dist[better]
        self.kind[i], self.dist[i], self.at[i] = kind, dist, j

    def meet(self, right: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Take the rows of another block into account; rows as near as the best, which are left to be decided by id."""
        left, ties, d = self.left, [], min(self.left.v.shape[1], right.v.shape[1])
        (na, fa), (nb, fb) = left.lengths(d), right.lengths(d)
        rows, columns = np.flatnonzero(fa), np.flatnonzero(fb)
        if len(rows) and len(columns):
            single = max(na[rows].max(), nb[columns].max()) < VAST_SINGLE
            sides: dict = {}
            for p in range(0, len(rows), STRIP):
                i = rows[p : p + STRIP]
                for real in (np.float32, np.float64) if single else (np.float64,):
                    slack = 8 * (d + 8) * float(np.finfo(real).eps)
                    if real not in sides:
                        sides[real] = np.column_stack([right.v[columns, :d], nb[columns] * (1 - slack)]).astype(real).T
                    low = np.column_stack([-2 * left.v[i, :d], np.ones(len(i))]).astype(real) @ sides[real]
                    limit = lambda k, x: np.where(k == 0, x * x * (1 + slack) + TINY[real], np.inf) - na[i] * (1 - slack)  # noqa: B023, E731
                    bound = limit(self.kind[i], self.dist[i]).astype(real)
                    hit = np.flatnonzero(low.min(axis=1) <= bound)
                    low, i, bound = low[hit], i[hit], bound[hit]
                    if not len(hit):
                        break
                    bound = np.minimum(bound, limit(*self._measure(right, d, i, columns[low.argmin(axis=1)])).astype(real))
                    x, y = np.nonzero(low <= bound[:, None])
                    if real is np.float64 or len(x) <= MANY * len(i):
                        self._offer(right, d, i[x], columns[y], ties)
                        break
        everyone = np.arange(len(right.ids))
        for those, others in ((np.flatnonzero(~fa), everyone), (rows, np.flatnonzero(~fb))):
            step = max(1, PAIRS // max(1, len(others)))
            for p in range(0, len(those) if len(others) else 0, step):
                i = those[p : p + step]
                self._offer(right, d, np.repeat(i, len(others)), np.tile(others, len(i)), ties)
        self.seen.append(right.ids)
        self.size += len(right.ids)
        i, j, kind, dist = (np.concatenate(t) for t in zip(*ties)) if ties else [np.zeros(0, np.int64)] * 4
        still = (kind == self.kind[i]) & (dist == self.dist[i])
        return i[still], j[still]

    def rows(self, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        kind = self.kind[i]
        dist = np.where(kind == NAN, np.nan, self.dist[i])
        return pa.RecordBatch.from_arrays([self.left.ids.take(pa.array(i)), pa.array(kind == NONE), pa.array(dist), pa.concat_arrays(self.seen).take(pa.array(j))], ["id", "none", "dist", "nn"])


def searcher(dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of blocks (columns of ``packer`` with ``a_`` and ``b_``, and ``a_k``, by which pairs of one block ``a`` follow one another) into
    rows ``id``, ``none``, ``dist``, ``nn``: the nearest row and those as near, several times for an ``id`` of several pairs."""

    def run(batches):
        best = now = None
        with np.errstate(all="ignore"):
            for x in batches:
                for r in range(x.num_rows):
                    k = x.column("a_k")[r].as_py()
                    if best is None or k != now:
                        if best is not None:
                            yield best.rows(np.arange(len(best.kind)), best.at)
                        best, now = _Best(_Block(x, r, "a", dtype)), k
                    ties = best.meet(_Block(x, r, "b", dtype))
                    if len(ties[0]):
                        yield best.rows(*ties)
            if best is not None:
                yield best.rows(np.arange(len(best.kind)), best.at)

    return run
