"""The best vectors of many queries at once, as products of matrices inside tasks.

Scores are those of ``vectors.cosine``, rounded to ``DIGITS``. A product of directions tells which vectors may be among the k best
of a query, and it is off by far less than the last digit; where a score is so near to a half of that digit that this could
matter, it is computed again in the order of components.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DIGITS = 6
UNITS = 10.0**DIGITS
#: Queries and vectors whose scores are held at once, and scores that are computed one by one at a time.
QUERIES, VECTORS, SINGLY = 512, 2048, 65536
#: By how much a product of directions may be off, in units of the last digit.
SLACK = 1e-4


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores in units of the last digit, as F.round has them (halves of the decimal form away from zero); NaN is above all."""
    with np.errstate(all="ignore"):
        units = np.abs(scores) * UNITS
        whole = np.copysign(np.floor(units + 0.5), scores)
        halves = np.flatnonzero(np.abs(units - np.floor(units) - 0.5) < 1e-6)
    kinds, which = np.unique(scores[halves], return_inverse=True)
    whole[halves] = np.array([float(Decimal(repr(x)).scaleb(DIGITS).quantize(Decimal(1), ROUND_HALF_UP)) for x in kinds.tolist()])[which]
    return np.where(np.isnan(scores), np.inf, whole + 0.0)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of each row of a with that of b, summed in the order of components."""
    out = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for i in range(a.shape[1]):
            out += a[:, i] * b[:, i]
    return out


@dataclass
class Side:
    """Vectors of one dimension. Lengths of 0 and those too large, small or not finite have no direction (zeros); the latter are odd."""

    rows: np.ndarray
    holes: np.ndarray  # a component is null: all scores are 0
    norms: np.ndarray
    unit: np.ndarray
    odd: np.ndarray

    @staticmethod
    def of(rows: np.ndarray, holes: np.ndarray) -> Side:
        rows[holes] = 0.0
        norms = np.sqrt(dots(rows, rows))
        plain = (norms > 1e-100) & (norms < 1e100)
        unit = np.zeros_like(rows)
        np.divide(rows, norms[:, None], out=unit, where=plain[:, None])
        return Side(rows, holes, norms, unit, ~plain & (norms != 0))

    def __len__(self) -> int:
        return len(self.rows)

    def part(self, start: int, size: int) -> Side:
        own = slice(start, start + size)
        return Side(self.rows[own], self.holes[own], self.norms[own], self.unit[own], self.odd[own])

    def cosine(self, own: np.ndarray, other: Side, met: np.ndarray) -> np.ndarray:
        """The exact score of each own[i] with the other side's met[i]."""
        out = np.zeros(len(own))
        for a in range(0, len(own), SINGLY):
            x, y = own[a : a + SINGLY], met[a : a + SINGLY]
            with np.errstate(all="ignore"):
                norms = self.norms[x] * other.norms[y]
                told = ((norms > 0) | np.isnan(norms)) & ~self.holes[x] & ~other.holes[y]
                out[a : a + SINGLY] = np.where(told, dots(self.rows[x], other.rows[y]) / norms, 0.0)
        return out


def by_dimension(vectors: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, Side]]:
    """Dimension -> which of the vectors have it, and they themselves; a null vector has none."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    flat, starts = vectors.flatten(), np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    values, null = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    found = {}
    for dim in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        places = starts[at, None] + np.arange(dim)
        found[dim] = at, Side.of(values[places].astype(np.float64), null[places].any(axis=1))
    return found


class Best:
    """The k best hits of a few queries among the vectors met so far: higher scores first, then smaller ids."""

    def __init__(self, asked: Side, k: int):
        self.asked, self.k = asked, k
        self.of, self.units, self.ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.least, self.last = np.full(len(asked), -np.inf), np.full(len(asked), np.iinfo(np.int64).max)  # of the k-th hit

    def meet(self, vectors: Side, ids: np.ndarray) -> None:
        scores = self.asked.unit @ vectors.unit.T
        for q in np.flatnonzero(self.asked.odd):
            scores[q] = self.asked.cosine(np.full(len(vectors), q), vectors, np.arange(len(vectors)))
        for v in np.flatnonzero(vectors.odd):
            scores[:, v] = self.asked.cosine(np.arange(len(self.asked)), vectors, np.full(len(self.asked), v))
        least = self.least / UNITS
        if self.k < len(vectors) and np.isneginf(least).any():
            least = np.maximum(least, -np.partition(-np.where(np.isnan(scores), np.inf, scores), self.k - 1, axis=1)[:, self.k - 1])
        # a score that is rounded to the k-th one is less than a unit below it
        q, v = np.nonzero(~(scores < (least - 1.1 / UNITS)[:, None]))
        if not len(q):
            return
        near = scores[q, v]
        units = np.abs(near) * UNITS
        with np.errstate(all="ignore"):
            unsure = np.flatnonzero(~(np.abs(units - np.floor(units) - 0.5) > SLACK))
        near[unsure] = self.asked.cosine(q[unsure], vectors, v[unsure])
        units, found = rounded(near), ids[v]
        good = (units > self.least[q]) | ((units == self.least[q]) & (found < self.last[q]))
        if good.any():
            self._enter(q[good], units[good], found[good])

    def _enter(self, of: np.ndarray, units: np.ndarray, ids: np.ndarray) -> None:
        of, units, ids = np.concatenate([self.of, of]), np.concatenate([self.units, units]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -units, of))
        of, units, ids = of[order], units[order], ids[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        full, kept = place == self.k - 1, place < self.k
        self.least[of[full]], self.last[of[full]] = units[full], ids[full]
        self.of, self.units, self.ids = of[kept], units[kept], ids[kept]


class Search:
    """The k best vectors of each query (query_id, query), however many batches of vectors come."""

    def __init__(self, queries: pa.Table | pa.RecordBatch, k: int):
        self.query_ids = queries.column("query_id")
        self.best = {dim: [(at[a : a + QUERIES], Best(side.part(a, QUERIES), k)) for a in range(0, len(side), QUERIES)] for dim, (at, side) in by_dimension(queries.column("query")).items()}

    def meet(self, vectors: pa.Table | pa.RecordBatch) -> None:
        ids = np.asarray(vectors.column("chunk_id"))
        for dim, (at, side) in by_dimension(vectors.column("embedding")).items():
            for a in range(0, len(side), VECTORS):
                part, own = side.part(a, VECTORS), ids[at[a : a + VECTORS]]
                for _, best in self.best.get(dim, []):
                    best.meet(part, own)

    def hits(self) -> pa.Table:
        """query_id, chunk_id, score."""
        found = [(at[b.of], b.ids, b.units) for own in self.best.values() for at, b in own]
        of, ids, units = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *found))
        scores = np.where(np.isinf(units), np.nan, units / UNITS)
        return pa.table([self.query_ids.take(pa.array(of)), pa.array(ids), pa.array(scores)], ["query_id", "chunk_id", "score"])
