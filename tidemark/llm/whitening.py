"""Whitening of embeddings from a weighted covariance over distinct vectors.

Vectors are snapped to a grid of whole numbers, x = floor(scale * entry) + shift.
Identical x are one distinct vector with its multiplicity; the fit weighs it by
that count or by one. Steps:

1. Rows get the digest of their x; distinct vectors are grouped by it, counts first
   summed where the rows are read, and written.
2. The weight W and the exact weighted sums S of each dimension.
3. The weighted covariance: each task centres its vectors by S / W and adds
   w * (x - S/W)^T (x - S/W) as one matrix product a batch; only upper triangles
   leave the tasks and are summed by row. Centring loses nothing: with
   S = q*W + r the numbers x - q are whole and r/W is one rounding.
4. Its eigenvectors, on the driver: one matrix of dimensions squared.
5. Each distinct vector is whitened once; the whitened vectors' own weighted
   covariance, by the same products, tells the error against the identity.
6. The results are joined back to the rows by digest, those of hot vectors by broadcast.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are
dropped; so are vectors whose length is not the commonest among the rest (of equally
common ones the largest), empty vectors among them. Entries beyond the range of
the grid (64-bit) are clipped to it. Components whose eigenvalue is no more than
1e-12 of the largest can't be told from rounding and have no rows: equal vectors
only, or one vector, give none; so does an empty table. A deviation beyond 64 bits
is null. Repeated rows and null ids are rows like others; other columns are left out,
whatever their names. A component's largest entry is positive (ties: the first), so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.lineage import hot_bound, join_groups, written

#: Clipped entries are apart by less than 64 bits.
_LIMIT = 1 << 61


def grid_rows(rows: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, key, x) of the rows with a finite vector of the commonest length; key is a digest of x."""
    c = F.col("v")
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    finite = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(c.isNotNull() & ~bad & (F.size(c) > 0))
    length = finite.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    whole = lambda e: F.floor(F.least(F.greatest(e * scale, F.lit(float(-_LIMIT))), F.lit(float(_LIMIT)))).cast("long") + F.lit(shift).cast("long")
    x = finite.where(F.size("v") == (length.d if length else 0)).select("id", F.transform("v", whole).alias("x"))
    return x.select("id", F.unhex(F.sha2(F.array_join("x", ",").cast("binary"), 256)).alias("key"), "x")


def distinct_vectors(rows: DataFrame, weight: str) -> DataFrame:
    """(key, x, copies, w) of each distinct vector."""
    found = rows.groupBy("key").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("copies"))
    return written(found.withColumn("w", F.col("copies") if weight == "count" else F.lit(1).cast("long")), "vectors")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, -1)


def _whole(v: int) -> Decimal:
    return Decimal(int(v))


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The weight W and each dimension's weighted sum, as whole numbers of any size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            x, w = _matrix(b.column("x"), b.num_rows), b.column("w").to_numpy()
            weight += sum(w.tolist())
            # Products and sums that 64 bits might not hold are formed as Python's whole numbers.
            safe = float(np.abs(x.astype(np.float64)).max()) * float(w.max()) * len(x) < 2**62
            part = (x * w[:, None]).sum(axis=0) if safe else (x.astype(object) * w.astype(object)[:, None]).sum(axis=0)
            total = part.astype(object) if total is None else total + part.astype(object)
        if total is not None:
            sums = [weight, *total.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([_whole(v) for v in sums], pa.decimal128(38, 0))], names=["dim", "sum"])

    got = vectors.select("x", "w").mapInArrow(add, "dim int, sum decimal(38,0)").groupBy("dim").agg(F.sum("sum").alias("sum")).orderBy("dim").collect()
    return (int(got[0]["sum"]), [int(r["sum"]) for r in got[1:]]) if got else (0, [])


class Centring:
    """x - S/W of whole numbers, with one rounding."""

    def __init__(self, weight: int, sums: list[int]):
        self.weight = weight
        self.whole = [s // weight for s in sums]
        self.rest = [s % weight for s in sums]

    def differences(self, x: np.ndarray) -> np.ndarray:
        """x - floor(S/W), exact if it is below 2**53."""
        low = np.array(self.whole, dtype=np.int64)
        return x - low

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.differences(x).astype(np.float64) - np.array([r / self.weight for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (W*x - S)**2; None beyond 64 bits."""
        d, n = self.differences(x), self.weight
        most = (float(np.abs(d.astype(np.float64)).max(initial=0)) + 1) * n
        if most**2 * x.shape[1] < 2**62:
            scaled = d * n - np.array(self.rest, dtype=np.int64)
            return (scaled * scaled).sum(axis=1).tolist()
        out = [sum((v * n - r) ** 2 for v, r in zip(row, self.rest)) for row in d.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def weighted_products(vectors: DataFrame, column: str, centre) -> np.ndarray | None:
    """The sum of w * centre(v)^T centre(v) over all vectors of a column: one matrix product a batch, upper triangles summed by row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                c = centre(_matrix(b.column(column), b.num_rows))
                total = total + (c * b.column("w").to_numpy().astype(np.float64)[:, None]).T @ c
        if not np.isscalar(total):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    got = vectors.select(column, "w").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if not len(got):
        return None
    out = np.zeros((got.i.max() + 1,) * 2)
    out[got.i, got.j] = out[got.j, got.i] = got.v
    return out


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors as columns by falling eigenvalue, and the eigenvalues, without those lost in rounding."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    n = min(components, int((values > 1e-12 * max(values[0], 0)).sum()))
    values, vectors = values[:n], vectors[:, :n]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(n)]
    return vectors * np.where(largest < 0, -1.0, 1.0), values


def whiten_embeddings(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 16, weight: str = "one") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component.

    `weight` is "one" (each distinct vector once) or "count" (as often as it occurs);
    n is the fit's whole weight.
    """
    if weight not in ("one", "count"):
        raise ValueError("weight is 'one' or 'count'")
    schema = "key binary, copies long, w long, deviation long, white array<double>"
    placed = grid_rows(rows, id_col, vector_col, scale, shift)
    keyed = written(placed, "grid")
    vectors = distinct_vectors(keyed, weight)
    total, sums = exact_sums(vectors)
    centring = Centring(total, sums) if total else None
    products = weighted_products(vectors, "x", centring) if total else None
    covariance = products / total if total else np.zeros((1, 1))
    axes, values = principal(covariance, components)
    projection, share = axes / np.sqrt(values), values / (np.trace(covariance) or 1.0)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(values):
                x = _matrix(b.column("x"), b.num_rows)
                white = centring(x) @ projection
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(values))
                lists = pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("copies"), b.column("w"), pa.array(centring.deviations(x), pa.int64()), lists], names=["key", "copies", "w", "deviation", "white"])

    white = written(vectors.mapInArrow(whiten, schema), "whitened")
    error = 0.0
    if len(values):
        mean = weighted_mean(white, len(values), total)
        error = float(np.abs(weighted_products(white, "white", lambda v: v - mean) / total - np.eye(len(values))).max())
    joined = join_groups(keyed.select("id", "key"), white.drop("w"), ["key"], "copies", hot_bound(keyed.count()))
    shares = F.array(*map(F.lit, share.tolist())) if len(values) else F.array().cast("array<double>")
    flat = joined.select("id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return flat.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(total).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def weighted_mean(white: DataFrame, d: int, total: int) -> np.ndarray:
    """The weighted mean of whitened vectors; zero but for rounding."""
    got = white.agg(*(F.sum(F.col("white")[k] * F.col("w")).alias(f"m{k}") for k in range(d))).first()
    return np.array([got[k] for k in range(d)]) / total
