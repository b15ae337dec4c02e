"""Embedding whitening: distributed covariance, leading eigenvectors, projection."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import batch_of, bounded_batches
from recallgrid.sources.storage import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues below this share of the trace are rounding: such a direction has no variance to scale.
FLAT = 1e-12
#: Eigenvalues closer than this share of the matrix norm count as one cluster.
CLUSTER = 1e-3
#: Entries beyond this after scaling do not fit; such a vector takes no part.
LARGEST = 2.0**52


# -- leading eigenpairs of a symmetric matrix, on the driver: its size is the dimension ---------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder: diagonal, off-diagonal, and the unit reflectors that took the matrix there."""
    a, n = matrix.astype(np.float64).copy(), len(matrix)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        x[0] += size if x[0] >= 0 else -size
        length = np.linalg.norm(x)
        v = x / length if length > 0 else np.zeros_like(x)
        reflectors.append(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def turned_back(vectors: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    """Eigenvectors (columns) of the matrix from those of its tridiagonal form."""
    out = vectors.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    return out


def below(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each point."""
    least = np.finfo(float).tiny * 4 + np.finfo(float).eps * (np.abs(beside).max(initial=0.0) + 1e-300)
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], beside, strict=True):
        q = np.where(np.abs(q) < least, -least, q)
        q = d - at - e * e / q
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection on Sturm counts."""
    n = len(diagonal)
    around = np.concatenate([[0.0], np.abs(beside), [0.0]])
    radius = around[:-1] + around[1:]
    spread = max(float(np.abs(diagonal).max() + radius.max()), 1e-300)
    low = np.full(k, (diagonal - radius).min() - 1e-9 * spread)
    high = np.full(k, (diagonal + radius).max() + 1e-9 * spread)
    rank = n - 1 - np.arange(k)
    for _ in range(200):
        middle = (low + high) / 2
        under = below(diagonal, beside, middle) <= rank
        low, high = np.where(under, middle, low), np.where(under, high, middle)
        if (high - low).max() <= 2 * np.finfo(float).eps * spread:
            break
    return (low + high) / 2


def _solved(diagonal: np.ndarray, beside: np.ndarray, value: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - value I) x = right by elimination with row exchanges."""
    n = len(diagonal)
    rows = [[0.0, 0.0, 0.0] for _ in range(n)]
    d, e, b = (diagonal - value).tolist(), beside.tolist() + [0.0], right.tolist()
    now = [d[0], e[0], 0.0]
    for i in range(n - 1):
        under = [e[i], d[i + 1], e[i + 1]]
        if abs(under[0]) > abs(now[0]):
            now, under = under, now
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(now[0]) < least:
            now[0] = least
        share = under[0] / now[0]
        rows[i] = now
        now = [under[1] - share * now[1], under[2] - share * now[2], 0.0]
        b[i + 1] -= share * b[i]
    if abs(now[0]) < least:
        now[0] = least
    rows[-1] = now
    x = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        x[i] = (b[i] - rows[i][1] * x[i + 1] - rows[i][2] * x[i + 2]) / rows[i][0]
        if abs(x[i]) > 1e150:
            x = [y * 1e-150 for y in x]
            b = [y * 1e-150 for y in b]
    return np.array(x[:n])


def vectors_of(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvectors (columns) of falling eigenvalues by inverse iteration.

    Each step is made orthogonal to the earlier vectors of the same cluster,
    so equal eigenvalues get different vectors.
    """
    norm = float(np.abs(diagonal).max() + 2 * np.abs(beside).max(initial=0.0)) or 1.0
    least = np.finfo(float).eps * norm
    rng = np.random.default_rng(7)
    out, first, shifted = np.zeros((len(diagonal), len(values))), 0, np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * norm:
            first = i
        # Within a cluster the shifts are kept apart, or the solves would all be the same.
        shifted = min(float(value), shifted - 10 * least) if i > first else float(value)
        x = rng.standard_normal(len(diagonal))
        for _ in range(6):
            for _ in range(2):
                x -= out[:, first:i] @ (out[:, first:i].T @ x)
            x /= np.linalg.norm(x)
            x = _solved(diagonal, beside, shifted, x, least)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= out[:, first:i] @ (out[:, first:i].T @ x)
        out[:, i] = x / np.linalg.norm(x)
    return out


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns, largest entry positive."""
    scale = float(np.abs(matrix).max()) or 1.0
    diagonal, beside, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, beside, min(k, len(diagonal)))
    vectors = turned_back(vectors_of(diagonal, beside, values), reflectors)
    top = np.abs(vectors).argmax(0)
    return values * scale, vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


# -- rows -------------------------------------------------------------------------------------

_PACKED = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("x", pa.binary())])
_WIDTHS = (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63))


def packed(x: np.ndarray) -> bytes:
    """Scaled entries without the shift, in the narrowest width that holds them all; equal vectors give equal bytes."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(next(w for w, limit in _WIDTHS if most < limit)).tobytes()


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    """Scaled entries without the shift, one row each, as int64."""
    out = np.empty((len(rows), dims), np.int64)
    for i, row in enumerate(rows):
        out[i] = np.frombuffer(row, f"<i{len(row) // dims}")
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from recallgrid.llm import whitening

    for batch in batches:
        rows = []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not vector.is_valid or vector.values.null_count:
                continue
            x = np.floor(vector.values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            if len(x) and np.isfinite(x).all() and np.abs(x).max() <= LARGEST:
                rows.append((vec_id, len(x), whitening.packed(x.astype(np.int64))))
        if rows:
            yield batch_of(whitening._PACKED, zip(*rows, strict=True))


def _groups(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if len(batch):
            yield batch, unpacked(batch.column(batch.schema.get_field_index("x")).to_pylist(), dims)


def _sums(dims: int):
    schema = pa.schema([("i", pa.int32()), ("n", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from recallgrid.llm import whitening

        n, total = 0, [0] * dims
        for _, x in whitening._groups(batches, dims):
            n += len(x)
            # LARGEST and the size of a batch keep a batch's sums within int64 only in halves.
            low, high = (x & 0xFFFFFFFF).sum(0).tolist(), (x >> 32).sum(0).tolist()
            total = [t + b + (a << 32) for t, a, b in zip(total, high, low, strict=True)]
        if n:
            yield batch_of(schema, [range(dims), [n] * dims, list(map(str, total))])

    return run


class Frame:
    """Number and exact sums of the fit list, and the directions to project on (as they are, without any)."""

    def __init__(self, n: int, sums: list[int], directions: np.ndarray | None = None):
        self.n, self.sums = n, sums
        # The mean as a whole number and a rest below one: entries lose the first exactly.
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([float(Fraction(s % n, n)) for s in sums])
        self.directions = directions

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def projected(self, x: np.ndarray) -> np.ndarray:
        y = self.centred(x)
        return y if self.directions is None else y @ self.directions

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it does not fit a long."""
        apart, rest = x - self.whole, np.array([s % self.n for s in self.sums], np.int64)
        widest = (int(np.abs(apart).max()) + 1) * self.n
        if widest * widest * x.shape[1] < 1 << 62:
            off = apart * self.n - rest
            return (off * off).sum(1).tolist()
        off = apart.astype(object) * self.n - rest.astype(object)
        return [int(d) if d < 1 << 63 else None for d in (off * off).sum(1)]


def _products(sent, dims: int):
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from recallgrid.llm import whitening

        frame, total = sent.value, None
        for _, x in whitening._groups(batches, dims):
            y = frame.projected(x)
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            for at in range(0, len(i), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield batch_of(schema, [i[part].astype(np.int32), j[part].astype(np.int32), total[i[part], j[part]]])

    return run


def covariance(fit: DataFrame, frame: Frame, dims: int) -> np.ndarray:
    """Covariance of the projected fit list, centred before multiplying, with divisor n.

    Each task hands on one sum for each pair of dimensions; the grouped totals
    that reach the driver are as many as the matrix has entries.
    """
    sent = fit.sparkSession.sparkContext.broadcast(frame)
    parts = fit.mapInArrow(_products(sent, dims), "i int, j int, value double")
    rows = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    i, j, value = (rows.column(c).to_numpy() for c in ("i", "j", "value"))
    sent.destroy()
    out = np.zeros((int(j.max()) + 1,) * 2)
    out[i, j] = out[j, i] = value / frame.n
    return out


_WHITE = "vec_id long, n long, deviation long, whitened array<double>"


def _project(sent, dims: int):
    schema = pa.schema(
        [("vec_id", pa.int64()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from recallgrid.llm import whitening

        frame = sent.value
        for batch, x in whitening._groups(batches, dims):
            yield batch_of(schema, [batch.column(0), [frame.n] * len(x), frame.deviations(x), list(frame.projected(x))])

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each vector on the leading components of all of them, scaled to unit variance.

    vectors: vec_id long, embedding array<float> or array<double>; other
    columns are not read. An entry c counts as x = floor(64 c) + 1000000. The
    components are the leading unit eigenvectors of the covariance of the
    different x-vectors. Returns vec_id, n (how many those are), deviation
    (sum over dimensions of (n x - S)^2, exact; null beyond a long), whitened
    (array, largest eigenvalue first), explained (array, eigenvalue over
    trace) and identity_error (largest entry of the covariance of `whitened`
    over the fit list minus the identity, measured by a pass of its own).

    The different vectors are found by a grouping on their packed entries,
    pre-aggregated, so copies of one vector do not pile up. Sums and products
    are added up in the tasks; the driver holds one matrix of the dimension
    and reduces it by Householder reflections, bisection on Sturm counts and
    inverse iteration with reorthogonalisation in clusters.

    Vectors that are null or empty, hold a null or non-finite entry, or one
    beyond 2^52 after scaling take no part, nor do those of another length
    than the commonest (of equally common ones the greater). Null vec_id: its
    row is kept. Repeated rows: one row each. Directions without variance
    (share of the trace below 1e-12) are no components; without any, as with
    one distinct vector, `whitened` is empty. Empty table: no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stored(rows.mapInArrow(_pack, "vec_id long, dims int, x binary"), "packed")
    commonest = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if commonest is None:
        empty = ", ".join([_WHITE, "explained array<double>", "identity_error double"])
        return spark.createDataFrame([], empty)
    dims = commonest["dims"]
    rows = rows.filter(F.col("dims") == dims)
    fit = stored(rows.select("x").distinct(), "fit")
    sums = fit.mapInArrow(_sums(dims), "i int, n long, value string")
    sums = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found = sorted(sums.collect())
    frame = Frame(found[0]["n"], [int(r["value"]) for r in found])
    matrix = covariance(fit, frame, dims)
    trace = float(np.trace(matrix))
    values, directions = leading_pairs(matrix, components)
    told = int((values > max(FLAT * trace, 0.0)).sum()) if trace > 0 else 0
    values, directions = values[:told], directions[:, :told]
    frame.directions = directions / np.sqrt(values)
    error = float(np.abs(covariance(fit, frame, dims) - np.eye(told)).max()) if told else 0.0
    sent = spark.sparkContext.broadcast(frame)
    out = rows.select("vec_id", "x").mapInArrow(_project(sent, dims), _WHITE)
    share = F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>")
    return out.withColumns({"explained": share, "identity_error": F.lit(error)})


def whitened_rows(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component, numbered from 1."""
    out = whitened(vectors, components)
    each = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(components)), "whitened", "explained")).alias("of")
    long = out.filter(F.size("whitened") > 0).select("vec_id", "n", "deviation", "identity_error", each)
    return long.select(
        "vec_id",
        F.col("of")["0"].alias("component"),
        "n",
        "deviation",
        F.col("of")["whitened"].alias("whitened"),
        F.col("of")["explained"].alias("explained"),
        "identity_error",
    ).filter("whitened is not null")
