"""Whitening of vectors by shifted CholeskyQR.

The rows are centred and orthogonalised without ever forming the covariance's
eigenvectors from it: each pass over the rows solves them through the
triangular factors found so far, sums the Gram matrix of the result (every
task its own, Spark the tasks'), and the driver takes one more Cholesky
factor of it.  The first pass shifts the Gram matrix, so that the factor
exists however ill-conditioned the rows are; later passes correct what the
shift left, and shift again only where rows have no full rank.  The product R
of the factors satisfies R'R = A'A for the centred rows A, to the precision of
A and not of its square; the singular value decomposition of R gives the
components and their eigenvalues.

Entries c are taken as long x = floor(1024 * c) + 100000, so sums are exact.

Scale: a pass reads the stored rows once, in Arrow batches; a task hands on one
matrix of dims x dims numbers, summed in two steps.  The driver holds such
matrices only; their size is checked (``MAX_DIMS``).

Defined results: a vector that is null or empty, or holds null or non-finite
entries (or entries of 2^40 and beyond, which a long cannot hold exactly here)
is dropped.  Of vectors of several lengths those of the most frequent length
stay (of equally frequent ones the longest).  Rows with null or repeated ids
are rows of their own.  Components without variance (eigenvalue zero to
working precision) are left out, so fewer than ``k`` may come; rows without any
variance, a single row and an empty table give an empty result.  A deviation
beyond a long is null.  Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.workers import ship_with_tasks
from casekit.llm.common import store

ship_with_tasks(__name__)

SCALE, OFFSET = 1024, 100_000
LIMIT = float(1 << 40)
MAX_DIMS = 4096
PASSES = 6            # at most; three are enough for rows of full rank
ORTHOGONAL = 1e-10    # largest entry of Q'Q - I at which the passes end
RANK = 1e-11          # singular values below this share of the largest one are zero
_LOW = 20             # bits of the lower half in which long sums are kept
_FAN = 64             # partial matrices summed together first


def fit_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the rows that remain, entries as longs."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    fits = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(LIMIT)))  # NaN is above all
    return rows.filter(F.col("v").isNotNull() & fits).select(
        "id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(OFFSET)).alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dims)


def solve_upper(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangular ``r``, by substitution."""
    q = np.empty_like(rows.T)  # one contiguous line per dimension
    for j in range(len(r)):
        q[j] = (rows[:, j] - r[:j, j] @ q[:j]) / r[j, j]
    return q.T


def factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """An upper Cholesky factor of the Gram matrix of ``n`` rows, shifted by
    its rounding error in the first pass, and wherever it has no factor."""
    dims = len(gram)
    unit = 2.0 ** -53
    shift = 11 * (min(n, 1 << 20) * dims + dims * (dims + 1)) * unit * np.linalg.norm(gram, 2)
    if not first:
        try:
            low = np.linalg.cholesky(gram)
            if np.diag(low).min() ** 2 > shift:
                return low.T
        except np.linalg.LinAlgError:
            pass
    return np.linalg.cholesky(gram + shift * np.eye(dims)).T


def _sum_parts(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum(np.stack(rows["sums"].to_list()), axis=0)
    return pd.DataFrame({"i": rows["i"].iloc[:1], "sums": [total]})


def _summed(rows: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], dtype: type = np.float64) -> np.ndarray:
    """The sum over all rows of a matrix that ``of`` makes of each batch."""
    kind = "long" if dtype is np.int64 else "double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch, dims))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(list(total.astype(dtype)), pa.list_(pa.from_numpy_dtype(dtype)))],
                ["i", "sums"])

    parts = rows.select("x").mapInArrow(work, f"i int, sums array<{kind}>")
    parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_FAN)))
    schema = f"i int, sums array<{kind}>"
    some = parts.groupBy("i", "part").applyInPandas(lambda rows: _sum_parts(rows), schema)
    lines = some.groupBy("i").applyInPandas(lambda rows: _sum_parts(rows), schema).collect()  # dims rows
    return np.array([r.sums for r in sorted(lines, key=lambda r: r.i)], dtype)


@dataclass
class Whitening:
    """What was fitted: components as rows, by falling eigenvalue."""
    n: int
    sums: list[int]             # per dimension, exact
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray       # share of the whole variance
    identity_error: float

    @property
    def dims(self) -> int:
        return len(self.sums)


def _whole_and_rest(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Means as whole numbers and rests below ``n``."""
    both = [divmod(s, n) for s in sums]
    return np.array([q for q, _ in both], np.int64), np.array([r for _, r in both], np.int64)


def _centred(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - whole).astype(np.float64) - rest / n


def _projector(w: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    whole, rest = _whole_and_rest(w.n, w.sums)
    turn = w.components.T / np.sqrt(w.eigenvalues)
    return lambda x: _centred(x, w.n, whole, rest) @ turn


def fit(rows: DataFrame, k: int = 8) -> Whitening | None:
    """Components of the rows of :func:`fit_rows` (stored, of one length);
    None where nothing varies."""
    dims = rows.select(F.size("x").alias("d")).limit(1).collect()
    if not dims:
        return None
    dims = dims[0].d
    if dims > MAX_DIMS:
        raise ValueError(f"{dims} dimensions; matrices of at most {MAX_DIMS} squared are held")
    halves = _summed(rows, dims, lambda x: np.stack([(x >> _LOW).sum(axis=0), (x & ((1 << _LOW) - 1)).sum(axis=0),
                                                     np.full(dims, len(x))]), np.int64)
    n = int(halves[2, 0])
    sums = [(int(hi) << _LOW) + int(lo) for hi, lo in zip(halves[0], halves[1], strict=True)]
    whole, rest = _whole_and_rest(n, sums)

    factors: list[np.ndarray] = []
    trace = 0.0
    for turn in range(PASSES):
        def gram(x: np.ndarray, factors: list[np.ndarray] = factors) -> np.ndarray:
            q = _centred(x, n, whole, rest)
            for r in factors:
                q = solve_upper(q, r)
            return q.T @ q

        g = _summed(rows, dims, gram)
        if turn == 0:
            trace = float(np.trace(g))
            if trace == 0:
                return None
        elif np.abs(g - np.eye(dims)).max() <= ORTHOGONAL:
            break
        factors = [*factors, factor(g, n, turn == 0)]
    r = factors[0]
    for f in factors[1:]:
        r = f @ r
    _, sigma, components = np.linalg.svd(r)
    keep = min(k, int((sigma > RANK * sigma[0]).sum()))
    e = sigma[:keep] ** 2 / n
    w = Whitening(n, sums, components[:keep], e, e / (trace / n), 0.0)
    project = _projector(w)

    def second(x: np.ndarray) -> np.ndarray:
        y = project(x)
        return np.vstack([y.T @ y, y.sum(axis=0)])

    got = _summed(rows, dims, second)
    mean = got[-1] / n
    w.identity_error = float(np.abs(got[:-1] / n - np.outer(mean, mean) - np.eye(keep)).max())
    return w


def apply(rows: DataFrame, w: Whitening) -> DataFrame:
    """(id, deviation, whitened): rows projected on the components, to variance
    one; ``deviation`` is the exact sum over dimensions of (n x - sum)^2."""
    whole, rest = _whole_and_rest(w.n, w.sums)
    project, n, dims = _projector(w), w.n, w.dims

    def deviation(x: np.ndarray) -> list[int | None]:
        away = x - whole
        top = (int(np.abs(away).max()) + 1) * n
        if dims * top * top < 1 << 63:
            return (((away * n - rest) ** 2).sum(axis=1)).tolist()
        exact = [sum((a * n - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in away.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, dims)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(deviation(x), pa.int64()), pa.array(list(project(x)), pa.list_(pa.float64()))],
                    ["id", "deviation", "whitened"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(work, schema)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8) -> tuple[DataFrame, Whitening | None]:
    """The whitened rows (:func:`apply`; empty without any variance) and what
    was fitted on all of them."""
    rows = store(fit_rows(vectors, id_col, vector_col), "whiten-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if len(lengths) > 1:
        rows = rows.filter(F.size("x") == lengths[0].d)
    w = fit(rows, k)
    if w is None:
        return rows.limit(0).select("id", F.lit(None).cast("long").alias("deviation"),
                                    F.array().cast("array<double>").alias("whitened")), None
    return apply(rows, w), w


def components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one
    row per row and component."""
    rows, w = whiten(vectors, id_col, vector_col, k)
    explained = F.array(*[F.lit(float(x)) for x in w.explained]) if w else F.array().cast("array<double>")
    return rows.select("id", "deviation", F.posexplode("whitened").alias("pos", "whitened")).select(
        "id", (F.col("pos") + 1).alias("component"), F.lit(w.n if w else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("pos")).alias("explained"), F.lit(w.identity_error if w else 0.0).alias("identity_error"))
