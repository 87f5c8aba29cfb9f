"""An exact, pruned nearest-neighbour index kept as a table.

Build: centroids are fitted on a bounded sample (``SAMPLE_ROWS`` vectors, those
of the smallest hashes); *every* corpus row is assigned to its nearest
centroid by Spark and written with its cell and its distance to the
centroid, one folder per cell.  A cell's radius is the largest such distance.

Search, exact for every query by the triangle inequality:

1. Each query is scored against the rows of its nearest cells, as many as it
   takes to hold ``k`` candidates.  The k-th best distance found bounds the
   answer from above.
2. A cell whose centroid is further away than the bound plus its radius
   cannot hold a better row and is left out for the query; all others are scored.
3. The best of what the second step finds are ranked.

No candidate is capped: a query that nothing can be left out for is scored
against the whole corpus.  In the first step (query, cell) pairs are dealt as in
:mod:`casekit.operators.vectors`: large cells in shards of about
``ROWS_PER_SHARD`` rows and a cell's queries in blocks, so that a cell or a
region of queries holding a third of all rows is split.  In the second,
queries of neighbouring first cells make blocks of about ``QUERIES_PER_BLOCK``
and a corpus row goes once to each block with a query that needs its cell; there
the cell is scored for the queries that need it, or for all if most do.  So
rows moved grow with blocks, not with pairs, also where nothing can be left out.

What the driver holds is bounded: the sample, ``MAX_CELLS`` centroids (also
broadcast) and one row per cell.

Defined results: null vectors, empty ones and those with null, NaN or infinite
entries (for cosine also zero vectors) are neither indexed nor searched for; corpus vectors of another length
than the most frequent one raise.  Ties are broken by the item columns.  An
empty corpus gives an index without cells and no results.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.workers import ship_with_tasks
from casekit.operators.vectors import _BLOCK_NUMBERS, QUERIES_PER_BLOCK, best_of_cells, check_search, finite, numbers, search_cells
from casekit.session import checkpoint_dir

ship_with_tasks(__name__)

SAMPLE_ROWS = 20_000
MAX_CELLS = 4096
ROWS_PER_SHARD = 1 << 16
ROUNDS = 8
SEED = 11


@dataclass
class VectorIndex:
    """``rows``: (__cell, __shard, *items, __v, __far); ``cells``: one row per
    cell that holds rows, with its number of rows, shards and radius."""
    rows: DataFrame
    items: list[str]
    metric: str
    centroids: np.ndarray
    cells: pd.DataFrame


def _vector(vec: str, metric: str) -> Column:
    """The vector as doubles, of length one for cosine; null where it has no place
    (not finite, or without direction)."""
    v = F.col(vec).cast("array<double>")
    good = (F.size(v) > 0) & finite(v)
    v = F.when(v.isNotNull() & good, v)
    if metric == "l2":
        return v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Euclidean distances (rows x centroids), exact to :func:`_slack`."""
    squares = (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T)
    return np.sqrt(np.maximum(squares, 0))


def _slack(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """What cancellation can take from each row's distances."""
    scale = np.linalg.norm(x, axis=1) + np.linalg.norm(centroids, axis=1).max()
    return np.sqrt(8 * x.shape[1] * np.finfo(float).eps) * scale[:, None]


def _fit(sample: np.ndarray, n_cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids of the sample by a few rounds of k-means; far points start cells."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.integers(len(sample))][None]
    near = _distances(sample, centroids)[:, 0]
    while len(centroids) < n_cells and near.max() > 0:
        share = near ** 2 / (near ** 2).sum()
        new = sample[rng.choice(len(sample), min(len(centroids), n_cells - len(centroids)), p=share)]
        centroids = np.concatenate((centroids, new))
        near = np.minimum(near, _distances(sample, new).min(axis=1))
    centroids = np.unique(centroids, axis=0)
    for _ in range(rounds):
        of = _distances(sample, centroids).argmin(axis=1)
        n = np.bincount(of, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, sample)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def build_index(corpus: DataFrame, item_cols: list[str] | str = "item_id", item_vec: str = "vector", metric: str = "l2",
                n_cells: int | None = None, sample_rows: int = SAMPLE_ROWS, path: str | None = None) -> VectorIndex:
    """Index every row of ``corpus`` for ``l2`` or ``cosine`` search; the table
    goes to ``path`` (default: a new folder under ``spark.checkpoint.dir``).
    ``n_cells`` defaults to the square root of the number of rows."""
    if metric not in ("l2", "cosine"):
        raise ValueError("an index needs a distance: metric must be l2 or cosine")
    spark = corpus.sparkSession
    items = [item_cols] if isinstance(item_cols, str) else list(item_cols)
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/vector-index-{uuid.uuid4().hex}"
    rows = corpus.select(*items, _vector(item_vec, metric).alias("__v")).filter(F.col("__v").isNotNull())
    lengths = rows.groupBy(F.size("__v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(2).collect()
    if len(lengths) > 1:
        raise ValueError("corpus vectors differ in length")
    n = lengths[0].n if lengths else 0
    wanted = min(MAX_CELLS, n_cells or max(1, math.isqrt(n)))
    drawn = rows.select("__v", F.xxhash64(*items, "__v").alias("h")).orderBy("h").limit(sample_rows).toPandas()["__v"]
    centroids = _fit(np.stack(drawn.to_numpy()), wanted) if n else np.zeros((0, 0))
    held = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("struct<cell: int, far: double>")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy())
        of = _distances(x, held.value).argmin(axis=1)
        return pd.DataFrame({"cell": of.astype(np.int32), "far": np.linalg.norm(x - held.value[of], axis=1)})

    shards = max(1, -(-n // ROWS_PER_SHARD))
    at = rows.withColumn("__a", assign("__v")).select(
        *items, "__v", F.col("__a.cell").alias("__cell"), F.col("__a.far").alias("__far"),
        F.pmod(F.xxhash64(*items, "__v"), F.lit(shards)).cast("int").alias("__part"))
    # A cell's rows of one hash range are one file; no task holds a hot cell.
    at.repartition("__cell", "__part").drop("__part").write.partitionBy("__cell").parquet(path)
    return open_index(spark, path, items, metric, centroids) if n else VectorIndex(
        at.drop("__part"), items, metric, centroids, pd.DataFrame({"__cell": [], "n": [], "radius": []}))


def open_index(spark: SparkSession, path: str, items: list[str], metric: str, centroids: np.ndarray) -> VectorIndex:
    rows = spark.read.parquet(path)
    cells = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"), F.max("__far").alias("radius")).toPandas()
    return VectorIndex(rows, items, metric, centroids, cells.sort_values("__cell", ignore_index=True))


def _first_cells(index: VectorIndex, k: int):
    """For each query: its nearest cells, as many as hold ``k`` rows."""
    numbers_, sizes = index.cells["__cell"].to_numpy(np.int64), index.cells["n"].to_numpy(np.int64)
    centroids = index.centroids[numbers_]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q in batches:
            d = _distances(np.stack(q["__v"].to_numpy()), centroids)
            order = d.argsort(axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) < k).sum(axis=1) + 1  # cells needed
            q["__cells"] = [numbers_[o[:m]].astype(np.int32) for o, m in zip(order, enough, strict=True)]
            yield q
    return work


def _opens(index: VectorIndex):
    """(vectors, bounds) -> queries x cells: which can hold something better."""
    numbers_, radius = index.cells["__cell"].to_numpy(np.int64), index.cells["radius"].to_numpy(float)
    centroids = index.centroids[numbers_]

    def opens(x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return ~(_distances(x, centroids) - radius > bound[:, None] + _slack(x, centroids))
    return opens, numbers_


def _other_cells(index: VectorIndex):
    """For each query: the cells that can hold something better than its bound."""
    opens, numbers_ = _opens(index)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q in batches:
            open_ = opens(np.stack(q["__v"].to_numpy()), q["__bound"].fillna(np.inf).to_numpy(float))
            q["__cells"] = [np.setdiff1d(numbers_[o], c).astype(np.int32) for o, c in zip(open_, q["__cells"], strict=True)]
            yield q[["__q", "__v", "__cells"]]
    return work


def _block_cells(index: VectorIndex):
    """The cells that queries of a block need: (__b, __cell), once per batch."""
    opens, numbers_ = _opens(index)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q in batches:
            for block, rows in q.groupby("__b"):
                open_ = opens(np.stack(rows["__v"].to_numpy()), rows["__bound"].fillna(np.inf).to_numpy(float))
                yield pd.DataFrame({"__b": block, "__cell": numbers_[open_.any(axis=0)].astype(np.int32)})
    return work


def _skips(index: VectorIndex):
    """In a block: the queries that need a cell (bounds are squared there)."""
    opens, numbers_ = _opens(index)

    def skips(x: np.ndarray, bound: np.ndarray):
        step = max(1, 4_000_000 // len(numbers_))
        open_ = np.concatenate([opens(x[at:at + step], np.sqrt(bound[at:at + step])) for at in range(0, len(x), step)])
        at = {int(c): i for i, c in enumerate(numbers_)}
        return lambda cell: np.flatnonzero(open_[:, at[int(cell)]])
    return skips


def _score_others(index: VectorIndex, todo: DataFrame, schema: T.StructType, k: int, query_id: str, exclude_self: bool) -> DataFrame:
    """Score ``todo`` (__q, __v, __first, __bound) against all cells that are needed;
    rows of the first cells come again."""
    spark = todo.sparkSession
    asked = todo.groupBy("__first").agg(F.count(F.lit(1)).alias("n")).orderBy("__first").toPandas()  # one row per cell
    asked["before"] = asked["n"].cumsum() - asked["n"]
    per = max(1, min(QUERIES_PER_BLOCK, _BLOCK_NUMBERS // max(1, index.centroids.shape[1])))
    blocks = max(1, -(-int(asked["n"].sum()) // per))
    place = spark.createDataFrame(asked[["__first", "n", "before"]].astype({"__first": "int32", "n": "int64", "before": "int64"}),
                                  "__first int, n long, before long")
    total = max(1, int(asked["n"].sum()))
    at = F.col("before") + F.pmod(F.xxhash64("__q", "__v"), F.col("n"))
    todo = todo.join(F.broadcast(place), "__first").withColumn("__b", F.floor(at * blocks / total).cast("long")).drop("n", "before")
    shards = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    needed = todo.select("__b", "__v", "__bound").mapInPandas(_block_cells(index), "__b long, __cell int").distinct()
    lists = needed.groupBy("__cell").agg(F.collect_list("__b").alias("__bs"))  # at most a row per cell
    q = todo.select("__q", "__v", "__b", (F.col("__bound") * F.col("__bound") * (1 + 1e-12)).alias("__bound"), numbers(shards).alias("__s"))
    c = index.rows.join(F.broadcast(lists), "__cell").select(
        *index.items, "__v", "__cell", F.pmod(F.xxhash64(*index.items, "__v"), F.lit(shards)).cast("long").alias("__s"),
        F.explode("__bs").alias("__b"))
    return search_cells(q, c, blocks * shards, schema, k, "l2", index.items, query_id, exclude_self, _skips(index))


def _score(index: VectorIndex, queries: DataFrame, schema: T.StructType, k: int, query_id: str, exclude_self: bool) -> DataFrame:
    """Score (query, cell) pairs: ``queries`` (__q, __v, __cells)."""
    spark = queries.sparkSession
    pairs = queries.select("__q", "__v", F.explode("__cells").alias("__cell"))
    asked = pairs.groupBy("__cell").agg(F.count(F.lit(1)).alias("asked"))
    # One row per cell: bounded by MAX_CELLS.
    sizes = spark.createDataFrame(index.cells[["__cell", "n"]].astype({"__cell": "int32", "n": "int64"}), "__cell int, n long")
    plan = F.broadcast(asked.join(sizes, "__cell").select(
        "__cell", F.ceil(F.col("asked") / QUERIES_PER_BLOCK).cast("int").alias("blocks"),
        F.ceil(F.col("n") / ROWS_PER_SHARD).cast("int").alias("shards")))
    cell = lambda part: F.shiftleft(F.col("__cell").cast("long"), 32) + part
    q = pairs.join(plan, "__cell").select(
        "__q", "__v", F.pmod(F.xxhash64("__q", "__v"), F.col("blocks").cast("long")).alias("__b"), "__cell", numbers(F.col("shards")).alias("__n"))
    c = index.rows.join(plan, "__cell").select(
        *index.items, "__v", F.pmod(F.xxhash64(*index.items, "__v"), F.col("shards").cast("long")).alias("__n"), "__cell",
        numbers(F.col("blocks")).alias("__b"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return search_cells(q.withColumn("__s", cell(F.col("__n"))), c.withColumn("__s", cell(F.col("__n"))), partitions, schema, k, "l2",
                        index.items, query_id, exclude_self)


def index_search(index: VectorIndex, queries: DataFrame, k: int = 3, query_id: str = "query_id", query_vec: str = "vector",
                 exclude_self: bool = False) -> DataFrame:
    """Exact top ``k`` per query, the rows of :func:`similarity_search` on the
    indexed corpus: (query_id, *items, rank, score)."""
    schema = check_search(queries, index.rows, query_id, index.items, index.metric)
    q = _queries(index, queries, query_id, query_vec)
    if q is None:
        return queries.sparkSession.createDataFrame([], schema.add("rank", "integer")).select(query_id, *index.items, "rank", "score")
    todo = _bounded(index, q, schema, k, query_id, exclude_self)
    todo = todo.withColumn("__first", F.get("__cells", F.lit(0))).drop("__cells")
    # Rows of the first cells are scored in both steps; the second alone finds the whole answer.
    best = best_of_cells(_score_others(index, todo, schema, k, query_id, exclude_self), k, query_id, index.items, "l2")
    if index.metric == "cosine":  # of unit vectors: distance^2 = 2 - 2 cos
        best = best.withColumn("score", 1 - F.col("score") / 2)
    return best


def cells_scored(index: VectorIndex, queries: DataFrame, k: int = 3, query_id: str = "query_id", query_vec: str = "vector",
                 exclude_self: bool = False) -> DataFrame:
    """(query_id, n_scored, n_cells): how many of the index's cells each query needs to be scored against."""
    schema = check_search(queries, index.rows, query_id, index.items, index.metric)
    q = _queries(index, queries, query_id, query_vec)
    if q is None:
        nothing = queries.select(F.col(query_id), _vector(query_vec, index.metric).alias("__v")).filter(F.col("__v").isNotNull())
        return nothing.groupBy(query_id).agg(F.lit(0).cast("long").alias("n_scored")).withColumn("n_cells", F.lit(0))
    todo = _bounded(index, q, schema, k, query_id, exclude_self)
    other = todo.mapInPandas(_other_cells(index), todo.select("__q", "__v", "__cells").schema)
    both = todo.select("__q", "__cells").unionByName(other.select("__q", "__cells"))
    return both.groupBy(F.col("__q").alias(query_id)).agg(F.sum(F.size("__cells")).alias("n_scored")).withColumn("n_cells", F.lit(len(index.cells)))


def _queries(index: VectorIndex, queries: DataFrame, query_id: str, query_vec: str) -> DataFrame | None:
    if not len(index.cells):
        return None
    q = queries.select(F.col(query_id).alias("__q"), _vector(query_vec, index.metric).alias("__v"))
    return q.filter(F.size("__v") == index.centroids.shape[1])


def _bounded(index: VectorIndex, q: DataFrame, schema: T.StructType, k: int, query_id: str, exclude_self: bool) -> DataFrame:
    """The queries with their nearest cells and the bound that the best of these
    give: (__q, __v, __cells, __bound)."""
    spark = q.sparkSession
    key = schema[query_id].dataType.simpleString()
    first = q.mapInPandas(_first_cells(index, k + exclude_self), f"__q {key}, __v array<double>, __cells array<int>")
    near = _score(index, first, schema, k, query_id, exclude_self)
    bound = best_of_cells(near, k, query_id, index.items, "l2").filter(F.col("rank") == k).select(
        F.col(query_id).alias("__q2"), F.sqrt("score").alias("__bound"))
    todo = first.join(bound, F.col("__q").eqNullSafe(F.col("__q2")), "left").drop("__q2")
    path = f"{checkpoint_dir(spark).rstrip('/')}/vector-search-{uuid.uuid4().hex}"
    todo.write.parquet(path)  # read three times: to deal queries out, for the cells needed, to score
    return spark.read.schema(todo.schema).parquet(path)
