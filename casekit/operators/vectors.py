"""Exact k-nearest-neighbour search between a query table and a corpus.

Plan (no collect, no broadcast, no cross join):

1. Queries are hashed into blocks of about ``QUERIES_PER_BLOCK`` (the queries
   are counted, nothing else runs before the action) and corpus rows into
   shards; each (block, shard) cell gets its block's queries and its shard's
   rows by one hash shuffle.  More queries make more blocks, not larger ones.
2. A task streams through its cells, queries first: it holds one block of
   queries and their best ``k`` items so far, and scores the cell's corpus
   rows batch by batch with numpy.  It emits exactly ``k`` items per query and
   cell (fewer if the cell has fewer), whatever ties there are.
3. A window ``row_number`` per query over those partial winners picks the
   global top-k (Spark plans it with a window group limit).

Squared distances are first estimated by one single-precision matrix product
with a bound on its error, around the mean of the block's queries.  Only pairs
whose estimate reaches the query's k-th best so far are computed as sums of
squared differences, so every distance that decides anything is exact.  Of equal
vectors in a batch only those that can be among the best ``k`` are looked at.

A task's memory is one block of queries (at most ``_BLOCK_NUMBERS`` numbers) and
one batch of rows, whatever the tables' sizes.  There are as many shards as it
takes to have a cell for every shuffle partition of the session; they only
spread the work.  The corpus is shuffled once per block and the queries once per
shard; where that is too much, :mod:`casekit.operators.vector_index` leaves most
of the cells out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.workers import ship_with_tasks

ship_with_tasks(__name__)

QUERIES_PER_BLOCK = 1 << 15
_BLOCK_NUMBERS = 1 << 25  # bound on the numbers in a block of queries
_BLOCK_FLOATS = 2_000_000  # bound on one temporary array
_BATCH_ROWS = 8192         # corpus rows scored at a time,
_FIRST_ROWS = 1024         # fewer where a query has no k items yet
_LARGEST = 1e15            # beyond it squares leave single precision


def finite(v: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor NaN or infinity."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _scores(C: np.ndarray, Q: np.ndarray, metric: str) -> np.ndarray:
    """(queries x rows) scores, lower is better; what has no score is NaN."""
    with np.errstate(all="ignore"):
        if metric == "l2":
            diff = C[None, :, :] - Q[:, None, :]
            return np.einsum("qnd,qnd->qn", diff, diff)
        dots = Q @ C.T
        if metric == "dot":
            return -dots
        norms = np.linalg.norm(Q, axis=1)[:, None] * np.linalg.norm(C, axis=1)[None, :]
        return -np.where(norms == 0, 0.0, dots / norms)


def _best(S: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the ``k`` smallest finite scores per query; of equal
    scores the first rows."""
    S = np.where(np.isfinite(S), S, np.inf)
    if S.shape[1] > k:
        kth = np.partition(S, k - 1, axis=1)[:, k - 1:k]
        tied = S == kth
        room = k - (S < kth).sum(axis=1, keepdims=True)
        keep = (S < kth) | (tied & (np.cumsum(tied, axis=1) <= room))
    else:
        keep = np.ones(S.shape, bool)
    return np.nonzero(keep & np.isfinite(S))


def _in_order(*keys: np.ndarray) -> np.ndarray:
    """For each row the number of rows before it with the same keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - start
    return out


def vectors_of(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """An Arrow column of lists of doubles as a matrix."""
    lengths = np.diff(column.offsets.to_numpy())
    dims = int(lengths[0]) if dims is None else dims
    if (lengths != dims).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _number(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values."""
    codes = column.dictionary_encode()
    return codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)


class _Cell:
    """The queries of one (block, shard) cell and their best items so far.
    Corpus rows come in the order of the items, so of equal scores the earlier
    row is the better one."""

    def __init__(self, k: int, metric: str, items: list[str], exclude_self: bool, skips=None):
        self.k, self.metric, self.items, self.exclude_self, self.skips = k, metric, items, exclude_self, skips
        self.parts: list[pa.Table] = []
        self.waiting: list[pa.Table] = []
        self.rows = 0
        self.Q: np.ndarray | None = None

    def add_queries(self, rows: pa.Table) -> None:
        self.parts.append(rows)

    def add_rows(self, rows: pa.Table) -> None:
        if not self.parts:
            return
        self.waiting.append(rows)
        self.rows += len(rows)
        if self.rows >= _BATCH_ROWS:
            self.score()

    def _start(self) -> None:
        queries = pa.concat_tables(self.parts).combine_chunks()
        self.parts = self.parts[:1]
        self.ids = queries["__q"]
        self.Q = vectors_of(_one(queries["__v"]))
        # What a score has to stay under, or reach where it is given.
        given = _one(queries["__bound"]).fill_null(np.inf).to_numpy(zero_copy_only=False)
        self.bound = given.astype(np.float64)
        self.full = np.zeros(len(self.Q), bool)
        self.q, self.s = np.zeros(0, np.int64), np.zeros(0)
        self.won: pa.Table | None = None
        self.open = self.skips(self.Q, given) if self.skips else None
        if self.metric == "l2":
            self.mean = self.Q.mean(axis=0)
            self.error = 4 * (self.Q.shape[1] + 8) * float(np.finfo(np.float32).eps)
            around = self.Q - self.mean
            self.large = not np.abs(around).max(initial=0) < _LARGEST
            self.squares = (around * around).sum(axis=1) * (1 - self.error)
            if not self.large:
                self.Q32 = np.concatenate((around, np.ones((len(around), 1))), axis=1).astype(np.float32)

    def score(self) -> None:
        if not self.rows:
            return
        rows = pa.concat_tables(self.waiting).combine_chunks()
        self.waiting, self.rows = [], 0
        if self.Q is None:
            self._start()
        at = 0
        while at < len(rows):
            n = _BATCH_ROWS if np.isfinite(self.bound).all() else _FIRST_ROWS
            self._score(rows.slice(at, n))
            at += n

    def _score(self, rows: pa.Table) -> None:
        C = vectors_of(_one(rows["__v"]), self.Q.shape[1])
        own = ids = None
        if self.exclude_self:
            own, ids = self._same_ids(rows[self.items[0]])
        # Of equal vectors the first k rows (of the first k + 1 ids, k of each) hide the others.
        same = np.unique(C.view(f"V{C.shape[1] * 8}"), return_inverse=True)[1].ravel() if C.shape[1] else np.zeros(len(C), np.int64)
        if ids is None:
            use = np.flatnonzero(_in_order(same) < self.k)
        else:
            nth = _in_order(same, ids)
            order = np.argsort(same, kind="stable")
            seen = np.cumsum(nth[order] == 0)  # ids of a vector are runs, as rows are in the order of the items
            before = np.empty(len(C), np.int64)
            before[order] = seen - seen[np.searchsorted(same[order], same[order])]
            use = np.flatnonzero((nth < self.k) & (before <= self.k))
            ids = ids[use]
        C = np.ascontiguousarray(C[use])
        found = []
        for some, cols in self._groups(rows, use):
            for q, n, s in self._near(C[cols], some, own, None if ids is None else ids[cols]):
                found.append((q, use[cols[n]], s))
        q, n, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        if not len(q):
            return
        items = rows.select(self.items).take(pa.array(n))
        # Winners so far came earlier: they stay before new rows of the same score.
        when = np.concatenate((np.zeros(len(self.q), np.int64), n + 1))
        q, s = np.concatenate((self.q, q)), np.concatenate((self.s, s))
        order = np.lexsort((when, s, q))
        start = np.flatnonzero(np.concatenate(([True], q[order][1:] != q[order][:-1])))
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        keep, last = order[rank < self.k], order[rank == self.k - 1]
        self.won = (pa.concat_tables([self.won, items]) if self.won is not None else items).take(pa.array(keep)).combine_chunks()
        self.q, self.s = q[keep], s[keep]
        self.full[q[last]] = True
        self.bound[q[last]] = np.minimum(self.bound[q[last]], s[last])

    def _groups(self, rows: pa.Table, use: np.ndarray):
        """(queries or None for all, rows) to score with each other."""
        everything = np.arange(len(use))
        if self.open is None:
            yield None, everything
            return
        cells = _one(rows["__cell"]).to_numpy(zero_copy_only=False)[use]
        asked = {c: self.open(c) for c in np.unique(cells)}
        most = [c for c, q in asked.items() if 4 * len(q) > len(self.Q)]
        if most:
            yield None, np.flatnonzero(np.isin(cells, most))
        for c, q in asked.items():
            if len(q) and c not in most:
                yield q, np.flatnonzero(cells == c)

    def _same_ids(self, items: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the queries' and the rows' ids; a null is nobody's id."""
        asked = self.ids
        if asked.type != items.type:
            if pa.types.is_string(asked.type) or pa.types.is_string(items.type):
                return np.full(len(asked), -1), np.arange(len(items))
            asked = asked.cast(items.type)
        codes = _number(pa.concat_arrays([_one(asked), _one(items)]))
        return np.where(asked.is_null().to_numpy(), -1, codes[:len(asked)]), codes[len(asked):]

    def _near(self, C: np.ndarray, some: np.ndarray | None, own: np.ndarray | None, ids: np.ndarray | None):
        """(query, row, score) of all pairs that can be among the best."""
        C32 = None
        if self.metric == "l2" and not self.large:
            around = C - self.mean
            if np.abs(around).max(initial=0) < _LARGEST:
                squares = (around * around).sum(axis=1) * (1 - self.error)
                C32 = np.concatenate((-2 * around, squares[:, None]), axis=1).astype(np.float32).T
        count = len(self.Q) if some is None else len(some)
        step = max(1, _BLOCK_FLOATS // max(1, len(C) * (C.shape[1] if self.metric == "l2" and C32 is None else 1)))
        for at in range(0, count, step):
            of = slice(at, min(at + step, count)) if some is None else some[at:at + step]
            if C32 is None:
                q, n, s = self._exact(C, of, own, ids)
            else:
                q, n, s = self._estimated(C, C32, of, own, ids)
            yield (q + at if some is None else of[q]), n, s

    def _estimated(self, C: np.ndarray, C32: np.ndarray, of, own: np.ndarray | None, ids: np.ndarray | None):
        S = self.Q32[of] @ C32
        Q, bound, full = self.Q[of], self.bound[of], self.full[of]
        new = np.flatnonzero(np.isinf(bound))
        if len(new) and len(C) > self.k:  # any k rows give a first bound, near ones a good one
            bound = bound.copy()
            first = S[new] if ids is None else np.where(own[of][new][:, None] == ids[None, :], np.float32(np.inf), S[new])
            near = np.argpartition(first, self.k - 1, axis=1)[:, :self.k]
            far = np.zeros(len(new))
            for j in range(self.k):
                diff = Q[new] - C[near[:, j]]
                far = np.maximum(far, np.einsum("pd,pd->p", diff, diff))
            bound[new] = np.where(np.isfinite(np.take_along_axis(first, near, axis=1)).all(axis=1), far, np.inf)
        limit = bound * (1 + self.error) - self.squares[of] + 1e-30
        with np.errstate(over="ignore"):
            limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        q, n = np.divmod(np.flatnonzero((S <= limit[:, None]).ravel()), len(C))
        kept = []
        for lo in range(0, len(q), 1 << 16):
            a, b = q[lo:lo + (1 << 16)], n[lo:lo + (1 << 16)]
            diff = Q[a] - C[b]
            s = np.einsum("pd,pd->p", diff, diff)
            good = np.isfinite(s) & np.where(full[a], s < bound[a], s <= bound[a])
            if ids is not None:
                good &= own[of][a] != ids[b]
            kept.append((a[good], b[good], s[good]))
        return tuple(np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (q, n, np.zeros(0))

    def _exact(self, C: np.ndarray, of, own: np.ndarray | None, ids: np.ndarray | None):
        S = _scores(C, self.Q[of], self.metric)
        if ids is not None:
            S = np.where(own[of][:, None] == ids[None, :], np.inf, S)
        full = self.full[of]
        q, n = np.nonzero((S < self.bound[of][:, None]) & full[:, None])
        if not full.all():
            new = np.flatnonzero(~full)
            q2, n2 = _best(S[new], self.k)
            q, n = np.concatenate((q, new[q2])), np.concatenate((n, n2))
        s = S[q, n]
        good = np.isfinite(s)
        return q[good], n[good], s[good]

    def result(self, schema: pa.Schema) -> pa.RecordBatch | None:
        self.score()
        if self.Q is None or self.won is None:
            return None
        score = self.s if self.metric == "l2" else -self.s
        columns = [self.ids.take(pa.array(self.q)), *[self.won[c] for c in self.items], pa.array(score)]
        return pa.RecordBatch.from_arrays([_one(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _search(k: int, metric: str, items: list[str], out: T.StructType, exclude_self: bool, skips=None):
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            b, s, item = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__b", "__s", "__item"))
            new = (b[1:] != b[:-1]) | (s[1:] != s[:-1]) | (item[1:] != item[:-1])
            starts = [0, *(np.flatnonzero(new) + 1), len(b)]
            table = pa.Table.from_batches([batch])
            for lo, hi in zip(starts, starts[1:]):
                if (b[lo], s[lo]) != at:
                    if cell is not None and (found := cell.result(schema)) is not None:
                        yield found
                    cell, at = _Cell(k, metric, items, exclude_self, skips), (b[lo], s[lo])
                rows = table.slice(lo, hi - lo)
                cell.add_rows(rows) if item[lo] else cell.add_queries(rows)
        if cell is not None and (found := cell.result(schema)) is not None:
            yield found
    return run


def check_search(queries: DataFrame, corpus: DataFrame, query_id: str, items: list[str], metric: str) -> T.StructType:
    """The schema of what the cells find."""
    if metric not in ("l2", "cosine", "dot"):
        raise ValueError("metric must be l2, cosine or dot")
    return T.StructType([queries.schema[query_id]] + [corpus.schema[c] for c in items] + [T.StructField("score", T.DoubleType())])


def numbers(n: Column | int) -> Column:
    """One row for each of 0 .. n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), (n if isinstance(n, Column) else F.lit(n)).cast("long") - 1))


def search_cells(queries: DataFrame, corpus: DataFrame, partitions: int, schema: T.StructType, k: int, metric: str,
                 items: list[str], query_id: str, exclude_self: bool, skips=None) -> DataFrame:
    """The best ``k`` items of every query in every cell: ``queries`` (__q, __v)
    and ``corpus`` (items, __v) rows with their cells (__b, __s).  A query's
    ``__bound``, if there is one, is a score that its answer reaches.  ``skips``
    (with ``__cell`` in the corpus rows) leaves queries of a block out:
    (vectors, bounds) -> (index cell -> the queries to score)."""
    own = ["__cell"] if skips else []
    bound = F.col("__bound") if "__bound" in queries.columns else F.lit(None).cast("double").alias("__bound")
    q = queries.select("__q", "__v", "__b", "__s", bound, F.lit(False).alias("__item"), *[F.lit(None).cast("int").alias(c) for c in own],
                       *[F.lit(None).cast(schema[c].dataType).alias(c) for c in items])
    c = corpus.select(F.lit(None).cast(schema[query_id].dataType).alias("__q"), "__v", "__b", "__s", F.lit(None).cast("double").alias("__bound"),
                      F.lit(True).alias("__item"), *own, *items)
    cells = q.unionByName(c).repartition(partitions, "__b", "__s").sortWithinPartitions("__b", "__s", "__item", *items)
    return cells.mapInArrow(_search(k, metric, items, schema, exclude_self, skips), schema)


def best_of_cells(found: DataFrame, k: int, query_id: str, items: list[str], metric: str) -> DataFrame:
    """The global top k of the cells' winners."""
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    w = Window.partitionBy(query_id).orderBy(order, *[F.col(i).asc() for i in items])
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query_id, *items, "rank", "score")


def similarity_search(queries: DataFrame, corpus: DataFrame, k: int = 3,
                      query_id: str = "query_id", query_vec: str = "vector",
                      item_cols: list[str] | str = "item_id", item_vec: str = "vector",
                      metric: str = "l2", exclude_self: bool = False,
                      query_blocks: int | None = None, corpus_shards: int | None = None) -> DataFrame:
    """Top ``k`` corpus items per query: ``(query_id, *item_cols, rank, score)``.

    ``metric``: ``l2`` (squared Euclidean, ascending), ``cosine`` or ``dot``
    (descending).  Ties are broken by the item columns.  Null vectors, those with
    entries that are not finite (they score nothing finite, so they are not
    shuffled) and scores that are not finite are left out.  ``exclude_self`` drops the pair
    where the query id equals the (single) item id.
    """
    items = [item_cols] if isinstance(item_cols, str) else list(item_cols)
    schema = check_search(queries, corpus, query_id, items, metric)
    q = queries.select(F.col(query_id).alias("__q"), F.col(query_vec).cast("array<double>").alias("__v")).filter(finite(F.col("__v")))
    if query_blocks:
        blocks = query_blocks
    else:
        n, dims = q.agg(F.count(F.lit(1)), F.max(F.size("__v"))).first()
        blocks = max(1, -(-n // max(1, min(QUERIES_PER_BLOCK, _BLOCK_NUMBERS // max(1, dims or 1)))))
    shards = corpus_shards or max(1, -(-int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))

    q = q.select("*", F.pmod(F.xxhash64("__q", "__v"), F.lit(blocks)).cast("long").alias("__b"), numbers(shards).alias("__s"))
    c = corpus.select(*items, F.col(item_vec).cast("array<double>").alias("__v")).filter(finite(F.col("__v")))
    c = c.select("*", F.pmod(F.xxhash64(*items, "__v"), F.lit(shards)).cast("long").alias("__s"), numbers(blocks).alias("__b"))
    found = search_cells(q, c, blocks * shards, schema, k, metric, items, query_id, exclude_self)
    return best_of_cells(found, k, query_id, items, metric)
