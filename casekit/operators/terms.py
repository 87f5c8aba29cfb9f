"""Weighted terms of texts, and exact search over posting lists.

``tfidf``: texts are counted once and kept in groups of up to ``GROUP_ROWS``
texts.  A group has one sorted list of its distinct terms; its texts hold places
in that list and counts.  Document frequencies are summed over the groups' lists,
and each group gets the weights of its own terms back, so what is shuffled by
term is one entry per group and term, not one per text and term.  A text's
vector is sparse: its terms in order with weights
``count * (ln((1 + texts) / (1 + texts with the term)) + 1)``, scaled to length one.

``build_postings`` turns each group around where it lies: one row per group and
term with the texts that hold it and how often, per text the length of its
weights before scaling (a weight is count * idf / length), and per term its number
of texts and its largest weight.  No row per text and term is ever shuffled or
written.  ``search_postings`` sums postings, exactly, without touching what
cannot win:

1. The rarest terms of a query, as many as occur in ``k`` texts, give candidates;
   the k-th best of their full scores is a score the answer reaches.
2. Terms whose largest weights together stay below that score cannot lift a text
   into the answer by themselves.  Only texts in the postings of the other terms
   are scored, in full, from the postings of all terms of the queries.

A text is scored once for a block of queries, however many of them its terms are
in: tasks hold a block's weights by term and the best ``k`` texts so far, and
stream through the groups.

Hot terms are split: a term's postings lie by group, in lists of at most
``BLOCK_ROWS`` texts.  Nothing is capped; a query of frequent words only reads
what it has to.  Shuffle files of a step are let go when its result is written.

Defined results: a text without terms has no vector; a query without known terms
finds nothing, and texts that share no term with a query are not results.  Null
texts have no terms; texts with a null key count, but are not results.  Ties
(scores equal to nine decimals) go by the key columns.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.workers import ship_with_tasks
from casekit.operators.documents import terms
from casekit.session import checkpoint_dir

ship_with_tasks(__name__)

BLOCK_ROWS = 1 << 16
GROUP_ROWS = 1 << 14
GROUP_WORDS = 1 << 22  # bound on the words of a group's texts; a longer text is a group
MAX_BUCKETS = 1 << 12  # of terms
QUERIES_PER_BLOCK = 1 << 12
_CELLS = 2_000_000  # bound on one temporary array
_SLACK = 1e-9  # scores are sums of rounded numbers


@dataclass
class TermVectors:
    """``vectors``: (keys, vector: array of (term, weight), ordered by term);
    ``idf``: (term, texts, idf); ``groups``: weights and texts as :class:`_Group`
    reads them; ``n``: how many rows of texts there are."""
    vectors: DataFrame
    idf: DataFrame
    groups: DataFrame
    n: int


def _counts(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    return rows.select(*keys, F.explode(terms(F.col(text_col))).alias("term")).groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("n"))


def _unit(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, weight) -> one ordered vector of length one per key."""
    listed = weighted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))
    return listed.withColumn("norm", norm).select(
        *keys, F.transform("v", lambda x: F.struct(x["term"].alias("term"), (x["weight"] / F.col("norm")).alias("weight"))).alias("vector"))


def _kept(df: DataFrame, path: str) -> DataFrame:
    """Write and read back.  The context cleaner deletes the step's shuffle files
    when the driver's JVM collects their handles, so it is asked to."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _lists(offsets: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _lengths(listed: pa.ListArray) -> np.ndarray:
    return np.diff(listed.offsets.to_numpy())


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))


def _cut(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches, cut where one of these values changes."""
    for batch in batches:
        if not len(batch):
            continue
        values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
        starts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1), len(batch)]
        for lo, hi in zip(starts, starts[1:]):
            yield tuple(values[lo].tolist()), batch.slice(lo, hi - lo)


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """Rows that follow each other with equal values, as one table each."""
    at, parts = None, []
    for values, part in _cut(batches, *names):
        if parts and values != at:
            yield pa.Table.from_batches(parts)
            parts = []
        at = values
        parts.append(part)
    if parts:
        yield pa.Table.from_batches(parts)


def _counted(group: int, texts: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    """A group: its distinct terms in order with their numbers of texts, in its
    first row, and each text's terms as places among them, with their counts."""
    listed = _array(texts["__t"])
    codes = listed.flatten().dictionary_encode()
    order = pc.sort_indices(codes.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row, size = np.repeat(np.arange(len(listed)), _lengths(listed)), max(1, len(order))
    both, n = np.unique(row * size + place[codes.indices.to_numpy()], return_counts=True)
    code = both % size
    offsets = np.searchsorted(both, np.arange(len(listed) + 1) * size)
    first = np.minimum(np.arange(len(listed) + 1), 1) * len(order)
    new = {"__g": pa.array(np.full(len(listed), group)), "__i": pa.array(np.arange(len(listed), dtype=np.int32)),
           "__t": _lists(offsets, code.astype(np.int32)), "__n": _lists(offsets, n.astype(np.int32)),
           "__terms": _lists(first, codes.dictionary.take(pa.array(order))),
           "__texts": _lists(first, np.bincount(code, minlength=len(order)).astype(np.int32))}
    return pa.RecordBatch.from_arrays([(new[f.name] if f.name in new else _array(texts[f.name])).cast(f.type) for f in schema], schema=schema)


def _term_counts(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, room, words = TaskContext.get().partitionId() << 32, [], GROUP_ROWS, GROUP_WORDS
        for batch in batches:
            ends, at = _ends(_lengths(batch.column("__t"))), 0
            while at < len(batch):
                to = min(at + room, int(np.searchsorted(ends, ends[at] + words, "right")) - 1, len(batch))
                if to <= at and parts:
                    yield _counted(group, pa.Table.from_batches(parts), schema)
                    group, parts, room, words = group + 1, [], GROUP_ROWS, GROUP_WORDS
                    continue
                to = max(to, at + 1)
                parts.append(batch.slice(at, to - at))
                room, words, at = room - (to - at), words - int(ends[to] - ends[at]), to
        if parts:
            yield _counted(group, pa.Table.from_batches(parts), schema)
    return run


def _dealt(buckets: int):
    """Each group's terms by bucket: (bucket, group, places, terms, texts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                found, texts = (batch.column(c).slice(at, 1).flatten() for c in ("__terms", "__texts"))
                bucket = (pd.util.hash_array(found.to_numpy(zero_copy_only=False).astype(object), categorize=False) % buckets).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                offsets = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(buckets)), pa.array(np.full(buckets, batch.column("__g")[at].as_py())), _lists(offsets, order.astype(np.int32)),
                     _lists(offsets, found.take(pa.array(order))), _lists(offsets, texts.take(pa.array(order)))], names=["__p", "__g", "__t", "__terms", "__texts"])
                yield rows.filter(pa.array(offsets[1:] > offsets[:-1]))
    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of all groups that hold a term, for each group's terms."""
    for rows in _runs(batches, "__p"):
        listed = _array(rows["__terms"])
        codes = listed.flatten().dictionary_encode().indices.to_numpy()
        texts = np.bincount(codes, _array(rows["__texts"]).flatten().to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([_array(rows["__g"]), _array(rows["__t"]), _lists(_ends(_lengths(listed)), texts[codes])],
                                         names=["__g", "__t", "__texts"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a group as one compressed value, which is shuffled as it is."""
    for (group,), part in _cut(batches, "__g"):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(part)
        yield pa.RecordBatch.from_arrays([pa.array([group]), part.column("__i").slice(0, 1), pa.array([sink.getvalue().to_pybytes()])],
                                         names=["__g", "__i", "__packed"])


class _Group:
    """A whole group: weights of its terms first, then its texts in order."""

    def __init__(self, rows: pa.Table):
        self.id, head = rows["__g"][0].as_py(), int(np.searchsorted(rows["__i"].to_numpy(), 0))
        weights = rows.slice(0, head)
        self.rows = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows["__packed"].slice(head)])
        self.terms = _array(self.rows["__terms"]).flatten()
        self.idf = np.zeros(len(self.terms))
        if head:
            self.idf[_array(weights["__t"]).flatten().to_numpy()] = _array(weights["__idf"]).flatten().to_numpy()
        listed = _array(self.rows["__t"])
        self.code, self.lengths = listed.flatten().to_numpy(), _lengths(listed)
        self.n = _array(self.rows["__n"]).flatten().to_numpy()
        self.row = np.repeat(np.arange(len(listed)), self.lengths)
        weight = self.n * self.idf[self.code]
        self.norm = np.sqrt(np.bincount(self.row, weight * weight, minlength=len(listed)))
        self.weight = weight / self.norm[self.row]


def _vectors(keys: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "__g"):
            g = _Group(rows)
            ends = _ends(g.lengths)
            for lo in range(0, len(g.lengths), 1024):
                hi = min(lo + 1024, len(g.lengths))
                part = slice(ends[lo], ends[hi])
                entries = pa.StructArray.from_arrays([g.terms.take(pa.array(g.code[part])), pa.array(g.weight[part])], names=["term", "weight"])
                vector = _lists(ends[lo:hi + 1] - ends[lo], entries).cast(schema.field("vector").type)
                yield pa.RecordBatch.from_arrays([*[_array(g.rows[c].slice(lo, hi - lo)) for c in keys], vector], schema=schema).filter(
                    pa.array(g.lengths[lo:hi] > 0))
    return run


def tfidf(rows: DataFrame, keys: list[str], text_col: str = "text", path: str | None = None) -> TermVectors:
    """Sparse vectors of all texts; ``keys`` identify a text (rows of the same
    keys are one).  The counts go to ``path`` (default: a new folder under
    ``spark.checkpoint.dir``) and folders of that name with an ending."""
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = rows.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/tfidf-{uuid.uuid4().hex}"
    own, field = [rows.schema[c] for c in keys], T.StructField
    ints, strings = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
    counted = T.StructType([*own, field("__rows", T.LongType()), field("__g", T.LongType()), field("__i", T.IntegerType()), field("__t", ints),
                            field("__n", ints), field("__terms", strings), field("__texts", ints)])
    count = lambda texts, path: _kept(texts.mapInArrow(_term_counts(to_arrow_schema(counted)), counted), path)
    counts = count(rows.select(*keys, F.lit(1).cast("long").alias("__rows"), terms(F.col(text_col)).alias("__t")), path)
    if counts.groupBy(*keys).agg(F.sum("__rows").alias("__rows")).filter("__rows > 1").limit(1).count():
        texts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.collect_list(text_col).alias("__t")).withColumn(
            "__t", F.flatten(F.transform("__t", terms)))
        counts = count(texts, f"{path}-merged")
    n, groups = counts.agg(F.coalesce(F.sum("__rows"), F.lit(0)), F.count_if(F.col("__i") == 0)).first()
    weight = lambda texts: F.log((1 + F.lit(n)) / (F.lit(1.0) + texts)) + 1
    listed = counts.filter("__i = 0").select("__g", "__terms", "__texts")
    idf = listed.select(F.inline(F.arrays_zip(F.col("__terms").alias("term"), F.col("__texts").alias("texts")))).groupBy("term").agg(
        F.sum("texts").alias("texts")).withColumn("idf", weight(F.col("texts")))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MAX_BUCKETS, max(groups, partitions))
    dealt = listed.mapInArrow(_dealt(buckets), "__p long, __g long, __t array<int>, __terms array<string>, __texts array<int>")
    summed = _kept(dealt.repartition("__p").sortWithinPartitions("__p").mapInArrow(_summed, "__g long, __t array<int>, __texts array<long>"), f"{path}-terms")
    weights = summed.select("__g", F.lit(-1).alias("__i"), "__t", F.transform("__texts", weight).alias("__idf"))
    packed = counts.drop("__rows", "__texts").mapInArrow(_packed, "__g long, __i int, __packed binary")
    both = weights.unionByName(packed, allowMissingColumns=True)
    whole = (both.repartition(groups, "__g") if groups > partitions else both.repartition("__g")).sortWithinPartitions("__g", "__i")
    out = T.StructType([*own, field("vector", T.ArrayType(T.StructType([field("term", T.StringType()), field("weight", T.DoubleType())])))])
    return TermVectors(whole.mapInArrow(_vectors(keys, to_arrow_schema(out)), out), idf, whole, n)


@dataclass
class Postings:
    """``postings``: (term, __g: group, __places: texts of the group, __n: the
    term's counts there); ``texts``: (keys, __g, __i: place in the group, __o: place in the
    order of keys, __norm); ``stats``: (term, texts, idf, top: the largest weight);
    ``vectors`` as in :class:`TermVectors`.  A weight is __n * idf / __norm."""
    keys: list[str]
    postings: DataFrame
    stats: DataFrame
    vectors: DataFrame
    texts: DataFrame


def _inverted(keys: list[str], block_rows: int, schema: pa.Schema):
    """Of each group its texts, then its lists of texts by term."""
    def batch(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "__g"):
            g = _Group(rows)
            yield batch(len(g.rows), {"__g": g.rows["__g"], "__i": g.rows["__i"], "__norm": pa.array(g.norm)} | {c: g.rows[c] for c in keys}).filter(
                pa.array(g.lengths > 0))
            order = np.argsort(g.code, kind="stable")
            found = np.bincount(g.code, minlength=len(g.terms))
            pieces = -(-found // block_rows)  # of a term's list
            term = np.repeat(np.arange(len(g.terms)), pieces)
            nth = np.arange(len(term)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            ends = _ends(np.minimum(block_rows, found[term] - nth * block_rows))
            place, n, weight = g.row[order].astype(np.int32), g.n[order], g.weight[order]
            for lo in range(0, len(term), 1 << 14):
                hi = min(lo + (1 << 14), len(term))
                part, offsets = slice(ends[lo], ends[hi]), ends[lo:hi + 1] - ends[lo]
                yield batch(hi - lo, {"__g": pa.array(np.full(hi - lo, g.id)), "term": g.terms.take(pa.array(term[lo:hi])),
                                      "__places": _lists(offsets, place[part]), "__n": _lists(offsets, n[part]),
                                      "__top": pa.array(np.maximum.reduceat(weight[part], offsets[:-1]))})
    return run


def build_postings(rows: DataFrame, keys: list[str], text_col: str = "text", path: str | None = None,
                   block_rows: int = BLOCK_ROWS) -> Postings:
    """Index all texts; the tables go to ``path`` (default: a new folder under
    ``spark.checkpoint.dir``)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = rows.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        return _kept(df, f"{path}/{name}")

    both = tfidf(rows, keys, text_col, f"{path}/counts")
    field, ints = T.StructField, T.ArrayType(T.IntegerType())
    turned = T.StructType([field("__g", T.LongType()), field("term", T.StringType()), field("__places", ints), field("__n", ints), field("__top", T.DoubleType()),
                           field("__i", T.IntegerType()), field("__norm", T.DoubleType()), *[field(c, rows.schema[c].dataType) for c in keys]])
    groups = kept(both.groups.mapInArrow(_inverted(keys, block_rows, to_arrow_schema(turned)), turned), "groups")
    lists = groups.filter("term is not null")
    stats = kept(lists.groupBy("term").agg(F.sum(F.size("__places")).cast("long").alias("texts"), F.max("__top").alias("top")).withColumn(
        "idf", F.log((1 + F.lit(both.n)) / (F.lit(1.0) + F.col("texts"))) + 1), "stats")
    texts = kept(groups.filter("term is null").select(*keys, "__g", "__i", "__norm").orderBy(*keys).withColumn("__o", F.monotonically_increasing_id()), "texts")
    return Postings(list(keys), lists.select("term", "__g", "__places", "__n"), stats, both.vectors, texts)


def _texts_of(index: Postings, wanted: DataFrame) -> DataFrame:
    """Distinct texts, as (group, place), in the postings of terms."""
    return index.postings.join(wanted, "term", "left_semi").select("__g", F.explode("__places").alias("__i")).distinct()


def _rounded(scores: np.ndarray) -> np.ndarray:
    """To nine decimals, as Spark rounds."""
    values, at = np.unique(scores, return_inverse=True)
    nine = Decimal("1e-9")
    return np.array([float(Decimal(repr(float(v))).quantize(nine, ROUND_HALF_UP)) for v in values], float)[at.ravel()]


class _Block:
    """A block of queries, by term, and their best texts so far; of equal scores
    the text that comes first in the order of keys is the better one."""

    def __init__(self, k: int, keys: list[str], queries: pa.Table):
        self.k, self.keys = k, keys
        queries = queries.combine_chunks()
        self.ids = queries["query_id"]
        vectors = _array(queries["vector"])
        entries = vectors.flatten()
        codes = entries.field("term").dictionary_encode()
        order = np.argsort(codes.indices.to_numpy(), kind="stable")
        self.terms = codes.dictionary
        self.query = np.repeat(np.arange(len(vectors)), _lengths(vectors))[order]
        self.weight = entries.field("weight").to_numpy()[order]
        self.start = np.searchsorted(codes.indices.to_numpy()[order], np.arange(len(self.terms) + 1))
        self.q, self.s, self.r, self.o = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        self.won: pa.Table | None = None
        self.bound, self.last = np.full(len(vectors), -np.inf), np.zeros(len(vectors), np.int64)  # score and order of the k-th

    def score(self, texts: pa.Table, lists: pa.Table) -> None:
        """Texts of a group by the lists of its terms."""
        place = pc.index_in(_array(lists["term"]), value_set=self.terms)
        lists = lists.filter(place.is_valid())
        if not len(texts) or not len(lists):
            return
        found, listed = _array(lists["term"]), _array(lists["__places"])
        lengths, at = _lengths(listed), listed.flatten().to_numpy()
        i = texts["__i"].to_numpy()
        row = np.full(max(i.max(), at.max()) + 1, -1)
        row[i] = np.arange(len(i))
        ordered = np.empty(len(found), np.int64)
        ordered[pc.sort_indices(found).to_numpy()] = np.arange(len(found))
        wanted = np.flatnonzero(row[at] >= 0)
        of = np.repeat(np.arange(len(found)), lengths)[wanted]
        row = row[at[wanted]]
        order = np.lexsort((ordered[of], row))  # a text's terms in their order
        wanted, of, row = wanted[order], of[order], row[order]
        weight = _array(lists["__n"]).flatten().to_numpy()[wanted] * lists["idf"].to_numpy()[of] / texts["__norm"].to_numpy()[row]
        place = place.drop_null().to_numpy()[of]
        step = max(1, _CELLS // len(self.bound))
        for lo in range(0, len(texts), step):
            part = slice(*np.searchsorted(row, (lo, lo + step)))
            if part.start < part.stop:
                self._score(texts.slice(lo, step), place[part], row[part] - lo, weight[part])

    def _score(self, texts: pa.Table, place: np.ndarray, row: np.ndarray, weight: np.ndarray) -> None:
        n = len(self.bound)
        lo, count = self.start[place], self.start[place + 1] - self.start[place]
        S = np.zeros(len(texts) * n)
        ends = np.cumsum(count)
        at = 0
        while at < len(count):  # pairs of a stretch of terms, in their order
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CELLS, "right")))
            c = count[at:to]
            which = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[at:to], c)
            np.add.at(S, np.repeat(row[at:to] * n, c) + self.query[which], np.repeat(weight[at:to], c) * self.weight[which])
            at = to
        S = S.reshape(len(texts), n)
        reach = self.bound
        if len(texts) > self.k:  # the k best of these, and their equals
            reach = np.maximum(reach, np.partition(S, len(texts) - self.k, axis=0)[len(texts) - self.k])
        i, q = np.nonzero((S > 0) & (S > reach - 2e-9))
        if not len(i):
            return
        s, o = S[i, q], texts["__o"].to_numpy()[i]
        r = _rounded(s)
        good = (r > self.bound[q]) | ((r == self.bound[q]) & (o < self.last[q]))
        i, q, s, o, r = i[good], q[good], s[good], o[good], r[good]
        won = texts.select(self.keys).take(pa.array(i))
        q, s, r, o = (np.concatenate(x) for x in ((self.q, q), (self.s, s), (self.r, r), (self.o, o)))
        order = np.lexsort((o, -r, q))
        first = np.flatnonzero(np.concatenate(([True], q[order][1:] != q[order][:-1])))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        keep, last = order[rank < self.k], order[rank == self.k - 1]
        self.won = (pa.concat_tables([self.won, won]) if self.won is not None else won).take(pa.array(keep)).combine_chunks()
        self.q, self.s, self.r, self.o = q[keep], s[keep], r[keep], o[keep]
        self.bound[q[last]], self.last[q[last]] = r[last], o[last]

    def result(self, schema: pa.Schema) -> pa.RecordBatch | None:
        if self.won is None:
            return None
        columns = [self.ids.take(pa.array(self.q)), *[self.won[c] for c in self.keys], pa.array(self.s)]
        return pa.RecordBatch.from_arrays([_array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _score_blocks(k: int, keys: list[str], schema: pa.Schema):
    """A block's queries come first, then its groups, of each the texts, then the lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for rows in _runs(batches, "__b", "__s", "__g"):
            b, s, g = (rows[c][0].as_py() for c in ("__b", "__s", "__g"))
            if (b, s) != at:
                if block is not None and (found := block.result(schema)) is not None:
                    yield found
                at, block = (b, s), None
            if g < 0:
                block = _Block(k, keys, rows)
            elif block is not None:  # else no query fell into this block
                texts = int(np.searchsorted(rows["__kind"].to_numpy(), 2))
                block.score(rows.slice(0, texts), rows.slice(texts))
        if block is not None and (found := block.result(schema)) is not None:
            yield found
    return run


def _scored(index: Postings, texts: DataFrame, weights: DataFrame, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    """The best texts of each task's share, with full scores: (query_id, keys,
    score).  ``asked``: the terms of all queries with their idf."""
    from functools import reduce

    from pyspark.sql.pandas.types import to_arrow_schema
    spark = weights.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-partitions // blocks))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shard = F.pmod(F.xxhash64("__g"), F.lit(shards)).cast("int")
    own = [index.texts.schema[c] for c in index.keys]
    out = T.StructType([weights.schema["query_id"], *own, T.StructField("score", T.DoubleType())])
    q = weights.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("__b"), number(shards).alias("__s"),
                       F.lit(-1).cast("long").alias("__g"), F.lit(0).alias("__kind"), "query_id", "vector")
    t = index.texts.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in index.keys])).join(texts, ["__g", "__i"], "left_semi").select(
        number(blocks).alias("__b"), shard.alias("__s"), "__g", F.lit(1).alias("__kind"), "__i", "__o", "__norm", *index.keys)
    groups = F.broadcast(texts.select("__g").distinct())
    lists = index.postings.join(asked, "term").join(groups, "__g", "left_semi").select(
        number(blocks).alias("__b"), shard.alias("__s"), "__g", F.lit(2).alias("__kind"), "term", "idf", "__places", "__n")
    both = q.unionByName(t, allowMissingColumns=True).unionByName(lists, allowMissingColumns=True)
    both = both.repartition(blocks * shards, "__b", "__s").sortWithinPartitions("__b", "__s", "__g", "__kind")
    return both.mapInArrow(_score_blocks(k, index.keys, to_arrow_schema(out)), out)


def _best(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), *[F.col(c).asc() for c in keys])
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_postings(index: Postings, queries: DataFrame, k: int = 3, query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """Exact top ``k`` texts per query by the product of term vectors:
    (query_id, keys, rank, score)."""
    spark = queries.sparkSession
    q = _counts(queries.select(F.col(query_id).alias("query_id"), F.col(text_col).alias("text")).filter(F.col("query_id").isNotNull()),
                ["query_id"], "text")
    known = q.join(index.stats, "term")
    path = f"{checkpoint_dir(spark).rstrip('/')}/queries-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:  # small tables, so that joins know they are
        return _kept(df, f"{path}/{name}")

    weights = kept(_unit(known.select("query_id", "term", (F.col("n") * F.col("idf")).alias("weight")), ["query_id"]), "weights")
    blocks = max(1, -(-weights.count() // QUERIES_PER_BLOCK))
    by_term = kept(weights.select("query_id", F.inline("vector")).join(index.stats, "term").select(
        "query_id", "term", "texts", "idf", (F.col("weight") * F.col("top")).alias("bound")), "terms")
    asked = kept(by_term.select("term", "idf").distinct(), "asked")

    def scored(wanted: DataFrame, name: str) -> DataFrame:
        wanted = kept(wanted.select("term").distinct(), f"{name}-terms")
        return _best(_scored(index, kept(_texts_of(index, wanted), f"{name}-texts"), weights, asked, blocks, k), index.keys, k)

    rarest = Window.partitionBy("query_id").orderBy("texts", "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = by_term.withColumn("before", F.coalesce(F.sum("texts").over(rarest), F.lit(0))).filter(F.col("before") < k)
    reached = scored(seeds, "seeds").filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    smallest = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    needed = (by_term.withColumn("together", F.sum("bound").over(smallest)).join(reached, "query_id", "left")
              .filter(F.col("reached").isNull() | (F.col("together") >= F.col("reached") - _SLACK)))
    return scored(needed, "needed").select(F.col("query_id").alias(query_id), *index.keys, "rank", "score")
