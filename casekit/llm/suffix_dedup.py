"""Remove strings that repeat across or inside documents, byte for byte.

A byte goes if a 200-byte string covering it also starts anywhere else.  The
repeated strings are found by bucket-pointer refinement: buckets of equal short
strings are refined by the bucket identifiers of later offsets, and refined
identifiers are used again for the next length (8, 16, 32, 64, 100, then 200
and up to 300 bytes), while places alone in their bucket drop out.

To move only a fraction of all positions, the first buckets are taken at
*anchors*: of each 101 consecutive positions the one with the smallest 100-byte
identifier (about 2 % of the positions).  Equal 200-byte strings have equal
anchors at equal distances, so none is lost.  Around an anchor at ``p`` the
strings starting at ``p - d``, ``0 <= d <= 100``, are refined together, in
blocks of ``LEVELS`` distances:

* if the bytes around the whole block (its *context*) occur twice, all strings
  of the block repeat: they are marked, and one representative goes on;
* if the bytes common to all strings of the block (its *core*) occur only with
  one context, no other place can match: the block is done;
* otherwise each different context is split into smaller blocks.

Blocks of one string end the recursion.  Identifiers are 64 bits wide.

Scale: an anchor, and later a block, is one narrow row.  Occurrences are counted
by grouped sums (combined before the shuffle) and joined back from written
tables, so very common passages are split like any skewed join key.  Texts are
shuffled once, to meet their anchors; later rounds move only texts that still
hold open blocks.  Every round is written to the shared folder, and what no
later round reads is deleted there.

Defined results: a null or empty text, or one under 200 bytes, loses nothing.
Rows repeated in full are occurrences of their own and get equal results.  Null
ids are fine.  An empty table gives an empty result; extra columns are not
looked at.  Very long texts are worked on in segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.functions.workers import ship_with_tasks
from casekit.llm.common import discard, release, store, text_of
from casekit.llm.substrings import LENGTH, SPAN, Buckets, _buffers, anchor_buckets

ship_with_tasks(__name__)

LEVELS = (SPAN + 1, 25, 5, 1)  # distances per block, by round
_X = 128                       # an item is position * _X + first distance


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("d").to_numpy()
        for owner, position, bucket in anchor_buckets(batch.column("bytes")):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[owner]), pa.array(position), pa.array(bucket.view(np.int64))], ["d", "p", "core"])


def _block_rows(size: int):
    """Blocks of one size -> (core, context) identifiers, one row per block."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _buffers(batch.column("bytes"))
            items, done = batch.column("items"), batch.column("done")
            for i, d in enumerate(batch.column("d").to_pylist()):
                item = items[i].values.to_numpy()
                text = Buckets(data[offsets[i]:offsets[i + 1]])
                p, x = item // _X, item % _X
                y = np.minimum(x + size - 1, SPAN)
                lo, hi = np.maximum(p - y, 0), np.minimum(p + LENGTH - x, text.size)
                ok = hi - lo >= LENGTH  # the block has a string inside the text
                p, x, y, lo, hi = p[ok], x[ok], y[ok], lo[ok], hi[ok]
                core = text.of(p - x, p + LENGTH - y)
                # equal contexts also lie the same way around the anchor
                context = text.of(lo, hi) + ((p - lo) * 512 + (hi - p)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((core + x.astype(np.uint64)).view(np.int64)), pa.array(context.view(np.int64)),
                     pa.array(np.full(len(p), d)), pa.array(p * _X + x), pa.array(done[i].values.to_numpy(False)[ok])],
                    ["core", "context", "d", "item", "done"])
    return work


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked strings -> what is left of each text."""
    for batch in batches:
        data, offsets = _buffers(batch.column("bytes"))
        out = []
        for i, marks in enumerate(batch.column("marks")):
            raw = data[offsets[i]:offsets[i + 1]]
            m = marks.values.to_numpy()
            p, x, y = m // (_X * _X), m // _X % _X, m % _X
            depth = np.zeros(len(raw) + 1, np.int64)
            np.add.at(depth, np.maximum(p - y, 0), 1)
            np.add.at(depth, np.minimum(p + LENGTH - x, len(raw)), -1)
            gone = np.cumsum(depth)[:-1] > 0
            runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
            out.append((int(gone.sum()), runs, raw[~gone].tobytes()))
        removed, runs, kept = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("d"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()),
             pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
            ["d", "n_removed", "n_spans", "kept", "kept_sha256"])


def repeated_strings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, cut): per input row its key ``d``, and for the keys of texts that
    lose something (d, n_removed, n_spans, kept, kept_sha256)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn(
        "d", F.xxhash64("id", "text"))
    bytes_ = rows.select("d", F.col("text").cast("binary").alias("bytes"))
    anchors = store(bytes_.mapInArrow(_anchor_rows, "d long, p long, core long"), "strings-anchors")
    live = store(anchors.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"), "strings-live")
    release(spark)
    found = store(anchors.join(live, "core", "left_semi").groupBy("d").agg(F.collect_set("p").alias("ps")), "strings-items")
    discard(anchors, live)
    release(spark)
    items = found.select("d", F.transform("ps", lambda p: p * _X).alias("items"),
                         F.transform("ps", lambda p: F.lit(False)).alias("done"))
    # Rows repeated in full share a key: each of them is an occurrence.
    texts = store(bytes_.join(items, "d"), "strings-texts")
    discard(found)
    release(spark)
    blocks_in, marks = texts, None
    for k, size in enumerate(LEVELS):
        blocks = store(blocks_in.mapInArrow(_block_rows(size), "core long, context long, d long, item long, done boolean"),
                       "strings-blocks")
        first = F.min(F.struct("done", "d", "item")).alias("first")
        contexts = store(blocks.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), first), "strings-contexts")
        twice = store(contexts.filter("n > 1").select("core", "context"), "strings-twice")
        new = store(blocks.filter("not done").join(twice, ["core", "context"], "left_semi").select(
            "d", (F.col("item") * _X + F.least(F.col("item") % _X + (size - 1), F.lit(SPAN))).alias("mark")).distinct(),
            "strings-marks")
        marks = new if marks is None else marks.union(new)
        discard(blocks, twice)
        release(spark)
        if k + 1 == len(LEVELS):
            break
        several = store(contexts.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("core"),
                        "strings-several")
        open_ = contexts.join(several, "core", "left_semi").select(
            F.col("first.d").alias("d"), F.col("first.item").alias("item"), (F.col("first.done") | (F.col("n") > 1)).alias("done"))
        x = F.col("item") % _X
        starts = F.sequence(x, F.least(x + (size - 1), F.lit(SPAN).cast("long")), F.lit(LEVELS[k + 1]).cast("long"))
        open_ = open_.withColumn("x", F.explode(starts)).select(
            "d", F.struct((F.col("item") - x + F.col("x")).alias("item"), "done").alias("b"))
        open_ = store(open_.groupBy("d").agg(F.collect_list("b").alias("b")).select(
            "d", F.col("b.item").alias("items"), F.col("b.done").alias("done")), "strings-open")
        discard(contexts, several)
        release(spark)
        before, blocks_in = blocks_in, store(blocks_in.select("d", "bytes").dropDuplicates(["d"]).join(open_, "d"), "strings-texts")
        discard(open_, *([before] if k else []))
        release(spark)
    marked = marks.groupBy("d").agg(F.collect_set("mark").alias("marks"))
    cut = texts.select("d", "bytes").dropDuplicates(["d"]).join(marked, "d").mapInArrow(
        _removed, "d long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return rows, cut


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    rows, cut = repeated_strings(docs)
    cut = store(cut.drop("kept"), "strings-cut")
    whole = rows.select(F.col("id").alias("doc_id"), "d", F.octet_length("text").cast("long").alias("n_bytes"),
                        F.sha2("text", 256).alias("whole"))
    return whole.join(cut, "d", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
