"""Near-duplicate documents by fast similarity sketches, bands and exact checks.

A sketch has ``BINS`` coordinates.  In each round every shingle is hashed into
one bin with a value that grows with the round, and a bin keeps its minimum;
after ``BINS`` random rounds, ``BINS`` more send all shingles to one bin each,
so every coordinate is filled.  Almost all texts fill theirs in the first few
rounds.  ``BAND_ROWS`` coordinates form a band; texts sharing a band are
candidates (at similarity 0.8 a pair shares none with probability 5e-8).
Candidates are linked if their full sets of shingle hashes (64 bits) say so.

Texts with equal sets are one class, represented by the smallest id; only
representatives are banded and compared.  In a band's group the candidates are
not paired with each other but with pivots: first with the member that shares
its bands with most others (of edited copies, the original), then with members
drawn by hash for what is not yet connected, and at last every remaining pair
of different components -- so no link between components is lost, and a group
of n mutual copies costs about n comparisons.  From the second step on, most
pairs of a group are ruled out by numbers alone: what a text lost and gained
against its group's centre, and how many of its shingles no other text has,
bound from below how much two texts differ (:func:`_possible`).

Defined results: a null, empty or blank text has an empty set and links with
nothing, as has a row with a null id (its component is null, and it is kept).
Rows repeated in full share id, class and component.  An empty table gives an
empty result; extra columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.functions.workers import ship_with_tasks
from casekit.llm.common import release, store
from casekit.llm.graph import connected_components
from casekit.llm.shingles import mix, shingle_set, word_hashes

ship_with_tasks(__name__)

BINS = 128
BAND_ROWS = 4
PIVOT_ORDERS = 8  # orders in which pivots are drawn by hash


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit hashes (not empty)."""
    out = np.full(bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    empty = bins
    for i in range(2 * bins):
        v = mix(items, i + 2)
        value = (v >> np.uint64(8)) | (np.uint64(i) << np.uint64(56))
        if i < bins:
            np.minimum.at(out, (v & np.uint64(0xFF)) % np.uint64(bins), value)
            empty = int((out == np.uint64(0xFFFFFFFFFFFFFFFF)).sum())
            if not empty:
                break
        else:
            b = i - bins
            out[b] = min(out[b], value.min())
    return out


def _features(words: np.ndarray, width: int) -> tuple[int, int, int, np.ndarray]:
    items = shingle_set(words, width)
    if not len(items):
        return 0, 0, 0, np.zeros(0, np.int64)
    rows = sketch(items).reshape(-1, BAND_ROWS)
    key = np.arange(len(rows), dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mix(key * np.uint64(31) + rows[:, k], k)
    a, b = mix(items, 1001).sum(dtype=np.uint64), mix(items, 1002).sum(dtype=np.uint64)
    return len(items), int(a.view(np.int64)), int(b.view(np.int64)), key.view(np.int64)


def _lowered(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts.to_pylist()]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0] + [len(x) for x in arrays])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values.view(np.int64)))


def features_udf(width: int):
    """text -> (n, a, b, bands): set size, a 128-bit digest of the set, band keys."""
    @F.arrow_udf("struct<n:bigint,a:bigint,b:bigint,bands:array<bigint>>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            with np.errstate(over="ignore"):
                rows = [_features(w, width) for w in word_hashes(_lowered(texts))]
            n, a, b, bands = ([r[k] for r in rows] for k in range(4))
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), _lists(bands)],
                ["n", "a", "b", "bands"])
    return features


def sets_udf(width: int):
    """text -> its distinct shingle hashes."""
    @F.arrow_udf("array<bigint>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _lists([shingle_set(w, width) for w in word_hashes(_lowered(texts))])
    return sets


def _possible(threshold_pct: int) -> Column:
    """Whether a text and a pivot can be similar, by counts alone.

    The sets share at most what is left of the smaller one without its ``u``
    unique shingles.  Against a common centre one text has ``lost`` and
    ``added`` shingles, ``extra`` of these not unique; two texts differ in all
    of these but those both lost (at most the lesser count) and those both
    added (at most the lesser ``extra``).  Unknown counts rule nothing out.
    """
    shared = F.least(F.col("n") - F.col("u"), F.col("pn") - F.col("pu"))
    differ = (F.col("lost") + F.col("added") + F.col("plost") + F.col("padded")
              - 2 * (F.least("lost", "plost") + F.least("extra", "pextra")))
    known = F.col("lost").isNotNull() & F.col("plost").isNotNull()
    sizes = F.col("n") + F.col("pn")
    return ((100 + threshold_pct) * shared >= threshold_pct * sizes) & (
        ~known | ((100 + threshold_pct) * differ <= (100 - threshold_pct) * sizes))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5,
                    threshold_pct: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    feats = store(texts.select("id", features_udf(width)("text").alias("f")).select("id", "f.*"), "minhash-features")
    reps = (feats.filter("n > 0 and id is not null").groupBy("a", "b", "n")
            .agg(F.min(F.struct("id", "bands")).alias("r")).select("a", "b", "n", "r.id", "r.bands"))
    reps = store(reps, "minhash-classes")
    rows = reps.select("id", "n", F.posexplode("bands").alias("band", "key"))
    shared = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "minhash-shared")
    members = store(rows.join(shared, "key"), "minhash-shares")
    scores = members.groupBy("id").agg(F.sum("c").alias("score"))
    members = store(members.drop("c").join(scores, "id"), "minhash-members")
    # texts are shuffled to their ids, at every size
    sets = texts.join(members.select("id").distinct().hint("merge"), "id", "left_semi")
    sets = store(sets.select("id", sets_udf(width)("text").alias("items")).groupBy("id", F.xxhash64("items").alias("h"))
                 .agg(F.first("items").alias("items")).select("id", "items"), "minhash-sets")
    release(docs.sparkSession)

    def counted(pairs: DataFrame) -> DataFrame:
        """The (x, y) pairs with the size of their full sets' intersection."""
        of = lambda side, name: sets.select(F.col("id").alias(side), F.col("items").alias(name))
        # Spark carries the smaller text's set to the larger one's.
        full = pairs.join(of("x", "s"), "x").join(of("y", "t"), "y")
        return full.select("x", "y", "xn", "yn", F.size(F.array_intersect("s", "t")).cast("long").alias("both"))

    similar = 100 * F.col("both") >= threshold_pct * (F.col("xn") + F.col("yn") - F.col("both"))

    def pairs_of(p: DataFrame) -> DataFrame:
        """Distinct candidate pairs, the one with the smaller set first."""
        swap = F.struct("n", "id") > F.struct("pn", "pivot")
        p = p.filter("id <> pivot").filter(_possible(threshold_pct))
        return p.select(F.when(swap, F.col("pivot")).otherwise(F.col("id")).alias("x"),
                        F.when(swap, F.col("id")).otherwise(F.col("pivot")).alias("y"),
                        F.least("n", "pn").alias("xn"), F.greatest("n", "pn").alias("yn")).distinct()

    own = ["n", "u", "lost", "added", "extra", "comp"]
    as_pivot = [F.col("id").alias("pivot"), *[F.col(c).alias(f"p{c}") for c in own]]

    def drawn(m: DataFrame, rank: Column) -> DataFrame:
        """Every group's pivot, the member of the least rank."""
        return store(m.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), *as_pivot)).alias("p")).select("key", "p.*"),
                     "minhash-pivots")

    def star(m: DataFrame, pivots: DataFrame) -> DataFrame:
        """Every member with its group's pivot."""
        return pairs_of(m.join(pivots, "key").filter("comp <> pcomp"))

    def unique_counts(m: DataFrame) -> DataFrame:
        """(id, u): shingles no other text of ``m`` has, where there are any."""
        items = sets.join(m.select("id").distinct(), "id", "left_semi").select("id", F.explode("items").alias("item"))
        alone = items.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1")
        return alone.groupBy("id").agg(F.count(F.lit(1)).alias("u"))

    nothing = F.lit(None).cast("long")
    left = members.select("*", F.col("id").alias("comp"), F.lit(0).cast("long").alias("u"), nothing.alias("lost"),
                          nothing.alias("added"), nothing.alias("extra"))
    centres = drawn(left, F.struct(-F.col("score"), F.xxhash64("id")))
    tried, unique = None, None
    for step in ("centre", "drawn", "rest"):
        if step == "centre":
            pairs = star(left, centres)
        elif step == "drawn":
            # the order that draws pivots depends on the band, so a text meets several
            pairs = star(left, drawn(left, F.xxhash64("id", F.col("band") % PIVOT_ORDERS)))
        else:
            # by common centre, so that a pair is met once however many groups it shares
            seat = left.join(centres.select("key", F.col("pivot").alias("centre")), "key").groupBy("id", "centre").agg(
                F.collect_set("key").alias("keys"), *[F.first(c).alias(c) for c in own])
            seat = store(seat, "minhash-by-centre")
            pairs = pairs_of(seat.join(seat.select("centre", F.col("keys").alias("pkeys"), *as_pivot), "centre").filter(
                "comp < pcomp and arrays_overlap(keys, pkeys)"))
        if tried is not None:
            pairs = pairs.join(tried.select("x", "y"), ["x", "y"], "left_anti")
        new = store(counted(store(pairs, "minhash-pairs")), "minhash-tried")
        tried = new if tried is None else tried.union(new)
        links = tried.filter(similar).select(F.col("x").alias("a"), F.col("y").alias("b"))
        comps = store(connected_components(links), "minhash-components")
        release(docs.sparkSession)
        if step != "rest":
            named = store(members.join(comps.withColumnRenamed("component", "comp"), "id", "left").withColumn(
                "comp", F.coalesce("comp", "id")), "minhash-named")
            # only groups that still hold two components go on
            open_ = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
            named = store(named.join(store(open_.select("key"), "minhash-open"), "key"), "minhash-left")
            if unique is None:
                unique = store(unique_counts(named), "minhash-unique")
                near = tried.select(F.col("x").alias("id"), F.col("y").alias("pivot"), "both").union(
                    tried.select(F.col("y"), F.col("x"), "both"))
                seats = named.select("id", "key", "n").join(centres.select("key", "pivot", "pn"), "key")
                seats = seats.join(near, ["id", "pivot"], "left").withColumn(
                    "both", F.when(F.col("id") == F.col("pivot"), F.col("n")).otherwise(F.col("both")))
                seats = seats.join(unique, "id", "left").withColumn("u", F.coalesce("u", F.lit(0)))
                seats = store(seats.select("id", "key", "u", (F.col("pn") - F.col("both")).alias("lost"),
                                           (F.col("n") - F.col("both")).alias("added"),
                                           F.when(F.col("both").isNotNull(), F.greatest(F.col("n") - F.col("both") - F.col("u"), F.lit(0)))
                                           .alias("extra")), "minhash-seats")
            left = store(named.join(seats, ["id", "key"]), "minhash-counted")
    classes = store(reps.select("a", "b", "n", "id").join(comps, "id", "left").select(
        "a", "b", "n", F.coalesce("component", "id").alias("component_id")), "minhash-result")
    out = feats.drop("bands").join(classes, ["a", "b", "n"], "left")
    own = F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component_id")))
