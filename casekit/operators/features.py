"""Customer features: grouped aggregates and rolling day windows.

``base_aggregations`` and ``rolling_window_aggregations`` keep the keyword
signatures of the reference's feature tools and run them as Spark plans;
``build_features`` plans a list of typed specs: steps that read the same columns
with the same keys share one daily table, one window stage and one join back,
whatever their number.

Scale notes
-----------
* Grouped aggregates use partial (map-side) aggregation, so a key holding a
  third of all rows is combined per task before the shuffle.
* ``mode="attach"`` does not use a key-partitioned window (which would put a
  hot key's rows into one task); it aggregates and joins the small result
  back -- a broadcast hash join when AQE sees it is small, else a sort-merge
  join whose skewed partitions AQE splits.  Without keys the aggregate is a
  scalar subquery.
* Rolling windows first combine rows to (key, day) partials (map-side), window
  over those -- at most one row per key and day, so no task grows with a hot
  key's rows -- and join the results back on (key, day).  Inputs declared to
  hold one row per key and day (checked while they are windowed) are windowed as
  they are: one read, one shuffle, no join.
* Distinct counts do not combine from daily counts.  Exact ones come from
  intervals: a value seen on a day covers the windows that end on that day up to
  the day before it is seen next (or leaves the window), so each window covers a
  value once, and a running sum of interval starts and ends over the days counts
  them -- one row per key, value and day, whatever the window sizes.
* Approximate ones combine from daily HyperLogLog sketches, which can be kept
  as a table and merged with those of later runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

AGG_FUNCS = {
    "sum": F.sum, "avg": F.avg, "mean": F.avg, "average": F.avg, "count": F.count,
    "min": F.min, "max": F.max, "stddev": F.stddev, "count_distinct": F.count_distinct,
    "approx_count_distinct": F.approx_count_distinct,
}
_AVERAGES = ("avg", "mean", "average")
_COUNTS = ("count", "count_distinct", "approx_count_distinct")
# Sketches of 2^12 registers: a relative standard error of 1.6 %.
SKETCH_LG_K = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LG_K / 2)
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _funcs(agg_func: str | list[str]) -> list[str]:
    funcs = [agg_func] if isinstance(agg_func, str) else list(agg_func)
    bad = [f for f in funcs if f.lower() not in AGG_FUNCS]
    if bad:
        raise ValueError(f"unsupported aggregate(s) {bad}; allowed: {sorted(AGG_FUNCS)}")
    return [f.lower() for f in funcs]


def _check_columns(df: DataFrame, cols: list[str], what: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: unknown column(s) {missing}; have {df.columns}")


def _round(c: Column, places: int | None, fname: str) -> Column:
    if places is None or fname in _COUNTS:
        return c
    return F.round(c, places)


# ------------------------------------------------------------ G1 - G6 --
def base_aggregations(df: DataFrame, agg_func: str | list[str], cols_to_agg: list[str] | None = None,
                      group_by_cols: list[str] | None = None, round_dec_points: int | None = 2,
                      mode: str = "group") -> DataFrame:
    """Aggregate ``cols_to_agg`` with ``agg_func`` per ``group_by_cols``.

    Output columns are named ``{func}_{col}``.  ``group_by_cols=None`` gives
    one global row; ``cols_to_agg=None`` means every numeric non-key column
    (``count`` with no columns counts rows as ``count_rows``).  ``mode=
    "attach"`` keeps the input rows and adds the aggregates to each.
    """
    keys = list(group_by_cols or [])
    _check_columns(df, keys, "group_by_cols")
    funcs = _funcs(agg_func)
    if cols_to_agg is None:
        cols = [f.name for f in df.schema.fields
                if f.name not in keys and isinstance(f.dataType, _NUMERIC)]
    else:
        cols = list(cols_to_agg)
        _check_columns(df, cols, "cols_to_agg")
    exprs = []
    for fn in funcs:
        if fn == "count" and cols_to_agg is None:
            exprs.append(F.count(F.lit(1)).alias("count_rows"))
            continue
        exprs += [_round(AGG_FUNCS[fn](F.col(c)), round_dec_points, fn).alias(f"{fn}_{c}") for c in cols]
    if mode == "group":
        return df.groupBy(*keys).agg(*exprs)
    if mode != "attach":
        raise ValueError("mode must be 'group' or 'attach'")
    return _join_back(df, df.groupBy(*keys).agg(*exprs), keys)


def _join_back(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Add the columns of ``found`` (one row per key) to every row."""
    names = [c for c in found.columns if c not in keys]
    if clash := [n for n in names if n in rows.columns]:
        raise ValueError(f"feature(s) {clash} are there already")
    if not keys:
        one = found.select(F.struct(*names).alias("__a")).scalar()
        return rows.withColumns({n: one[n] for n in names})
    found = found.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *names)
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return rows.join(found, same, "left").drop(*[f"__k_{k}" for k in keys])


# -------------------------------------------------------------- W1 - W3 --
def _frame(size: int, offset: int) -> tuple[int, int]:
    """``size`` calendar days ending ``offset`` days before the row's day."""
    if size < 1 or offset < 0:
        raise ValueError("window sizes must be >= 1 day and the offset >= 0")
    return -(size - 1) - offset, -offset


def _feature_name(fn: str, col: str, size: int, offset: int) -> str:
    return f"{fn}_{col}_{size}d" + (f"_off{offset}" if offset else "")


def rolling_window_aggregations(df: DataFrame, partition_cols: list[str], order_col: str,
                                agg_func: str | list[str], num_cols_to_agg: list[str],
                                window_size_in_days: list[int] | int, window_offset: int = 0,
                                round_dec_points: int | None = 2, one_row_per_day: bool = False) -> DataFrame:
    """Add one column per (function, column, window size): the aggregate
    over the rows of the same partition whose day lies in the window.

    The frame is a RANGE over day numbers (``unix_date``): gaps in dates do
    not stretch it and rows of the same day are peers; rows without a day are
    peers of each other.  A window of ``w`` days with offset ``o`` covers days
    ``[d-(w-1)-o, d-o]``.  Sums and averages of decimals are exact; ``stddev``
    (sample) is a double, merged from the days' counts, means and squared
    deviations, and null for fewer than two values.  ``count_distinct`` is
    exact and takes columns of any type; ``approx_count_distinct`` is estimated
    from daily sketches.  ``one_row_per_day`` declares that no two rows share
    partition and day; rows that do raise.
    """
    return Rolling(partition_cols, order_col, agg_func, num_cols_to_agg, window_size_in_days, window_offset,
                   round_dec_points, one_row_per_day).apply(df)


def _sketched(c: str) -> Column:
    """Sketches take strings and whole numbers; other types go in as text."""
    return F.col(c).cast("string")


def _partials(funcs: dict[str, set[str]], by_row: bool) -> dict[str, Column]:
    """Columns that combine over days, for the functions needed per column;
    ``by_row``: a row is its day's only one."""
    out: dict[str, Column] = {}
    for c, fns in funcs.items():
        x = F.col(c).cast("double")
        if fns & {"sum", *_AVERAGES}:
            out[f"__s_{c}"] = F.col(c) if by_row else F.sum(c)
        if fns & {"count", "stddev", *_AVERAGES}:
            out[f"__n_{c}"] = F.col(c).isNotNull().cast("long") if by_row else F.count(c)
        if "min" in fns:
            out[f"__lo_{c}"] = F.col(c) if by_row else F.min(c)
        if "max" in fns:
            out[f"__hi_{c}"] = F.col(c) if by_row else F.max(c)
        if "stddev" in fns:
            out[f"__m_{c}"] = x if by_row else F.avg(x)
            out[f"__q_{c}"] = F.when(x.isNotNull(), F.lit(0.0)) if by_row else F.var_pop(x) * F.count(c)
        if "approx_count_distinct" in fns and not by_row:
            out[f"__h_{c}"] = F.hll_sketch_agg(_sketched(c), F.lit(SKETCH_LG_K))
    return out


def _over_days(fn: str, c: str, w: WindowSpec) -> Column:
    """An aggregate over a window's daily partials of column ``c``."""
    if fn == "min":
        return F.min(f"__lo_{c}").over(w)
    if fn == "max":
        return F.max(f"__hi_{c}").over(w)
    if fn == "approx_count_distinct":
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"__h_{c}").over(w)), F.lit(0).cast("long"))
    if fn == "sum":
        return F.sum(f"__s_{c}").over(w)
    n = F.sum(f"__n_{c}").over(w)
    if fn == "count":
        return F.coalesce(n, F.lit(0)).cast("long")
    if fn == "stddev":
        weight, d = F.col(f"__n_{c}"), F.col(f"__d_{c}")
        squares = F.sum(F.col(f"__q_{c}") + weight * d * d).over(w) - F.pow(F.sum(weight * d).over(w), 2) / n
        return F.when(n > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (n - 1)))
    return F.try_divide(F.sum(f"__s_{c}").over(w), n)


def _distinct_counts(staged: DataFrame, keys: list[str], c: str, windows: list[tuple[int, int]]) -> DataFrame:
    """(keys, ``__day``, one count per window): exact distinct values of ``c``
    on every day that a key has rows."""
    seen = staged.filter(F.col(c).isNotNull()).groupBy(*keys, "__day", F.col(c).alias("__v")).agg(F.lit(1).alias("__1"))
    # Rows without a day stand apart: a value of theirs is never followed by another day.
    later = F.lead("__day").over(Window.partitionBy(*keys, "__v", F.isnull("__day")).orderBy("__day"))
    marks = []
    for i, (size, offset) in enumerate(windows):
        day = F.col("__day") + offset
        marks += [F.struct(day.alias("__day"), F.lit(i).alias("__w"), F.lit(1).alias("__d")),
                  F.struct(F.least(day + size, F.col("__next") + offset).alias("__day"), F.lit(i).alias("__w"), F.lit(-1).alias("__d"))]
    marks = seen.withColumn("__next", later).select(*keys, F.isnull("__day").alias("__none"), F.explode(F.array(*marks)).alias("__m"))
    marks = marks.filter(~F.col("__none") | (F.col("__m.__d") > 0)).select(*keys, "__m.*")
    nothing = F.lit(None).cast("int")
    days = staged.select(*keys, "__day").distinct().select(*keys, "__day", nothing.alias("__w"), nothing.alias("__d"))
    change = [F.coalesce(F.sum(F.when(F.col("__w") == i, F.col("__d"))), F.lit(0)).alias(f"__c{i}") for i in range(len(windows))]
    by_day = marks.unionByName(days).groupBy(*keys, "__day").agg(*change, F.max(F.isnull("__w")).alias("__own"))
    until = Window.partitionBy(*keys, F.isnull("__day")).orderBy("__day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return by_day.select(*keys, "__day", "__own", *[
        F.sum(f"__c{i}").over(until).cast("long").alias(_feature_name("count_distinct", c, *w)) for i, w in enumerate(windows)
    ]).filter("__own").drop("__own")


# ------------------------------------------------- G2 / W1 kept sketches --
def daily_sketches(df: DataFrame, keys: list[str], order_col: str, cols: list[str]) -> DataFrame:
    """(keys, ``day``, ``sketch_{col}``): one HyperLogLog sketch per key, day and column."""
    _check_columns(df, keys + [order_col] + cols, "daily_sketches")
    return df.groupBy(*keys, F.to_date(F.col(order_col)).alias("day")).agg(
        *[F.hll_sketch_agg(_sketched(c), F.lit(SKETCH_LG_K)).alias(f"sketch_{c}") for c in cols])


def merge_sketches(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """One table of daily sketches from several (of other runs, sources or late
    rows); their days may overlap, and values they share count once."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    names = [c for c in both.columns if c.startswith("sketch_")]
    return both.groupBy(*keys, "day").agg(*[F.hll_union_agg(n).alias(n) for n in names])


def sketched_distinct_counts(sketches: DataFrame, keys: list[str], sizes: list[int], offset: int = 0) -> DataFrame:
    """(keys, ``day``, ``approx_count_distinct_{col}_{w}d``) from daily sketches alone."""
    names = [c for c in sketches.columns if c.startswith("sketch_")]
    base = Window.partitionBy(*keys).orderBy("__day")
    new = {}
    for size in sizes:
        w = base.rangeBetween(*_frame(size, offset))
        for n in names:
            found = F.hll_sketch_estimate(F.hll_union_agg(n).over(w))
            new[_feature_name("approx_count_distinct", n.removeprefix("sketch_"), size, offset)] = F.coalesce(found, F.lit(0).cast("long"))
    return sketches.withColumn("__day", F.unix_date("day")).select(*keys, "day", *[e.alias(n) for n, e in new.items()])


# ------------------------------------------------------------------ G4 --
def daily_totals(df: DataFrame, keys: list[str], date_col: str, type_cols: list[str],
                 total_name: str = "total_event_cnt", round_dec_points: int | None = 2) -> DataFrame:
    """Per key and day: the summed type counters and their row-wise total."""
    g = base_aggregations(df, "sum", type_cols, keys + [date_col], round_dec_points)
    total = sum((F.coalesce(F.col(f"sum_{c}"), F.lit(0.0)) for c in type_cols), F.lit(0.0))
    return g.withColumn(total_name, _round(total, round_dec_points, "sum"))


# ------------------------------------------------------------------ C1 --
@dataclass
class BaseAgg:
    agg_func: str | list[str]
    cols_to_agg: list[str] | None = None
    group_by_cols: list[str] | None = None
    round_dec_points: int | None = 2
    mode: str = "group"

    def apply(self, df: DataFrame) -> DataFrame:
        return base_aggregations(df, self.agg_func, self.cols_to_agg, self.group_by_cols,
                                 self.round_dec_points, self.mode)


@dataclass
class Rolling:
    partition_cols: list[str]
    order_col: str
    agg_func: str | list[str]
    num_cols_to_agg: list[str]
    window_size_in_days: list[int] | int = field(default_factory=lambda: [7])
    window_offset: int = 0
    round_dec_points: int | None = 2
    one_row_per_day: bool = False

    @property
    def windows(self) -> list[tuple[int, int]]:
        sizes = self.window_size_in_days
        return [(size, self.window_offset) for size in ([sizes] if isinstance(sizes, int) else sizes)]

    def apply(self, df: DataFrame) -> DataFrame:
        return build_features(df, [self])


def _reads(spec: BaseAgg | Rolling) -> list[str]:
    if isinstance(spec, Rolling):
        return [*spec.partition_cols, spec.order_col, *spec.num_cols_to_agg]
    return [*(spec.group_by_cols or []), *(spec.cols_to_agg or [])]


def _shared_days(df: DataFrame, specs: list[BaseAgg | Rolling]) -> list[BaseAgg | Rolling | list]:
    """Specs of one stage in order; those that one daily table answers are a
    list: Rolling steps of equal keys and order, and the attached aggregates
    over these keys that combine from days."""
    out: list = []
    groups: dict[tuple, list] = {}
    for spec in specs:
        if isinstance(spec, Rolling):
            key = (tuple(spec.partition_cols), spec.order_col, spec.one_row_per_day)
            if key not in groups:
                groups[key] = []
                out.append(groups[key])
            groups[key].append(spec)
        else:
            out.append(spec)
    for spec in [s for s in out if isinstance(s, BaseAgg)]:
        same = [g for key, g in groups.items() if key[0] == tuple(spec.group_by_cols or [])]
        # Sums and averages of decimals would change their type.
        fixed = any(isinstance(df.schema[c].dataType, T.DecimalType) for c in spec.cols_to_agg)
        if same and set(_funcs(spec.agg_func)) <= ({"min", "max", "count"} | (set() if fixed else {"sum", "stddev", *_AVERAGES})):
            same[0].append(spec)
            out = [s for s in out if s is not spec]
    return out


def _from_days(rows: DataFrame, df: DataFrame, specs: list[BaseAgg | Rolling]) -> DataFrame:
    """Add the features of ``specs`` (equal keys and order, computed on ``df``) to ``rows``."""
    first = next(s for s in specs if isinstance(s, Rolling))
    keys, by_row = list(first.partition_cols), first.one_row_per_day
    funcs: dict[str, set[str]] = {}
    distinct: dict[str, list[tuple[int, int]]] = {}
    for spec in specs:
        fns = set(_funcs(spec.agg_func))
        for c in spec.num_cols_to_agg if isinstance(spec, Rolling) else spec.cols_to_agg:
            funcs.setdefault(c, set()).update(fns - {"count_distinct"})
            if "count_distinct" in fns:
                distinct.setdefault(c, []).extend(w for w in spec.windows if w not in distinct.get(c, []))
    day = F.unix_date(F.to_date(F.col(first.order_col)))
    staged, parts = df.withColumn("__day", day), _partials(funcs, by_row)
    if by_row:
        daily = rows.withColumns({"__day": day} | parts)
        for c, fns in funcs.items():
            if "approx_count_distinct" in fns:
                raise ValueError("approx_count_distinct over rows declared one per day: use count_distinct")
    else:
        daily = staged.groupBy(*keys, "__day").agg(*[p.alias(n) for n, p in parts.items()] or [F.lit(1).alias("__1")])
    base = Window.partitionBy(*keys).orderBy("__day")
    whole = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Deviations from the key's first mean: no large squares cancel.
    daily = daily.withColumns({f"__d_{c}": F.col(f"__m_{c}") - F.first(f"__m_{c}", ignorenulls=True).over(whole)
                               for c, fns in funcs.items() if "stddev" in fns})
    new: dict[str, Column] = {}
    for spec in specs:
        fns, places = _funcs(spec.agg_func), spec.round_dec_points
        if isinstance(spec, BaseAgg):
            new |= {f"{fn}_{c}": _round(_over_days(fn, c, whole), places, fn) for fn in fns for c in spec.cols_to_agg}
            continue
        for size, offset in spec.windows:
            w = base.rangeBetween(*_frame(size, offset))
            new |= {_feature_name(fn, c, size, offset): F.col(_feature_name(fn, c, size, offset)) if fn == "count_distinct"
                    else _round(_over_days(fn, c, w), places, fn) for fn in fns for c in spec.num_cols_to_agg}
    if clash := [n for n in new if n in rows.columns]:
        raise ValueError(f"feature(s) {clash} are there already")
    own = {n: e for n, e in new.items() if not n.startswith("count_distinct_")}
    if by_row:
        # Checked in the same sort: two rows of one day stop the job.
        twice = F.lag("__day").over(base) == F.col("__day")
        error = F.raise_error(F.lit(f"two rows of one {', '.join(keys)} and day, declared one_row_per_day"))
        found = daily.withColumn("__ok", F.when(twice, error).otherwise(F.lit(True)))
        found = found.select(*rows.columns, "__day", "__ok", *[e.alias(n) for n, e in own.items()]).filter("__ok").drop("__ok")
    else:
        # All columns share one partitioning and ordering: one shuffle, one sort.
        found = daily.select(*keys, "__day", *[e.alias(n) for n, e in own.items()])
    for c, windows in distinct.items():
        found = _join_back(found, _distinct_counts(staged, keys, c, windows), [*keys, "__day"])
    if by_row:
        return found.select(*rows.columns, *new)
    return _join_back(rows.withColumn("__day", day), found, [*keys, "__day"]).select(*rows.columns, *new)


def build_features(df: DataFrame, specs: list[BaseAgg | Rolling]) -> DataFrame:
    """Apply ``specs`` in order; columns are checked before anything runs.

    Steps that read no feature of the steps before them are one stage, and all
    are computed from the stage's input: per set of equal keys one daily table
    and one join back, however many steps.  A step that reads earlier features,
    a grouping step, or one over all numeric columns begins a new stage.
    """
    out, todo = df, list(specs)
    while todo:
        stage: list[BaseAgg | Rolling] = []
        for spec in todo:
            alone = isinstance(spec, BaseAgg) and (spec.mode != "attach" or spec.cols_to_agg is None)
            if stage and (alone or not set(_reads(spec)) <= set(out.columns)):
                break
            stage.append(spec)
            if alone:
                break
        todo = todo[len(stage):]
        for spec in stage:
            _check_columns(out, _reads(spec), type(spec).__name__)
            _funcs(spec.agg_func)
        if isinstance(stage[0], BaseAgg) and len(stage) == 1:
            out = stage[0].apply(out)
            continue
        source = out
        order: list[str] = []
        for step in _shared_days(source, stage):
            if isinstance(step, list):
                out = _from_days(out, source, step)
            else:
                out = _join_back(out, replace(step, mode="group").apply(source), list(step.group_by_cols or []))
        for spec in stage:  # features stand in the order of the steps
            order += [n for n in _names(spec) if n not in order]
        out = out.select(*source.columns, *order)
    return out


def _names(spec: BaseAgg | Rolling) -> list[str]:
    if isinstance(spec, Rolling):
        return [_feature_name(fn, c, *w) for w in spec.windows for fn in _funcs(spec.agg_func) for c in spec.num_cols_to_agg]
    return [f"{fn}_{c}" for fn in _funcs(spec.agg_func) for c in spec.cols_to_agg]
