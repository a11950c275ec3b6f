"""Windows, running totals and joins along one long order, without a task that holds it.

Rows are dealt out by ranges of the order, sorted, and written once with their range and
their place in it. What a range needs of the others is little and known from its edges:
the rows just before it (a halo), a total, or the last row of another kind. Ranges then
go to one task each, whatever the keys, so a key that has most of the rows is as many
tasks as it has ranges. The number of ranges is that of the shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import written

RANGE, PLACE = "_range", "_place"
#: Rows of an interval table that are broadcast for a nested loop at most.
FEW = 1000


def ranges_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, order: Iterable[str | Column], name: str = "ranges") -> DataFrame:
    """df with the range and the place in it of each row, from 0 on, in a written table: read again, rows keep both."""
    order = list(order)
    at = F.col("_at")
    rows = df.repartitionByRange(ranges_of(df), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # the id is the partition's number above 33 bits for the row's
    return written(rows.withColumn(RANGE, F.shiftright(at, 33).cast("int")).withColumn(PLACE, at.bitwiseAND((1 << 33) - 1)).drop("_at"), name)


def together(df: DataFrame) -> DataFrame:
    """Each range as one task; windows by range need no further exchange."""
    return df.repartitionById(ranges_of(df), F.col(RANGE))


def position(ts: str, kind: T.DataType) -> Column:
    """A time as whole microseconds, a number as it is, so that distances can be told."""
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(microsecond, timestamp_ntz'1970-01-01', `{ts}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(f"`{ts}`"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(f"`{ts}`")).cast("long") * 86_400_000_000
    if isinstance(kind, T.NumericType):
        return F.col(f"`{ts}`")
    raise ValueError(f"{ts} is neither a time nor a number: {kind.simpleString()}")


# ---------------------------------------------------------------- rolling windows


def _with_halo(rows: DataFrame, g: Column, wanted: Column) -> DataFrame:
    """Every row in its own range (_own), and again in each range that wants it; wanted is an array of ranges."""
    own = F.array(F.struct(F.col(RANGE).alias("p"), F.lit(True).alias("own")))
    again = F.transform(F.coalesce(wanted, F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), F.lit(False).alias("own")))
    rows = rows.withColumn("_g", g).withColumn("_to", F.explode(F.concat(own, again)))
    return together(rows.withColumn(RANGE, F.col("_to.p")).withColumn("_own", F.col("_to.own")).drop("_to"))


def rolling_rows(df: DataFrame, order: list[str], n: int, outputs: Mapping[str, Column], keys: tuple[str, ...] = (), min_periods: int = 1) -> DataFrame:
    """df with aggregates over the last n rows, this one included, in the order of a series or of each key's.

    Each is null where the frame has fewer than min_periods rows. A range gets the n - 1
    rows before it once more; n is best far below the rows of a range. Rows that are
    equal in order are taken in one order throughout, which the data don't determine.
    """
    parts = ranged(df, [*keys, *order])
    sizes = {r[RANGE]: r.n for r in parts.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each range
    start, at = {}, 0
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    to: dict[int, list[tuple[int, int]]] = {p: [] for p in start}
    for p in start:
        for q in sorted(start, reverse=True):
            if q < p and start[q] + sizes[q] > start[p] - (n - 1):
                to[q].append((p, start[p] - (n - 1)))
    moves = df.sparkSession.createDataFrame([(q, start[q], to[q]) for q in start], f"{RANGE} int, _start long, _moves array<struct<p:int,least:long>>")
    g = F.col("_start") + F.col(PLACE)
    rows = parts.join(F.broadcast(moves), RANGE)
    both = _with_halo(rows, g, F.transform(F.filter("_moves", lambda m: g >= m["least"]), lambda m: m["p"]))
    w = Window.partitionBy(RANGE, *keys).orderBy("_g").rowsBetween(-(n - 1), 0)
    enough = F.count(F.lit(1)).over(w) >= min_periods
    found = both.select(*(F.col(f"`{c}`") for c in df.columns), "_own", *(F.when(enough, c.over(w)).alias(k) for k, c in outputs.items()))
    return found.where("_own").drop("_own")


def _in_ranges_with_halo(df: DataFrame, ts: str, span: int, keys: tuple[str, ...]) -> DataFrame:
    """df by ranges along (keys, _t), each with the rows of the span before it once more."""
    parts = ranged(df.withColumn("_t", position(ts, df.schema[ts].dataType)), [*keys, "_t"])
    row = F.struct(F.struct(*keys, F.lit(0).alias("_")).alias("key"), F.col("_t").alias("t"))
    edges = {r[RANGE]: (r.first, r.last) for r in parts.groupBy(RANGE).agg(F.min_by(row, PLACE).alias("first"), F.max_by(row, PLACE).alias("last")).collect()}
    to: dict[int, list[tuple]] = {p: [] for p in edges}
    for p, (first, _) in edges.items():
        for q in sorted((q for q in edges if q < p), reverse=True):
            last = edges[q][1]
            if first.t is None or last.t is None or last.key != first.key or last.t < first.t - span:
                break
            to[q].append((p, first.t - span, first.key))
    kinds = {f.name: f.dataType for f in parts.schema.fields}
    key = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("_", T.IntegerType())])
    move = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("least", kinds["_t"]), T.StructField("key", key)])
    moves = df.sparkSession.createDataFrame(list(to.items()), T.StructType([T.StructField(RANGE, T.IntegerType()), T.StructField("_moves", T.ArrayType(move))]))
    rows = parts.join(F.broadcast(moves), RANGE)
    same = F.struct(*keys, F.lit(0).alias("_"))
    return _with_halo(rows, F.lit(0), F.transform(F.filter("_moves", lambda m: (F.col("_t") >= m["least"]) & m["key"].eqNullSafe(same)), lambda m: m["p"]))


def rolling_span(df: DataFrame, ts: str, span: int, outputs: Mapping[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """df with aggregates over the rows up to span before each (microseconds, for a time), it and its peers included, by keys if given.

    A range gets the rows of the span before it once more; rows of one key and time lie
    in one range, as each other's peers. Rows without a time have each other as peers.
    Spark goes through a frame anew for each row: where frames grow with the table, take
    rolling_moments() for counts, sums and deviations.
    """
    both = _in_ranges_with_halo(df, ts, span, keys)
    w = Window.partitionBy(RANGE, *keys).orderBy("_t").rangeBetween(-span, 0)
    found = both.select(*(F.col(f"`{c}`") for c in df.columns), "_own", *(c.over(w).alias(k) for k, c in outputs.items()))
    return found.where("_own").drop("_own")


def rolling_moments(df: DataFrame, ts: str, span: int, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with n (rows), total (of value) and sd (of the sample) over the rows that rolling_span() takes, at a cost that doesn't grow with their number.

    Time is cut into blocks as long as the span. The frame of a row is what its block has
    up to it, and what the block before has from the frame's start on: two totals that run
    once through a block, forwards and backwards, and are put together without any
    subtraction of sums. Times and whole numbers only.
    """
    if span < 1:
        raise ValueError(f"a span is at least 1: {span}")
    if isinstance(df.schema[ts].dataType, (T.FractionalType, T.DecimalType)):
        raise ValueError(f"{ts} is neither a time nor a whole number: {df.schema[ts].dataType.simpleString()}")
    both = _in_ranges_with_halo(df, ts, span, keys)
    sums = {"n": F.count(F.lit(1)), "k": F.count(f"`{value}`"), "s": F.sum(f"`{value}`"), "m": F.avg(f"`{value}`"), "v": F.var_pop(f"`{value}`")}
    up_to = Window.partitionBy(RANGE, *keys, "_block").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_block", F.col("_t") - F.pmod("_t", F.lit(span)))
    rows = rows.withColumn("_a", F.struct(*(c.over(up_to).alias(k) for k, c in sums.items())))
    # each own row looks from the start of its frame into the block before, and brings its columns along
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns), F.col("_a"), F.col("_t"))
    data = F.struct(F.col("_block").alias("b"), F.col("_t").alias("t"), F.col(f"`{value}`").alias("x"), F.lit(1).alias("real"), F.lit(None).cast(rows.select(own.alias("own")).schema["own"].dataType).alias("own"))
    look = F.struct((F.col("_block") - span).alias("b"), (F.col("_t") - span).alias("t"), F.lit(None).cast(df.schema[value].dataType).alias("x"), F.lit(None).cast("int").alias("real"), own.alias("own"))
    rows = rows.select(RANGE, *(F.col(f"`{k}`") for k in keys), F.explode(F.when(F.col("_own"), F.array(data, look)).otherwise(F.array(data))).alias("_l"))
    x, down = F.col("_l.x"), Window.partitionBy(RANGE, *keys, "_l.b").orderBy(F.desc("_l.t")).rangeBetween(Window.unboundedPreceding, 0)
    sums = {"n": F.count("_l.real"), "k": F.count(x), "s": F.sum(x), "m": F.avg(x), "v": F.var_pop(x)}
    rows = rows.select("_l.own", F.struct(*(c.over(down).alias(k) for k, c in sums.items())).alias("_b")).where("own is not null")
    a, b = F.col("own._a"), F.col("_b")
    timed = F.col("own._t").isNotNull()  # rows without a time are each other's peers, and look nowhere
    k = a["k"] + F.when(timed, b["k"]).otherwise(0)
    square = a["v"] * a["k"] + b["v"] * b["k"] + (a["m"] - b["m"]) * (a["m"] - b["m"]) * a["k"] * b["k"] / k
    square = F.when(~timed | (b["k"] == 0), a["v"] * a["k"]).when(a["k"] == 0, b["v"] * b["k"]).otherwise(square)
    total = F.when(~timed | (b["k"] == 0), a["s"]).when(a["k"] == 0, b["s"]).otherwise(a["s"] + b["s"])
    n = a["n"] + F.when(timed, b["n"]).otherwise(0)
    return rows.select(*(F.col("own")[c].alias(c) for c in df.columns), n.alias("n"), total.alias("total"), F.when(k > 1, F.sqrt(square / (k - 1))).alias("sd"))


def running(df: DataFrame, order: list[str | Column], value: Column | None = None, name: str = "running") -> DataFrame:
    """df with the running sum of value (the row number, if none) in a total order, and <name>_total.

    Sums within ranges are shifted by the totals of the ranges before; nulls add nothing,
    and where no row so far has a value the sum is null. A row number is its place in its
    range, shifted, so it needs no window.
    """
    parts = ranged(df if value is None else df.withColumn("_v", value), order)
    total = F.count(F.lit(1)) if value is None else F.sum("_v")
    totals = parts.groupBy(RANGE).agg(total.alias("_t"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(RANGE, F.sum("_t").over(before).alias("_s"), F.sum("_t").over(Window.partitionBy(F.lit(0))).alias(f"{name}_total"))
    if value is None:
        out = parts.join(F.broadcast(shifts), RANGE).withColumn(name, F.col(PLACE) + 1 + F.coalesce("_s", F.lit(0)))
        return out.drop(RANGE, PLACE, "_s")
    w = Window.partitionBy(RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    within = together(parts).withColumn("_w", F.sum("_v").over(w)).join(F.broadcast(shifts), RANGE)
    both = F.when(F.col("_w").isNull(), F.col("_s")).otherwise(F.col("_w") + F.coalesce("_s", F.lit(0)))
    return within.withColumn(name, both).drop("_v", "_w", "_s", RANGE, PLACE)


# ---------------------------------------------------------------- as-of join


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], direction: str = "backward", tolerance: int | None = None, tie: list[str] | None = None) -> DataFrame:
    """left with the values of right's row of the same keys at or before its time (backward), at or after it (forward), or nearest to it.

    Nearest prefers the earlier row of two equally far. Farther than tolerance
    (microseconds, for times) is no match. Of right's rows of one key and time the last
    by tie (its values, unless given) counts backward, the first forward. A null key or
    time matches nothing; each row of left gives one row. Both sides are laid along
    (keys, time) in ranges, and the last row of right is carried from range to range, so
    neither side is multiplied and a hot key is no single task.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"no such direction: {direction}")
    if set(values) & set(left.columns):
        raise ValueError(f"both sides have {sorted(set(values) & set(left.columns))}")
    tie = list(values if tie is None else tie)
    k = [f"_k{i}" for i in range(len(keys))]
    own = lambda df: [F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)]
    at = lambda df, ts: position(ts, df.schema[ts].dataType)
    source = right.select(*own(right), at(right, right_ts).alias("_t"), F.struct(*values).alias("v"), F.struct(*tie).alias("_tie")).where(" and ".join(f"{c} is not null" for c in ["_t", *k]))
    source = source.select(*k, "_t", F.lit(None).cast(_struct_of(left)).alias("_row"), F.struct(F.struct(*k, F.lit(0).alias("_")).alias("key"), F.col("_t").alias("t"), "v").alias("_v"), F.lit(2 if direction == "forward" else 0).alias("_side"), "_tie", F.lit(None).cast("long").alias("_h"))
    kinds = source.schema
    row = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    marked = left.select(*own(left), at(left, left_ts).alias("_t"), row.alias("_row"), F.lit(None).cast(kinds["_v"].dataType).alias("_v"), F.lit(1).alias("_side"), F.lit(None).cast(kinds["_tie"].dataType).alias("_tie"), F.xxhash64(row).alias("_h"))
    # rows of left at one time are told apart by a hash, so that these too can lie in several ranges
    parts = ranged(marked.unionByName(source), [*k, "_t", "_side", "_tie", "_h"], "asof")
    key = F.struct(*k, F.lit(0).alias("_"))

    def nearest(name: str, pick, order: Column, rows: tuple[int, int]) -> tuple[DataFrame, Column]:
        """right's row nearest before each, in an order: of its own range, or else of the ranges before; a row for each range holds the latter."""
        edges = parts.where("_v is not null").groupBy(RANGE).agg(pick("_v", PLACE).alias("_e"))
        every = parts.select(RANGE).distinct().join(F.broadcast(edges), RANGE, "left")
        by = F.col(RANGE) if order is ahead else F.desc(RANGE)
        before = F.last("_e", ignorenulls=True).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
        inner = F.last("_v", ignorenulls=True).over(Window.partitionBy(RANGE, *k).orderBy(order).rowsBetween(*rows))
        return every.select(RANGE, before.alias(name)), F.coalesce(inner, F.when(F.col(name)["key"] == key, F.col(name)))

    ahead, back = F.asc(PLACE), F.desc(PLACE)
    found, way = parts, {}
    if direction != "forward":
        edges, way["_b"] = nearest("_before", F.max_by, ahead, (Window.unboundedPreceding, 0))
        found = found.join(F.broadcast(edges), RANGE)
    if direction != "backward":
        edges, way["_f"] = nearest("_behind", F.min_by, back, (Window.unboundedPreceding, -1))
        found = found.join(F.broadcast(edges), RANGE)
    found = together(found).select("*", *(c.alias(n) for n, c in way.items())).where("_side = 1")
    far = {n: F.abs(F.col("_t") - F.col(f"{n}.t")) for n in way}
    best = F.col(next(iter(way)))
    if direction == "nearest":
        best = F.when(F.coalesce(far["_b"] <= far["_f"], F.col("_f").isNull()), F.col("_b")).otherwise(F.col("_f"))
    fits = F.col("_t").isNotNull()
    if tolerance is not None:
        fits &= F.abs(F.col("_t") - F.col("_best.t")) <= tolerance
    found = found.withColumn("_best", best)
    return found.select(*(F.col("_row")[c].alias(c) for c in left.columns), *(F.when(fits, F.col("_best.v")[v]).alias(v) for v in values))


def _struct_of(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])


# ---------------------------------------------------------------- interval join


def interval_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, keys: tuple[str, ...] = (), how: str = "inner", few: int = FEW) -> DataFrame:
    """left joined (inner or left) to the rows of right with low <= point < high, and equal keys.

    Up to `few` rows of right, by their count, are broadcast. Beyond, an interval goes
    into bins of a width, a power of four, that it is at most as long as, so it touches
    two or three of them; a point goes into its bin of every width that occurs, of which
    there are few. Bins are joined by hash or sort, and the bounds checked exactly. Null
    points, ends and keys match nothing, nor do intervals that end before they begin.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no such join: {how}")
    clash = set(left.columns) & (set(right.columns) - set(keys))
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    kind = left.schema[point].dataType
    right = right.where(F.col(low) < F.col(high))
    others = [c for c in right.columns if c not in keys]
    inside = (F.col("_x") >= F.col("_low")) & (F.col("_x") < F.col("_high"))
    same = [F.col(f"_r{i}") == F.col(k) for i, k in enumerate(keys)]
    ends = right.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)), *others, position(low, right.schema[low].dataType).alias("_low"), position(high, right.schema[high].dataType).alias("_high"))
    points = left.withColumn("_x", position(point, kind))
    if few and len(ends.limit(few + 1).select(F.lit(1)).collect()) <= few:
        condition = inside
        for s in same:
            condition &= s
        return points.join(F.broadcast(ends), condition, how).select(*left.columns, *others)
    if how == "left":
        points = written(points.withColumn("_id", F.monotonically_increasing_id()), "points")
    power = lambda c: F.ceil(F.log2(F.greatest(c.cast("double"), F.lit(1e-300))) / 2)
    # bins as fine as the ends can be told apart: the number of one stays below 2 ** 52
    level = F.greatest(power(F.col("_high") - F.col("_low")), power(F.greatest(F.abs("_low"), F.abs("_high"))) - 25).cast("int")
    binned = written(ends.withColumn("_level", level), "intervals")
    levels = sorted(r._level for r in binned.select("_level").distinct().collect())  # a few exponents
    first, last = (F.floor(F.col(c).cast("double") / F.pow(F.lit(4.0), "_level")) for c in ("_low", "_high"))
    binned = binned.withColumn("_bin", F.explode(F.sequence(first, last)))
    spread = F.array(*(F.struct(F.lit(v).alias("l"), F.floor(F.col("_x").cast("double") / 4.0**v).alias("b")) for v in levels)) if levels else F.array().cast("array<struct<l:int,b:bigint>>")
    at = points.where("_x is not null").withColumn("_at", F.explode(spread))
    condition = (F.col("_at.l") == F.col("_level")) & (F.col("_at.b") == F.col("_bin"))
    for s in same:
        condition &= s
    pairs = at.join(binned, condition & inside)
    if how == "inner":
        return pairs.select(*left.columns, *others)
    hit = pairs.select("_id", *left.columns, *others)
    missed = points.join(hit.select("_id").distinct(), "_id", "left_anti")
    return hit.drop("_id").unionByName(missed.select(*left.columns), allowMissingColumns=True)
