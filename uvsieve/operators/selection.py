"""Exact quantiles of groups of any size, by distributed selection.

No group meets in one buffer. A group's wanted rank lies in a bracket of values, at first from the least to the largest. Each round takes a sketch of the values in the bracket (of bounded
size), proposes a narrower bracket around the rank, and counts the rows below and within it; the counts tell where the rank is, whatever the sketch's error. A bracket of one value, or of
at most ``limit`` rows, is settled: only such rows are gathered, as values and counts. Rows are only read; what is shuffled are sketches, counts and the last few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.thresholds import MAD_SCALE
from ..sources.checkpoints import settled

#: Rows that a rank's bracket may end with.
LIMIT = 200_000
#: Steps of the sketch: a round leaves about three in so many rows.
STEPS = 200
#: Groups and quantiles (of about 100 bytes) whose brackets go to the rows by broadcast, so that rows stay where they are; beyond, both sides are shuffled by group.
MAX_BROADCAST = 100_000
#: Of a group and wanted quantile: rank, part of the next rank, bracket, rows below and within it, and the least value above it.
STATE = ("_rank", "_part", "_low", "_high", "_below", "_inside", "_next")


def brackets(rows: DataFrame, keys: list[str], value: str = "value", at: tuple[float, ...] = (0.5,), limit: int = LIMIT, start: DataFrame | None = None) -> DataFrame:
    """(keys, _n, _t, STATE): for each group and quantile number ``_t`` a bracket with at most ``limit`` rows, or of one value.

    ``start(keys, _t, _try_low, _try_high)``: brackets to try first, such as those of like rows; groups without one begin with a sketch. Null values don't count."""
    x = F.col(value)
    groups = rows.groupBy(*keys).agg(F.count(x).alias("_n"), F.min(x).cast("double").alias("_low"), F.max(x).cast("double").alias("_high")).where(F.col("_n") > 0)
    place = [(F.col("_n") - 1) * F.lit(float(q)) for q in at]
    wanted = F.array(*[F.struct(F.lit(k).alias("_t"), (F.floor(p) + 1).alias("_rank"), (p - F.floor(p)).alias("_part")) for k, p in enumerate(place)])
    state = groups.select("*", F.inline(wanted)).withColumn("_below", F.lit(0).cast("long")).withColumn("_inside", F.col("_n")).withColumn("_next", F.lit(None).cast("double"))
    state = settled(state.select(*keys, "_n", "_t", *STATE))
    named = [*keys, "_t"]
    if start is not None:
        tried = state.join(start.select(*named, "_try_low", "_try_high"), named).where((F.col("_try_low") <= F.col("_high")) & (F.col("_try_high") >= F.col("_low")))
        state = settled(_counted(rows, keys, value, state, settled(tried)))
    wide = (F.col("_inside") > limit) & (F.col("_low") < F.col("_high"))
    while state.where(wide).limit(1).count():
        state = settled(_counted(rows, keys, value, state, settled(_proposed(rows, keys, value, state.where(wide)))))
    return state


def sent(table: DataFrame) -> DataFrame:
    """A settled table of groups, to be broadcast if it has at most ``MAX_BROADCAST`` rows."""
    return F.broadcast(table) if table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else table


def _within(rows: DataFrame, keys: list[str], value: str, state: DataFrame, *more: str) -> DataFrame:
    return rows.select(*keys, F.col(value).cast("double").alias("_x")).join(sent(state.select(*keys, "_t", "_low", "_high", *more)), keys).where(F.col("_x").between(F.col("_low"), F.col("_high")))


def _proposed(rows: DataFrame, keys: list[str], value: str, state: DataFrame) -> DataFrame:
    """``state`` with a narrower bracket to try around each rank, from a sketch of the rows within."""
    steps = F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)])
    sketch = _within(rows, keys, value, state).groupBy(*keys, "_t").agg(F.percentile_approx("_x", steps, 4 * STEPS).alias("_e"))
    part = (F.col("_rank") - F.col("_below")) / F.col("_inside") * STEPS
    low, high = F.greatest(F.floor(part) - 1, F.lit(0)), F.least(F.ceil(part) + 1, F.lit(STEPS))
    edge = lambda k: F.element_at("_e", (k + 1).cast("int"))
    tried = state.join(sketch, [*keys, "_t"]).withColumn("_try_low", F.when(low == 0, F.col("_low")).otherwise(edge(low))).withColumn("_try_high", F.when(high == STEPS, F.col("_high")).otherwise(edge(high)))
    # where that is no narrower, as among few different values, the sketch's value at the rank alone is tried: whatever the counts say, the bracket loses a value
    same = (F.col("_try_low") <= F.col("_low")) & (F.col("_try_high") >= F.col("_high"))
    one = edge(F.least(F.greatest(F.round(part), F.lit(0)), F.lit(STEPS)))
    return tried.withColumn("_one", F.when(same, one)).withColumn("_try_low", F.coalesce("_one", "_try_low")).withColumn("_try_high", F.coalesce("_one", "_try_high")).drop("_e", "_one")


def _counted(rows: DataFrame, keys: list[str], value: str, state: DataFrame, tried: DataFrame) -> DataFrame:
    """``state``, narrowed where a bracket was tried: to that bracket, or to what lies below or above it, as the counts tell."""
    x, low, high = F.col("_x"), F.col("_try_low"), F.col("_try_high")
    counts = _within(rows, keys, value, tried, "_try_low", "_try_high").groupBy(*keys, "_t").agg(
        F.count_if(x < low).alias("_less"), F.count_if(x.between(low, high)).alias("_mid"), F.max(F.when(x < low, x)).alias("_top"), F.min(F.when(x >= low, x)).alias("_from"), F.min(F.when(x > high, x)).alias("_beyond"),
    )
    found = state.join(tried.select(*keys, "_t", "_try_low", "_try_high"), [*keys, "_t"], "left").join(counts, [*keys, "_t"], "left")
    known, rank = F.col("_mid").isNotNull(), F.col("_rank") - F.col("_below")
    before, inside = known & (rank <= F.col("_less")), known & (rank > F.col("_less")) & (rank <= F.col("_less") + F.col("_mid"))
    beyond = known & (rank > F.col("_less") + F.col("_mid"))

    def choose(a: Column, b: Column, c: Column, name: str) -> Column:
        return F.when(before, a).when(inside, b).when(beyond, c).otherwise(F.col(name)).alias(name)

    col = F.col
    return found.select(
        *keys, "_n", "_t", "_rank", "_part", choose(col("_low"), F.greatest("_try_low", "_low"), col("_beyond"), "_low"), choose(col("_top"), F.least("_try_high", "_high"), col("_high"), "_high"),
        choose(col("_below"), col("_below") + col("_less"), col("_below") + col("_less") + col("_mid"), "_below"), choose(col("_less"), col("_mid"), col("_inside") - col("_less") - col("_mid"), "_inside"),
        choose(F.coalesce("_from", "_next"), F.coalesce("_beyond", "_next"), col("_next"), "_next"),
    )


def picked(rows: DataFrame, keys: list[str], value: str, state: DataFrame) -> DataFrame:
    """(keys, _t, _n, _q): the values at the ranks of ``brackets``; between two ranks in proportion."""
    alone = F.col("_low") == F.col("_high")
    several = state.where(~alone)
    times = _within(rows, keys, value, several, "_below", "_rank").groupBy(*keys, "_t", "_x").agg(F.count("*").alias("_m"), F.first("_below").alias("_below"), F.first("_rank").alias("_rank"))
    upto = times.withColumn("_upto", F.col("_below") + F.sum("_m").over(Window.partitionBy(*keys, "_t").orderBy("_x")))
    reached = lambda k: F.min(F.when(F.col("_upto") >= F.col("_rank") + k, F.col("_x")))
    ends = upto.groupBy(*keys, "_t").agg(reached(0).alias("_a"), reached(1).alias("_b"))
    single = state.where(alone).select(*keys, "_t", F.col("_low").alias("_a"), F.when(F.col("_rank") < F.col("_below") + F.col("_inside"), F.col("_low")).alias("_b"))
    found = state.join(ends.unionByName(single), [*keys, "_t"])
    following = F.coalesce("_b", "_next", "_a")
    return found.select(*keys, "_t", "_n", F.when(F.col("_part") == 0, F.col("_a")).otherwise((1 - F.col("_part")) * F.col("_a") + F.col("_part") * following).alias("_q"))


def quantiles(rows: DataFrame, keys: list[str], value: str = "value", at: tuple[float, ...] = (0.5,), limit: int = LIMIT) -> DataFrame:
    """(keys, n, q0, q1, ...): exact quantiles of each group, between two values in proportion. ``rows`` are read several times: settle them if they are dear to make.

    Groups without a value are absent; null values don't count; NaN counts as larger than any number."""
    found = picked(rows, keys, value, brackets(rows, keys, value, at, limit))
    return found.groupBy(*keys).agg(F.first("_n").alias("n"), *[F.max(F.when(F.col("_t") == k, F.col("_q"))).alias(f"q{k}") for k in range(len(at))])


def medians_and_mads(rows: DataFrame, keys: list[str], value: str = "value", scale: float = MAD_SCALE, limit: int = LIMIT) -> DataFrame:
    """(keys, n, median, mad): exact medians and scaled median absolute deviations, both by selection."""
    middle = settled(quantiles(rows, keys, value, limit=limit).withColumnRenamed("q0", "median"))
    apart = rows.join(sent(middle.select(*keys, "median")), keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("_apart"))
    spread = quantiles(apart, keys, "_apart", limit=limit)
    return middle.join(spread.select(*keys, (F.col("q0") * scale).alias("mad")), keys)
