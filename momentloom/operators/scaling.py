"""Building blocks that keep one huge recording from landing in one task.

Windows and joins over a timeline are keyed by the recording *and* a block of its
timeline. What crosses a block border is carried by a table with one row per block,
which is thousands of times smaller than the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import stage

__all__ = ["block_of", "spread_interval", "running", "runs", "point_in_interval",
           "interval_overlap", "top_n", "keys_equal", "spaced", "neighbours", "nearest", "numbered",
           "let", "fold_rows"]

_BLK = "_blk"
#: Partitions of ``neighbours`` for each shuffle partition of the session.
SORT_PARTS = 4
#: Rows of a block of ``spaced``: a power of two, so that a position is the low bits of a rank.
RANK_BITS = 10


def block_of(col, width: int) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col / F.lit(width)).cast("bigint")


def spread_interval(start, end, width: int) -> Column:
    """All block numbers touched by the half-open interval [start, end)."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    first = block_of(start, width)
    last = F.greatest(first, block_of(F.ceil(end) - 1, width))
    return F.explode(F.sequence(first, last))


def keys_equal(right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column, list[str]]:
    """Rename the key columns of ``right`` so that a condition can tell the sides apart."""
    renamed = {k: f"_r_{k}" for k in keys}
    right = right.select(*[F.col(c).alias(renamed.get(c, c)) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(r) for k, r in renamed.items()])
    return right, cond, list(renamed.values())


def running(df: DataFrame, keys: list[str], order: list, block: Column,
            **cols: tuple[str, Column]) -> DataFrame:
    """Add running aggregates over the rows **before** each row of its key.

    ``cols`` maps a new column to ``(kind, expression)``, kind being ``sum``, ``max`` or
    ``count``. ``block`` must not decrease along ``order``. Blocks are scanned
    independently; a row-per-block table carries their totals forward. ``df`` is read
    twice: ``stage`` it first when it is expensive.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    agg = {"sum": F.sum, "max": F.max, "count": F.count}
    merge = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
             "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
             "max": lambda a, b: F.greatest(a, b)}
    names = df.columns
    base = df.withColumn(_BLK, block)
    for name, (_, expr) in cols.items():
        base = base.withColumn(f"_in_{name}", expr)
    here = (W.partitionBy(*keys, _BLK).orderBy(*order)
            .rowsBetween(W.unboundedPreceding, -1))
    local = base.select(
        "*", *[agg[k](F.col(f"_in_{n}")).over(here).alias(f"_loc_{n}")
               for n, (k, _) in cols.items()])
    totals = base.groupBy(*keys, _BLK).agg(
        *[agg[k](F.col(f"_in_{n}")).alias(f"_tot_{n}") for n, (k, _) in cols.items()])
    before = (W.partitionBy(*keys).orderBy(_BLK)
              .rowsBetween(W.unboundedPreceding, -1))
    carry = totals.select(
        *keys, _BLK, *[{"count": F.sum}.get(k, agg[k])(F.col(f"_tot_{n}")).over(before)
                       .alias(f"_car_{n}") for n, (k, _) in cols.items()])
    return (local.join(carry, [*keys, _BLK], "left")
            .select(*names, *[merge[k](F.col(f"_loc_{n}"), F.col(f"_car_{n}")).alias(n)
                              for n, (k, _) in cols.items()]))


def runs(df: DataFrame, keys: list[str], order: str, at: str, gap: int, width: int | None,
         out: str = "run_id") -> DataFrame:
    """Label maximal runs in which each row lies less than ``gap`` after the furthest
    ``at`` value before it. ``out`` is the ``order`` value of the run's first row.

    ``order`` is a number; blocks are ``width`` wide in it. A run that crosses
    blocks is stitched on the row-per-block table. ``df`` is read twice, as in ``running``. Without
    ``width`` a key is one block: for keys known to have few rows.
    """
    names = df.columns
    base = df if width is None else df.withColumn(_BLK, block_of(order, width))
    here = W.partitionBy(*keys, *([] if width is None else [_BLK])).orderBy(order)
    past = here.rowsBetween(W.unboundedPreceding, -1)
    upto = here.rowsBetween(W.unboundedPreceding, 0)
    local = base.withColumn("_pm", F.max(at).over(past))
    starts = F.col("_pm").isNull() | (F.col(at) - F.col("_pm") >= gap)
    local = local.withColumn("_seg", F.max(F.when(starts, F.col(order))).over(upto))
    if width is None:
        return local.select(*names, F.col("_seg").alias(out))
    blocks = local.groupBy(*keys, _BLK).agg(
        F.max(at).alias("_bmax"), F.min(order).alias("_bfirst"),
        F.min_by(at, order).alias("_bfirst_at"), F.max("_seg").alias("_blast"))
    along = (W.partitionBy(*keys).orderBy(_BLK)
             .rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.withColumn("_prev", F.max("_bmax").over(along))
    joined = F.col("_prev").isNotNull() & (F.col("_bfirst_at") - F.col("_prev") < gap)
    own = F.when(~joined | (F.col("_blast") != F.col("_bfirst")), F.col("_blast"))
    blocks = (blocks.withColumn("_own", own)
              .withColumn("_head", F.when(joined, F.max("_own").over(along))
                          .otherwise(F.col("_bfirst")))
              .select(*keys, _BLK, "_bfirst", "_head"))
    return (local.join(blocks, [*keys, _BLK])
            .select(*names, F.when(F.col("_seg") == F.col("_bfirst"), F.col("_head"))
                    .otherwise(F.col("_seg")).alias(out)))


def point_in_interval(intervals: DataFrame, points: DataFrame, keys: list[str],
                      start: str, end: str, at: str, width: int,
                      how: str = "inner") -> DataFrame:
    """Join half-open intervals with the points inside them.

    Intervals are repeated once per block they touch and points fall in one block, so the
    join is an equi-join on (keys, block) with the range as a residual; AQE can split a
    crowded block. With ``how='left'`` an interval has a row without a point for its first block
    if that block has none inside it, whatever lies in later ones: aggregate before counting rows.
    """
    left = intervals.withColumn(_BLK, spread_interval(start, end, width))
    right, cond, drop = keys_equal(points.withColumn(_BLK, block_of(at, width)),
                                   [*keys, _BLK])
    cond = cond & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    out = left.join(right, cond, how)
    if how == "left":
        out = out.filter(F.col(drop[0]).isNotNull() | (F.col(_BLK) == block_of(start, width)))
    return out.drop(*drop, _BLK)


def interval_overlap(left: DataFrame, right: DataFrame, keys: list[str],
                     lstart: str, lend: str, rstart: str, rend: str,
                     width: int) -> DataFrame:
    """Pairs of half-open intervals that overlap, each pair once.

    Both sides are spread over blocks; a pair is kept only in the block where the overlap
    begins, so nothing has to be de-duplicated afterwards.
    """
    a = left.withColumn(_BLK, spread_interval(lstart, lend, width))
    b, cond, drop = keys_equal(right.withColumn(_BLK, spread_interval(rstart, rend, width)),
                               [*keys, _BLK])
    cond = (cond & (F.col(lstart) < F.col(rend)) & (F.col(lend) > F.col(rstart))
            & (F.col(_BLK) == block_of(F.greatest(F.col(lstart), F.col(rstart)), width)))
    return a.join(b, cond).drop(*drop, _BLK)


def neighbours(points: DataFrame, marks: DataFrame, keys: list[str], at: str, reach: int, width: int,
               kinds: list[str]) -> DataFrame:
    """``points`` with the nearest mark of each kind at or before and at or after ``at``, as structs
    (_m, _ord) ``before_<kind>`` and ``after_<kind>``; marks farther than ``reach`` may be missing.

    ``marks``: keys, _m (a time), _kind, _ord; of marks at one time that with the greatest _ord
    counts. Points and marks are one sorted table per block of the timeline, passed once in each
    direction: no join, and no point is repeated. Only marks within ``reach`` of a border are lent
    to the block behind it.
    """
    names = points.columns
    width = max(width, reach + 1)
    own = block_of("_m", width)
    from_start = F.col("_m") - own * F.lit(width)
    homes = F.array_compact(F.array(own, F.when(from_start <= reach, own - 1), F.when(from_start >= width - reach, own + 1)))
    lent = marks.select(*keys, F.explode(homes).alias(_BLK), F.col("_m").alias("_t"), F.lit(0).alias("_point"), "_ord",
                        F.col("_kind"), F.lit(None).cast(points.schema).alias("_row"))
    mine = points.select(*keys, block_of(at, width).alias(_BLK), F.col(at).alias("_t"), F.lit(1).alias("_point"),
                         F.lit(None).cast(marks.schema["_ord"].dataType).alias("_ord"), F.lit(None).cast("string").alias("_kind"), F.struct(*names).alias("_row"))
    upto = lambda *order: W.partitionBy(*keys, _BLK).orderBy(*order, "_point", "_ord").rowsBetween(W.unboundedPreceding, 0)
    # What the windows read is made of a row behind the shuffle, not carried through it; rows are wide
    # there and sorted twice, so they go to more partitions than elsewhere, which are not put together again.
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) * SORT_PARTS
    seen = lent.unionByName(mine).repartition(parts, *keys, _BLK).withColumn("_mark", F.struct(F.col("_t").alias("_m"), "_ord"))
    for side, order in (("before", F.asc("_t")), ("after", F.desc("_t"))):
        seen = seen.withColumns({f"{side}_{k}": F.last(F.when(F.col("_kind") == k, F.col("_mark")), True).over(upto(order)) for k in kinds})
    return seen.filter("_point = 1").select("_row.*", *[f"{side}_{k}" for side in ("before", "after") for k in kinds])


def nearest(at: Column, kind: str, limit: int) -> Column:
    """Time of the nearer of the two ``neighbours`` of a kind within ``limit``, of equally near ones
    that with the greater _ord; NULL if none is near enough."""
    def near(side):
        mark = F.col(f"{side}_{kind}")
        away = F.abs(mark["_m"] - at)
        return F.when(away <= limit, F.struct((-away).alias("away"), mark["_ord"].alias("ord"), mark["_m"].alias("m")))

    return F.greatest(near("before"), near("after"))["m"]


def top_n(df: DataFrame, keys: list[str], order: list, n: int,
          rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark limits each group before the shuffle
    (WindowGroupLimit), so a crowded key ships at most ``n`` rows per task."""
    name = rank or "_rn"
    out = (df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
           .filter(F.col(name) <= n))
    return out if rank else out.drop(name)


def numbered(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """``df`` with ``out``: the number from 1 of each row in the ``order`` of its key.

    Rows are range-partitioned by key and order and sorted, so the ids that Spark gives them rise
    with the order; a table with a row per (key, partition) says where each begins. Ranges are cut
    where the rows are, so neither a large key nor a value that many rows share is one task's; of
    rows equal in key and order any may come first.
    """
    names = df.columns
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    tied = [*keys, *order, "_tie"]
    spread = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*tied).sortWithinPartitions(*tied).drop("_tie")
    placed = stage(spread.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return placed.join(parts, [*keys, "_part"]).select(*names, (F.col("_at") + F.col("_shift")).alias(out))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_rows(rows: Column, start: Column, kind: str, step: Callable[[Column, Column], Column], part: int = 128) -> Column:
    """What ``step`` gives for the rows of an array, one after the other, as one array of ``kind``.

    ``step(state, row)`` is a struct (state, out): the next state and an array of results. Results
    are gathered part by part, so that a long array is not copied for each row. It all stays in the
    JVM.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc, row):
        return let(step(acc["state"], row), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

    def several(acc, at):
        begin = F.struct(acc["state"].alias("state"), none.alias("out"))
        return F.aggregate(F.slice(rows, at * part + 1, F.lit(part)), begin, one,
                           lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    parts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(rows) - 1, F.lit(0)) / part).cast("int"))
    begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(parts, begin, several)["out"])


def _ranked(times: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """``times`` with their rank from 0 within the key."""
    out = running(times, keys, [at], block_of(at, width), _before=("count", F.lit(1)))
    return out.select(*keys, at, F.coalesce("_before", F.lit(0)).cast("bigint").alias("_rank"))


def _next_ranks(ranked: DataFrame, keys: list[str], at: str, gap: int, width: int) -> DataFrame:
    """Adds ``_next``: the rank of the first row at least ``gap`` later (one past the last rank if
    there is none). A block of the timeline borrows the rows that lie less than ``gap`` behind its
    end; ``width`` is at least ``gap``, so that is part of the next block only."""
    own = block_of(at, width)
    lent = F.col(at) - own * F.lit(width) < F.lit(gap)
    near = ranked.withColumn(_BLK, F.explode(F.when(lent, F.array(own, own - 1)).otherwise(F.array(own))))
    later = W.partitionBy(*keys, _BLK).orderBy(F.col(at).desc()).rangeBetween(W.unboundedPreceding, -gap)
    here = W.partitionBy(*keys, _BLK)
    first = F.min(F.when(own == F.col(_BLK), F.col("_rank"))).over(here)
    reached = first + F.count(F.lit(1)).over(here) - F.count(F.lit(1)).over(later)
    return near.withColumn("_next", reached).filter(own == F.col(_BLK)).drop(_BLK)


def _exits(rows: Column, block: Column) -> Column:
    """Where each row of a block leaves it: its ``_next`` followed inside the block, the distance
    doubled ``RANK_BITS`` times."""
    inside = lambda rank: F.shiftright(rank, RANK_BITS) == block
    at = lambda rank: (rank % (1 << RANK_BITS)).cast("int")
    jumps = F.transform(rows, lambda r: r["_next"])
    double = lambda known, _: F.transform(known, lambda r: F.when(inside(r), F.coalesce(F.get(known, at(r)), r)).otherwise(r))
    return F.aggregate(F.sequence(F.lit(1), F.lit(RANK_BITS)), jumps, double)


def spaced(times: DataFrame, keys: list[str], at: str, gap: int, width: int) -> DataFrame:
    """The rows (keys, ``at``) a walk keeps that takes the first of each key and then each one at
    least ``gap`` after the last one taken. ``times`` has distinct rows and is read twice.

    Nothing walks. Every row knows the rank of the row it would hand over to. Rows lie in blocks of
    ``2 ** RANK_BITS`` ranks, whatever their times; inside a block the hand-overs are followed in an
    array, so a row that others hand over to from outside has one jump through its block. Only
    these jumps, one or a few for each block, are followed from block to block: the distance is
    doubled by self-joins, then the blocks on the way from the first row are marked. Each block is
    settled alone from where it is entered, so one key of any length spreads over tasks.
    """
    width = max(width, gap)
    linked = _next_ranks(_ranked(times, keys, at, width), keys, at, gap, width)
    block = F.shiftright("_rank", RANK_BITS)
    rows = F.array_sort(F.collect_list(F.struct("_rank", F.col(at).alias("_at"), "_next")))
    blocks = stage(linked.groupBy(*keys, block.alias(_BLK)).agg(rows.alias("_rows")), "time-blocks")
    entered = _entered(blocks, keys)

    def take(state, row):
        kept = F.struct(row["_next"].alias("want"), F.concat(state["kept"], F.array(row["_at"])).alias("kept"))
        return F.when(row["_rank"] == state["want"], kept).otherwise(state)

    none = F.array().cast(blocks.select(F.transform("_rows", lambda r: r["_at"]).alias("x")).schema["x"].dataType)
    kept = F.aggregate("_rows", F.struct(F.col("_entry").alias("want"), none.alias("kept")), take)["kept"]
    first = blocks.filter(F.col(_BLK) == 0).withColumn("_entry", F.lit(0).cast("bigint"))
    settled = first if entered is None else first.unionByName(blocks.join(entered, [*keys, _BLK]))
    return settled.select(*keys, F.explode(kept).alias(at))


def _entered(blocks: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, block, ``_entry``) for the blocks behind the first that the walk enters; None if no
    key has two blocks."""
    last = blocks.agg(F.max(_BLK)).first()[0] or 0
    if not last:
        return None
    many = blocks.filter(F.col(_BLK) == 1).select(*keys)
    jumps = blocks.join(many, keys, "left_semi").select(*keys, _BLK, "_rows", _exits(F.col("_rows"), F.col(_BLK)).alias("_exits"))
    across = jumps.select(*keys, F.explode(F.array_distinct(F.filter(F.transform("_rows", lambda r: r["_next"]), lambda n: F.shiftright(n, RANK_BITS) > F.col(_BLK)))).alias("a")).distinct()
    start = jumps.filter(F.col(_BLK) == 0).select(*keys, F.lit(0).cast("bigint").alias("a"))
    ends = jumps.select(*keys, F.inline(F.zip_with("_rows", "_exits", lambda r, x: F.struct(r["_rank"].alias("a"), x.alias("b")))))
    hops = [stage(ends.join(across.unionByName(start), [*keys, "a"]), "jumps")]
    while 1 << len(hops) <= last:
        ahead = hops[-1].select(*keys, F.col("a").alias("b"), F.col("b").alias("_c"))
        hops.append(stage(hops[-1].join(ahead, [*keys, "b"]).select(*keys, "a", F.col("_c").alias("b")), "jumps"))
    way = hops[0].filter("a = 0").select(*keys, "a")
    for hop in reversed(hops):
        way = stage(way.unionByName(way.join(hop, [*keys, "a"]).select(*keys, F.col("b").alias("a"))), "way")
    return way.filter("a > 0").select(*keys, F.shiftright("a", RANK_BITS).alias(_BLK), F.col("a").alias("_entry"))
