"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

Every source j has a token target T_j. Document rates minimize the divergence from one copy each,
sum(r ln r - r + 1), under sum(r * size) = T_j and 0 <= r <= cap. Its dual is convex in one multiplier
per source, with solution r = min(cap, exp(lambda_j * size / mean_j)): exponentially tilted rates.
All multipliers are found at once by safeguarded Newton steps, each one aggregation over the table of
(source, size, documents): documents of a source with equal sizes have equal rates. That table is
pre-aggregated, so a hot source costs no more than its distinct sizes.

Rates become whole copies per (source, size) cell, then each source's rest is closed by single copies
of the size that fits it best. Within a cell the copies go to documents in the order of a hash of
doc_id, counted in buckets, so no cell is ranked in one task and reruns agree.

Null and empty texts have size 0 and are never taken. The null source is a source of its own, last in
order. Rows that repeat a doc_id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._io import stored, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
NEWTON_STEPS = 60
#: A Newton residual that is this small against the target is solved.
TOLERANCE = 1e-9
_BUCKETS = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(cells: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, docs, weight, target) from cells (source, size, n): one row a source.

    Targets share ``share`` of all sizes by weight; a target stops at ``cap`` times its source and the
    excess goes to the others by weight: target = min(cap * size, level * weight) for one level. Sources in
    order of the level at which they stop give it by running sums over the table of sources.
    """
    per = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    stop = (cap * F.col("source_size") / F.col("weight")).alias("stop")
    ranked = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before, after = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("stop", stop)
    level = (F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after)
    # The level is the first, in this order, that stays below its own source's stop.
    per = per.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(Window.partitionBy())["level"]
    per = per.withColumn("target", F.least(cap * F.col("source_size"), F.coalesce(found, F.lit(float("inf"))) * F.col("weight")).cast("double"))
    return per.select("source", "source_size", "docs", "weight", "target")


def tilted_rates(cells: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = NEWTON_STEPS) -> DataFrame:
    """cells with ``rate``. One job a Newton step; only the count of open sources comes to the driver."""
    mean = F.col("source_size") / F.col("docs")
    state = targets.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, mean).otherwise(1.0).alias("scale"),
        F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
        (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("full"),
    )
    state = stored(state.withColumn("done", F.col("full") | (F.col("target") <= 0)), "mix-state")
    on = lambda a, b: a["source"].eqNullSafe(b["source"])
    for _ in range(steps):
        if state.where(~F.col("done")).isEmpty():
            break
        z = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.lit(50.0), F.col("lam") * z))
        w = F.col("n") * F.col("size")
        open_ = state.where(~F.col("done")).select(F.col("source").alias("key"), "scale", "lam", "target")
        moment = (
            cells.where("size > 0").join(open_, F.col("source").eqNullSafe(F.col("key")))
            .groupBy(F.col("key"))
            .agg(F.sum(w * F.least(F.lit(float(cap)), raw)).alias("got"), F.sum(F.when(raw < cap, w * z * raw).otherwise(0.0)).alias("slope"))
        )
        state = state.join(moment, F.col("source").eqNullSafe(F.col("key")), "left")
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap >= 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - gap / F.col("slope")
        inside = F.col("slope").isNotNull() & (F.col("slope") > 0) & (step > low) & (step < high) & (F.abs(step - F.col("lam")) <= 4)
        middle = F.when(low == float("-inf"), high - 2.0).when(high == float("inf"), low + 2.0).otherwise((low + high) / 2)
        live = ~F.col("done") & F.col("got").isNotNull()
        solved = F.abs(gap) <= TOLERANCE * F.col("target")
        state = stored(
            state.select(
                "source", "source_size", "target", "scale",
                F.when(live & ~solved, F.when(inside, step).otherwise(middle)).otherwise(F.col("lam")).alias("lam"),
                F.when(live, low).otherwise(F.col("low")).alias("low"), F.when(live, high).otherwise(F.col("high")).alias("high"),
                "full", (F.col("done") | solved | F.col("got").isNull()).alias("done"),
            ),
            "mix-state",
        )
    rate = F.when(F.col("size") <= 0, 0.0).when(F.col("full"), float(cap)).when(F.col("target") <= 0, 0.0)
    rate = rate.otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("scale")))))
    return cells.join(state, on(cells, state)).select(cells["source"], "size", "n", "target", rate.alias("rate"))


def whole_copies(rates: DataFrame, cap: int = CAP, rounds: int = 12) -> DataFrame:
    """(source, size, n, copies): copies of all documents of a cell together, close to n * rate.

    Cells are rounded to the nearest copy. What a source then lacks or has too much is closed in rounds:
    each changes the copies of the one cell that leaves the least.
    """
    cells = stored(rates.withColumn("copies", F.least(F.round(F.col("n") * F.col("rate")).cast("long"), cap * F.col("n"))), "mix-cells")
    for _ in range(rounds):
        gap = cells.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).select(F.col("source").alias("key"), "gap")
        room = F.when(F.col("gap") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        change = F.least(room, F.greatest(F.lit(1), F.round(F.abs("gap") / F.col("size")).cast("long")))
        rest = F.abs(F.abs("gap") - change * F.col("size"))
        best = (
            cells.where("size > 0").join(gap, F.col("source").eqNullSafe(F.col("key"))).where((room > 0) & (rest < F.abs("gap")))
            .groupBy("key")
            .agg(F.min(F.struct(rest.alias("rest"), F.col("size").alias("at"), (F.signum("gap") * change).cast("long").alias("change"))).alias("best"))
            .select("key", "best.at", "best.change")
        )
        best = stored(best, "mix-best")
        if best.isEmpty():
            break
        cells = cells.join(best, F.col("source").eqNullSafe(F.col("key")) & (F.col("size") == F.col("at")), "left")
        cells = stored(cells.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("key", "at", "change"), "mix-cells")
    return cells.select("source", "size", "n", "copies")


def mixed(docs: DataFrame, key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(key, source, size, source_size, target, copies), one row per row of ``docs``."""
    small = docs.select(F.col(key).alias("key"), "source", word_count(F.col("text")).alias("size"))
    small = stored(small.withColumn("h", F.xxhash64("key", "source")).withColumn("bucket", F.pmod("h", F.lit(_BUCKETS)).cast("int")), "mix-docs")
    cells = stored(small.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    targets = stored(source_targets(cells, weights, share, cap), "mix-targets")
    copies = whole_copies(tilted_rates(cells, targets, cap), cap).where("copies > 0")
    # Of a cell's copies, buckets get whole numbers by their running counts; documents by rank in the bucket.
    running = Window.partitionBy("source", "size").orderBy("bucket")
    counts = small.groupBy("source", "size", "bucket").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(running))
    a, b = counts.alias("a"), copies.alias("b")
    shared = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")))
    part = lambda upto: F.floor(F.col("copies") * upto / F.col("n"))
    shared = shared.select(F.col("a.source").alias("s2"), F.col("a.size").alias("z2"), F.col("bucket").alias("b2"), "m", (part(F.col("upto")) - part(F.col("upto") - F.col("m"))).alias("k"))
    place = Window.partitionBy("source", "size", "bucket").orderBy("h", "key")
    ranked = small.withColumn("rank", F.row_number().over(place))
    ranked = ranked.join(shared, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("bucket") == F.col("b2")), "left")
    each = F.floor(F.col("k") / F.col("m")) + (F.col("rank") <= F.col("k") % F.col("m")).cast("long")
    ranked = ranked.select("key", "source", "size", F.coalesce(each, F.lit(0)).cast("int").alias("copies"))
    of = targets.select(F.col("source").alias("s3"), "source_size", "target")
    return ranked.join(of, F.col("source").eqNullSafe(F.col("s3"))).select("key", "source", "size", "source_size", "target", "copies")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: Copies of one row that a task writes at a time, where equal rows share many.
_AT_A_TIME = 64


def repeat_by_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``.

    Rows without a word are never taken. Which rows are taken is decided on hashes and sizes alone; texts are
    read once more and meet the copies in one join. Rows that agree in every column can't be told apart: they
    share their copies, at most ``cap`` for each of them.
    """
    names, keys = docs.columns, ["_lexigrid_k1", "_lexigrid_k2"]
    row = docs.withColumns({keys[0]: F.xxhash64(*names), keys[1]: F.xxhash64(F.lit(1), *names)})
    taken = mixed(row.select(F.struct(*keys).alias("_k"), "source", "text"), "_k", weights, share, cap)
    taken = taken.groupBy("key").agg(F.sum("copies").alias("_lexigrid_copies"), F.count("*").alias("_lexigrid_rows"))
    taken = stored(taken.where("_lexigrid_copies > 0").select("key.*", "_lexigrid_copies", "_lexigrid_rows"), "mix-taken")
    each = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    out = row.join(taken.where("_lexigrid_rows = 1"), keys).withColumn("_lexigrid_n", each(F.col("_lexigrid_copies"))).select(*names)
    many = taken.where("_lexigrid_rows > 1")
    if many.isEmpty():
        return out
    # One row stands for its repeats; its copies are written by several tasks.
    many = row.join(many, keys).dropDuplicates(keys).withColumn("_lexigrid_part", each(F.ceil(F.col("_lexigrid_copies") / _AT_A_TIME)))
    rest = F.least(F.lit(_AT_A_TIME), F.col("_lexigrid_copies") - (F.col("_lexigrid_part") - 1) * _AT_A_TIME)
    many = many.repartition(*keys, "_lexigrid_part").withColumn("_lexigrid_n", each(rest)).select(*names)
    return out.unionByName(many)
