"""Sharding into near equal bytes by sampled splitters. DataFrame operations only.

Rows that have equal texts form a group; a group is one unit unless it is larger than a quarter of a
shard's share, then its rows are units of their own. Units are sorted by a hash of their text (and of
doc_id within a divided group). A size-weighted sample of keys gives quantile splitters for ranges;
ranges that hold too many units are divided by a second hash. Running sizes over the ranges and within
each range place every unit exactly, and shard boundaries are the quantiles that fill each shard up.

Units above a fiftieth of a share would overshoot a boundary. There are less than 50 a shard of them;
they are placed first, largest first, each where least is, and the boundaries make up for them.

Null texts count as no bytes, and are equal to one another but not to empty texts. Equal rows
(doc_id and text) are counted together and laid out again at the end, so any number of repeats is fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._io import stored, table

SHARDS = 16
#: Units above 1 / (shards * SINGLE) of all bytes are placed one by one, groups above 1 / (shards * WHOLE) divided.
SINGLE, WHOLE = 50, 4
#: Units a range should hold, and the most ranges that splitters are drawn for at once.
RANGE_UNITS, MOST_RANGES = 2_000, 1024
#: Sampled keys for each range.
SAMPLE = 32


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _below(value: Column, limits: list) -> Column:
    """How many of the sorted limits the value reaches; two steps of about the root of their number each."""
    if not limits:
        return F.lit(0)
    step = max(1, int(len(limits) ** 0.5))
    rows = [limits[i : i + step] for i in range(0, len(limits), step)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    coarse = F.size(F.filter(heads, lambda x: x <= value))
    inner = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in rows]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(inner, lambda x: x <= value)))


def _units(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """rows with unit (key of the unit), sub (0 for a whole group) and unit_bytes."""
    groups = rows.groupBy("h", "text_crc32", "size").agg(F.sum(F.col("size") * F.col("n")).alias("group_bytes"))
    # Only groups that are divided matter here; there are less than shards * WHOLE of them.
    heavy = groups.where(F.col("group_bytes") * (shards * WHOLE) > total).select("h", "text_crc32", "size", F.lit(True).alias("divided"))
    rows = rows.join(F.broadcast(heavy), ["h", "text_crc32", "size"], "left")
    return rows.withColumn("sub", F.when(F.col("divided"), F.xxhash64("doc_id", "h")).otherwise(F.lit(0).cast("long"))).drop("divided")


def _least_filled(big: DataFrame, shards: int) -> DataFrame:
    """Largest first, each unit where least is: over less than shards * SINGLE units in one array."""
    units = F.sort_array(F.collect_list(F.struct("bytes", "h", "sub")), asc=False)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("fill"), F.array().cast("array<int>").alias("at"))

    def place(acc: Column, u: Column) -> Column:
        least = (F.array_position(acc["fill"], F.array_min(acc["fill"])) - 1).cast("int")
        fill = F.transform(acc["fill"], lambda x, i: F.when(i == least, x + u["bytes"]).otherwise(x))
        return F.struct(fill.alias("fill"), F.concat(acc["at"], F.array(least)).alias("at"))

    one = big.select(units.alias("u")).select("u", F.aggregate("u", start, place)["at"].alias("at"))
    return one.select(F.explode(F.arrays_zip("u", "at")).alias("x")).select("x.u.h", "x.u.sub", F.col("x.at").alias("shard"), "x.u.bytes")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per row of ``docs``; law: near equal bytes."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), byte_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h"))
    rows = stored(rows.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count("*").alias("n")), "shard-rows")
    got = rows.agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.count("*").alias("rows")).first()
    total = got["bytes"] or 0
    rows = stored(_units(rows, total, shards), "shard-units")
    units = stored(rows.groupBy("h", "sub").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")), "shard-unit-sizes")
    is_big = F.col("bytes") * (shards * SINGLE) > total
    big = stored(_least_filled(units.where(is_big), shards), "shard-big")
    fill = {r["shard"]: r["bytes"] for r in big.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    small = units.where(~is_big)
    rest = total - sum(fill.values())
    # What each shard still lacks; where single units overfilled one, the others share what is left.
    level = _level([fill.get(s, 0) for s in range(shards)], rest)
    lack = [max(0.0, level - fill.get(s, 0)) for s in range(shards)]
    bounds = [sum(lack[: s + 1]) for s in range(shards - 1)]
    ranges = max(1, min(MOST_RANGES, got["rows"] // RANGE_UNITS))
    chance = F.least(F.lit(1.0), F.col("bytes") * (ranges * SAMPLE / max(1, rest)))
    # A unit is drawn by a hash of its key with a chance that grows with its size: ranges * SAMPLE keys on average.
    drawn = small.where(F.pmod(F.xxhash64("sub", "h", F.lit(3)), F.lit(1 << 30)) < chance * (1 << 30)) if ranges > 1 else None
    keys = sorted(r["h"] for r in drawn.select("h").collect()) if drawn is not None else []
    limits = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if len(keys) >= ranges else []
    placed = small.withColumn("range", _below(F.col("h"), limits).cast("int"))
    sizes = placed.groupBy("range").agg(F.count("*").alias("units"))
    # Overfull ranges are divided by a second hash, in an order of its own.
    crowded = sizes.where(F.col("units") > 2 * RANGE_UNITS).select("range", F.ceil(F.col("units") / RANGE_UNITS).alias("parts"))
    placed = placed.join(F.broadcast(crowded), "range", "left")  # a row for each of at most MOST_RANGES ranges
    placed = placed.withColumn("part", F.coalesce(F.pmod(F.xxhash64("h", "sub", F.lit(5)), F.col("parts")), F.lit(0)))
    placed = stored(placed.select("h", "sub", "bytes", "range", "part"), "shard-ranges")
    order = Window.partitionBy("range").orderBy("part")
    whole = Window.orderBy("range")
    parts = placed.groupBy("range", "part").agg(F.sum("bytes").alias("b")).withColumn("before", F.sum("b").over(order) - F.col("b"))
    heads = parts.groupBy("range").agg(F.sum("b").alias("b")).withColumn("start", F.sum("b").over(whole) - F.col("b")).select("range", "start")
    starts = parts.join(heads, "range").select("range", "part", (F.col("start") + F.col("before")).alias("start"))
    within = Window.partitionBy("range", "part").orderBy("h", "sub")
    at = F.col("start") + F.sum("bytes").over(within) - F.col("bytes") / 2
    dealt = placed.join(starts, ["range", "part"]).withColumn("at", at).select("h", "sub", _below(F.col("at"), [float(b) for b in bounds]).cast("int").alias("shard"))
    dealt = dealt.unionByName(big.select("h", "sub", "shard"))
    rows = rows.join(dealt, ["h", "sub"])
    return _slots(stored(rows.select("doc_id", "size", "text_crc32", "h", "n", "shard"), "shard-dealt"))


def _level(fill: list[int], rest: int) -> float:
    """Height to which ``rest`` fills up bins of the given heights."""
    heights = sorted(fill)
    for k in range(len(heights), 0, -1):
        level = (rest + sum(heights[:k])) / k
        if level >= heights[k - 1]:
            return level
    return 0.0


def _slots(rows: DataFrame, buckets: int = 1024) -> DataFrame:
    """Gapless numbers within each shard, by running counts over buckets of a hash and within each bucket."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).cast("int"))
    over = Window.partitionBy("shard").orderBy("bucket")
    starts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("m")).withColumn("start", F.sum("m").over(over) - F.col("m")).drop("m")
    inside = Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "size", "text_crc32")
    first = F.col("start") + F.sum("n").over(inside) - F.col("n")
    out = rows.join(starts, ["shard", "bucket"]).withColumn("first", first)
    out = out.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharded(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
