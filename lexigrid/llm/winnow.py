"""Document fingerprints by winnowing. DataFrame operations only.

Tokens are words (scripts written without spaces: characters; long runs are cut). Every run of ``K``
tokens is hashed, by doubling: pairs of tokens, then pairs of pairs. Of every ``W`` hashes in a row the
smallest is selected, the rightmost of equal ones, with its position. Any run of ``W + K - 1`` tokens
that two texts share therefore selects a hash in both, and no run shorter than ``K`` counts.

The minimum over windows is taken by doubling as well, on numbers that hold 40 bits of the hash above
the position's distance from the end of the range, so that ties fall to the right. Arrays are only ever
zipped with shifted copies of themselves: the work grows with the length of a text, not its square.

Texts of fewer than ``K`` tokens have one hash, of all their tokens. Null texts are empty and select
nothing. Two empty fingerprints are alike (1), an empty one and another are not (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._io import table

K, W = 4, 4
#: Documents a bucket of neighbours should hold, and the most buckets.
BUCKET, MOST_BUCKETS = 400, 1 << 15
_POSITIONS = (1 << 24) - 1
_DENSE = r"\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{0E00}-\x{0EFF}"
TOKEN = rf"[{_DENSE}]|[^\x20\x09-\x0D{_DENSE}]{{1,32}}"


def _shifted(name: str, by: int) -> Column:
    return F.slice(name, by + 1, F.greatest(F.size(name), F.lit(1)))


def selected(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with ``out``: array of packed (hash, position) numbers in text order, see ``hashes``."""
    a, b = f"_{out}_a", f"_{out}_b"
    kept = df.columns
    df = df.withColumn(a, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))
    df = df.withColumn(b, F.zip_with(a, _shifted(a, 1), lambda x, y: F.xxhash64(x, y)))
    grams = F.slice(F.zip_with(b, _shifted(b, 2), lambda x, y: F.xxhash64(x, y)), F.lit(1), F.greatest(F.size(a) - (K - 1), F.lit(0)))
    grams = F.when(F.size(a) >= K, grams).when(F.size(a) > 0, F.array(F.xxhash64(a))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*kept, grams.alias(a))
    packed = F.transform(a, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 24), 24).bitwiseOR(F.lit(_POSITIONS).cast("long") - i.cast("long").bitwiseAND(F.lit(_POSITIONS).cast("long"))))
    df = df.select(*kept, packed.alias(a))
    df = df.select(*kept, F.zip_with(a, _shifted(a, 1), lambda x, y: F.least(x, y)).alias(a))
    least = F.zip_with(a, _shifted(a, 2), lambda x, y: F.least(x, y))
    least = F.slice(least, F.lit(1), F.greatest(F.size(a) - (W - 1), F.lit(1)))
    return df.select(*kept, F.array_distinct(F.when(F.size(a) > 0, least).otherwise(F.col(a))).alias(out))


def hashes(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, 24)))


def positions(packed: Column) -> Column:
    """(hash, token position) of each selected hash, for texts of fewer than 2^24 tokens."""
    return F.transform(packed, lambda x: F.struct(F.shiftright(x, 24).alias("hash"), (F.lit(_POSITIONS).cast("long") - x.bitwiseAND(F.lit(_POSITIONS).cast("long"))).cast("int").alias("position")))


def digest(h: Column) -> Column:
    """32 hexadecimal digits for a fingerprint."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(h)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), h)), 16, "0")))


def likeness(a: str, b: str) -> Column:
    """Shared hashes of all hashes of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def _bucket_limits(docs: DataFrame) -> tuple[int, list[int]]:
    """The smallest doc_id, and doc_ids at which buckets begin."""
    got = docs.agg(F.count("*").alias("n"), F.min("_id").alias("least")).first()
    buckets = min(MOST_BUCKETS, got["n"] // BUCKET)
    if buckets < 2:
        return got["least"], []
    shares = [i / buckets for i in range(1, buckets)]
    return got["least"], sorted(set(docs.agg(F.percentile_approx("_id", shares, 20 * buckets).alias("p")).first()["p"]))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, own, changed, following): packed fingerprints of each text, of its edited
    text and of the next text by doc_id (after the last: the first).

    Rows are dealt to buckets of neighbours by quantiles of doc_id, whose first rows go to the bucket
    before as well: one shuffle of the texts. Null doc_ids come last; rows of one doc_id go by a hash of the text.
    """
    big = F.lit((1 << 63) - 1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_id", F.coalesce("doc_id", big))
    least, limits = _bucket_limits(docs.select("_id"))
    step = max(1, int(len(limits) ** 0.5))
    lines = [limits[i : i + step] for i in range(0, len(limits), step)]
    if lines:
        coarse = F.size(F.filter(F.array(*[F.lit(r[0]) for r in lines]), lambda x: x <= F.col("_id")))
        line = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in lines]), F.greatest(coarse, F.lit(1)))
        bucket = F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(line, lambda x: x <= F.col("_id"))))
        starts = F.array_contains(line, F.col("_id"))
    else:
        bucket, starts = F.lit(0), F.lit(False)
    place = lambda b, ahead: F.struct(b.cast("int").alias("bucket"), F.lit(ahead).alias("ahead"))
    none = F.array().cast("array<struct<bucket:int,ahead:int>>")
    docs = docs.withColumn("_b", bucket).withColumn("_starts", starts)
    places = F.concat(
        F.array(place(F.col("_b"), 0)),
        F.when(F.col("_starts"), F.array(place(F.col("_b") - 1, 1))).otherwise(none),
        F.when(F.col("_id") == F.lit(least), F.array(place(F.lit(len(limits)), 2))).otherwise(none),
    )
    docs = docs.select("doc_id", "_id", "text", F.explode(places).alias("p")).select("doc_id", "_id", "text", "p.bucket", "p.ahead").repartition(F.col("bucket"))
    docs = selected(docs, "text", "own").withColumn("_h", F.xxhash64("text"))
    order = Window.partitionBy("bucket").orderBy("ahead", "_id", "_h")
    docs = docs.select("doc_id", "ahead", "text", "own", F.lead("text").over(order).alias("_next"), F.lead("own").over(order).alias("following")).where("ahead = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "following")
    return selected(docs, "edited", "changed")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprinted(table(spark, sf_dir, "documents"))
    found = found.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), *[hashes(F.col(c)).alias(c) for c in ("own", "changed", "following")])
    return found.select("doc_id", "n_chars", "edited_sha256", digest(F.col("own")).alias("fingerprint"), digest(F.col("changed")).alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"))
