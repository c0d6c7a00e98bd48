"""Votes, label summaries, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .rank import first_row

NONE = "no_consensus"


def majority(votes: DataFrame, key: list[str], voters: int = 3) -> DataFrame:
    """One decision a key from votes (pass, label, certainty, confidence); empty labels are no votes.

    Adds label, certainty, confidence, agreement, has_disagreement, vote_split_pattern, uncertainty_tag. A label
    needs two votes; of equally frequent labels the one of the earliest pass leads.
    """
    cast = F.coalesce("label", F.lit("")) != ""
    per = votes.groupBy(*key, "label").agg(F.count_if(cast).alias("n"), F.min("pass").alias("first"), F.sum(F.when(cast, F.coalesce("confidence", F.lit(0.0)))).alias("conf"), F.bool_or(cast & (F.coalesce("certainty", F.lit("medium")) == "low")).alias("low"))
    by = per.groupBy(*key).agg(
        F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("labels"), F.max("n").alias("count"), F.min_by("label", F.struct(-F.col("n"), "first")).alias("lead"), F.sum("conf").alias("conf"), F.bool_or("low").alias("low")
    )
    n, c = F.col("n"), F.col("count")
    wins = (n >= 2) & (c >= 2)
    conf = F.when(n > 0, F.round(F.coalesce("conf", F.lit(0.0)) / n, 4)).otherwise(0.0)
    mean = F.coalesce(F.col("conf"), F.lit(0.0)) / n
    high = wins & (c == n) & (mean >= 0.8) & ~F.coalesce("low", F.lit(False))
    split = F.when(n == 0, "missing").when(n >= 3, F.when(c == n, F.concat(n.cast("string"), F.lit("-0"))).when(c >= 2, F.concat_ws("-", c.cast("string"), (n - c).cast("string"))).otherwise("1-1-1")).when(n == 2, F.when(c == 2, "2-0").otherwise("1-1")).otherwise("1-0")
    tag = F.when(n == 0, "api_missing").when(wins, F.when(c == n, "stable").otherwise("majority_vote")).otherwise("split_vote")
    tag = F.concat(tag, F.when((n > 0) & F.col("low"), "+low_certainty").otherwise(""))
    return by.select(
        *key, F.when(wins, F.col("lead")).otherwise(NONE).alias("label"), F.when(high, "high").when(wins, "medium").otherwise("low").alias("certainty"), conf.alias("confidence"),
        F.concat_ws("/", c.cast("string"), F.when(n == 0, F.lit(voters)).otherwise(n).cast("string")).alias("agreement"), ((n == 0) | (F.col("labels") > 1)).alias("has_disagreement"), split.alias("vote_split_pattern"), tag.alias("uncertainty_tag"),
    )


def majorities(votes: DataFrame, key: list[str], targets: list[str], confident: float = 0.8) -> DataFrame:
    """Independent majorities over several label columns of votes (pass, targets, confidence), and one certainty:
    high if all are unanimous and confident, medium if each has two votes, else needs_human_review."""
    long = votes.select(*key, "pass", "confidence", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("label")) for t in targets])).alias("x")).select(*key, "pass", "confidence", "x.target", "x.label")
    long = long.where(F.coalesce("label", F.lit("")) != "")
    per = long.groupBy(*key, "target", "label").agg(F.count("*").alias("n"), F.min("pass").alias("first"), F.sum("confidence").alias("conf"))
    top = per.groupBy(*key, "target").agg(F.sum("n").alias("n"), F.max("n").alias("count"), F.min_by("label", F.struct(-F.col("n"), "first")).alias("label"), (F.sum("conf") / F.sum("n")).alias("mean"))
    out = top.groupBy(*key).agg(*[F.max(F.when(F.col("target") == t, F.when(F.col("count") >= 2, F.col("label")).otherwise("needs_human_review"))).alias(t) for t in targets], F.bool_and(F.col("count") == F.col("n")).alias("_all"), F.min("count").alias("_least"), F.min("mean").alias("_mean"))
    certainty = F.when(F.col("_all") & (F.col("_least") >= 2) & (F.col("_mean") >= confident), "high").when(F.col("_least") >= 2, "medium").otherwise("needs_human_review")
    return out.withColumn("certainty", certainty).drop("_all", "_least", "_mean")


def escalated(first: DataFrame, second: DataFrame, prior: DataFrame, key: list[str]) -> DataFrame:
    """Label of the first tier that has one, else of the second, else the prior; tier says which."""
    a, b, c = (d.select(*key, F.when(F.coalesce("label", F.lit(NONE)) != NONE, F.col("label")).alias(n)) for d, n in ((first, "_a"), (second, "_b"), (prior, "_c")))
    out = c.join(a, key, "left").join(b, key, "left")
    tier = F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second").otherwise("prior")
    return out.select(*key, F.coalesce("_a", "_b", "_c").alias("label"), tier.alias("tier"))


def needs_escalation(df: DataFrame, threshold: float, bad: list[str]) -> DataFrame:
    """Rows without a label, below the confidence, for review, or accepted with a bad label."""
    label = F.coalesce("label", F.lit(""))
    return df.where((label == "") | (F.coalesce("confidence", F.lit(0.0)) < threshold) | (label == "needs_human_review") | ((F.col("role") == "accepted") & label.isin(*bad)))


def label_counts(df: DataFrame, groups: list[str]) -> DataFrame:
    """Counts by label, over all and by each group in turn, in one pass; ``level`` names the group."""
    sets = ", ".join(["(label)", *[f"(label, `{g}`)" for g in groups]])
    level = "CASE " + " ".join(f"WHEN grouping(`{g}`) = 0 THEN '{g}'" for g in groups) + " ELSE 'all' END"
    cols = ", ".join(f"`{g}`" for g in groups)
    return df.sparkSession.sql(f"SELECT {level} AS level, label, {cols}, count(*) AS n FROM {{d}} GROUP BY GROUPING SETS ({sets})", d=df)


def rate(hit: Column, of: Column | None = None) -> Column:
    """Share of rows that hit among those that count; 0 if none counts."""
    n = F.count_if(of) if of is not None else F.count("*")
    k = F.count_if(hit & of) if of is not None else F.count_if(hit)
    return F.when(n == 0, 0.0).otherwise(k / n)


def hit_rates(ranked: DataFrame, truth: DataFrame, by: list[str], k: int) -> DataFrame:
    """Per group of queries with a truth: n, first-place rate, rate in the first k."""
    found = ranked.join(truth, "query_id").where("term_id = expected_id").groupBy("query_id").agg(F.min("rank").alias("at"))
    df = truth.join(found, "query_id", "left")
    return df.groupBy(*by).agg(F.count("*").alias("n"), rate(F.coalesce(F.col("at") == 1, F.lit(False))).alias("top1"), rate(F.coalesce(F.col("at") <= k, F.lit(False))).alias("in_top_k"))


def flips(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Counts of right and wrong in two runs (key, right)."""
    both = old.select(*key, F.col("right").alias("o")).join(new.select(*key, F.col("right").alias("n")), key)
    return both.agg(F.count_if(~F.col("o") & F.col("n")).alias("wrong_to_right"), F.count_if(F.col("o") & ~F.col("n")).alias("right_to_wrong"), F.count("*").alias("n"))


def run_diff(old: DataFrame, new: DataFrame, key: list[str], value: str, score: str | None = None) -> DataFrame:
    """Full outer comparison: new, lost, same, changed; with a score also improved and regressed."""
    a = old.select(*key, F.col(value).alias("old_value"), *([F.col(score).alias("old_score")] if score else []), F.lit(True).alias("_a"))
    b = new.select(*key, F.col(value).alias("new_value"), *([F.col(score).alias("new_score")] if score else []), F.lit(True).alias("_b"))
    out = a.join(b, key, "full")
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "lost").when(F.col("old_value").eqNullSafe(F.col("new_value")), "same")
    if score:
        status = status.when(F.col("new_score") > F.col("old_score"), "improved").when(F.col("new_score") < F.col("old_score"), "regressed")
    return out.withColumn("status", status.otherwise("changed")).drop("_a", "_b")


def transitions(diff: DataFrame, a: str = "old_value", b: str = "new_value") -> DataFrame:
    return diff.groupBy(F.col(a).alias("from"), F.col(b).alias("to")).agg(F.count("*").alias("n"))


def regressions(old: DataFrame, new: DataFrame, key: list[str], targeted: DataFrame) -> DataFrame:
    """Keys now wrong that were not before, but for the targeted."""
    return new.where("label = 'wrong'").join(old.where("label <> 'wrong'"), key, "left_semi").join(targeted, key, "left_anti")


def votes_kept(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """New rows with the old label where the top term did not change, else null."""
    before = old.select(*key, F.col("term_id").alias("_t"), F.col("label").alias("_l"))
    return new.join(before, key, "left").withColumn("label", F.when(F.col("term_id").eqNullSafe(F.col("_t")), F.col("_l"))).drop("_t", "_l")


def key_aliases(votes: DataFrame, old: str, new: str) -> DataFrame:
    """Votes, and those under the key prefix ``old`` again under ``new`` where there are none."""
    copies = votes.where(F.startswith("key", F.lit(old))).withColumn("key", F.concat(F.lit(new), F.expr(f"substring(key, {len(old) + 1})")))
    return votes.unionByName(copies.join(votes, "key", "left_anti"))


def score_band(score: Column) -> Column:
    return F.when(score == 0, "no_result").when(score >= 0.9, "high").when(score >= 0.6, "review").otherwise("low")


def high_but_wrong(df: DataFrame, least: float = 0.75) -> DataFrame:
    return df.where((F.col("kind") == "abbrev") & (F.col("label") == "wrong") & (F.col("score") >= least)).orderBy(F.desc("score"))


def contingency(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column value, missing ones under "missing"."""
    full = df.withColumn(column, F.coalesce(F.col(column), F.lit("missing")))
    return full.groupBy(row).pivot(column, [*values, "missing"]).count().na.fill(0)


def weighted_cost(usage: DataFrame, prices: DataFrame, by: str, tokens: list[str], per: float = 1e6) -> DataFrame:
    """Sum of tokens times price over a price table (by, price_<tokens>)."""
    cost = sum((F.col(t) * F.col(f"price_{t}") / per for t in tokens), F.lit(0.0))
    return usage.join(prices, by).groupBy(by).agg(F.sum(cost).alias("cost"))


def best_variant(results: DataFrame, truth: DataFrame, key: str, variants: tuple[str, str]) -> DataFrame:
    """Accuracy of each variant on the labelled keys, and which is better; the second wins ties."""
    acc = results.join(truth, key).groupBy("variant").agg(F.avg((F.col("label") == F.col("expected")).cast("int")).alias("accuracy"))
    order = F.struct("accuracy", (F.col("variant") == variants[1]).cast("int"))
    return acc.withColumn("chosen", F.col("variant") == F.max_by("variant", order).over(Window.partitionBy()))


def index_percentile(df: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    """The value at place int(q * n) of the sorted values."""
    # Equal values are counted before the shuffle; only distinct ones are ordered.
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    upto, total = F.sum("_n").over(w.orderBy(value)), F.sum("_n").over(w)
    reached = counts.withColumn("_upto", upto).withColumn("_total", total).where(F.col("_upto") >= F.floor(F.col("_total") * q) + 1)
    return reached.groupBy(*by).agg(F.min(value).alias(f"p{int(q * 100)}"))


def bucket(text: Column, patterns: list[tuple[str, str]], otherwise: str) -> Column:
    """Name of the first pattern that the text matches."""
    out = F.when(F.lit(False), F.lit(""))
    for pattern, name in patterns:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def nearest_by_tokens(queries: DataFrame, terms: DataFrame, k: int = 6) -> DataFrame:
    """(query_id, term_id, overlap): the k terms of highest token Jaccard, found through shared tokens."""
    q = queries.select("query_id", F.array_distinct(T.split_words(F.lower("query"))).alias("qt"))
    t = terms.select("term_id", F.array_distinct(T.split_words(F.lower("name"))).alias("tt"))
    shared = q.select("query_id", F.size("qt").alias("qn"), F.explode("qt").alias("w")).join(t.select("term_id", F.size("tt").alias("tn"), F.explode("tt").alias("w")), "w")
    pairs = shared.groupBy("query_id", "term_id", "qn", "tn").agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("overlap", F.col("n") / (F.col("qn") + F.col("tn") - F.col("n")))
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "term_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "term_id", "overlap")


def dictionary_seeds(diff: DataFrame, key: str = "query") -> DataFrame:
    """First row by case-folded key of what changed from aligned to wrong or partial."""
    bad = diff.where("old_value = 'aligned' AND new_value IN ('wrong', 'partial_or_narrower')")
    return first_row(bad.withColumn("_k", F.lower(key)), ["_k"], [F.col(key)]).orderBy("_k").drop("_k")


def valid_batch(asked: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """Problems of a batch: keys missing, unknown or answered twice; empty if it is sound."""
    missing = asked.join(answered, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    unknown = answered.join(asked, key, "left_anti").select(key, F.lit("unknown").alias("problem")).distinct()
    twice = answered.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("problem"))
    return missing.unionByName(unknown).unionByName(twice)


def guarded(answers: DataFrame, candidates: DataFrame, relations: tuple[str, ...] = ("'=", "<", ">"), k: int = 4) -> DataFrame:
    """Answers whose id is a candidate and whose relation is known, once an id, at most k a query."""
    good = answers.where(F.col("relation").isin(*relations)).join(candidates.select("query_id", "term_id").distinct(), ["query_id", "term_id"], "left_semi")
    good = first_row(good, ["query_id", "term_id"], [F.col("ord")])
    w = Window.partitionBy("query_id").orderBy("ord")
    return good.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def class_majority(votes: DataFrame, key: list[str], worst: str = "unsuitable") -> DataFrame:
    """Majority of label, and apart from it of suitability (ties: ``worst``) and of class_ok (ties: false)."""
    out = majority(votes, key)
    tops = []
    for c, tie in (("suitability", F.lit(worst)), ("class_ok", F.lit(False))):
        per = votes.where(F.col(c).isNotNull()).groupBy(*key, c).agg(F.count("*").alias("n"))
        top = per.groupBy(*key).agg(F.max("n").alias("m"), F.max_by(c, "n").alias("_v"), F.sort_array(F.collect_list("n"), asc=False).alias("_n"))
        tied = (F.size("_n") > 1) & (F.get("_n", F.lit(0)) == F.get("_n", F.lit(1)))
        tops.append(top.select(*key, F.when(tied, tie).otherwise(F.col("_v")).alias(c)))
    for t in tops:
        out = out.join(t, key, "left")
    return out


def reviewed(df: DataFrame, accept: DataFrame, reject: DataFrame, key: list[str]) -> DataFrame:
    """Metrics of a run (key, term_id) against reviewed rows: accepted ids that stayed or changed, rejected ids that
    changed, and rejected rows whose name now contains the wanted target (reject: key, term_id, target)."""
    a = accept.select(*key, F.col("term_id").alias("_was")).join(df, key)
    r = reject.select(*key, F.col("term_id").alias("_was"), "target").join(df, key)
    left = a.agg(F.count_if(F.col("term_id") == F.col("_was")).alias("accept_same"), F.count_if(~F.col("term_id").eqNullSafe(F.col("_was"))).alias("accept_changed"))
    right = r.agg(F.count_if(~F.col("term_id").eqNullSafe(F.col("_was"))).alias("reject_changed"), F.count_if((F.col("target") != "") & T.contains_folded(F.col("name"), F.col("target"))).alias("target_matched"))
    return left.join(right)  # one row each


def routed(df: DataFrame, routes: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """Each row with the name of the first route that takes it."""
    out = F.when(F.lit(False), F.lit(""))
    for name, takes in routes:
        out = out.when(takes, name)
    return df.withColumn("route", out.otherwise(otherwise))


def migrated(source: DataFrame, target: DataFrame, keys: DataFrame, key: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """source without the keyed rows, and target with them under a new label; an unknown key is an error."""
    if not keys.join(source, key, "left_anti").isEmpty():
        raise ValueError(f"keys missing by {key}")
    moved = source.join(keys, key, "left_semi").withColumn("label", F.lit(label))
    return source.join(keys, key, "left_anti"), target.unionByName(moved, allowMissingColumns=True)


def review_order(df: DataFrame, flags: list[str]) -> DataFrame:
    """By dataset, place of the flag in the list (others last), score, and query, case aside."""
    place = F.coalesce(F.nullif(F.array_position(T.words_array(flags), F.col("flag")), F.lit(0)), F.lit(len(flags) + 1))
    return df.orderBy("dataset", place, "score", F.lower("query"))


def relation_shares(df: DataFrame) -> DataFrame:
    """By relation: rows, and the share whose label agrees with it."""
    fits = ((F.col("relation") == "'=") & (F.col("label") == "aligned")) | ((F.col("relation") == "<") & (F.col("label") == "broader_parent")) | ((F.col("relation") == ">") & (F.col("label") == "partial_or_narrower"))
    return df.groupBy("relation").agg(F.count("*").alias("n"), rate(fits).alias("consistent"))
