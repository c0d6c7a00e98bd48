"""Summaries of runs: rates by group, what a change did, and how a corpus fared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import LABEL_WORTH
from .curate import improvability
from .evaluate import rate
from .rank import first_row

FITS = {"'=": "aligned", "<": "broader_parent", ">": "partial_or_narrower"}


def group_rates(df: DataFrame, by: str, within: str) -> DataFrame:
    """By ``by``, and by ``by`` and ``within``, in one pass (``within`` is null for the whole): n, aligned_rate,
    aligned_or_parent_rate, id_match_rate over rows with a truth (null without one), and counts of ids that exist and
    that do not (hallucinated).

    Needs label, expected_id, found_id and id_exists.
    """
    aligned, parent = F.col("label") == "aligned", F.col("label") == "broader_parent"
    truth = T.text_of(F.col("expected_id")) != ""
    answered = T.text_of(F.col("found_id")) != ""
    flagged = df.select(
        by, within, aligned.cast("int").alias("a"), (aligned | parent).cast("int").alias("p"), truth.cast("int").alias("t"),
        (truth & F.col("found_id").eqNullSafe(F.col("expected_id"))).cast("int").alias("m"), (answered & F.col("id_exists")).cast("int").alias("e"), (answered & ~F.col("id_exists")).cast("int").alias("h"),
    )
    sums = F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "apmteh"]
    out = flagged.groupingSets([[by], [by, within]], by, within).agg(F.grouping(within).alias("_whole"), *sums)
    share = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("n"), 4)
    return out.select(
        by, F.when(F.col("_whole") == 0, F.col(within)).alias(within), "n", share("a").alias("aligned_rate"), share("p").alias("aligned_or_parent_rate"),
        F.when(F.col("t") > 0, F.round(F.col("m") / F.col("t"), 4)).alias("id_match_rate"), F.col("e").alias("ids_valid"), F.col("h").alias("ids_hallucinated"),
    )


def change_records(off: DataFrame, on: DataFrame, judged: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two runs (key, id, label; on: key, id, relation) in both: off_id, off_label, on_id, relation, changed and
    on_label. Where the id did not change the old label stays; else ``judged`` (key, id, label) has the new one."""
    a = off.select(*key, F.col("id").alias("off_id"), F.col("label").alias("off_label"))
    b = on.select(*key, F.col("id").alias("on_id"), "relation")
    out = a.join(b, key).withColumn("changed", (T.text_of(F.col("on_id")) != "") & ~F.col("on_id").eqNullSafe(F.col("off_id")))
    new = judged.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("id").alias("_id"), F.col("label").alias("_label"))
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in key], F.col("on_id") == F.col("_id"))
    out = out.join(new, same & F.col("changed"), "left")
    return out.withColumn("on_label", F.when(F.col("changed"), F.coalesce("_label", F.lit("no_consensus"))).otherwise(F.col("off_label"))).drop("_id", "_label", *[f"_{k}" for k in key])


def change_summary(records: DataFrame) -> DataFrame:
    """One row over ``change_records``: counts before and after, changed, improved, regressed, and how many of the
    changed rows with a relation have the label that it asks for."""
    worth = F.create_map(*[F.lit(x) for kv in LABEL_WORTH.items() for x in kv])
    of = lambda c: F.coalesce(F.element_at(worth, F.col(c)), F.lit(0))
    useful = lambda c: F.count_if(F.col(c).isin("aligned", "broader_parent"))
    asked = F.element_at(F.create_map(*[F.lit(x) for kv in FITS.items() for x in kv]), F.col("relation"))
    changed, related = F.col("changed"), F.col("changed") & F.col("relation").isin(*FITS)
    return records.agg(
        F.count("*").alias("n"), useful("off_label").alias("off_useful"), useful("on_label").alias("on_useful"),
        F.count_if(F.col("off_label") == "aligned").alias("off_aligned"), F.count_if(F.col("on_label") == "aligned").alias("on_aligned"),
        F.count_if(T.text_of(F.col("off_id")) == "").alias("off_no_match"), F.count_if(T.text_of(F.col("on_id")) == "").alias("on_no_match"),
        F.count_if(changed).alias("changed"), F.count_if(changed & (of("on_label") > of("off_label"))).alias("improved"),
        F.count_if(changed & (of("on_label") < of("off_label"))).alias("regressed"), F.count_if(changed & (of("on_label") == of("off_label"))).alias("same_worth"),
        F.count_if(related).alias("related"), F.count_if(related & (F.col("on_label") == asked)).alias("consistent"),
    )


def corpus_names(results: DataFrame, source: DataFrame, core: DataFrame, challenge: DataFrame, order: str = "ord") -> DataFrame:
    """One row a name of a run: its first result (term_id, score, review_flag), its first source row (species,
    category), its papers, the expected id of the core, whether it is a challenge, and what it is due to."""
    name = ["structure_name"]
    first = first_row(results, name, [F.col(order)]).select(*name, "term_id", "score", "review_flag")
    meta = first_row(source, name, [F.col(order)]).select(*name, "species", "category")
    papers = source.groupBy(*name).agg(F.array_join(F.array_sort(F.collect_set("paper")), "; ").alias("papers"))
    out = first.join(meta, name).join(papers, name).join(core.select(*name, "expected_id"), name, "left").join(challenge.select(*name, F.lit(True).alias("in_challenge")).distinct(), name, "left")
    due = improvability(F.col("structure_name"), F.col("species"), F.col("score"), F.col("review_flag"), F.col("expected_id"), F.col("term_id"))
    return out.withColumns({"in_challenge": F.coalesce("in_challenge", F.lit(False)), "in_core": F.col("expected_id").isNotNull(), "due": due})


def corpus_summary(names: DataFrame) -> DataFrame:
    """(part, key, n) over ``corpus_names``: names by flag, by species and flag, by what they are due to, core names
    that match and that do not, and the patterns of what can be improved."""
    improvable = F.col("due") == "improvable"
    flag = T.text_of(F.col("review_flag"))
    part = lambda p, k: F.struct(F.lit(p).alias("part"), k.alias("key"))
    when = lambda c, x: F.when(c, x)
    tag = lambda c, n: when(improvable & c, part("tag", F.lit(n)))
    parts = [
        part("flag", flag), part("due", F.col("due")), part("species", F.concat_ws(":", "species", flag)),
        when(F.col("in_core"), part("core", F.when(F.col("expected_id").eqNullSafe(F.col("term_id")), "match").otherwise("mismatch"))),
        tag(F.contains("structure_name", F.lit("(")), "parenthetical"), tag(F.col("in_challenge"), "known_challenge"), tag(F.col("in_core"), "core_regression"),
        *[tag(flag == f, f) for f in ("needs_review", "low_confidence", "modifier_conflict")], tag((F.col("species") == "Human") & ~F.col("in_core"), "human_paper_specific"),
    ]
    long = names.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.part", "x.key")
    return long.groupBy("part", "key").agg(F.count("*").alias("n"))


def paper_totals(source: DataFrame, names: DataFrame) -> DataFrame:
    """By paper: rows, and rows whose name matched with each flag."""
    of = lambda f: F.count_if(F.col("review_flag") == f)
    return source.select("paper", "structure_name").join(names.select("structure_name", "review_flag"), "structure_name").groupBy("paper").agg(F.count("*").alias("total"), of("high_confidence").alias("high"), of("needs_review").alias("needs_review"), of("low_confidence").alias("low"))


def sub_corpus(records: DataFrame, keys: DataFrame, whole: str = "species", part: str = "corpus") -> DataFrame:
    """Records of the dataset ``whole``, and those of ``part`` whose query is among ``keys``."""
    return records.where(F.col("dataset") == whole).unionByName(records.where(F.col("dataset") == part).join(keys.select("query").distinct(), "query", "left_semi").select(*records.columns))


def label_map(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    """(by, labels): a map of counts by label, by name."""
    counts = df.groupBy(by, label).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("labels"))


def consistency(df: DataFrame) -> DataFrame:
    """By relation: rows and the share with the label that it asks for, as ``rate`` gives it."""
    asked = F.element_at(F.create_map(*[F.lit(x) for kv in FITS.items() for x in kv]), F.col("relation"))
    return df.where(F.col("relation").isin(*FITS)).groupBy("relation").agg(F.count("*").alias("n"), F.round(rate(F.col("label") == asked), 4).alias("rate"))
