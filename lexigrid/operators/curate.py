"""Judging a corpus of names before and after a run: flags, seeds, routes, and what a poor match is due to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..lexicon import (
    ALLO_MORE, ALLO_WORDS, BORDER_WORDS, CELL_MARKER, COMPOUND, CRYPTIC, FIBER, GAP_NAMES, HARD_NOTES, KIND_NOTES,
    LAYER_CUT, LAYER_ONLY, LAYER_TOKEN, MEDIUM_NOTES, TOO_BROAD,
)
from .corpus import cascade, flags
from .rank import first_row


def holds_any(text: Column, words) -> Column:
    """Whether a text contains one of the words."""
    return reduce(lambda found, w: found | F.contains(text, F.lit(w)), words, F.lit(False))


def blob(name: Column, fullname: Column) -> Column:
    return F.lower(F.concat(T.text_of(name), F.lit(" "), T.text_of(fullname)))


def difficulty(notes: Column) -> Column:
    """easy, medium or hard, by words of a curator's notes."""
    n = F.lower(T.text_of(notes))
    return F.when(holds_any(n, HARD_NOTES), "hard").when(holds_any(n, MEDIUM_NOTES), "medium").otherwise("easy")


def query_kind(name: Column, notes: Column) -> Column:
    """abbrev, ambiguous, edge, synonym or fullname, by the notes and by how the name looks."""
    n = F.lower(T.text_of(notes))
    out = F.when(F.contains(n, F.lit("abbrev")) | T.is_abbreviation(name), "abbrev")
    for kind, words in KIND_NOTES.items():
        out = out.when(holds_any(n, words), kind)
    return out.otherwise("fullname")


def name_flags(df: DataFrame) -> DataFrame:
    """df with ``rule_flags`` from structure_name, fullname, region_class, final_certainty and flash_vote_split."""
    name, full = T.stripped(F.col("structure_name")), T.stripped(F.col("fullname"))
    kind = T.stripped(F.col("region_class"))
    either = lambda pattern: name.rlike(pattern) | full.rlike(pattern)
    both = F.lower(F.concat(name, F.lit(" "), full))
    only = either(LAYER_ONLY)
    layered = ~only & either(LAYER_TOKEN)
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.concat(name, F.lit(" "), full), LAYER_CUT, " "), "[^A-Za-z]+", " "))
    allo, border = holds_any(both, (*ALLO_WORDS, *ALLO_MORE)), holds_any(both, BORDER_WORDS)
    inner = (kind == "non_neocortex") & ~allo
    found = flags(
        [
            ("rule_layer_only", only | (layered & (F.length(rest) < 3))),
            ("rule_has_layer", layered & (F.length(rest) >= 3)),
            ("rule_too_broad", F.lower(name).isin(*TOO_BROAD) | F.lower(full).isin(*TOO_BROAD)),
            ("rule_fiber", both.rlike(FIBER)),
            ("rule_cell_type", either(CELL_MARKER)),
            ("rule_compound", either(COMPOUND)),
            ("rule_cryptic_acronym", (full == "") & name.rlike(CRYPTIC) & kind.isin("ambiguous", "unresolved", "other")),
            ("rule_prior_ambiguous", kind.isin("ambiguous", "unresolved")),
            ("rule_prior_other", kind == "other"),
            ("suspect_border_in_non_neo", inner & border),
            ("suspect_cortex_word_in_non_neo", inner & ~border & both.rlike(r"\b(cortex|cortical|gyrus)\b") & ~F.contains(both, F.lit("cerebellar"))),
            ("weak_neocortex_certainty", (kind == "neocortex") & (T.stripped(F.col("final_certainty")) != "high")),
            ("flash_split", T.stripped(F.col("flash_vote_split")).isin("2-1", "1-1-1")),
            ("suspect_allo_in_neocortex", allo & (kind == "neocortex")),
        ]
    )
    return df.withColumn("rule_flags", found)


def suitability_seed(df: DataFrame) -> DataFrame:
    """df with (suitability, unsuitable_reason) where its flags decide, both empty elsewhere."""
    kind = T.stripped(F.col("region_class"))
    # Two flags count for some classes only.
    counted = F.filter("rule_flags", lambda f: F.when(f == "rule_fiber", kind == "other").when(f == "rule_cell_type", kind.isin("other", "ambiguous", "unresolved", "neocortex", "non_neocortex")).otherwise(True))
    steps = [
        (["rule_layer_only", "rule_has_layer"], "layer_only"), (["rule_too_broad"], "too_broad"), (["rule_prior_ambiguous"], "ambiguous_name"),
        (["rule_fiber"], "fiber_tract_or_ventricle"), (["rule_cell_type"], "cell_type_or_marker"), (["rule_cryptic_acronym"], "acronym_unresolved"),
        (["rule_compound"], "compound_multi_region"), (["rule_prior_other"], "other"),
    ]
    seed = cascade(counted, [(names, "unsuitable", reason) for names, reason in steps], ("", ""))
    return df.withColumn("_seed", seed).withColumn("suitability", F.col("_seed.label")).withColumn("unsuitable_reason", F.col("_seed.reason")).drop("_seed")


def adjudication_route(df: DataFrame, spotcheck: DataFrame | None = None) -> DataFrame:
    """df with ``route_reason``: why a row needs a costly second look, empty if it does not. Label risks come first,
    then rules that decide, then the record_ids of ``spotcheck``."""
    has = lambda *names: F.arrays_overlap("rule_flags", T.words_array(names))
    decided = has("rule_layer_only", "rule_has_layer", "rule_too_broad", "rule_prior_ambiguous", "rule_prior_other", "rule_cell_type", "rule_cryptic_acronym", "rule_compound")
    drawn = F.lit(False)
    if spotcheck is not None:
        df = df.join(spotcheck.select("record_id", F.lit(True).alias("_drawn")).distinct(), "record_id", "left")
        drawn = F.coalesce("_drawn", F.lit(False))
    reason = (
        F.when(has("suspect_border_in_non_neo", "suspect_cortex_word_in_non_neo"), "contamination_suspect").when(has("suspect_allo_in_neocortex"), "allo_in_neocortex")
        .when(has("weak_neocortex_certainty"), "weak_neocortex").when(has("flash_split"), "flash_split").when(decided, "").when(drawn, "spotcheck").otherwise("")
    )
    return df.withColumn("route_reason", reason).drop("_drawn")


def seed_remap(df: DataFrame, old: str = "old_label") -> DataFrame:
    """df with (needs_api, region_class, decision_stage, seed_reason) from an older labelling of the same names."""
    label, text = T.stripped(F.col(old)), blob(F.col("structure_name"), F.col("fullname"))
    hit = F.get(F.filter(T.words_array(ALLO_WORDS), lambda w: F.contains(text, w)), F.lit(0))
    keyword = (label == "cortical") & hit.isNotNull()
    kept = label.isin("neocortex", "non_neocortex", "ambiguous", "other") & (label != "ambiguous")
    kind = F.when(label == "subcortical", "non_neocortex").when(keyword, "non_neocortex").when(kept, label).otherwise("")
    reason = (
        F.when(label == "subcortical", "seed: subcortical → non_neocortex").when(label == "other", "seed: other kept")
        .when(keyword, F.concat(F.lit("seed: cortical + keyword '"), hit, F.lit("' → non_neocortex"))).when(kept, F.concat(F.lit("seed: keep "), label)).otherwise("")
    )
    stage = F.when(keyword, "seed_keyword").when(kind != "", "seed_remap").otherwise("")
    return df.withColumns({"needs_api": kind == "", "region_class": kind, "decision_stage": stage, "seed_reason": reason})


def improvability(name: Column, species: Column, score: Column, flag: Column, expected: Column, found: Column) -> Column:
    """catalog_gap, limited, improvable or ok for a name of a run, the first that fits: a name of no single region; a
    doubtful match of a species with labels of its own; another id than expected (empty: none is); a doubtful flag;
    nothing found."""
    poor = F.coalesce(score, F.lit(0.0))
    return (
        F.when(T.text_of(name).rlike(GAP_NAMES), "catalog_gap")
        .when(species.isin("Macaque", "Rat") & (T.text_of(flag) != "high_confidence") & (poor < 0.75), "limited")
        .when((T.text_of(expected) != "") & (T.text_of(expected) != T.text_of(found)), "improvable")
        .when(T.text_of(flag).isin("needs_review", "low_confidence", "modifier_conflict"), "improvable")
        .when(poor == 0, F.when(T.text_of(species) != "Human", "catalog_gap").otherwise("improvable"))
        .otherwise("ok")
    )


def failure_category(df: DataFrame, known: DataFrame, gaps: list[str], default: tuple[str, str] = ("B_algo", "low score, unclear match")) -> DataFrame:
    """df (query, methods, review_flag) with (category, note): by a reviewed table (query, category, note) where it has
    the query, else by patterns of names that the catalog does not divide so far, else by how the match came about."""
    gap = reduce(lambda found, p: found | F.col("query").rlike(p), gaps, F.lit(False))
    flag = F.col("review_flag")
    rules = [
        (gap, "D_catalog_gap", "the catalog lacks this granularity"),
        (F.contains("methods", F.lit("exact")), "A_effectively_correct", "exact base match; subdivision not in the catalog"),
        (flag == "modifier_conflict", "A_effectively_correct", "modifier de-specified to correct parent"),
        (flag == "needs_review", "A_effectively_correct", "synonym/parent match (review-only flag)"),
    ]
    pick = lambda i: reduce(lambda out, r: out.when(r[0], r[i]), rules[1:], F.when(rules[0][0], rules[0][i])).otherwise(default[i - 1])
    out = df.join(known.select("query", F.col("category").alias("_c"), F.col("note").alias("_n")), "query", "left")
    return out.withColumns({"category": F.coalesce("_c", pick(1)), "note": F.when(F.col("_c").isNotNull(), F.col("_n")).otherwise(pick(2))}).drop("_c", "_n")


def with_metadata(slim: DataFrame, full: DataFrame, columns: list[str], key: tuple[str, ...] = ("structure_name", "fullname", "species"), order: str = "ord") -> DataFrame:
    """slim rows with a name, and ``columns`` of the full table by the trimmed key, empty where there is none; of
    several full rows with one key the last by ``order`` counts. record_id: the full row's number, else slim's ``order``."""
    keys = [T.stripped(F.col(c)).alias(f"_{c}") for c in key]
    rows = full.select(*keys, order, *[T.stripped(F.col(c)).alias(f"_v_{c}") for c in [*columns, "record_id"]])
    last = F.max_by(F.struct(*[f"_v_{c}" for c in [*columns, "record_id"]]), order).alias("_x")
    rows = rows.groupBy(*[f"_{c}" for c in key]).agg(last)
    clean = slim.withColumns({c: T.stripped(F.col(c)) for c in key}).where(F.col(key[0]) != "")
    out = clean.join(rows, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in key]), "left")
    number = T.stripped(F.col("_x._v_record_id")).try_cast("long")
    out = out.withColumns({**{c: F.coalesce(F.col(f"_x._v_{c}"), F.lit("")) for c in columns}, "record_id": F.coalesce(number, F.col(order).cast("long"))})
    return out.drop("_x", *[f"_{c}" for c in key])


def by_kind(df: DataFrame, key: str, kinds: tuple[str, ...], columns: list[str], order: str) -> DataFrame:
    """One row a key with ``<kind>_<column>`` for each kind, the last row of a kind by ``order``; null where there is none."""
    last = {k: F.max_by(F.when(F.col("query_kind") == k, F.struct(*columns)), F.when(F.col("query_kind") == k, F.col(order))) for k in kinds}
    wide = df.groupBy(key).agg(*[x.alias(k) for k, x in last.items()])
    return wide.select(key, *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in kinds for c in columns])


def abbreviation_candidates(wide: DataFrame, existing: DataFrame) -> DataFrame:
    """(abbrev, expansion, priority, mentions, reason) of abbreviations that a rule would help.

    ``wide``: abbrev_ and fullname_ columns query, label, term_id, score, mentions, fullname, as ``by_kind`` gives them;
    ``existing``: rules (abbrev, expansion) there already.
    """
    c = F.col
    abbrev, label, other = T.stripped(c("abbrev_query")), T.text_of(c("abbrev_label")), T.text_of(c("fullname_label"))
    own = T.stripped(c("fullname_query"))
    expansion = F.when(own != "", own).otherwise(T.stripped(c("abbrev_fullname")))
    found, full_found = T.text_of(c("abbrev_term_id")) != "", T.text_of(c("fullname_term_id")) != ""
    cases = [
        (~found & full_found & other.isin("aligned", "broader_parent"), 1, F.concat(F.lit("no_match→fullname_"), other)),
        ((label == "wrong") & (other == "aligned"), 2, F.lit("abbrev_wrong_fullname_aligned")),
        ((label == "wrong") & (F.coalesce(c("abbrev_score"), F.lit(0.0)) >= 0.9) & full_found, 3, F.lit("abbrev_wrong_highconf")),
        (~found, 4, F.lit("abbrev_no_match_has_fullname")),
    ]
    pick = lambda i: reduce(lambda out, r: out.when(r[0], r[i]), cases[1:], F.when(cases[0][0], cases[0][i]))
    out = wide.select(abbrev.alias("abbrev"), expansion.alias("expansion"), pick(1).alias("priority"), F.coalesce(c("abbrev_mentions"), F.lit(0)).alias("mentions"), pick(2).alias("reason"))
    out = out.where((F.col("expansion") != "") & (F.lower("expansion") != F.lower("abbrev")) & F.col("abbrev").rlike("^[A-Za-z][A-Za-z0-9]{1,5}$") & F.col("priority").isNotNull())
    there = existing.select(F.lower(T.stripped(F.col("abbrev"))).alias("_a"), F.lower(T.stripped(F.col("expansion"))).alias("_e")).distinct()
    return out.join(there, (F.lower("abbrev") == F.col("_a")) & (F.lower("expansion") == F.col("_e")), "left_anti")


def best_rules(candidates: DataFrame, least: dict[int, int] = {1: 0, 2: 0, 3: 5, 4: 15}) -> DataFrame:  # noqa: B006
    """One candidate an abbreviation, of the least priority, then of most mentions; those with fewer mentions than
    their priority asks for are left out."""
    best = first_row(candidates.withColumn("_k", F.lower("abbrev")), ["_k"], [F.col("priority"), F.desc("mentions"), F.col("expansion")])
    needed = F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("priority"))
    return best.where(F.col("mentions") >= needed).drop("_k")


def by_mentions(df: DataFrame, mentions: str = "n_mentions", name: str = "name", place: str = "place") -> DataFrame:
    """Rows most mentioned first, then by name, case aside; ``place`` numbers them over range partitions, so that no
    task sees all rows."""
    from ..session import stored

    ordered = stored(df.repartitionByRange(F.desc(mentions), F.lower(name), F.col(name)).withColumn("_part", F.spark_partition_id()), "by-mentions")
    w = Window.partitionBy("_part").orderBy(F.desc(mentions), F.lower(name), F.col(name))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row a partition
    return ordered.join(F.broadcast(before), "_part").withColumn(place, F.row_number().over(w) + F.col("_before")).drop("_part", "_before")


def filled_pick(df: DataFrame, stratum: str, quotas: dict[str, int], key: Column, order: list, fill: DataFrame, fill_order: list, cap: dict[str, int], first: list[str], source: str) -> DataFrame:
    """Up to a quota of rows of each stratum, one a key; strata that fall short take rows of ``fill`` whose key is not
    taken yet; strata above a ``cap`` keep rows of the sources ``first`` and give up others first, the last by ``order``."""
    limit = lambda d: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col(stratum)), F.lit(0))
    once = first_row(df.withColumn("_key", key), ["_key"], order)
    own = Window.partitionBy(stratum)
    picked = once.withColumn("_n", F.row_number().over(own.orderBy(*order))).where(F.col("_n") <= limit(quotas)).drop("_n")
    have = picked.groupBy(stratum).agg(F.count("*").alias("_have"))
    more = first_row(fill.withColumn("_key", key), ["_key"], fill_order).join(picked.select("_key"), "_key", "left_anti").join(have, stratum, "left")
    more = more.withColumn("_n", F.row_number().over(own.orderBy(*fill_order))).where(F.col("_n") <= limit(quotas) - F.coalesce("_have", F.lit(0))).drop("_n", "_have")
    every = picked.unionByName(more)
    keeps = F.when(F.col(source).isin(*first), 0).otherwise(1)
    over = own.orderBy(keeps, *order)
    capped = every.withColumn("_n", F.row_number().over(over)).withColumn("_keeps", keeps)
    most = F.element_at(F.create_map(*[F.lit(x) for kv in cap.items() for x in kv]), F.col(stratum))
    return capped.where(most.isNull() | (F.col("_keeps") == 0) | (F.col("_n") <= most)).drop("_n", "_keeps", "_key")
