"""One text to many: alias forms, rule rewrites, abbreviation expansions.

A form carries ``ord``, an array of integers that sorts forms as they arose. Rules meet texts through
an equi-join on the first word of the rule, never through a nested loop; whoever contains the whole
source is rewritten. Rules apply to the text as it was, not to one another's results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.similarity import boundary_contains
from ..lexicon import ROMAN, Lexicon


def rewritten(df: DataFrame, keys: list[str], rules: DataFrame | None) -> DataFrame:
    """df (keys, ord, text) and, for each rule (rule_ord, source, target) whose source a text contains, the text with the target."""
    base = df.select(*keys, F.concat("ord", F.array(F.lit(0))).alias("ord"), "text")
    if rules is None:
        return base
    rules = rules.select("rule_ord", "source", "target", F.element_at(F.split("source", " "), 1).alias("_word"))
    hits = df.withColumn("_norm", T.normalize(F.col("text"))).withColumn("_word", F.explode(F.array_distinct(T.split_words(F.col("_norm")))))
    hits = hits.join(rules, "_word").where(boundary_contains(F.col("_norm"), F.col("source")))
    made = F.regexp_replace(F.col("_norm"), F.concat(F.lit(r"\b"), F.col("source"), F.lit(r"\b")), F.col("target"))
    hits = hits.withColumn("_made", made).where("_made <> _norm")
    return base.unionByName(hits.select(*keys, F.concat("ord", F.array(F.col("rule_ord").cast("int") + 1)).alias("ord"), F.col("_made").alias("text")))


def abbreviations_expanded(df: DataFrame, keys: list[str], abbrevs: DataFrame | None, lexicon: Lexicon) -> DataFrame:
    """df and, for each abbreviation (rule_ord, abbrev, expansion), texts that are it or hold it among harmless words only."""
    base = df.select(*keys, F.concat("ord", F.array(F.lit(0))).alias("ord"), "text")
    if abbrevs is None:
        return base
    rules = abbrevs.select("rule_ord", "abbrev", "expansion", F.element_at(F.split("abbrev", " "), 1).alias("_word"))
    hits = df.withColumn("_norm", T.normalize(F.col("text"))).withColumn("_word", F.explode(F.array_distinct(T.split_words(F.col("_norm")))))
    hits = hits.join(rules, "_word").where(boundary_contains(F.col("_norm"), F.col("abbrev")))
    allowed = T.words_array(lexicon.residue)
    whole = F.col("_norm") == F.col("abbrev")
    pattern = F.concat(F.lit(r"(?<![a-z0-9])"), F.col("abbrev"), F.lit(r"(?![a-z0-9])"))
    rest = T.split_words(F.regexp_replace(F.col("_norm"), pattern, F.lit(" ")))
    harmless = F.forall(rest, lambda t: F.array_contains(allowed, t) & ~t.rlike(ROMAN) & ~t.rlike("^[0-9]+$"))
    inline = (F.length("abbrev") >= 2) & ~F.col("abbrev").rlike(ROMAN) & (F.size(rest) > 0) & harmless
    made = F.when(whole, F.col("expansion")).when(inline, F.regexp_replace(F.col("_norm"), pattern, F.col("expansion")))
    hits = hits.withColumn("_made", made).where("_made IS NOT NULL AND _made <> _norm")
    return base.unionByName(hits.select(*keys, F.concat("ord", F.array(F.col("rule_ord").cast("int") + 1)).alias("ord"), F.col("_made").alias("text")))


def first_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest of texts that normalize alike, per keys; what normalizes to nothing goes."""
    df = df.withColumn("text", T.stripped(F.col("text"))).withColumn("norm", T.normalize(F.col("text"))).where("norm <> ''")
    return df.groupBy(*keys, "norm").agg(F.min(F.struct("ord", "text")).alias("f")).select(*keys, "norm", "f.ord", "f.text")


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "norm")).cast("int"))


def alias_forms(alias) -> object:
    """Array of an alias's own forms: itself, without parentheses, their parts (also behind the rest), comma inversion."""
    bare = T.strip_parenthetical(alias)
    groups = F.regexp_extract_all(T.text_of(alias), F.lit(r"\(([^)]*)\)"), F.lit(1))
    none = F.array().cast("array<string>")

    def forms(part):
        suffix = T.normalize(part)
        return F.concat(F.array(part), F.when((suffix != "") & ~suffix.rlike("^[0-9]+$"), F.array(F.concat_ws(" ", T.normalize(bare), suffix))).otherwise(none))

    inside = F.flatten(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, "[,;/]"))), forms))
    left, right = T.stripped(F.substring_index(alias, ",", 1)), T.stripped(F.regexp_extract(alias, r"(?s)^[^,]*,(.*)$", 1))
    inverted = F.when((left != "") & (right != ""), F.array(F.concat_ws(" ", right, left))).otherwise(none)
    return F.concat(F.array(alias, bare), inside, inverted)


def query_variants(queries: DataFrame, lexicon: Lexicon, rules: DataFrame | None = None, abbrevs: DataFrame | None = None) -> DataFrame:
    """(query_id, variant, norm, variant_ord) of queries (query_id, query)."""
    q = T.text_of(F.col("query"))
    roi = T.strip_markers(q)
    forms = F.array(
        q, roi, T.strip_laterality(q, lexicon), T.strip_laterality(roi, lexicon), T.strip_parenthetical(q), T.strip_parenthetical(roi),
        T.flatten_parentheses(q), T.flatten_parentheses(roi), T.cut_exclusion(T.strip_parenthetical(roi)),
    )
    df = queries.select("query_id", F.posexplode(forms).alias("i", "text")).select("query_id", F.array("i").alias("ord"), "text")
    keys = ["query_id"]
    for step in (lambda d: rewritten(d, keys, rules), lambda d: abbreviations_expanded(d, keys, abbrevs, lexicon), lambda d: rewritten(d, keys, rules)):
        df = first_of_each(step(df), keys).select("query_id", "ord", "text", "norm") if step else df
    return numbered(df, keys, "variant_ord").select("query_id", F.col("text").alias("variant"), "norm", "variant_ord")


def abbreviation_probes(queries: DataFrame, lexicon: Lexicon, abbrevs: DataFrame | None) -> DataFrame:
    """(query_id, raw_abbrev, expansions) for queries that are or hold an abbreviation: the shortest found, and all expansions."""
    if abbrevs is None:
        return queries.select("query_id", F.lit(None).cast("string").alias("raw_abbrev"), F.array().cast("array<string>").alias("expansions")).limit(0)
    q = T.text_of(F.col("query"))
    roi = T.strip_markers(q)
    whole = F.transform(F.array(q, roi, T.strip_laterality(q, lexicon), T.strip_laterality(roi, lexicon)), T.normalize)
    probes = F.concat(whole, F.flatten(F.transform(whole, T.split_words)))
    df = queries.select("query_id", F.posexplode(F.array_distinct(probes)).alias("i", "probe"))
    hits = df.join(abbrevs.where("expansion <> abbrev"), F.col("probe") == F.col("abbrev"))
    return hits.groupBy("query_id").agg(F.min_by("probe", F.struct(F.length("probe"), F.col("i"))).alias("raw_abbrev"), F.array_sort(F.collect_set("expansion")).alias("expansions"))
