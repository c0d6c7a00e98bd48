"""The searchable side: terms, their aliases, and the statistics that retrieval needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.similarity import composed
from ..lexicon import Lexicon
from ..session import stored
from .expand import alias_forms, first_of_each, numbered, rewritten

TERM_COLUMNS = ("term_id", "name", "acronym", "alt_name", "alt_acronym", "parent_id", "sort_order", "depth")


@dataclass
class Index:
    """terms; aliases (term_id, alias_ord, alias, norm, tokens); postings (token, term_id, alias_ord, tf, doc_len);
    frequencies (token, df). The number of aliases and their mean length are counted when they are asked for."""

    terms: DataFrame
    aliases: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    lexicon: Lexicon
    counts: tuple[int, float] | None = None

    def _counted(self) -> tuple[int, float]:
        if self.counts is None:
            got = self.aliases.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("m")).first()
            self.counts = got["n"], float(got["m"] or 0.0)
        return self.counts

    @property
    def entries(self) -> int:
        return self._counted()[0]

    @property
    def mean_length(self) -> float:
        return self._counted()[1]


def inferred_depth(parent_row, levels: list) -> object:
    """Row number of the parent and one, if it is a number; else the last filled level; else 0."""
    filled = F.filter(F.array(*[F.when(T.stripped(c) != "", F.lit(i)) for i, c in enumerate(levels)]), lambda x: x.isNotNull()) if levels else F.array().cast("array<int>")
    return F.when(T.stripped(parent_row).rlike("^[0-9]+$"), F.expr("0").cast("int") + T.stripped(parent_row).try_cast("int") + 1).otherwise(F.coalesce(F.array_max(filled), F.lit(0)))


def with_defaults(terms: DataFrame) -> DataFrame:
    """All columns of a catalog, texts in NFKC; missing ones empty, rows without a name left out."""
    have = set(terms.columns)
    cols = [composed(T.stripped(F.col(c))).alias(c) if c in have else F.lit("").alias(c) for c in TERM_COLUMNS[1:-1]]
    depth = F.coalesce(F.col("depth").cast("int"), F.lit(0)) if "depth" in have else F.lit(0)
    more = F.col("more_aliases") if "more_aliases" in have else F.array().cast("array<string>")
    return terms.select(F.col("term_id").cast("string").alias("term_id"), *cols, depth.alias("depth"), more.alias("more_aliases")).where("name <> ''")


def term_aliases(terms: DataFrame, lexicon: Lexicon, rules: DataFrame | None = None) -> DataFrame:
    """(term_id, alias_ord, alias, norm, tokens); two-way rules only, and no alias of generic words but the first."""
    raw = F.concat(F.array("name", "acronym", "alt_name", "alt_acronym"), F.coalesce("more_aliases", F.array().cast("array<string>")))
    df = terms.select("term_id", F.posexplode(raw).alias("i", "alias")).where(T.normalize(F.col("alias")) != "")
    df = df.select("term_id", "i", F.posexplode(alias_forms(F.col("alias"))).alias("j", "text")).select("term_id", F.array("i", "j").alias("ord"), "text")
    two_way = rules.where("bidirectional") if rules is not None else None
    df = first_of_each(rewritten(df, ["term_id"], two_way), ["term_id"])
    first = F.min("ord").over(Window.partitionBy("term_id"))
    generic = T.words_array(lexicon.generic)
    telling = F.exists(T.split_words(F.col("norm")), lambda t: ~F.array_contains(generic, t))
    df = df.withColumn("_first", first).where((F.col("ord") == F.col("_first")) | telling)
    df = numbered(df, ["term_id"], "alias_ord")
    return df.select("term_id", "alias_ord", F.col("text").alias("alias"), "norm", T.tokenize(F.col("norm"), lexicon).alias("tokens"))


def postings_of(aliases: DataFrame) -> DataFrame:
    long = aliases.select("term_id", "alias_ord", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("token"))
    return long.groupBy("token", "term_id", "alias_ord", "doc_len").agg(F.count("*").cast("int").alias("tf"))


def frequencies_of(aliases: DataFrame) -> DataFrame:
    """(token, df): aliases that hold a token, counted before they are shuffled."""
    return aliases.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def build_index(terms: DataFrame, lexicon: Lexicon | None = None, rules: DataFrame | None = None) -> Index:
    """Index of a catalog, written to the shared folder, so that searches read tables and plan nothing of it again.

    What scoring asks of a term's aliases is folded into the term once. ``sources.snapshot`` keeps an index longer.
    """
    lexicon = lexicon or Lexicon()
    terms = with_defaults(terms)
    aliases = stored(term_aliases(terms, lexicon, rules), "index-aliases")
    postings = stored(postings_of(aliases), "index-postings")
    frequencies = stored(frequencies_of(aliases), "index-frequencies")
    a = F.col("alias")
    folded = (
        aliases.select("term_id", "alias_ord", "norm", "tokens", T.content_tokens(a, lexicon).alias("content"), T.specificity_terms(a, lexicon).alias("specific"), T.area_ids(a).alias("areas"))
        .groupBy("term_id")
        .agg(F.array_sort(F.collect_list(F.struct("alias_ord", "norm", "tokens", "content", "specific", "areas"))).alias("x"))
        .select(
            "term_id",
            F.transform("x.tokens", F.array_distinct).alias("alias_tokens"),
            F.array_join("x.norm", " ").alias("alias_text"),
            *[F.array_distinct(F.flatten(f"x.{n}")).alias(f"alias_{n}") for n in ("content", "specific", "areas")],
        )
    )
    terms = stored(terms.drop("more_aliases").join(folded, "term_id"), "index-terms")
    return Index(terms, aliases, postings, frequencies, lexicon)
