"""Queries over crafted rows: each operator meets the cases that its rules name, and the SQL beside it says what
must come out, as a table or as arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import similarity as S
from .functions import text as T
from .lexicon import AREA_ID, Lexicon
from .operators import corpus, curate, evaluate, expand, hierarchy, project, rank, retrieve, score, summary
from .operators.catalog import build_index, term_aliases, with_defaults
from .plans import matcher, stages
from .queries import query
from .session import ready, shared_dir
from .sources import snapshot
from .sources import tables as sources

LEX = Lexicon()


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int):
        return f"CAST({x} AS BIGINT)"
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    if x.startswith("=") and len(x) > 1:  # arithmetic
        return f"CAST({x[1:]} AS DOUBLE)"
    return "'" + x.replace("'", "''") + "'"


def table(names: str, *rows) -> str:
    """SQL of a table of literals; text that begins with = is arithmetic in double precision."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"


def made(spark: SparkSession, schema: str, *rows) -> DataFrame:
    return ready(spark).createDataFrame(list(rows), schema)


# --- scalars of one text

_TEXTS = [
    ("normalize", "Broca's area", "brocas area"), ("normalize", "Pre-frontal/A_B & C", "pre frontal a b and c"), ("normalize", "ﬁber²", "fiber2"), ("normalize", " \t--  ", ""),
    ("tokenize", "the Nucleus of X", "nucleus|x"), ("tokenize", "of the", ""),
    ("strip_laterality", "Left  Amygdala (right)", "amygdala"), ("strip_parenthetical", "X nucleus (y)", "X nucleus  "), ("flatten", "X nucleus (y)", "X nucleus  y "),
    ("cut_exclusion", "cortex Excluding insula", "cortex  "), ("cut_exclusion", "exceptional cortex", "exceptional cortex"),
    ("strip_markers", "amygdala neurons", "amygdala"), ("strip_markers", "SST+", "SST+"), ("strip_markers", "striatum D1R - ", "striatum"),
    ("unique", "A-b;a b; ;C;c", "A-b|C"), ("grams3", "ab", "ab"), ("grams2", "abc ab", "ab|bc|ca"), ("grams2", "--", ""),
    ("content", "posterior nucleus of amygdala", "amygdala"), ("content", "frontal lobe area", "frontal|lobe"),
    ("specificity", "the core area of amygdala", "core|area"), ("modifiers", "amygdala (central, core part)", "central|core|part|central core part"), ("modifiers", "dorsal amygdala", "dorsal"),
    ("area_ids", "area 23c and V3A 10 abcd1", "23c|v3a|10"), ("area_keys", "23c v3a 007", ":23|v:3|:7"), ("without_prefix", "precuneiform", "cuneiform"), ("without_prefix", "prelim", "none"),
    ("without_prefix", "hypothalamic", "thalamic"), ("head", "nucleus of lateral olfactory tract", "gray"), ("head", "lateral lemniscus dorsal nucleus", "gray"), ("head", "visual area", "cortex"), ("head", "foo", "none"),
    ("side", "left X", "left"), ("side", "L and R X", "unknown"), ("side", "bilateral X", "bilateral"), ("side", "both left X", "left"), ("side", "contralateral X", "right"),
    ("layer", "L5a", "true"), ("layer", "LIV", "true"), ("layer", "L7", "false"), ("layer", "layer 5", "false"),
    ("unknown", "<Unknown>", "true"), ("unknown", " null ", "true"), ("unknown", "N/A", "true"), ("unknown", "nan", "false"), ("unknown", "-", "false"), ("unknown", "", "true"),
    ("collapsed", "  A \t B ", "a b"), ("folded", "Broca's_Area!", "broca s area"), ("abbrev", "PFC", "true"), ("abbrev", "dLGN", "true"), ("abbrev", "ab", "false"), ("abbrev", "Amygdala", "false"),
    ("difficulty", "Brodmann area; synonym", "hard"), ("difficulty", "spelling variant", "medium"), ("difficulty", "plain", "easy"),
    ("kind", "Amygdala;abbreviation of it", "abbrev"), ("kind", "PFC;plain", "abbrev"), ("kind", "amygdala;plural form", "edge"), ("kind", "amygdala;collective term", "ambiguous"), ("kind", "amygdala;eponym", "synonym"), ("kind", "amygdala;", "fullname"),
    ("parenthetical", "a (b)", "true"), ("parenthetical", "a b", "false"), ("blob", "Name;Full NAME", "name full name"),
    ("relation", "=", "'="), ("relation", " '= ", "'="), ("relation", "<", "<"), ("relation", "~", "none"), ("id", "AA123", "X:AA123"), ("id", " 77 ", "X:77"), ("id", "Y:5", "Y:5"),
    ("removed", "left,Laterality;foo,bar;,marker", "left/laterality|foo/noise"), ("notes", "x | y;y | z", "x | y | z"), ("title", "pre-frontal cORTEX", "Pre-Frontal Cortex"), ("human", "the_end_of_the_day", "The End of the Day"),
    ("key_name", "12: some_name_of_it (SN)", "Some Name of It"), ("json", "```json {\"a\": 1} ``` end", "{\"a\": 1}"), ("json", "none", "none"),
    ("vote", "Broader;HIGH;1.7; why ", "broader_parent/high/1.0/why"), ("vote", "partial-or narrower;sure;x;", "partial_or_narrower/medium/0.5/"), ("vote", "nonsense;low;-2;r", "none/low/0.0/r"),
    ("cut220", "ab", "220"), ("contains", "Dorsal RAPHE;raphe", "true"), ("hit", "lesion of VTA-SNc;VTA", "true"), ("hit", "lesion of vta;VTA", "false"), ("hit", "VTAs;VTA", "false"),
]


@query(table("fn, input, output", *_TEXTS))
def q_text_scalars(spark, sf_dir):
    """Scalars of one text; arrays are joined by a bar, several arguments come apart at semicolons."""
    df = made(spark, "fn string, input string", *[r[:2] for r in _TEXTS])
    x = F.col("input")
    part = lambda i: F.coalesce(F.get(F.split(x, ";"), F.lit(i)), F.lit(""))
    bar = lambda a: F.array_join(a, "|")
    said = lambda b: b.cast("string")
    pairs = F.transform(F.split(x, ";"), lambda p: F.struct(F.substring_index(p, ",", 1).alias("text"), F.substring_index(p, ",", -1).alias("kind")))
    vote = T.vote_item(part(0), part(1), part(2), part(3))
    forms = {
        "normalize": T.normalize(S.composed(x)), "tokenize": bar(T.tokenize(x, LEX)), "strip_laterality": T.strip_laterality(x, LEX), "strip_parenthetical": T.strip_parenthetical(x), "flatten": T.flatten_parentheses(x),
        "cut_exclusion": T.cut_exclusion(x), "strip_markers": T.strip_markers(x), "unique": bar(T.distinct_normalized(F.split(x, ";"))), "grams3": bar(T.ngrams(x, 3)), "grams2": bar(T.ngrams(x, 2)),
        "content": bar(T.content_tokens(x, LEX)), "specificity": bar(T.specificity_terms(x, LEX)), "modifiers": bar(T.modifier_terms(x, LEX)), "area_ids": bar(T.area_ids(x)), "area_keys": bar(T.area_keys(F.filter(F.split(x, " "), lambda t: t.rlike(AREA_ID)))),
        "without_prefix": S.prefix_stem(x), "head": T.structure_head(T.split_words(T.normalize(x))), "side": T.laterality(x), "layer": said(T.is_layer(x)), "unknown": said(T.is_unknown(x)), "collapsed": T.collapsed(x), "folded": T.folded_name(x),
        "abbrev": said(T.is_abbreviation(x)), "difficulty": curate.difficulty(x), "kind": curate.query_kind(part(0), part(1)), "parenthetical": said(F.contains(x, F.lit("("))), "blob": curate.blob(part(0), part(1)),
        "relation": T.relation_mark(x), "id": T.prefixed_id(x, "X:"), "removed": bar(F.transform(T.removed_items(pairs, ["laterality", "marker"]), lambda r: F.concat_ws("/", r["text"], r["kind"]))), "notes": T.merged_notes(part(0), part(1)),
        "title": T.title_case(x), "human": T.humanize(x), "key_name": sources.key_table_name(x), "json": T.json_object(x), "contains": said(T.contains_folded(part(0), part(1))), "hit": said(T.dictionary_hit(part(0), part(1))),
        "vote": F.concat_ws("/", F.coalesce(vote["label"], F.lit("none")), vote["certainty"], vote["confidence"].cast("string"), vote["reason"]), "cut220": F.length(T.vote_item(x, x, x, F.repeat(x, 200))["reason"]).cast("string"),
    }
    out = F.when(F.lit(False), F.lit(""))
    for name, form in forms.items():
        out = out.when(F.col("fn") == name, F.coalesce(form, F.lit("none")))
    return df.withColumn("output", out)


# --- scalars of two texts

_PAIRS = [
    ("dice", "a|b", "b|c", 0.5), ("dice", "", "b", 0.0), ("jaccard", "a|b", "b|c", "=1.0/3"), ("jaccard", "a", "", 0.0), ("boundary", "major insular cortex", "insular cortex", 1.0), ("boundary", "retroreuniens x", "reuniens", 0.0),
    ("containment", "insular cortex", "major insular cortex", 0.92), ("containment", "cortex", "the very major insular cortex", "=6.0/29+0.25"), ("containment", "abc", "abc d", 0.0), ("ratio", "abcd", "bcde", 0.75), ("ratio", "", "", 1.0),
    ("similarity", "abcd", "bcde", "=0.35*0.75+0.25*2*2/6.0+0.2*2*1/4.0"), ("similarity", "Insular-Cortex", "insular cortex", 1.0), ("similarity", "", "x", 0.0), ("similarity", "insular cortex", "major insular cortex", 0.92),
    ("modifier", "", "alias text", 1.0), ("modifier", "Core|shell", "the core of it", 0.5), ("stem", "habenula", "habenular", 1.0), ("stem", "amygdala", "amygdaloid", 1.0), ("stem", "dorsal", "ventral", 0.0), ("stem", "abcd", "abcde", 0.0),
    ("overlap", "amygdala|x", "amygdaloid", 1.0), ("overlap", "alpha", "omega", 0.0), ("affix", "precuneiform", "cuneiform", 1.0), ("affix", "precuneiform", "precuneiform|cuneiform", 0.0), ("affix", "supramammillary", "mammillaryx", 1.0),
    ("within", "insula", "the insula", 1.0), ("within", "a", "b", 0.0), ("areas", "23c", "5", 0.0), ("areas", "6a", "6", 1.0), ("areas", "a1", "a8", 0.0), ("areas", "", "a8", 1.0), ("heads", "x nucleus", "x tract", 1.0), ("heads", "x nucleus", "x", 0.0),
]


@query(table("fn, a, b, output", *_PAIRS))
def q_pair_scalars(spark, sf_dir):
    """Scalars of two texts or arrays (joined by a bar); truths are 1 and 0."""
    df = made(spark, "fn string, a string, b string", *[r[:3] for r in _PAIRS])
    a, b = F.col("a"), F.col("b")
    of = lambda c: F.filter(F.split(c, r"\|"), lambda t: t != "")
    truth = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    head = lambda c: T.structure_head(T.split_words(T.normalize(c)))
    keys_a, keys_b = T.area_keys(of(a)), T.area_keys(of(b))
    forms = {
        "dice": S.dice(of(a), of(b)), "jaccard": S.jaccard(of(a), of(b)), "boundary": truth(S.boundary_contains(a, b)), "containment": S.containment(a, b), "ratio": S.sequence_ratio(a, b), "similarity": S.string_similarity(a, b, LEX),
        "modifier": S.modifier_match(of(a), b), "stem": truth(S.stem_match(a, b)), "overlap": truth(S.content_overlap(of(a), of(b))), "affix": truth(S.affix_mismatch(of(a), of(b))), "within": truth(S.name_within(a, b)),
        "areas": truth((F.size(keys_a) == 0) | (F.size(keys_b) == 0) | F.arrays_overlap(keys_a, keys_b)), "heads": truth(head(a) != head(b)),
    }
    out = F.when(F.lit(False), F.lit(0.0))
    for name, form in forms.items():
        out = out.when(F.col("fn") == name, form)
    return df.withColumn("output", out)


# --- the scoring chain

_TERMS = [
    ("t1", "amygdala", "AMY", "", "", ""), ("t2", "central nucleus of amygdala", "CeA", "", "", "t1"), ("t3", "medial nucleus of amygdala", "MeA", "", "", "t1"), ("t4", "area 23", "A23", "", "", ""), ("t5", "area v3", "V3", "", "", ""),
    ("t6", "olfactory tract", "OT", "", "", ""), ("t7", "cuneiform tegmentum", "CT", "", "", ""), ("t8", "pole area", "PA", "", "", ""), ("t9", "raphe nucleus", "RN", "", "", ""), ("t10", "cuneiform nucleus", "CN", "", "", ""),
    ("t11", "median eminence zone", "MEA", "", "", ""), ("t12", "mea complex", "XX", "", "", ""), ("t13", "raphe nuclei complex nucleus", "RC", "", "", ""),
]
_QUERIES = {
    "a": "amygdala", "b": "amygdala region", "c": "central amygdala", "d": "amygdala part", "e": "area 24", "f": "v3 cortex", "g": "olfactory nucleus", "h": "precuneiform tegmentum", "i": "frontal pole", "j": "raphe nuclei",
    "k": "precuneiform nucleus", "l": "MEA", "m": "amygdala (central)", "n": "amygdala (shell)",
}
#: (query, term, exact, fuzzy, bm25, matched query or None for the query itself)
_FOUND = [
    ("a", "t1", 1.0, 0.0, 0.0, None), ("b", "t1", 0.0, 0.6, 0.5, None), ("c", "t2", 0.0, 0.8, 0.6, None), ("c", "t3", 0.0, 0.7, 0.4, None), ("d", "t2", 0.0, 0.6, 0.0, None), ("e", "t4", 0.0, 0.8, 0.0, None), ("f", "t5", 0.0, 0.6, 0.0, None),
    ("g", "t6", 0.0, 0.7, 0.5, None), ("h", "t7", 0.0, 0.9, 0.0, None), ("i", "t8", 0.0, 0.7, 0.0, None), ("j", "t9", 0.0, 0.9, 0.5, None), ("j", "t13", 0.0, 0.9, 0.5, None), ("k", "t10", 0.0, 0.9, 0.0, None),
    ("l", "t11", 1.0, 0.0, 0.0, None), ("l", "t12", 1.0, 0.0, 0.0, None), ("l", "t3", 1.0, 0.5, 0.0, "medial nucleus of amygdala"), ("m", "t1", 1.0, 0.0, 0.0, "amygdala"), ("n", "t1", 1.0, 0.0, 0.0, "amygdala"),
]
#: What the chain makes of them, as arithmetic: the base of exact, fuzzy f, bm25 b and token score t is the largest of
#: exact, .5f + .3b + .2t and .75f + .25t; then come the factors of the steps.
_CHAIN = [
    ("a", "t1", "exact", "=1.0", 1.0, "", False, False),
    ("b", "t1", "bm25+fuzzy", "=0.75*0.6+0.25/2", 1.0, "", False, False),
    ("c", "t2", "bm25+fuzzy", "=0.75*0.8+0.25*2/3+0.12", 1.0, "central", False, False),
    ("c", "t3", "bm25+fuzzy", "=0.88*(0.75*0.7+0.25/4)", 0.0, "central", False, False),
    ("d", "t2", "fuzzy", "=0.86*(0.75*0.6+0.25/4)", 1.0, "", False, False),
    ("e", "t4", "fuzzy", "=0.4*(0.75*0.8+0.25/3)", 1.0, "", False, False),
    ("f", "t5", "fuzzy", "=0.75*0.6+0.25/2+0.08", 1.0, "", False, False),
    ("g", "t6", "bm25+fuzzy", "=0.5*(0.75*0.7+0.25/3)", 1.0, "", False, False),
    ("h", "t7", "fuzzy", "=0.62*(0.75*0.9+0.25/3)", 1.0, "", False, False),
    ("i", "t8", "fuzzy", "=0.48*(0.75*0.7+0.25/3)", 1.0, "", False, False),
    ("j", "t9", "bm25+fuzzy", "=0.72*(0.75*0.9+0.25/3)", 1.0, "", False, False),
    ("j", "t13", "bm25+fuzzy", "=0.75*0.9+0.25/2", 1.0, "", False, False),
    ("k", "t10", "fuzzy", "=least(0.38, 0.62*(0.75*0.9+0.25/3))", 1.0, "", False, False),
    ("l", "t11", "exact", "=0.48", 1.0, "", True, False),
    ("l", "t12", "exact", "=1.0", 1.0, "", True, False),
    ("l", "t3", "exact+fuzzy", "=1.0", 1.0, "", False, True),
    ("m", "t1", "exact", "=1.0", 0.0, "", False, False),
    ("n", "t1", "exact", "=0.88", 0.0, "", False, False),
]


def _pool(spark: SparkSession) -> DataFrame:
    terms = made(spark, "term_id string, name string, acronym string, alt_name string, alt_acronym string, parent_id string", *_TERMS)
    queries = made(spark, "query_id string, query string", *_QUERIES.items())
    rows = [(q, t, m, s, "alias", by or _QUERIES[q], 1) for q, t, *scores, by in _FOUND for m, s in zip(("exact", "fuzzy", "bm25"), scores, strict=True) if s]
    found = made(spark, "query_id string, term_id string, method string, score double, alias string, matched_query string, variant_ord int", *rows)
    abbrevs = sources.abbreviation_rules(made(spark, "abbrev string, expansion string", ("MeA", "medial nucleus of amygdala")))
    return matcher.scored_pool(queries, build_index(terms), found, abbrevs)


@query(f"SELECT query_id, term_id, methods, round(score, 6) AS score, modifier_match, resolvable, via_raw, via_expansion FROM ({table('query_id, term_id, methods, score, modifier_match, resolvable, via_raw, via_expansion', *_CHAIN)})")
def q_score_chain(spark, sf_dir):
    """Candidates through merging, flags, what a query's pool resolves, and the fourteen steps of the score."""
    out = _pool(spark)
    return out.select("query_id", "term_id", "methods", "score", F.col("modifier_match_score").alias("modifier_match"), F.array_join(F.array_sort("resolvable"), ";").alias("resolvable"), "via_raw", "via_expansion")


@query(table("query_id, term_id, expansion_exact, expansion_soft", ("l", "t11", True, False), ("l", "t12", True, False), ("l", "t3", True, False)))
def q_expansion_support(spark, sf_dir):
    """What the candidates of a query say together about its expansion."""
    return _pool(spark).where("query_id = 'l'").select("query_id", "term_id", "expansion_exact", "expansion_soft")


@query(table("query_id, term_id, methods, exact, fuzzy, bm25, best, matched_alias, matched_query", ("q", "t", "bm25+fuzzy", 0.0, 0.9, 0.9, 0.9, "g", "mg"), ("q", "u", "bm25+exact", 1.0, 0.0, 0.4, 1.0, "e", "me")))
def q_merge_rules(spark, sf_dir):
    """Candidates of several methods in one row: best of each, and the first of the highest."""
    rows = [("q", "t", "bm25", 0.9, "b", "mb", 1), ("q", "t", "fuzzy", 0.9, "f", "mf", 2), ("q", "t", "fuzzy", 0.9, "g", "mg", 1), ("q", "t", "bm25", 0.2, "c", "mc", 0), ("q", "u", "exact", 1.0, "e", "me", 3), ("q", "u", "bm25", 0.4, "x", "mx", 1)]
    return score.merged(made(spark, "query_id string, term_id string, method string, score double, alias string, matched_query string, variant_ord int", *rows)).drop("seen_queries")


# --- catalogs, rules, variants


@query(table("term_id, alias_ord, alias", ("t1", 1, "polar cortex (FP, area 10)"), ("t1", 2, "polar cortex"), ("t1", 3, "FP"), ("t1", 4, "polar cortex fp"), ("t1", 5, "area 10"), ("t1", 6, "polar cortex area 10"), ("t1", 7, "area 10) polar cortex (FP"), ("t1", 8, "PC"), ("t1", 9, "frontal pole field"), ("t2", 1, "lateral part"), ("t2", 2, "LP"), ("t3", 1, "front field"), ("t3", 2, "frontal pole field")))
def q_catalog_aliases(spark, sf_dir):
    """Aliases of a catalog: their forms, two-way rules, and none of generic words but the first."""
    raw = made(
        spark, "id string, title string, short string, other string, `hierarchy 1` string, `Unnamed: 3` string, parent string",
        ("t1", "polar cortex (FP, area 10)", "PC", "front field", "", "", "2"), ("t2", " lateral part ", "LP", "medial area", "", "the part", ""), ("t3", "front field", "", "", "", "", "x"), ("t4", "  ", "ZZ", "", "", "", ""),
    )
    rows = sources.catalog_rows(raw, {"term_id": "id", "name": "title", "acronym": "short", "alt_name": "other"})
    rules = sources.alias_rules(made(spark, "source string, target string, bidirectional string", ("front field", "frontal pole field", "yes"), ("polar cortex", "never", "no"), ("x", "x", "yes"), ("", "y", "yes")))
    out = term_aliases(with_defaults(rows), LEX, rules)
    return out.where("NOT (term_id = 't1' AND alias = 'front field')").select("term_id", (F.col("alias_ord") - F.when((F.col("term_id") == "t1") & (F.col("alias_ord") > 8), 1).otherwise(0)).cast("long").alias("alias_ord"), "alias")


@query(table("term_id, depth", ("a", 3), ("b", 1), ("c", 0)))
def q_catalog_depth(spark, sf_dir):
    raw = made(spark, "id string, title string, `hierarchy 1` string, `hierarchy 2` string, parent string", ("a", "A", "x", "", "2"), ("b", "B", "x", "y", "none"), ("c", "C", "", "", ""))
    return sources.catalog_rows(raw, {"term_id": "id", "name": "title"}).select("term_id", F.col("depth").cast("long").alias("depth"))


@query(table("kind, words", ("stopwords", "of|the"), ("laterality", "left"), ("weak", "area"), ("modifiers", "dorsal")))
def q_token_rules(spark, sf_dir):
    """Token lists from rules; unknown kinds and empty terms are left out."""
    lex = sources.lexicon_from(made(spark, "term string, kind string", ("The", "stopword"), ("of", "Stopword"), ("LEFT", "laterality"), ("area", "weak"), ("Dorsal", "modifier"), ("x", "other"), (" ", "weak")))
    return made(spark, "kind string, words string", *[(k, "|".join(getattr(lex, k))) for k in ("stopwords", "laterality", "weak", "modifiers")])


@query(table("rule, a, b", ("alias", "alpha beta", "gamma"), ("alias", "gamma", "alpha beta"), ("alias", "one", "two"), ("abbrev", "cp", "caudate putamen"), ("abbrev", "vta", "ventral area")))
def q_rule_tables(spark, sf_dir):
    """Alias rules in both directions and abbreviation rules, normalized, idle ones left out."""
    a = sources.alias_rules(made(spark, "source string, target string, bidirectional string", ("Alpha-Beta", "Gamma", ""), ("one", "two", "No"), ("x", "X", ""), ("", "z", "")))
    b = sources.abbreviation_rules(made(spark, "abbrev string, expansion string", ("CP", "Caudate Putamen"), ("VTA", "ventral area"), ("x", "x"), ("", "y")))
    return a.select(F.lit("alias").alias("rule"), F.col("source").alias("a"), F.col("target").alias("b")).unionByName(b.select(F.lit("abbrev").alias("rule"), F.col("abbrev").alias("a"), F.col("expansion").alias("b")))


@query(table("text, made", ("caudal cp", "caudal caudate putamen"), ("iii", "third thing"), ("CP", "caudate putamen"), ("left cp nucleus", "left caudate putamen nucleus")))
def q_abbreviation_guard(spark, sf_dir):
    """Abbreviations in texts: alone, or among harmless words only."""
    rules = sources.abbreviation_rules(made(spark, "abbrev string, expansion string", ("cp", "caudate putamen"), ("dcn", "deep thing"), ("ec", "outer thing"), ("iii", "third thing")))
    df = made(spark, "k string", *[(x,) for x in ("caudal cp", "dcn interpositus", "ec iii", "iii", "CP", "left cp nucleus", "cp 3")]).select("k", F.array(F.lit(0)).alias("ord"), F.col("k").alias("text"))
    out = expand.abbreviations_expanded(df, ["k"], rules, LEX)
    return out.where("text <> k").select(F.col("k").alias("text"), F.col("text").alias("made"))


@query(table("query_id, variant_ord, norm", ("q", 1, "left alpha core neurons excluding x"), ("q", 2, "left alpha core excluding x"), ("q", 3, "alpha core neurons excluding x"), ("q", 4, "alpha core excluding x"), ("q", 5, "left alpha neurons excluding x"), ("q", 6, "left alpha excluding x"), ("q", 7, "left alpha"), ("r", 1, "cp"), ("r", 2, "caudate putamen"), ("r", 3, "striatum")))
def q_query_variants(spark, sf_dir):
    """Variants of queries, in order: nine base forms, alias rules, abbreviations, alias rules again."""
    rules = sources.alias_rules(made(spark, "source string, target string, bidirectional string", ("caudate putamen", "striatum", "no")))
    abbrevs = sources.abbreviation_rules(made(spark, "abbrev string, expansion string", ("cp", "caudate putamen")))
    out = expand.query_variants(made(spark, "query_id string, query string", ("q", "left Alpha (core) neurons excluding X"), ("r", "CP")), LEX, rules, abbrevs)
    return out.select("query_id", F.col("variant_ord").cast("long").alias("variant_ord"), "norm")


@query(table("query_id, raw_abbrev, expansions", ("q", "cp", "caudate putamen"), ("r", "vta", "ventral area|ventral tegmentum")))
def q_abbreviation_probes(spark, sf_dir):
    """Abbreviations that a query is or holds: the shortest, and all that they stand for."""
    abbrevs = sources.abbreviation_rules(made(spark, "abbrev string, expansion string", ("cp", "caudate putamen"), ("vta", "ventral area"), ("vta", "ventral tegmentum"), ("zz", "none")))
    out = expand.abbreviation_probes(made(spark, "query_id string, query string", ("q", "left CP"), ("r", "VTA"), ("s", "nothing here")), LEX, abbrevs)
    return out.select("query_id", "raw_abbrev", F.array_join("expansions", "|").alias("expansions"))


# --- retrieval


def _small_index(spark: SparkSession):
    names = [("t1", "red ring"), ("t2", "red gear"), ("t3", "blue ring box"), ("t4", "gear box"), ("t5", "widget"), ("t6", "red")]
    return build_index(made(spark, "term_id string, name string", *names))


@query(table("query_id, term_id, score, variant", ("q", "t1", 1.0, "Red-Ring"), ("r", "t5", 1.0, "widget")))
def q_exact_hits(spark, sf_dir):
    """Variants whose normalized form is an alias."""
    index = _small_index(spark)
    v = expand.query_variants(made(spark, "query_id string, query string", ("q", "Red-Ring"), ("r", "widget"), ("s", "rings")), LEX)
    return retrieve.exact(v, index).select("query_id", "term_id", "score", F.col("matched_query").alias("variant"))


@query(table("query_id, term_id, score", ("q", "t1", 1.0), ("r", "t5", "=0.35*2*6/13.0+0.25*2*5/11.0+0.2*2*4/9.0"), ("s", "t3", "=least(0.92, 9/13.0+0.25)")))
def q_fuzzy_hits(spark, sf_dir):
    """Aliases by the two rarest tokens; a variant of more than five letters without such an alias by shared bigrams;
    what stays below .45 is left out."""
    index = _small_index(spark)
    v = made(spark, "query_id string, variant_ord int, variant string, norm string", ("q", 1, "red ring", "red ring"), ("r", 1, "widgett", "widgett"), ("s", 1, "blue ring", "blue ring"), ("t", 1, "zzz", "zzz"))
    return retrieve.fuzzy(v, index).select("query_id", "term_id", F.round("score", 9).alias("score"))


@query("""WITH a(term_id, toks) AS (VALUES ('t1', ['red', 'ring']), ('t2', ['red', 'gear']), ('t3', ['blue', 'ring', 'box']), ('t4', ['gear', 'box']), ('t5', ['widget']), ('t6', ['red'])), s AS (SELECT count(*) AS n, avg(len(toks)) AS m FROM a),
  p AS (SELECT term_id, len(toks) AS dl, unnest(toks) AS t FROM a), f AS (SELECT t, count(*) AS df FROM p GROUP BY t), q(query_id, t, qf) AS (VALUES ('q', 'red', 1), ('q', 'box', 2), ('r', 'gear', 1)),
  h AS (SELECT query_id, term_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / m)) * qf) AS raw FROM q JOIN f USING (t) JOIN p USING (t), s GROUP BY query_id, term_id)
  SELECT query_id, term_id, round(raw / (raw + 4), 9) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, term_id) AS rank FROM h) WHERE rank <= 3""")
def q_bm25_terms(spark, sf_dir):
    """The best three terms of each query by BM25, a term by its best alias."""
    index = _small_index(spark)
    v = made(spark, "query_id string, variant_ord int, variant string, norm string", ("q", 1, "box red box", "box red box"), ("r", 1, "gear", "gear"))
    out = retrieve.bm25(v, index, 3)
    return rank.top_per_group(out, ["query_id"], [F.desc("score"), F.col("term_id")], 3).select("query_id", "term_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(table("query_id, rank, term_id", ("a", 1, "u"), ("a", 2, "s"), ("b", 1, "v"), ("c", 0, None)))
def q_coverage_and_limit(spark, sf_dir):
    """Ranked by score, likeness, depth, name and id; the coverage filter comes before the limit; unanswered queries stay."""
    rows = [("a", "t", 0.9, 0.5, 1, "n", ""), ("a", "u", 0.9, 0.4, 2, "m", "x"), ("a", "s", 0.9, 0.4, 1, "m", "x"), ("a", "w", 0.2, 0.4, 1, "m", "x"), ("b", "v", 0.1, 0.0, 0, "z", "y")]
    df = made(spark, "query_id string, term_id string, score double, name_jaccard double, depth int, name string, alt_name string", *rows)
    out = rank.ranked(df, 2, where=rank.coverage_filter("with")).select("query_id", "rank", "term_id")
    return rank.with_unanswered(made(spark, "query_id string", ("a",), ("b",), ("c",)), out).select("query_id", F.col("rank").cast("long").alias("rank"), "term_id")


# --- distributions


_HITS = [("q", 1, "a", "A", "", 1.0, "exact"), ("q", 2, "b", "B", "b alias", 0.96, "exact+fuzzy"), ("q", 3, "c", "C", "", 0.9, "fuzzy"), ("r", 1, "a", "A", "", 0.8, "fuzzy"), ("r", 2, "b", "B", "", 0.5, "bm25")]


@query(table("query_id, term_id", ("q", "a"), ("r", "a"), ("r", "b")))
def q_preferred_hits(spark, sf_dir):
    """Exact hits alone where there are any, of those the ones by their own name."""
    df = made(spark, "query_id string, rank int, term_id string, name string, matched_alias string, score double, methods string", *_HITS).withColumn("matched_query", F.col("name"))
    return project.preferred_hits(df, 5).select("query_id", "term_id")


@query(table("query_id, rank, label, score, lit_name", ("q", 1, "L1", "=0.8*0.9", "b"), ("q", 2, "L2", "=1.0*0.5", "a"), ("q", 3, "L3", "=1.0*0.5", "a")))
def q_projected_labels(spark, sf_dir):
    """Labels of a query's names by match score times share, the best row of each label, ties by label."""
    hits = made(spark, "query_id string, rank int, lit_name string, score double", ("q", 1, "a", 1.0), ("q", 2, "b", 0.8), ("q", 3, "none", 0.7))
    dist = made(spark, "lit_name string, label string, p_raw string, rank string", ("a", "L1", "0.2", "3"), ("a", "L2", "0.5", "2"), ("a", "L3", "0.5", "1"), ("b", "L1", "0.9", "1"), ("b", "L4", "0.1", "2"), ("b", "L2", None, "3"))
    return project.projected(hits, dist, "label", 3).select("query_id", F.col("rank").cast("long").alias("rank"), "label", "score", "lit_name")


@query(table("lit_name, top_label, top_p_raw, side, area", ("a", "L2", "0.7", "U", "x"), ("b", "L9", "0.4", "L", "y"), ("c", "", "", "", "")))
def q_name_index(spark, sf_dir):
    """Names with their rank-1 label and the side row that is preferred, empty where there is none."""
    coarse = made(spark, "lit_name string, rank string, label string, p_raw string", ("a", "1", "L1", "0.7"), ("a", "1", "L2", "0.7"), ("a", "2", "L0", "0.1"), ("b", "1", "L9", "0.4"))
    sides = made(spark, "lit_name string, side string, area string, ord int", ("a", "L", "w", 1), ("a", "U", "x", 2), ("b", "L", "y", 1), ("b", "R", "z", 2))
    return project.name_index(made(spark, "lit_name string", ("a",), ("b",), ("c",)), coarse, sides).select("lit_name", "top_label", "top_p_raw", "side", "area")


@query(table("term_id, name, alt_name, lit_name", ("LIT:alpha", "alpha", "Alpha!", "alpha"), ("LIT:gamma x", "other", "G", "gamma x")))
def q_synthetic_catalog(spark, sf_dir):
    """A name index as a catalog, and hits of it back to its names, by name or else by id."""
    names = made(spark, "lit_name string, surface string", ("alpha", "Alpha!"), ("gamma x", "G"))
    cat = project.synthetic_catalog(names).withColumn("name", F.when(F.col("name") == "gamma x", "other").otherwise(F.col("name")))
    lost = made(spark, "term_id string, name string, acronym string, alt_name string, alt_acronym string, parent_id string", ("LIT:zz", "none", "", "", "", ""))
    return project.with_literature_name(cat.unionByName(lost), names).select("term_id", "name", "alt_name", "lit_name")


# --- corpus


@query(table("taxon, common, keep, species", ("", "", True, ""), ("Danio rerio fish", "zebrafish", False, "Zebrafish"), ("", "Mouse", True, "mouse!"), ("Mus musculus", "", True, "mouse!"), ("", "some mammal", True, "Some Mammal"), ("Corvus", "", False, "Corvus")))
def q_species(spark, sf_dir):
    """Which rows a deny and allow list keeps, and the name of their species."""
    df = made(spark, "taxon string, common string", ("", ""), ("Danio rerio fish", "zebrafish"), ("", "Mouse"), ("Mus musculus", ""), ("", "some mammal"), ("Corvus", ""))
    names = made(spark, "key string, value string", ("mouse", "mouse!"), ("mus musculus", "mouse!"))
    out = corpus.canonical(df, names, "common", "taxon", "species")
    return out.select("taxon", "common", corpus.allowed_row(F.col("taxon"), F.col("common"), ["fish"], ["mouse", "mus musculus"], ["mammal"]).alias("keep"), "species")


@query(table("skip, n", ("unknown", 2), ("layer", 1), (None, 2)))
def q_skip_counters(spark, sf_dir):
    df = made(spark, "name string", ("null",), ("<unknown>",), ("L5",), ("amygdala",), ("CA1",))
    return corpus.kept_and_skipped(df, [("unknown", T.is_unknown(F.col("name"))), ("layer", T.is_layer(F.col("name")))]).groupBy("skip").agg(F.count("*").alias("n"))


@query(table("name, id, notes", ("a", "2", "x | y"), ("b", "", "z")))
def q_union_merge(spark, sf_dir):
    """Entries of several sources: the last id that is not empty, all notes once, in order."""
    return corpus.merged_entries(made(spark, "o int, name string, id string, notes string", (1, "a", "1", "x"), (2, "a", "2", "y"), (3, "a", "", "x"), (1, "b", "", "z")), ["name"], ["id"], ["notes"], "o")


@query(table("k, surface, sources", ("a", "Aa", "atlas; seed"), ("b", "Bbb long", "one; two")))
def q_species_merge(spark, sf_dir):
    """The seed's surface, else the longest, and all sources."""
    rows = [("a", "Aaaaaa", False, "atlas", 1), ("a", "Aa", True, "seed", 2), ("b", "Bb", False, "one", 1), ("b", "Bbb long", False, "two", 2), ("b", "Bbb lonh", False, "one", 3)]
    return corpus.surface_merge(made(spark, "k string, surface string, seed boolean, source string, o int", *rows), ["k"], "surface", "seed", "source", "o")


@query(table("name, fullname, expected_id", ("PFC", "", "1"), ("x", "Hippocampus", "2"), ("y", "z", None)))
def q_core_lookup(spark, sf_dir):
    """An expected id by name, else by full name."""
    truth = made(spark, "t_name string, t_full string, expected_id string", ("pfc", "prefrontal", "1"), ("hip", "hippocampus", "2"))
    return corpus.coalesced_lookup(made(spark, "name string, fullname string", ("PFC", ""), ("x", "Hippocampus"), ("y", "z")), truth, [("name", "t_name"), ("fullname", "t_full")], "expected_id")


@query(table("k, v", ("a", 1), ("b", 2), ("c", 3)))
def q_containment_and_upsert(spark, sf_dir):
    """New rows are added where their key is not there; every key of a part must be in the whole."""
    old = made(spark, "k string, v long", ("a", 1), ("b", 2))
    return corpus.must_contain(corpus.upsert_new(old, made(spark, "k string, v long", ("b", 9), ("c", 3)), ["k"]), old, ["k"])


_CLASSED = [
    (1, "L5", "", "ambiguous", "high", "3-0"), (2, "L5 of amygdala", "", "non_neocortex", "high", "3-0"), (3, "brain", "", "other", "high", "3-0"), (4, "optic tract", "", "other", "high", "3-0"), (5, "pyramidal amygdala", "", "non_neocortex", "high", "3-0"),
    (6, "amygdala and hippocampus", "", "non_neocortex", "high", "3-0"), (7, "XY1", "", "unresolved", "high", "3-0"), (8, "anterior cingulate", "", "non_neocortex", "high", "3-0"), (9, "strange cortex", "", "non_neocortex", "high", "3-0"),
    (10, "V1 field", "", "neocortex", "medium", "3-0"), (11, "amygdala", "", "non_neocortex", "high", "2-1"), (12, "piriform field", "", "neocortex", "high", "3-0"), (13, "cerebellar cortex", "", "non_neocortex", "high", "3-0"), (14, "thalamus", "", "non_neocortex", "high", "3-0"),
]


@query(table(
    "record_id, flags, suitability, reason, route",
    (1, "rule_layer_only+rule_cryptic_acronym+rule_prior_ambiguous", "unsuitable", "layer_only", ""), (2, "rule_has_layer", "unsuitable", "layer_only", ""), (3, "rule_too_broad+rule_prior_other", "unsuitable", "too_broad", ""),
    (4, "rule_fiber+rule_prior_other", "unsuitable", "fiber_tract_or_ventricle", ""), (5, "rule_cell_type", "unsuitable", "cell_type_or_marker", ""), (6, "rule_compound", "unsuitable", "compound_multi_region", ""),
    (7, "rule_cryptic_acronym+rule_prior_ambiguous", "unsuitable", "ambiguous_name", ""), (8, "suspect_border_in_non_neo", "", "", "contamination_suspect"), (9, "suspect_cortex_word_in_non_neo", "", "", "contamination_suspect"),
    (10, "weak_neocortex_certainty", "", "", "weak_neocortex"), (11, "flash_split", "", "", "flash_split"), (12, "suspect_allo_in_neocortex", "", "", "allo_in_neocortex"), (13, "", "", "", ""), (14, "", "", "", "spotcheck"),
))
def q_name_flags(spark, sf_dir):
    """The fourteen flags of names, the seed of suitability that they decide, and who gets a second look."""
    df = made(spark, "record_id long, structure_name string, fullname string, region_class string, final_certainty string, flash_vote_split string", *_CLASSED)
    out = curate.adjudication_route(curate.suitability_seed(curate.name_flags(df)), made(spark, "record_id long", (14,), (6,)))
    return out.select("record_id", F.array_join("rule_flags", "+").alias("flags"), "suitability", F.col("unsuitable_reason").alias("reason"), F.col("route_reason").alias("route"))


@query(table(
    "name, old_label, needs_api, region_class, stage, reason",
    ("a", "subcortical", False, "non_neocortex", "seed_remap", "seed: subcortical → non_neocortex"), ("b", "other", False, "other", "seed_remap", "seed: other kept"),
    ("Piriform field", "cortical", False, "non_neocortex", "seed_keyword", "seed: cortical + keyword 'piriform' → non_neocortex"), ("motor field", "cortical", True, "", "", ""), ("c", "ambiguous", True, "", "", ""),
    ("d", "", True, "", "", ""), ("e", "neocortex", False, "neocortex", "seed_remap", "seed: keep neocortex"), ("f", "strange", True, "", "", ""),
))
def q_seed_remap(spark, sf_dir):
    """Labels of an older scheme in the new one, without a second look where the old one or a word of the name decides."""
    rows = [(n, "", o) for n, o in (("a", "subcortical"), ("b", "other"), ("Piriform field", "cortical"), ("motor field", "cortical"), ("c", "ambiguous"), ("d", ""), ("e", "neocortex"), ("f", "strange"))]
    out = curate.seed_remap(made(spark, "structure_name string, fullname string, old_label string", *rows))
    return out.select(F.col("structure_name").alias("name"), "old_label", "needs_api", "region_class", F.col("decision_stage").alias("stage"), F.col("seed_reason").alias("reason"))


@query(table("name, due", ("whole brain", "catalog_gap"), ("a", "limited"), ("b", "improvable"), ("c", "improvable"), ("d", "catalog_gap"), ("e", "improvable"), ("f", "ok"), ("g", "ok")))
def q_improvability(spark, sf_dir):
    """What a match is due to, by name, species, score, flag and the expected id."""
    rows = [
        ("whole brain", "Human", 0.9, "high_confidence", "", ""), ("a", "Rat", 0.5, "needs_review", "", "x"), ("b", "Human", 0.9, "high_confidence", "1", "2"), ("c", "Human", 0.8, "needs_review", "", "x"),
        ("d", "Mouse", 0.0, "", "", ""), ("e", "Human", 0.0, "", "", ""), ("f", "Human", 0.95, "high_confidence", "1", "1"), ("g", "Rat", 0.95, "high_confidence", "", "1"),
    ]
    df = made(spark, "name string, species string, score double, flag string, expected string, found string", *rows)
    return df.select("name", curate.improvability(*[F.col(c) for c in ("name", "species", "score", "flag", "expected", "found")]).alias("due"))


@query(table("query, category, note", ("known", "C_dict", "spelling"), ("area 55b", "D_catalog_gap", "the catalog lacks this granularity"), ("x", "A_effectively_correct", "exact base match; subdivision not in the catalog"), ("y", "A_effectively_correct", "modifier de-specified to correct parent"), ("z", "A_effectively_correct", "synonym/parent match (review-only flag)"), ("w", "B_algo", "low score, unclear match")))
def q_failure_category(spark, sf_dir):
    """Why a match failed: a reviewed table first, then patterns of names, then how it came about."""
    df = made(spark, "query string, methods string, review_flag string", ("known", "exact", ""), ("area 55b", "exact", ""), ("x", "bm25+exact", ""), ("y", "fuzzy", "modifier_conflict"), ("z", "fuzzy", "needs_review"), ("w", "fuzzy", "low_confidence"))
    return curate.failure_category(df, made(spark, "query string, category string, note string", ("known", "C_dict", "spelling")), [r"(?i)\barea\s+\d"]).select("query", "category", "note")


@query(table("structure_name, record_id, flash_vote_split, final_reason", ("a", 7, "2-1", "late"), ("b", 2, "", ""), ("c", 3, "3-0", "r")))
def q_metadata_join(spark, sf_dir):
    """Records with the metadata of a three-column key; the last of several, and the own place where no number is known."""
    slim = made(spark, "ord int, structure_name string, fullname string, species string", (1, " a ", "A", "Rat"), (2, "b", "B", "Rat"), (3, "c", "", "Human"), (4, "  ", "", ""))
    full = made(spark, "ord int, record_id string, structure_name string, fullname string, species string, flash_vote_split string, final_reason string", (1, "5", "a", "A", "Rat", "3-0", "early"), (2, "7", "a", "A ", "Rat", "2-1", "late"), (3, "9", "b", "B", "Mouse", "1-1-1", "other"), (4, "x", "c", "", "Human", "3-0", "r"))
    return curate.with_metadata(slim, full, ["flash_vote_split", "final_reason"]).select("structure_name", "record_id", "flash_vote_split", "final_reason")


@query(table("abbrev, expansion, priority, mentions, reason", ("CP", "caudate putamen", 1, 2, "no_match→fullname_aligned"), ("VTA", "ventral area", 2, 1, "abbrev_wrong_fullname_aligned"), ("XY", "ex why", 3, 5, "abbrev_wrong_highconf"), ("QQ", "cue cue", 4, 15, "abbrev_no_match_has_fullname")))
def q_abbreviation_rules_mined(spark, sf_dir):
    """Rules that abbreviations lack: runs of names and their full names side by side, the best candidate of each
    abbreviation, and the mentions that its priority asks for."""
    schema = "ord int, structure_name string, query_kind string, query string, label string, term_id string, score double, mentions int, fullname string"
    rows = [
        (1, "CP", "abbrev", "CP", "", "", 0.0, 2, "caudate putamen"), (2, "CP", "fullname", "caudate putamen", "aligned", "t1", 1.0, 2, ""), (3, "VTA", "abbrev", "VTA", "wrong", "t9", 0.5, 1, "ventral area"), (4, "VTA", "fullname", "ventral area", "aligned", "t2", 1.0, 1, ""),
        (5, "XY", "abbrev", "XY", "wrong", "t9", 0.95, 5, ""), (6, "XY", "fullname", "ex why", "wrong", "t3", 0.5, 5, ""), (7, "XZ", "abbrev", "XZ", "wrong", "t9", 0.95, 4, ""), (8, "XZ", "fullname", "ex zee", "wrong", "t3", 0.5, 4, ""),
        (9, "QQ", "abbrev", "QQ", "", "", 0.0, 15, "cue cue"), (10, "qq2", "abbrev", "qq", "", "", 0.0, 14, "other cue"), (11, "toolong", "abbrev", "toolong", "", "", 0.0, 99, "too long"), (12, "OLD", "abbrev", "OLD", "", "", 0.0, 99, "old one"), (13, "SAME", "abbrev", "SAME", "", "", 0.0, 99, "same"),
    ]
    wide = curate.by_kind(made(spark, schema, *rows), "structure_name", ("abbrev", "fullname"), ["query", "label", "term_id", "score", "mentions", "fullname"], "ord")
    found = curate.abbreviation_candidates(wide, made(spark, "abbrev string, expansion string", ("old", "Old One")))
    return curate.best_rules(found).select("abbrev", "expansion", F.col("priority").cast("long").alias("priority"), F.col("mentions").cast("long").alias("mentions"), "reason")


@query("""SELECT c_custkey, CAST(row_number() OVER (ORDER BY round(c_acctbal, -3) DESC, lower(c_name), c_name) AS BIGINT) AS place FROM customer""")
def q_by_mentions(spark, sf_dir):
    """All customers numbered by balance, then by name, without one task that sees them all."""
    c = ready(spark).read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.round("c_acctbal", -3).alias("n"), "c_name")
    return curate.by_mentions(c, "n", "c_name").select("c_custkey", F.col("place").cast("long").alias("place"))


@query(table("id, name, difficulty, source", ("AIC-001", "e1", "easy", "core"), ("AIC-002", "e2", "easy", "core"), ("AIC-003", "m1", "medium", "core"), ("AIC-004", "m2", "medium", "corpus"), ("AIC-005", "h1", "hard", "challenge"), ("AIC-006", "h2", "hard", "challenge"), ("AIC-007", "h3", "hard", "challenge")))
def q_filled_pick(spark, sf_dir):
    """Quotas by difficulty, one row a name; a shortfall is filled by the most mentioned, and beyond a cap rows of the
    first sources stay; numbered in the end."""
    schema = "name string, difficulty string, source string, n_mentions int"
    df = made(spark, schema, ("e1", "easy", "core", 1), ("E1 ", "easy", "core", 9), ("e2", "easy", "core", 1), ("e3", "easy", "core", 1), ("m1", "medium", "core", 1), ("h1", "hard", "challenge", 1), ("h2", "hard", "challenge", 1), ("h3", "hard", "challenge", 1), ("h4", "hard", "core", 1))
    fill = made(spark, schema, ("m1", "medium", "corpus", 99), ("m3", "medium", "corpus", 3), ("m2", "medium", "corpus", 7))
    key, order = T.collapsed(F.col("name")), [F.col("difficulty"), F.col("source"), F.lower("name")]
    out = curate.filled_pick(df, "difficulty", {"easy": 2, "medium": 2, "hard": 9}, key, [F.length("name"), *order], fill, [F.desc("n_mentions"), F.col("name")], {"hard": 3}, ["challenge"], "source")
    rank_of = F.array_position(T.words_array(["easy", "medium", "hard"]), F.col("difficulty"))
    return rank.sequential_ids(out, [rank_of, F.array_position(T.words_array(["core", "corpus", "challenge"]), F.col("source")), F.lower("name")], "AIC-%03d").select("id", "name", "difficulty", "source")


# --- runs


_RATED = [("s1", "easy", "aligned", "1", "1", True), ("s1", "easy", "broader_parent", "1", "2", True), ("s1", "hard", "wrong", "", "9", False), ("s2", "hard", "aligned", "3", "3", True), ("s2", "hard", "wrong", "3", "", False), ("s2", "easy", "aligned", "", "4", True)]


@query(table(
    "system, difficulty, n, aligned_rate, aligned_or_parent_rate, id_match_rate, ids_valid, ids_hallucinated",
    ("s1", None, 3, "=round(1/3.0, 4)", "=round(2/3.0, 4)", 0.5, 2, 1), ("s2", None, 3, "=round(2/3.0, 4)", "=round(2/3.0, 4)", 0.5, 2, 0), ("s1", "easy", 2, 0.5, 1.0, 0.5, 2, 0), ("s1", "hard", 1, 0.0, 0.0, None, 0, 1),
    ("s2", "hard", 2, 0.5, 0.5, 0.5, 1, 0), ("s2", "easy", 1, 1.0, 1.0, None, 1, 0),
))
def q_group_rates(spark, sf_dir):
    """Rates by system, and by system and difficulty, with ids that match, exist and do not exist."""
    return summary.group_rates(made(spark, "system string, difficulty string, label string, expected_id string, found_id string, id_exists boolean", *_RATED), "system", "difficulty")


def _changes(spark: SparkSession) -> DataFrame:
    off = made(spark, "dataset string, query string, id string, label string", ("d", "a", "1", "aligned"), ("d", "b", "2", "wrong"), ("d", "c", "3", "aligned"), ("d", "e", "", "source_or_ontology_issue"), ("d", "f", "5", "wrong"), ("d", "lost", "6", "wrong"))
    on = made(spark, "dataset string, query string, id string, relation string", ("d", "a", "1", "'="), ("d", "b", "9", "'="), ("d", "c", "8", "<"), ("d", "e", "", ""), ("d", "f", "7", ">"))
    judged = made(spark, "dataset string, query string, id string, label string", ("d", "b", "9", "aligned"), ("d", "c", "8", "broader_parent"), ("d", "f", "7", "ambiguous"), ("d", "f", "x", "aligned"))
    return summary.change_records(off, on, judged, ["dataset", "query"])


@query(table("n, off_useful, on_useful, off_aligned, on_aligned, off_no_match, on_no_match, changed, improved, regressed, same_worth, related, consistent", (5, 2, 3, 2, 2, 1, 1, 3, 1, 1, 1, 3, 2)))
def q_change_summary(spark, sf_dir):
    """What a second run changed, by the worth of its labels."""
    return summary.change_summary(_changes(spark))


@query(table("relation, n, rate", ("'=", 2, 1.0), ("<", 1, 1.0), (">", 1, 0.0)))
def q_relation_consistency(spark, sf_dir):
    return summary.consistency(_changes(spark).withColumn("label", F.col("on_label")))


def _run(spark: SparkSession):
    results = made(spark, "ord int, structure_name string, term_id string, score double, review_flag string", (1, "a", "1", 0.95, "high_confidence"), (2, "a", "9", 0.1, "low_confidence"), (3, "b (x)", "2", 0.7, "needs_review"), (4, "c", "", 0.0, ""), (5, "d", "5", 0.5, "low_confidence"))
    source = made(spark, "ord int, structure_name string, species string, category string, paper string", (1, "a", "Human", "k", "p2"), (2, "a", "Rat", "k", "p1"), (3, "b (x)", "Human", "k", "p1"), (4, "c", "Mouse", "k", "p1"), (5, "d", "Rat", "k", "p2"))
    core = made(spark, "structure_name string, expected_id string", ("a", "1"), ("b (x)", "3"))
    return source, summary.corpus_names(results, source, core, made(spark, "structure_name string", ("d",), ("b (x)",)))


@query(table("structure_name, papers, due", ("a", "p1; p2", "ok"), ("b (x)", "p1", "improvable"), ("c", "p1", "catalog_gap"), ("d", "p2", "limited")))
def q_corpus_names(spark, sf_dir):
    return _run(spark)[1].select("structure_name", "papers", "due")


@query(table(
    "part, key, n",
    ("flag", "high_confidence", 1), ("flag", "needs_review", 1), ("flag", "", 1), ("flag", "low_confidence", 1), ("due", "ok", 1), ("due", "improvable", 1), ("due", "catalog_gap", 1), ("due", "limited", 1),
    ("species", "Human:high_confidence", 1), ("species", "Human:needs_review", 1), ("species", "Mouse:", 1), ("species", "Rat:low_confidence", 1), ("core", "match", 1), ("core", "mismatch", 1),
    ("tag", "parenthetical", 1), ("tag", "known_challenge", 1), ("tag", "core_regression", 1), ("tag", "needs_review", 1),
))
def q_corpus_summary(spark, sf_dir):
    """How the names of a corpus fared, counted in one pass."""
    return summary.corpus_summary(_run(spark)[1])


@query(table("paper, total, high, needs_review, low", ("p1", 3, 1, 1, 0), ("p2", 2, 1, 0, 1)))
def q_paper_totals(spark, sf_dir):
    return summary.paper_totals(*_run(spark))


@query(table("dataset, query", ("species", "a"), ("species", "b"), ("corpus", "a")))
def q_sub_corpus(spark, sf_dir):
    return summary.sub_corpus(made(spark, "dataset string, query string", ("species", "a"), ("species", "b"), ("corpus", "a"), ("corpus", "z"), ("other", "a")), made(spark, "query string", ("a",), ("a",)))


@query("""SELECT o_orderstatus AS status, CAST(json_group_object(p, n) AS VARCHAR) AS labels FROM (SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL ORDER BY o_orderstatus, p) GROUP BY o_orderstatus""")
def q_label_map(spark, sf_dir):
    """Counts by label as a map, written as JSON."""
    o = ready(spark).read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("label"))
    return summary.label_map(o, "status").select("status", F.to_json("labels").alias("labels"))


@query("""SELECT o_custkey, '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY o_custkey""")
def q_top_json(spark, sf_dir):
    """Each customer's first three orders as JSON."""
    o = rank.top_per_group(ready(spark).read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey"], [F.col("o_orderkey")], 3)
    return o.groupBy("o_custkey").agg(T.top_json(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))).alias("top3"))


@query("""SELECT event_id, 'run_' || strftime(ts, '%Y%m%d_%H%M%S') || '.csv' AS file FROM events""")
def q_dated_names(spark, sf_dir):
    return ready(spark).read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.dated_name("run", F.col("ts"), "csv").alias("file"))


@query(table("grp, n, top1, in_top_k", ("x", 2, 0.5, 1.0), ("y", 1, 0.0, 0.0)))
def q_hit_rates_by_group(spark, sf_dir):
    ranked = made(spark, "query_id string, rank int, term_id string", ("a", 1, "t1"), ("a", 2, "t2"), ("b", 1, "t9"), ("b", 2, "t3"), ("c", 1, "t9"))
    return evaluate.hit_rates(ranked, made(spark, "query_id string, expected_id string, grp string", ("a", "t1", "x"), ("b", "t3", "x"), ("c", "t4", "y")), ["grp"], 2)


@query(table("wrong_to_right, right_to_wrong, n", (1, 2, 4)))
def q_flips(spark, sf_dir):
    run = lambda *r: made(spark, "k string, right boolean", *zip("abcd", r, strict=True))
    return evaluate.flips(run(True, True, False, True), run(False, False, True, True), ["k"])


@query(table("k, label, tier", ("a", "x", "first"), ("b", "y", "second"), ("c", "p", "prior")))
def q_two_tiers(spark, sf_dir):
    tier = lambda *rows: made(spark, "k string, label string", *rows)
    return evaluate.escalated(tier(("a", "x"), ("b", "no_consensus")), tier(("a", "z"), ("b", "y")), tier(("a", "p"), ("b", "p"), ("c", "p")), ["k"])


@query(table("k", ("missing",), ("unsure",), ("review",), ("bad",)))
def q_threshold_escalation(spark, sf_dir):
    rows = [("missing", None, 0.9, ""), ("unsure", "aligned", 0.5, ""), ("review", "needs_human_review", 0.9, ""), ("bad", "wrong", 0.9, "accepted"), ("fine", "wrong", 0.9, ""), ("good", "aligned", 0.9, "accepted")]
    return evaluate.needs_escalation(made(spark, "k string, label string, confidence double, role string", *rows), 0.75, ["wrong"]).select("k")


@query(table("k, p, q, certainty", ("k", "a", "y", "medium"), ("m", "needs_human_review", "y", "needs_human_review"), ("n", "a", "y", "high")))
def q_three_target_vote(spark, sf_dir):
    rows = [("k", 1, "a", "x"), ("k", 2, "a", "y"), ("k", 3, "b", "y"), ("m", 1, "a", "x"), ("m", 2, "b", "y"), ("m", 3, "c", "y"), *[("n", i, "a", "y") for i in (1, 2, 3)]]
    return evaluate.majorities(made(spark, "k string, pass int, p string, q string, confidence double", *[(*r, 0.9) for r in rows]), ["k"], ["p", "q"])


@query(table("k, label, suitability, class_ok", ("a", "x", "suitable", True), ("b", "x", "unsuitable", False)))
def q_class_majority(spark, sf_dir):
    rows = [("a", 1, "x", "suitable", True), ("a", 2, "x", "suitable", True), ("a", 3, "y", "unsuitable", False), ("b", 1, "x", "suitable", True), ("b", 2, "x", "unsuitable", False)]
    df = made(spark, "k string, pass int, label string, suitability string, class_ok boolean", *rows).withColumn("certainty", F.lit("high")).withColumn("confidence", F.lit(0.9))
    return evaluate.class_majority(df, ["k"]).select("k", "label", "suitability", "class_ok")


@query(table("k, label, agreement, certainty, split", ("a", "x", "2/3", "medium", "2-1"), ("b", "x", "3/3", "high", "3-0"), ("c", "no_consensus", "1/3", "low", "1-1-1"), ("d", "no_consensus", "1/1", "low", "1-0")))
def q_vote_cases(spark, sf_dir):
    """Splits of votes and what they decide."""
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), *[("b", i, "x") for i in (1, 2, 3)], ("c", 1, "x"), ("c", 2, "y"), ("c", 3, "z"), ("d", 1, "x"), ("d", 2, None), ("d", 3, "")]
    df = made(spark, "k string, pass int, label string", *rows).withColumn("certainty", F.lit("medium")).withColumn("confidence", F.lit(0.9))
    return evaluate.majority(df, ["k"]).select("k", "label", "agreement", "certainty", F.col("vote_split_pattern").alias("split"))


@query(table("query, score", ("b", 0.9), ("a", 0.75)))
def q_high_but_wrong(spark, sf_dir):
    rows = [("a", "abbrev", "wrong", 0.75), ("b", "abbrev", "wrong", 0.9), ("c", "abbrev", "wrong", 0.5), ("d", "fullname", "wrong", 0.9), ("e", "abbrev", "aligned", 0.9)]
    return evaluate.high_but_wrong(made(spark, "query string, kind string, label string, score double", *rows)).select("query", "score")


@query(table("k, problem", ("b", "missing"), ("z", "unknown"), ("a", "duplicate")))
def q_batch_check(spark, sf_dir):
    one = lambda *k: made(spark, "k string", *[(x,) for x in k])
    return evaluate.valid_batch(one("a", "b"), one("a", "a", "z"), "k")


@query(table("query_id, term_id, relation", ("q", "t1", "'="), ("q", "t2", "<"), ("q", "t3", ">"), ("q", "t4", "<")))
def q_answer_guards(spark, sf_dir):
    """Answers that are candidates, with a known relation, once an id, four at most."""
    rows = [("q", "t1", "'=", 1), ("q", "t1", "<", 2), ("q", "t9", "<", 3), ("q", "t2", "<", 4), ("q", "t3", ">", 5), ("q", "t4", "?", 6), ("q", "t4", "<", 7), ("q", "t5", "<", 8)]
    out = evaluate.guarded(made(spark, "query_id string, term_id string, relation string, ord int", *rows), made(spark, "query_id string, term_id string", *[("q", f"t{i}") for i in range(1, 6)]))
    return out.select("query_id", "term_id", "relation")


@query(table("variant, accuracy, chosen", ("A", 0.5, False), ("B", 0.5, True)))
def q_best_variant(spark, sf_dir):
    results = made(spark, "k string, variant string, label string", ("a", "A", "x"), ("b", "A", "y"), ("a", "B", "z"), ("b", "B", "z"), ("c", "A", "x"))
    return evaluate.best_variant(results, made(spark, "k string, expected string", ("a", "x"), ("b", "z")), "k", ("A", "B"))


@query(table("k", ("b",)))
def q_regressions(spark, sf_dir):
    run = lambda *r: made(spark, "k string, label string", *zip("abcd", r, strict=True))
    return evaluate.regressions(run("wrong", "aligned", "aligned", "aligned"), run("wrong", "wrong", "wrong", "aligned"), ["k"], made(spark, "k string", ("c",))).select("k")


@query(table("k, label", ("a", "aligned"), ("b", None), ("c", None)))
def q_votes_kept(spark, sf_dir):
    new = made(spark, "k string, term_id string", ("a", "1"), ("b", "2"), ("c", "3"))
    return evaluate.votes_kept(new, made(spark, "k string, term_id string, label string", ("a", "1", "aligned"), ("b", "9", "wrong")), ["k"]).select("k", "label")


@query(table("key, label", ("A||x", "p"), ("A||y", "q"), ("B||x", "r"), ("B||y", "q")))
def q_key_aliases(spark, sf_dir):
    return evaluate.key_aliases(made(spark, "key string, label string", ("A||x", "p"), ("A||y", "q"), ("B||x", "r")), "A||", "B||")


@query(table("query", ("Alpha",), ("beta",)))
def q_dictionary_seeds(spark, sf_dir):
    rows = [("alpha", "aligned", "wrong"), ("Alpha", "aligned", "wrong"), ("beta", "aligned", "partial_or_narrower"), ("gamma", "aligned", "aligned"), ("delta", "wrong", "wrong")]
    return evaluate.dictionary_seeds(made(spark, "query string, old_value string, new_value string", *rows)).select("query")


@query(table("accept_same, accept_changed, reject_changed, target_matched", (1, 1, 1, 1)))
def q_reviewed_metrics(spark, sf_dir):
    run = made(spark, "k string, term_id string, name string", ("a", "1", "x"), ("b", "9", "y"), ("c", "3", "z"), ("d", "8", "the Target one"))
    accept = made(spark, "k string, term_id string", ("a", "1"), ("b", "2"))
    return evaluate.reviewed(run, accept, made(spark, "k string, term_id string, target string", ("c", "3", "t"), ("d", "4", "target")), ["k"])


@query(table("side, k, label", ("left", "a", "x"), ("moved", "b", "new"), ("moved", "t", "old")))
def q_migrated(spark, sf_dir):
    """Keyed rows moved from one table to another under a new label."""
    left, right = evaluate.migrated(made(spark, "k string, label string", ("a", "x"), ("b", "x")), made(spark, "k string, label string", ("t", "old")), made(spark, "k string", ("b",)), ["k"], "new")
    return left.select(F.lit("left").alias("side"), "k", "label").unionByName(right.select(F.lit("moved").alias("side"), "k", "label"))


@query(table("place, query", (1, "b"), (2, "A"), (3, "c"), (4, "d")))
def q_review_order(spark, sf_dir):
    df = made(spark, "dataset string, flag string, score double, query string", ("x", "other", 0.1, "c"), ("x", "low", 0.5, "A"), ("y", "low", 0.1, "d"), ("x", "low", 0.2, "b"))
    rows = [r["query"] for r in evaluate.review_order(df, ["low"]).collect()]  # four rows
    return made(spark, "place long, query string", *[(i + 1, q) for i, q in enumerate(rows)])


# --- trees, stages, sources


@query(table("term_id, tree_depth", ("r", 0), ("a", 1), ("b", 2), ("x", 2)))
def q_tree_with_extension(spark, sf_dir):
    """A catalog with an extension below its own terms, and the depth of each."""
    tree = lambda *rows: made(spark, "term_id string, parent_id string", *rows)
    return hierarchy.tree_depth(hierarchy.ancestors(hierarchy.with_extension(tree(("r", ""), ("a", "r"), ("b", "a")), tree(("x", "a"))))).select("term_id", F.col("tree_depth").cast("long").alias("tree_depth"))


@query(table("step, query_id, value", ("roi", "a", "left amygdala"), ("roi", "b", "SST"), ("removed", "a", "neurons/marker"), ("hint", "a", "h1"), ("result", "a", "h1 '="), ("result", "a", "up >"), ("result", "a", "down <")))
def q_stages(spark, sf_dir):
    """Stages before and behind the matcher: what is no name goes; hints and sure hits, then who stands above and below."""
    queries = made(spark, "query_id string, query string", ("a", "left amygdala neurons"), ("b", "SST"))
    pre = stages.preprocess(queries, LEX)
    hints = stages.dictionary_hints(queries, made(spark, "abbrev string, term_id string", ("amygdala", "h1"), ("Neurons", "h2")))
    up = hierarchy.ancestors(made(spark, "term_id string, parent_id string", ("up", ""), ("h1", "up"), ("down", "h1"), ("far", "")))
    ranked = made(spark, "query_id string, term_id string, rank int, score double", ("a", "up", 1, 0.7), ("a", "far", 2, 0.6), ("a", "down", 3, 0.5))
    post = stages.postprocess(ranked, hints, up)
    return (
        pre.select(F.lit("roi").alias("step"), "query_id", F.col("roi_query").alias("value"))
        .unionByName(pre.where(F.size("removed") > 0).select(F.lit("removed").alias("step"), "query_id", F.array_join(F.transform("removed", lambda r: F.concat_ws("/", r["text"], r["kind"])), "|").alias("value")))
        .unionByName(hints.select(F.lit("hint").alias("step"), "query_id", F.col("term_id").alias("value")))
        .unionByName(post.select(F.lit("result").alias("step"), "query_id", F.concat_ws(" ", "term_id", "relation").alias("value")))
    )


@query(table("source, value", ("csv", "a|1"), ("csv", "b|"), ("csv_columns", "v"), ("json", "a|1"), ("json", "b|"), ("label", "Alpha one"), ("label", "Beta"), ("key", "Some Name"), ("key", "Other"), ("by", "x:1"), ("by", "y:1"), ("lines", "a\nb")))
def q_files(spark, sf_dir):
    """Files written and read again: CSV with a byte order mark, JSON, labels in quotes, key tables, a folder a value."""
    base = f"{shared_dir(ready(spark))}/files"
    df = made(spark, "k string, v string", ("a", "1"), ("b", ""))
    sources.write_csv(df.select(F.col("k").alias("﻿k"), "v"), f"{base}/bom")
    sources.write_csv(df, f"{base}/columns", ["v"])
    sources.write_json(df, f"{base}/json")
    sources.write_csv(made(spark, "k string", ("a\nb",)), f"{base}/lines")
    sources.write_by(made(spark, "k string, s string", ("1", "x"), ("2", "y")), f"{base}/by", "s")
    made(spark, "value string", ('1 2 3 "alpha one"',), ('4 "Clear Label"',), ('5 "alpha one"',), ('6 "beta" ',), ("7 none",)).coalesce(1).write.mode("overwrite").text(f"{base}/labels")
    one = lambda name, d, *cols: d.select(F.lit(name).alias("source"), F.concat_ws("|", *cols).alias("value"))
    by = ready(spark).read.csv(f"{base}/by", header=True).groupBy("s").agg(F.count("*").alias("n"))
    keys = sources.key_table(made(spark, "`Level 1` string, `Level 6` string, z string", ("x", "12: some_name (SN)", "q"), ("x", "13: other", "q"), ("y", "12: some_name (SN)", "q")))
    out = one("csv", sources.read_csv(spark, f"{base}/bom"), "k", "v").unionByName(one("json", sources.read_json(spark, f"{base}/json", "k string, v string"), "k", "v"))
    out = out.unionByName(sources.read_csv(spark, f"{base}/columns").limit(1).select(F.lit("csv_columns").alias("source"), F.lit("v").alias("value"))).unionByName(one("label", sources.label_file(spark, f"{base}/labels"), "name"))
    return out.unionByName(one("key", keys, "name")).unionByName(by.select(F.lit("by").alias("source"), F.concat_ws(":", "s", "n").alias("value"))).unionByName(one("lines", sources.read_csv(spark, f"{base}/lines", multiline=True), "k"))


@query(table("kind, query", ("abbrev", "CP"), ("abbrev", "VTA"), ("fullname", "Caudate Putamen"), ("plain", "alpha"), ("plain", "beta"), ("kept", "CP"), ("ranked", "x:0"), ("ranked", "y:1")))
def q_query_sources(spark, sf_dir):
    """Queries from tables: two kinds a row, plain first columns, suitable rows, required columns; and ranked rows back."""
    df = made(
        spark, "o int, structure_name string, fullname string, suitability string, region_class string",
        (1, "CP", "Caudate Putamen", "", ""), (2, "cp", "caudate putamen", "suitable", "non_neocortex"), (3, "VTA", "vta", "suitable", ""), (4, "XX", "x", "unsuitable", ""), (5, "YY", "y", "", "neocortex"), (6, "", "z", "", ""),
    )
    two = sources.two_kind_queries(df, order="o", allowed={"suitability": ("suitable",), "region_class": ("non_neocortex",)}).select("kind", "query")
    plain = sources.query_rows(made(spark, "q string, z int", (" alpha ", 1), ("", 2), ("beta", 3), ("alpha", 4)), unique=True).select(F.lit("plain").alias("kind"), "query")
    kept = sources.suitable(sources.required(df.where("o = 1"), ["structure_name", "suitability"])).select(F.lit("kept").alias("kind"), F.col("structure_name").alias("query"))
    results = made(spark, "query_id string, rank int, name string", ("y", 1, "n"))
    back = sources.ranked_sink(made(spark, "query_id string", ("x",), ("y",)), results).select(F.lit("ranked").alias("kind"), F.concat_ws(":", "query_id", "match_rank").alias("query"))
    return two.unionByName(plain).unionByName(kept).unionByName(back)


@query(table("same, other_order, other_rows, found, entries, stale", (True, True, False, "t1", 6, True)))
def q_snapshot(spark, sf_dir):
    """An index written and read: the fingerprint of its tables does not depend on their order, and a stale one is refused."""
    terms = made(spark, "term_id string, name string", ("t1", "red ring"), ("t2", "red gear"), ("t3", "blue ring box"), ("t4", "gear box"), ("t5", "widget"), ("t6", "red"))
    of, path = snapshot.fingerprint(terms), f"{shared_dir(ready(spark))}/snapshot"
    snapshot.save(build_index(terms), path, of)
    back = snapshot.load(spark, path, of)
    top = matcher.search(made(spark, "query_id string, query string", ("q", "Red Ring")), back, top_k=1).first()
    facts = (snapshot.fingerprint(terms) == of, snapshot.fingerprint(terms.orderBy(F.desc("term_id"))) == of, snapshot.fingerprint(terms.limit(3)) == of, top["term_id"], back.entries, snapshot.load(spark, path, "other") is None)
    return made(spark, "same boolean, other_order boolean, other_rows boolean, found string, entries long, stale boolean", facts)


@query(table("batch_rows, again", (3, 1)))
def q_resumed_pass(spark, sf_dir):
    """A pass that is run again goes on with what it has not seen."""
    from .streaming.batches import unseen

    whole, done = made(spark, "k string", ("a",), ("b",), ("c",)), made(spark, "k string", ("a",), ("b",))
    return whole.agg(F.count("*").alias("batch_rows")).join(unseen(whole, done, ["k"]).agg(F.count("*").alias("again")))  # one row each


_SEARCHED = [("a", "Red-Ring", 1, "t1", 1.0), ("b", "WIDGET", 1, "t5", 1.0), ("c", "left widget", 1, "t5", 1.0), ("d", "zzz", 0, None, None), ("e", "", 0, None, None)]


@query(table("query_id, query, rank, term_id, score", *_SEARCHED))
def q_search_cases(spark, sf_dir):
    """The whole matcher: all methods' candidates, scored, ranked, and queries without an answer."""
    v = made(spark, "query_id string, query string", *[r[:2] for r in _SEARCHED])
    out = matcher.search(v, _small_index(spark), top_k=1, unanswered=True)
    return out.select("query_id", "query", F.col("rank").cast("long").alias("rank"), "term_id", "score")


@query(table("query_id, rank, term_id, score", *[(q, rank_, t, s) for q, _, rank_, t, s in _SEARCHED if t]))
def q_stream_cases(spark, sf_dir):
    """The same queries as a stream, a folder for each batch, read back."""
    from .streaming.batches import match_stream

    base = f"{shared_dir(ready(spark))}/stream-cases"
    made(spark, "query_id string, query string", *[r[:2] for r in _SEARCHED]).write.mode("overwrite").parquet(f"{base}/in")
    stream = spark.readStream.schema("query_id string, query string").parquet(f"{base}/in")
    match_stream(stream, _small_index(spark), f"{base}/out", f"{base}/state", top_k=1).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("query_id", F.col("rank").cast("long").alias("rank"), "term_id", "score")


@query(table("k, old_value, new_value, status", ("a", "x", "x", "same"), ("b", "x", "y", "improved"), ("c", "x", None, "lost"), ("d", None, "x", "new"), ("e", "x", "y", "regressed"), ("f", "x", "y", "changed")))
def q_run_diff_cases(spark, sf_dir):
    """Every way in which two runs differ."""
    run = lambda *rows: made(spark, "k string, v string, s double", *rows)
    old = run(("a", "x", 1.0), ("b", "x", 1.0), ("c", "x", 1.0), ("e", "x", 1.0), ("f", "x", 1.0))
    new = run(("a", "x", 0.0), ("b", "y", 2.0), ("d", "x", 1.0), ("e", "y", 0.5), ("f", "y", 1.0))
    return evaluate.run_diff(old, new, ["k"], "v", "s").select("k", "old_value", "new_value", "status")
