"""Text scalars, Column to Column; all of them stay inside the JVM.

Null input counts as the empty string. Case and character classes are guaranteed for ASCII.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import AREA_ID, BOTH, FUSED_MARKERS, LABEL_ALIASES, LABELS, LAYER_NAME, LEFT, MARKERS, RIGHT, STRUCTURE_CLASSES, UNKNOWN_NAMES, Lexicon


def words_array(words: Iterable[str]) -> Column:
    return F.array(*map(F.lit, words)) if (words := list(words)) else F.array().cast("array<string>")


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space at both ends, tabs and line ends included."""
    return F.regexp_replace(text_of(c), r"^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Lower-case words of 0-9A-Za-z joined by one space; ``&`` is "and", quotes vanish, all else separates."""
    c = F.replace(F.replace(text_of(c), F.lit("&"), F.lit(" and ")), F.lit("/"), F.lit(" "))
    c = F.regexp_replace(c, "['`´]", "")
    return F.lower(F.trim(F.regexp_replace(c, "[^0-9A-Za-z]+", " ")))


def split_words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def without(tokens: Column, words: Iterable[str]) -> Column:
    """Tokens that are none of the words; repeats stay."""
    listed = words_array(words)
    return F.filter(tokens, lambda t: ~F.array_contains(listed, t))


def tokenize(c: Column, lexicon: Lexicon, keep_stopwords: bool = False) -> Column:
    tokens = split_words(normalize(c))
    return tokens if keep_stopwords else without(tokens, lexicon.stopwords)


def strip_laterality(c: Column, lexicon: Lexicon) -> Column:
    return F.array_join(without(split_words(normalize(c)), lexicon.laterality), " ")


def strip_parenthetical(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"\([^)]*\)", " ")


def flatten_parentheses(c: Column) -> Column:
    return F.translate(text_of(c), "()", "  ")


def cut_exclusion(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"(?is)\b(excluding|except|without)\b[^\n]*$", " ")


def strip_markers(c: Column) -> Column:
    """Without marker words and fused marker endings; the text itself if fewer than two characters would be left."""
    raw = text_of(c)
    out = F.regexp_replace(raw, MARKERS, " ")
    out = F.regexp_replace(out, FUSED_MARKERS, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\++", " "), r"\s+", " ")
    out = F.regexp_replace(out, r"^[ \-_/]+|[ \-_/]+$", "")
    return F.when(F.length(normalize(out)) < 2, raw).otherwise(out)


def ngrams(c: Column, n: int) -> Column:
    """Distinct n-grams of the normalized text without spaces; a shorter text is one gram, an empty one none."""
    t = F.replace(normalize(c), F.lit(" "), F.lit(""))
    return compact_ngrams(t, n)


def compact_ngrams(t: Column, n: int) -> Column:
    grams = F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))  # one pass over the text
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= n, F.array(t)).otherwise(grams)


def content_tokens(c: Column, lexicon: Lexicon) -> Column:
    return F.array_distinct(without(tokenize(c, lexicon), lexicon.noncontent))


def specificity_terms(c: Column, lexicon: Lexicon) -> Column:
    listed = words_array({*lexicon.modifiers, *lexicon.weak})
    return F.array_distinct(F.filter(split_words(normalize(c)), lambda t: F.array_contains(listed, t)))


def distinct_normalized(items: Column) -> Column:
    """Items without repeats by their normalized form, in order; what normalizes to nothing goes."""
    clean = F.transform(items, stripped)
    pairs = F.filter(F.transform(clean, lambda x: F.struct(x.alias("s"), normalize(x).alias("k"))), lambda p: p["k"] != "")
    start = F.array().cast("array<struct<s:string,k:string>>")
    kept = F.aggregate(pairs, start, lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.transform(kept, lambda p: p["s"])


def modifier_terms(c: Column, lexicon: Lexicon) -> Column:
    """Tokens of each parenthesis, the whole of one with several, then the text's modifier words."""
    groups = F.regexp_extract_all(text_of(c), F.lit(r"\(([^)]*)\)"), F.lit(1))
    of_group = lambda g: F.concat(tokenize(g, lexicon), F.when(F.size(tokenize(g, lexicon)) > 1, F.array(normalize(g))).otherwise(F.array().cast("array<string>")))
    listed = words_array(lexicon.modifiers)
    own = F.filter(tokenize(c, lexicon), lambda t: F.array_contains(listed, t))
    return distinct_normalized(F.concat(F.flatten(F.transform(groups, of_group)), own))


def area_ids(c: Column) -> Column:
    """Tokens that are a code of an area, such as ``23c`` or ``v3a``."""
    return F.array_distinct(F.filter(split_words(normalize(c)), lambda t: t.rlike(AREA_ID)))


def area_keys(ids: Column) -> Column:
    """prefix:number of each code; a letter behind the number does not count."""
    return F.array_distinct(F.transform(ids, lambda t: F.concat(F.regexp_extract(t, AREA_ID, 1), F.lit(":"), F.regexp_replace(F.regexp_extract(t, AREA_ID, 2), "^0+(?=.)", ""))))


def structure_head(tokens: Column) -> Column:
    """Class of the first class word directly before "of", else of the last class word; null if there is none."""
    table = F.create_map(*[F.lit(x) for label, members in STRUCTURE_CLASSES.items() for m in members for x in (m, label)])
    after = F.concat(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), F.array(F.lit("")))
    of = F.filter(F.zip_with(tokens, after, lambda t, n: F.when(n == "of", F.element_at(table, t))), lambda x: x.isNotNull())
    last = F.filter(F.transform(tokens, lambda t: F.element_at(table, t)), lambda x: x.isNotNull())
    return F.coalesce(F.get(of, F.lit(0)), F.when(F.size(last) > 0, F.element_at(last, -1)))


def laterality(c: Column) -> Column:
    """left, right, bilateral or unknown, from words of the normalized text."""
    tokens = split_words(normalize(c))
    has = lambda words: F.arrays_overlap(tokens, words_array(words))
    return F.when(has(BOTH) & ~has(LEFT) & ~has(RIGHT), "bilateral").when(has(LEFT) & ~has(RIGHT), "left").when(has(RIGHT) & ~has(LEFT), "right").otherwise("unknown")


def title_case(c: Column) -> Column:
    """Upper case after every character that is no letter, lower case elsewhere (``pre-frontal``: ``Pre-Frontal``)."""
    parts = F.regexp_extract_all(text_of(c), F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def humanize(c: Column, small: Iterable[str] = ("of", "the", "and", "in", "to")) -> Column:
    """Underscores to spaces; words capitalized but for small ones after the first."""
    listed = words_array(small)
    parts = F.filter(F.split(F.replace(text_of(c), F.lit("_"), F.lit(" ")), r"\s+"), lambda p: p != "")
    word = lambda p, i: F.when((i > 0) & F.array_contains(listed, F.lower(p)), F.lower(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
    return F.array_join(F.transform(parts, word), " ")


def is_layer(c: Column) -> Column:
    return stripped(c).rlike(LAYER_NAME)


def is_unknown(c: Column, words: Iterable[str] = UNKNOWN_NAMES) -> Column:
    return F.lower(stripped(c)).isin(*words)


def collapsed(c: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.lower(F.regexp_replace(stripped(c), r"\s+", " "))


def folded_name(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", " "))


def is_abbreviation(c: Column) -> Column:
    """1 to 6 capitals, or 2 to 6 characters without white space and with a capital."""
    t = stripped(c)
    return t.rlike(r"^[A-Z]{1,6}$") | (t.rlike(r"^\S{2,6}$") & t.rlike("[A-Z]"))


def merged_notes(*notes: Column, sep: str = " | ") -> Column:
    """Notes joined without repeats, in order."""
    parts = F.concat(*[F.split(text_of(n), sep.replace("|", r"\|")) for n in notes])
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, stripped), lambda p: p != "")), sep)


def vote_label(c: Column, aliases: dict[str, str], known: Iterable[str], otherwise: str | None = None) -> Column:
    """Lower case, blanks and hyphens to underscores, aliases resolved; what is not known becomes ``otherwise``."""
    t = F.regexp_replace(F.lower(stripped(c)), r"[ \-]", "_")
    if aliases:
        t = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), t), t)
    return F.when(t.isin(*known), t).otherwise(F.lit(otherwise))


def vote_item(label: Column, certainty: Column, confidence: Column, reason: Column) -> Column:
    """Struct (label, certainty, confidence, reason) of a vote: the label by the fixed aliases, null if unknown; an
    unknown certainty is medium; confidence from 0 to 1, a half where it is no number; 220 characters of reason."""
    sure = F.lower(stripped(certainty))
    number = F.coalesce(stripped(confidence.cast("string")).try_cast("double"), F.lit(0.5))
    return F.struct(
        vote_label(label, LABEL_ALIASES, LABELS).alias("label"), F.when(sure.isin("high", "medium", "low"), sure).otherwise("medium").alias("certainty"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)).alias("confidence"), F.substring(stripped(reason), 1, 220).alias("reason"),
    )


def top_json(items: Column, most: int = 3) -> Column:
    """The first items of an array of structs as JSON text."""
    return F.to_json(F.slice(items, 1, most))


def dated_name(stem: str, at: Column, ending: str) -> Column:
    """stem_YYYYMMDD_HHMMSS.ending for a time."""
    return F.concat(F.lit(f"{stem}_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(f".{ending}"))


def json_object(c: Column) -> Column:
    """The first object in a text, code fences aside: from the first brace to the last."""
    out = F.regexp_extract(text_of(c), r"(?s)\{.*\}", 0)
    return F.when(out != "", out)


def dictionary_hit(text: Column, abbrev: Column) -> Column:
    """Whether the abbreviation stands in the text, case kept, between other characters than letters and digits."""
    return F.regexp_like(text_of(text), F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), abbrev, F.lit(r"\E(?![A-Za-z0-9])")))


def relation_mark(c: Column) -> Column:
    """``=`` and ``'=`` as ``'=``; ``<`` and ``>`` as they are; anything else null."""
    t = stripped(c)
    return F.when(t.isin("=", "'="), "'=").when(t.isin("<", ">"), t)


def prefixed_id(c: Column, prefix: str) -> Column:
    """A bare number, letters AA before it or not, with the catalog's prefix; other ids as they are."""
    t = stripped(c)
    return F.when(t.rlike(r"^(AA)?\d+$"), F.concat(F.lit(prefix), t)).otherwise(t)


def removed_items(items: Column, kinds: Iterable[str], otherwise: str = "noise") -> Column:
    """array<struct<text,kind>>: blanks left out, unknown kinds as ``otherwise``."""
    listed = words_array(kinds)
    clean = F.transform(items, lambda x: F.struct(stripped(x["text"]).alias("text"), F.when(F.array_contains(listed, F.lower(stripped(x["kind"]))), F.lower(stripped(x["kind"]))).otherwise(otherwise).alias("kind")))
    return F.filter(clean, lambda x: x["text"] != "")


def contains_folded(c: Column, part: Column) -> Column:
    """Whether a text contains a part, case aside."""
    return F.contains(F.lower(text_of(c)), F.lower(part))
