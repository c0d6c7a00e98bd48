import difflib

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import similarity as S
from lexigrid.functions import text as T
from lexigrid.lexicon import Lexicon

LEX = Lexicon()


@pytest.fixture(scope="module")
def value(spark):
    def of(make, *args):
        kinds = {str: "string", list: "array<string>", float: "double", int: "int"}
        schema = ", ".join(f"c{i} {kinds.get(type(a), 'string')}" for i, a in enumerate(args)) or "c int"
        df = spark.createDataFrame([args or (0,)], schema)
        return df.select(make(*[F.col(c) for c in df.columns]).alias("v")).first()["v"]

    return of


@pytest.mark.parametrize(("text", "want"), [("Broca's area", "brocas area"), ("Pre-frontal/A_B & C", "pre frontal a b and c"), ("", ""), (None, ""), (" (,) ", ""), ("Café x", "caf x"), ("a\tb\nc", "a b c")])
def test_normalize(value, text, want):
    assert value(T.normalize, text) == want


def test_nfkc_before_normalizing(value):
    assert value(lambda c: T.normalize(S.nfkc(c)), "ﬁber²") == "fiber2"


def test_tokens_and_strippers(value):
    assert value(lambda c: T.tokenize(c, LEX), "The core of the X") == ["core", "x"]
    assert value(lambda c: T.tokenize(c, LEX), "") == []
    assert value(lambda c: T.strip_laterality(c, LEX), "left X left Y") == "x y"
    assert value(T.strip_parenthetical, "X nucleus (y)") == "X nucleus  "
    assert value(T.flatten_parentheses, "X nucleus (y)") == "X nucleus  y "
    assert value(T.cut_exclusion, "thalamus excluding y").strip() == "thalamus"
    assert value(T.strip_markers, "BLA Ppp1r1b") == "BLA"
    assert value(T.strip_markers, "MDTGlut") == "MDT"
    assert value(T.strip_markers, "neurons") == "neurons"
    assert value(T.stripped, "\t x \n") == "x"


def test_ngrams(value):
    assert value(lambda c: T.ngrams(c, 3), "ab") == ["ab"]
    assert sorted(value(lambda c: T.ngrams(c, 2), "abc ab")) == ["ab", "bc", "ca"]
    assert value(lambda c: T.ngrams(c, 2), "") == []


def test_modifiers_and_distinct(value):
    assert value(lambda c: T.modifier_terms(c, LEX), "dorsal x (core, part of y) core") == ["core", "part", "y", "core part of y", "dorsal"]
    assert value(T.distinct_normalized, ["A b", " a-B ", "", "c"]) == ["A b", "c"]


@pytest.mark.parametrize(("a", "b", "same"), [("23c", "5", False), ("6a", "6", True), ("a1", "a8", False), ("03a", "3", True)])
def test_area_ids(value, a, b, same):
    assert bool(set(value(lambda c: T.area_keys(T.area_ids(c)), a)) & set(value(lambda c: T.area_keys(T.area_ids(c)), b))) == same


def test_area_id_parts(value):
    assert value(lambda c: T.area_keys(T.area_ids(c)), "area v3a and x") == ["v:3"]


@pytest.mark.parametrize(("text", "want"), [("nucleus of lateral olfactory tract", "gray"), ("lateral lemniscus dorsal nucleus", "gray"), ("visual area", "cortex"), ("foo", None), ("", None)])
def test_structure_head(value, text, want):
    assert value(lambda c: T.structure_head(T.split_words(c)), text) == want


@pytest.mark.parametrize(("q", "c", "want"), [(["precuneiform"], ["cuneiform"], True), (["precuneiform"], ["precuneiform"], False), (["cuneiform"], ["precuneiform"], False)])
def test_affix_mismatch(value, q, c, want):
    assert value(S.affix_mismatch, q, c) is want


@pytest.mark.parametrize(("h", "n", "want"), [("major insular cortex", "insular cortex", True), ("retroreuniens x", "reuniens", False)])
def test_boundary_contains(value, h, n, want):
    assert value(S.boundary_contains, h, n) is want


@pytest.mark.parametrize(("a", "b", "want"), [("habenula", "habenular", True), ("amygdala", "amygdaloid", True), ("dorsal", "ventral", False), ("abc", "abcd", False)])
def test_stem_match(value, a, b, want):
    assert value(S.stem_match, a, b) is want and value(S.stem_match, b, a) is want


def test_similarities(value):
    assert value(S.dice, [], ["x"]) == 0 and value(S.dice, ["a", "b"], ["b", "c"]) == 0.5
    assert value(S.jaccard, ["a", "b"], ["b", "c"]) == pytest.approx(1 / 3)
    assert value(S.containment, "insular cortex", "major insular cortex") == pytest.approx(0.92)
    assert value(S.sequence_ratio, "small ring", "small rign") == difflib.SequenceMatcher(None, "small ring", "small rign").ratio()
    assert value(lambda a, b: S.string_similarity(a, b, LEX), "A-b", "a b") == 1.0
    assert value(lambda a, b: S.string_similarity(a, b, LEX), "", "a b") == 0.0
    assert value(S.modifier_match, [], "x") == 1.0 and value(S.modifier_match, ["core", "y"], "x core") == 0.5


@pytest.mark.parametrize(("text", "want"), [("left X", "left"), ("L and R X", "unknown"), ("bilateral X", "bilateral"), ("both left X", "left"), ("ipsilateral X", "left"), ("X", "unknown")])
def test_laterality(value, text, want):
    assert value(T.laterality, text) == want


def test_small_text_helpers(value):
    assert value(T.title_case, "pre-frontal x") == "Pre-Frontal X"
    assert value(T.humanize, "field_OF_the_x") == "Field of the X"
    assert value(T.is_layer, "LIVa") is True and value(T.is_layer, "L7") is False
    assert value(T.is_unknown, " N/A ") is True
    assert value(T.is_abbreviation, "NAc") is True and value(T.is_abbreviation, "nac") is False
    assert value(lambda a, b: T.merged_notes(a, b), "x | y", "y | z") == "x | y | z"
    assert value(lambda c: T.vote_label(c, {"ok": "aligned"}, ["aligned", "broader_parent"]), "Broader-Parent") == "broader_parent"
    assert value(T.json_object, "```json\n{\"a\": {\"b\": 1}}\n```") == '{"a": {"b": 1}}'
    assert value(T.dictionary_hit, "in NAc, core", "NAc") is True and value(T.dictionary_hit, "in nac", "NAc") is False and value(T.dictionary_hit, "xNAc", "NAc") is False
