import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given_list", "numbers"),
    [("1, 3-5", [1, 3, 4, 5]), ("12", [12]), ("2–4", [2, 3, 4]), ("5-3", [5]), ("2,", [2, 0]), ("1-2-3", [1]), ("2 3", []), ("1-500", list(range(1, 101))), ("7;9", [7, 9])],
)
def test_number_lists(spark, given_list, numbers):
    assert value(spark, tx.number_list(F.lit(given_list))) == numbers


def test_spans_slice_back_to_the_marker(spark):
    t = "As [1, 3-5] shows (see [12]), and [2–4]."
    rows = value(spark, tx.spans_of(F.lit(t), tx.BRACKET))
    assert [r["inner"] for r in rows] == ["1, 3-5", "12", "2–4"]
    assert all(t[r["start_pos"] : r["end_pos"]] == r["raw"] for r in rows)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["[1]", "ab ", "[2, 3]", "é", "[", "] ", "(x)"]), max_size=8))
def test_spans_of_any_text(spark, parts):
    t = "".join(parts)
    rows = value(spark, tx.spans_of(F.lit(t), tx.BRACKET))
    assert all(t[r["start_pos"] : r["end_pos"]] == r["raw"] for r in rows)
    assert len(rows) == t.count("[1]") + t.count("[2, 3]")


def test_identifiers(spark):
    t = F.lit("Doe (2019a). A title. doi 10.1234/ab.c-1). arXiv:1706.03762v2, 1899 and 2031.")
    assert value(spark, tx.doi_of(t)) == "10.1234/ab.c-1"
    assert value(spark, tx.arxiv_of(t)) == "1706.03762"
    assert value(spark, tx.last_year(t, 2026)) == 2019
    assert value(spark, tx.doi_of(F.lit("none"))) is None and value(spark, tx.last_year(F.lit("none"), 2026)) is None


@pytest.mark.parametrize(("a", "b", "score"), [("One of two words", "one of two words", 1.0), ("alpha beta gamma delta", "Alpha beta gamma delta and much more of it", 1.0), ("alpha beta", "alpha gamma", 0.5), ("x", "y", 0.0)])
def test_title_score(spark, a, b, score):
    assert value(spark, tx.token_score(tx.title_tokens(F.lit(a)), tx.title_tokens(F.lit(b)))) == pytest.approx(score)


def test_noise_predicates(spark):
    assert value(spark, tx.is_math_noise(F.lit("x = y + z ≤ 3"))) is True
    assert value(spark, tx.is_math_noise(F.lit("A plain sentence that says something clearly."))) is False
    assert value(spark, tx.is_numeric_debris(F.lit("12 3.5 | 7% 8"))) is True
    assert value(spark, tx.is_numeric_debris(F.lit("all words are longer here"))) is False


def test_lines_are_joined_without_their_hyphens(spark):
    assert value(spark, tx.join_wrapped(F.array(*map(F.lit, ["a divi-", "ded word", "Non-", "Latin"])))) == "a divided word Non- Latin"
    assert value(spark, tx.join_wrapped(F.array().cast("array<string>"))) == ""


def test_sentence_at_position(spark):
    t = "See Fig. 2 of Smith et al. here. The second one [3] is cited. End."
    at = t.index("[3]")
    assert value(spark, tx.sentence_at(F.lit(t), F.lit(at))) == "The second one [3] is cited."


def test_latex_and_superscripts(spark):
    assert value(spark, tx.latex(F.lit("50% & a_b \\ ~ ^ ⟦^3⟧"))) == r"50\% \& a\_b \textbackslash{} \textasciitilde{} \textasciicircum{} [3]"
    assert value(spark, tx.plain_superscripts(F.lit("x⟦^1,2⟧"))) == "x[1,2]"


def test_quotes(spark):
    assert value(spark, tx.quote_in_text(F.lit("A “quoted” part"), F.lit("with a quoted, part of it"))) is True
    assert value(spark, tx.quote_in_text(F.lit("short"), F.lit("short"))) is False


def test_index_is_rebuilt(spark):
    m = F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2)))
    assert value(spark, tx.rebuild_from_index(m)) == "a b a"
