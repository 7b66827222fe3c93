import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioloom.functions import headings
from folioloom.functions import text as tx
from folioloom.functions.similarity import is_in_source, is_placeholder, predicate_matches, ratio_bound, same_entity, similar_names

TEXTS = st.lists(st.text("ab Zé.;,!?-|1_\n\t ", max_size=60), min_size=20, max_size=20)
SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def sentences(t):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s.strip()]


def condensed(t, sentences_, chars):
    parts = sentences(t)[:sentences_]
    out = ""
    for s in parts:
        if out and len(out) + 1 + len(s) > chars:
            break
        out = f"{out} {s}" if out else s
    if len(out) <= chars:
        return out
    head = out[:chars]
    at = next((p for m in ("; ", ", ") if (p := head.rfind(m)) >= chars * 0.6), -1)
    out = head[:at] if at >= 0 else head[: head.rfind(" ")] if " " in head else head
    out = out.rstrip(" ,;:-—")
    return out if out and out[-1] in ".!?" else out + "."


@SLOW
@given(TEXTS)
def test_columns_against_python(spark, texts):
    assert values(spark, tx.sentences_of, texts) == [sentences(t) for t in texts]
    assert values(spark, tx.name_key, texts) == [" ".join(t.split()).lower() for t in texts]
    assert values(spark, tx.plain_text, texts) == [" ".join("".join(c for c in t.lower() if c.isalnum() or c.isspace()).split()) for t in texts]
    assert values(spark, tx.word_text, texts) == ["".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" or c.isspace() else " " for c in t.lower()) for t in texts]
    snake = ["_".join([w for w in re.sub("[^a-z_]", "", re.sub("[ -]", "_", t.strip().lower())).split("_") if w][:3]) for t in texts]
    assert values(spark, tx.snake_name, texts) == snake
    for n, chars in ((1, 20), (3, 40)):
        assert values(spark, lambda c: tx.condense(c, n, chars), texts) == [condensed(t, n, chars) for t in texts]  # noqa: B023


def test_sentences_that_are_easily_got_wrong(spark):
    got = values(spark, tx.sentences_of, ["Such as e.g. this one.", 'He said "no." Then left.', "One;  two. \n Three!", ""])
    assert got == [["Such as e.g.", "this one."], ['He said "no." Then left.'], ["One;  two.", "Three!"], []]
    assert values(spark, lambda c: tx.sentences_of(c, True), ["One;  two. Three"]) == [["One", "two.", "Three"]]
    assert values(spark, tx.snippet_sentences, ["short. one."]) == [["short. one."]]


def test_answers_without_reasoning_or_fence(spark):
    raw = ["<think>a</think>b", "x</Thinking> y", "z <reasoning> w", "<analysis>1</analysis><think>2</think> 3", "plain"]
    assert values(spark, tx.without_reasoning, raw) == ["b", "y", "w", "3", "plain"]
    assert values(spark, tx.without_reasoning, ["< think >x</ think > y", "a <\t/ analysis >b", "x< thinking\n>y"]) == ["y", "b", "y"]
    assert values(spark, tx.without_fence, ["```json {1}```", "```", "```\na\n```b```c"]) == ["```json {1}", "", "a\n```b"]
    assert values(spark, tx.without_fence, ['```json\n{"a": 1}\n```\nbye', "no ``` fence"]) == ['{"a": 1}', "no ``` fence"]


def test_triples(spark):
    raw = ["a | b | c", "a, b, c", "a - b - c", "well-known, is, x", "only two | parts", "a | b | c | d"]
    assert values(spark, tx.tidy_triple, raw) == ["a | b | c", "a | b | c", "a | b | c", "well-known | is | x", "only two | parts", "a | b | c | d"]


def test_headings(spark):
    raw = ["References", "7. Works cited:", "IV) Bibliografia", "references to others", "Referências bibliográficas", "My references"]
    assert values(spark, headings.is_references_heading, raw) == [True, True, True, False, True, False]
    assert values(spark, headings.starts_with_references, ["References Smith 2001", "the references"]) == [True, False]
    pages = ["text\nReferences\nSmith", "left column     References\nx", "nothing here", "a    References\nBibliography"]
    assert values(spark, headings.references_position, pages) == [5, 16, None, 5]
    intro = ["Introduction", "1. Introduction We begin", "INTRODUCTION We begin", "Introduction We begin", "2 INTRODUÇÃO: sim", ""]
    assert values(spark, headings.after_introduction, intro) == ["", "We begin", "We begin", None, "sim", None]


@pytest.mark.parametrize(
    ("phrase", "source", "want"),
    [("art", "a part of it", True), ("of it", "x", True), ("long words here", "other text", False), ("", "x", False), ("red blue green", "red and blue", True), ("red blue green", "red only", False)],
)
def test_grounding(spark, phrase, source, want):
    df = spark.createDataFrame([(phrase, source)], "p string, s string")
    assert df.select(is_in_source(F.col("p"), F.col("s"))).head()[0] is want


def test_similar_names(spark):
    from difflib import SequenceMatcher

    names = ["part of", "parts of", "part_of", "component", "components", "compenent", "x", "xs", "", "a longer name here", "a longer nane here"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for r in df.select("a", "b", similar_names(F.col("a"), F.col("b")).alias("s"), ratio_bound(F.col("a"), F.col("b")).alias("u")).collect():
        true = SequenceMatcher(None, r.a, r.b).ratio()
        assert true <= r.u + 1e-9
        assert r.s == (r.a == r.b or r.a == r.b + "s" or r.b == r.a + "s" or true >= 0.85), r


def test_other_predicates(spark):
    df = spark.createDataFrame([("Part of", "part_of", "Entity A"), ("holds", "part_of", "entity"), ("", "x", "engine")], "p string, n string, e string")
    assert [tuple(r) for r in df.select(predicate_matches(F.col("p"), F.col("n")), is_placeholder(F.col("e"))).collect()] == [(True, True), (False, True), (False, False)]
    pairs = spark.createDataFrame([("red engine", "engine"), ("engine", "engines x"), ("a", ""), ("abcd", "wxyz")], "a string, b string")
    assert [r[0] for r in pairs.select(same_entity(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]
