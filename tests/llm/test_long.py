"""Texts made to take long: time grows with the text alone."""

import time

import pytest

from readloom.llm import html, language, secrets, simhash, spelling, substring

N = 1_000_000


def within(seconds, f, *args):
    start = time.time()
    out = f(*args)
    assert time.time() - start < seconds
    return out


@pytest.mark.parametrize("unit", ["<a ", "<a '", "<a \"'", "<!", "<!--", "</", "<script ", "<", "</script ", "<p>", "<div><p", "&", "&#", "<a b=\"", "<a x = ", "a="])
@pytest.mark.parametrize("end", ["", ">", "'>", "\">"])
def test_pages(unit, end):
    within(20, html.lines, unit * (N // len(unit)) + end)


@pytest.mark.parametrize("unit", [".", ". ", ".)", "…\"", "a.", "a. ", " ", "\n", ".\n", "!?"])
def test_units(unit):
    within(20, substring.units, unit * (N // len(unit)) + "a")
    within(20, substring.remove.__globals__["units"], "a" + unit * (N // len(unit)))


def test_tags():
    assert html.lines("<p>a</p><a b='c<p>d") == [("a", False, False), ("<a b='c", False, False), ("d", False, False)]
    assert html.lines("<p title=\"x>y\">a<!-- <p> -->b</p><br/>c") == [("ab", False, False), ("c", False, False)]
    assert html.lines("one <a 'two <b>three") == [("one <a 'two three", False, False)]
    assert html.lines("<script>if (a < b) \"</p>\"</SCRIPT >x</>y") == [("x</>y", False, False)]


def test_sentences():
    cut = lambda t: [t[a:b] for a, b in substring.sentences(t)]
    assert cut("  One two. Three?! (Four.) . five ... six… ") == ["One two.", "Three?!", "(Four.)", ". five ...", "six…"]
    assert cut("... a") == ["...", "a"] and cut(". a") == [". a"] and cut("3.5 is. no.end") == ["3.5 is.", "no.end"] and cut("  ") == []


def test_letters(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 10)], "doc_id long, text string, lang string")
    model = language.train(docs)
    found = {t: model.predict(t)[0] for t in ("½ ² ① 12 _", "", "the ½ dog", "Ⅷ ⅷ")}
    assert found["½ ² ① 12 _"] == found[""] == language.UNDETERMINED and found["the ½ dog"] == "en"


def test_long_words():
    text = "x" * N + " " + "y " * (N // 2)
    within(20, simhash.fingerprint, text)
    within(20, spelling.PositionIndex, [text[:50_000], text[:49_999]])
