import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import classify as C


def ask(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_normalise(spark):
    assert ask(spark, ["  “It’s  here.” ", "", None, "A b\n\tc,"], X.normalise) == ["it's here", "", None, "a b c"]


def test_normalise_is_stable(spark):
    values = ["  “It’s  here.” ", "'..x", 'a" "', "  ...  "]
    once = ask(spark, values, X.normalise)
    assert ask(spark, once, X.normalise) == once


def test_tokenisers(spark):
    text = ["The courses are delivered within 24 hours, via mapping fixtures", "", None]
    got = {n: ask(spark, text, f) for n, f in X.TOKENISERS.items()}
    assert got["content"][0] == ["course", "deliver", "within", "hour", "mapp", "fixture"]
    assert got["significant"][0] == ["deliver", "within", "hour", "mapp", "fixture"]
    assert got["link"][0] == ["course", "deliver", "within", "hour", "mapp", "fixture"]
    assert "course" in got["feature"][0] and "the" not in got["feature"][0]
    assert got["topic"][0] == ["cours", "deliver", "mapp", "fixtur"]
    assert got["merge"][0][:2] == ["course", "delivered"]
    assert all(v[1] == [] and v[2] == [] for v in got.values())


def test_splits(spark):
    assert ask(spark, ["One. Two! three? Four"], X.sentences) == [["One.", "Two!", "three?", "Four"]]
    assert ask(spark, ["One. Two! three? Four"], X.strict_sentences) == [["One.", "Two! three?", "Four"]]
    assert ask(spark, ["A does b; c does d, and e does f but g and h stay."], X.clauses) == [["A does b", "c does d", "e does f", "g and h stay."]]


def test_small_things(spark):
    assert ask(spark, ["Guest  Checkout!", "é"], X.slug) == ["guest-checkout", "unnamed-feature"]
    assert ask(spark, ["DeliveryRadius", "SSOConfig"], X.decamel) == ["Delivery Radius", "SSO Config"]
    assert ask(spark, ["[00:01] Nadia Brook: hello: you"], X.strip_speaker) == ["hello: you"]
    assert ask(spark, ["<think>no</think>yes", "left over</think> yes", "yes"], X.strip_thinking) == ["yes", "yes", "yes"]
    assert ask(spark, ["Implement the export", "Enable x", "The export"], X.destub) == ["The export", "X", "The export"]
    assert ask(spark, ["00:00:01.250", "1:02:03,5", "[00:10]", "12.5s", None], X.clock_millis) == [1250, 3723500, 10000, None, None]


def test_numbers(spark):
    assert ask(spark, ["1,200 and 24 or twenty"], X.numerals) == [["1200", "24", "twenty"]]
    assert ask(spark, ["hundred", "twenty", "1,200.5"], X.number_value) == [None, 20.0, 1200.5]
    m = ask(spark, ["within 24 hours, or two business days, 5 stars and 24 hours", None], X.measures)
    assert [(r["unit"], r["value"]) for r in m[0]] == [("hour", 24.0), ("day", 2.0), ("star", 5.0)] and m[1] == []
    assert ask(spark, ["10,000 units", "four hours, two days", ""], X.is_multipart) == [False, True, False]


def test_areas(spark):
    assert ask(spark, ["NEW: DeliveryRadius", "There annual leave (existing)", '"**Roster**"', "Category Shouldn", "", "Exports NEW: x"], X.clean_area) == ["Delivery Radius", "annual leave", "Roster", "", "", "Exports"]
    assert ask(spark, ["Misc", "Ticket Features", "Guest Checkout"], X.is_dump_area) == [True, True, False]
    assert ask(spark, ["Send the invoice archive to them", "the", None], lambda c: X.area_from_summary(c, F.lit(None).cast("string"))) == ["Invoice Archive", "Misc", "Misc"]


def test_summaries(spark):
    assert ask(spark, ["so, implement the export", "", None], X.summary_from_quote) == ["The export.", "", ""]
    long = "When " + "word " * 30 + "ends"
    assert len(ask(spark, [long], X.summary_from_quote)[0].split()) == 24
    df = spark.createDataFrame([("Discussed exports.", "exports keep thirty days"), ("Exports keep thirty days.", "exports keep thirty days"), (None, "keep it"), ("Alpha beta gamma delta", "exports keep")], "s string, q string")
    assert [r[0] for r in df.select(X.repair_summary(F.col("s"), F.col("q"))).collect()] == ["Exports keep thirty days.", "Exports keep thirty days.", "Keep it.", "Exports keep."]


CASES = [
    ("banter", "Thanks, everyone", True), ("banter", "I’m glad you like it", True), ("banter", "The invoice is late", False),
    ("echo", "Yes, same rule", True), ("echo", "Yes, " + "word " * 12, False), ("logistics", "Let's move the call to Friday", True), ("logistics", "Move the invoice to the archive", False),
    ("aspiration", "It should just feel premium", True), ("aspiration", "It should feel fast, under 2 seconds", False),
    ("undecided", "We haven’t decided the refund window", True), ("undecided", "Finance agreed the refund window", False), ("undecided", "We decided the open question", False), ("resolves", "That settles the open question", True),
    ("hedge", "Let me check with legal", True), ("requirement", "The export must keep thirty days", True), ("requirement", "With one shortcut.", False), ("no_change", "It stays as is", True),
    ("narration", "Discussed the export", True), ("vague_gap", "What are the details?", True), ("vague_gap", "What is the limit?", False),
]


def test_classifiers(spark):
    for name in C.CLASSIFIERS:
        mine = [(t, want) for n, t, want in CASES if n == name]
        assert ask(spark, [t for t, _ in mine], C.CLASSIFIERS[name]) == [w for _, w in mine], name
    assert all(ask(spark, [None, ""], f) == [False, False] for f in C.CLASSIFIERS.values())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_normalise_like_python(spark, values):
    import re

    blank = "[\t\n\x0b\x0c\r \x85\xa0  -     　]+"
    values = [v.replace("\x00", "").lower() for v in values if v.lower() == v.lower().lower() and v.isascii()]
    if values:
        assert ask(spark, values, X.normalise) == [re.sub(blank, " ", v).strip(" \t\n\"'.,") for v in values]


@pytest.mark.parametrize("name", sorted(X.TOKENISERS))
def test_long_text(spark, name):
    assert len(ask(spark, ["alphabet" * 3 + " beta9x" * 20000], X.TOKENISERS[name])[0]) <= 2
