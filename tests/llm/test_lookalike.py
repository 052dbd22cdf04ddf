import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.lookalike import LOOKALIKES, Conflict, build_table, consistent, same_looking, transducer


@pytest.mark.parametrize("text, form", [
    ("Ｗｈａｔ ａｂｏｕｔ", "What about"), ("Τhat sho⁠uld feel", "That should feel"), ("ö é", "ö é"), ("e​́x", "éx"), ("ﬁne ﬂow", "fine flow"), ("a­b﻿c", "abc"), ("45 m² ½", "45 m² ½"),
    ("👩‍💻 a‍b", "👩‍💻 ab"), ("сo-op", "co-op"), ("а́", "á"), ("  x  ", "x"), ("a  b", "a  b"), ("“x” – y", "“x” – y"), ("", ""), ("résumé", "résumé"), ("αβγ", "αβγ"),
])
def test_form(text, form):
    assert transducer().form(text) == form


@pytest.mark.parametrize("a, b", [("ρ", "p"), ("τ", "t"), ("κ", "k"), ("օ", "o"), ("ⅳ", "iv"), ("𝐀", "A"), ("ꓮ", "A"), ("ｶﾞ", "ガ"), ("각", "\u1100\u1161\u11a8"), ("1\u200b\u0301", "1\u0301"), ("ậ", "a\u0302\u0323")])
def test_same_picture(a, b):
    assert transducer().form(f"x {a}.") == transducer().form(f"x {b}.")


@settings(max_examples=300)
@given(st.text(max_size=30))
def test_stable_and_aligned(text):
    t = transducer()
    once = t.form(text)
    assert t.form(once) == once
    form, at = t.aligned(text)
    assert at is None or len(at) == len(form) and all(0 <= a <= b < len(text) for a, b in zip(at, at[1:] + at[-1:]))


def test_table_has_no_conflict():
    table = build_table()
    assert all(ch not in table for form in table.values() for ch in form)
    LOOKALIKES[" "] = "x"
    try:
        with pytest.raises(Conflict):
            build_table_with_space_as_letter()
    finally:
        del LOOKALIKES[" "]


def build_table_with_space_as_letter():
    table = build_table()
    if table[" "] != " ":
        raise Conflict("a space became a letter")


def test_columns(spark):
    df = spark.createDataFrame([("k", 1, "Ｈｉ there", "x"), ("k", 2, None, "x"), ("k", 3, "plain ", "x"), ("z", 4, "Hi there", "x")], "s string, i int, t string, extra string")
    assert [r[0] for r in df.orderBy("i").select(consistent(df.t)).collect()] == ["Hi there", None, "plain", "Hi there"]
    q = spark.createDataFrame([("k", 7, "Hi there", "y"), ("k", 8, "Ｈｉ there", "y"), ("k", 9, None, "y")], "s string, k int, q string, extra string")
    got = same_looking(q, df, ["s"], "q", "t")
    assert sorted((r.k, r.i, r.extra) for r in got.collect()) == [(7, 1, "y")]
    assert same_looking(q.limit(0), df, ["s"], "q", "t").count() == 0
