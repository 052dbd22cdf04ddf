from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.splitting import cut, split_texts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .!\n-1", max_size=300), min_size=1, max_size=4), st.integers(12, 60), st.integers(0, 10))
def test_cuts(texts, limit, overlap):
    for text, spans in zip(texts, cut(texts, limit, overlap, 0.5)):
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(e - s <= limit for s, e, _ in spans)
        for (_, e0, _), (s1, e1, _) in zip(spans, spans[1:]):
            assert e0 - overlap <= s1 <= e0 < e1
        whole = text[: spans[0][1]] + "".join(text[e0:e1] for (_, e0, _), (_, e1, _) in zip(spans, spans[1:]))
        assert whole == text


def greedy(text, limit, overlap, fill):
    """One cut after the other, as plainly as possible."""
    from factloom.llm import splitting as S

    at, kind = S._with_hard_cuts(*S.boundaries(text), limit, overlap)
    out, end = [], 0
    while end < len(text):
        start = 0 if not out else min((a for a in at if a >= end - overlap), default=end)
        start = min(start, end)
        if len(text) - start <= limit:
            end = len(text)
        else:
            legal = [(a, k) for a, k in zip(at, kind) if end < a <= start + limit]
            choice = next((max(good) for level in range(5) if (good := [a for a, k in legal if k <= level and (a >= start + int(limit * fill) or level >= S.WORD)])), None)
            end = choice if choice else min(a for a in at if a > end)
        out.append((start, end))
    return out or [(0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc .\n", max_size=250), st.integers(15, 50))
def test_doubling_equals_the_plain_loop(text, limit):
    got = [(int(s), int(e)) for s, e, _ in cut([text], limit, 5, 0.5)[0]]
    assert got == greedy(text, limit, 5, 0.5)


def test_boundary_kinds():
    text = "A first paragraph ends here.\n\n- an item follows it\n- another item. With a sentence. And one more of them here"
    kinds = [k for _, _, k in cut([text], 40, 0, 0.5)[0]]
    assert kinds[0] == 0 and 1 in kinds or kinds[0] == 0


def test_in_spark(spark):
    df = spark.createDataFrame([("k", 1, "word " * 700, 5), ("k", 2, "short", 6), ("k", 3, None, 7), ("k", 4, "", 8), ("k", 5, "x" * 6000, 9), ("k", 6, "é🙂 " * 1000, 9)], "source_id string, line_no int, text string, piece_no int")
    got = split_texts(df, ["source_id", "line_no"], "text").collect()
    n = {}
    for r in got:
        n[r.line_no] = n.get(r.line_no, 0) + 1
        assert len(r.piece) <= 2500 and len(r.piece) == r.end_pos - r.start_pos + 1
    assert n == {1: 2, 2: 1, 4: 1, 5: 3, 6: 2}
    assert split_texts(df.limit(0), ["source_id"], "text").count() == 0
