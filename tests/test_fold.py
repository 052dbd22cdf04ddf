import pytest

from factloom.model import ReplayModel, RuleModel, explain_error, join_stream, parse_areas, parse_gaps, parse_merges, parse_statements, parse_verdict, with_retries
from factloom.operators import fold as D
from factloom.operators.fold import Row, Verdict
from factloom.runtime import checkpoint

W = frozenset


def row(quote, source="k1", **kw):
    words = W(w for w in quote.lower().split() if len(w) > 2)
    nums = W(w for w in quote.split() if w.isdigit())
    return Row(summary=quote, quote=quote, source_id=source, norm=quote.lower(), words=words, numbers=nums, numerals=nums, **kw)


def run(facts, stmts, verdict=lambda s, a: Verdict("UNCLEAR"), known=None):
    return [(e["event_type"], e["ef_id"], e["other_ef_id"], e["adds_fact"]) for e in D.fold(facts, stmts, verdict, known)]


OLD = [row("export keeps thirty days", "k0", ef_id=1), row("refund within 24 hours", "k0", ef_id=2)]
CASES = [
    ([row("alpha beta gamma")], None, [("new", 3, None, True)]),
    ([row("export keeps thirty days")], None, [("restated", None, None, False)]),
    ([row("export keeps ninety days", verified=False)], None, [("unverified", None, None, False)]),
    ([row("export keeps ninety days")], None, [("review", None, None, False)]),
    ([row("export keeps ninety days")], Verdict("NEW"), [("new", 3, None, True)]),
    ([row("export keeps thirty")], Verdict("DUPLICATE", 1), [("restated", None, 1, False)]),
    ([row("export keeps thirty")], Verdict("DUPLICATE", 9), [("review", None, None, False)]),
    ([row("export still keeps thirty", no_change=True)], Verdict("UNCLEAR"), [("restated", None, None, False)]),
    ([row("export still keeps thirty", no_change=True)], Verdict("CHANGE", 1), [("restated", None, 1, False)]),
    ([row("export still keeps 40", no_change=True)], Verdict("CHANGE", 1), [("changed", 3, 1, True)]),
    ([row("export keeps ninety days")], Verdict("CHANGE", 1), [("changed", 3, 1, True)]),
    ([row("export keeps ninety days")], Verdict("CHANGE", 2), [("changed", 3, 1, True)]),  # re-aimed by wording
    ([row("export keeps ninety days", "k0")], Verdict("CHANGE", 1), [("new", 3, 1, True)]),  # same call
    ([row("ninety", no_change=True)], Verdict("CHANGE", 2), [("restated", None, 2, False)]),
]


@pytest.mark.parametrize("stmts, verdict, want", CASES)
def test_verdicts(stmts, verdict, want):
    assert run(OLD, stmts, lambda s, a: verdict or Verdict("UNCLEAR")) == want


def test_partial_and_unshared_changes():
    table = [row("high 4 hours, low 3 days", "k0", ef_id=1, multipart=True)]
    table[0].numerals = W({"4", "3"})
    assert run(table, [row("high 2 hours")], lambda s, a: Verdict("CHANGE", 1)) == [("review", 2, 1, True)]
    s = row("qqq 5", no_change=True)
    assert run(OLD, [s], lambda st, a: Verdict("CHANGE", 1)) == [("review", 3, 1, True)]


def test_empty_area_and_order():
    assert run([], [row("stays as is", no_change=True)]) == [("dropped", None, None, False)]
    later, first = row("export keeps thirty days", seq=2), row("export keeps thirty days", seq=1)
    assert run([], [later, first]) == [("new", 1, None, True), ("restated", None, None, False)]


def test_questions():
    long = "what is the refund window for vouchers"
    ask = lambda q: row(q, kind="question")
    assert [e[0] for e in run([], [ask(long), ask("so, " + long), ask("short"), ask("short")])] == ["question", "asked_again", "question", "asked_again"]
    assert run([], [ask(long)], known={long})[0][0] == "asked_again"


def test_best_target():
    facts = [row("alpha beta one", ef_id=1), row("alpha beta two", ef_id=2), row("gamma", ef_id=3)]
    assert D.best_target(W({"alpha", "beta"}), facts[:2]).ef_id == 2  # ties to the larger id
    assert D.best_target(W({"gamma"}), facts).ef_id == 3
    assert D.best_target(W({"alpha"}), facts[:2]) is None


def test_fold_in_spark(spark):
    from tests.fixture import TURNS

    s = spark.createDataFrame(
        [("p", "Refunds", i, "fact", t, t, sp, ts, k, None, True) for i, (k, n, ts, sp, t) in enumerate(TURNS) if "refunds" in t] + [("p", None, 99, "fact", "x", "x", None, None, "k", None, True)],
        "project string, feature string, seq bigint, kind string, summary string, quote string, speaker string, ts string, source_id string, call_date date, verified boolean",
    )
    facts = spark.createDataFrame([], "project string, feature string, ef_id int, superseded_by int, summary string, quote string, speaker string, ts string, source_id string, call_date date")
    events = checkpoint(D.fold_events(s, facts, RuleModel().verdict))
    got = [(r.event_type, r.ef_id, r.other_ef_id) for r in events.orderBy("seq").collect()]
    assert got == [("new", 1, None), ("changed", 2, 1), ("new", 3, None)]
    after = checkpoint(D.facts_after(facts, events))
    assert {(r.ef_id, r.superseded_by) for r in after.collect()} == {(1, 2), (2, None), (3, None)}
    again = D.fold_events(s, after, RuleModel().verdict)
    assert {r.event_type for r in again.collect()} == {"restated"}  # the same call again adds no facts
    c = D.run_counters(events).first()
    assert (c.n_new, c.n_changed, c.n_restated) == (2, 1, 0)
    assert D.change_log(events).count() == 3 and D.open_items(events).count() == 0
    assert all(r.is_sound for r in D.version_chain(after).collect())
    assert D.fold_events(s.limit(0), facts, RuleModel().verdict).count() == 0


def test_replies():
    facts = [row("a b", ef_id=3)]
    assert parse_verdict("VERDICT: CHANGE\nTARGET: EF-3\nREASON: value", facts) == Verdict("CHANGE", 3, "value")
    assert parse_verdict("VERDICT: CHANGE\nTARGET: 9", facts).verdict == "UNCLEAR" and parse_verdict("hm", facts).verdict == "UNCLEAR"
    assert parse_verdict("verdict: duplicate\ntarget: 9", facts) == Verdict("DUPLICATE", None, "")
    reply = "## STATEMENT\nFeature: A\nSummary: s\nQuote: q\nSpeaker: x\nTimestamp: t\n\n## STATEMENT\nFeature: B\n## OPEN_QUESTION\nFeature: A\nQuestion: why\nQuote: q2\nSpeaker: x\nTimestamp: t"
    assert [(b["kind"], b["summary"]) for b in parse_statements(reply)] == [("fact", "s"), ("question", "why")]
    assert parse_areas("1 = Exports\n2) Refunds\n7 = x\n1 = Late", 2) == {1: "Exports", 2: "Refunds"}
    assert parse_gaps("GAP: What limit? [from EF-1, EF-9]\n- GAP: x [EF-9]", {1}) == [("What limit?", [1])]
    assert parse_merges("MERGE: 1 + 2 => 2\nMERGE: zz => zz", ["A", "B"]) == [["B", "A"]]
    assert join_stream(['{"message": {"content": "a"}}', "", '{"response": "b"}']) == "ab"
    assert ReplayModel({"q": ("NEW",)}).verdict(Row("q", "q", "k", norm="q"), []).verdict == "NEW"
    assert "installed" in explain_error(OSError("model not found"), "m")


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("connection refused")
        return "ok"

    assert with_retries(flaky, sleep=waits.append) == "ok" and waits == [4.0, 8.0]
    with pytest.raises(OSError):
        with_retries(lambda: (_ for _ in ()).throw(OSError("bad request")), sleep=waits.append)


def test_fold_in_spark_equals_the_ledger_on_repeats_and_nulls(spark):
    import random

    rng = random.Random(5)
    quotes = ["The export stays as it is", "Export keeps thirty days", "Export keeps ninety days of invoices", "Refunds stay the same as before", "Refunds within 24 hours", "Vouchers need a manager"]
    rows = [
        ("p", rng.choice(["A", "B", "C"]), i, rng.choice(["fact", "fact", "fact", None, "question"]), rng.choice([None, "Export rule"]), rng.choice(quotes), None, None, f"k{i // 40}", None, rng.choice([True, True, True, None, False]))
        for i in range(240)
    ]
    s = spark.createDataFrame(rows, "project string, feature string, seq bigint, kind string, summary string, quote string, speaker string, ts string, source_id string, call_date date, verified boolean")
    facts = spark.createDataFrame([("p", "C", 1, None, "x", "Vouchers need a manager", None, None, "k", None)], "project string, feature string, ef_id int, superseded_by int, summary string, quote string, speaker string, ts string, source_id string, call_date date")
    for verdict in (lambda s, a: Verdict("UNCLEAR"), RuleModel().verdict):
        got = {(r.feature, r.seq): (r.event_type, r.ef_id, r.other_ef_id) for r in D.fold_events(s, facts, verdict).collect()}
        feats = D.with_features(s.withColumn("summary", D.F.when(D.F.col("kind") == "question", D.F.col("summary")).otherwise(D.X.repair_summary(D.F.col("summary"), D.F.col("quote"))))).toPandas()
        old = D.with_features(facts).toPandas()
        want = {}
        for area in ("A", "B", "C"):
            stmts = D._rows(feats[feats.feature == area], "seq")
            events = D.fold(D._rows(old[old.feature == area], "seq"), stmts, verdict)
            want |= {(area, q.seq): (e["event_type"], e["ef_id"], e["other_ef_id"]) for q, e in zip(sorted(stmts, key=lambda q: q.seq), events)}
        assert len(got) == len(rows) and got == want
