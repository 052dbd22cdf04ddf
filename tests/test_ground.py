from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import classify as C
from factloom.operators import ground as G
from tests.fixture import SCHEMA, TURNS


def turns(spark):
    return spark.createDataFrame(TURNS + TURNS[:2] + [("k9", 1, None, None, None), ("k9", 2, None, None, "")], SCHEMA)


def quotes(spark, rows):
    return spark.createDataFrame(rows, "k int, source_id string, quote string")


def test_verbatim(spark):
    q = quotes(spark, [
        (1, "k1", "must keep the LAST thirty days of invoices"), (2, "k2", "must keep the last ninety days of invoices"), (3, "k1", "up to 200 dollars within 24 hours. We haven’t decided"), (4, "k1", "as before"), (5, "k1", "..."), (6, "k1", None),
        (7, "k9", "approve refunds"), (8, "k1", "pprove refunds up to 200 dolla"), (9, "k2", "must keep the last thirty days of invoices"), (10, "k1", "same idea as before"),
    ])
    got = {r.k: r.quote_line for r in G.ground(q, turns(spark), "k").collect()}
    assert got == {1: 2, 2: None, 3: 3, 4: 6, 5: None, 6: None, 7: None, 8: 3, 9: 2, 10: 6}
    assert G.ground(q.limit(0), turns(spark), "k").count() == 0 and {r.quote_line for r in G.ground(q, turns(spark).limit(0), "k").collect()} == {None}


def test_verbatim_over_any_number_of_lines(spark):
    t = spark.createDataFrame([
        ("v", 1000, None, "N", "So the export keeps"), ("v", 1001, None, "O", "the last"), ("v", 2000, None, "N", "thirty"), ("v", 3000, None, None, "..."), ("v", 4000, None, "N", "days, of every"), ("v", 6001, None, "N", "signed invoice and nothing else"),
        ("b", 1, None, "N", "Refunds are approved"), ("b", 3, None, "N", "by a branch manager"), ("b", 9, None, "N", "within two days."),
    ], SCHEMA)
    q = quotes(spark, [
        (1, "v", "export keeps the last thirty ... days, of every signed invoice"), (2, "v", "the last thirty"), (3, "v", "of every signed invoice"), (4, "b", "refunds are approved by a branch manager within two days"), (5, "b", "approved by"), (6, "b", "manager within"),
        (7, "v", "export keeps the first thirty ... days, of every signed invoice"), (8, "b", "days"), (9, "v", "ths last"), (10, "b", "ranch man"),
    ])
    assert {r.k: r.quote_line for r in G.ground(q, t, "k").collect()} == {1: 1000, 2: 1001, 3: 4000, 4: 1, 5: 1, 6: 3, 7: None, 8: 9, 9: None, 10: 3}


def test_spans(spark):
    s = G.candidate_spans(spark.createDataFrame([("k", 1, None, None, "First sentence here. Tiny. First sentence here."), ("k", 2, None, None, "short"), ("k", 3, None, None, None)], SCHEMA))
    assert sorted((r.span, r.part) for r in s.collect()) == [("First sentence here.", 1), ("First sentence here. Tiny. First sentence here.", 0)]


def test_snap(spark):
    q = quotes(spark, [(1, "k1", "branch manager may approve refunds up to 200 dollars within 24 hours"), (2, "k1", "something else entirely about penguins"), (3, "k3", "manager can approve refunds within 48 hours at counter")])
    got = {r.k: (r.quote, r.verified, r.match_score) for r in G.snap_quotes(q, turns(spark), "k").collect()}
    assert got[1][0].startswith("A branch manager can approve") and got[1][1] and 0.66 <= got[1][2] < 1
    assert got[2] == ("something else entirely about penguins", False, None) and got[3][1]


def test_similarity_is_the_larger_ratio():
    assert G.similarity("a b c d", "a b c e") == max(0.75, 6 / 7) or G.similarity("a b c d", "a b c e") >= 0.75
    assert G.similarity("same", "same") == 1.0 and G.similarity("abc", "xyz") == 0.0


def test_dedup_and_times(spark):
    s = spark.createDataFrame([("k2", 2, "fact", "High tickets are now answered in three hours"), ("k2", 1, "question", "high tickets are now answered in three hours."), ("k2", 3, "fact", "Other words here now")], "source_id string, seq bigint, kind string, quote string")
    assert {(r.seq, r.kind) for r in G.dedup_quotes(s).collect()} == {(1, "question"), (3, "fact")}
    t = G.backfill_ts(s.withColumn("k", F.col("seq")).withColumn("ts", F.lit("99:99")), turns(spark), "k")
    assert {r.seq: r.ts for r in t.collect()} == {1: "00:00:12.000", 2: "00:00:12.000", 3: "not available"}


def test_answered(spark):
    rows = [(1, "k", "question", "refund window vouchers", "refund window vouchers", 100), (2, "k", "fact", "refund window sixty", "refund window sixty", 900), (3, "k", "question", "archive contract export", "archive contract export", 950), (4, "k", "fact", "archive", "archive", 1200), (5, "k", "question", "penguin", "penguin", 10), (6, "z", "question", "refund window", "refund window", 1)]
    s = spark.createDataFrame(rows, "k int, source_id string, kind string, summary string, quote string, pos int")
    assert {r.k for r in G.drop_answered(s, "k", "pos").collect()} == {2, 4, 5, 6}


def test_chatter_reclassify_unbundle_sweep(spark):
    t = turns(spark)
    s = t.where("text <> ''").dropDuplicates(["source_id", "line_no"]).select("source_id", "line_no", F.lit("fact").alias("kind"), F.col("text").alias("summary"), F.col("text").alias("quote"))
    kept = {(r.source_id, r.line_no) for r in C.drop_chatter(s).collect()}
    assert ("k0", 1) not in kept and ("k1", 1) not in kept and ("k1", 6) not in kept and ("k1", 7) not in kept and ("k1", 2) in kept
    asked = {(r.source_id, r.line_no) for r in C.reclassify(s).where("kind = 'question'").collect()}
    assert {("k1", 4), ("k1", 5)} <= asked and ("k1", 2) not in asked
    known = s.withColumn("known", F.transform(X.clauses(F.col("quote")), lambda c: X.normalise(c)))
    parts = [r.quote for r in C.unbundle(known, F.col("known")).where("source_id = 'k1' and line_no = 2").collect()]
    assert parts == ["The export must keep the last thirty days of invoices", "the archive must store every signed contract."]
    assert C.unbundle(known.withColumn("known", F.array().cast("array<string>")), F.col("known")).count() == s.count()
    swept = C.hedge_sweep(t, t.limit(0).select("source_id", F.col("text").alias("norm"))).collect()
    assert [(r.source_id, r.line_no, r.ts) for r in swept] == [("k1", 4, "not available")]
    assert C.hedge_sweep(t, t.select("source_id", X.normalise(F.col("text")).alias("norm"))).count() == 0


def test_common_letters():
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [row]  # the row before, and the one being made
            new = [0]
            for j, y in enumerate(b):
                new.append(row[1][j] + 1 if x == y else max(row[1][j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    for n in (1, 31, 32, 33, 64, 90):
        q, spans = word(n), [word(rng.randrange(0, 120)) for _ in range(40)]
        assert G.common_letters(q, spans).tolist() == [lcs(q, s) for s in spans]


def test_snap_equals_brute_force_on_noisy_quotes(spark):
    import random

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randrange(3, 9))) for _ in range(60)] + ["the", "the", "the", "of"]
    lines = [("k", i, None, None, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6, 16)))) for i in range(1, 60)]
    rows = []
    for i in range(60):
        words = rng.choice(lines)[4].split()
        noisy = [w[:p] + "ж" + w[p + 1 :] if rng.random() < i / 60 else w for w in words for p in [rng.randrange(len(w))]]
        rows.append((i, "k", " ".join(noisy) + " x"))
    t = spark.createDataFrame(lines, SCHEMA)
    spans = [(r.span, r.n, r.line_no, r.part, r.norm) for r in G.candidate_spans(t).withColumn("norm", X.normalise(F.col("span"))).collect()]
    norms = {r.k: r.q for r in quotes(spark, rows).select("k", X.normalise(F.col("quote")).alias("q")).collect()}
    want = {}
    for k, q in norms.items():
        score, n, line, part, span = min((-G.similarity(q, norm), -n, line, part, span) for span, n, line, part, norm in spans)
        if -score >= 0.66:
            want[k] = (span, round(-score, 9))
    got = {r.k: (r.span, round(r.score, 9)) for r in G.snap(quotes(spark, rows), "k", G.candidate_spans(t)).collect()}
    assert len(want) >= 50 and got == want


def test_snap_in_blocks_without_rows_of_words(spark, monkeypatch):
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randrange(3, 9))) for _ in range(50)]
    lines = [("k" if i % 8 else "m", i, None, None, ". ".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(2))) for i in range(1, 400)]
    lines += [("k", i + 1000, None, None, lines[i][4]) for i in range(0, 40)]
    rows = [(i, rng.choice("km"), " ".join(w for w in rng.choice(lines)[4].split() if rng.random() > i / 120)) for i in range(60)]
    t, q = spark.createDataFrame(lines, SCHEMA).cache(), quotes(spark, rows)
    spans = [(r.source_id, r.span, r.n, r.line_no, r.part, r.norm) for r in G.candidate_spans(t).withColumn("norm", X.normalise(F.col("span"))).collect()]
    want = {}
    for r in q.select("k", "source_id", X.normalise(F.col("quote")).alias("q")).collect():
        score, n, line, part, span = min((-G.similarity(r.q, norm), -n, line, part, span) for call, span, n, line, part, norm in spans if call == r.source_id)
        if -score >= 0.66:
            want[r.k] = (span, round(-score, 9), line)
    monkeypatch.setattr(G, "SPANS_A_BLOCK", 150)  # both calls are divided
    near = G.snap(q, "k", G.candidate_spans(t))
    # a row for each word of a span, with the span's text, filled the disk
    assert "split(norm" not in near._jdf.queryExecution().toString()
    got = {r.k: (r.span, round(r.score, 9), r.span_line) for r in near.collect()}
    assert 20 <= len(want) < 60 and got == want


def test_bounds_lose_nothing():
    import random

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeghilmnorstuéж") for _ in range(rng.randrange(2, 9))) for _ in range(70)] + ["the", "of", "aaaa"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    spans = list(dict.fromkeys([line(rng.randrange(1, 70)) for _ in range(700)] + ["", "a", "the the the the the the the"]))
    quotes = [" ".join(w for w in rng.choice(spans).split() if rng.random() > i / 80) for i in range(60)] + ["a", "ж"]
    quotes = [q for q in quotes if q]
    block = G.Spans(spans, list(range(len(spans))), quotes)
    for q in quotes:
        score = {i: G.similarity(q, block.norms[i]) for i in range(len(spans))}
        for t in (0.66, 0.8, 0.95):
            found = block.by_letters(q, t) | block.by_words(q, t)
            assert {i for i, x in score.items() if x >= t} <= set(found)
    # pairs of neighbours leave out most long spans before any subsequence is sought
    long = next(q for q in quotes if len(q) > 250)
    assert len(block.by_pairs(long, 0.95, 0, len(spans))) < 10


def test_lines_are_divided_as_spans_are(spark):
    texts = ["First  sentence here.\tTiny. \"Second ‘one’ there!\" Is it? ", "ΟΔΟΣ ends. ΑΣ. İstanbul’s gate.  opens", "a.\x02 b is here? No one. knows, .", "12345678", "1234567", "x. " * 9, "One. One. One is here.  One is here. "]
    t = spark.createDataFrame([("k", i, None, None, x) for i, x in enumerate(texts)], SCHEMA)
    want = {(r.line_no, r.part, r.span, r.norm) for r in G._spans(t, 8).withColumn("norm", X.normalise(F.col("span"))).collect()}
    lines = G._blocks_of_lines(t, "body").withColumn("low", F.when(F.octet_length("body") != F.length("body"), F.col("norm"))).where("length(body) >= 8").collect()
    assert {(r.line_no, i, *x) for r in lines for i, x in enumerate(G.quotable(r.body, r.low, 8))} == want
    assert {r.line_no: r.norm for r in G._blocks_of_lines(t).collect()} == {r.line_no: r.norm for r in t.withColumn("norm", X.folded(F.col("text"))).collect()}


def test_snap_shuffles_lines_not_spans(spark, monkeypatch):
    seen = []
    snap_lines = G.snap_lines
    monkeypatch.setattr(G, "snap_lines", lambda *a: seen.append(a[2]) or snap_lines(*a))
    G.snap_quotes(quotes(spark, [(1, "k1", "branch manager may approve refunds up to 200 dollars within 24 hours")]), turns(spark), "k")
    assert seen[0].count() == turns(spark).where("text is not null").dropDuplicates(["source_id", "line_no"]).count()
