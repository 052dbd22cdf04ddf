import datetime

from pyspark.sql import functions as F

from factloom import cli, store
from factloom.operators import crossdoc as K
from factloom.operators import naming
from factloom.plans import ingest as I
from factloom.plans.ingest import ingest, views
from factloom.streaming import calls as stream
from tests.fixture import SCHEMA, TURNS

FACTS = store.schemas.FACTS


def fact(feature, ef, summary, quote=None, source="k1", by=None, project="p"):
    return (project, feature, ef, by, summary, quote or summary, "Nadia", "not available", source, datetime.date(2024, 1, 1))


def test_contradictions(spark):
    filler = [fact("Filler", i, f"filler{i} unique{i}") for i in range(1, 13)]
    pair = [fact("Refunds", 1, "Refund approval manager takes 24 hours"), fact("Counter", 1, "Refund approval manager takes 48 hours", source="k3")]
    rows = filler + pair + [fact("Scale", 1, "Refund approval manager one to five stars 3 hours"), fact("Old", 1, "Refund approval manager takes 9 hours", by=2)]
    got = [tuple(r) for r in K.contradictions(spark.createDataFrame(rows, FACTS)).collect()]
    assert [(r[1], r[3], r[5], r[6], r[7]) for r in got] == [("Counter", "Refunds", "hour", 48.0, 24.0)]
    assert K.contradictions(spark.createDataFrame(pair, FACTS)).count() == 0  # too few facts: every shared word is common
    assert K.contradictions(spark.createDataFrame([], FACTS)).count() == 0
    bounds = filler + [fact("A", 1, "Refund approval manager at least 4 hours"), fact("B", 1, "Refund approval manager below 3 hours")]
    assert K.contradictions(spark.createDataFrame(bounds, FACTS)).count() == 0


def test_resolve(spark):
    facts = spark.createDataFrame([fact("Refunds", 1, "Voucher refund window is sixty weeks", source="k3"), fact("Other", 1, "Voucher refund lane 30")], FACTS)
    q = spark.createDataFrame([(1, "p", "k1", "Which voucher refund window applies", ""), (2, "p", "k3", "Which voucher refund window applies", ""), (3, "p", "k9", "voucher refund 30 things", ""), (4, "p", "k1", "hm", "")], "k int, project string, source_id string, summary string, quote string")
    got = {r.k: (r.verdict, r.feature) for r in K.resolve_questions(q, "k", facts).collect()}
    assert got == {1: ("resolved", "Refunds"), 2: ("near", "Other"), 3: ("resolved", "Other")}


def test_targets_and_filters(spark):
    facts = spark.createDataFrame([fact("R", 1, "alpha beta gamma"), fact("R", 2, "alpha beta delta"), fact("R", 3, "alpha omega", by=9)], FACTS)
    s = spark.createDataFrame([(1, "p", "R", "beta alpha", ""), (2, "p", "R", "gamma", ""), (3, "p", "R", "omega", ""), (4, "p", "R", "alpha", ""), (5, "p", "R", "unchanged zzz", "")], "k int, project string, feature string, summary string, quote string")
    assert {r.k: r.ef_id for r in K.best_targets(s, "k", facts).collect()} == {1: 2, 2: 1}
    assert {r.k for r in K.shares_no_word(s, "k", facts).collect()} == {3}
    r = K.restated(s.withColumn("quote", F.lit("Alpha  beta gamma.")), facts)
    assert r.count() == 5 and K.restated(s, facts).count() == 0


def test_merge(spark):
    facts = spark.createDataFrame([fact("A", 1, "one", by=2), fact("A", 2, "two"), fact("a!", 1, "three"), fact("C", 7, "four")], FACTS)
    groups = spark.createDataFrame([("p", "A", "A", 0), ("p", "a!", "A", 1)], "project string, feature string, target string, member_no int")
    got = {(r.feature, r.ef_id, r.superseded_by, r.summary) for r in K.merge_areas(facts, groups).collect()}
    assert got == {("A", 1, 2, "one"), ("A", 2, None, "two"), ("A", 3, None, "three"), ("C", 7, None, "four")}
    assert K.mergeable(facts, groups).count() == 0 and K.mergeable(facts, groups, explicit=True).count() == 2  # no shared word


def test_stories(spark):
    facts = spark.createDataFrame([fact("A", i, s) for i, s in enumerate(["Implement the export.", "The CSV stays; always", "SSO works"] + [f"Rule {i}" for i in range(7)])], FACTS)
    story = K.story(facts).first().story
    assert story.startswith("The export; the CSV stays, always; SSO works; rule 0") and story.endswith("; plus 2 more (see Established Facts).")
    one = facts.where("ef_id < 3")
    check = lambda s: K.story_problem(spark.createDataFrame([("p", "A", s)], "project string, feature string, story string"), one).first().problem
    assert check("As a user I want the export, the CSV and SSO works") is None
    assert check("The export, CSV and SSO works in 5 days") == "invented number"
    assert check("The export, CSV and SSO works by Whatsapp") == "invented proper noun: whatsapp"
    assert check("The export only").startswith("leaves")
    df = spark.createDataFrame([('"Story: As a learner, I want x"', "the customer exports")], "s string, f string")
    assert df.select(K.constrain_role(K.clean_story(F.col("s")), F.col("f"))).first()[0] == "As a user, I want x"
    assert K.plain_story(one).first().story == "Implement the export; The CSV stays; always; SSO works."


def test_gaps(spark):
    facts = spark.createDataFrame([fact("A", 1, "Reviews take one to five stars"), fact("A", 2, "Export runs nightly")], FACTS)
    rows = [("What is the maximum stars review rating?", [1]), ("What are the details?", [2]), ("Who restarts a failed export?", [2]), ("Who restarts a failed export?", [1, 2]), ("Which penguin swims?", [2]), ("Who sees the export first?", [9]), ("Does the export email auditors?", [2])]
    g = spark.createDataFrame([("p", "A", i, q, r) for i, (q, r) in enumerate(rows)], "project string, feature string, gap_no int, question string, refs array<int>")
    items = spark.createDataFrame([("p", "A", "email auditors about the export")], "project string, feature string, text string")
    assert [(r.question, r.refs) for r in K.filter_gaps(g, facts, items).collect()] == [("Who restarts a failed export?", [2])]


def test_score_and_top(spark):
    turns = spark.createDataFrame(TURNS, SCHEMA)
    facts = spark.createDataFrame([fact("A", 1, "Short one", "must keep the last thirty days"), fact("A", 2, "A longer summary text", "penguins swim very fast", by=1)], FACTS)
    s = K.grounding_score(facts, turns).first()
    assert (s.n_facts, s.n_superseded, s.n_quotes, s.n_grounded, s.n_fragments, s.passed) == (2, 1, 2, 1, 1, False)
    stamped = facts.withColumn("ts", F.lit("00:00:01"))
    assert K.invented_stamps(stamped, turns.select("source_id")).count() == 2 and K.invented_stamps(facts, turns.select("source_id")).count() == 0
    q = spark.createDataFrame([(1, "refund manager"), (2, "")], "q int, t string")
    got = K.top_documents(q, "q", "t", turns.withColumn("d", F.concat_ws("#", "source_id", "line_no")), "d", "text").orderBy("rank").collect()
    assert [(r.q, r.d, r.overlap) for r in got] == [(1, "k1#3", 2), (1, "k2#1", 2), (1, "k3#2", 2)]


def test_model_calls(spark):
    def chat(system, prompt):
        known = prompt.split("\n")[0]
        return f"<think>x</think>## STATEMENT\nFeature: A{len(known)}\nSummary: s\nQuote: q\nSpeaker: x\nTimestamp: t\n\n## STATEMENT\nFeature: B"

    chunks = spark.createDataFrame([("k", 2, "y" * 500), ("k", 1, "x" * 500), ("z", 1, "short")], "source_id string, part_no int, text string")
    calls = I.call_model(chunks, chat, "system").cache()
    assert calls.count() == 3 and "Known areas: none" in calls.where("part_no = 1").first().prompt and "A17" in calls.where("part_no = 2").first().prompt
    s = I.statements_from_replies(calls).orderBy("source_id", "seq").collect()
    assert [(r.source_id, r.seq, r.kind, r.quote) for r in s] == [("k", 1000, "fact", "q"), ("k", 2000, "fact", "q"), ("z", 1000, "fact", "q")]
    assert I.needs_coverage(chunks, False).count() == 2 and I.needs_coverage(chunks, True).count() == 0


def test_ingest_cli_stream(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, SCHEMA)
    calls = spark.createDataFrame([(k, "p", datetime.date(2024, 1, n)) for n, k in enumerate(("k1", "k2", "k3", "k0"), 1)], "source_id string, project string, call_date date")
    root = str(tmp_path / "store")
    events = ingest(spark, turns, calls, root)
    assert not {r.source_id for r in events.where("adds_fact").collect()} & {"k0"}
    v = views(spark, root)
    n = v["facts"].count()
    assert n > 3 and v["active"].count() <= n and v["change_log"].count() > 0
    assert K.grounding_score(v["facts"], turns).first().passed  # no citation, no fact
    again = ingest(spark, turns, calls, root)
    assert store.load(spark, root, "facts").count() == n  # again: nothing new
    assert again.where("event_type = 'question'").count() == 0 and v["resolved"].count() >= 0 and v["contradictions"].count() >= 0
    # a second run changes nothing, not even the state's number
    assert again.count() == 0 and store._manifests(spark, root) == [1]
    log = store.load(spark, root, "events").collect()
    assert len({(r.project, r.seq) for r in log}) == len(log)
    # what was found after the calls: answers with their back-link, contradictions in both areas
    kinds = [r.event_type for r in log]
    assert kinds.count("resolved") == kinds.count("answers") and kinds.count("contradiction") % 2 == 0
    answered = {(r.feature, r.quote) for r in log if r.event_type == "resolved"}
    assert {(r.feature, r.quote) for r in v["open_items"].where("tag = 'RESOLVED'").collect()} == answered
    # a failure before the manifest is in place leaves the state as it was
    from unittest import mock

    with mock.patch.object(store, "_put", side_effect=OSError("gone")):
        try:
            store.save(spark, root, {"facts": store.load(spark, root, "facts").limit(0)})
        except OSError:
            pass
    assert store.load(spark, root, "facts").count() == n
    assert cli.features(spark, root).count() > 0 and cli.ask(spark, root, "refund manager").count() > 0
    names = [r.feature for r in cli.features(spark, root).collect()]
    assert cli.show(spark, root, names[0][:4].lower()).count() > 0
    assert cli.merge(spark, root, "p", names[:2]) == names[:2] and cli.merge(spark, root, "p", ["zzz"]) == []
    assert store.load(spark, root, "facts").count() == n
    moved = store.load(spark, root, "events")
    assert moved.count() <= len(log) and moved.where(F.col("feature") == names[1]).count() == 0  # questions and log moved along
    have = {(r.feature, r.ef_id) for r in store.load(spark, root, "facts").collect()}
    assert {(r.feature, r.ef_id) for r in moved.where("adds_fact").collect()} <= have
    cli.export(spark, root, str(tmp_path / "docs"))
    assert store.parse_facts(store.read_documents(spark, str(tmp_path / "docs"))).count() > 0

    lines = turns.withColumn("received_at", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    lines.union(lines.limit(3)).write.parquet(str(tmp_path / "lines"))
    query = stream.run(spark, str(tmp_path / "lines"), calls, str(tmp_path / "store2"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert store.load(spark, str(tmp_path / "store2"), "facts").count() == n


def test_routing_keeps_to_the_project(spark):
    names = spark.createDataFrame([("p", "Refund Windows"), ("q", "Refund Windows")], "project string, feature string")
    known = spark.createDataFrame([("p", "Refund Window")], "project string, feature string").withColumn("o", F.col("feature"))
    got = {(r.project, r.routed) for r in naming.route_names(names, "feature", known, "feature", "o", scope="project").collect()}
    assert got == {("p", "Refund Window"), ("q", "Refund Windows")}


def test_areas_by_callback(spark):
    s = spark.createDataFrame([("a", "p", 1, "fact", "x", "Refund approval limits", "refunds up to 20 dollars"), ("b", "p", 2, "fact", "Exams", "Final exams are timed", "exams last an hour"), ("c", "p", 3, "fact", "", "Final exams have retakes", "retake the exam"), ("d", "p", 4, "question", "Talk", "who decides on penguins", "who decides")], "key string, project string, seq bigint, kind string, feature string, summary string, quote string")
    facts = spark.createDataFrame([("p", "Invoice Export", 1, None, "s", "q", None, None, "k", None)], FACTS)
    areas = lambda df: spark.createDataFrame([("a", "Invoice Export"), ("b", "Final Exams"), ("c", "Exams")], "key string, area string")
    got = {r.key: r.feature for r in I.assign_areas(s, facts, areas).collect()}
    assert got["a"] != "Invoice Export" and got["b"] == got["c"] == "Final Exams" and got["d"] == ""


def test_gaps_of_a_lifetime(spark):
    facts = spark.createDataFrame([("p", "Refunds", 1, None, "Managers approve refunds", "managers approve refunds", None, None, "k", None)], FACTS)
    gaps = spark.createDataFrame([("p", "Refunds", i, q, [1]) for i, q in enumerate(("Which managers approve refunds abroad?", "Do managers approve refunds on holidays?", "May managers approve refunds by telephone?"), 1)], "project string, feature string, gap_no int, question string, refs array<int>")
    none = spark.createDataFrame([], "project string, feature string, text string")
    used = spark.createDataFrame([("p", "Refunds", 1)], "project string, feature string, n_gaps bigint")
    assert K.filter_gaps(gaps, facts, none).count() == 2 and K.filter_gaps(gaps, facts, none, used=used).count() == 1
