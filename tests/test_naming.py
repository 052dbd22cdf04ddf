import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.operators import naming as N
from factloom.operators.graph import connected_components


def names(spark, values, col="n"):
    return spark.createDataFrame([(v,) for v in values], f"{col} string")


def test_route(spark):
    known = spark.createDataFrame([("Leave Balance", 1), ("Notification Preferences", 2), ("Preferences Panel", 3)], "k string, o int")
    got = {r.n: r.routed for r in N.route_names(names(spark, ["Leave Approval", "Switching Notification Method", "leave balances", "the app", "Preferences", None]), "n", known, "k", "o").collect()}
    assert got == {"Leave Approval": "Leave Approval", "Switching Notification Method": "Notification Preferences", "leave balances": "Leave Balance", "the app": "the app", "Preferences": "Notification Preferences"}
    assert N.route_names(names(spark, ["x y"]), "n", known.limit(0), "k", "o").first().routed == "x y"


def test_canonical(spark):
    rows = [("b", x) for x in ("Certificate Content", "Certificate Format", "Ticket Routing", "Ticket Aging", "Ticket Export", "Ticket Export Format")]
    got = {r.n: r.canonical for r in N.canonical_names(spark.createDataFrame(rows * 2, "s string, n string"), "s", "n").collect()}
    assert got["Certificate Content"] == got["Certificate Format"] == got["Ticket Export Format"] == got["Ticket Export"]
    assert got["Ticket Routing"] == "Ticket Routing" and got["Ticket Aging"] == "Ticket Aging"


def test_cohesion(spark):
    rows = [("Misc", i, s) for i, s in enumerate(["Ticket export nightly", "Ticket export weekly", "Ticket refund window", "Ticket refund limits"])]
    rows += [("Billing", 10 + i, s) for i, s in enumerate(["Invoice export nightly", "Invoice export weekly", "Invoice refund window", "Invoice refund limits"])]
    rows += [("Tiny", 20, "One thing"), ("Tiny", 21, "Another thing")]
    got = N.cohesion_split(spark.createDataFrame(rows, "area string, row int, summary string"), "area", "row", "summary").collect()
    assert {r.area for r in got} == {"Misc"}
    by = {r.row: r.new_area for r in got}
    assert by[0] == by[1] != by[2] == by[3] and "Export" in by[0] and "Refund" in by[2]


def test_rehome_and_rest(spark):
    facts = spark.createDataFrame([("p", "Refunds", "refund window sixty days", "refund window"), ("p", "Refunds", "refund limit", "limit"), ("p", "Exports", "export invoices nightly", "export")], "project string, feature string, summary string, quote string")
    q = spark.createDataFrame([(1, "p", "which refund window applies", ""), (2, "p", "unrelated words", ""), (3, "z", "refund window", "")], "k int, project string, summary string, quote string")
    assert {r.k: (r.host, r.overlap) for r in N.rehome(q, "k", facts).collect()} == {1: ("Refunds", 2), 2: ("Refunds", 0)}
    df = spark.createDataFrame([("Delivery Radius", "the radius is ten"), ("Exports", "refund rule"), ("Misc", None)], "a string, t string")
    assert [bool(r[0]) for r in df.select(N.misrouted(df, "a", "t")).collect()] == [False, True, True]
    assert N.consolidate(["Export Archive", "Archive Exports", "The", "Refund Window"]) == {"Export Archive": "Export Archive", "Archive Exports": "Export Archive", "The": "The", "Refund Window": "Refund Window"}


def test_ambient(spark):
    df = spark.createDataFrame([("p", i, ["a", "b"] if i < 3 else ["a"]) for i in range(5)], "g string, r int, w array<string>")
    assert {(r.word, r.n_rows, r.group_rows) for r in N.document_frequency(df, ["g"], "r", "w").collect()} == {("a", 5, 5), ("b", 3, 5)}
    assert {r.word for r in N.ambient_words(df, ["g"], "r", "w", 0.6).collect()} == {"a"}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
def test_components(spark, edges):
    label = {n: n for n in itertools.chain(*edges)}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == label


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(200)] + [(None, 3), (500, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src int, dst int")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[200 + i] for i in range(200)} == {100} and got[500] == 500
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0
