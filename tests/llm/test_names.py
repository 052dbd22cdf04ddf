import random

from factloom.llm import spellings as P
from factloom.llm import speaker_turns as T
from factloom.llm.names import bare


def test_bare():
    assert [bare(x) for x in ("**Nadia Brook:**", "Brook, Nadia", "Dr. Nadia Brook (client)", "<v Nadia Brook>", "MR", "Quill Ltd, Inc")] == ["Nadia Brook", "Nadia Brook", "Nadia Brook", "Nadia Brook", "MR", "Quill Ltd, Inc"]


def test_similarity():
    same = [("bob lark", "robert lark"), ("p brig", "peter brig"), ("stephanei ulvoav", "stephanie ulvova"), ("barbara m vint", "barbara vint"), ("quenby phar ltd", "quenby pharmacies ltd"), ("quenby textiles", "quenby textiles inc"), ("zarn anni", "anneliese zarn")]
    other = [("priyanka pell", "josephine pell"), ("quenby textiles ltd", "quenby textiles inc"), ("h ostashby", "josephine ostashby"), ("amber textiles", "amber furniture"), ("henrietta thornestra", "henrietta thornstrum"), ("barbara m vint", "barbara k vint")]
    assert [(a, b) for a, b in same if P.monge_elkan(a, b) < P.ACCEPT] == [] and [(a, b) for a, b in other if P.monge_elkan(a, b) >= P.ACCEPT] == []


def test_bands():
    b = P.bands_for(0.3, 2, 0.99)
    assert 1 - (1 - 0.3**2) ** b >= 0.99 > 1 - (1 - 0.3**2) ** (b - 1)


def test_links(spark):
    rows = [("p", x) for x in ("Robert Larkmarek", "Bob Larkmarek", "R. Larkmarek", "Larkmarek, Robert", "ROBERT LARKMAREK", "Robrt Larkmarek", "Priyanka Pellashby", "Joséphine Pellashby", "Josephine  Pellashby", "Unknown", "???", "", None, "Quenby Textiles Inc", "the Quenby-Textiles Inc.", "Quenby Textiles")]
    rows += [("q", "Robert Larkmarek"), (None, "Bob Larkmarek")] + rows[:3]
    got = {tuple(r) for r in P.same_entity_pairs(P.link_spellings(spark.createDataFrame(rows, "project string, speaker string"), "project", "speaker"), "project", "speaker").collect()}
    groups = [rows[i][1] for i in range(6)], ["Joséphine Pellashby", "Josephine  Pellashby"], ["Quenby Textiles Inc", "the Quenby-Textiles Inc.", "Quenby Textiles"]
    assert got == {("p", a, b) for g in groups for a in g for b in g if a < b}
    assert P.link_spellings(spark.createDataFrame([], "project string, speaker string"), "project", "speaker").count() == 0


def test_stars(spark):
    v = spark.createDataFrame([(x, r) for x, r in (("a", 9), ("b", 5), ("c", 8), ("d", 1), ("e", 2))], "v string, rank int")
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.95), ("c", "d", 0.9)], "a string, b string, sim double")
    assert {r.v: r.centre for r in P.star_clusters(v, e).collect()} == {"a": "a", "c": "c", "b": "c", "d": "c", "e": "e"}


def test_line_parser():
    p = lambda *a: T.parse_line(*a, True)
    assert p("00:00:03.960", "Nadia", "Um, the, uh... export [music] stays (see no. 9)") == (3, "Nadia", False, False, "The, export stays (see no. 9)", None)
    assert p(None, None, "[00:01:05] Nadia Brook: Hello.")[:4] == (65, "Nadia Brook", True, False)
    assert p(None, None, "Small change: the rule.")[1:3] == ("Small change", True)
    assert [T.seconds(x) for x in ("9:33", "100.6s", "00:00:39.672 --> 00:00:45.672", "[00:06:51]", "00:05:35,463", "not available", None, "12")] == [573, 100, 39, 411, 335, -1, -1, -1]
    assert [T.is_noise(x) for x in ("Um.", "[laughter]", "*clears throat* uh", "♪ ♪", "Yes.", "Okay, um", "((background chatter))", "")] == [True] * 4 + [False, False, True, True]


TURNS = [
    ("k", 1, "00:00:01", "Nadia Brook", "Hello."), ("k", 2, None, None, "More."), ("k", 3, None, "[music]", None), ("k", 4, None, "SPEAKER_02", "[laughter]"), ("k", 5, "0:09", None, "After the laugh."), ("k", 6, None, None, "Nadai Brook: And I."),
    ("k", 7, None, "NB", "Still me."), ("k", 8, None, "???", "Who?"), ("k", 9, "12.9s", "Lind, Omar", "Me."), ("k", 9, "12.9s", "Lind, Omar", "Me."), ("z", 1, None, None, "Alone."), ("k", None, None, None, "x"),
]
SCHEMA = "source_id string, line_no int, ts string, speaker string, text string"


def test_turns(spark, monkeypatch):
    people = spark.createDataFrame([("k", 1, "Nadia Brook"), ("k", 2, "Omar Lind"), ("k", 3, None)], "source_id string, attendee_no int, full_name string")
    df = spark.createDataFrame(TURNS, SCHEMA)
    want = {("k", 1, 2, 1, 1), ("k", 5, 5, 2, 9), ("k", 6, 7, 1, -1), ("k", 8, 8, 0, -1), ("k", 9, 9, 2, 12), ("z", 1, 1, 0, -1)}
    for lines in (5000, 2):  # runs go on over the ends of blocks
        monkeypatch.setattr(T, "BLOCK_LINES", lines)
        got = T.speaker_turns(df, people)
        assert {tuple(r)[:5] for r in got.select("source_id", "first_line", "last_line", "attendee_no", "start_sec").collect()} == want
    assert {r.first_line: r.text for r in got.where("source_id = 'k'").collect()}[6] == "And I. Still me."
    assert T.speaker_turns(df.limit(0), people).count() == 0


def test_candidate_recall(spark):
    """Of generated variants as similar as the curve is tuned for, nearly all must become candidates, at every number of rows a band."""
    rng = random.Random(4)
    given, family = ["katherine", "william", "robert", "magdalena", "theodore", "joanna", "peter", "susan"], ["brookfield", "lindqvist", "okafor", "castellanos", "huang", "petrenko", "ashworth", "delacroix"]
    grams = lambda n: {w[i : i + 2] for w in (f"^{x}$" for x in n.split()) for i in range(len(w) - 1)}
    names, pairs = set(), []
    for _ in range(300):
        a = f"{rng.choice(given)} {rng.choice(family)}{rng.randrange(90)}"
        g, f = a.split()
        k = rng.randrange(len(f))
        b = rng.choice([f"{g[0]} {f}", f"{f} {g}", f"{g} {f[:k] + f[k + 1:]}", f"{g[:3]} {f}", f"{g} {rng.choice('abc')} {f}"])
        names |= {a, b}
        if a != b and len(grams(a) & grams(b)) >= P.LOWEST_SIMILARITY * len(grams(a) | grams(b)):
            pairs.append(tuple(sorted((a, b))))
    df = spark.createDataFrame([("p", n) for n in names], "scope string, name string")
    for rows in (2, 3):
        got = {(r.a, r.b) for r in P.candidates(df, rows, P.bands_for(P.LOWEST_SIMILARITY, rows, P.RECALL)).collect()}
        assert len(pairs) > 200 and sum(p in got for p in pairs) >= 0.97 * len(pairs)
    assert P.rows_for(10) == 2 and P.rows_for(50_000) > 2
