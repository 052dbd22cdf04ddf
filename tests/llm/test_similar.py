import random

from factloom.llm import similar as S


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)]
    rows = [(i, rng.sample(vocabulary, rng.randint(1, 30))) for i in range(120)]
    for i in range(120, 220):
        base = list(rows[rng.randrange(120)][1])
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        rows.append((i, base))
    rows += [(300 + i, ["same", "words", "often", "here"]) for i in range(40)] + [(400, []), (401, None), (402, [])]
    df = spark.createDataFrame(rows, "key int, w array<string>")
    members, links = S.similar_sets(df.union(df.limit(5)), "key", "w", 0.68)
    got = {tuple(r) for r in S.expand_pairs(members, links).collect()}
    sets = [(i, set(w)) for i, w in rows if w]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(x & y) >= 0.68 * len(x | y) - 1e-9}
    assert got == want and len(want) > 50
    g = {r.id: r for r in S.groups(members, links).collect()}
    assert len({g[300 + i].group_id for i in range(40)}) == 1 and 400 not in g and all(g[a].group_id == g[b].group_id for a, b in want)
    for many in (2, 3):  # every number of shared prefix tokens gives the same links
        cost, S.KEY_COST = S.KEY_COST, {2: 0.001, 3: 0.0}[many]
        try:
            assert {tuple(r)[:2] for r in S.similar_sets(df, "key", "w", 0.68)[1].collect()} == {tuple(r)[:2] for r in links.collect()}
        finally:
            S.KEY_COST = cost


def test_empty(spark):
    members, links = S.similar_sets(spark.createDataFrame([], "i int, w array<string>"), "i", "w", 0.8)
    assert members.count() == 0 and links.count() == 0
