"""Problem 1: near-duplicate records, by adaptive multi-match prefixes.

Tokens are ordered from rare to frequent over all records. A record x with n tokens probes with its
prefix of n - ceil(t n) + L tokens; a record y of m <= n tokens is indexed with its prefix of
m - ceil(2t/(1+t) m) + L tokens. Two records of similarity t or more share at least L tokens of these
prefixes, for every L up to the needed overlap. Each record chooses its own L: it lengthens its prefix,
and so requires one more shared prefix token, as long as that lowers its estimated cost (keys sent plus
candidates expected from the counts of its prefix tokens). "L shared tokens" is an equality join on
L-subsets of the prefixes, so no list of a single frequent token is ever scanned. The index side is priced
too: per length class (steps of 1.1), an L is open only if it saves more than its index keys cost, and only
records that a probe of such a class can reach are indexed for it.

Candidates pass a length test and a parity-bitmap bound (both exact upper bounds of the overlap) inside
the join; the remaining pairs are verified on the token sets.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.lookalike import consistent
from factloom.operators.graph import connected_components
from factloom.runtime import broadcast_if_small, checkpoint

MOST_SHARED = 3
"""Longest choice of shared tokens. The result is the same for any value; it bounds the search for the cheapest one."""
KEY_COST = 40.0
"""What building, sending and sorting one key costs, in candidates tested in the join (measured: 2 microseconds to 50 nanoseconds)."""
MOST_BROADCAST = 300_000
"""Rows of 16 bytes of the table of token counts up to which it is sent to every executor."""
LENGTH_STEP = 1.1
"""Ratio of successive length classes."""


def words(col: Column) -> Column:
    """Runs of letters or digits, lower case, in the consistent form; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(consistent(col), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _at_least(share: float, n: Column) -> Column:
    """ceil(share * n), safe against rounding just above a whole number."""
    return F.ceil(F.lit(share) * n - F.lit(1e-9)).cast("int")


def _subsets(items: Column, size: int) -> Column:
    """Hashes of all subsets of ``size`` elements of an ordered array."""

    def below(rest: Column, chosen: list[Column]) -> Column:
        if len(chosen) == size - 1:
            return F.transform(rest, lambda a: F.xxhash64(F.lit(size), *chosen, a))
        after = lambda i: F.slice(rest, i + 2, F.greatest(F.size(rest) - i - 1, F.lit(0)))
        return F.flatten(F.transform(rest, lambda a, i: below(after(i), [*chosen, a])))

    return below(items, [])


def _choose(n: Column, k: int) -> Column:
    """Number of subsets of ``k`` of ``n`` elements."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * F.greatest(n - i, F.lit(0)) / (i + 1)
    return out


def _met(share: Column, size: int, total: float) -> Column:
    """Records expected to hold ``size`` of the tokens with these shares, were tokens independent: elementary symmetric sums by Newton's identities."""
    raised = lambda x, k: x if k == 1 else x * raised(x, k - 1)
    summed = lambda k: F.aggregate(share, F.lit(0.0), lambda a, x: a + raised(x, k))
    power = [None] + [summed(k) for k in range(1, size + 1)]
    e = [F.lit(1.0)]
    for k in range(1, size + 1):
        e.append(sum(((-1) ** (i - 1) * e[k - i] * power[i] for i in range(1, k + 1)), F.lit(0.0)) / k)
    return F.greatest(e[size], F.lit(0.0)) * total


def _opened(docs: DataFrame) -> dict[int, tuple[int, ...]]:
    """Length class -> numbers of shared tokens its records may choose from.

    Every set of numbers is priced over all records of the class: the cheapest choice of each as a probe, and the
    index keys of all for each number in the set. A number is open only where it saves more than its index keys cost.
    """
    sizes = range(1, MOST_SHARED + 1)
    sets = [c for r in sizes for c in itertools.combinations(sizes, r)]
    price = lambda c: F.sum(F.least(*[F.col(f"probe{k}") for k in c], F.lit(float("inf"))) + sum((F.col(f"index{k}") for k in c), F.lit(0.0)))
    rows = docs.groupBy("class").agg(*[price(c).alias("s" + "".join(map(str, c))) for c in sets]).collect()  # one row per length class
    return {r["class"]: min(sets, key=lambda c: (r["s" + "".join(map(str, c))], c)) for r in rows}


def similar_sets(df: DataFrame, id_col: str, tokens: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records with an array of tokens, complete for every pair of Jaccard >= ``threshold``.

    members(id, rep): every record with at least one token, and the smallest id of those with the same set.
    links(rep_a, rep_b, overlap, jaccard): pairs of different sets, rep_a < rep_b. Copies of one set, however
    many, take part once. Records without tokens (null or empty) match nothing. Ids must be unique;
    a repeated (id, tokens) row counts once.
    """
    t = threshold
    flat = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.coalesce(F.col(tokens), F.array().cast("array<string>")))).alias("toks")).where(F.size("toks") > 0)
    flat = checkpoint(flat.withColumn("key", F.md5(F.array_join("toks", "\x1f").cast("binary"))))
    reps = flat.groupBy("key").agg(F.min("id").alias("rep"))
    members = flat.join(reps.hint("merge"), "key").select("id", "rep").distinct()
    sets = flat.groupBy("key").agg(F.min("id").alias("id"), F.first("toks").alias("toks"))
    total = float(max(1, reps.count()))
    ranked = sets.select("key", "id", F.explode(F.transform("toks", lambda x: F.xxhash64(x))).alias("h"))
    freq = checkpoint(ranked.groupBy("h").agg(F.count("*").alias("df")))
    # a small vocabulary goes to the tokens where they are, and nothing more is shuffled; a large one is joined by shuffle
    counted = ranked.join(broadcast_if_small(freq, MOST_BROADCAST), "h").groupBy("key")
    docs = counted.agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))
    one = F.lit(1).cast("long")

    def parity(half: int) -> Column:
        """64 bits; each token of this half of the hash space toggles one. Two sets differ in at least as many tokens as bits."""
        mine = F.filter("h", lambda x: F.shiftrightunsigned(x, 40).bitwiseAND(one) == half)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", one, F.shiftrightunsigned(x, 8).bitwiseAND(F.lit(63)).cast("int"))))

    docs = docs.select("id", F.col("o.h").alias("h"), F.transform("o.df", lambda x: x / F.lit(total)).alias("f"), F.size("o").alias("n"))
    docs = docs.withColumns({"need": _at_least(t, F.col("n")), "need_y": _at_least(2 * t / (1 + t), F.col("n")), "b1": parity(0), "b2": parity(1)})

    docs = docs.withColumn("class", F.floor(F.log(F.col("n")) / math.log(LENGTH_STEP)).cast("int"))
    for k in range(1, MOST_SHARED + 1):
        spare, spare_y = F.col("n") - F.col("need") + k, F.greatest(F.col("n") - F.col("need_y") + k, F.lit(0))
        probe = _choose(spare, k) * KEY_COST + _met(F.slice("f", 1, spare), k, total)
        docs = docs.withColumns({f"probe{k}": F.when(F.col("need") >= k, probe).otherwise(F.lit(float("inf"))), f"index{k}": _choose(spare_y, k) * KEY_COST})
    docs = checkpoint(docs)
    opened = _opened(docs)
    pick = F.lit(None).cast("int")
    for cls, sizes in sorted(opened.items()):
        best = F.least(*[F.col(f"probe{k}") for k in sizes], F.lit(float("inf")))
        pick = F.when(F.col("class") == cls, F.coalesce(*[F.when(F.col(f"probe{k}") <= best, k) for k in sizes])).otherwise(pick)
    docs = docs.withColumn("shared", pick)

    def keyed(size: int, length: Column, df: DataFrame, p: str) -> DataFrame:
        return df.select(
            F.explode(_subsets(F.slice("h", 1, F.greatest(length, F.lit(0))), size)).alias("key"), *[F.col(c).alias(p + c) for c in ("id", "n", "b1", "b2")],
        )

    candidates = None
    reach = math.ceil(-math.log(t) / math.log(LENGTH_STEP)) + 1  # a larger set is at most so many classes up
    for size in sorted({k for sizes in opened.values() for k in sizes}):
        # x is the larger set, so the overlap is at least ceil(t n_x) and, as n_x >= n_y, at least ceil(2t/(1+t) n_y)
        up = [cls for cls, sizes in opened.items() if size in sizes]
        probe = keyed(size, F.col("n") - F.col("need") + size, docs.where(F.col("shared") == size), "x_")
        index = keyed(size, F.col("n") - F.col("need_y") + size, docs.where(F.col("class").isin(sorted({c for u in up for c in range(u - reach, u + 1)}))), "y_")
        x, y = F.col("x_n"), F.col("y_n")
        over = _at_least(t / (1 + t), x + y)
        differ = F.bit_count(F.col("x_b1").bitwiseXOR(F.col("y_b1"))) + F.bit_count(F.col("x_b2").bitwiseXOR(F.col("y_b2")))
        hit = probe.hint("merge").join(index, "key").where(
            ((y < x) | ((y == x) & (F.col("y_id") < F.col("x_id")))) & (y >= F.lit(t) * x - 1e-9) & (differ <= x + y - 2 * over)
        )
        hit = hit.select("x_id", "y_id")
        candidates = hit if candidates is None else candidates.union(hit)
    if candidates is None:
        candidates = docs.select(F.col("id").alias("x_id"), F.col("id").alias("y_id")).limit(0)
    a = docs.select(F.col("id").alias("x_id"), F.col("h").alias("x_h"))
    b = docs.select(F.col("id").alias("y_id"), F.col("h").alias("y_h"))
    pairs = candidates.distinct().join(a.hint("merge"), "x_id").join(b.hint("merge"), "y_id").withColumn("overlap", F.size(F.array_intersect("x_h", "y_h")))
    pairs = pairs.withColumn("either", F.size("x_h") + F.size("y_h") - F.col("overlap")).where(F.col("overlap") >= F.lit(t) * F.col("either") - 1e-9)
    links = pairs.select(F.least("x_id", "y_id").alias("rep_a"), F.greatest("x_id", "y_id").alias("rep_b"), F.col("overlap").cast("int"), (F.col("overlap") / F.col("either")).alias("jaccard"))
    return members, links


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records, those with equal sets too. Grows with the square of a group of copies."""
    one = members.select(F.col("id").alias("i"), F.col("rep").alias("rep_a"))
    two = members.select(F.col("id").alias("j"), F.col("rep").alias("rep_b"))
    across = links.select("rep_a", "rep_b").join(one.hint("merge"), "rep_a").join(two.hint("merge"), "rep_b").select("i", "j")
    same = one.join(two.hint("merge"), F.col("rep_a") == F.col("rep_b")).where("i < j").select("i", "j")
    return across.union(same).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, rep, group_id, n_links): one row per record; n_links counts its class's links to other classes."""
    links = checkpoint(links)
    comp = connected_components(links, "rep_a", "rep_b").select(F.col("node").alias("rep"), F.col("component").alias("group_id"))
    degree = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    info = comp.join(degree.hint("merge"), "rep", "left")
    return members.join(info.hint("merge"), "rep", "left").select("id", "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
