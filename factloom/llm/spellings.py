"""Problem 3: spellings of one person or organisation, linked.

Names are brought to their words (titles, remarks, markup and articles off, "Family, Given" turned round).
Candidates come from MinHash banding over padded q-grams of the words, so the order of parts doesn't
matter; bands are tuned from the collision curve 1 - (1 - s^r)^b to reach a stated recall at the lowest
similarity that true variants have, and a scope with many names takes more rows a band (and so more bands at
the same recall), which keeps unrelated names apart. Candidates are verified by Monge-Elkan similarity, whose inner
measure knows typing errors, initials, shortened words and short forms of given names. The links are
clustered by star clustering: the most complete and best linked spelling becomes a centre, its neighbours
its satellites, round by round; links between two satellites never join two stars.
"""

from __future__ import annotations

import functools
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.lookalike import transducer
from factloom.llm.names import LEGAL_FORMS, UNKNOWN_VOICE, bare, fold, same_given
from factloom.llm.speaker_turns import _edits
from factloom.runtime import checkpoint

LOWEST_SIMILARITY = 0.3
RECALL = 0.99
MOST_ROWS = 4
USUAL_SIMILARITY = 0.1
"""Of unrelated names, to price candidates; it changes no result but the cost."""
ACCEPT = 0.8
# Spellings of legal forms.
SAME_FORM = {"limited": "ltd", "co": "company", "incorporated": "inc", "corp": "corporation", "gmbh": "gmbh"}


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The number of bands at which two sets of this similarity collide with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def rows_for(names: int) -> int:
    """Rows a band that are cheapest for a scope of so many names: MinHash values to compute, and unrelated pairs to verify."""
    def cost(rows: int) -> float:
        bands = bands_for(LOWEST_SIMILARITY, rows, RECALL)
        return names * bands * rows + names**2 / 2 * (1 - (1 - USUAL_SIMILARITY**rows) ** bands) * 3

    return min(range(2, MOST_ROWS + 1), key=cost)


@functools.lru_cache(maxsize=100_000)
def canonical_words(raw: str | None) -> str | None:
    """Folded words of a typed name, single-spaced; None for unknown voices and names without letters."""
    if raw is None:
        return None
    name = bare(transducer().form(raw))
    if not name or UNKNOWN_VOICE.match(name) or name == "???":
        return None
    words = [w for w in re.findall(r"[^\W_]+", re.sub(r"(?<=\b[A-Za-z])\.(?=[A-Za-z]\b)", "", fold(name)).replace("g.m.b.h", "gmbh"))]
    if words and words[0] == "the":
        words.pop(0)
    return " ".join(words) if any(w.isalpha() for w in words) else None


def _parts(name: str) -> tuple[list[str], str | None]:
    words = name.split()
    legal = None
    if len(words) > 1 and words[-1] in LEGAL_FORMS:
        legal = SAME_FORM.get(words[-1], words[-1])
        words = words[:-1]
    return words, legal


@functools.lru_cache(maxsize=1_000_000)
def word_similarity(a: str, b: str) -> float:
    """Words meet again and again in other pairs of names; the cache is bounded and changes no result."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.9 if a[0] == b[0] else 0.0
    if same_given(a, b):
        return 0.96
    short, long = sorted((a, b), key=len)
    if 3 <= len(short) <= 5 and len(long) - len(short) >= 3 and long.startswith(short):
        return 0.9
    most = 1 if len(long) < 9 else 2
    if len(long) - len(short) > most:
        return 0.0
    d = _edits(a, b)
    return 1 - d / len(long) if d <= most and len(long) >= 3 else 0.0


@functools.lru_cache(maxsize=200_000)
def monge_elkan(a: str, b: str) -> float:
    """Mean of the two directions of Monge-Elkan over the words; middle initials count little."""
    x, fx = _parts(a)
    y, fy = _parts(b)
    if not x or not y or fx and fy and fx != fy:
        return 0.0

    def middle(words: list[str]) -> list[float]:
        full = sum(len(w) > 1 for w in words)
        return [0.1 if len(w) == 1 and full >= 2 else 1.0 for w in words]

    def one(u: list[str], v: list[str]) -> float:
        weights = middle(u)
        return sum(k * max(word_similarity(w, t) for t in v) for w, k in zip(u, weights)) / sum(weights)

    mx, my = [w for w, k in zip(x, middle(x)) if k < 1], [w for w, k in zip(y, middle(y)) if k < 1]
    if mx and my and not set(mx) & set(my):
        return 0.0  # two different middle initials
    if all(len(w) == 1 for w in x) or all(len(w) == 1 for w in y):
        return 0.0
    # one word against several says too little
    score = (one(x, y) + one(y, x)) / 2
    if min(sum(k == 1 for k in middle(x)), sum(k == 1 for k in middle(y))) == 1 and len(x) != len(y):
        return min(score, 0.75)
    return score


_canonical = F.pandas_udf(lambda s: pd.Series([canonical_words(None if x is None or x != x else x) for x in s], dtype=object), T.StringType())
_similarity = F.pandas_udf(lambda a, b: pd.Series([monge_elkan(x, y) for x, y in zip(a, b)]), T.DoubleType())


def candidates(names: DataFrame, rows: int, bands: int) -> DataFrame:
    """(scope, a, b), a < b: names of one scope that share a band of MinHash values over padded bigrams of their words."""
    padded = F.concat(F.lit("^"), F.replace(F.col("name"), F.lit(" "), F.lit("$^")), F.lit("$"))
    grams = F.filter(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2)), lambda g: g != "$^")
    # names are few beside their bands: spread them before the bands are made
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = names.repartition(tasks, "scope", "name").select("scope", "name", F.transform(F.array_distinct(grams), lambda g: F.xxhash64(g)).alias("g"))
    low = lambda i: F.array_min(F.transform("g", lambda x: F.xxhash64(x, i)))
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, *[low(b * rows + k) for k in range(rows)]))
    keyed = base.select("scope", "name", F.explode(band).alias("band"))
    other = keyed.select("scope", F.col("name").alias("b"), "band")
    return keyed.withColumnRenamed("name", "a").join(other.hint("merge"), ["scope", "band"]).where("a < b").select("scope", "a", "b").distinct()


def candidates_by_size(forms: DataFrame) -> DataFrame:
    """Candidates of every scope, with the rows a band that suit its number of names."""
    sized = forms.groupBy("scope").agg(F.count("*").alias("many"))
    # rows_for grows with the number of names: the smallest number of names for each further row, by bisection
    steps = []
    for rows in range(3, MOST_ROWS + 1):
        lo, hi = 1, 1 << 40
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if rows_for(mid) >= rows else (mid + 1, hi)
        steps.append(lo)
    rows = F.lit(2)
    for least in steps:
        rows = rows + (F.col("many") >= least).cast("int")
    tagged = checkpoint(forms.join(sized.select("scope", rows.alias("rows")).hint("merge"), "scope").select("scope", "name", "rows"))
    out = None
    for r in sorted(x[0] for x in tagged.select("rows").distinct().collect()):
        found = candidates(tagged.where(F.col("rows") == r).select("scope", "name"), r, bands_for(LOWEST_SIMILARITY, r, RECALL))
        out = found if out is None else out.union(found)
    return tagged.select("scope", F.col("name").alias("a"), F.col("name").alias("b")).limit(0) if out is None else out


def star_clusters(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, centre): vertices(v, rank) with a rank that orders them all, edges(a, b, sim) in one direction.

    A vertex that outranks all its undecided neighbours becomes a centre and decides them; a satellite goes
    to its most similar centre (ties: the higher rank). The order of ranks alone fixes the result.
    """
    both = checkpoint(edges.select("a", "b", "sim").union(edges.select("b", "a", "sim")))
    linked = both.select(F.col("a").alias("v")).distinct()
    open_ = checkpoint(vertices.join(linked.hint("merge"), "v", "left_semi"))
    centres = vertices.join(linked.hint("merge"), "v", "left_anti").select("v")
    while not open_.isEmpty():
        n = open_.select(F.col("v").alias("b"), F.col("rank").alias("their"))
        best = both.join(n.hint("merge"), "b").groupBy(F.col("a").alias("v")).agg(F.max("their").alias("their"))
        new = checkpoint(open_.join(best.hint("merge"), "v", "left").where(F.col("their").isNull() | (F.col("rank") > F.col("their"))).select("v"))
        decided = both.join(new.withColumnRenamed("v", "b").hint("merge"), "b").select(F.col("a").alias("v")).union(new)
        centres = centres.union(new)
        open_ = checkpoint(open_.join(decided.distinct().hint("merge"), "v", "left_anti"))
    centres = checkpoint(centres)
    ranked = centres.join(vertices.hint("merge"), "v").select(F.col("v").alias("b"), "rank")
    best = both.join(centres.withColumnRenamed("v", "a").hint("merge"), "a", "left_anti").join(ranked.hint("merge"), "b")
    best = best.groupBy(F.col("a").alias("v")).agg(F.max(F.struct("sim", "rank", "b")).getField("b").alias("centre"))
    return best.union(centres.select("v", F.col("v").alias("centre")))


def link_spellings(names: DataFrame, scope: str, name: str) -> DataFrame:
    """(scope, name, entity): every distinct typed name that is one, with the centre spelling of its cluster.

    Null names, unknown voices, names without letters, and rows of a null scope are left out. Repeated rows
    add to the weight of a spelling only. Names of different scopes are never linked.
    """
    typed = names.where(F.col(scope).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(scope).alias("scope"), F.col(name).alias("typed")).agg(F.count("*").alias("n"))
    typed = checkpoint(typed.withColumn("name", _canonical("typed")).where("name is not null"))
    forms = typed.groupBy("scope", "name").agg(F.sum("n").alias("n"))
    pairs = candidates_by_size(forms).withColumn("sim", _similarity("a", "b")).where(F.col("sim") >= ACCEPT)
    vid = lambda c: F.concat_ws("\x01", F.col("scope").cast("string"), F.col(c))
    edges = checkpoint(pairs.select(vid("a").alias("a"), vid("b").alias("b"), "sim"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("degree"))
    complete = F.size(F.filter(F.split("name", " "), lambda w: F.length(w) > 1))
    vertices = forms.select(vid("name").alias("v"), complete.alias("full"), "n").join(degree.hint("merge"), "v", "left")
    vertices = checkpoint(vertices.select("v", F.struct("full", F.coalesce("degree", F.lit(0)).alias("d"), F.coalesce("n", F.lit(0)).alias("n"), "v").alias("rank")))
    stars = star_clusters(vertices, edges)
    out = typed.withColumn("v", vid("name")).join(stars.hint("merge"), "v")
    return out.select(F.col("scope").alias(scope), F.col("typed").alias(name), F.element_at(F.split("centre", "\x01"), -1).alias("entity"))


def same_entity_pairs(linked: DataFrame, scope: str, name: str) -> DataFrame:
    """(scope, name_a, name_b), name_a < name_b by code point: pairs of different spellings of one entity."""
    other = linked.select(scope, "entity", F.col(name).alias("name_b"))
    return linked.withColumnRenamed(name, "name_a").join(other.hint("merge"), [scope, "entity"]).where("name_a < name_b").select(scope, "name_a", "name_b")
