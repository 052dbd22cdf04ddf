"""Row classifiers, reclassification, unbundling, and the sweep for unsettled lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import lexicon as L
from factloom.functions import text as X


def _hits(col: Column, patterns: list[str]) -> Column:
    return X.folded(col).rlike(L.any_of(patterns))


def _n_words(col: Column) -> Column:
    s = X.folded(col)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def is_banter(col: Column) -> Column:
    return _hits(col, L.BANTER)


def is_reply_echo(col: Column) -> Column:
    """Starts with a word of agreement and has few words."""
    return X.folded(col).rlike(L.ECHO_LEAD) & (_n_words(col) <= L.ECHO_WORDS)


def is_logistics(col: Column) -> Column:
    return _hits(col, L.LOGISTICS)


def is_aspiration(col: Column) -> Column:
    """A wish for a feel without anything measurable."""
    return _hits(col, L.ASPIRATION) & ~X.folded(col).rlike(L.MEASURABLE)


def resolves(col: Column) -> Column:
    """Wording that settles a question; "we decided ... not" settles nothing."""
    return F.regexp_replace(X.folded(col), L.DECIDED_NOT, " ").rlike(L.any_of(L.RESOLVES))


def is_undecided(col: Column) -> Column:
    return _hits(col, L.UNDECIDED) & ~resolves(col)


def is_hedge(col: Column) -> Column:
    return _hits(col, L.HEDGE)


def is_requirement_like(col: Column) -> Column:
    """Five words or more and a verb."""
    low = X.folded(col)
    return (F.size(F.regexp_extract_all(low, F.lit("[a-z0-9']+"), F.lit(0))) >= 5) & low.rlike(L.VERBISH)


def is_no_change(col: Column) -> Column:
    return _hits(col, L.NO_CHANGE)


def is_narration(col: Column) -> Column:
    return X.folded(col).rlike(L.NARRATION)


def is_vague_gap(col: Column) -> Column:
    return _hits(col, L.VAGUE_GAP)


def has_bound(col: Column) -> Column:
    return F.regexp_extract(X.folded(col), rf"\b({L.BOUNDS})\b", 1)


CLASSIFIERS = {
    "banter": is_banter, "echo": is_reply_echo, "logistics": is_logistics, "aspiration": is_aspiration, "undecided": is_undecided, "resolves": resolves, "hedge": is_hedge,
    "requirement": is_requirement_like, "no_change": is_no_change, "narration": is_narration, "vague_gap": is_vague_gap,
}


def drop_chatter(statements: DataFrame) -> DataFrame:
    """Without banter, echoes and logistics; rows of null quote stay."""
    q = F.col("quote")
    return statements.where(q.isNull() | ~(is_banter(q) | is_reply_echo(q) | is_logistics(q)))


def reclassify(statements: DataFrame) -> DataFrame:
    """Facts that voice a mere wish or something undecided become questions."""
    both = F.concat_ws(" ", "summary", "quote")
    return statements.withColumn("kind", F.when(is_aspiration(F.col("quote")) | is_undecided(both), "question").otherwise(F.col("kind")))


def unbundle(statements: DataFrame, is_verbatim: Column, part: str = "_at") -> DataFrame:
    """Facts whose quote packs several requirements, one row per part; ``parts`` must hold the quote's verbatim parts.

    ``is_verbatim`` is a column of an array of normalised parts that are known verbatim; a fact is split if two or
    more of its clauses are in it and read like requirements. Each part's summary is the part itself. ``part`` is the
    name of a column for the number of the part, from 0.
    """
    parts = F.filter(X.clauses(F.col("quote")), lambda c: F.array_contains(is_verbatim, X.normalise(c)) & is_requirement_like(c))
    split = (F.col("kind") == "fact") & (F.size(parts) >= 2)
    rows = statements.select("*", F.posexplode(F.when(split, parts).otherwise(F.array(F.col("quote")))).alias(part, "_part"))
    whole = F.rtrim("_part", F.lit(".!?"))
    own = F.concat(F.upper(F.substring(whole, 1, 1)), F.substring(whole, F.lit(2), F.length(whole)), F.lit("."))
    return rows.withColumn("summary", F.when(split, own).otherwise(F.col("summary"))).withColumn("quote", F.col("_part")).drop("_part")


def hedge_sweep(turns: DataFrame, seen: DataFrame) -> DataFrame:
    """Lines that flag something unsettled, as verified questions without area; ``seen``(source_id, norm) are quotes already taken."""
    t = F.col("text")
    n = F.size(F.split(X.folded(t), " "))
    lines = turns.where(is_hedge(t) & (n >= 4) & ~is_logistics(t) & ~is_banter(t) & ~is_reply_echo(t))
    lines = lines.select(
        "source_id", "line_no", F.lit("question").alias("kind"), F.lit("").alias("feature"), F.rtrim("text", F.lit(".")).alias("summary"), F.col("text").alias("quote"),
        F.coalesce("speaker", F.lit("Unidentified speaker")).alias("speaker"), F.coalesce("ts", F.lit("not available")).alias("ts"), F.lit(True).alias("verified"), F.lit(1.0).alias("match_score"), X.normalise(t).alias("norm"),
    )
    fresh = lines.join(seen.select("source_id", "norm").distinct(), ["source_id", "norm"], "left_anti")
    first = fresh.groupBy("source_id", "norm").agg(F.min("line_no").alias("line_no"))
    return fresh.join(first, ["source_id", "norm", "line_no"]).dropDuplicates(["source_id", "norm"])
