"""One query per operator over the test tables; the matching SQL is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import store
from factloom.functions import text as X
from factloom.model import RuleModel
from factloom.operators import classify as C
from factloom.operators import crossdoc, fold, ground, naming
from factloom.runtime import table
from factloom.sources import transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def statements(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each statement once, whatever the deliveries."""
    return table(spark, d, "statements").select("statement_id", *columns).dropDuplicates(["statement_id"])


def turns(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "turns").select("source_id", "line_no", *columns).dropDuplicates(["source_id", "line_no"])


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts").dropDuplicates(["project", "feature", "ef_id"])


def with_project(s: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls").select("source_id", "project", "call_date").dropDuplicates(["source_id"])
    return s.join(calls, "source_id")


def _sorted(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), " ")


@query
def normalise_text(spark, d):
    return statements(spark, d, "quote").select("statement_id", X.normalise(F.col("quote")).alias("norm"))


@query
def split_sentences(spark, d):
    return turns(spark, d, "text").select("source_id", "line_no", F.posexplode(X.sentences(F.col("text"))).alias("part", "sentence"))


@query
def split_strict_sentences(spark, d):
    return turns(spark, d, "text").select("source_id", "line_no", F.posexplode(X.strict_sentences(F.col("text"))).alias("part", "sentence"))


@query
def split_clauses(spark, d):
    return statements(spark, d, "quote").select("statement_id", F.posexplode(X.clauses(F.col("quote"))).alias("part", "clause"))


@query
def strip_speaker(spark, d):
    return turns(spark, d, "text").select("source_id", "line_no", X.strip_speaker(F.col("text")).alias("body"))


def _tokens(name: str):
    def run(spark, d):
        return statements(spark, d, "summary", "quote").select("statement_id", _sorted(X.TOKENISERS[name](F.concat_ws(" ", "summary", "quote"))).alias("tokens"))

    run.__name__ = f"tokens_{name}"
    return query(run)


for _name in X.TOKENISERS:
    _tokens(_name)


def _classifier(name: str):
    def run(spark, d):
        return turns(spark, d, "text").select("source_id", "line_no", C.CLASSIFIERS[name](F.col("text")).cast("int").alias("hit"))

    run.__name__ = f"classify_{name}"
    return query(run)


for _name in C.CLASSIFIERS:
    _classifier(_name)


@query
def area_names(spark, d):
    f = F.col("feature")
    s = table(spark, d, "statements").select("feature").where("feature is not null").distinct()
    return s.select("feature", X.decamel(f).alias("spaced"), X.slug(f).alias("slug"), X.is_bad_area(f).cast("int").alias("bad"), X.is_dump_area(f).cast("int").alias("dump"))


@query
def clean_areas(spark, d):
    s = table(spark, d, "statements").select("feature").where("feature is not null").distinct()
    return s.select("feature", X.clean_area(F.col("feature")).alias("area"))


@query
def areas_from_summaries(spark, d):
    return statements(spark, d, "summary", "feature").select("statement_id", X.area_from_summary(F.col("summary"), F.col("feature")).alias("area"))


@query
def summaries_from_quotes(spark, d):
    return statements(spark, d, "quote").select("statement_id", X.summary_from_quote(F.col("quote")).alias("summary"))


@query
def repaired_summaries(spark, d):
    return statements(spark, d, "summary", "quote").select("statement_id", X.repair_summary(F.col("summary"), F.col("quote")).alias("summary"))


@query
def measures(spark, d):
    return statements(spark, d, "quote").select("statement_id", F.explode(X.measures(F.col("quote"))).alias("m")).select("statement_id", "m.unit", "m.value")


@query
def numbers(spark, d):
    q = F.col("quote")
    return statements(spark, d, "quote").select("statement_id", _sorted(X.digit_numbers(q)).alias("digits"), _sorted(X.numerals(q)).alias("numerals"), _sorted(X.story_numbers(q)).alias("story_numbers"), X.is_multipart(q).cast("int").alias("multipart"))


@query
def clock_times(spark, d):
    return turns(spark, d, "ts").select("source_id", "line_no", X.clock_millis(F.col("ts")).alias("millis"))


@query
def candidate_spans(spark, d):
    return ground.candidate_spans(turns(spark, d, "text"))


@query
def chunks(spark, d):
    return transcripts.chunk_lines(turns(spark, d, "ts", "speaker", "text")).select("source_id", "part_no", "total", "line_from", "line_to", F.length("text").alias("n_chars"))


@query
def ground_verbatim(spark, d):
    g = ground.ground(statements(spark, d, "source_id", "quote"), turns(spark, d, "text"), "statement_id")
    return g.select("statement_id", F.col("is_verbatim").cast("int").alias("is_verbatim"), "quote_line")


@query
def snapped_quotes(spark, d):
    s = ground.snap_quotes(statements(spark, d, "source_id", "quote"), turns(spark, d, "text"), "statement_id")
    return s.select("statement_id", "quote", F.col("verified").cast("int").alias("verified"), F.round("match_score", 6).alias("match_score"))


@query
def quote_times(spark, d):
    s = ground.backfill_ts(statements(spark, d, "source_id", "quote").withColumn("ts", F.lit(None).cast("string")), turns(spark, d, "text", "ts"), "statement_id")
    return s.select("statement_id", "ts")


@query
def dedup_quotes(spark, d):
    return ground.dedup_quotes(statements(spark, d, "source_id", "seq", "kind", "quote").where("quote is not null")).select("source_id", "norm", "seq", "statement_id")


@query
def chatter_free(spark, d):
    return C.drop_chatter(statements(spark, d, "quote")).select("statement_id")


@query
def reclassified(spark, d):
    return C.reclassify(statements(spark, d, "kind", "summary", "quote")).select("statement_id", "kind")


@query
def unbundled(spark, d):
    s = statements(spark, d, "source_id", "kind", "summary", "quote").where("quote is not null")
    parts = s.select("source_id", F.explode(X.clauses(F.col("quote"))).alias("c")).distinct().withColumn("k", F.concat_ws("\x01", "source_id", "c"))
    found = ground.verbatim_lines(parts, "k", "c", ground.line_norms(turns(spark, d, "text"))).select("k")
    own = s.select("statement_id", "source_id", F.explode(X.clauses(F.col("quote"))).alias("c")).withColumn("k", F.concat_ws("\x01", "source_id", "c")).join(found, "k").groupBy("statement_id").agg(F.collect_set(X.normalise(F.col("c"))).alias("known"))
    return C.unbundle(s.join(own, "statement_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>"))), F.col("known")).select("statement_id", "quote", "summary")


@query
def hedged_lines(spark, d):
    seen = table(spark, d, "statements").where("quote is not null").select("source_id", X.normalise(F.col("quote")).alias("norm"))
    return C.hedge_sweep(turns(spark, d, "ts", "speaker", "text"), seen).select("source_id", "line_no", "quote", "speaker", "ts")


@query
def unanswered(spark, d):
    s = statements(spark, d, "source_id", "seq", "kind", "summary", "quote").where("quote is not null").withColumn("pos", F.col("seq") * 100)
    return ground.drop_answered(s, "statement_id", "pos").select("statement_id")


@query
def routed_names(spark, d):
    areas = table(spark, d, "feature_areas")
    r = naming.route_names(table(spark, d, "statements"), "feature", areas, "area_name", "area_id")
    return r.select("feature", "routed", F.round("score", 6).alias("score"))


@query
def canonical_names(spark, d):
    s = with_project(table(spark, d, "statements").select("source_id", "feature").distinct(), spark, d)
    return naming.canonical_names(s.withColumn("feature", X.clean_area(F.col("feature"))).where("feature <> ''"), "project", "feature")


@query
def split_areas(spark, d):
    """All statements of a call as one catch-all area, as if a model had dumped it."""
    s = statements(spark, d, "source_id", "summary").withColumn("name", F.lit("Misc"))
    return naming.cohesion_split(s, "source_id", "statement_id", "summary", name="name").select(F.col("area").alias("source_id"), F.col("row").alias("statement_id"), "new_area")


@query
def word_frequency(spark, d):
    f = facts(spark, d).withColumn("row", F.concat_ws("#", "feature", F.col("ef_id").cast("string"))).withColumn("w", X.topic_words(F.concat_ws(" ", "summary", "quote")))
    return naming.document_frequency(f, ["project"], "row", "w")


@query
def ambient_words(spark, d):
    f = facts(spark, d).withColumn("row", F.concat_ws("#", "feature", F.col("ef_id").cast("string"))).withColumn("w", X.topic_words(F.concat_ws(" ", "summary", "quote")))
    return naming.ambient_words(f, ["project"], "row", "w", 0.25).select("project", "word", "n_rows")


@query
def rehomed_questions(spark, d):
    q = with_project(statements(spark, d, "source_id", "kind", "summary", "quote").where("kind = 'question'"), spark, d)
    return naming.rehome(q, "statement_id", facts(spark, d))


@query
def misrouted_statements(spark, d):
    s = statements(spark, d, "feature", "summary", "quote").where("feature is not null").withColumn("text", F.concat_ws(" ", "summary", "quote"))
    return s.where(naming.misrouted(s, "feature", "text")).select("statement_id")


@query
def active_facts(spark, d):
    return crossdoc.active_facts(facts(spark, d)).select("project", "feature", "ef_id", "summary")


@query
def version_chain(spark, d):
    v = fold.version_chain(facts(spark, d))
    return v.select("project", "feature", "ef_id", "next_id", F.col("is_active").cast("int").alias("is_active"), F.col("is_sound").cast("int").alias("is_sound"))


@query
def restated_statements(spark, d):
    s = with_project(statements(spark, d, "source_id", "feature", "quote"), spark, d).where("feature is not null and quote is not null")
    return crossdoc.restated(s, facts(spark, d)).select("statement_id")


@query
def unshared_statements(spark, d):
    s = with_project(statements(spark, d, "source_id", "feature", "summary", "quote"), spark, d).where("feature is not null")
    return crossdoc.shares_no_word(s, "statement_id", facts(spark, d))


@query
def best_targets(spark, d):
    s = with_project(statements(spark, d, "source_id", "feature", "summary", "quote"), spark, d).where("feature is not null")
    return crossdoc.best_targets(s, "statement_id", facts(spark, d))


def _fold(spark, d):
    s = with_project(statements(spark, d, "source_id", "seq", "kind", "feature", "summary", "quote", "speaker", "ts", "verified"), spark, d).withColumn("seq", F.col("statement_id"))
    return fold.fold_events(s, facts(spark, d), RuleModel().verdict)


@query
def fold_events(spark, d):
    return _fold(spark, d).select("project", "feature", "seq", "event_type", "ef_id", "other_ef_id")


@query
def fold_counters(spark, d):
    return fold.run_counters(_fold(spark, d))


@query
def facts_after_fold(spark, d):
    return fold.facts_after(facts(spark, d), _fold(spark, d)).select("project", "feature", "ef_id", "superseded_by", "summary")


@query
def resolved_questions(spark, d):
    q = with_project(statements(spark, d, "source_id", "kind", "summary", "quote").where("kind = 'question'"), spark, d)
    return crossdoc.resolve_questions(q, "statement_id", facts(spark, d))


@query
def contradictions(spark, d):
    return crossdoc.contradictions(facts(spark, d))


@query
def top_documents(spark, d):
    items = table(spark, d, "eval_items")
    return crossdoc.top_documents(items, "item_id", "text", table(spark, d, "documents").dropDuplicates(["doc_id"]), "doc_id", "text")


def _merge_groups(f: DataFrame, words: int = 100) -> DataFrame:
    """Areas of a project whose slugs, or the first ``words`` words of them, are equal form a group; the smallest name is the target."""
    from pyspark.sql import Window

    areas = f.select("project", "feature").where("feature is not null").distinct().withColumn("slug", F.substring_index(X.slug(F.col("feature")), "-", words))
    w = Window.partitionBy("project", "slug")
    ranked = areas.select("project", "feature", F.min("feature").over(w).alias("target"), F.row_number().over(w.orderBy("feature")).alias("member_no"), F.count("*").over(w).alias("n"))
    return ranked.where("n > 1").drop("n")


@query
def merged_areas(spark, d):
    f = facts(spark, d)
    return crossdoc.merge_areas(f, _merge_groups(f)).select("project", "feature", "ef_id", "superseded_by", "summary")


@query
def mergeable_areas(spark, d):
    f = facts(spark, d)
    return crossdoc.mergeable(f, _merge_groups(f, 1)).select("project", "feature", "target")


@query
def stories(spark, d):
    return crossdoc.story(facts(spark, d))


@query
def story_problems(spark, d):
    f = facts(spark, d)
    return crossdoc.story_problem(crossdoc.story(f), f)


@query
def grounding_score(spark, d):
    s = crossdoc.grounding_score(facts(spark, d), turns(spark, d, "text"))
    return s.withColumn("passed", F.col("passed").cast("int"))


@query
def fact_lines(spark, d):
    return store.fact_lines(facts(spark, d)).select("project", "feature", "ef_id", "line")


@query
def numbered_facts(spark, d):
    s = with_project(statements(spark, d, "source_id", "kind", "feature").where("kind = 'fact'"), spark, d).withColumn("seq", F.col("statement_id"))
    return fold.number_facts(s.where("feature is not null"), facts(spark, d)).select("statement_id", "project", "feature", "ef_id")


def _files(spark: SparkSession, d: str, header: str, line: Column, between: str) -> DataFrame:
    """(source_id, raw): the turns of each call as files of up to 400 line numbers, ``line`` by ``line``."""
    blank = lambda c: F.btrim(F.regexp_replace(F.col(c), f"(?:{X.BLANK}|[<>])+", " "))
    t = turns(spark, d, "ts", "speaker", "text").withColumns({"text": blank("text"), "who": F.coalesce(blank("speaker"), F.lit(""))}).where("text <> ''")
    t = t.select(F.concat_ws("#", "source_id", F.floor(F.col("line_no") / 400).cast("string")).alias("source_id"), "line_no", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line)
    return t.groupBy("source_id").agg(F.concat(F.lit(header), F.array_join(lines, between)).alias("raw"))


@query
def vtt_turns(spark, d):
    """Every call written as WebVTT and read again."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    n = F.col("line_no")
    start = F.concat(two(F.floor(n / 3600)), F.lit(":"), two(F.floor(n / 60) % 60), F.lit(":"), two(n % 60), F.lit(".000"))
    cue = F.concat(n.cast("string"), F.lit("\n"), start, F.lit(" --> "), start, F.lit("\n<v "), F.col("who"), F.lit(">"), F.col("text"), F.lit("</v>"))
    return transcripts.vtt_turns(_files(spark, d, "WEBVTT\n\n", cue, "\n\n"))


@query
def txt_turns(spark, d):
    """Every call written as lines of text, with labels where there are some, and read again."""
    who = F.when(F.col("who") != "", F.concat(F.lit("**"), F.col("who"), F.lit(":** "))).otherwise("")
    return transcripts.txt_turns(_files(spark, d, "", F.concat(who, F.col("text")), "\n"))
