"""One call, or many, from transcript to versioned facts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import store
from factloom.config import CONFIG, Config
from factloom.functions import text as X
from factloom.model import RuleModel, TextModel, parse_statements, strip_thinking
from factloom.operators import classify as C
from factloom.operators import crossdoc, fold, ground, naming
from factloom.runtime import checkpoint
from factloom.sources import transcripts

CALL_STEP = 10_000_000_000_000
"""Numbers of one call in a project's order: 100,000 a line."""
LATE_STEP = 1_000_000_000_000
"""The last of them are for what is found after the calls."""


def extract_by_rules(turns: DataFrame) -> DataFrame:
    """Statements of the rule model: every sentence of a turn that reads like a requirement and isn't chatter."""
    s = turns.where("text is not null").select("source_id", "line_no", "speaker", "ts", F.posexplode(X.sentences(F.col("text"))).alias("part", "quote"))
    s = s.withColumn("quote", F.btrim("quote")).where(C.is_requirement_like(F.col("quote")))
    return s.select(
        "source_id", (F.col("line_no").cast("long") * 1000 + F.col("part")).alias("seq"), F.lit("fact").alias("kind"), X.area_from_summary(X.summary_from_quote(F.col("quote")), F.lit("Misc")).alias("feature"),
        X.summary_from_quote(F.col("quote")).alias("summary"), "quote", F.coalesce("speaker", F.lit("Unidentified speaker")).alias("speaker"), F.coalesce("ts", F.lit("not available")).alias("ts"), F.lit(True).alias("verified"), F.lit(1.0).alias("match_score"),
    )


def needs_coverage(chunks: DataFrame, has_facts: bool, shortest_chunk: int = 400, short_call: int = 1500) -> DataFrame:
    """Chunks worth a second extraction: longer ones, of a first call or of a follow-up that isn't short."""
    size = chunks.groupBy("source_id").agg(F.sum(F.length("text")).alias("_n"))
    out = chunks.where(F.length("text") > shortest_chunk).join(size, "source_id")
    return (out.where(F.col("_n") >= short_call) if has_facts else out).drop("_n")


def call_model(chunks: DataFrame, chat: Callable[[str, str], str], system: str, coverage: bool = False) -> DataFrame:
    """source_id, part_no, prompt, reply: the audit table of model calls; write it to a table before it is used.

    The chunks of a call are sent one after another, as each prompt names the areas found so far; calls run in parallel.
    """
    lead = "List what the earlier pass may have missed. " if coverage else ""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        areas, rows = [], []
        for r in pdf.sort_values("part_no").itertuples():
            prompt = f"{lead}Known areas: {', '.join(areas) or 'none'}\n\n{r.text}"
            reply = chat(system, prompt)
            areas += [b["feature"] for b in parse_statements(strip_thinking(reply)) if b["feature"] not in areas]
            rows.append((r.source_id, r.part_no, prompt, reply))
        return pd.DataFrame(rows, columns=["source_id", "part_no", "prompt", "reply"])

    return chunks.select("source_id", "part_no", "text").groupBy("source_id").applyInPandas(run, "source_id string, part_no int, prompt string, reply string")


def statements_from_replies(calls: DataFrame, from_coverage: bool = False) -> DataFrame:
    """Statements of model replies, in order; blocks that lack a label are dropped."""
    parsed = F.udf(lambda reply: [(b["kind"], b["feature"], b["summary"], b["quote"], b["speaker"], b["timestamp"]) for b in parse_statements(reply or "")], "array<struct<kind:string,feature:string,summary:string,quote:string,speaker:string,ts:string>>")
    rows = calls.select("source_id", "part_no", F.posexplode(parsed(X.strip_thinking(F.col("reply")))).alias("n", "b"))
    late = 500 if from_coverage else 0
    return rows.select("source_id", (F.col("part_no").cast("long") * 1000 + F.col("n") + late).alias("seq"), "b.*", F.lit(from_coverage).alias("from_coverage"))


def extract_by_model(spark: SparkSession, turns: DataFrame, chat: Callable[[str, str], str], system: str, root: str, has_facts: bool) -> DataFrame:
    """Statements of a text model: every chunk, then the coverage pass over those worth it.

    Prompts and replies are written to audit tables below ``root`` first and read back, so that no reply is asked for
    twice, whatever is computed again.
    """
    chunks = checkpoint(transcripts.chunk_lines(turns))
    at = f"{root}/audit/{uuid.uuid4().hex[:12]}"
    call_model(chunks, chat, system).write.parquet(f"{at}/first")
    call_model(needs_coverage(chunks, has_facts), chat, system, coverage=True).write.parquet(f"{at}/coverage")
    first, more = (spark.read.parquet(f"{at}/{x}") for x in ("first", "coverage"))
    return statements_from_replies(first).unionByName(statements_from_replies(more, from_coverage=True))


def statements_of(turns: DataFrame, extracted: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Extracted statements through the pipeline: filter, reclassify, unbundle, ground, date, drop, dedup, sweep, drop answered ones."""
    s = C.reclassify(C.drop_chatter(extracted)).where("source_id is not null and quote is not null")
    s = s.withColumn("from_coverage", F.coalesce("from_coverage", F.lit(False)) if "from_coverage" in s.columns else F.lit(False))
    key = lambda: F.concat_ws("#", "source_id", F.col("seq").cast("string"), F.hex(F.xxhash64("quote")))
    s = checkpoint(ground.verbatim_clauses(s.withColumn("key", key()), turns, "key"))
    s = C.unbundle(s, F.col("known"), "part").withColumns({"key": key(), "seq": F.col("seq") * 100 + F.least("part", F.lit(99))}).drop("known", "part")
    s = checkpoint(ground.snap_quotes(s.dropDuplicates(["key"]), turns, "key", config))
    stamps = turns.where("ts is not null").dropDuplicates(["source_id", "line_no"]).select("source_id", F.col("line_no").cast("int").alias("quote_line"), F.col("ts").alias("line_ts"))
    s = s.join(stamps.hint("merge"), ["source_id", "quote_line"], "left").withColumn("ts", F.coalesce("line_ts", F.lit("not available"))).drop("line_ts")
    s = s.where(F.col("verified") | ~((F.col("kind") == "question") | F.col("from_coverage")))
    s = C.reclassify(ground.dedup_quotes(s))
    swept = C.hedge_sweep(turns, s.select("source_id", "norm"))
    swept = swept.withColumns({"seq": F.col("line_no").cast("long") * 100_000 + 99_999, "quote_line": F.col("line_no"), "quote_as_extracted": F.col("quote")}).withColumn("key", F.concat_ws("#", "source_id", F.lit("swept"), F.col("seq").cast("string")))
    cols = ["source_id", "seq", "kind", "feature", "summary", "quote", "speaker", "ts", "verified", "match_score", "quote_as_extracted", "quote_line", "norm", "key"]
    s = checkpoint(s.select(*cols).unionByName(swept.select(*cols)))
    # the place of a statement is the number of characters of the call before its line
    starts = ground.line_norms(turns).select("source_id", F.col("line_no").alias("quote_line"), F.col("start").alias("pos"))
    return ground.drop_answered(s.join(starts.hint("merge"), ["source_id", "quote_line"], "left"), "key", "pos", config).drop("pos")


def assign_areas(s: DataFrame, facts: DataFrame, areas: Callable[[DataFrame], DataFrame] | None = None, config: Config = CONFIG) -> DataFrame:
    """Statements (key, project, feature, summary, quote, kind) with their final feature; "" for questions without a home.

    ``areas`` gives (key, area), say from a text model; an existing area that shares no significant word with the
    statement isn't believed, and new areas of one batch that are nearly the same are folded. Without it the names of
    the batch are made canonical. Then names are routed onto the project's existing areas, new areas that are really
    several topics are split, and what came of that is routed again.
    """
    known = facts.select("project", "feature").distinct().withColumn("o", F.col("feature"))
    own = F.coalesce(X.clean_area(F.col("feature")), F.lit(""))
    s = s.withColumn("feature", F.when((own == "") & (F.col("kind") != "question"), X.area_from_summary(F.col("summary"), F.lit("Misc"))).otherwise(own))

    def routed(s: DataFrame) -> DataFrame:
        to = naming.route_names(s.where("feature <> ''"), "feature", known, "feature", "o", config, scope="project").select("project", "feature", "routed")
        return checkpoint(s.join(to.hint("merge"), ["project", "feature"], "left").withColumn("feature", F.coalesce("routed", "feature")).drop("routed"))

    if areas is not None:
        given = areas(s).select("key", "area").join(s.select("key", "project"), "key").join(known.select("project", F.col("feature").alias("area"), F.lit(True).alias("exists")), ["project", "area"], "left").drop("project")
        s = s.join(given.hint("merge"), "key", "left").withColumn("text", F.concat_ws(" ", "summary", "quote"))
        astray = F.coalesce("exists", F.lit(False)) & naming.misrouted(s, "area", "text")
        kept = (F.col("feature") != "") & ~naming.misrouted(s, "feature", "text")
        s = s.withColumn("feature", F.when(F.coalesce("area", F.lit("")) == "", F.col("feature")).when(~astray, F.col("area")).when(kept, F.col("feature")).otherwise(X.area_from_summary(F.col("summary"), F.lit("Misc"))))
        s = checkpoint(s.drop("area", "exists", "text"))
        new = s.where("feature <> ''").groupBy("project", "feature").agg(F.min("seq").alias("seq")).join(known, ["project", "feature"], "left_anti")

        def fold_names(pdf: pd.DataFrame) -> pd.DataFrame:
            to = naming.consolidate(pdf.sort_values(["seq", "feature"])["feature"].tolist())
            return pdf.assign(canonical=pdf["feature"].map(to))[["project", "feature", "canonical"]]

        names = new.groupBy("project").applyInPandas(fold_names, "project string, feature string, canonical string")  # new names of one batch
    else:
        names = naming.canonical_names(s.where("feature <> ''"), "project", "feature", config)
    s = s.join(names.hint("merge"), ["project", "feature"], "left").withColumn("feature", F.coalesce("canonical", "feature")).drop("canonical")
    s = routed(s)
    fresh = s.where("feature <> ''").join(known.select("project", "feature"), ["project", "feature"], "left_anti").withColumn("area", F.concat_ws("\x01", "project", "feature"))
    split = naming.cohesion_split(fresh, "area", "key", "summary", config, name="feature").select(F.col("row").alias("key"), "new_area")
    s = routed(s.join(split.hint("merge"), "key", "left").withColumn("feature", F.coalesce("new_area", "feature")).drop("new_area"))
    # a new area of questions alone is no area
    real = s.where("kind <> 'question'").select("project", "feature").union(known.select("project", "feature")).distinct().withColumn("real", F.lit(True))
    return s.join(real.hint("merge"), ["project", "feature"], "left").withColumn("feature", F.when(F.col("real"), F.col("feature")).otherwise("")).drop("real")


def ingest(
    spark: SparkSession, turns: DataFrame, calls: DataFrame, root: str, model: TextModel | None = None, extracted: DataFrame | None = None, config: Config = CONFIG,
    areas: Callable[[DataFrame], DataFrame] | None = None, gaps: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Folds the calls into the store below ``root`` and returns the events.

    calls: source_id, project, call_date; calls of a project are applied in order of date, then source_id, after all
    calls on record. Statements whose quote the log has for this call are passed over, so running it again with the
    same calls changes nothing. ``areas`` see ``assign_areas``; ``gaps`` gives gap questions (project, feature, gap_no,
    question, refs) of the facts it is handed. Answers and contradictions are looked for only in projects whose
    facts the run touches.
    """
    facts, log = checkpoint(store.load(spark, root, "facts")), checkpoint(store.load(spark, root, "events"))
    s = statements_of(turns, extracted if extracted is not None else extract_by_rules(turns), config)
    s = s.join(calls.select("source_id", "project", "call_date").where("project is not null").dropDuplicates(["source_id"]), "source_id")
    seen = log.select("project", "source_id", X.normalise(F.col("quote")).alias("norm")).distinct()
    s = checkpoint(s.join(seen.hint("merge"), ["project", "source_id", "norm"], "left_anti"))
    s = checkpoint(assign_areas(s, facts, areas, config))
    last = log.groupBy("project").agg(F.floor(F.max("seq") / CALL_STEP).alias("last"))
    order = F.concat(F.coalesce(F.col("call_date").cast("string"), F.lit("")), F.lit("\x01"), "source_id")
    rank = s.select("project", "source_id", order.alias("o")).distinct().withColumn("n", F.dense_rank().over(Window.partitionBy("project").orderBy("o")))
    rank = rank.join(last.hint("merge"), "project", "left").select("project", "source_id", (F.col("n") + F.coalesce("last", F.lit(0))).alias("call_no"))
    s = s.join(rank.hint("merge"), ["project", "source_id"]).withColumn("seq", F.col("call_no") * CALL_STEP + F.col("seq"))
    homeless = s.where("feature = '' and kind = 'question'")
    hosts = crossdoc_hosts(homeless, facts, s)
    s = s.where("feature <> ''").unionByName(homeless.drop("feature").join(hosts.hint("merge"), "key").select(*s.columns))
    text_model = model or RuleModel()
    events = checkpoint(fold.fold_events(s, facts, text_model.verdict, log.where("event_type = 'question'").select("project", "quote")))
    after = checkpoint(fold.facts_after(facts, events))
    touched = events.where("adds_fact").select("project").distinct()
    now = lambda df: df.join(touched.hint("merge"), "project", "left_semi")
    every = checkpoint(now(log.unionByName(events)))
    extra = resolutions(every, now(after), text_model, config).unionByName(contradiction_flags(every, now(after), config))
    if gaps is not None:
        extra = extra.unionByName(gap_questions(gaps(fold_touched(after, events)), after, log.unionByName(events), config))
    events = checkpoint(events.unionByName(extra))
    store.append(spark, root, events, after)
    return events


def fold_touched(facts: DataFrame, events: DataFrame) -> DataFrame:
    """Active facts of the areas that got a fact in this run."""
    return crossdoc.active_facts(facts).join(events.where("adds_fact").select("project", "feature").distinct(), ["project", "feature"], "left_semi")


def _late_event(df: DataFrame, every: DataFrame, event: str, **columns) -> DataFrame:
    """Events of the passes over all facts, numbered after the latest call of their project; those on record already are left out."""
    top = every.groupBy("project").agg((F.floor(F.max("seq") / CALL_STEP) * CALL_STEP + CALL_STEP - LATE_STEP).alias("_top"))
    values = {"event_type": F.lit(event), "kind": F.lit("note"), "adds_fact": F.lit(False), "was_quote": F.lit(None).cast("string")} | columns
    out = df.join(top.hint("merge"), "project").withColumns(values)
    out = out.withColumn("seq", F.col("_top") + F.pmod(F.xxhash64("feature", "ef_id", "source_id", "quote", "reason"), F.lit(LATE_STEP)))
    done = every.where(F.col("event_type") == event).select("project", "feature", "ef_id", "source_id", "reason").distinct()
    on = [out[c].eqNullSafe(done[c]) for c in done.columns]
    return out.join(done.hint("merge"), on, "left_anti").select(*fold.EVENT_COLUMNS)


def resolutions(events: DataFrame, facts: DataFrame, model: TextModel, config: Config = CONFIG) -> DataFrame:
    """"resolved" events of questions that a fact answers, each with a back-link event in the fact's area.

    Near misses, at most ``model_resolutions`` a run in the order of their area and number, are put to the model.
    """
    done = events.where("event_type = 'resolved'").select("project", "feature", "source_id", X.normalise(F.col("quote")).alias("_n")).distinct()
    q = events.where("event_type = 'question'").withColumn("_n", X.normalise(F.col("quote"))).join(done.hint("merge"), ["project", "feature", "source_id", "_n"], "left_anti")
    q = checkpoint(q.withColumn("key", F.concat_ws("#", "project", "feature", "source_id", F.col("seq").cast("string"))).select("key", *fold.EVENT_COLUMNS))
    met = crossdoc.resolve_questions(q, "key", facts, config).select("key", "verdict", F.col("feature").alias("a_feature"), F.col("ef_id").alias("a_id"))
    answer = facts.select("project", F.col("feature").alias("a_feature"), F.col("ef_id").alias("a_id"), F.col("quote").alias("a_quote"))
    both = checkpoint(q.join(met.hint("merge"), "key").join(answer.hint("merge"), ["project", "a_feature", "a_id"]))
    near = both.where("verdict = 'near'").orderBy("project", "feature", "seq", "key").select("key", F.coalesce("summary", "quote").alias("asked"), "a_quote").limit(config.model_resolutions).collect()
    sure = [r.key for r in near if model.resolves(r.asked, r.a_quote)]
    both = both.where((F.col("verdict") == "resolved") | F.col("key").isin(sure))
    pointer = F.concat(F.col("a_feature"), F.lit(" EF-"), F.col("a_id").cast("string"))
    flipped = _late_event(both, events, "resolved", ef_id=F.lit(None).cast("int"), other_ef_id=F.lit(None).cast("int"), reason=pointer, now_quote=F.col("a_quote"))
    there = both.withColumn("q_feature", F.col("feature")).withColumn("feature", F.col("a_feature"))
    link = _late_event(there, events, "answers", ef_id=F.col("a_id"), other_ef_id=F.lit(None).cast("int"), reason=F.concat(F.lit("a question of "), F.col("q_feature")), now_quote=F.col("a_quote"))
    return flipped.unionByName(link)


def contradiction_flags(events: DataFrame, facts: DataFrame, config: Config = CONFIG) -> DataFrame:
    """"contradiction" events, one in each of the two areas; a pair on record isn't flagged again."""
    c = checkpoint(crossdoc.contradictions(facts, config))
    side = lambda x, y: c.select("project", F.col(f"feature_{x}").alias("feature"), F.col(f"ef_{x}").alias("ef_id"), F.concat(F.lit("differs from "), F.col(f"feature_{y}"), F.lit(" EF-"), F.col(f"ef_{y}").cast("string"), F.lit(" in "), "unit").alias("reason"))
    rows = side("a", "b").unionByName(side("b", "a")).distinct()
    own = facts.select("project", "feature", "ef_id", "summary", "quote", "speaker", "ts", "source_id", "call_date")
    return _late_event(rows.join(own.hint("merge"), ["project", "feature", "ef_id"]), events, "contradiction", other_ef_id=F.lit(None).cast("int"), now_quote=F.lit(None).cast("string"))


def gap_questions(gaps: DataFrame, facts: DataFrame, events: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Usable gap questions as question events; an area gets two in its whole life."""
    asked = events.where("event_type = 'question'")
    used = asked.where("reason = 'gap'").groupBy("project", "feature").agg(F.count("*").alias("n_gaps"))
    open_ = asked.select("project", "feature", F.concat_ws(" ", "summary", "quote").alias("text"))
    g = crossdoc.filter_gaps(gaps, facts, open_, config, used)
    none = {c: F.lit(None).cast("string") for c in ("quote", "speaker", "ts", "source_id", "now_quote")}
    return _late_event(g, events, "question", summary=F.col("question"), ef_id=F.element_at("refs", 1), other_ef_id=F.lit(None).cast("int"), reason=F.lit("gap"), call_date=F.lit(None).cast("date"), **none).withColumn("kind", F.lit("question"))


def crossdoc_hosts(questions: DataFrame, facts: DataFrame, statements: DataFrame) -> DataFrame:
    """(key, feature) for questions without area, judged by recorded facts and by the statements of this run."""
    now = statements.where("feature <> '' and kind = 'fact'").select("project", "feature", "summary", "quote")
    every = facts.select("project", "feature", "summary", "quote").unionByName(now)
    return naming.rehome(questions, "key", every).select("key", F.col("host").alias("feature"))


def views(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """facts, active, stories, open items, change log and counters of the store, and the passes over all facts."""
    facts, events = store.load(spark, root, "facts"), store.load(spark, root, "events")
    questions = events.where("event_type = 'question'").withColumn("key", F.concat_ws("#", "project", "feature", "source_id", F.col("seq").cast("string")))
    passes = {"resolved": crossdoc.resolve_questions(questions, "key", facts), "contradictions": crossdoc.contradictions(facts)}
    return passes | {"facts": facts, "active": crossdoc.active_facts(facts), "stories": crossdoc.story(facts), "open_items": fold.open_items(events), "change_log": fold.change_log(events), "counters": fold.run_counters(events)}
