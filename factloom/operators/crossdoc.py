"""Passes over all facts of a project: resolved questions, contradictions, merging of areas, the grounding score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import lexicon as L
from factloom.config import CONFIG, Config
from factloom.functions import text as X
from factloom.operators import classify as C
from factloom.operators import ground as G


def active_facts(facts: DataFrame) -> DataFrame:
    return facts.where("superseded_by is null")


def _body() -> Column:
    return F.concat_ws(" ", "summary", "quote")


def resolve_questions(questions: DataFrame, key: str, facts: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(key, verdict, feature, ef_id, shared): the first active fact of the project that answers each open question.

    ``key`` is unique. Three shared topic words answer, or two if the question's numbers all occur in the fact. A question of fewer
    than two topic words has no answer; facts of the question's own call are no answers. "near" marks those with
    two shared words only, at most ``model_resolutions`` of which a model may be asked. First means the smallest
    (feature, ef_id). Pairs are formed by an equality join on a shared word.
    """
    text = F.coalesce("summary", "quote")
    q = questions.select(F.col(key).alias("k"), "project", F.col("source_id").alias("q_source"), X.topic_words(text).alias("qw"), X.numerals(text).alias("qn")).where(F.size("qw") >= 2)
    f = active_facts(facts).select("project", "feature", "ef_id", F.col("source_id").alias("f_source"), X.topic_words(_body()).alias("fw"), X.numerals(_body()).alias("fn"))
    # at least two words are shared, so the commonest one of a question needn't be joined on
    asked = G.but_commonest(q.withColumn("qw", F.transform("qw", lambda w: F.xxhash64(w))), "project", "k", "qw")
    told = f.withColumn("fw", F.transform("fw", lambda w: F.xxhash64(w))).select("project", "feature", "ef_id", "f_source", "fn", "fw", F.explode("fw").alias("_w"))
    met = asked.join(told.hint("merge"), ["project", "_w"]).where(~F.col("q_source").eqNullSafe(F.col("f_source"))).withColumn("shared", F.size(F.array_intersect("qw", "fw")).cast("long"))
    numbers = (F.size("qn") > 0) & (F.size(F.array_except("qn", "fn")) == 0)
    sure = (F.col("shared") >= config.resolve_words) | ((F.col("shared") >= config.resolve_words_with_number) & numbers)
    met = met.where(F.col("shared") >= config.resolve_words_with_number).withColumn("verdict", F.when(sure, "resolved").otherwise("near"))
    first = met.groupBy("k").agg(F.min(F.struct((F.col("verdict") != "resolved").alias("o"), "feature", "ef_id", "shared", "verdict")).alias("b"))
    return first.select(F.col("k").alias(key), F.col("b.verdict").alias("verdict"), F.col("b.feature").alias("feature"), F.col("b.ef_id").alias("ef_id"), F.col("b.shared").alias("shared"))


def contradictions(facts: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Pairs of active facts of a project that give different values of one unit on a shared point.

    At least two shared rare topic words (in at most ``rare_share`` of the project's active facts). Left out: quotes
    of which one contains the other, opposite bounds, rating scales, pairs linked by supersession. Equal facts
    (same summary and quote) are compared once, by their smallest (feature, ef_id). Candidate pairs are formed on
    pairs of rare words and the unit, so a single frequent word or unit never makes a group.
    Columns: project, feature_a, ef_a, feature_b, ef_b, unit, value_a, value_b, shared.
    """
    act = active_facts(facts).where("quote is not null").groupBy("project", "summary", "quote").agg(F.min(F.struct("feature", "ef_id")).alias("id"), F.count("*").alias("copies"))
    act = act.select("project", "summary", "quote", F.col("id.feature").alias("feature"), F.col("id.ef_id").alias("ef_id"), "copies")
    act = act.withColumns({"w": X.topic_words(_body()), "m": X.measures(_body()), "norm": X.normalise(F.col("quote")), "bound": C.has_bound(F.col("quote"))})
    n = act.groupBy("project").agg(F.sum("copies").alias("n"))
    df = act.select("project", "copies", F.explode("w").alias("word")).groupBy("project", "word").agg(F.sum("copies").alias("df"))
    rare = df.join(n, "project").where(F.col("df") <= F.col("n") * config.rare_share).select("project", "word")
    scale = X.folded(F.col("quote")).rlike(L.SCALE)
    side = act.where((F.size("m") > 0) & ~scale)
    words = side.select("project", "feature", "ef_id", F.explode("w").alias("word")).join(rare, ["project", "word"]).groupBy("project", "feature", "ef_id").agg(F.array_sort(F.collect_list("word")).alias("rare"))
    side = side.join(words, ["project", "feature", "ef_id"]).select("project", "feature", "ef_id", "m", "norm", "bound", "rare")
    two = F.flatten(F.transform("rare", lambda a, i: F.transform(F.slice("rare", i + 2, F.size("rare")), lambda b: F.xxhash64(a, b))))
    keyed = side.withColumn("unit", F.explode(F.array_distinct(F.transform("m", lambda x: x["unit"])))).select("project", "feature", "ef_id", "unit", F.explode(two).alias("pair"))
    # a key only one fact has makes no pair: drop it before rows travel
    busy = keyed.groupBy("project", "unit", "pair").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    keyed = keyed.join(busy, ["project", "unit", "pair"])
    a = keyed.select("project", "unit", "pair", F.struct("feature", "ef_id").alias("a"))
    b = keyed.select("project", "unit", "pair", F.struct("feature", "ef_id").alias("b"))
    met = a.join(b, ["project", "unit", "pair"]).where("a < b").select("project", "a", "b").distinct()
    left = side.select("project", F.struct("feature", "ef_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("m", "norm", "bound", "rare")])
    right = side.select("project", F.struct("feature", "ef_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("m", "norm", "bound", "rare")])
    met = met.join(left, ["project", "a"]).join(right, ["project", "b"])
    conflicts = F.filter(F.flatten(F.transform("m_a", lambda x: F.transform("m_b", lambda y: F.struct(x["unit"].alias("unit"), x["value"].alias("value_a"), y["value"].alias("value_b"), y["unit"].alias("other"))))), lambda z: (z["unit"] == z["other"]) & (z["value_a"] != z["value_b"]))
    met = met.withColumn("c", F.array_min(conflicts)).withColumn("shared", F.size(F.array_intersect("rare_a", "rare_b")))
    low, high = sorted(L.LOW_BOUNDS), sorted(L.HIGH_BOUNDS)
    opposite = (F.col("bound_a").isin(*low) & F.col("bound_b").isin(*high)) | (F.col("bound_a").isin(*high) & F.col("bound_b").isin(*low))
    met = met.where(F.col("c").isNotNull() & ~opposite & ~F.expr("contains(norm_a, norm_b) or contains(norm_b, norm_a)") & (F.col("shared") >= config.contradiction_words))
    return met.select("project", F.col("a.feature").alias("feature_a"), F.col("a.ef_id").alias("ef_a"), F.col("b.feature").alias("feature_b"), F.col("b.ef_id").alias("ef_b"), "c.unit", "c.value_a", "c.value_b", "shared")


def restated(statements: DataFrame, facts: DataFrame) -> DataFrame:
    """Statements whose normalised quote their area already records."""
    known = facts.select("project", "feature", X.normalise(F.col("quote")).alias("norm")).distinct()
    return statements.withColumn("norm", X.normalise(F.col("quote"))).join(known, ["project", "feature", "norm"], "left_semi")


def shares_no_word(statements: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """Keys of statements that share no merge word with any active fact of their area, no-change wording aside."""
    w = statements.where(~C.is_no_change(_body())).select(key, "project", "feature", X.merge_words(_body()).alias("w"))
    fw = active_facts(facts).select("project", "feature", F.explode(X.merge_words(_body())).alias("word")).distinct()
    met = w.select(key, "project", "feature", F.explode("w").alias("word")).join(fw, ["project", "feature", "word"], "left_semi").select(key).distinct()
    return w.select(key).distinct().join(met, key, "left_anti")


def best_targets(statements: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """(key, ef_id, overlap): the active fact of the area a statement would change, judged by wording.

    Words in more than half of an area's three or more active facts don't count. Two shared words are enough, ties
    to the larger id; one only if no other fact shares one.
    """
    act = active_facts(facts).select("project", "feature", "ef_id", X.merge_words(_body()).alias("w"))
    n = act.groupBy("project", "feature").agg(F.count("*").alias("n"))
    fw = act.select("project", "feature", "ef_id", F.explode("w").alias("word"))
    ambient = fw.groupBy("project", "feature", "word").agg(F.count("*").alias("df")).join(n, ["project", "feature"]).where("n > 2 and df * 2 > n").select("project", "feature", "word")
    fw = fw.join(ambient, ["project", "feature", "word"], "left_anti")
    sw = statements.select(key, "project", "feature", F.explode(X.merge_words(_body())).alias("word"))
    met = sw.join(fw, ["project", "feature", "word"]).groupBy(key, "ef_id").agg(F.count("*").alias("overlap"))
    best = met.groupBy(key).agg(F.max(F.struct("overlap", "ef_id")).alias("b"), F.count("*").alias("n_facts"))
    return best.where((F.col("b.overlap") >= 2) | (F.col("n_facts") == 1)).select(key, F.col("b.ef_id").alias("ef_id"), F.col("b.overlap").alias("overlap"))


def top_documents(questions: DataFrame, key: str, text: str, docs: DataFrame, doc: str, doc_text: str, config: Config = CONFIG) -> DataFrame:
    """(key, doc, overlap, rank): for each question the documents sharing most content words, the first ``top_documents``.

    Ties go to the smaller doc. Word sets are reduced to the questions' words before they meet.
    """
    q = questions.select(F.col(key).alias("k"), F.explode(X.content_words(F.col(text))).alias("w")).distinct()
    d = docs.select(F.col(doc).alias("d"), F.explode(X.content_words(F.col(doc_text))).alias("w")).join(q.select("w").distinct(), "w", "left_semi").distinct()
    met = q.join(d, "w").groupBy("k", "d").agg(F.count("*").alias("overlap"))
    r = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("overlap"), "d"))
    return met.withColumn("rank", r).where(F.col("rank") <= config.top_documents).select(F.col("k").alias(key), F.col("d").alias(doc), "overlap", "rank")


def merge_ids(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """project, feature, ef_id, target, new_id of the facts of merged areas: ids dealt anew over (member_no, ef_id) within the target."""
    g = groups.select("project", "feature", "target", "member_no").distinct()
    inside = facts.select("project", "feature", "ef_id").distinct().join(g, ["project", "feature"])
    per = inside.groupBy("project", "target", "member_no").agg(F.count("*").alias("n"))
    before = per.select("project", "target", "member_no", F.coalesce(F.sum("n").over(Window.partitionBy("project", "target").orderBy("member_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("project", "target", "member_no").orderBy("ef_id"))
    ids = inside.withColumn("own", own).join(before, ["project", "target", "member_no"])
    return ids.select("project", "feature", "ef_id", "target", (F.col("own") + F.col("before")).cast("int").alias("new_id"))


def _mapped(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """df with ``column`` mapped from old to new ids of its (project, feature); ids that are not mapped stay."""
    m = ids.select("project", "feature", F.col("ef_id").alias(column), F.col("new_id").alias("_new"))
    return df.join(m.hint("merge"), ["project", "feature", column], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def merge_areas(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Facts after areas were merged: groups(project, feature, target, member_no), the target itself among the members.

    superseded_by is mapped along; areas outside any group stay. Each fact is in the result once.
    """
    g = groups.select("project", "feature", "target").distinct()
    ids = merge_ids(facts, groups)
    moved = _mapped(_mapped(facts.join(g.select("project", "feature"), ["project", "feature"], "left_semi"), ids, "superseded_by"), ids, "ef_id")
    moved = moved.join(g.hint("merge"), ["project", "feature"]).withColumn("feature", F.col("target"))
    return facts.join(g.select("project", "feature"), ["project", "feature"], "left_anti").unionByName(moved.select(*facts.columns))


def merge_events(events: DataFrame, facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Events (questions and log) after the same merge: they follow their facts into the target, with the new ids. Repeated log lines count once."""
    g = groups.select("project", "feature", "target").distinct()
    ids = merge_ids(facts, groups)
    moved = _mapped(_mapped(events.join(g.select("project", "feature"), ["project", "feature"], "left_semi"), ids, "other_ef_id"), ids, "ef_id")
    moved = moved.join(g.hint("merge"), ["project", "feature"]).withColumn("feature", F.col("target")).select(*events.columns).distinct()
    return events.join(g.select("project", "feature"), ["project", "feature"], "left_anti").unionByName(moved)


def mergeable(facts: DataFrame, groups: DataFrame, explicit: bool = False) -> DataFrame:
    """Groups that may be merged: members share a word of name and first summary with the target, and at most one has several facts.

    An explicit merge is taken as it is. A group left with one member is dropped.
    """
    if explicit:
        return groups
    head = facts.groupBy("project", "feature").agg(F.min_by("summary", "ef_id").alias("s"), F.count("*").alias("n"))
    w = groups.join(head, ["project", "feature"]).withColumn("w", X.merge_words(F.concat_ws(" ", "feature", "s")))
    target = w.where("feature = target").select("project", "target", F.col("w").alias("tw"))
    kept = w.join(target, ["project", "target"]).where((F.col("feature") == F.col("target")) | F.arrays_overlap("w", "tw"))
    sizes = kept.groupBy("project", "target").agg(F.count("*").alias("members"), F.count_if(F.col("n") > 1).alias("large")).where("members >= 2 and large <= 1")
    return kept.join(sizes, ["project", "target"], "left_semi").select("project", "feature", "target", "member_no")


def grounding_score(facts: DataFrame, turns: DataFrame, config: Config = CONFIG) -> DataFrame:
    """One row: n_facts, n_superseded, n_quotes, n_grounded, n_fragments, passed. Quotes are sought in their own call."""
    q = facts.select("project", "feature", "ef_id", "source_id", "quote", "summary", "superseded_by").withColumn("k", F.concat_ws("\x01", "project", "feature", F.col("ef_id").cast("string")))
    found = G.verbatim_lines(q.where("quote is not null"), "k", "quote", G.line_norms(turns)).select("k", F.lit(True).alias("hit"))
    w = F.size(F.regexp_extract_all(F.coalesce("summary", F.lit("")), F.lit("[A-Za-z0-9']+"), F.lit(0)))
    out = q.join(found, "k", "left").agg(
        F.count("*").alias("n_facts"), F.count("superseded_by").alias("n_superseded"), F.count("quote").alias("n_quotes"), F.count("hit").alias("n_grounded"), F.count_if(w < config.fragment_words).alias("n_fragments"),
    )
    return out.withColumn("passed", F.col("n_quotes") == F.col("n_grounded"))


def invented_stamps(facts: DataFrame, untimed: DataFrame) -> DataFrame:
    """Facts that carry a time although their call, listed in ``untimed``(source_id), has none."""
    return facts.where(X.clock_millis(F.col("ts")).isNotNull()).join(untimed.select("source_id").distinct(), "source_id", "left_semi")


def story(facts: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(project, feature, story): current summaries as one sentence, the first ``story_facts`` by id and a count of the rest.

    Only these summaries of an area are gathered, so the row stays small however many facts there are.
    """
    act = active_facts(facts)
    clause = F.regexp_replace(F.rtrim(X.destub(F.btrim(F.coalesce("summary", F.lit("")))), F.lit(" .;")), r"\s*[;\n]\s*", ", ")
    n = act.groupBy("project", "feature").agg(F.count("*").alias("n"))
    top = act.withColumn("r", F.row_number().over(Window.partitionBy("project", "feature").orderBy("ef_id"))).where(F.col("r") <= config.story_facts).withColumn("c", clause).where("c <> ''")
    got = top.groupBy("project", "feature").agg(F.array_sort(F.collect_list(F.struct("r", "c"))).alias("cs")).join(n, ["project", "feature"])
    lead = lambda c: F.element_at(F.split(c, " "), 1)
    acronym = lambda c: (F.length(lead(c)) > 1) & (F.upper(lead(c)) == lead(c))
    small = lambda c: F.when(acronym(c), c).otherwise(F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c))))
    joined = F.array_join(F.transform("cs", lambda x, i: F.when(i == 0, x["c"]).otherwise(small(x["c"]))), "; ")
    more = F.col("n") - F.size("cs")
    return got.select("project", "feature", F.concat(joined, F.when(more > 0, F.concat(F.lit("; plus "), more.cast("string"), F.lit(" more (see Established Facts)"))).otherwise(""), F.lit(".")).alias("story"))


def plain_story(facts: DataFrame) -> DataFrame:
    """(project, feature, story): all current summaries, joined; for areas known to be small."""
    act = active_facts(facts)
    got = act.groupBy("project", "feature").agg(F.array_sort(F.collect_list(F.struct("ef_id", F.rtrim(F.coalesce("summary", F.lit("")), F.lit(".")).alias("s")))).alias("cs"))
    return got.select("project", "feature", F.concat(F.array_join(F.transform("cs", lambda x: x["s"]), "; "), F.lit(".")).alias("story"))


def clean_story(col: Column) -> Column:
    """A model's story without outer quotes and lead-ins."""
    s = F.btrim(F.btrim(F.btrim(col), F.lit('"')))
    return F.btrim(F.regexp_replace(s, r"(?i)^(?:sure,[^:]*:|sure,|here(?: is|'s)[^:]*:|user story:|story:|summary:)\s*", ""))


def constrain_role(story_col: Column, fact_text: Column) -> Column:
    """"As a user" where the story's role is not a word of the facts."""
    p = r"(?i)^\s*as an?\s+([a-z][a-z ]{1,20}?)([,\s])"
    role = F.rtrim(F.element_at(F.split(F.lower(F.btrim(F.regexp_extract(story_col, p, 1))), " "), -1), F.lit("s"))
    wrong = story_col.rlike(p) & (role != "") & (role != "user") & ~F.contains(F.lower(fact_text), role)
    return F.when(wrong, F.regexp_replace(story_col, p, "As a user$2")).otherwise(story_col)


def story_problem(stories: DataFrame, facts: DataFrame) -> DataFrame:
    """(project, feature, problem): an invented number or name, or facts left out; null if the story will do."""
    act = active_facts(facts).select("project", "feature", "ef_id", "summary", _body().alias("body"))
    text = act.groupBy("project", "feature").agg(F.flatten(F.collect_set(X.story_numbers(F.col("body")))).alias("nums"), F.array_distinct(F.flatten(F.collect_set(X.words(F.col("body"))))).alias("said"), F.count("*").alias("n"))
    s = stories.join(text, ["project", "feature"]).withColumn("sw", X.content_words(F.col("story")))
    number = F.size(F.array_except(X.story_numbers(F.col("story")), F.col("nums"))) > 0
    glue = sorted(L.STORY_GLUE)
    inner = F.regexp_extract_all("story", F.lit(r"[^.!?:;\s]\s+([A-Z][A-Za-z]{2,}|[A-Z]{3,})"), F.lit(1))
    names = F.filter(F.transform(inner, lambda w: F.lower(w)), lambda w: ~w.isin(*glue))
    known = F.array_union("said", X.words(F.col("feature")))
    s = s.withColumn("name", F.try_element_at(F.array_except(names, known), F.lit(1)))
    fw = act.select("project", "feature", "ef_id", F.filter(X.content_words(F.col("summary")), lambda w: ~w.isin(*glue)).alias("w"))
    df = fw.select("project", "feature", F.explode("w").alias("word")).groupBy("project", "feature", "word").agg(F.count("*").alias("df")).join(text.select("project", "feature", "n"), ["project", "feature"])
    distinct = fw.select("project", "feature", "ef_id", F.explode("w").alias("word")).join(df.where("not (n > 2 and df * 2 > n)").select("project", "feature", "word"), ["project", "feature", "word"])
    met = distinct.join(s.select("project", "feature", "sw"), ["project", "feature"]).groupBy("project", "feature", "ef_id").agg(F.max(F.array_contains("sw", F.col("word"))).alias("met"))
    missed = met.groupBy("project", "feature").agg(F.count_if(~F.col("met")).alias("missed"))
    out = s.join(missed, ["project", "feature"], "left").withColumn("missed", F.coalesce("missed", F.lit(0)))
    left_out = (F.col("missed") >= 2) | ((F.col("missed") >= 1) & (F.col("n") <= 3))
    return out.select("project", "feature", F.when(number, "invented number").when(F.col("name").isNotNull(), F.concat(F.lit("invented proper noun: "), F.col("name"))).when(left_out, F.concat(F.lit("leaves "), F.col("missed").cast("string"), F.lit(" fact(s) out"))).alias("problem"))


def filter_gaps(gaps: DataFrame, facts: DataFrame, existing: DataFrame, config: Config = CONFIG, used: DataFrame | None = None) -> DataFrame:
    """Usable gap questions, two per area over its whole life, those of ``used``(project, feature, n_gaps) counted: gaps(project, feature, gap_no, question, refs array<int>), existing(project, feature, text).

    Kept: some cited fact is active; shares a word with the area's facts; adds one to the cited facts; doesn't ask for
    a limit they state; isn't boilerplate; shares fewer than two topic words with an item already open.
    """
    act = active_facts(facts).select("project", "feature", "ef_id", "summary", _body().alias("body"))
    glue = sorted(L.STORY_GLUE)
    g = gaps.withColumn("qw", F.filter(X.content_words(F.col("question")), lambda w: ~w.isin(*glue))).where(~C.is_vague_gap(F.col("question")))
    cited = g.select("project", "feature", "gap_no", F.explode("refs").alias("ef_id")).join(act, ["project", "feature", "ef_id"]).groupBy("project", "feature", "gap_no").agg(F.concat_ws(" ", F.sort_array(F.collect_list("body"))).alias("cited"), F.sort_array(F.collect_set("ef_id")).alias("valid"))
    g = g.join(cited, ["project", "feature", "gap_no"])
    g = g.where((F.size(F.array_except("qw", X.content_words(F.col("cited")))) > 0) & ~(X.folded(F.col("question")).rlike(L.LIMIT_QUESTION) & X.folded(F.col("cited")).rlike(L.STATED_RANGE)))
    vocabulary = act.select("project", "feature", F.explode(X.content_words(F.col("summary"))).alias("w")).distinct()
    near = g.select("project", "feature", "gap_no", F.explode("qw").alias("w")).join(vocabulary, ["project", "feature", "w"], "left_semi").select("project", "feature", "gap_no").distinct()
    items = existing.select("project", "feature", F.col("text").alias("item"), F.explode(X.merge_words(F.col("text"))).alias("w"))
    topic = g.select("project", "feature", "gap_no", F.explode(X.merge_words(F.col("question"))).alias("w")).join(items, ["project", "feature", "w"]).groupBy("project", "feature", "gap_no", "item").agg(F.count("*").alias("n")).where("n >= 2")
    g = g.join(near, ["project", "feature", "gap_no"], "left_semi").join(topic.select("project", "feature", "gap_no").distinct(), ["project", "feature", "gap_no"], "left_anti")
    g = g.groupBy("project", "feature", F.lower("question").alias("low")).agg(F.min_by(F.struct("gap_no", "question", "valid"), "gap_no").alias("x")).select("project", "feature", "x.*")
    g = g.withColumn("n_gaps", F.lit(0).cast("long")) if used is None else g.join(used.select("project", "feature", "n_gaps"), ["project", "feature"], "left")
    r = F.row_number().over(Window.partitionBy("project", "feature").orderBy("gap_no"))
    return g.withColumn("r", r).where(F.col("r") + F.coalesce("n_gaps", F.lit(0)) <= config.top_gaps).select("project", "feature", "question", F.col("valid").alias("refs"))
