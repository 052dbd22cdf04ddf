"""The reconcile state machine: statements of one feature area folded into its versioned facts, in order.

Everything that concerns one row alone (normal forms, word sets, numbers, wording tests, repaired summaries)
is computed by column expressions beforehand, and what needs no state (quotes on record) is resolved by joins;
the fold itself is a pure function over small records. It emits events only; facts, open items, the change
log and counters are projections of the events.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import text as X
from factloom.operators import classify as C
from factloom.runtime import checkpoint


@dataclass
class Row:
    """A statement or a recorded fact, with its precomputed features."""

    summary: str
    quote: str
    source_id: str
    norm: str = ""
    words: frozenset = frozenset()
    numbers: frozenset = frozenset()
    numerals: frozenset = frozenset()
    multipart: bool = False
    no_change: bool = False
    kind: str = "fact"
    verified: bool = True
    speaker: str | None = None
    ts: str | None = None
    call_date: object = None
    seq: int = 0
    ef_id: int = 0
    superseded_by: int | None = None


@dataclass
class Verdict:
    verdict: str
    target: int | None = None
    reason: str = ""


class Active(Sequence):
    """The active facts of an area in order, indexed by word, so that a statement meets only facts it shares words with."""

    def __init__(self, rows: Iterable[Row] = ()) -> None:
        self.rows: dict[int, Row] = {}
        self.places: dict[int, int] = {}
        self.by_word: dict[str, set[int]] = {}
        self.by_id: dict[int, Row] = {}
        self.next = 0
        for r in rows:
            self.add(r)

    def add(self, row: Row) -> None:
        self.rows[self.next], self.places[id(row)] = row, self.next
        for w in row.words:
            self.by_word.setdefault(w, set()).add(self.next)
        self.by_id.setdefault(row.ef_id, row)
        self.next += 1

    def remove(self, row: Row) -> None:
        at = self.places.pop(id(row))
        del self.rows[at]
        for w in row.words:
            self.by_word[w].discard(at)
        if self.by_id.get(row.ef_id) is row:
            del self.by_id[row.ef_id]

    def shares_word(self, words: Iterable[str]) -> bool:
        return any(self.by_word.get(w) for w in words)

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self):
        return iter(self.rows.values())

    def __getitem__(self, i):
        return list(self.rows.values())[i]


@dataclass
class Ledger:
    """The facts of one area while statements arrive."""

    facts: list[Row]
    verdict_of: Callable[[Row, list[Row]], Verdict]
    known_questions: set = field(default_factory=set)
    events: list[dict] = field(default_factory=list)
    asked: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.quotes = {f.norm for f in self.facts}
        self.last_id = max((f.ef_id for f in self.facts), default=0)
        self.active = Active(f for f in self.facts if f.superseded_by is None)

    def record(self, f: Row) -> None:
        """A fact that was there before."""
        self.facts.append(f)
        self.quotes.add(f.norm)
        self.last_id = max(self.last_id, f.ef_id)
        if f.superseded_by is None:
            self.active.add(f)

    def emit(self, event: str, s: Row, ef_id: int | None = None, other: int | None = None, reason: str = "", was: str | None = None, adds: bool = False) -> None:
        self.events.append({
            "event_type": event, "ef_id": ef_id, "other_ef_id": other, "kind": s.kind, "summary": s.summary, "quote": s.quote, "speaker": s.speaker, "ts": s.ts, "source_id": s.source_id, "call_date": s.call_date,
            "reason": reason, "was_quote": was, "now_quote": s.quote if was is not None else None, "adds_fact": adds, "seq": len(self.events) + 1,
        })

    def add(self, s: Row) -> int:
        self.last_id += 1
        s.ef_id, s.superseded_by = self.last_id, None
        self.facts.append(s)
        self.active.add(s)
        self.quotes.add(s.norm)
        return s.ef_id

    def take(self, s: Row) -> None:
        if s.kind == "question":
            return self.take_question(s)
        if not s.verified:
            return self.emit("unverified", s)
        if s.norm in self.quotes:
            return self.emit("restated", s, reason="the quote is recorded")
        active = self.active
        if not active:
            if s.no_change:
                return self.emit("dropped", s, reason="confirms what is not recorded")
            return self.emit("new", s, self.add(s), adds=True)
        if not s.no_change and not active.shares_word(s.words):
            return self.emit("new", s, self.add(s), adds=True)
        v = self.verdict_of(s, active)
        target = active.by_id.get(v.target)
        if v.verdict == "NEW":
            return self.emit("new", s, self.add(s), reason=v.reason, adds=True)
        if v.verdict == "DUPLICATE" and target:
            return self.emit("restated", s, other=target.ef_id, reason=v.reason)
        if v.verdict == "CHANGE" and target:
            return self.change(s, target, v.reason)
        if s.no_change:
            return self.emit("restated", s, reason="re-confirmed")
        return self.emit("review", s, reason=v.reason or "unclear")

    def take_question(self, s: Row) -> None:
        long = len(s.norm) >= 20
        again = long and s.norm in self.known_questions or s.norm in self.asked
        again = again or any(min(len(s.norm), len(q)) >= 20 and (s.norm in q or q in s.norm) for q in self.asked)
        if again:
            return self.emit("asked_again", s)
        self.asked.append(s.norm)
        return self.emit("question", s)

    def change(self, s: Row, target: Row, reason: str) -> None:
        if s.no_change and not s.numbers - target.numbers:
            return self.emit("restated", s, other=target.ef_id, reason="re-confirmed")
        same_call = s.source_id == target.source_id
        aim = best_target(s.words, self.active)
        if aim is None and s.words & target.words:
            aim = target
        new_id = self.add(s)
        if same_call:
            return self.emit("new", s, new_id, target.ef_id, "complements it, same call", adds=True)
        if aim is None:
            return self.emit("review", s, new_id, target.ef_id, "no shared wording", adds=True)
        if aim.multipart and len(s.numerals & aim.numerals) < len(aim.numerals):
            return self.emit("review", s, new_id, aim.ef_id, "updates part of it", adds=True)
        self.active.remove(aim)
        aim.superseded_by = new_id
        note = reason if aim is target else f"re-aimed from {target.ef_id}"
        return self.emit("changed", s, new_id, aim.ef_id, note, was=aim.quote, adds=True)


def best_target(words: frozenset, active: Sequence[Row]) -> Row | None:
    """The active fact that shares most words, those in more than half of three or more facts aside.

    Two shared words are enough, ties to the larger id; a single one only if no other fact shares one.
    """
    held = active if isinstance(active, Active) else Active(active)
    met: Counter[int] = Counter()
    for w in words:
        at = held.by_word.get(w, ())
        if len(held) <= 2 or len(at) * 2 <= len(held):
            met.update(at)
    if not met:
        return None
    best = max(met, key=lambda k: (met[k], held.rows[k].ef_id, -k))
    return held.rows[best] if met[best] >= 2 or len(met) == 1 else None


def fold(facts: list[Row], statements: Iterable[Row], verdict_of: Callable[[Row, list[Row]], Verdict], known_questions: set | None = None) -> list[dict]:
    """Events of statements folded into facts, in the order of ``seq``. Neither input list is changed."""
    from copy import copy

    ledger = Ledger([copy(f) for f in facts], verdict_of, set(known_questions or ()))
    for s in sorted(statements, key=lambda s: s.seq):
        ledger.take(copy(s))
    return ledger.events


EVENT_COLUMNS = [c.split()[0] for c in schemas.EVENTS.split(", ")]
FEATURES = ["norm", "words", "numbers", "numerals", "multipart", "no_change"]


def with_features(df: DataFrame) -> DataFrame:
    """Adds the columns the fold needs of each row."""
    both = F.concat_ws(" ", "summary", "quote")
    df = df.drop(*FEATURES)
    return df.select(
        "*", F.coalesce(X.normalise(F.col("quote")), F.lit("")).alias("norm"), X.merge_words(both).alias("words"), X.digit_numbers(F.col("quote")).alias("numbers"), X.numerals(F.col("quote")).alias("numerals"),
        X.is_multipart(F.col("quote")).alias("multipart"), C.is_no_change(both).alias("no_change"),
    )


def _rows(pdf: pd.DataFrame, seq: str) -> list[Row]:
    out = []
    for r in pdf.to_dict("records"):
        none = lambda x: None if x is None or x is pd.NaT or x != x else x
        out.append(Row(
            summary=none(r["summary"]) or "", quote=none(r["quote"]) or "", source_id=r["source_id"], norm=r["norm"], words=frozenset(r["words"]), numbers=frozenset(r["numbers"]), numerals=frozenset(r["numerals"]),
            multipart=bool(r["multipart"]), no_change=bool(r["no_change"]), kind=none(r.get("kind")) or "fact", verified=bool(r.get("verified", True)), speaker=none(r["speaker"]), ts=none(r["ts"]), call_date=none(r["call_date"]),
            seq=int(none(r.get(seq)) or 0), ef_id=int(none(r.get("ef_id")) or 0), superseded_by=None if none(r.get("superseded_by")) is None else int(r["superseded_by"]),
        ))
    return out


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "date": pa.date32()}
_ARROW_EVENTS = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schemas.EVENTS.split(", ")])
_PLACE = ["seq", "speaker", "ts", "source_id", "call_date"]
_FACT_COLUMNS = ["project", "feature", "ef_id", "superseded_by", "summary", "quote", "speaker", "ts", "source_id", "call_date", *FEATURES]


def _each(wordings: DataFrame, event: str, reason: str) -> DataFrame:
    """An event without fact for each place of the wordings."""
    each = wordings.select("project", "feature", "kind", "summary", "quote", F.explode("places").alias("p")).select("*", "p.*")
    set_ = {"event_type": F.lit(event), "ef_id": F.lit(None).cast("int"), "other_ef_id": F.lit(None).cast("int"), "reason": F.lit(reason), "was_quote": F.lit(None).cast("string"), "now_quote": F.lit(None).cast("string"), "adds_fact": F.lit(False)}
    return each.withColumns(set_).select(*schemas._schema(schemas.EVENTS).names)


def fold_events(statements: DataFrame, facts: DataFrame, verdict_of: Callable[[Row, list[Row]], Verdict], asked: DataFrame | None = None) -> DataFrame:
    """Events (schema EVENTS) of statements folded into the recorded facts of their (project, feature).

    statements: project, feature, seq (orders them within the area), kind, summary, quote, speaker, ts, source_id,
    call_date, verified. Statements without area or project are left out; a missing kind is a fact, a missing
    verified is unverified. Facts and statements of one area are sequential by nature. Quotes of recorded facts
    are restated whatever comes, so they are taken out by a join before the fold. Whether another repetition is
    restated depends on what became of those before it, so the fold takes it. Rows come to the fold sorted by area and
    order, and go through it one by one: many small areas share a task, and of a large one only its ledger is held.
    ``asked``(project, quote) are questions on record anywhere in the
    project: those of 20 characters or more are not asked again.
    """
    s = statements.where("project is not null and feature is not null and quote is not null")
    s = s.withColumns({"kind": F.coalesce("kind", F.lit("fact")), "verified": F.coalesce("verified", F.lit(False))})
    s = s.withColumn("summary", F.when(F.col("kind") == "question", F.col("summary")).otherwise(X.repair_summary(F.col("summary"), F.col("quote"))))
    s = s.groupBy("project", "feature", "kind", "verified", "summary", "quote").agg(F.collect_list(F.struct(*_PLACE)).alias("places"))
    s = with_features(s)
    near = facts.where("project is not null and feature is not null").join(s.select("project", "feature").distinct().hint("merge"), ["project", "feature"], "left_semi")
    f = with_features(near).select(*_FACT_COLUMNS)
    recorded = f.select("project", "feature", "norm").distinct().withColumn("known", F.lit(True))
    marked = checkpoint(s.join(recorded, ["project", "feature", "norm"], "left"))  # read by every branch below
    repeated = (F.col("kind") != "question") & F.col("verified") & F.coalesce("known", F.lit(False))
    again = _each(marked.where(repeated), "restated", "the quote is recorded")
    todo = marked.where(~repeated).drop("known")
    if asked is not None:
        on_record = asked.select("project", X.normalise(F.col("quote")).alias("norm")).where(F.length("norm") >= 20).distinct()
        questions = todo.where("kind = 'question'")
        again = again.unionByName(_each(questions.join(on_record, ["project", "norm"], "left_semi"), "asked_again", "the question is recorded"))
        todo = todo.where("kind <> 'question'").unionByName(questions.join(on_record, ["project", "norm"], "left_anti").select(*todo.columns))
    rows = todo.select("*", F.explode("places").alias("_p")).select("project", "feature", F.lit(1).alias("src"), "_p.seq", "kind", "verified", "summary", "quote", "_p.speaker", "_p.ts", "_p.source_id", "_p.call_date", F.lit(0).alias("ef_id"), F.lit(None).cast("int").alias("superseded_by"), *FEATURES)
    old = f.select("project", "feature", F.lit(0).alias("src"), F.col("ef_id").cast("long").alias("seq"), F.lit("fact").alias("kind"), F.lit(True).alias("verified"), "summary", "quote", "speaker", "ts", "source_id", "call_date", "ef_id", "superseded_by", *FEATURES)
    ordered = rows.unionByName(old).repartition("project", "feature").sortWithinPartitions("project", "feature", "src", "seq", "quote")
    folded = ordered.mapInArrow(_folder(verdict_of), schemas._schema(schemas.EVENTS))
    return folded.unionByName(again)


def _folder(verdict_of: Callable[[Row, list[Row]], Verdict]):
    """The fold over batches of rows sorted by project, feature, src (facts first) and seq."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        area, ledger = None, None
        for batch in batches:
            out: dict[str, list] = {c: [] for c in EVENT_COLUMNS}
            for r in batch.to_pylist():
                if (r["project"], r["feature"]) != area:
                    area, ledger = (r["project"], r["feature"]), Ledger([], verdict_of)
                row = Row(
                    summary=r["summary"] or "", quote=r["quote"] or "", source_id=r["source_id"], norm=r["norm"], words=frozenset(r["words"]), numbers=frozenset(r["numbers"]), numerals=frozenset(r["numerals"]), multipart=bool(r["multipart"]),
                    no_change=bool(r["no_change"]), kind=r["kind"], verified=r["verified"], speaker=r["speaker"], ts=r["ts"], call_date=r["call_date"], seq=r["seq"] or 0, ef_id=r["ef_id"], superseded_by=r["superseded_by"],
                )
                if r["src"] == 0:
                    ledger.record(row)
                    continue
                ledger.take(row)
                event = ledger.events.pop() | {"project": area[0], "feature": area[1], "seq": row.seq}  # one event a statement
                for c in EVENT_COLUMNS:
                    out[c].append(event[c])
            yield pa.RecordBatch.from_pydict(out, schema=_ARROW_EVENTS)

    return run


def facts_after(facts: DataFrame, events: DataFrame) -> DataFrame:
    """The facts table after the events: old facts with their successors, and added ones. Nothing is deleted."""
    gone = events.where("event_type = 'changed'").select("project", "feature", F.col("other_ef_id").alias("ef_id"), F.col("ef_id").alias("by"))
    new = events.where("adds_fact").select("project", "feature", "ef_id", F.lit(None).cast("int").alias("superseded_by"), "summary", "quote", "speaker", "ts", "source_id", "call_date")
    every = facts.select(*new.columns).unionByName(new)
    return every.join(gone, ["project", "feature", "ef_id"], "left").withColumn("superseded_by", F.coalesce("superseded_by", "by")).drop("by")


def run_counters(events: DataFrame) -> DataFrame:
    """The six counts of a run per area."""
    e = F.col("event_type")
    names = {"n_new": e == "new", "n_changed": e == "changed", "n_restated": e == "restated", "n_review": e == "review", "n_unverified": e == "unverified", "n_open": e == "question"}
    return events.groupBy("project", "feature").agg(*[F.count_if(test).alias(n) for n, test in names.items()])


def change_log(events: DataFrame) -> DataFrame:
    """The append-only log: everything that was not merely dropped, with was and now of changes."""
    return events.where("event_type not in ('dropped', 'asked_again')").select("project", "feature", "seq", F.col("call_date").alias("event_date"), "source_id", "event_type", "ef_id", "other_ef_id", "reason", "was_quote", "now_quote")


def open_items(events: DataFrame) -> DataFrame:
    """Open questions, unverified citations and items to review; questions that were answered carry another tag and a pointer."""
    tags = {"question": "OPEN QUESTION", "unverified": "UNVERIFIED CITATION", "review": "NEEDS REVIEW"}
    tag = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    q = events.where(F.col("event_type").isin(*tags)).withColumn("_n", X.normalise(F.col("quote")))
    done = events.where("event_type = 'resolved'").groupBy("project", "feature", "source_id", X.normalise(F.col("quote")).alias("_n")).agg(F.min("reason").alias("_by")).withColumn("event_type", F.lit("question"))
    q = q.join(done.hint("merge"), ["project", "feature", "source_id", "_n", "event_type"], "left")
    body = F.when(F.col("_by").isNotNull(), F.concat(F.coalesce("summary", F.lit("")), F.lit(" (answered by "), "_by", F.lit(")"))).otherwise(F.col("summary"))
    return q.select("project", "feature", F.concat_ws("-", F.lit("Q"), F.col("call_date").cast("string"), "source_id", X.slug(F.col("feature")), F.col("seq").cast("string")).alias("q_id"), F.when(F.col("_by").isNotNull(), "RESOLVED").otherwise(F.try_element_at(tag, F.col("event_type"))).alias("tag"), body.alias("summary"), "quote", "speaker", "source_id", "call_date", F.array_compact(F.array("ef_id", "other_ef_id")).alias("refs"))


def version_chain(facts: DataFrame) -> DataFrame:
    """project, feature, ef_id, next_id, is_active, and whether the successor exists and is later."""
    f = facts.select("project", "feature", "ef_id", "superseded_by").distinct()
    nxt = f.select("project", "feature", F.col("ef_id").alias("superseded_by"), F.lit(True).alias("found"))
    out = f.join(nxt, ["project", "feature", "superseded_by"], "left")
    return out.select("project", "feature", "ef_id", F.col("superseded_by").alias("next_id"), F.col("superseded_by").isNull().alias("is_active"), (F.col("superseded_by").isNull() | (F.coalesce("found", F.lit(False)) & (F.col("superseded_by") > F.col("ef_id")))).alias("is_sound"))


def number_facts(facts: DataFrame, existing: DataFrame) -> DataFrame:
    """ef_id of new facts: the area's largest id plus the rank by seq. Ranks are counted per (area, source) first."""
    top = existing.groupBy("project", "feature").agg(F.max("ef_id").alias("top"))
    per = facts.groupBy("project", "feature", "source_id").agg(F.count("*").alias("n"), F.min("seq").alias("lo"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("project", "feature").orderBy("lo", "source_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = facts.withColumn("r", F.row_number().over(Window.partitionBy("project", "feature", "source_id").orderBy("seq")))
    out = ranked.join(before.select("project", "feature", "source_id", "before"), ["project", "feature", "source_id"]).join(top, ["project", "feature"], "left")
    return out.withColumn("ef_id", (F.coalesce("top", F.lit(0)) + F.col("before") + F.col("r")).cast("int")).drop("r", "before", "top")
