"""Problem 2: transcript lines to clean, ordered speaker turns.

Each line goes through a finite-state parser: TIME (in ts, else at the start of the text), then LABEL (in
speaker, else before a colon at the start of the text), then BODY. The body loses sound annotations and
standalone fillers. Labels are resolved per call against its attendees by equality joins on name keys.
Consecutive lines of one speaker are merged in line order by a two-level scan: windows within blocks of
lines, then over one summary row per block, so a call of any length is spread over many tasks.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.lookalike import transducer
from factloom.llm.names import NICKNAMES, NUMBERED, UNKNOWN_VOICE, bare, fold, full_forms
from factloom.runtime import checkpoint

BLOCK_LINES = 5000
COST_UNIT = 1000
"""Steps of a fit's cost that count as different."""

# Sounds that transcribers write in brackets, and sounds of hesitation.
SOUNDS = "laugh\\w*|music\\w*|noise|cough\\w*|sigh\\w*|typing|types|doors?|phone|crosstalk|cross-talk|inaudible|unintelligible|indistinct|beep\\w*|applause|clapp\\w*|chatter|background|throat|silence|pause\\w*|static|bell|rings?|ringing|sneez\\w*|whisper\\w*|breath\\w*|sniff\\w*|gasp\\w*|chuckl\\w*|giggl\\w*|groan\\w*|yawn\\w*|whistl\\w*|bark\\w*|knock\\w*|rustl\\w*|click\\w*|click|hum\\w*|cheer\\w*|cr(?:y|ies|ying)|footsteps|echo|feedback|blank_audio|no audio"
HESITATION = "u+m+|u+h+m*|e+r+m*|a+h+|e+h+|h+m+|m+|m+-?h+m+|uh-?huh|mhm|huh|oh"
_ANNOTATION = re.compile(rf"\(\([^()]*\)\)|[\[({{<*][^\[\](){{}}<>*]*\b(?:{SOUNDS})\b[^\[\](){{}}<>*]*[\])}}>*]|♪[^♪\n]*♪|♪+", re.I)
_FILLER = re.compile(rf"(?<![\w'’-])(?:{HESITATION}|(?:you know|i mean)(?=\s*(?:,|\.\.\.|…)))(?![\w'’]|-\w)\s*(?:\.\.\.|…|[,—–-]+)?\s*", re.I)
_ONLY_FILLER = re.compile(rf"\b(?:{HESITATION}|you know|i mean)\b", re.I)
_FIRST_WORD = re.compile(r"[^\w\[({<*♪]*([^\W_]+)")
_CLOCK = r"(?:(\d{1,3}):)?(\d{1,3}):(\d{2})(?:[.,](\d{1,6}))?"
_TS = re.compile(rf"^\W*{_CLOCK}(?:\s*-+>\s*.*)?\W*$")
_TS_SECONDS = re.compile(r"^\W*(\d+)(?:[.,]\d+)?\s*s(?:ec(?:onds?)?)?\W*$", re.I)
_HEAD_TIME = re.compile(rf"^\s*(?:[\[(]\s*{_CLOCK}\s*[\])]|(\d{{1,2}}):(\d{{2}}):(\d{{2}})(?:[.,]\d{{1,6}})?(?=\s))(?:\s*-+>\s*[\[(]?[\d:.,]+[\])]?)?\s*[-–]?\s*")
_HEAD_VOICE = re.compile(r"^\s*<v(?:\.\S+)?\s*([^>]*)>\s*")
_HEAD_LABEL = re.compile(r"^\s*([*_]{0,2}[^\s:*_][^:\n]{0,59}?)[*_]{0,2}\s*:(?:[*_]{2})?\s+(?=\S)|^\s*([*_]{0,2}[^\s:*_][^:\n]{0,59}?)[*_]{0,2}\s*:(?:[*_]{2})?\s*$")

PARSED = T.StructType([
    T.StructField("sec", T.LongType()), T.StructField("label", T.StringType()), T.StructField("from_text", T.BooleanType()),
    T.StructField("noise", T.BooleanType()), T.StructField("body", T.StringType()), T.StructField("headless", T.StringType()),
])


def seconds(ts: str | None) -> int:
    """Whole seconds of a clock time, a cue range or a count of seconds; -1 if it is none."""
    if not ts:
        return -1
    if m := _TS.match(ts):
        return int(m.group(1) or 0) * 3600 + int(m.group(2)) * 60 + int(m.group(3))
    if m := _TS_SECONDS.match(ts):
        return int(m.group(1))
    return -1


def clean(body: str) -> str:
    """The body without sound annotations and standalone fillers, with single spaces and a capital first letter."""
    out = _ANNOTATION.sub(" ", body)
    out = _FILLER.sub("", out)
    out = re.sub(r"[^\S\n]+", " ", out)
    out = re.sub(r" +([,.;:!?])", r"\1", out).strip()
    return out[:1].upper() + out[1:] if out and body.strip()[:1].isupper() else out


def is_noise(body: str) -> bool:
    first = _FIRST_WORD.match(body)
    if first and not _ONLY_FILLER.match(first.group(1)) and first.group(1).lower() not in ("you", "i"):
        return False  # a word of content stands before anything in brackets
    rest = _ONLY_FILLER.sub(" ", _ANNOTATION.sub(" ", body))
    return not any(c.isalnum() for c in rest)


def parse_line(ts: str | None, speaker: str | None, text: str | None, want_text: bool) -> tuple:
    form = transducer().form
    sec = seconds(form(ts))
    label = None if speaker is None or not speaker.strip() else form(speaker)
    if text is None:
        return sec, label, False, True, None, None
    body, from_text, headless = form(text), False, None
    lead = body.lstrip()[:1]  # the patterns below need these characters
    if (lead.isdigit() or lead in ("[", "(")) and (m := _HEAD_TIME.match(body)):  # TIME
        if sec < 0:
            sec = seconds(re.split(r"-+>", m.group())[0].strip(" -–"))
        body = body[m.end():]
    if body.lstrip()[:1] == "<" and (m := _HEAD_VOICE.match(body)):  # LABEL, as a voice tag
        body = re.sub(r"</v>\s*$", "", body[m.end():])
        if label is None:
            label, from_text = f"<v {m.group(1)}>", False
    elif ":" in body and (m := _HEAD_LABEL.match(body)):  # LABEL, before a colon
        head = (m.group(1) or m.group(2)).strip()
        if label is None and len(head.split()) <= 6:
            label, from_text, headless = head, True, body[m.end():]
        elif label is not None and fold(bare(head)) == fold(bare(label)):
            body = body[m.end():]
    noise = is_noise(headless if from_text else body)
    if not want_text:
        return sec, label, from_text, noise, None, None
    return sec, label, from_text, noise, clean(body), None if headless is None else clean(headless)


def _parser(want_text: bool):
    @F.pandas_udf(PARSED)
    def parse(ts: pd.Series, speaker: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = [parse_line(*(None if x is None or x != x else x for x in row), want_text) for row in zip(ts, speaker, text)]
        return pd.DataFrame(rows, columns=PARSED.names)

    return parse


def _shorter(word: str) -> set[str]:
    """The word and the word without any one letter: words one edit or swap apart share one of these."""
    return {word} | {word[:i] + word[i + 1:] for i in range(len(word))} if len(word) >= 4 else {word}


@functools.lru_cache(maxsize=100_000)
def name_keys(label: str | None) -> list[str]:
    """Keys of a typed label. Two names can mean the same person only if they share one."""
    if label is None:
        return []
    if m := NUMBERED.match(label.strip(" :*<>[]")):
        return [f"#{int(m.group(1))}"]
    name = bare(label)
    if UNKNOWN_VOICE.match(name):
        return []
    words = re.findall(r"[^\W_]+", fold(name))
    if not words:
        return []
    keys = set()
    if len(words) == 1:
        keys |= {f"i:{words[0]}"} if 2 <= len(words[0]) <= 4 else set()
    for w in words:
        if len(w) > 1:
            keys |= {f"w:{x}" for x in _shorter(w)} | {f"w:{full}" for full in full_forms(w)}
    return sorted(keys)


@functools.lru_cache(maxsize=100_000)
def attendee_keys(name: str | None) -> list[str]:
    if name is None:
        return []
    words = re.findall(r"[^\W_]+", fold(bare(name)))
    keys = {f"w:{x}" for w in words if len(w) > 1 for x in _shorter(w)}
    if len(words) > 1:
        keys |= {"i:" + "".join(w[0] for w in words), "i:" + words[0][0] + words[-1][0]}
    return sorted(keys)


@functools.lru_cache(maxsize=100_000)
def _name_words(name: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(bare(name)))


def fit(label: str, name: str) -> float:
    """How well a label fits an attendee's name: 0 is exact, larger is worse, 9 and more is no fit."""
    a, b = _name_words(label), _name_words(name)
    if not a or not b:
        return 9.0
    if a == b:
        return 0.0
    if sorted(a) == sorted(b):
        return 0.1
    given, family = b[0], b[-1]
    if len(a) == 1:
        w = a[0]
        if w in (given, family):
            return 1.0
        if len(w) <= 4 and w in ("".join(x[0] for x in b), given[0] + family[0]):
            return 1.5
        if w in full_forms_of(given):
            return 1.6
        d = min(_edits(w, given), _edits(w, family))
        return 2.0 + d if d <= (1 if len(w) < 7 else 2) else 9.0
    best = 9.0
    for first, last in ((a[0], a[-1]), (a[-1], a[0])):
        cost = 0.0
        for typed, real, short in ((first, given, True), (last, family, False)):
            if typed == real:
                continue
            if len(typed) == 1:
                cost += 0.5 if typed == real[0] else 9.0
            elif short and real in full_forms(typed):
                cost += 0.6
            else:
                d = _edits(typed, real)
                cost += d if d <= max(1, min(len(typed), len(real)) // 3) else 9.0
        best = min(best, 0.2 + cost)
    return best


def full_forms_of(given: str) -> set[str]:
    return {short for short, names in NICKNAMES.items() if given in names.split()}


def _edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours."""
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if prev2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, prev2[j - 2] + 1)
            row.append(c)
        prev2, prev = prev, row
    return prev[-1]


# The same labels and names meet in many calls; the caches are bounded and change no result.
@functools.lru_cache(maxsize=200_000)
def _cost(label: str, name: str) -> int:
    return round(fit(label, name) * COST_UNIT)


_label_keys = F.pandas_udf(lambda s: pd.Series([name_keys(x) for x in s], dtype=object), T.ArrayType(T.StringType()))
_attendee_keys = F.pandas_udf(lambda s: pd.Series([attendee_keys(x) for x in s], dtype=object), T.ArrayType(T.StringType()))
_fit = F.pandas_udf(lambda a, b: pd.Series([_cost(x, y) for x, y in zip(a, b)], dtype="int64"), T.LongType())


def resolve_labels(labels: DataFrame, attendees: DataFrame) -> DataFrame:
    """(source_id, label, attendee_no): distinct labels of each call with the attendee meant.

    Labels that fit two attendees equally well, fit nobody, or name an unknown voice are left out.
    """
    keyed = labels.select("source_id", "label", F.explode(_label_keys("label")).alias("key"))
    people = attendees.where("full_name is not null and attendee_no is not null").select("source_id", F.col("attendee_no").cast("int"), "full_name").distinct()
    index = people.select("source_id", "attendee_no", "full_name", F.explode(F.concat(_attendee_keys("full_name"), F.array(F.concat(F.lit("#"), F.col("attendee_no").cast("string"))))).alias("key"))
    met = keyed.join(index.hint("merge"), ["source_id", "key"]).groupBy("source_id", "label", "attendee_no", "full_name").agg(F.max(F.col("key").startswith("#")).alias("numbered"))
    # one pass: people by rounded cost, then the least cost of each label with the number of people who reach it
    met = met.withColumn("cost", F.when(F.col("numbered"), F.lit(0)).otherwise(_fit("label", "full_name"))).where(F.col("cost") < 6 * COST_UNIT)
    level = met.groupBy("source_id", "label", "cost").agg(F.min("attendee_no").alias("attendee_no"), F.count("*").alias("n"))
    won = level.groupBy("source_id", "label").agg(F.min_by(F.struct("attendee_no", "n"), "cost").alias("w"))
    return won.where("w.n = 1").select("source_id", "label", "w.attendee_no")


def _filled(lines: DataFrame) -> DataFrame:
    """Adds ``who``: the speaker of the line, else of the last line before that has one, else 0. Windows span a block at most."""
    inside = Window.partitionBy("source_id", "blk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.groupBy("source_id", "blk").agg(F.max_by("said_by", F.when(F.col("said_by").isNotNull(), F.col("line_no"))).alias("_end"))
    ends = ends.select("source_id", "blk", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    lines = lines.withColumn("_here", F.last("said_by", ignorenulls=True).over(inside)).join(ends.hint("merge"), ["source_id", "blk"])
    return lines.withColumn("who", F.coalesce("_here", "_carried", F.lit(0))).drop("_here", "_carried")


def _runs(lines: DataFrame, extra: list[Column]) -> DataFrame:
    """Runs of one speaker within each block: source_id, blk, first_line, last_line, who, sec_line, sec, and ``extra``."""
    inside = Window.partitionBy("source_id", "blk").orderBy("line_no")
    last = F.lag("who").over(inside)
    lines = lines.withColumn("_start", F.when(last.isNull() | (last != F.col("who")), F.col("line_no")))
    lines = lines.withColumn("_run", F.last("_start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    timed = F.when(F.col("sec").isNotNull(), F.struct("line_no", "sec"))
    runs = lines.groupBy("source_id", "blk", F.col("_run").alias("first_line")).agg(F.max("line_no").alias("last_line"), F.min("who").alias("who"), F.min(timed).alias("timed"), *extra)
    return runs


def _across_blocks(runs: DataFrame) -> DataFrame:
    """Adds ``turn``: the first line of the whole run. Only the first and last run of each block can go on in another one."""
    inside = Window.partitionBy("source_id", "blk")
    runs = checkpoint(runs.withColumn("_edge", (F.col("first_line") == F.min("first_line").over(inside)) | (F.col("first_line") == F.max("first_line").over(inside))))
    order = Window.partitionBy("source_id").orderBy("first_line")
    edges = runs.where("_edge").select("source_id", "blk", "first_line", "who")
    goes_on = (F.lag("blk").over(order) != F.col("blk")) & (F.lag("who").over(order) == F.col("who"))
    edges = edges.withColumn("_start", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("first_line")))
    edges = edges.select("source_id", "first_line", F.last("_start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_turn"))
    return runs.join(edges.hint("merge"), ["source_id", "first_line"], "left").withColumn("turn", F.coalesce("_turn", "first_line"))


def speaker_turns(turns: DataFrame, attendees: DataFrame, want_text: bool = True) -> DataFrame:
    """One row per clean turn: source_id, first_line, last_line, attendee_no, start_sec and, if wanted, text.

    Repeated (source_id, line_no) rows count once; rows with a null key are dropped. Lines whose text is
    null, or holds only sounds and hesitation, are dropped but still hand on their speaker. A line without
    label belongs to the speaker of the line before, the first one to nobody (0). A label before a colon
    in the text counts only if it has at most six words and 60 characters (no name on a transcript is longer)
    and means an attendee or an unknown voice; else it stays text.
    """
    lines = turns.where("source_id is not null and line_no is not null").select("source_id", F.col("line_no").cast("int"), _parser(want_text)("ts", "speaker", "text").alias("p"))
    lines = checkpoint(lines.select("source_id", "line_no", "p.*").dropDuplicates(["source_id", "line_no"]))
    labels = lines.where("label is not null").select("source_id", "label").distinct()
    known = resolve_labels(labels, attendees)
    lines = lines.join(known.hint("merge"), ["source_id", "label"], "left")
    nobody = F.col("label").rlike(r"(?i)^\W*(?:(?:unknown|unidentified|unnamed)(?:\s+(?:speaker|voice))?|speaker|voice)\W*$|^\W+$|^<v\s*>$")
    labelled = F.col("label").isNotNull() & (~F.col("from_text") | F.col("attendee_no").isNotNull() | nobody)
    lines = lines.select(
        "source_id", "line_no", F.floor(F.col("line_no") / BLOCK_LINES).alias("blk"), "noise", F.when(F.col("sec") >= 0, F.col("sec")).alias("sec"),
        F.when(labelled, F.coalesce("attendee_no", F.lit(0))).alias("said_by"), *([F.when(labelled & F.col("from_text"), F.col("headless")).otherwise(F.col("body")).alias("text")] if want_text else []),
    )
    runs = _across_blocks(_runs(_filled(lines).where(~F.col("noise")), [F.collect_list(F.struct("line_no", "text")).alias("texts")] if want_text else []))
    out = [F.max("last_line").alias("last_line"), F.min("who").alias("attendee_no"), F.coalesce(F.min("timed").getField("sec"), F.lit(-1)).cast("long").alias("start_sec")]
    if want_text:
        out.append(F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("texts"))), lambda x: x.text), " ").alias("text"))
    return runs.groupBy("source_id", F.col("turn").alias("first_line")).agg(*out)
