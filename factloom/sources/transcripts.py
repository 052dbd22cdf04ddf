"""Plain-text and WebVTT transcripts as turns, and chunks of lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import schemas
from factloom.config import CONFIG, Config

UNNAMED = "Unidentified speaker"


def read_files(spark: SparkSession, path: str, glob: str = "*.{txt,vtt,md}") -> tuple[DataFrame, DataFrame]:
    """(files, rejects): files(source_id, path, raw), a row per transcript; rejects(source_id, path, reason) of empty ones.

    Undecodable bytes become replacement characters; a file is never the cause of an exception.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    files = raw.select(stem.alias("source_id"), "path", F.btrim(F.make_valid_utf8(F.col("content").cast("string")), F.lit(" \t\r\n﻿")).alias("raw"))
    return files.where("raw <> ''"), files.where("raw = ''").select("source_id", "path", F.lit("the file is empty").alias("reason"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("source_id", F.posexplode(F.split("raw", r"\r\n|\r|\n")).alias("n", "line"))


def txt_turns(files: DataFrame) -> DataFrame:
    """Turns of "[time] Speaker: text" lines; blank lines are dropped, bold marks around speakers too, unlabelled lines have no speaker."""
    lines = _lines(files).select("source_id", (F.col("n") + 1).alias("line_no"), F.btrim("line").alias("line")).where("line <> ''")
    return lines.select("source_id", "line_no", *turn_parts(F.col("line")))


def turn_parts(line: Column) -> list[Column]:
    """ts, speaker and text of a line "[time] Speaker: text"."""
    pattern = r"^(?:\[([^\]]+)\]\s*)?(?:\*\*)?([^:*]{1,40}?)(?:\*\*)?:(?:\*\*)?\s*(.+)$"
    timed = r"^\[([^\]]+)\]\s*(.+)$"
    ok = line.rlike(pattern)
    blank = lambda c: F.when(c != "", c)
    return [
        blank(F.when(ok, F.regexp_extract(line, pattern, 1)).otherwise(F.regexp_extract(line, timed, 1))).alias("ts"),
        blank(F.when(ok, F.btrim(F.regexp_extract(line, pattern, 2)))).alias("speaker"),
        F.btrim(F.when(ok, F.regexp_extract(line, pattern, 3)).when(line.rlike(timed), F.regexp_extract(line, timed, 2)).otherwise(line)).alias("text"),
    ]


CUE = r"^\s*((?:\d{1,3}:)?\d{1,2}:\d{2}[.,]\d{3})\s*-->.*$"


def vtt_turns(files: DataFrame) -> DataFrame:
    """Turns of WebVTT files: one per voice in a cue, with the cue's start as ts.

    A payload of several lines is one text; payload outside voice tags, and empty voice tags, belong to
    "Unidentified speaker"; other tags are stripped; NOTE, STYLE and REGION blocks are skipped. Blocks are
    told apart by blank lines, so a line of digits inside a payload stays text. Files are rows, so a block is
    cut out of its file without windows over the file's lines.
    """
    blocks = files.select("source_id", F.posexplode(F.split(F.regexp_replace("raw", r"\r\n|\r", "\n"), r"\n[ \t]*\n\s*")).alias("block_no", "block"))
    lines = F.split("block", "\n")
    cue_at = F.array_position(F.transform(lines, lambda x: x.rlike(CUE)), True)
    cues = blocks.where(~F.btrim("block").rlike(r"^(?:NOTE|STYLE|REGION)\b")).select("source_id", "block_no", lines.alias("lines"), cue_at.cast("int").alias("cue_at")).where("cue_at > 0")
    cues = cues.select(
        "source_id", "block_no", F.regexp_extract(F.element_at("lines", F.col("cue_at")), CUE, 1).alias("ts"),
        F.btrim(F.array_join(F.transform(F.slice("lines", F.col("cue_at") + 1, F.size("lines")), lambda x: F.btrim(x)), " ")).alias("payload"),
    ).where("payload <> ''")
    # a mark before each voice tag parts the payload; text before the first one has no voice
    parts = F.split(F.regexp_replace("payload", r"<v(?:\.[^\s>]*)?[ \t]*([^>]*)>", "\x02$1\x03"), "\x02")
    voiced = cues.select("source_id", "block_no", "ts", F.posexplode(parts).alias("part_no", "part"))
    tagged = F.col("part").contains("\x03")
    name = F.btrim(F.substring_index("part", "\x03", 1))
    text = F.btrim(F.regexp_replace(F.when(tagged, F.substring_index("part", "\x03", -1)).otherwise(F.col("part")), r"<[^>]*>", ""))
    turns = voiced.select("source_id", "block_no", "part_no", "ts", F.when(tagged & (name != ""), name).otherwise(UNNAMED).alias("speaker"), text.alias("text")).where("text <> ''")
    return turns.select("source_id", (F.col("block_no") * 1000 + F.col("part_no")).cast("int").alias("line_no"), "ts", "speaker", "text")


def turns_of(files: DataFrame) -> DataFrame:
    """Turns of text and WebVTT files alike, told apart by the WEBVTT signature."""
    is_vtt = F.col("raw").rlike(r"^\W?WEBVTT")
    return txt_turns(files.where(~is_vtt)).unionByName(vtt_turns(files.where(is_vtt)))


def rendered(turns: DataFrame) -> Column:
    """A turn as a line "[ts] Speaker: text"."""
    stamp = F.when(F.col("ts").isNotNull(), F.concat(F.lit("["), F.col("ts"), F.lit("] "))).otherwise("")
    who = F.when(F.col("speaker").isNotNull(), F.concat(F.col("speaker"), F.lit(": "))).otherwise("")
    return F.concat(stamp, who, F.coalesce("text", F.lit("")))


def pack_lines(sizes: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) line indexes of greedy chunks; each later chunk repeats the last ``overlap`` lines of the one before.

    Every line is in a chunk, and each chunk adds at least one line, so lines longer than ``most`` stand alone
    and nothing is lost. Repeated lines are left out where they would not leave room for a new one.
    """
    out, first = [], 0
    done = 0
    while done < len(sizes):
        last, room = done, most - sum(sizes[first:done]) - (done - first)
        while first < done and room < sizes[done]:
            room += sizes[first] + 1
            first += 1
        room -= sizes[done] + 1
        while last + 1 < len(sizes) and sizes[last + 1] <= room:
            last += 1
            room -= sizes[last] + 1
        out.append((first, last))
        done = last + 1
        first = max(first, done - overlap)
    return out


def chunk_lines(turns: DataFrame, config: Config = CONFIG, section_lines: int = 20_000) -> DataFrame:
    """Chunks of whole lines of at most ``chunk_chars`` characters, overlapping by ``chunk_overlap_lines`` lines.

    Greedy packing is sequential, so a call is packed in sections of ``section_lines`` line numbers: each
    section is one task, however long the call. Chunks don't reach over the end of a section. Repeated
    (source_id, line_no) rows count once; null texts are empty lines.
    """
    lines = turns.where("source_id is not null and line_no is not null").dropDuplicates(["source_id", "line_no"])
    lines = lines.select("source_id", F.col("line_no").cast("int").alias("line_no"), F.floor((F.col("line_no") - 1) / section_lines).cast("int").alias("section"), rendered(lines).alias("line"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        text, no = pdf["line"].tolist(), pdf["line_no"].tolist()
        spans = pack_lines([len(t) for t in text], config.chunk_chars, config.chunk_overlap_lines)
        rows = [(pdf["source_id"].iloc[0], pdf["section"].iloc[0], n, no[a], no[b], "\n".join(text[a : b + 1])) for n, (a, b) in enumerate(spans)]
        return pd.DataFrame(rows, columns=["source_id", "section", "n", "line_from", "line_to", "text"])

    parts = lines.groupBy("source_id", "section").applyInPandas(pack, "source_id string, section int, n int, line_from int, line_to int, text string")
    return number_chunks(parts)


def number_chunks(parts: DataFrame) -> DataFrame:
    """part_no and total over the sections of each call, from one count per section."""
    sized = parts.groupBy("source_id", "section").agg(F.max("n").alias("last"))
    order = Window.partitionBy("source_id").orderBy("section")
    sized = sized.select("source_id", "section", F.coalesce(F.sum(F.col("last") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum(F.col("last") + 1).over(Window.partitionBy("source_id")).alias("total"))
    out = parts.join(sized, ["source_id", "section"])
    return out.select("source_id", (F.col("n") + F.col("before") + 1).cast("int").alias("part_no"), F.col("total").cast("int"), "line_from", "line_to", "text")


def rows_of(spark: SparkSession, rows: list[tuple], schema: str = schemas.TURNS) -> DataFrame:
    return spark.createDataFrame(rows, schema)

