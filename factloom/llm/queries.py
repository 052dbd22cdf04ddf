"""The queries of the ten problems; names and columns as TESTDATA.md gives them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import canonical, languages, leaks, lookalike, packing, personal, similar, speaker_turns, spellings, splitting
from factloom.llm.oracle import ORACLE
from factloom.runtime import table

STATEMENT_SIMILARITY = 0.68


def _statement_sets(spark: SparkSession, d: str):
    s = table(spark, d, "statements").select("statement_id", "quote", "summary").where("statement_id is not null")
    s = s.dropDuplicates(["statement_id"])
    s = s.select("statement_id", F.concat(similar.words(F.col("quote")), similar.words(F.col("summary"))).alias("toks"))
    return similar.similar_sets(s, "statement_id", "toks", STATEMENT_SIMILARITY)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.expand_pairs(*_statement_sets(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return similar.groups(*_statement_sets(spark, d)).withColumnRenamed("id", "statement_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return speaker_turns.speaker_turns(table(spark, d, "turns"), table(spark, d, "attendees"), want_text=False)


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return speaker_turns.speaker_turns(table(spark, d, "turns"), table(spark, d, "attendees"))


def _speakers(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls").select("source_id", "project").distinct()
    s = table(spark, d, "statements").select("statement_id", "source_id", "speaker").where("speaker is not null").distinct()
    return spellings.link_spellings(s.join(calls, "source_id"), "project", "speaker")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spellings.same_entity_pairs(_speakers(spark, d), "project", "speaker")


p3_entities = _speakers


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "statements").select("statement_id", "source_id", "quote")
    t = table(spark, d, "turns").select("source_id", "line_no", "text")
    return lookalike.same_looking(s, t, ["source_id"], "quote", "text").select("statement_id", "source_id", "line_no").distinct()


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").select("source_id", "line_no", "text").dropDuplicates(["source_id", "line_no"])
    return t.select("source_id", "line_no", lookalike.consistent(F.col("text")).alias("form"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "turns"), ["source_id", "line_no"], "text", limit=2500, overlap=200)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("n_pieces > 1").select("source_id", "line_no").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).dropDuplicates(["source_id", "line_no", "piece_no"])


def _given(spark: SparkSession, d: str) -> list[str]:
    return personal.given_names(table(spark, d, "attendees"), "full_name")


def _with_personal_data(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").select(F.lit("turns").alias("tab"), "source_id", F.col("line_no").cast("long").alias("row_no"), "text")
    s = table(spark, d, "statements").select(F.lit("statements").alias("tab"), "source_id", F.col("seq").alias("row_no"), F.col("quote").alias("text"))
    return t.union(s)


# the kinds TESTDATA.md lists; the operator knows cards and dates of birth besides
LISTED_KINDS = ("email", "phone", "id_number", "address", "name")


def _key(spark: SparkSession) -> bytes:
    """The secret of the pseudonyms, from the session's setting; without one a random key, so that nothing can be traced back."""
    return spark.conf.get("spark.factloom.pseudonymKey", "").encode() or os.urandom(32)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = personal.find_personal(_with_personal_data(spark, d), ["tab", "source_id", "row_no"], "text", _given(spark, d), _key(spark)).where(F.col("kind").isin(*LISTED_KINDS))
    return found.select("tab", "source_id", "row_no", "kind", "start_pos").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_personal_data(spark, d).dropDuplicates(["tab", "source_id", "row_no"])
    return personal.redact(rows, "text", _given(spark, d), _key(spark)).select("tab", "source_id", "row_no", "redacted")


def _areas_of(spark: SparkSession, d: str, values: DataFrame) -> DataFrame:
    return canonical.map_to_list(values, "feature", table(spark, d, "feature_areas"), "area_id", "area_name", "alias_name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "statements").select("statement_id", "feature").where("feature is not null")
    s = s.join(table(spark, d, "feature_areas").select(F.col("area_name").alias("feature")), "feature", "left_anti")
    return s.join(_areas_of(spark, d, s), F.col("feature") == F.col("value")).select("statement_id", F.coalesce("entry_id", F.lit(0)).alias("area_id")).distinct()


def p7_values(spark: SparkSession, d: str) -> DataFrame:
    return _areas_of(spark, d, table(spark, d, "statements"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return p8_packed(spark, d).groupBy("container_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).where("edits = 0").select("doc_id", "item_id")


LABELLED_PER_LANGUAGE = 300


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    crf = languages.train(languages.sample_labelled(docs, "text", "lang", "doc_id", LABELLED_PER_LANGUAGE))
    return languages.document_languages(docs, "doc_id", "text", "lang", crf)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(p10_languages(spark, d))


__all__ = ["ORACLE", "QUERIES"]

QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_turns, p3_found, p4_found, p4_forms, p5_found, p5_pieces, p6_found, p6_redacted, p7_found, p7_values, p8_packed, p8_containers, p9_found, p9_leaks, p10_found, p10_languages)} | {"p3_entities": p3_entities}
