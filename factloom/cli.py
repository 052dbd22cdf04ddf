"""Commands over a store: ingest transcripts, list and show areas, look up a question, merge areas, score, export."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import store
from factloom.operators import crossdoc, fold
from factloom.plans.ingest import ingest
from factloom.runtime import bounded
from factloom.sources import transcripts

MOST_LISTED = 100_000


def features(spark: SparkSession, root: str) -> DataFrame:
    f = store.load(spark, root, "facts")
    return f.groupBy("project", "feature").agg(F.count_if(F.col("superseded_by").isNull()).alias("active"), F.count("*").alias("facts")).orderBy("project", "feature")


def show(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The fact lines of the first area, by name, that contains ``name``."""
    f = store.load(spark, root, "facts")
    hit = f.where(F.contains(F.lower("feature"), F.lit(name.lower()))).agg(F.min(F.struct("feature", "project")).alias("x")).select("x.feature", "x.project")
    return store.fact_lines(f.join(hit, ["project", "feature"])).orderBy("ef_id").select("line")


def ask(spark: SparkSession, root: str, question: str) -> DataFrame:
    """The areas whose facts share most content words with the question."""
    f = crossdoc.active_facts(store.load(spark, root, "facts")).withColumn("body", F.concat_ws(" ", "feature", "summary", "quote"))
    q = spark.createDataFrame([(1, question)], "q int, text string")
    docs = f.select(F.concat_ws(" / ", "project", "feature").alias("area"), "body")
    return crossdoc.top_documents(q, "q", "text", docs, "area", "body").orderBy("rank").select("area", "overlap")


def merge(spark: SparkSession, root: str, project: str, names: list[str]) -> list[str]:
    """Merges areas into the first; each name is an exact one or else the first that contains it. Returns the names found."""
    f = store.load(spark, root, "facts")
    known = sorted(r[0] for r in bounded(f.where(F.col("project") == project).select("feature").distinct(), MOST_LISTED, "the list of areas"))
    found = []
    for n in names:
        hit = n if n in known else next((k for k in known if n.lower() in k.lower()), None)
        if hit and hit not in found:
            found.append(hit)
    if len(found) >= 2:
        groups = spark.createDataFrame([(project, m, found[0], i) for i, m in enumerate(found)], "project string, feature string, target string, member_no int")
        groups = crossdoc.mergeable(f, groups, explicit=True)
        events = store.load(spark, root, "events")
        store.save(spark, root, {"facts": crossdoc.merge_areas(f, groups), "events": crossdoc.merge_events(events, f, groups)})
    return found


def run_files(spark: SparkSession, root: str, path: str, project: str, day: datetime.date) -> DataFrame:
    files, rejects = transcripts.read_files(spark, path)
    for r in rejects.limit(20).collect():
        print(f"{r.path}: {r.reason}", file=sys.stderr)
    turns = transcripts.turns_of(files)
    calls = files.select("source_id", F.lit(project).alias("project"), F.lit(day).alias("call_date")).distinct()
    return fold.run_counters(ingest(spark, turns, calls, root))


def export(spark: SparkSession, root: str, folder: str) -> None:
    f, e = store.load(spark, root, "facts"), store.load(spark, root, "events")
    store.write_documents(store.documents(f, crossdoc.story(f), fold.open_items(e), fold.change_log(e)), folder)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="factloom", description=__doc__)
    p.add_argument("root", help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("path")
    a.add_argument("--project", default="default")
    a.add_argument("--date", type=datetime.date.fromisoformat, default=datetime.date.today())
    sub.add_parser("features")
    a = sub.add_parser("show")
    a.add_argument("name")
    a = sub.add_parser("ask")
    a.add_argument("question")
    a = sub.add_parser("merge")
    a.add_argument("project")
    a.add_argument("names", nargs="+")
    a = sub.add_parser("score")
    a.add_argument("path")
    a = sub.add_parser("export")
    a.add_argument("folder")
    o = p.parse_args(argv)
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    if o.command == "ingest":
        run_files(spark, o.root, o.path, o.project, o.date).show(50, False)
    elif o.command == "features":
        features(spark, o.root).show(1000, False)
    elif o.command == "show":
        show(spark, o.root, o.name).show(1000, False)
    elif o.command == "ask":
        ask(spark, o.root, o.question).show(3, False)
    elif o.command == "merge":
        found = merge(spark, o.root, o.project, o.names)
        print("merged: " + ", ".join(found) if len(found) >= 2 else "fewer than two areas found")
        return 0 if len(found) >= 2 else 1
    elif o.command == "score":
        turns = transcripts.turns_of(transcripts.read_files(spark, o.path)[0])
        s = crossdoc.grounding_score(store.load(spark, o.root, "facts"), turns).first()
        print(f"facts {s.n_facts} ({s.n_superseded} superseded), quotes grounded {s.n_grounded}/{s.n_quotes}, fragments {s.n_fragments}: {'PASS' if s.passed else 'FAIL'}")
        return 0 if s.passed else 1
    else:
        export(spark, o.root, o.folder)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
