"""The knowledge store: parquet tables in versions, and Markdown as an exchange format.

A version is a small manifest that lists the folders its tables consist of. Manifests are numbered, written aside and
renamed into place last; the one with the highest number is the current state, so a run that fails at any point leaves
the former state as it was. A run adds a folder of its own events, and rewrites the facts of only those buckets of
projects that its events touch; the other folders are carried over.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import text as X

BUCKETS = 64
MOST_FOLDERS = 200
"""Folders of events from which they are rewritten as one."""
TABLES = {"facts": schemas.FACTS, "events": schemas.EVENTS}


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/manifests")
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:12]) for n in names if re.fullmatch(r"\d{12}\.json", n))


def current(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Table -> folders of the current state; empty if there is none."""
    numbers = _manifests(spark, root)
    if not numbers:
        return {}
    fs, p = _fs(spark, f"{root}/manifests/{numbers[-1]:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current state; empty if there is none."""
    folders = current(spark, root).get(name, [])
    if not folders:
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(*[f"{root}/{f}" for f in folders])


def _put(spark: SparkSession, root: str, tables: dict[str, list[str]]) -> None:
    """Makes a state current: the manifest is written aside and renamed to the next number, which fails if another run has taken it."""
    fs, staged = _fs(spark, f"{root}/manifests/staged-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(tables).encode()))
    out.close()
    number = (_manifests(spark, root) or [0])[-1] + 1
    _, target = _fs(spark, f"{root}/manifests/{number:012d}.json")
    if fs.exists(target) or not fs.rename(staged, target):
        raise RuntimeError("another run has changed the store meanwhile")


def _columns(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[c.split()[0] for c in TABLES[name].split(", ")])


def bucket(project):
    return F.pmod(F.xxhash64(F.coalesce(project, F.lit(""))), F.lit(BUCKETS)).cast("int")


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Writes whole tables as a new state and makes it current; returns the name of its folder."""
    version = f"v-{uuid.uuid4().hex[:12]}"
    state = dict(current(spark, root))
    for name, df in tables.items():
        df = _columns(df, name)
        if name == "facts":
            df.withColumn("bucket", bucket(F.col("project"))).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{version}/{name}")
            state[name] = _parts(spark, root, f"{version}/{name}")
        else:
            df.write.parquet(f"{root}/{version}/{name}")
            state[name] = [f"{version}/{name}"]
    _put(spark, root, state)
    return version


def _parts(spark: SparkSession, root: str, folder: str) -> list[str]:
    fs, p = _fs(spark, f"{root}/{folder}")
    return sorted(f"{folder}/{x.getPath().getName()}" for x in fs.listStatus(p) if x.getPath().getName().startswith("bucket="))


def append(spark: SparkSession, root: str, events: DataFrame, facts: DataFrame) -> bool:
    """Adds a run: its events, and the facts as they are after it, of which only the touched buckets are written.

    A run without events changes nothing. Returns whether a new state was made.
    """
    touched = sorted(r[0] for r in events.select(bucket(F.col("project")).alias("b")).distinct().collect())  # BUCKETS rows at most
    if not touched:
        return False
    version = f"v-{uuid.uuid4().hex[:12]}"
    state = current(spark, root)
    log = state.get("events", []) + [f"{version}/events"]
    _columns(events, "events").write.parquet(f"{root}/{version}/events")
    if len(log) > MOST_FOLDERS:
        spark.read.schema(TABLES["events"]).parquet(*[f"{root}/{f}" for f in log]).write.parquet(f"{root}/{version}/events-all")
        log = [f"{version}/events-all"]
    changed = _columns(facts, "facts").withColumn("bucket", bucket(F.col("project"))).where(F.col("bucket").isin(touched))
    changed.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{version}/facts")
    kept = [f for f in state.get("facts", []) if int(f.rpartition("=")[2]) not in touched]
    _put(spark, root, state | {"events": log, "facts": kept + _parts(spark, root, f"{version}/facts")})
    return True


def attribution(speaker, ts, source_id, call_date):
    """"speaker, time (source: call, date)", the form facts are cited in."""
    return F.concat(F.coalesce(speaker, F.lit("Unidentified speaker")), F.lit(", "), F.coalesce(ts, F.lit("not available")), F.lit(" (source: "), F.coalesce(source_id, F.lit("")), F.lit(", "), F.coalesce(call_date.cast("string"), F.lit("")), F.lit(")"))


def fact_lines(facts: DataFrame) -> DataFrame:
    """project, feature, ef_id, line: each fact as a Markdown list item."""
    by = F.when(F.col("superseded_by").isNotNull(), F.concat(F.lit(" [superseded by EF-"), F.col("superseded_by").cast("string"), F.lit("]"))).otherwise("")
    cite = attribution(F.col("speaker"), F.col("ts"), F.col("source_id"), F.col("call_date"))
    line = F.concat(F.lit("- **EF-"), F.col("ef_id").cast("string"), F.lit("**"), by, F.lit(": "), F.coalesce("summary", F.lit("")), F.lit(' — *"'), F.coalesce("quote", F.lit("")), F.lit('"* — '), cite)
    return facts.select("project", "feature", "ef_id", line.alias("line"))


def documents(facts: DataFrame, stories: DataFrame, items: DataFrame, log: DataFrame) -> DataFrame:
    """project, feature, slug, body: one Markdown document per area, with its four sections; areas without facts have none."""

    def joined(df: DataFrame, order: str, line: str, name: str) -> DataFrame:
        return df.groupBy("project", "feature").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n").alias(name))

    f = joined(fact_lines(facts), "ef_id", "line", "facts")
    quoted = F.concat(F.lit("- **"), F.col("q_id"), F.lit("** ["), F.col("tag"), F.lit("]: "), F.coalesce("summary", F.lit("")), F.lit('\n  - *"'), F.coalesce("quote", F.lit("")), F.lit('"*'))
    q = joined(items.withColumn("line", quoted), "q_id", "line", "open_items")
    entry = F.concat(F.lit("- "), F.coalesce(F.col("event_date").cast("string"), F.lit("")), F.lit(": "), F.coalesce("source_id", F.lit("")), F.lit(" "), F.col("event_type"), F.coalesce(F.concat(F.lit(" EF-"), F.col("ef_id").cast("string")), F.lit("")))
    c = joined(log.withColumn("line", entry), "seq", "line", "log")
    d = f.join(stories, ["project", "feature"], "left").join(q, ["project", "feature"], "left").join(c, ["project", "feature"], "left")
    body = F.concat(
        F.lit("# "), F.col("feature"), F.lit("\n\n## User Story\n"), F.coalesce("story", F.lit("No confirmed requirements yet.")), F.lit("\n\n## Established Facts\n"), F.col("facts"),
        F.lit("\n\n## Open Questions / Ambiguities\n"), F.coalesce("open_items", F.lit("None.")), F.lit("\n\n## Change Log\n"), F.coalesce("log", F.lit("None yet.")), F.lit("\n"),
    )
    return d.select("project", "feature", X.slug(F.col("feature")).alias("slug"), body.alias("body"))


def write_documents(docs: DataFrame, path: str) -> None:
    """One file per area below ``path``, named by project and slug; areas with one slug get a number.

    Written by Spark's text source, one file a document, into any file system the cluster shares, then renamed by the
    driver, which handles names only.
    """
    n = F.row_number().over(Window.partitionBy("project", "slug").orderBy("feature"))
    named = docs.withColumn("n", n).select("project", F.when(F.col("n") > 1, F.concat_ws("-", "slug", F.col("n").cast("string"))).otherwise(F.col("slug")).alias("name"), "body")

    rows = named.select(F.coalesce("project", F.lit("none")).alias("project"), "name", "body")
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    one = F.concat_ws("\x01", "project", "name")
    rows.repartition(one).select("project", "name", F.regexp_replace("body", "\n$", "").alias("value")).write.partitionBy("project", "name").text(staged)
    spark = docs.sparkSession
    fs, top = _fs(spark, staged)
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for p in fs.listStatus(top) if fs.exists(top) else []:
        if not p.getPath().getName().startswith("project="):
            continue
        project = unescape(p.getPath().getName()[len("project="):])
        for d in fs.listStatus(p.getPath()):
            name = unescape(d.getPath().getName()[len("name="):])
            file = next(x.getPath() for x in fs.listStatus(d.getPath()) if x.getPath().getName().startswith("part-"))
            _, target = _fs(spark, f"{path}/{project}/{name}.md")
            fs.mkdirs(target.getParent())
            fs.delete(target, False)
            fs.rename(file, target)
    fs.delete(top, True)


FACT_LINE = r'^-\s*\*\*EF-(\d+)\*\*(?:\s*\[superseded by EF-(\d+)\])?:\s*(.+?)\s*—\s*\*"(.+?)"\*\s*—\s*(.+?), ([^,()]+) \(source: (.*), (\d{4}-\d{2}-\d{2})?\)\s*$'


def section(body, heading: str):
    """The text of a "## heading" section."""
    return F.btrim(F.regexp_extract(body, rf"(?s)(?:^|\n)## {heading}[^\n]*\n(.*?)(?=\n## |$)", 1), F.lit(" \t\n"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """project, feature, user_story, established_facts, open_questions, change_log of Markdown documents in project folders."""
    raw = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path, wholetext=True).select("*", "_metadata.file_path")
    v = F.col("value")
    return raw.select(
        F.element_at(F.split("file_path", "/"), -2).alias("project"), F.btrim(F.regexp_extract(v, r"^# ([^\n]*)", 1)).alias("feature"),
        section(v, "User Story").alias("user_story"), section(v, "Established Facts").alias("established_facts"), section(v, "Open Questions").alias("open_questions"), section(v, "Change Log").alias("change_log"),
    )


def parse_facts(docs: DataFrame) -> DataFrame:
    """The facts table of read documents; lines that are no facts are left out."""
    line = docs.select("project", "feature", F.explode(F.split("established_facts", "\n")).alias("line")).where(F.col("line").rlike(FACT_LINE))
    g = lambda i: F.regexp_extract("line", FACT_LINE, i)
    return line.select(
        "project", "feature", g(1).cast("int").alias("ef_id"), g(2).try_cast("int").alias("superseded_by"), g(3).alias("summary"), g(4).alias("quote"), g(5).alias("speaker"), g(6).alias("ts"), g(7).alias("source_id"), g(8).try_cast("date").alias("call_date"),
    )
