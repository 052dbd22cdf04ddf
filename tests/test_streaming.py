import datetime
import os

from factloom.streaming import calls as S


def test_late_files_of_a_backlog_are_kept(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    day = lambda n: datetime.datetime(2024, 6, 1) + datetime.timedelta(days=n)
    files = [[("a", 1, day(90)), ("a", 2, day(90))], [("b", 1, day(95))], [("b", 2, day(0)), ("c", 1, day(1)), ("a", 1, day(91))], [("c", 2, None)]]
    for i, rows in enumerate(files):
        part = spark.createDataFrame([(k, n, None, "Nadia", f"line {n}", at) for k, n, at in rows], S.LINES).coalesce(1)
        part.write.mode("append").parquet(str(folder))
        for p in folder.glob("part-*.parquet"):
            if p.stat().st_mtime > 1_000_000_000:
                os.utime(p, (1000 + i, 1000 + i))
    one_by_one = S.stream_lines
    monkeypatch.setattr(S, "stream_lines", lambda spark, folder: one_by_one(spark, folder, 1))
    ingested = []
    monkeypatch.setattr(S, "ingest", lambda spark, lines, *_: ingested.append(sorted((r.source_id, r.line_no) for r in lines.collect())))
    assert S.run(spark, str(folder), None, root, str(tmp_path / "ckpt")).awaitTermination(120)
    stored = sorted((r.source_id, r.line_no) for r in spark.read.parquet(f"{root}/lines").collect())
    assert stored == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("c", 2)]
    assert ingested[-1] == [("c", 1), ("c", 2)] and ingested[-2] == stored[:-1]
