from hypothesis import given
from hypothesis import strategies as st

from factloom import store
from factloom.config import Config
from tests.fixture import VTT
from factloom.sources import transcripts as R


def test_txt_and_vtt(spark, tmp_path):
    (tmp_path / "a.txt").write_text("[00:00:05] Nadia Brook: Hello there.\n\n**PM:** Bold speaker.\nno label here\n")
    (tmp_path / "b.vtt").write_text(VTT)
    (tmp_path / "c.txt").write_text("  \n")
    (tmp_path / "d.txt").write_bytes(b"Omar: caf\xe9\n")
    files, rejects = R.read_files(spark, str(tmp_path))
    assert [r.source_id for r in rejects.collect()] == ["c"]
    got = {(r.source_id, r.ts, r.speaker, r.text) for r in R.turns_of(files).collect()}
    assert {("a", "00:00:05", "Nadia Brook", "Hello there."), ("a", None, "PM", "Bold speaker."), ("a", None, None, "no label here")} <= got
    vtt = [(r.ts, r.speaker, r.text) for r in R.turns_of(files).where("source_id = 'b'").orderBy("line_no").collect()]
    assert vtt == [
        ("00:00:01.000", "Nadia Brook", "The export keeps the last thirty days."), ("00:00:04.500", "Unidentified speaker", "Is that for every branch?"),
        ("00:00:07.000", "Omar Lind", "Yes, for every branch, and for the archive."), ("00:00:07.000", "Nadia Brook", "Agreed."), ("00:00:11.000", "Unidentified speaker", "42"),
    ]
    assert any(s == "d" and "caf" in t for s, _, _, t in got)


@given(st.lists(st.integers(0, 60), max_size=40), st.integers(10, 80), st.integers(0, 3))
def test_packing(sizes, most, overlap):
    spans = R.pack_lines(sizes, most, overlap)
    seen = [i for a, b in spans for i in range(a, b + 1)]
    assert sorted(set(seen)) == list(range(len(sizes)))
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert d > b and b + 1 - overlap <= c <= b + 1
    for a, b in spans:
        assert sum(sizes[a : b + 1]) + (b - a) <= most or a == b


def test_chunks(spark):
    rows = [("k", i, None, None, "x" * 30) for i in range(1, 21)] * 2 + [("z", 1, None, "A", None), (None, 1, None, None, "y")]
    turns = spark.createDataFrame(rows, "source_id string, line_no int, ts string, speaker string, text string")
    got = R.chunk_lines(turns, Config(chunk_chars=100), section_lines=10).orderBy("source_id", "part_no").collect()
    k = [r for r in got if r.source_id == "k"]
    assert [r.part_no for r in k] == list(range(1, len(k) + 1)) and {r.total for r in k} == {len(k)}
    assert {n for r in k for n in range(r.line_from, r.line_to + 1)} == set(range(1, 21)) and all(len(r.text) <= 100 for r in k)
    assert [r.text for r in got if r.source_id == "z"] == ["A: "]
    assert R.chunk_lines(turns.limit(0)).count() == 0


def test_markdown_round_trip(spark, tmp_path):
    import datetime

    facts = spark.createDataFrame([("p", "Exports", 1, 2, "Old rule.", "keeps ten days", "Nadia", "00:00:01", "k-1", datetime.date(2024, 1, 2)), ("p", "Exports", 2, None, "New rule.", "keeps thirty days", "Omar", "not available", "k-2", datetime.date(2024, 1, 3))], store.schemas.FACTS)
    events = spark.createDataFrame([], store.schemas.EVENTS)
    from factloom.operators import crossdoc, fold

    docs = store.documents(facts, crossdoc.story(facts), fold.open_items(events), fold.change_log(events))
    store.write_documents(docs, str(tmp_path))
    read = store.read_documents(spark, str(tmp_path))
    r = read.first()
    assert (r.project, r.feature, r.user_story, r.open_questions) == ("p", "Exports", "New rule.", "None.")
    assert sorted(map(tuple, store.parse_facts(read).collect())) == sorted(map(tuple, facts.collect()))
