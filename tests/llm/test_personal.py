import datetime

from hypothesis import given
from hypothesis import strategies as st

from factloom.llm.lookalike import transducer
from factloom.llm.personal import FIRST_DAY, Detector, date_of, feistel, find_personal, given_names, luhn, permuted_card, permuted_date, pseudonym, redact

D = Detector(["Joséphine", "Nadia", "Matthias"])
FOUND = [
    ("Reach me under a.b+c@desk.invalid.", "email", "a.b+c@desk.invalid"), ("It is lark_8 (at) postbox (dot) test now", "email", "lark_8 (at) postbox (dot) test"), ("costwick at example dot net.", "email", "costwick at example dot net"),
    ("Call +1 907 555 0106 now", "phone", "+1 907 555 0106"), ("0044 (0)7700-900-847 as", "phone", "0044 (0)7700-900-847"), ("(202) 555-0174 as", "phone", "(202) 555-0174"), ("five five five oh one eight seven, ok", "phone", "five five five oh one eight seven"), ("19075550138.", "phone", "19075550138"),
    ("no 942-38-8309, it", "id_number", "942-38-8309"), ("XX62 4311 4219 1106 31. It", "id_number", "XX62 4311 4219 1106 31"), ("QQ 52 62 07 C and", "id_number", "QQ 52 62 07 C"), ("59.920.349-1.", "id_number", "59.920.349-1"), ("PA9493157 the", "id_number", "PA9493157"), ("is 907.555.0115. 14 boxes", "phone", "907.555.0115"), ("on 907-555-0115 a trainee", "phone", "907-555-0115"), ("at 907-555-0115 when", "phone", "907-555-0115"),
    ("at Flat 24C, 44 Foundry St., Hestermouth 5159 please", "address", "Flat 24C, 44 Foundry St., Hestermouth 5159"), ("at Heronweg 151, 42810 Marrowby please", "address", "Heronweg 151, 42810 Marrowby"), ("PO Box 415, Skelmoor first", "address", "PO Box 415, Skelmoor"),
    ("Ask for Joséphine M. Ostashby at", "name", "Joséphine M. Ostashby"), ("for matthias drosienne by", "name", "matthias drosienne"), ("Mrs. Nadia Pell says", "name", "Nadia Pell"),
]
CLEAN = ["order 2024-0117-88", "lot 7700 900", "version 555.0142.1", "was 1 202 555 in", "within 69 months of the quarter close", "Ask support at the desk, dot your i's.", "Thanks, Nadia, that helps.", "Nadia said", "Nadia Brook: hello", "Quenby Textiles Ltd", "handle @ops", "08:30-17:45", "Serial QX-204-555", ""]


def test_detector():
    for text, kind, value in FOUND:
        assert [(k, text[s:e]) for k, s, e in D.find(text)] == [(kind, value)], text
    for text in CLEAN:
        assert D.find(text) == [], text


@given(st.text(alphabet="0123456789", min_size=1, max_size=24), st.binary(min_size=1, max_size=8))
def test_feistel_round_trip(digits, key):
    new = feistel(digits, key)
    assert len(new) == len(digits) and new.isdigit() and feistel(new, key, back=True) == digits


def test_feistel_permutes():
    assert len({feistel(f"{i:03d}", b"k") for i in range(1000)}) == 1000


def test_links_across_spellings():
    p = lambda v: "".join(c for c in pseudonym("phone", v, b"k") if c.isdigit())[-10:]
    assert p("+1 907 555 0106") == p("907.555.0106") == p("(907) 555-0106") == p("19075550106") != p("907-555-0107")
    assert pseudonym("id_number", "942-38-8309", b"k")[3] == "-" and pseudonym("email", "a@b.test", b"k") == pseudonym("email", "A (at) b (dot) test", b"k")


def test_in_spark(spark):
    rows = [("k", 1, "Ｃａｌｌ +1 907 555 0106 nо​w, Nadia Brook"), ("k", 2, None), ("k", 3, ""), ("k", 4, "Ask " * 5000 + "Nadia Brook")]
    df = spark.createDataFrame(rows + rows[:1], "source_id string, row_no int, text string")
    people = spark.createDataFrame([("Nadia Brook",), (None,), ("X",)], "full_name string")
    given_ = given_names(people, "full_name")
    assert given_ == ["nadia"]
    got = sorted((r.row_no, r.kind, r.start_pos, r.value) for r in find_personal(df, ["source_id", "row_no"], "text", given_, b"k").distinct().collect())
    assert got == [(1, "name", 28, "Nadia Brook"), (1, "phone", 7, "1 907 555 0106"), (4, "name", 20001, "Nadia Brook")]
    out = [r.redacted for r in redact(df.limit(3), "text", given_, b"k").orderBy("row_no").collect()]
    assert out[0].startswith("Ｃａｌｌ [PHONE +1") and "Nadia" not in out[0] and "nо​w, [NAME " in out[0] and out[1:] == [None, ""]
    assert transducer().form("x") == "x"


def test_names_that_no_attendee_has():
    detector = Detector([])
    for text, value in (("Ask for Albert Larkenko at the gate", "Albert Larkenko"), ("Mr. Albert Ng says", "Albert Ng"), ("Ask Albert O'Brien now", "Albert O'Brien"), ("for Albert van der Pell by", "Albert van der Pell"), ("Ask Albert De Witt now", "Albert De Witt")):
        assert [(k, text[s:e]) for k, s, e in detector.find(text)] == [("name", value)], text
    for text in ("Albert is here", "Albert de facto runs it", "Ask Albert It is late", "albert to me"):
        assert detector.find(text) == [], text


def test_names_told_by_what_stands_before():
    detector = Detector([])
    unseen = "Ngozi Adeyemi;Bogdan Kowalczuk;Jamal Whitfield;Aiko Tanabe;Svetlana Orlova;Thabo Mokoena;Ingrid Solheim;Ravi Menon;Chidi Eze;Linnéa Ström".split(";")
    held = [(f, n) for n in unseen for f in ("My name is {}.", "Please ask Mr. {} about it", "Dr {} signed", "and you're talking to {} now")]
    got = [[text[s:e] for k, s, e in detector.find(text) if k == "name"] == [n] for f, n in held for text in (f.format(n),)]
    assert sum(got) >= 0.9 * len(held)
    for text in ("My name is on the list", "Mr. Adeyemi called", "Dr Who Ltd is here", "[10:22:30] Mr. Jamal Whitfield: hello", "**Dr Jamal Whitfield:** hello"):
        assert detector.find(text) == [], text


def test_labels_and_accents():
    detector = Detector(["zoë", "richard"])
    assert detector.find("[10:22:30] Richard Tarnstrum: Happy Friday") == detector.find("Richard Tarnstrum (client): hello") == []
    assert [k for k, _, _ in Detector([]).find("Ask for Zoë Zelmarek now")] == ["name"]


def test_cards_and_dates():
    detector = Detector([])
    text = "Card 4111 1111 1111 1111, born on 3 March 1985; order 4111 1111 1111 1112 of 3 March 1985"
    assert [(k, text[s:e]) for k, s, e in detector.find(text)] == [("card", "4111 1111 1111 1111"), ("date", "3 March 1985")]
    new = pseudonym("card", "4111 1111 1111 1111", b"k")
    assert new[4] == new[9] == " " and luhn(new.replace(" ", "")) and new != "4111 1111 1111 1111"
    assert permuted_card(permuted_card("4111111111111111", b"k"), b"k", back=True) == "4111111111111111"
    days = {date_of(pseudonym("date", v, b"k")) for v in ("1985-03-03", "3 March 1985", "March 3, 1985", "03.03.1985", "3/3/1985")}
    assert len(days) == 1 and None not in days
    assert date_of("31.02.1985") is None and date_of("1985-13-01") is None and date_of("03/25/1985") == date_of("1985-03-25")


@given(st.dates(min_value=FIRST_DAY, max_value=datetime.date(2099, 12, 31)), st.binary(min_size=1, max_size=8))
def test_dates_are_restored(day, key):
    assert permuted_date(permuted_date(day.isoformat(), key), key, back=True) == day.isoformat()
