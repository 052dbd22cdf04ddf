"""Problem 6: personal information in free text, replaced by typed placeholders.

Detection runs on the consistent form of a text, with every position carried back to the text as
delivered. Numbers are validated by format and length, payment cards by their check digit, dates by the
calendar. A placeholder carries a pseudonym that keeps equal values linked across documents: digits of
validated numbers are permuted by a keyed Feistel network within their own format (a phone number stays one,
with the same separators; a card keeps a valid check digit), dates of birth within the days of two centuries
and in their own notation; values without such a format get a keyed tag. Without the key nothing can be
traced back; with it numbers and dates can be restored.

Names are found by given name (lists and the people a caller passes), and, whatever the given name, where a
title or a self-introduction stands before two capitalised words.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.lookalike import transducer
from factloom.llm.names import GIVEN_NAMES, LEGAL_FORMS, NICKNAMES, TITLES, fold

ROUNDS = 10
MOST_GIVEN_NAMES = 200_000

# Spoken digits, kinds of streets, words that follow a given name without being a family name.
SPOKEN = {"zero": "0", "oh": "0", "o": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Close|Cl|Court|Ct|Row|Way|Place|Pl|Square|Sq|Boulevard|Blvd|Terrace|Crescent|Parkway|Highway|Hill|Walk|Mews|Gardens|Grove|Alley|Quay"
NOT_FAMILY = set("operations department team ledger gate north south east west office services group company street avenue road lane from with when will would should could must may might can cannot said says asked asks wants wanted that this they them then than have has had was were are and but for not the you your his her its our their into onto over under after before about also just like back again here there today tomorrow yesterday monday tuesday wednesday thursday friday saturday sunday please thanks thank joined left sent wrote called calls moved signed once twice will is it in on at to of or so no ok we he me my by do go if an as am us up".split()) | LEGAL_FORMS
PARTICLES = r"(?:[Vv][ao]n|[Dd]e[rnl]?|[Dd][aiu]|[Ll][ae]|[Tt]e[nr])[ ]+"
_COMMON_WORDS = {"will", "bill", "mark", "art", "dot", "don", "pat", "rich", "sue", "drew", "em", "al", "jack", "cat", "fern", "val", "meg", "peg", "val", "sal", "ed", "em", "harry", "dick", "ken", "grace", "hope", "may", "june", "april", "rose", "jim", "jo", "lore", "mara", "isa", "nell", "liv", "pip", "sam", "bob", "ben", "dan", "len", "ron", "ted", "tim", "tom", "vic", "zo", "pri", "reba", "olu", "bert", "chuck", "hank", "hal", "fritz", "gabe", "penny", "frank", "chip", "kit", "kitty", "charlie", "max", "ray", "guy", "rob", "nick", "josh", "carol", "dawn", "ivy", "joy", "faith", "summer", "victor", "christian", "thea"}

_EMAIL = re.compile(
    r"(?<![\w.+-])[\w][\w.+-]*(?:@|\s?[\[(]at[\])]\s?|\s+at\s+(?=[\w-]+(?:\s+dot\s+|\s?[\[(]dot[\])]\s?)[a-z]{2,}\b))[\w-]+(?:(?:\.|\s?[\[(]dot[\])]\s?|\s+dot\s+)[\w-]+)*(?:\.|\s?[\[(]dot[\])]\s?|\s+dot\s+)[a-z]{2,24}(?![\w-])", re.I
)
_NUMBER = re.compile(r"(?<![\w.+/-])(?:[A-Za-z]{2}(?=\d)|[A-Za-z]{2}\s(?=\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d]\b))?[+(]?\d[\d().\s-]*\d(?:-[Kk]|\s?[A-Da-d](?!\w))?(?![\w]|[.-]\d)")
_ID_FORMS = [re.compile(p, re.I) for p in (
    r"\d{3}-\d{2}-\d{4}", r"\d{6}-\d{4}", r"\d{1,2}\.\d{3}\.\d{3}-[\dK]", r"[A-Z]{2}\d{7}", r"[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]", r"[A-Z]{2}\d{2}(?:\s?\d{4}){3,7}(?:\s?\d{1,4})?",
)]
_PHONE_FORMS = [re.compile(p) for p in (
    r"\+\d{1,3}[\s.-]?(?:\(0\)[\s.-]?)?(?:\(?\d{1,5}\)?[\s.-]?)(?:\d{2,8}[\s.-]?){1,4}", r"00\d{1,3}[\s.-]?(?:\(0\)[\s.-]?)?(?:\d{2,8}[\s.-]?){1,4}",
    r"\(\d{3}\)\s?\d{3}[\s.-]?\d{4}", r"(?:1[\s.-])?\d{3}[.\s-]\d{3}[.\s-]\d{4}", r"1[2-9]\d{9}", r"0\d{2,4}[\s.-]?\d{3,4}[\s.-]?\d{3,4}", r"0\d{9,10}",
)]
_SPOKEN = re.compile(r"\b(?:(?:" + "|".join(SPOKEN) + r")[\s,-]+){6,14}(?:" + "|".join(SPOKEN) + r")\b", re.I)
_NO_LETTER = re.compile(r"[\W\d_]+")
_PLACE = r"[^\W\d_][\w'’-]*(?:[ -](?-i:[A-ZÀ-Þ])[\w'’-]*){0,2}"
_STREET_WORD = r"(?!(?:of|the|a|an|to|from|in|on|at|per|by|for|and|or|is|are|was|within|after|before)\b)[^\W\d_][\w'’-]*\s+"
_ADDRESS = re.compile(
    r"(?<![\w#.,-])(?:"
    rf"(?:(?:Flat|Apt\.?|Apartment|Suite|Unit)\s+\w{{1,5}},\s*)?\d{{1,5}}[A-Za-z]?(?:\s?[-–]\s?\d{{1,5}})?\s+(?:{_STREET_WORD}){{1,4}}?(?:{STREETS})\b\.?(?:,\s*{_PLACE})?(?:,?\s+\d{{4,5}}(?!\w))?"
    rf"|[^\W\d_][\w'’-]{{2,}}(?:weg|stra(?:ss|ß)e|strasse|str\.|gasse|platz|allee|ring|damm|ufer|laan|straat)\s+\d{{1,5}}[a-z]?(?:,\s*\d{{4,5}}\s+{_PLACE})?"
    rf"|P\.?\s?O\.?\s+Box\s+\d{{1,6}}(?:,\s*{_PLACE})?"
    r")", re.I,
)
_ONE_WORD_STREETS = ("weg", "strasse", "straße", "str.", "gasse", "platz", "allee", "ring", "damm", "ufer", "laan", "straat", "box")
_SPOKEN_SET = set(SPOKEN)
_STREET_SET = {w.lower() for w in STREETS.split("|")}
_BLANK_DIGIT = re.compile(r"\s\d")
_LONG_NUMBER = re.compile(r"\d[\d().\s-]{4,}\d")
# Months; the days within which dates are permuted.
MONTHS = "January February March April May June July August September October November December".split()
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 73_049  # to the end of 2099
_MONTH = "|".join(m if len(m) < 4 else f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
_DATE = re.compile(rf"\b(?:(?P<y1>\d{{4}})-(?P<m1>\d{{2}})-(?P<d1>\d{{2}})|(?P<d2>\d{{1,2}})(?P<sep>[./])(?P<m2>\d{{1,2}})(?P=sep)(?P<y2>\d{{4}})|(?P<d3>\d{{1,2}})(?:st|nd|rd|th)? (?P<n3>{_MONTH})\.?,? (?P<y3>\d{{4}})|(?P<n4>{_MONTH})\.? (?P<d4>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<y4>\d{{4}}))\b", re.I)
_BIRTH = re.compile(r"\b(?:born|birth|birthday|birthdate|dob|d\.o\.b\.?|geboren|geb\.|née?|nacid[oa]|nat[oa])\b[^.!?\n]{0,25}$", re.I)
_CARD = re.compile(r"(?<![\w.+-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?:[ -]?\d{1,3})?(?![\w]|[.-]\d)")
# Words after which two capitalised words are a person's name: titles, and introductions of oneself.
_INTRODUCED = re.compile(r"(?:\b(?:[Mm]y name is|[Mm]y name's|[Ii] am called|[Yy]ou(?:'re| are) (?:talking|speaking) (?:to|with))\s+|\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herr|Frau)\b\.?\s+)(?=[^\W\d_])")
_TWO_CAPITALS = re.compile(r"([^\W\d_]{2,}(?:-[^\W\d_]+)?)(?:\s[^\W\d_]\.)*\s(?:" + PARTICLES + r"){0,2}((?:[OD]['’])?[^\W\d_]{2,}(?:[-'’][^\W\d_]+)*)(?![\w])")
# A speaker label at the start of a text, after a time and marks if there are any.
_HEAD = re.compile(r"^[^\w]*(?:\d[\d:.,]*(?:\s*-+>\s*[\d:.,]+)?)?[^\w]*(?:<v\s*)?(?:(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herr|Frau)\b\.?\s*)?$")
_LABEL_END = re.compile(r"^[*_]{0,2}\s*(?:\([^()]*\)\s*)?[*_]{0,2}\s*[:>]")


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others, as on payment cards."""
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def date_of(text: str) -> datetime.date | None:
    """The day a date means (day before month in all-number notations unless only the other order is one), None if it is none."""
    m = _DATE.fullmatch(text)
    if not m:
        return None
    g = m.groupdict()
    k = next(k for k in "1234" if g[f"y{k}"])
    month = g.get(f"m{k}") or next(i for i, n in enumerate(MONTHS, 1) if n[:3].lower() == g[f"n{k}"][:3].lower())
    y, mo, d = int(g[f"y{k}"]), int(month), int(g[f"d{k}"])
    if k == "2" and mo > 12 >= d:
        mo, d = d, mo
    try:
        day = datetime.date(y, mo, d)
    except ValueError:
        return None
    return day if 0 <= (day - FIRST_DAY).days < DAYS else None


def permuted_date(text: str, key: bytes, back: bool = False) -> str:
    """Another day in the same notation: a keyed permutation of the days of two centuries (cycle walking); ``back`` undoes it."""
    at = (date_of(text) - FIRST_DAY).days
    while True:
        at = int(feistel(f"{at:05d}", key + b"date", back))
        if at < DAYS:
            break
    new = FIRST_DAY + datetime.timedelta(days=at)
    m = _DATE.fullmatch(text)
    if m.group("y1"):
        return new.isoformat()
    if m.group("y2"):
        a, b = new.day, new.month
        if int(m.group("m2")) > 12:  # month first; kept only where it can't be read the other way
            a, b = (b, a) if new.day > 12 else (a, b)
        return f"{a:02d}{m.group('sep')}{b:02d}{m.group('sep')}{new.year}"
    month = MONTHS[new.month - 1]
    return f"{new.day} {month} {new.year}" if m.group("y3") else f"{month} {new.day}, {new.year}"


def permuted_card(digits: str, key: bytes, back: bool = False) -> str:
    """Digits of a card permuted but for the check digit, which is computed anew."""
    body = feistel(digits[:-1], key + b"card", back)
    return next(body + c for c in "0123456789" if luhn(body + c))


# the same forms inside a longer run of digits and marks ("... 0115. 14 boxes", "... 0115 a trainee")
_INSIDE = [(kind, re.compile(rf"(?<![\w.-])(?:{p.pattern})(?![\w]|[.-]\d)", p.flags)) for kind, forms in (("id_number", _ID_FORMS), ("phone", _PHONE_FORMS)) for p in forms]


def _number_in(raw: str) -> tuple[str, int, int] | None:
    """(kind, start, end) of the valid number that a run of digits and separators is or holds."""
    if sum(c.isdigit() for c in raw) < 6:
        return None
    for kind, forms in (("id_number", _ID_FORMS), ("phone", _PHONE_FORMS)):
        if any(p.fullmatch(raw) for p in forms) and (kind == "id_number" or 9 <= sum(c.isdigit() for c in raw) <= 15):
            return kind, 0, len(raw)
    for kind, p in _INSIDE:
        for m in p.finditer(raw):
            if kind == "id_number" or 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                return kind, m.start(), m.start() + len(m.group().rstrip(" .-"))
    return None


def _may_hold_address(text: str, words: set[str]) -> bool:
    if not words.isdisjoint(_STREET_SET):
        return True
    return any(text[max(0, m.start() - 8) : m.start()].lower().rstrip().endswith(_ONE_WORD_STREETS) for m in _BLANK_DIGIT.finditer(text))


def feistel(digits: str, key: bytes, back: bool = False) -> str:
    """A keyed permutation of the decimal strings of this length (two or more digits); ``back`` undoes it."""
    n = len(digits)
    if n < 2:
        shift = int.from_bytes(hmac.new(key, b"single", hashlib.sha256).digest()[:4], "big")
        return "".join(str((int(c) + (-shift if back else shift)) % 10) for c in digits)
    u = n // 2
    v = n - u
    a, b = int(digits[:u]), int(digits[u:])

    def f(i: int, x: int, size: int) -> int:
        return int.from_bytes(hmac.new(key, f"{n}:{i}:{x}".encode(), hashlib.sha256).digest()[:16], "big") % 10**size

    # the halves keep their lengths: even rounds change the left one, odd rounds the right one
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if i % 2 == 0:
            a = (a - f(i, b, u) if back else a + f(i, b, u)) % 10**u
        else:
            b = (b - f(i, a, v) if back else b + f(i, a, v)) % 10**v
    return f"{a:0{u}d}{b:0{v}d}"


def national(digits: str, raw: str) -> tuple[str, str]:
    """(kept prefix, digits to permute) of a phone number, so that its spellings share one pseudonym."""
    rest = digits
    if raw.lstrip("(").startswith("+"):
        code = re.match(r"\+(1|44|\d{2})", raw.lstrip("("))
        rest = digits[len(code.group(1)):]
    elif raw.startswith("00"):
        rest = digits[4:]
    elif len(digits) == 11 and digits[0] == "1":
        rest = digits[1:]
    if rest.startswith("0"):
        rest = rest[1:]
    return digits[: len(digits) - len(rest)], rest


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """What stands in the placeholder for a value given in its consistent form."""
    if kind == "phone" and not any(c.isdigit() for c in value):
        words = re.findall(r"[a-z]+", value.lower())
        digits = "".join(SPOKEN[w] for w in words)
        return feistel(digits, key + b"phone")
    if kind == "date":
        return permuted_date(value, key)
    if kind == "card":
        new = iter(permuted_card("".join(c for c in value if c.isdigit()), key))
        return "".join(next(new) if c.isdigit() else c for c in value)
    if kind in ("phone", "id_number"):
        digits = "".join(c for c in value if c.isdigit())
        prefix, rest = national(digits, value) if kind == "phone" else ("", digits)
        new = iter(prefix + feistel(rest, key + kind.encode()))
        return "".join(next(new) if c.isdigit() else c.upper() for c in value)
    plain = re.sub(r"\s*[\[(]?\b(at)\b[\])]?\s*", "@", value) if kind == "email" and "@" not in value else value
    plain = re.sub(r"\s*[\[(]?\bdot\b[\])]?\s*", ".", plain, flags=re.I) if kind == "email" else plain
    plain = re.sub(r"[^\w@.+-]+", " ", fold(plain)).strip(" .")
    return hmac.new(key, f"{kind}:{plain}".encode(), hashlib.sha256).hexdigest()[:10]


_BEFORE_NAMES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "herr", "frau", "name", "called", "talking", "speaking"}
_BIRTH_WORDS = {"born", "birth", "birthday", "birthdate", "dob", "d", "geboren", "geb", "née", "né", "nacido", "nacida", "nato", "nata"}
_FIRM = re.compile(r",?\s+(?:" + "|".join(sorted(LEGAL_FORMS)) + r")\b", re.I)


class Detector:
    """Finds (kind, start, end) in a text in its consistent form; given: folded given names."""

    def __init__(self, given: list[str]) -> None:
        names = {fold(g) for g in given} | set(GIVEN_NAMES) | set(NICKNAMES) | {n for full in NICKNAMES.values() for n in full.split()}
        self.given = {n for n in names if n.isalpha() and len(n) > 1}
        self.word_pair = re.compile(r"(?<![\w'’-])([^\W\d_]{2,})((?:[ ]+[^\W\d_]\.)*[ ]+)((?:" + PARTICLES + r"){0,2})((?:[OD]['’])?[^\W\d_]{2,}(?:[-'’][^\W\d_]+)*)(?![\w])")
        self.seen = self.given | {g.lower() for g in given}
        self.first_word = re.compile(r"(?<![\w'’@.-])[^\W\d_]{2,}(?= )")

    def names(self, text: str) -> Iterator[tuple[str, int, int]]:
        given = self.given
        for w in self.first_word.finditer(text):
            g = w.group()
            low = g.lower()
            if (low if low.isascii() else fold(low)) not in given:
                continue
            m = self.word_pair.match(text, w.start())
            if not m:
                continue
            family = m.group(4)
            if fold(family) in NOT_FAMILY:
                continue
            if g[0].isupper():
                if not family[0].isupper():
                    continue
            elif low in _COMMON_WORDS or not family.islower() or len(family) < 5:
                continue
            if not self.is_other(text, m.start(), m.end()):
                yield "name", m.start(), m.end()

    def is_other(self, text: str, start: int, end: int) -> bool:
        """Whether the words are the speaker label at the start of a text, or a firm."""
        after = text[end : end + 80]
        return bool(_LABEL_END.match(after) and _HEAD.match(text[:start]) or _FIRM.match(after))

    def introduced(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Names told by what stands before them, whatever the given name."""
        for w in _INTRODUCED.finditer(text):
            m = _TWO_CAPITALS.match(text, w.end())
            if m and m.group(1)[0].isupper() and m.group(2)[0].isupper() and fold(m.group(2)) not in NOT_FAMILY and fold(m.group(1)) not in LEGAL_FORMS and not self.is_other(text, m.start(), m.end()):
                yield "name", m.start(), m.end()

    def find(self, text: str) -> list[tuple[str, int, int]]:
        spans: list[tuple[str, int, int]] = []
        low = text.lower()
        words = set(_NO_LETTER.split(low))
        # cheap tests first; each is implied by the pattern it guards
        if "@" in low or "at" in words and ("dot" in words or "(at)" in low or "[at]" in low):
            spans += [("email", m.start(), m.end()) for m in _EMAIL.finditer(text)]
        for m in _NUMBER.finditer(text) if _LONG_NUMBER.search(text) else ():
            if (hit := _number_in(m.group())) is not None:
                spans.append((hit[0], m.start() + hit[1], m.start() + hit[2]))
            elif card := _CARD.fullmatch(m.group()):
                digits = "".join(c for c in card.group() if c.isdigit())
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        if not words.isdisjoint(_SPOKEN_SET):
            spans += [("phone", m.start(), m.end()) for m in _SPOKEN.finditer(text)]
        if _may_hold_address(text, words):
            spans += [("address", m.start(), m.end()) for m in _ADDRESS.finditer(text)]
        if not self.seen.isdisjoint(words if text.isascii() else {w if w.isascii() else fold(w) for w in words}):
            spans += self.names(text)
        if not words.isdisjoint(_BEFORE_NAMES):
            spans += self.introduced(text)
        if not words.isdisjoint(_BIRTH_WORDS):
            spans += [("date", m.start(), m.end()) for m in _DATE.finditer(text) if _BIRTH.search(text[max(0, m.start() - 40) : m.start()]) and date_of(m.group())]
        order = {"email": 0, "card": 1, "date": 2, "id_number": 3, "address": 4, "phone": 5, "name": 6}
        taken: list[tuple[str, int, int]] = []
        for s in sorted(spans, key=lambda x: (order[x[0]], x[1])):
            if all(s[2] <= t[1] or s[1] >= t[2] for t in taken):
                taken.append(s)
        return sorted(taken, key=lambda x: x[1])


def given_names(people: DataFrame, column: str) -> list[str]:
    """Distinct first words of full names, as a checked small list."""
    from factloom.runtime import bounded

    first = F.lower(F.regexp_extract(column, r"^\s*(\p{L}+)\s+\p{L}", 1))
    return sorted(r[0] for r in bounded(people.select(first.alias("g")).where("g <> ''").distinct(), MOST_GIVEN_NAMES, "the list of given names"))


def find_personal(df: DataFrame, keys: list[str], text: str, given: list[str], key: bytes) -> DataFrame:
    """keys, kind, start_pos, end_pos (1-based, inclusive, in the text as delivered), value, pseudonym: a row per piece.

    kind is email, phone, id_number, address, name, card (by its check digit) or date (of birth).

    start_pos is the first letter or digit of the piece. Null and empty texts give no row; repeated rows give repeated rows.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("kind", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("pseudonym", T.StringType()),
    ])
    names = df.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector, tr = Detector(names.value), transducer()
        for batch in batches:
            rows, at = [], []
            for i, raw in enumerate(batch["_text"]):
                form, back = tr.aligned(raw)
                for kind, s, e in detector.find(form):
                    s += next((j for j, c in enumerate(form[s:e]) if c.isalnum()), 0)
                    first, last = (s, e - 1) if back is None else (back[s], back[e] - 1 if e < len(back) else len(raw) - 1)
                    at.append(i)
                    rows.append((kind, first + 1, last + 1, raw[first : last + 1], pseudonym(kind, form[s:e], key)))
            out = pd.DataFrame(rows, columns=schema.names[len(keys):])
            for k in keys:
                out[k] = batch[f"_k_{k}"].take(at).to_numpy()
            yield out[schema.names]

    part = df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(text).alias("_text")).where(F.length("_text") > 0)
    return part.mapInPandas(run, schema)


def redact(df: DataFrame, text: str, given: list[str], key: bytes, out: str = "redacted") -> DataFrame:
    """Adds ``out``: the text with [KIND pseudonym] in place of each piece and all else unchanged; null stays null."""
    names = df.sparkSession.sparkContext.broadcast(given)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        detector, tr = Detector(names.value), transducer()
        res = []
        for raw in texts:
            if raw is None:
                res.append(None)
                continue
            form, back = tr.aligned(raw)
            parts, last = [], 0
            for kind, s, e in detector.find(form):
                a, b = (s, e) if back is None else (back[s], back[e] if e < len(back) else len(raw))
                parts += [raw[last:a], f"[{kind.upper()} {pseudonym(kind, form[s:e], key)}]"]
                last = b
            res.append("".join([*parts, raw[last:]]))
        return pd.Series(res, dtype=object)

    return df.withColumn(out, run(F.col(text)))
