"""Column expressions over text: normal form, tokenisers, splitters, numbers, measures, names.

All are built from JVM functions, so they stay inside generated code or higher-order functions; null in
gives null (or an empty array) out, and an empty text the empty result of its type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import lexicon as L

# Every kind of white space, the same set for Java's and RE2's regular expressions.
BLANK = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_MARK = "\x02"


def let(col: Column, f) -> Column:
    """f(value of col), with the value computed once although f uses it inside lambdas."""
    return F.get(F.transform(F.array(col), f), F.lit(0))


def normalise(col: Column) -> Column:
    """Lower case, straight quotes, single spaces, without blanks, quotes, full stops and commas at the ends."""
    folded = F.translate(F.lower(col), "’‘“”", "''\"\"")
    return F.btrim(F.regexp_replace(folded, BLANK + "+", " "), F.lit(" \t\n\"'.,"))


def folded(col: Column) -> Column:
    """The form classifiers match: lower case, straight quotes, single spaces; null counts as empty."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(F.coalesce(col, F.lit(""))), "’‘“”", "''\"\""), BLANK + "+", " "))


def words(col: Column, shortest: int = 1) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("[a-z0-9]+" if shortest == 1 else f"[a-z0-9]{{{shortest},}}"), F.lit(0))


def _not_in(stop: set[str]):
    return lambda w: ~w.isin(*sorted(stop))


def stem(w: Column) -> Column:
    """ing and ed off where three letters stay, else the plural s of words of four letters or more."""
    n = F.length(w)
    return (
        F.when(w.endswith("ing") & (n >= 6), F.substring(w, F.lit(1), n - 3))
        .when(w.endswith("ed") & (n >= 5), F.substring(w, F.lit(1), n - 2))
        .when(w.endswith("s") & (n >= 4), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def topic_stem(w: Column) -> Column:
    """The first fitting suffix off, longest families first; ies becomes y."""
    out = None
    for suffix in L.TOPIC_SUFFIXES:
        cut = F.substring(w, F.lit(1), F.length(w) - len(suffix))
        cut = F.concat(cut, F.lit("y")) if suffix == "ies" else cut
        test = w.endswith(suffix) & (F.length(w) >= len(suffix) + 3)
        out = F.when(test, cut) if out is None else out.when(test, cut)
    return out.otherwise(w)


def plural_stem(w: Column, longer_than: int) -> Column:
    return F.when(w.endswith("s") & (F.length(w) > longer_than), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def content_words(col: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(words(col), lambda w: (F.length(w) >= 3) & _not_in(L.STORY_STOP)(w)), stem))


def significant_words(col: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(words(col), stem), lambda w: (F.length(w) >= 4) & _not_in(L.STORY_STOP | L.GENERIC)(w)))


def link_words(col: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(words(col), lambda w: (F.length(w) >= 4) & _not_in(L.LINK_STOP)(w)), stem))


def link_surfaces(col: Column) -> Column:
    """(stem, word) of the link words, in order of appearance."""
    return F.transform(F.filter(words(col), lambda w: (F.length(w) >= 4) & _not_in(L.LINK_STOP)(w)), lambda w: F.struct(stem(w).alias("stem"), w.alias("word")))


def feature_words(col: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(words(col), _not_in(L.ROUTING_STOP)), lambda w: plural_stem(w, 3)))


def topic_words(col: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(words(col, 4), _not_in(L.TOPIC_STOP)), topic_stem))


def merge_words(col: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(words(col, 3), _not_in(L.MERGE_STOP)), lambda w: plural_stem(w, 4)))


TOKENISERS = {"content": content_words, "significant": significant_words, "link": link_words, "feature": feature_words, "topic": topic_words, "merge": merge_words}


def sentences(col: Column) -> Column:
    """Parts after . ! or ? and white space."""
    return F.split(F.regexp_replace(col, f"([.!?]){BLANK}+", "$1" + _MARK), _MARK)


def strict_sentences(col: Column) -> Column:
    """As sentences, but only before a capital letter or an opening bracket."""
    return F.split(F.regexp_replace(col, f"([.!?]){BLANK}+([A-Z(])", "$1" + _MARK + "$2"), _MARK)


def clauses(col: Column) -> Column:
    """Clauses of all strict sentences: split at ; but, however, whereas and a comma with and."""
    parts = F.flatten(F.transform(strict_sentences(col), lambda s: F.split(F.regexp_replace(s, "(?i)" + L.CLAUSE_BREAK, _MARK), _MARK)))
    return F.filter(F.transform(parts, lambda c: F.btrim(c, F.lit(" ,;\t\n"))), lambda c: c != "")


def strip_speaker(col: Column) -> Column:
    """The line without "[time] " and a speaker of up to 40 characters before a colon."""
    return F.regexp_replace(col, r"^(?:\[[^\]]+\]\s*)?[^:]{1,40}:\s*", "")


def strip_thinking(col: Column) -> Column:
    """A model reply without its thinking; what follows a dangling closing tag is the reply."""
    return F.btrim(F.substring_index(F.regexp_replace(col, "(?is)<think>.*?</think>", ""), "</think>", -1))


def slug(col: Column) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", "unnamed-feature").otherwise(s)


def decamel(col: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(col, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.btrim(F.regexp_replace(s, r"\s+", " "))


def digit_numbers(col: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"[0-9][0-9,]*"), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit(""))))


def numerals(col: Column) -> Column:
    """Numbers in digits or words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(L.NUMBER_TOKEN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit(""))))


def story_numbers(col: Column) -> Column:
    """Number tokens and number or unit words, as a story is checked for."""
    low = F.lower(F.coalesce(col, F.lit("")))
    digits = F.transform(F.regexp_extract_all(low, F.lit(r"\b[0-9]+(?:[.,][0-9]+)?\b"), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")))
    return F.array_distinct(F.concat(digits, F.filter(words(col), lambda w: w.isin(*sorted(L.NUMBER_WORDS)))))


def number_value(token: Column) -> Column:
    t = F.replace(F.lower(token), F.lit(","), F.lit(""))
    table = F.create_map(*[F.lit(x) for k, v in L.WORD_VALUES.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, t), t.try_cast("double"))



def measures(col: Column) -> Column:
    """array<struct<unit, value>> of "number unit" pairs; plurals and "business" are dropped."""
    low = F.lower(F.coalesce(col, F.lit("")))
    pattern = "(" + L.NUMBER_TOKEN + r")\s*(business days?|requests? per minute|" + L.MEASURE_UNITS + r")(?:[^a-z]|$)"
    pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(low, F.lit(pattern), F.lit(2)).alias("u"))
    out = F.transform(pairs, lambda p: F.struct(F.regexp_replace(F.replace(p["u"], F.lit("business "), F.lit("")), "s$", "").alias("unit"), number_value(p["n"]).alias("value")))
    return F.array_distinct(F.filter(out, lambda m: m["value"].isNotNull()))


def is_multipart(col: Column) -> Column:
    """Two or more parts between ; and , hold a number; a thousands separator doesn't part."""
    joined = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"([0-9]),([0-9]{3})\b", "$1$2")
    return F.size(F.filter(F.split(joined, "[;,]"), lambda p: p.rlike(L.NUMBER_TOKEN))) >= 2


def destub(col: Column) -> Column:
    """Without a leading build verb, capitalised again."""
    lead = rf"(?i)^(?:please\s+)?(?:{L.STUB_VERBS})\s+"
    rest = F.btrim(F.regexp_replace(col, lead, ""))
    return F.when(col.rlike(lead) & (rest != ""), F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))).otherwise(col)


def _capital(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, F.lit(2), F.length(col)))


def summary_from_quote(quote: Column, most: int = 24) -> Column:
    """A one-line summary in the speaker's own words."""
    q = F.btrim(F.coalesce(quote, F.lit("")), F.lit(" \t\n\""))
    bare = F.btrim(F.regexp_replace(q, L.QUOTE_FILLER, ""))
    parts = F.split(bare, r"\s+")
    first = F.element_at(F.split(F.regexp_replace(bare, r"([,;:])\s", "$1" + _MARK), _MARK), 1)
    short = F.when(F.size(parts) <= most, bare).when((F.size(F.split(first, r"\s+")) >= 6) & (first != bare), first).otherwise(F.array_join(F.slice(parts, 1, most), " "))
    return F.when(bare == "", q).otherwise(destub(_capital(F.concat(F.rtrim(short, F.lit(" .!?;:,")), F.lit(".")))))


def repair_summary(summary: Column, quote: Column, overlap: float = 0.35, novel: int = 2) -> Column:
    """The summary, or one made from the quote where it is empty, drifts from the quote, adds to it or narrates."""
    s = F.btrim(F.coalesce(summary, F.lit("")))
    sw, qw = content_words(s), content_words(quote)
    share = F.size(F.array_intersect(sw, qw)) / F.greatest(F.size(sw), F.lit(1))
    extra = F.filter(F.array_except(sw, qw), lambda w: (F.length(w) >= 4) & _not_in(L.STORY_GLUE | L.NUMBER_WORDS)(w))
    bad = (s == "") | (F.size(sw) == 0) | (share < overlap) | (F.size(extra) >= novel) | F.lower(s).rlike(L.NARRATION)
    return F.when(bad, summary_from_quote(quote)).otherwise(s)


def is_bad_area(name: Column) -> Column:
    """No usable title: empty, led by a filler, noun and modal, or only generic words."""
    t = words(name)
    empty_words = L.STORY_STOP | L.GENERIC | L.AREA_BAD_LEAD | L.NAME_STOP
    first, second = F.try_element_at(t, F.lit(1)), F.try_element_at(t, F.lit(2))
    lead = first.isin(*sorted(L.AREA_BAD_LEAD | L.NAME_STOP))
    modal = (F.size(t) == 2) & second.isin(*sorted(L.NAME_STOP))
    return (F.size(t) == 0) | F.coalesce(lead, F.lit(False)) | F.coalesce(modal, F.lit(False)) | F.forall(t, lambda w: w.isin(*sorted(empty_words)) | (F.length(w) < 3))


def is_dump_area(name: Column) -> Column:
    last = F.try_element_at(words(name), F.lit(-1))
    return F.lower(F.btrim(name)).isin(*sorted(L.DUMP_NAMES)) | is_bad_area(name) | F.coalesce(last.isin(*sorted(L.DUMP_LAST)), F.lit(False))


def clean_area(name: Column) -> Column:
    """A typed area as a title of up to four words; empty where nothing usable is left."""
    s = F.btrim(F.btrim(F.btrim(F.coalesce(name, F.lit("")), F.lit(" \t\n")), F.lit('"*')), F.lit(" \t\n"))
    s = F.btrim(F.substring_index(F.substring_index(s, " (", 1), " -- ", 1))
    before, after = F.btrim(F.regexp_extract(s, r"(?is)^(.*?)\bNEW\s*:\s*(.*)$", 1)), F.btrim(F.regexp_extract(s, r"(?is)^(.*?)\bNEW\s*:\s*(.*)$", 2))
    s = F.when(s.rlike(r"(?i)\bNEW\s*:"), F.when(before != "", before).otherwise(after)).otherwise(s)
    parts = F.filter(F.split(decamel(s), " "), lambda w: w != "")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & F.lower(w).isin(*sorted(L.AREA_BAD_LEAD)), acc).otherwise(F.concat(acc, F.array(w))))
    title = F.array_join(F.slice(kept, 1, 4), " ")
    return F.when(is_bad_area(title), "").otherwise(title)


def area_from_summary(summary: Column, fallback: Column) -> Column:
    """The first two distinctive words of a summary as a title; else the fallback if usable, else Misc."""
    skip = L.LEADING_VERBS | L.STORY_STOP | L.AREA_BAD_LEAD | L.NAME_STOP
    kept = F.filter(words(summary), lambda w: (F.length(w) >= 4) & _not_in(skip | L.GENERIC)(w))
    name = F.initcap(F.array_join(F.slice(kept, 1, 2), " "))
    return F.when(name != "", name).when(~is_bad_area(F.coalesce(fallback, F.lit(""))), fallback).otherwise("Misc")


def clock_millis(ts: Column) -> Column:
    """Milliseconds of HH:MM:SS with , or . and up to three digits, brackets and ranges allowed; null if it is none."""
    p = r"^\W*(?:(\d{1,3}):)?(\d{1,3}):(\d{2})(?:[.,](\d{1,3}))?(?:\D.*)?$"
    part = lambda i: F.regexp_extract(ts, p, i)
    zero = lambda c: F.when(c == "", F.lit(0)).otherwise(c.try_cast("int"))
    millis = F.when(part(4) == "", F.lit(0)).otherwise(F.rpad(part(4), 3, "0").try_cast("int"))
    return F.when(ts.rlike(p), ((zero(part(1)) * 60 + zero(part(2))) * 60 + zero(part(3))).cast("long") * 1000 + millis)
