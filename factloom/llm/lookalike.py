"""Problem 4: one consistent form for text that looks the same.

A transducer is compiled once per process from rules over the Unicode database: its input symbols are
grapheme clusters (a base with its marks, an emoji with its joiners), its output the consistent form.
At every position the longest mapped cluster wins, and one pass over the text applies every rule.

Building checks the table for conflicts: no cluster may map to two outputs, and no output may contain
a cluster that is mapped again (so the form is stable under repetition).

Letters that look alike across scripts go to the Latin letter wherever they occur; the result is a form
for comparison, in which a Cyrillic word may show Latin letters.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that Unicode's list of confusable characters gives for a Latin letter (letter for
# letter, same case; a capital that it gives for small l stands for capital I), but those whose shape differs in common typefaces
# (alpha, gamma, iota, sigma). Dashes of other lengths are no look-alikes.
LOOKALIKES = {
    # Greek and Coptic
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϝ": "F", "Ϻ": "M", "Ϳ": "J",
    "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "κ": "k", "τ": "t",
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԍ": "G", "Ԝ": "W", "Ѵ": "V", "Ү": "Y", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y", "ҽ": "e",
    # Armenian
    "Ս": "U", "Տ": "S", "Օ": "O", "ա": "w", "գ": "q", "զ": "q", "հ": "h", "ո": "n", "ռ": "n", "ս": "u", "ց": "g", "ք": "f", "օ": "o",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ᏻ": "G", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Latin and its small capitals
    "ɡ": "g", "ɑ": "a", "ᴄ": "c", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ƽ": "s", "ꞌ": "'",
    # hyphens
    "‐": "-", "‑": "-",
}
# Characters without a picture that Unicode does not list as format characters.
FILLERS = "͏ᅟᅠ឴឵᠋᠌᠍⠀ㅤﾠ"
HALF_WIDTH_MARKS = "ﾞﾟ"
MOST_CLUSTERS = 200_000
JOINER = "‍"
_PICTURE = "[©®‼-㊙\U0001f000-\U0001faff]"
_VARIATION = "[︀-️]"


class Conflict(ValueError):
    """Two rules give one cluster two forms, or a form holds a cluster that is mapped again."""


def build_table() -> dict[str, str]:
    """Cluster -> consistent form, from rules; raises Conflict."""
    table: dict[str, str] = {}

    def put(cluster: str, form: str) -> None:
        if cluster == form:
            return
        if table.setdefault(cluster, form) != form:
            raise Conflict(f"{cluster!a} to {table[cluster]!a} and {form!a}")

    composed: dict[str, str] = {}
    marks: set[str] = set()
    for code in itertools.chain(range(0x80, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200)):  # no other plane has any
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or ch in LOOKALIKES:
            continue
        kind = unicodedata.category(ch)
        how = unicodedata.decomposition(ch)
        if kind in ("Cf", "Cc") and ch not in "\x85" or ch in FILLERS:
            put(ch, "")
        elif kind == "Zs":
            put(ch, " ")
        elif how.startswith(("<wide>", "<narrow>")):
            form = unicodedata.normalize("NFKC", ch)
            put(ch, {"ㅤ": ""}.get(form, form))
        elif how.startswith("<compat>") and (0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F):  # ligatures, Roman numerals
            put(ch, unicodedata.normalize("NFKC", ch))
        elif how.startswith("<font>"):  # letters of mathematical alphabets
            put(ch, unicodedata.normalize("NFKC", ch))
        elif how and not how.startswith("<"):
            form = unicodedata.normalize("NFC", ch)
            if form != ch:
                put(ch, form)
            else:
                composed[unicodedata.normalize("NFD", ch)] = ch
                marks.update(unicodedata.normalize("NFD", ch)[1:])
    for alike, latin in LOOKALIKES.items():
        put(alike, latin)
    put("\t", " ")
    put(" ", "\n")
    put(" ", "\n")
    put("\r\n", "\n")
    # accents: a base, in any of its looks, followed by the marks of a composed letter
    looks: dict[str, list[str]] = {}
    for cluster, form in table.items():
        if len(cluster) == 1 and len(form) == 1 and form.isalpha():
            looks.setdefault(form, []).append(cluster)
    for parts, ch in composed.items():
        base, rest = parts[0], parts[1:]
        base = table.get(base, base)
        form = unicodedata.normalize("NFC", base + rest)
        if form != ch:  # a look-alike base: the composed letter goes to the Latin one
            put(ch, form)
        for look in [base, *looks.get(base, [])]:
            put(look + rest, form)
    for _ in range(4):  # forms that are mapped themselves settle on the last form
        again = {k: new for k, form in table.items() if (new := "".join(table.get(ch, ch) for ch in form)) != form}
        if not again:
            return table
        table |= again
    raise Conflict(f"no stable form for {sorted(again)[:5]!a}")


def _ranges(codes: Iterable[int]) -> str:
    """Character class of code points, as ranges."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(re.escape(chr(a)) + "-" + re.escape(chr(b)) for a, b in out)


class Transducer:
    """The compiled table. ``form`` rewrites a text; ``aligned`` also tells where each output character came from.

    All characters, and all clusters that Unicode has a composed letter for, are in the table beforehand; any other
    base with its marks follows the same rule when it is first met, and is then kept.
    """

    def __init__(self) -> None:
        self.table = build_table()
        single = sorted(k for k in self.table if len(k) == 1)
        self.single = {ord(k): self.table[k] for k in single}
        mark = _ranges(c for c in range(0x300, 0x10000) if unicodedata.combining(chr(c))) + HALF_WIDTH_MARKS
        blank = "".join(re.escape(k) for k in single if not self.table[k] and k < "\U00010000")
        # A cluster of several characters: an emoji with its joiners, or a base with marks (format characters between them
        # have no picture); else any single mapped character. Alternatives stand longest first.
        emoji = f"{_PICTURE}{_VARIATION}?(?:{JOINER}{_PICTURE}{_VARIATION}?)+"
        marked = f"[^\\s{mark}{blank}](?:[{blank}]*[{mark}])+"
        jamo = "[\u1100-\u115e\u1161-\u11ff]{2,}"  # letters of a Hangul syllable
        ones = "[" + "".join(re.escape(k) for k in single if k < "\U00010000") + "]|[\U00010000-\U0010ffff]"
        self.pattern = re.compile(f"({emoji})|({marked})|{jamo}|\r\n|{ones}")
        self.simple = re.compile(ones)
        self.several = re.compile(f"[{mark}{JOINER}\u1100-\u11ff\r]")  # without these every cluster is one character
        self.blank = {ord(k): None for k in single if not self.table[k]}

    def _one(self, m: re.Match) -> str:
        cluster = m.group()
        if len(cluster) == 1:
            return self.table.get(cluster, cluster)
        if m.group(1):
            return cluster
        if (form := self.table.get(cluster)) is not None:
            return form
        plain = unicodedata.normalize("NFD", cluster.translate(self.blank))
        form = unicodedata.normalize("NFC", "".join(self.table.get(c, c) for c in plain))
        if len(self.table) < MOST_CLUSTERS:
            self.table[cluster] = form  # the rest of the same cluster's occurrences look it up
        return form

    def _single(self, m: re.Match) -> str:
        return self.table.get(m.group(), m.group())

    def form(self, text: str | None) -> str | None:
        if text is None:
            return None
        if not (text.isascii() and text.isprintable()):
            text = self.pattern.sub(self._one, text) if self.several.search(text) else self.simple.sub(self._single, text)
        return text.strip(" \n")

    def aligned(self, text: str) -> tuple[str, list[int] | None]:
        """The form without trimming, and for each of its characters the position in ``text`` (None: the same)."""
        if text.isascii():
            return text.replace("\t", " "), None
        out, at, last = [], [], 0
        for m in (self.pattern if self.several.search(text) else self.simple).finditer(text):
            start = m.start()
            out.append(text[last:start])
            at.extend(range(last, start))
            new = self._one(m)
            out.append(new)
            at.extend([start] * len(new))
            last = m.end()
        out.append(text[last:])
        at.extend(range(last, len(text)))
        return "".join(out), at


@functools.lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


@F.pandas_udf(T.StringType())
def _form_udf(texts: pd.Series) -> pd.Series:
    form = transducer().form
    return pd.Series(np.array([None if t is None else form(t) for t in texts], dtype=object))


def consistent(col: Column) -> Column:
    """The consistent form of a text column; null stays null.

    Plain ASCII text, the common case, is only trimmed, inside the JVM: no text of it travels to Python.
    """
    odd = col.rlike(r"[^\x20-\x7E]")
    return F.when(odd, _form_udf(F.when(odd, col))).otherwise(F.btrim(col))


def same_looking(left: DataFrame, right: DataFrame, on: list[str], left_text: str, right_text: str) -> DataFrame:
    """Pairs of rows with equal ``on`` whose texts differ as strings and look the same.

    Only digests travel through the shuffle, never texts, and the digest is part of the key, so a key with
    very many rows is spread over all tasks. Null texts match nothing; empty texts look like each other.
    Columns: ``on``, and the other columns of both sides; of columns both sides have, the left one's.
    """
    right = right.drop(*[c for c in left.columns if c in right.columns and c not in (*on, right_text)])

    def side(df: DataFrame, text: str, digest: str) -> DataFrame:
        df = df.where(F.col(text).isNotNull())
        return df.select(*[c for c in df.columns if c != text], F.md5(consistent(F.col(text)).cast("binary")).alias("_form"), F.md5(F.col(text).cast("binary")).alias(digest))

    pairs = side(left, left_text, "_l").join(side(right, right_text, "_r"), [*on, "_form"])
    return pairs.where(F.col("_l") != F.col("_r")).drop("_form", "_l", "_r")
