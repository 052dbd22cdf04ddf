"""Grounding: no quote without its place in the source.

A quote is verbatim if its normal form is part of the normal form of its call's lines, taken together in line order;
it may run over any number of lines, whatever gaps their numbers have. Lines are ranked within their call. Words
inside the quote are whole words of the call too, so candidates come from an equality join on the quote's rarest
inner 3-gram of words (which may itself run over lines); texts are fetched for the few places so found, by rank.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.config import CONFIG, Config
from factloom.functions import text as X
from factloom.runtime import broadcast_if_small, checkpoint, written

_TOKEN = "[a-z0-9]+"


LINES_A_BLOCK = 100_000
ANCHORS = 4
"""3-grams of a quote, picked by hash, of which the rarest is sought. Any one would do: a verbatim quote has them all."""
MOST_CALLS = 500_000
MOST_PLACES = 300_000
"""Lines looked at up to which the others are dropped before texts are shuffled; of more, few would be dropped."""
MOST_GRAMS = 1_000_000
"""Grams asked for, of 8 bytes each, up to which they are sent to every executor."""


def _grams(tokens):
    """Hashes of all 3-grams of a token array."""
    return X.let(F.transform(tokens, lambda w: F.xxhash64(w)), _grams_of)


def _grams_of(t):
    """The same of the hashes of tokens."""
    return F.transform(F.slice(t, 3, F.greatest(F.size(t) - 2, F.lit(0))), lambda z, i: F.xxhash64(F.get(t, i), F.get(t, i + 1), z))


def _gram(*tokens: str):
    return F.xxhash64(*[F.xxhash64(t) for t in tokens])


def _blocks_of_lines(turns: DataFrame, *columns: str) -> DataFrame:
    """Lines with a text, once each, in blocks of line numbers; with body, the text in single blanks, norm, and within the block _r, words and _c, characters before.

    Texts go through one shuffle, which serves the removal of repeats and the windows.
    """
    lines = turns.where("text is not null and source_id is not null").select("source_id", F.col("line_no").cast("int").alias("line_no"), "text")
    lines = lines.withColumn("_blk", F.floor(F.col("line_no") / LINES_A_BLOCK)).repartition("source_id", "_blk")
    lines = lines.groupBy("source_id", "_blk", "line_no").agg(F.first("text").alias("text"))
    # most texts are of ASCII characters in single blanks: these need no look at each character
    ascii = lambda c: F.octet_length(c) == F.length(c)
    lines = lines.withColumn("body", F.btrim(F.when(ascii("text") & ~F.col("text").rlike("[\\t-\\r]|  "), F.col("text")).otherwise(F.regexp_replace("text", X.BLANK + "+", " "))))
    lines = lines.withColumn("norm", F.when(ascii("body"), F.lower("body")).otherwise(F.translate(F.lower("body"), "’‘“”", "''\"\""))).withColumns({"_w": F.col("norm").rlike(_TOKEN).cast("long"), "_n": F.when(F.col("norm") != "", F.length("norm") + 1).otherwise(0).cast("long")})
    inside = Window.partitionBy("source_id", "_blk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"_r": F.sum("_w").over(inside), "_c": F.sum("_n").over(inside) - F.col("_n")})
    return written(lines.select("source_id", "_blk", "line_no", "norm", "_w", "_n", "_r", "_c", *columns))


def _ranked(lines: DataFrame) -> DataFrame:
    lines = lines.where("line_no is not null")
    before = Window.partitionBy("source_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("source_id", "_blk").agg(F.sum("_w").alias("_w"), F.sum("_n").alias("_n"))
    blocks = blocks.select("source_id", "_blk", F.sum("_w").over(before).alias("_ranks"), F.sum("_n").over(before).alias("_chars"))
    later = checkpoint(blocks.where("_ranks is not null"))  # none of a call of one block
    ranked = lines.where("norm <> ''").join(broadcast_if_small(later, MOST_CALLS), ["source_id", "_blk"], "left")
    return ranked.select("source_id", "line_no", (F.col("_r") + F.coalesce("_ranks", F.lit(0))).alias("rank"), "norm", (F.col("_c") + F.coalesce("_chars", F.lit(0))).alias("start"))


def line_norms(turns: DataFrame) -> DataFrame:
    """source_id, line_no, rank, norm, start: the folded text of each line that is not blank.

    rank counts the lines of a call that have words, in line order; a line without words shares the rank of the one
    before. start is the number of characters of the call before the line, one blank between lines. Both come
    from windows over blocks of line numbers and over one row per block.
    """
    return _ranked(_blocks_of_lines(turns))


def _postings(lines: DataFrame) -> DataFrame:
    """source_id, g, rank: the words and 3-grams of words of each call, with the rank of the line each begins in. No texts."""
    lines = lines.where(F.col("norm").rlike(_TOKEN))
    hashes = F.transform(F.regexp_extract_all("norm", F.lit(_TOKEN), F.lit(0)), lambda w: F.xxhash64(w))
    inner = lines.select("source_id", F.explode(X.let(hashes, lambda h: F.concat(h, _grams_of(h)))).alias("g"), "rank")
    # the first or last two words, without a look at those between
    one, two = [r"\A[^a-z0-9]*+" + words for words in ("([a-z0-9]++)", "[a-z0-9]++[^a-z0-9]++([a-z0-9]++)")]
    word = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    back = F.reverse(F.col("norm"))
    head = lines.select("source_id", (F.col("rank") - 1).alias("rank"), word(F.col("norm"), one).alias("a"), word(F.col("norm"), two).alias("b"))
    # the second word after a line of one word is the first word of the line after that
    after = head.select("source_id", (F.col("rank") - 1).alias("rank"), F.col("a").alias("c"))
    head = head.join(after.hint("merge"), ["source_id", "rank"], "left").select("source_id", "rank", "a", F.coalesce("b", "c").alias("b"))
    tail = lines.select("source_id", "rank", F.reverse(word(back, two)).alias("y"), F.reverse(word(back, one)).alias("z"))
    edge = tail.join(head.hint("merge"), ["source_id", "rank"])
    over = edge.select("source_id", F.explode(F.array(F.when(F.col("y").isNotNull(), _gram("y", "z", "a")), F.when(F.col("b").isNotNull(), _gram("z", "a", "b")))).alias("g"), "rank").where("g is not null")
    return inner.union(over)


def _words_with(short: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """_key, source_id, g: words of the call that hold the longest word of a quote of one or two words."""
    longest = F.array_max(F.transform("_t", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).getField("w")
    q = short.select("_key", "source_id", longest.alias("_l")).withColumn("_c", F.substring("_l", 1, 3))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substring(F.col("word"), i, n))))
    v = vocabulary.select("source_id", "word", F.explode(F.array_distinct(pieces)).alias("_c"))
    return q.join(v.hint("merge"), ["source_id", "_c"]).where(F.expr("contains(word, _l)")).select("_key", "source_id", F.xxhash64("word").alias("g"))


def _located(hits: DataFrame, lines: DataFrame, reach) -> DataFrame:
    """Of hits(_key, source_id, _q, rank) those whose quote stands in the lines from ``reach`` before to ``reach`` after: adds line_no, where it begins,
    and runs_on: whether the line before or after the place's is wholly inside the quote, without which it can't reach further.

    The lines around a place are put together once, for all quotes that are sought there.
    """
    need = hits.groupBy("source_id", "rank").agg(F.max(reach).alias("_reach"))
    wanted = need.select("source_id", "rank", F.explode(F.sequence(F.col("rank") - F.col("_reach"), F.col("rank") + F.col("_reach"))).alias("_at"))
    looked = wanted.select(F.xxhash64("source_id", "_at").alias("_k")).distinct()
    texts = lines.select("source_id", F.col("rank").alias("_at"), "line_no", "norm").withColumn("_k", F.xxhash64("source_id", "_at"))
    texts = texts.join(broadcast_if_small(looked, MOST_PLACES), "_k", "left_semi").drop("_k")
    around = wanted.join(texts.hint("merge"), ["source_id", "_at"]).groupBy("source_id", "rank").agg(F.array_sort(F.collect_list(F.struct("line_no", "norm", "_at"))).alias("_l"))
    got = hits.join(around.hint("merge"), ["source_id", "rank"]).withColumn("_p", F.expr("locate(_q, array_join(transform(_l, x -> x.norm), ' '))"))
    # the line that holds character _p: lines are passed as long as they end before it
    walk = F.aggregate("_l", F.struct(F.lit(0).alias("end"), F.lit(None).cast("int").alias("line")), lambda acc, x: F.struct((acc.end + F.length(x.norm) + 1).alias("end"), F.when(acc.end < F.col("_p"), x.line_no).otherwise(acc.line).alias("line")))
    beside = lambda step: F.expr(f"array_join(transform(filter(_l, x -> x._at = rank + {step}), x -> x.norm), ' ')")
    inside = lambda c: F.expr(f"contains(_q, {c})") & (F.col(c) != "")
    got = got.withColumns({"_before": beside(-1), "_after": beside(1)})
    return got.select("_key", "source_id", "_q", "rank", F.when(F.col("_p") > 0, walk.getField("line")).alias("line_no"), ((F.col("_p") == 0) & (inside("_before") | inside("_after"))).alias("runs_on"))


def verbatim_lines(quotes: DataFrame, key: str, quote: str, lines: DataFrame) -> DataFrame:
    """(key, line_no): for each quote found verbatim, the first line that holds (or begins) it.

    ``quotes`` has ``key``, source_id and the quote; ``lines`` is of ``line_norms``. Quotes without letters or digits are
    never verbatim. Equal quotes of a call are sought once.
    """
    q = quotes.select(F.col(key).alias("_id"), "source_id", X.normalise(F.col(quote)).alias("_q")).where(F.col("_q").rlike(_TOKEN)).withColumn("_key", F.xxhash64("source_id", "_q"))
    q = written(q.distinct())
    one = q.groupBy("_key", "source_id", "_q").agg(F.lit(1)).select("_key", "source_id", "_q", F.regexp_extract_all("_q", F.lit(_TOKEN), F.lit(0)).alias("_t"))
    # inner words are whole words of the call: 3-grams of them, or single ones where there are fewer than three
    within = F.slice("_t", 2, F.greatest(F.size("_t") - 2, F.lit(0)))
    by_three = one.where(F.size("_t") >= 5).select("_key", "source_id", F.explode(F.slice(F.array_sort(F.array_distinct(_grams(within))), 1, ANCHORS)).alias("g"))
    few = one.where(F.size("_t").between(3, 4))
    by_one = few.select("_key", "source_id", F.explode(F.array_distinct(F.transform(within, lambda w: F.xxhash64(w)))).alias("g"))
    short = one.where(F.size("_t") <= 2)
    words = lines.select("source_id", F.explode(F.regexp_extract_all("norm", F.lit(_TOKEN), F.lit(0))).alias("word"), "rank")
    with_call = lambda df: df.withColumn("g", F.xxhash64("source_id", "g"))
    asked = with_call(by_three.union(by_one)).withColumn("rarest", F.lit(True))
    calls = short.select("source_id").distinct()
    if not calls.isEmpty():
        held = _words_with(short, words.join(broadcast_if_small(calls, MOST_CALLS), "source_id", "left_semi").select("source_id", "word").distinct())
        asked = asked.union(with_call(held).withColumn("rarest", F.lit(False)))
    asked = checkpoint(asked)
    postings = with_call(_postings(lines)).select("g", "rank")
    # where few grams are asked for, others are dropped before anything is shuffled
    kept = checkpoint(postings.join(broadcast_if_small(asked.select("g").distinct(), MOST_GRAMS), "g", "left_semi").distinct())
    df = kept.groupBy("g").agg(F.count("*").alias("df"))
    # a gram the call doesn't have makes its quote hopeless
    counted = asked.where("rarest").join(df.hint("merge"), "g", "left").groupBy("_key", "source_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("m"))
    sought = counted.where("m.df > 0").select("_key", "source_id", "m.g").union(asked.where("not rarest").select("_key", "source_id", "g"))
    places = sought.join(kept.hint("merge"), "g").select("_key", "source_id", "rank").distinct()
    hits = written(places.join(one.select("_key", "_q").hint("merge"), "_key"))
    near = written(_located(hits, lines, F.lit(1)))
    # a quote reaches over at most as many lines as it has words
    far = _located(near.where("runs_on and line_no is null").drop("line_no", "runs_on"), lines, F.size(F.regexp_extract_all("_q", F.lit(_TOKEN), F.lit(0))))
    found = near.select("_key", "line_no").union(far.select("_key", "line_no")).where("line_no is not null").groupBy("_key").agg(F.min("line_no").alias("line_no"))
    return q.join(found.hint("merge"), "_key").select(F.col("_id").alias(key), "line_no")


def ground(statements: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """Adds is_verbatim and quote_line to statements (with source_id, quote and a unique ``key``)."""
    return _with_place(statements, verbatim_lines(statements, key, "quote", line_norms(turns)), key)


def _with_place(statements: DataFrame, found: DataFrame, key: str) -> DataFrame:
    out = statements.join(found.withColumnRenamed("line_no", "quote_line").hint("merge"), key, "left")
    return out.withColumn("is_verbatim", F.col("quote_line").isNotNull())


def _spans(lines: DataFrame, shortest: int) -> DataFrame:
    """source_id, line_no, part, span: quotable lines and sentences of lines with text."""
    body = F.btrim(F.regexp_replace("text", X.BLANK + "+", " "))
    lines = lines.select("source_id", "line_no", body.alias("body")).where(F.length("body") >= shortest)
    parts = F.transform(X.sentences(F.col("body")), lambda s: F.btrim(s))
    kept = F.concat(F.array("body"), F.filter(parts, lambda s: (F.length(s) >= shortest) & (F.length(s) < F.length(F.col("body")))))
    return lines.select("source_id", "line_no", F.posexplode(kept).alias("part", "span"))


def candidate_spans(turns: DataFrame, shortest: int = CONFIG.shortest_span) -> DataFrame:
    """source_id, span, span_ord: quotable lines and sentences, distinct within a call, longest first.

    Ties in length keep the order of appearance. span_ord is the rank within (source_id, length), with the
    length first in the order, so that no window runs over a whole call: order by length desc, line_no, part.
    """
    spans = _spans(turns.where("text is not null").dropDuplicates(["source_id", "line_no"]), shortest)
    return spans.groupBy("source_id", "span").agg(F.min(F.struct("line_no", "part")).alias("at")).select("source_id", "span", F.length("span").alias("n"), "at.line_no", "at.part")


def similarity(a: str, b: str) -> float:
    """The larger of the character and the word sequence ratio."""
    words = difflib.SequenceMatcher(None, a.split(), b.split()).ratio()
    m = difflib.SequenceMatcher(None, a, b)
    if m.real_quick_ratio() <= words or m.quick_ratio() <= words:  # upper bounds of the ratio
        return words
    return max(words, m.ratio())


SPANS_A_BLOCK = 24_000
SPANS_A_LINE = 2
LETTERS = 63
"""Letters told apart in bounds; rarer ones count as one, which only raises a bound."""
CLASSES = 4
PAIRS = 512
"""Pairs of neighbouring letters told apart; rarer ones count as one, which only raises a bound."""
LEVELS = 8
PAIR_BITS = 768
MASK = np.uint64((1 << 63) - 1)


def _masks(codes: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """For each 63 characters of a text the places of each letter as bits; and the bits that are in use. Letter 0 is none."""
    size = max(1, -(-len(codes) // 63))
    masks = np.zeros((size, letters), np.uint64)
    for i, c in enumerate(codes.tolist()):
        masks[i // 63, c] |= np.uint64(1 << (i % 63))
    masks[:, 0] = 0
    return masks, np.array([(1 << min(63, len(codes) - 63 * k)) - 1 for k in range(size)], np.uint64)


def _subsequences(masks: np.ndarray, used: np.ndarray, flat: np.ndarray, start: np.ndarray, sizes: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """Length of the longest common subsequence of the text of ``masks`` with each flat[start : start + size].

    Bit-parallel over the characters of the one, for ``chunk`` of the others at once; their characters are steps.
    """
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    for first in range(0, len(order), chunk):
        rows = order[first : first + chunk]
        n, size = len(rows), len(masks)
        at, long = start[rows].copy(), sizes[rows]
        state = np.full((size, n), MASK, np.uint64)
        total, carry = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for live in np.searchsorted(-long, -np.arange(long[0] if n else 0), "left").tolist():  # those longer than the step
            c = flat[at[:live]]
            at[:live] += 1
            for k in range(size):
                v, s = state[k, :live], total[:live]
                u = masks[k][c]
                u &= v
                np.add(u, v, out=s)
                if k:
                    s += carry[:live]
                if k < size - 1:
                    np.right_shift(s, np.uint64(63), out=carry[:live])
                v ^= u
                v |= s
                v &= MASK
        out[rows] = np.bitwise_count(~state & used[:, None]).sum(axis=0)
    return out


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and the length of each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.array([len(x) for x in texts], np.int64)


def common_letters(q: str, spans: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``q`` with each span: no sequence match has more characters."""
    own, inverse = np.unique(_flat([q])[0], return_inverse=True)
    points, sizes = _flat(spans)
    at = np.searchsorted(own, points).clip(max=len(own) - 1)
    return _subsequences(*_masks(inverse + 1, len(own) + 1), np.where(own[at] == points, at + 1, 0), np.cumsum(sizes) - sizes, sizes)


class Spans:
    """Normal forms of spans of one call, by length, with what bounds their similarity to any of ``quotes``.

    ``first``: of equally similar spans the one with the least is taken.
    """

    def __init__(self, norms: list[str], first: list, quotes: list[str]):
        order = sorted(range(len(norms)), key=lambda i: len(norms[i]))
        self.order, self.norms, self.first = order, [norms[i] for i in order], [first[i] for i in order]
        n = len(order)
        # words: the spans that have each word of a quote
        split = [x.split() for x in self.norms]
        self.words = np.fromiter(map(len, split), np.int64, n)
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for q in quotes for w in q.split()))}
        ids = np.fromiter(map(self.number.get, chain.from_iterable(split), repeat(-1)), np.int64, int(self.words.sum()))
        pairs = np.unique((ids * n + np.repeat(np.arange(n), self.words))[ids >= 0])
        self.ends = np.searchsorted(pairs, np.arange(len(self.number) + 1) * n)
        self.having = pairs % max(n, 1)
        points, self.sizes = _flat(self.norms)
        self._points, self._quotes, self.table = points, quotes, None

    def _letters(self) -> None:
        """Letters of the quotes, in classes of like weight; others match nothing."""
        points, quotes, n = self._points, self._quotes, len(self.norms)
        own, count = np.unique(_flat(quotes)[0], return_counts=True)
        own = own[np.argsort(-count, kind="stable")]
        self.table = np.zeros(0x110000, np.uint8)
        self.table[own] = np.minimum(np.arange(len(own)) + 1, LETTERS)
        codes = self.table[points]
        weight, self.letters = np.zeros(CLASSES), min(len(own), LETTERS) + 1
        totals = np.bincount(codes, minlength=self.letters)
        self.of_class = np.zeros(self.letters, np.int64)
        for c in range(1, self.letters):
            self.of_class[c] = k = int(weight.argmin())
            weight[k] += totals[c]
        owner = np.repeat(np.arange(n), self.sizes)
        self.counts = np.bincount(codes.astype(np.int64) * n + owner, minlength=self.letters * n).reshape(self.letters, n).astype(np.uint16 if self.sizes.max(initial=0) < 65_000 else np.int64)
        self.all = (codes, np.cumsum(self.sizes) - self.sizes, self.sizes)
        self._bits_of_pairs(codes, owner)
        # in spans of 200 characters and more a block of a match has one of these letters (difflib's autojunk), but for one at the start of both texts
        self.seeds = np.where(self.counts <= self.sizes // 100 + 1, self.counts, 0)
        self.seeds[LETTERS:] = self.counts[LETTERS:]
        self.seeds[0] = 0
        self.most_blocks = np.where(self.sizes < 200, 1 << 30, self.seeds.sum(axis=0, dtype=np.int64) + 1).astype(np.float32)
        self.long = self.sizes.astype(np.float32)
        self._codes, self._owner, self._parts = codes, owner, None

    def _bits_of_pairs(self, codes: np.ndarray, owner: np.ndarray) -> None:
        """Bits for the first, second, ... of a pair of neighbouring letters in a text, of those that most texts have."""
        n = len(self.sizes)
        step = codes[:-1].astype(np.int64) * (LETTERS + 1) + codes[1:]
        step[(owner[1:] != owner[:-1]) | (codes[:-1] == 0) | (codes[1:] == 0)] = 0  # in no quote
        often = np.argsort(-np.bincount(step, minlength=(LETTERS + 1) ** 2)[1:], kind="stable") + 1
        self.pair = np.zeros((LETTERS + 1) ** 2, np.int64)
        self.pair[often] = np.minimum(np.arange(len(often)), PAIRS - 2) + 1
        many = np.zeros((n, PAIRS), self.counts.dtype)
        for first in range(0, n, 4096):
            lo, hi = np.searchsorted(owner, [first, first + 4096])
            size, inner = min(4096, n - first), slice(lo, max(lo, min(hi, len(step))))
            count = np.bincount((owner[inner] - first) * PAIRS + self.pair[step[inner]], minlength=size * PAIRS)
            many[first : first + size] = count.reshape(size, PAIRS)
        in_quotes = many[:, 1:].sum(axis=1, dtype=np.int64)
        with_level = np.array([(many >= level).sum(axis=0) for level in range(1, LEVELS + 1)])
        with_level[:, 0] = -1
        chosen = np.argsort(-with_level, axis=None, kind="stable")[:PAIR_BITS]
        self.bit_level, self.bit_pair = chosen // PAIRS + 1, chosen % PAIRS
        self.pairs = np.ascontiguousarray(self._pair_bits(many).T)
        self.without_bit = (in_quotes - np.bitwise_count(self.pairs).sum(axis=0, dtype=np.int64)).astype(np.float32)

    def _pair_bits(self, many: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.packbits(many[:, self.bit_pair] >= self.bit_level, axis=1)).view(np.uint64)

    def by_pairs(self, q: str, t: float, lo: int, hi: int) -> np.ndarray:
        """Of the spans from ``lo`` to ``hi`` those whose pairs of neighbouring letters allow a ratio of ``t``.

        A match of m characters in k blocks has m - k pairs, and k - 1 characters at least of either text are not in it,
        so with c pairs in common m <= c + k and k <= a + b - 2 m + 1, or 3 m <= c + a + b + 1.
        """
        own = self.table[_flat([q])[0]].astype(np.int64)
        step = np.where((own[:-1] > 0) & (own[1:] > 0), own[:-1] * (LETTERS + 1) + own[1:], 0)
        mine = self._pair_bits(np.bincount(self.pair[step], minlength=PAIRS)[None, :])[0]
        common = np.zeros(hi - lo, np.uint16)
        for theirs, bits in zip(self.pairs, mine):
            if bits:
                common += np.bitwise_count(theirs[lo:hi] & bits)
        c = np.minimum(self.without_bit[lo:hi], np.float32(max(len(q) - 1, 0) - int(np.bitwise_count(mine).sum())))
        c += common
        both = self.long[lo:hi] + np.float32(len(q))
        least = np.float32(t / 2) * both - np.float32(0.01)
        rows = np.flatnonzero(np.minimum(c + self.most_blocks[lo:hi], (c + both + np.float32(1)) / np.float32(3)) >= least)
        # of the letters that begin blocks those that the quote has
        some = rows[int(np.searchsorted(rows, np.searchsorted(self.sizes, 200) - lo)) :]
        if len(some):
            count = np.bincount(own, minlength=self.letters)
            blocks = np.ones(len(some), np.int64)
            for x in np.flatnonzero(count).tolist():
                blocks += np.minimum(self.seeds[x, lo + some], count[x])
            rows = np.concatenate([rows[: len(rows) - len(some)], some[c[some] + blocks >= least[some]]])
        return lo + rows

    def parts(self) -> list:
        """The texts with the letters of each class only: no more letters are in common than the classes have each for itself.

        Of spans of fewer than 200 characters also as a table, a row for each place, so that a step takes a row as it is.
        """
        if self._parts is None:
            self._parts = []
            short = int(np.searchsorted(self.sizes, 200))
            for k in range(CLASSES):
                own = (self.of_class[self._codes] == k) & (self._codes > 0)
                sizes = np.bincount(self._owner[own], minlength=len(self.sizes))
                flat, start = self._codes[own], np.cumsum(sizes) - sizes
                table = np.zeros((int(sizes[:short].max(initial=0)), short), np.intp)
                owner, end = np.repeat(np.arange(short), sizes[:short]), int(sizes[:short].sum())
                table[np.arange(end) - start[owner], owner] = flat[:end]
                self._parts.append((flat, start, sizes, table))
        return self._parts

    def in_class(self, k: int, mine: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of ``mine`` with each of ``rows``, of the letters of class ``k``."""
        flat, start, sizes, table = self.parts()[k]
        out, short = np.empty(len(rows), np.int64), int(np.searchsorted(rows, table.shape[1]))
        if short < 200 or short * 2 < rows[short - 1] - rows[0] + 1 or len(mine) > 64:
            short = 0
        rest = rows[short:]
        out[short:] = _subsequences(*_masks(mine, self.letters), flat, start[rest], sizes[rest])
        if short:
            masks = np.zeros(self.letters, np.uint64)
            for i, c in enumerate(mine.tolist()):
                masks[c] |= np.uint64(1 << i)
            first, end = int(rows[0]), int(rows[short - 1]) + 1
            common = np.empty(end - first, np.int64)
            for lo in range(first, end, 4096):
                hi = min(end, lo + 4096)
                v, u, s = np.full(hi - lo, ~np.uint64(0)), np.empty(hi - lo, np.uint64), np.empty(hi - lo, np.uint64)
                for c in table[: sizes[lo:hi].max(), lo:hi]:
                    np.take(masks, c, out=u, mode="clip")
                    np.bitwise_and(u, v, out=u)
                    np.add(u, v, out=s)
                    np.bitwise_xor(v, u, out=v)
                    np.bitwise_or(v, s, out=v)
                common[lo - first : hi - first] = np.bitwise_count(~v & np.uint64((1 << len(mine)) - 1))
            out[:short] = common[rows[:short] - first]
        return out

    def having_word(self, w: str) -> np.ndarray:
        i = self.number[w]
        return self.having[self.ends[i] : self.ends[i + 1]]

    def guess(self, q: str) -> int:
        """A span that has many of the rarest words of ``q``, or -1: a start, which no result depends on."""
        found, total = [], 0
        for x in sorted((self.having_word(w) for w in set(q.split())), key=len):
            if len(x):
                total += len(x)
                if found and total > 5_000:
                    break
                found.append(x)
        if not found:
            return -1
        rows, count = np.unique(np.concatenate(found), return_counts=True)
        return int(rows[(count / (self.words[rows] + len(q.split()))).argmax()])

    def by_words(self, q: str, t: float) -> dict[int, float]:
        """Spans whose words allow a ratio of ``t``, with the largest ratio these allow."""
        own = Counter(q.split())
        a = own.total()
        # 2 m / (a + b) >= t and m <= b give m >= t a / (2 - t); of the commonest words as many as three quarters of that are not looked up
        needed = math.ceil(a * t / (2 - t) - 1e-9)
        by_df = sorted(own, key=lambda w: -len(self.having_word(w)))
        left_out = 0
        while by_df and left_out + own[by_df[0]] <= needed * 3 // 4:
            left_out += own[by_df.pop(0)]
        seen = [self.having_word(w) for w in by_df]
        if not seen:
            return {}
        many = np.bincount(np.concatenate(seen), np.repeat([own[w] for w in by_df], [len(x) for x in seen]), len(self.norms)) + left_out
        out = {}
        for i in np.flatnonzero((2 * np.minimum(many, self.words) >= t * (a + self.words) - 1e-9) & (self.words > 0)).tolist():
            bound = 2.0 * (own & Counter(self.norms[i].split())).total() / (a + int(self.words[i]))
            if bound >= t:
                out[i] = bound
        return out

    def by_letters(self, q: str, t: float) -> dict[int, float]:
        """Spans whose letters in their order allow a ratio of ``t``, with the largest ratio these allow.

        Bounds from the cheapest to the strongest: lengths, pairs of neighbours, letters, letters in order within a class, letters in order.
        """
        if self.table is None:
            self._letters()
        a = len(q)
        lo, hi = np.searchsorted(self.sizes, [math.floor(a * t / (2 - t) - 1e-6), math.ceil(a * (2 - t) / t + 1e-6) + 1])
        rows = self.by_pairs(q, t, lo, hi)
        if not len(rows):
            return {}
        own = self.table[_flat([q])[0]].astype(np.int64)
        if len(rows) > 40:
            count = np.bincount(own, minlength=self.letters)
            shared = np.zeros((CLASSES, len(rows)), np.int32)
            for c in np.flatnonzero(count).tolist():
                if c:
                    shared[self.of_class[c]] += np.minimum(self.counts[c, rows], count[c])
            for k in range(-1, CLASSES):
                mine = own[(self.of_class[own] == k) & (own > 0)] if k >= 0 else ()
                if len(mine):
                    shared[k] = self.in_class(k, mine, rows)
                left = 2.0 * shared.sum(axis=0) / (a + self.sizes[rows]) >= t
                rows, shared = rows[left], shared[:, left]
        flat, start, sizes = self.all
        if len(rows) > 200:
            bound = 2.0 * _subsequences(*_masks(own, self.letters), flat, start[rows], sizes[rows]) / (a + sizes[rows])
        else:
            bound = 2.0 * np.array([_common(own.tolist(), flat[start[i] : start[i] + sizes[i]].tolist()) for i in rows]) / (a + sizes[rows])
        return {i: b for i, b in zip(rows.tolist(), bound.tolist()) if b >= t}

    def closest(self, q: str, t: float, exact: dict[int, float]) -> tuple[float, int]:
        """Similarity of ``q`` to the most similar span, and its number; -1 where none has ``t``. ``exact``: similarities known."""
        best, at = 0.0, -1
        bounds = self.by_letters(q, t)
        for i, b in self.by_words(q, t).items():
            bounds[i] = max(b, bounds.get(i, 0.0))
        for i, b in sorted(bounds.items(), key=lambda x: -x[1]):
            if b < best:
                break
            score = exact[i] if i in exact else similarity(q, self.norms[i])
            if score >= t and (score > best or score == best and self.first[i] < self.first[at]):
                best, at = score, i
        return best, at


def _common(a: list, b: list) -> int:
    """Length of the longest common subsequence, letter 0 matching nothing."""
    masks: dict = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    masks.pop(0, None)
    full = v = (1 << len(a)) - 1
    for c in b:
        if m := masks.get(c):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


_SENTENCE = re.compile("(?<=[.!?]) |\x02")


def quotable(body: str, low: str | None, shortest: int) -> list[tuple[str, str]]:
    """The spans of ``_spans`` of a text in single blanks, in the order of their parts, each with its normal form.

    ``low``: the text as ``X.folded`` has it, needed where it is not of ASCII characters only.
    """
    low = body.lower() if low is None else low
    pieces = zip(_SENTENCE.split(body), _SENTENCE.split(low), strict=True)
    kept = [(p, n) for p, n in ((p.strip(" "), n) for p, n in pieces) if shortest <= len(p) < len(body)]
    return [(p, n.strip(" \t\n\"'.,")) for p, n in [(body, low), *kept]]


def snap(quotes: DataFrame, key: str, spans: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(key, span, score, span_line): the most similar of ``spans`` (of ``candidate_spans``) of the same call for each ungrounded quote."""
    return snap_lines(quotes, key, spans.select("source_id", "line_no", F.col("part").cast("int").alias("part"), F.col("span").alias("body"), X.normalise(F.col("span")).alias("norm")), config)


def snap_lines(quotes: DataFrame, key: str, lines: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(key, span, score, span_line): the most similar span of the same call for each ungrounded quote, if similar enough.

    Ties go to the longer span, then to the earlier one. No number of shared words or grams follows from a character
    ratio of 0.66, so each quote meets all spans of its call, in tasks of blocks of spans. Nothing but quotes and lines is
    shuffled, and lines (those without part) are divided into spans where they are compared; within a block bounds by words and letters leave few pairs to compare exactly, and lose nothing. In
    calls of several blocks a first pass finds each quote a similar span, and the second seeks those that are no less similar.
    """
    t = config.snap_similarity
    q = written(quotes.select(key, "source_id", X.normalise(F.col("quote")).alias("q")).where("q <> ''").distinct())
    asked = q.select("source_id").distinct()
    s = lines.where(F.length("body") >= config.shortest_span).join(broadcast_if_small(asked, MOST_CALLS), "source_id", "left_semi")
    low = F.when(F.col("part").isNotNull() | (F.octet_length("body") != F.length("body")), F.col("norm"))
    s = s.select("source_id", "body", low.alias("low"), F.col("line_no").cast("int").alias("line_no"), "part")
    per = s.groupBy("source_id").agg(F.sum(F.when(F.col("part").isNull(), SPANS_A_LINE).otherwise(1)).alias("_n"))
    per = checkpoint(per.select("source_id", "_n", F.ceil(F.col("_n") / SPANS_A_BLOCK).cast("int").alias("_blocks")))
    cells = max(1, -(-(per.agg(F.sum("_n")).first()[0] or 0) // SPANS_A_BLOCK))
    # small calls share tasks; spans of a line stay together
    cell = lambda block: F.when(F.col("_blocks") > 1, F.xxhash64("source_id", block)).otherwise(F.pmod(F.xxhash64("source_id"), F.lit(cells))).alias("cell")
    small = broadcast_if_small(per.select("source_id", "_blocks"), MOST_CALLS)
    line = F.pmod(F.xxhash64("line_no"), F.col("_blocks").cast("bigint")).cast("int")
    blocks = s.join(small, "source_id").select(cell(line), "source_id", "_blocks", "body", "low", "line_no", "part")
    pairs = q.join(small, "source_id").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(cell(F.col("_b")), key, "source_id", "_blocks", "q")
    schema = T.StructType([q.schema[key], *T._parse_datatype_string("score double, n int, line_no int, part int, span string")])

    def meet(left: pd.DataFrame, right: pd.DataFrame, guessing: bool):
        at_call = right.groupby("source_id", sort=False).indices
        for call, own in left.groupby("source_id", sort=False):
            near = right.iloc[at_call.get(call, [])]
            found = []
            for body, low, line, part in zip(near["body"], near["low"], near["line_no"], near["part"]):
                line = math.inf if pd.isna(line) else int(line)
                texts = [(body, low)] if not pd.isna(part) else quotable(body, low, config.shortest_span)
                found += ((-len(span), line, i if pd.isna(part) else int(part), span, norm) for i, (span, norm) in enumerate(texts))
            found.sort()
            near = {}
            for x in found:
                near.setdefault(x[4], x)
            if not near:
                continue
            near = list(near.values())
            block = Spans([x[4] for x in near], list(range(len(near))), own["q"].tolist())
            for text, rows in own.groupby("q", sort=False):
                least = max(t, float(rows["least"].iloc[0]))
                i = block.guess(text) if guessing or rows["_blocks"].iloc[0] == 1 else -1
                exact = {i: similarity(text, block.norms[i])} if i >= 0 else {}
                best, at = (exact.get(i, 0.0), i) if guessing else block.closest(text, max(least, exact.get(i, 0.0)), exact)
                if at >= 0:
                    n, line, part, span, _ = near[block.order[at]]
                    yield from ((k, best, -n, None if line == math.inf else line, part, span) for k in rows[key])

    def run(guessing: bool):
        return lambda left, right: pd.DataFrame(list(meet(left, right, guessing)), columns=schema.names)

    least = None
    if not per.where("_blocks > 1").isEmpty():
        first = pairs.where("_blocks > 1").withColumn("least", F.lit(0.0)).groupBy("cell").cogroup(blocks.where("_blocks > 1").groupBy("cell")).applyInPandas(run(True), schema)
        least = checkpoint(first.groupBy(key).agg(F.max("score").alias("least")))
    pairs = pairs.withColumn("least", F.lit(0.0)) if least is None else pairs.join(least.hint("merge"), key, "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    scored = pairs.groupBy("cell").cogroup(blocks.groupBy("cell")).applyInPandas(run(False), schema)
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("n")).alias("n"), "line_no", "part", "span")).alias("b"))
    return best.select(key, F.col("b.span").alias("span"), (-F.col("b.s")).alias("score"), F.col("b.line_no").alias("span_line"))


def snap_quotes(statements: DataFrame, turns: DataFrame, key: str, config: Config = CONFIG) -> DataFrame:
    """Statements with quote, quote_as_extracted, verified and match_score set: verbatim, snapped, or unverified."""
    lines = _blocks_of_lines(turns, "body")
    statements = statements.drop("verified", "match_score", "quote_as_extracted")
    g = _with_place(statements, checkpoint(verbatim_lines(statements, key, "quote", _ranked(lines))), key)
    near = snap_lines(g.where(~F.col("is_verbatim")), key, lines.select("source_id", "line_no", F.lit(None).cast("int").alias("part"), "body", "norm"), config)
    out = g.join(near.hint("merge"), key, "left")
    return out.select(
        *[c for c in g.columns if c not in ("quote", "is_verbatim", "quote_line")], F.coalesce("quote_line", "span_line").alias("quote_line"), F.col("quote").alias("quote_as_extracted"), F.when(F.col("is_verbatim"), F.btrim("quote", F.lit(' "'))).otherwise(F.coalesce("span", "quote")).alias("quote"),
        (F.col("is_verbatim") | F.col("span").isNotNull()).alias("verified"), F.when(F.col("is_verbatim"), 1.0).otherwise(F.col("score")).alias("match_score"),
    )


def backfill_ts(statements: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """ts of statements from the first line that holds the quote; a stated ts that no line has is dropped."""
    g = ground(statements, turns, key)
    stamps = turns.where("ts is not null").dropDuplicates(["source_id", "line_no"]).select("source_id", F.col("line_no").alias("quote_line"), F.col("ts").alias("line_ts"))
    return g.join(stamps, ["source_id", "quote_line"], "left").withColumn("ts", F.coalesce("line_ts", F.lit("not available"))).drop("line_ts", "is_verbatim")


def verbatim_clauses(statements: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """Adds known: the normal forms of those clauses of the quote that are verbatim in the call. Only quotes of several clauses are looked at."""
    own = statements.select(key, "source_id", F.explode(X.clauses(F.col("quote"))).alias("c"), F.size(X.clauses(F.col("quote"))).alias("n")).where("n > 1")
    own = own.select(key, "source_id", "c", F.xxhash64("source_id", X.normalise(F.col("c"))).alias("_c"))
    found = verbatim_lines(own.select("_c", "source_id", "c"), "_c", "c", line_norms(turns)).select("_c").distinct()
    known = own.join(found.hint("merge"), "_c", "left_semi").groupBy(key).agg(F.collect_set(X.normalise(F.col("c"))).alias("known"))
    return statements.join(known.hint("merge"), key, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row (smallest ``order``) of each key; by aggregation, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def dedup_quotes(statements: DataFrame, order: str = "seq") -> DataFrame:
    """One row per call and normalised quote, the first by ``order``, facts and questions alike."""
    return first_of_each(statements.withColumn("norm", X.normalise(F.col("quote"))), ["source_id", "norm"], order)


def but_commonest(df: DataFrame, scope: str, key: str, words: str) -> DataFrame:
    """Rows of ``df`` exploded to ``_w``, the hashes of their words but the one most rows of their scope have.

    Two rows that share two words or more share one of these of either row, so a join on them is complete for such
    pairs, and leaves out the hottest key.
    """
    one = df.select(scope, F.explode(words).alias("_w"))
    count = one.groupBy(scope, "_w").agg(F.count("*").alias("_df"))
    each = df.select("*", F.explode(words).alias("_w")).join(count.hint("merge"), [scope, "_w"])
    top = each.groupBy(key).agg(F.max(F.struct("_df", "_w")).getField("_w").alias("_top"))
    return each.join(top.hint("merge"), key).where(F.col("_w") != F.col("_top")).drop("_df", "_top")


def drop_answered(statements: DataFrame, key: str, position: str, config: Config = CONFIG) -> DataFrame:
    """Without questions that a later fact of the same call answers.

    A fact at a larger ``position`` answers a question of two or more content words if they share two words, or
    one within ``answer_reach_chars``. The first are met through all words of the question but its commonest one, the
    second on a word and a stretch of that many characters, so a word that very many have forms no large group.
    """
    from factloom import lexicon as L

    stop = sorted(L.QUESTION_WORDS)
    reach = config.answer_reach_chars
    w = F.filter(X.content_words(F.concat_ws(" ", "summary", "quote")), lambda x: ~x.isin(*stop))
    w = checkpoint(statements.where(F.col(position).isNotNull()).select(F.col(key).alias("k"), "source_id", "kind", F.col(position).cast("long").alias("p"), F.transform(w, lambda x: F.xxhash64(x)).alias("ws")))
    q = w.where((F.col("kind") == "question") & (F.size("ws") >= 2)).select("source_id", F.col("k").alias("qk"), F.col("p").alias("qp"), F.col("ws").alias("qw"))
    f = w.where(F.col("kind") != "question").select("source_id", F.col("p").alias("fp"), F.col("ws").alias("fw"))
    facts = f.select("source_id", "fp", "fw", F.explode("fw").alias("_w"))
    two = but_commonest(q, "source_id", "qk", "qw").join(facts.hint("merge"), ["source_id", "_w"]).where((F.col("fp") > F.col("qp")) & (F.size(F.array_intersect("qw", "fw")) >= 2)).select("qk")
    part = lambda c: F.floor(F.col(c) / reach)
    near = q.select("source_id", "qk", "qp", F.explode("qw").alias("_w")).withColumn("_part", F.explode(F.array(part("qp"), part("qp") + 1)))
    close = near.join(facts.withColumn("_part", part("fp")).hint("merge"), ["source_id", "_w", "_part"]).where((F.col("fp") > F.col("qp")) & (F.col("fp") - F.col("qp") < reach)).select("qk")
    answered = two.union(close).distinct().withColumnRenamed("qk", key)
    return statements.join(answered.hint("merge"), key, "left_anti")
