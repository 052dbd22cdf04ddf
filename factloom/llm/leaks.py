"""Problem 9: evaluation passages inside a training corpus.

Every item is cut into windows of ``window`` words, the shortest passage that counts. Windows of items and
documents are embedded by the CGK random walk (edit distance in words becomes Hamming distance), and
repeated bit sampling of the embeddings gives hash keys: windows within the edit bound share one with the
stated recall, equal windows share all. Samples come from the first 1.5 x window steps, which the walk
spends inside the window: later ones would mostly be padding, alike for all. Candidates must have all but
``max_edits`` words in place within ``max_edits`` positions, and are then verified by exact edit distance.

The items, a query set beside the corpus, go to the executors in blocks of at most ``BLOCK_CHARS`` characters,
whatever their number; for each block the documents are probed where they are read: no shuffle of text or
of windows. A window of a document takes part only if all but ``max_edits`` of its words occur in the block
at all, which loses no case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.lookalike import transducer

# odd multipliers of a mixing hash, as signed 64-bit numbers
_SPREAD = np.int64(-7046029254386353131)
_MIX = np.int64(-4658895280553007687)
_WORD = re.compile(r"[^\W_]+")
BLOCK_CHARS = 1_000_000
"""Characters of items sent to the executors at once: about 50 MB of tables at 200,000 windows."""
CHECKED_AT_ONCE = 100_000
"""Candidates verified at once, to bound a worker's memory."""


def words_of(text: str | None) -> list[str]:
    return [] if text is None else _WORD.findall(transducer().form(text).lower())


class Tables:
    """LSH tables over the windows of the items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, repeats: int, bits: int, seed: int) -> None:
        self.window, self.repeats = window, repeats
        self.vocabulary: dict[str, int] = {}
        ids, rows = [], []
        for item, text in items:
            code = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for i in range(len(code) - window + 1):
                ids.append(item)
                rows.append(code[i : i + window])
        self.items = np.array(ids, np.int64)
        self.rows = np.array(rows, np.int32).reshape(-1, window)
        self.other = len(self.vocabulary)  # any word that no item has
        rng = np.random.default_rng(seed)
        self.steps = window + window // 2
        self.walk = rng.integers(1, 2**63 - 1, (repeats, self.steps), dtype=np.int64) | 1
        self.sample = np.stack([np.sort(rng.choice(self.steps, min(bits, self.steps), replace=False)) for _ in range(repeats)])
        self.salt = rng.integers(1, 2**63 - 1, self.sample.shape, dtype=np.int64) | 1
        self.index = []
        for r in range(repeats):
            keys = self.keys(self.rows, r)
            order = np.argsort(keys, kind="stable").astype(np.int32)
            self.index.append((keys[order], order))

    def keys(self, rows: np.ndarray, r: int) -> np.ndarray:
        """Hash of the sampled symbols of each row's CGK embedding under walk ``r``: at each step the symbol in hand
        is put out, and a random bit of (step, symbol), the top bit of a hash, decides whether to move on."""
        n, w = rows.shape
        padded = np.concatenate([rows, np.full((n, 1), self.other + 1, np.int32)], axis=1).ravel()
        start = np.arange(n, dtype=np.int64) * (w + 1)
        at, key = np.zeros(n, np.int64), np.zeros(n, np.int64)
        k, last = 0, self.sample[r, -1]
        with np.errstate(over="ignore"):
            for j in range(last + 1):
                symbol = padded[start + at].astype(np.int64) + 1
                if self.sample[r, k] == j:
                    key = (key ^ symbol) * self.salt[r, k]
                    key ^= (key >> 29) & 0x7FFFFFFFF
                    k += 1
                at = np.minimum(at + ((((symbol * _SPREAD) ^ self.walk[r, j]) * _MIX) < 0), w)
        return key

    def candidates(self, rows: np.ndarray) -> np.ndarray:
        """(row, item window) pairs that share a key."""
        found = []
        for r, (sorted_keys, order) in enumerate(self.index):
            keys = self.keys(rows, r)
            lo, hi = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
            n = hi - lo
            if not n.sum():
                continue
            line = np.repeat(np.arange(len(rows)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(line * len(self.rows) + order[np.repeat(lo, n) + step])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.column_stack(np.divmod(both, max(1, len(self.rows))))


def edit_distance(a: np.ndarray, b: np.ndarray, slack: int = 0) -> np.ndarray:
    """Exact edit distances of the rows of two arrays, all at once; with ``slack`` the smallest one to the first
    w - slack to w + slack words of the row of ``b``, where w is the number of columns of ``a``."""
    n, w = a.shape
    prev = np.tile(np.arange(b.shape[1] + 1), (n, 1))
    for i in range(1, w + 1):
        row = np.empty_like(prev)
        row[:, 0] = i
        for j in range(1, b.shape[1] + 1):
            row[:, j] = np.minimum(np.minimum(prev[:, j], row[:, j - 1]) + 1, prev[:, j - 1] + (a[:, i - 1] != b[:, j - 1]))
        prev = row
    return prev[:, w - slack :].min(axis=1)


def _in_place(b: np.ndarray, spans: np.ndarray, slack: int) -> np.ndarray:
    """Number of words of each row of ``b`` that the row of ``spans`` has at most ``slack`` places off."""
    w = b.shape[1]
    held = np.zeros(b.shape, bool)
    for shift in range(-slack, slack + 1):
        lo, hi = max(0, -shift), min(w, spans.shape[1] - shift)
        held[:, lo:hi] |= b[:, lo:hi] == spans[:, lo + shift : hi + shift]
    return held.sum(axis=1)


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int = 12, max_edits: int = 1, repeats: int = 16, bits: int = 8, seed: int = 7) -> DataFrame:
    """(doc_id, item_id, edits, n_windows): documents that hold a passage of ``window`` words of an item, up to ``max_edits``.

    edits is the smallest edit distance (in words) of any of its passages to a window of the item, n_windows how many
    places reach it. A passage may be longer or shorter than the window by the words added or dropped. Equal windows
    are always found; ``repeats`` and ``bits`` set the recall of the others (see the tests: at least 0.9 at one edit,
    be it a word replaced, added or dropped). Items shorter than the window and null or empty texts match nothing;
    repeated documents count once per (doc_id, item_id). A single item has to fit into memory.
    """
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and length(t) > 0").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    spread = items.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    hits = None
    for block in range(blocks):
        found = _probe(part, Tables([(r.i, r.t) for r in spread.where(F.col("b") == block).collect()], window, repeats, bits, seed), window, max_edits)
        hits = found if hits is None else hits.union(found)
    best = hits.distinct().groupBy("doc_id", "item_id", "edits").agg(F.count("*").alias("n"))
    return best.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.min_by("n", "edits").alias("n_windows"))


def _probe(part: DataFrame, table: Tables, window: int, max_edits: int) -> DataFrame:
    """doc_id, item_id, edits, at: windows of the documents that are within ``max_edits`` of a window of the table's items."""
    shared = part.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([T.StructField("doc_id", part.schema["doc_id"].dataType), T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("at", T.IntegerType())])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        get = t.vocabulary.get
        longest = window + max_edits
        end = np.full(longest, t.other + 1, np.int32)
        for batch in batches:
            codes = [np.fromiter((get(w, t.other) for w in words_of(x)), np.int32) for x in batch["text"]]
            sizes = np.array([len(c) for c in codes], np.int64)
            if not len(t.rows) or not sizes.sum():
                continue
            # the end of a text is padded, so that a passage shorter than the window can stand there
            sizes += longest
            flat = np.concatenate([x for c in codes for x in (c, end)])
            owner = np.repeat(np.arange(len(codes)), sizes)
            start = np.arange(len(flat) - longest + 1)
            known = np.concatenate([[0], np.cumsum(flat < t.other)])
            good = start[known[start + window] - known[start] >= window - max_edits]
            if not len(good):
                continue
            rows = flat[good[:, None] + np.arange(window)]
            pairs = t.candidates(rows)
            first = np.cumsum(sizes) - sizes
            for k in range(0, len(pairs), CHECKED_AT_ONCE):
                line, item = pairs[k : k + CHECKED_AT_ONCE].T
                spans = flat[good[line][:, None] + np.arange(longest)]
                b = t.rows[item]
                near = _in_place(b, spans, max_edits) >= window - max_edits
                line, item, spans, b = line[near], item[near], spans[near], b[near]
                d = np.where((spans[:, :window] == b).all(axis=1), 0, 1 + max_edits)
                rest = np.flatnonzero(d) if max_edits else []
                if len(rest):
                    d[rest] = edit_distance(b[rest], spans[rest], max_edits)
                keep = d <= max_edits
                line, item, d = line[keep], item[keep], d[keep]
                at = good[line]
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].take(owner[at]).to_numpy(), "item_id": t.items[item], "edits": d.astype(np.int32), "at": (at - first[owner[at]]).astype(np.int32),
                })

    return part.mapInPandas(probe, schema)
