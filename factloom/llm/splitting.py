"""Problem 5: pieces under a size limit, cut at natural boundaries, with overlap.

Every boundary of a text is joined to its farthest legal successor: the last boundary of the best kind
(paragraph, list item, sentence, word, any character) that a piece starting at that boundary's overlap
can still reach. Squaring the successor table log2(n) times then yields all greedy cuts of all texts of
a batch at once: after round k the reached set holds the first 2**k cuts. A text is one row, so no
table has to be shuffled; the tables are NumPy arrays over the boundaries of a whole Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAGRAPH, ITEM, SENTENCE, WORD, CHARACTER = range(5)
_KINDS = (
    (PARAGRAPH, re.compile(r"\n[^\S\n]*\n\s*")),
    (ITEM, re.compile(r"\n\s*(?=(?:[-*•–]|\d{1,3}[.)])\s)|\s+(?=(?:[*•]|\d{1,3}\))\s)|\n")),
    (SENTENCE, re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？]")),
    (WORD, re.compile(r"\s+")),
)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a piece may end (blanks stay with the piece before), ascending, and the best kind of each."""
    kind = np.full(len(text) + 1, CHARACTER, np.int8)
    for level, pattern in reversed(_KINDS):
        kind[[m.end() for m in pattern.finditer(text)]] = level
    kind[0] = kind[-1] = PARAGRAPH
    at = np.flatnonzero(kind < CHARACTER)
    return at, kind[at]


def _with_hard_cuts(at: np.ndarray, kind: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Adds plain character cuts inside stretches without any boundary that are longer than a piece may grow."""
    step = limit - overlap
    gaps = np.flatnonzero(np.diff(at) > step)
    if not len(gaps):
        return at, kind
    extra = np.concatenate([np.arange(at[g] + step, at[g + 1], step) for g in gaps])
    every = np.concatenate([at, extra])
    kinds = np.concatenate([kind, np.full(len(extra), CHARACTER, np.int8)])
    order = np.argsort(every, kind="stable")
    return every[order], kinds[order]


def cut(texts: list[str], limit: int, overlap: int, fill: float) -> list[np.ndarray]:
    """For each text rows (start, end, kind of the end): pieces in order, by pointer doubling over all texts together."""
    ats, kinds, owner, starts, base = [], [], [], [], 0
    offsets = [0]
    for i, text in enumerate(texts):
        at, kind = _with_hard_cuts(*boundaries(text), limit, overlap)
        # A piece after the cut at `at` begins at the first word within the last `overlap` characters.
        begin = at[np.minimum(np.searchsorted(at, at - overlap, "left"), np.arange(len(at)))]
        begin[0] = 0
        ats.append(at + base)
        kinds.append(kind)
        starts.append(begin + base)
        owner.append(np.full(len(at), i))
        base += len(text) + limit + 2  # texts lie so far apart that no piece reaches the next
        offsets.append(offsets[-1] + len(at))
    at, kind, begin, own = map(np.concatenate, (ats, kinds, starts, owner))
    ends = np.array(offsets[1:]) - 1
    here = np.arange(len(at))
    # the farthest boundary of each kind that is legal after each boundary
    reach = np.searchsorted(at, begin + limit, "right") - 1
    least = np.searchsorted(at, begin + np.int64(limit * fill), "left")
    succ = np.full(len(at), -1)
    for level in (CHARACTER, WORD, SENTENCE, ITEM, PARAGRAPH):  # better kinds overwrite
        of_kind = np.flatnonzero(kind <= level)
        k = np.searchsorted(of_kind, reach, "right") - 1
        best = np.where(k >= 0, of_kind[np.maximum(k, 0)], -1)
        good = (best > here) & (own[np.maximum(best, 0)] == own) & ((best >= least) | (level >= WORD))
        succ = np.where(good, best, succ)
    last = ends[own]
    succ = np.where(reach >= last, last, succ)
    succ = np.where(succ <= here, np.minimum(here + 1, last), succ)
    # pointer doubling: reached holds the first 2**k cuts, jump leads 2**k cuts ahead
    reached = np.zeros(len(at), bool)
    first = np.array(offsets[:-1])
    reached[succ[first]] = True
    jump = succ
    while True:
        more = jump[np.flatnonzero(reached)]
        if reached[more].all():
            break
        reached[more] = True
        jump = jump[jump]
    out = []
    for i in range(len(texts)):
        lo, hi = offsets[i], offsets[i + 1]
        cuts = lo + np.flatnonzero(reached[lo:hi])
        origin = at[lo]
        start = np.concatenate([[0], begin[cuts[:-1]] - origin]) if len(cuts) else np.array([0])
        end = at[cuts] - origin if len(cuts) else np.array([len(texts[i])])
        out.append(np.column_stack([start, end, kind[cuts] if len(cuts) else [PARAGRAPH]]))
    return out


def split_texts(df: DataFrame, keys: list[str], text: str, limit: int = 2500, overlap: int = 200, fill: float = 0.5) -> DataFrame:
    """Pieces of at most ``limit`` characters: ``keys``, piece_no, n_pieces, start_pos, end_pos (1-based, inclusive), cut_kind, piece.

    A cut takes the best kind of boundary among those that leave the piece at least ``fill`` full, and the
    last boundary of that kind. Each later piece repeats whole words of up to the last ``overlap``
    characters of the one before. The pieces without their overlaps join to the text again. Null texts give
    no row; a text within the limit, empty ones too, is one piece. Repeated rows are split each.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below the limit")
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("piece_no", T.IntegerType()), T.StructField("n_pieces", T.IntegerType()), T.StructField("start_pos", T.LongType()),
        T.StructField("end_pos", T.LongType()), T.StructField("cut_kind", T.StringType()), T.StructField("piece", T.StringType()),
    ])
    names = ["paragraph", "list item", "sentence", "word", "character"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_text"].tolist()
            if not texts:
                continue
            rows = []
            for i, spans in enumerate(cut(texts, limit, overlap, fill)):
                rows += [(i, n + 1, len(spans), int(s) + 1, int(e), names[k], texts[i][s:e]) for n, (s, e, k) in enumerate(spans)]
            out = pd.DataFrame(rows, columns=["_i", *schema.names[len(keys):]])
            for k in keys:
                out[k] = batch[f"_k_{k}"].take(out["_i"]).to_numpy()
            yield out[schema.names]

    whole = df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    long = whole.where(F.length("_text") > limit).mapInPandas(pieces, schema)
    short = whole.where(F.length("_text") <= limit).select(
        *[F.col(f"_k_{k}").alias(k) for k in keys], F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(1).cast("long").alias("start_pos"),
        F.length("_text").cast("long").alias("end_pos"), F.lit(names[0]).alias("cut_kind"), F.col("_text").alias("piece"),
    )
    return long.unionByName(short)
