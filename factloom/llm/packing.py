"""Problem 8: documents into containers of a fixed number of tokens.

Only the histogram of token counts, at most one row per possible count, comes to the driver. There, length
patterns that fill a container exactly are enumerated from the histogram, their repeat counts are fitted to
it by non-negative least squares and rounded down, and what is left is packed by patterns too: best fit
decreasing over the histogram, each resulting pattern repeated as often as its lengths last. So every
length has a plan for all its documents, whatever their number; the number of patterns doesn't grow with it.

Documents then find their place by arithmetic: each is numbered within its length (two-level, salted, so a
length that very many share is not numbered in one task) and looks its container up in the plan.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.runtime import checkpoint

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of this public vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS_PER_SALT = 200_000


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def pieces_of(enc, text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(tokens, start, end) of a text, 1-based inclusive positions; several pieces only if it exceeds the capacity."""
    tokens = enc.encode_ordinary(text)
    if len(tokens) <= capacity:
        return [(len(tokens), 1, len(text))] if tokens else []
    raw = enc.decode_bytes(tokens)
    ends = np.cumsum([len(b) for b in enc.decode_tokens_bytes(tokens)])
    starts_char = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
    chars = np.concatenate([[0], np.cumsum(starts_char)])
    whole = np.append(starts_char, True)[ends]  # the cut after this token falls between characters
    out, at, pos = [], 0, 0
    while at < len(tokens):
        stop = min(at + capacity, len(tokens))
        while stop < len(tokens) and stop > at + 1 and not whole[stop - 1]:
            stop -= 1
        end = int(chars[ends[stop - 1]])
        out.append((stop - at, pos + 1, end))
        at, pos = stop, end
    return out


def measure(docs: DataFrame, doc_id: str, text: str, capacity: int, path: str) -> DataFrame:
    """doc_id, piece_no, n_tokens, start_pos, end_pos; texts without tokens (null, empty) give no row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)] + [T.StructField(c, T.IntegerType()) for c in ("piece_no", "n_tokens", "start_pos", "end_pos")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for batch in batches:
            rows = [(i, n + 1, *p) for i, t in zip(batch["doc_id"], batch["text"]) for n, p in enumerate(pieces_of(enc, t, capacity))]
            yield pd.DataFrame(rows, columns=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0).mapInPandas(run, schema)


def nnls(a: np.ndarray, b: np.ndarray, sweeps: int = 150) -> np.ndarray:
    """min ||a x - b|| over x >= 0, by cyclic coordinate descent on the normal equations."""
    gram, target = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    grad = -target
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(x)):
            new = max(0.0, x[j] - grad[j] / gram[j, j])
            if new != x[j]:
                step = new - x[j]
                grad = grad + gram[:, j] * step
                x[j] = new
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return x


def exact_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, each: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Patterns (multiplicities per length) that fill a container: ``each`` per length, drawn along the histogram, ended exactly.

    A pattern takes as few documents as the lengths drawn allow, and at most 400; shorter texts are left to other
    patterns and to the residual."""
    where = {int(v): i for i, v in enumerate(lengths)}
    share = counts / counts.sum()
    drawn = rng.choice(len(lengths), size=(len(lengths) * each, 400), p=share)
    found, seen = [], set()
    shortest = int(lengths[0])
    for k in range(len(lengths) * each):
        pattern, left = {k % len(lengths): 1}, capacity - int(lengths[k % len(lengths)])
        for i in drawn[k]:
            if left < shortest or left in where:
                break
            # two last documents that fill the rest to the token, if such a pair exists
            if left <= 2 * int(lengths[-1]):
                pair = next((j for j in drawn[k][-40:] if left - int(lengths[j]) in where), None)
                if pair is not None:
                    pattern[int(pair)] = pattern.get(int(pair), 0) + 1
                    left -= int(lengths[pair])
                    break
            if int(lengths[i]) <= left:
                pattern[int(i)] = pattern.get(int(i), 0) + 1
                left -= int(lengths[i])
        if left in where:
            pattern[where[left]] = pattern.get(where[left], 0) + 1
            left = 0
        if left == 0 and (key := tuple(sorted(pattern.items()))) not in seen:
            seen.add(key)
            v = np.zeros(len(lengths))
            for i, n in pattern.items():
                v[i] = n
            found.append(v)
    return found


def plan(histogram: dict[int, int], capacity: int, most_patterns: int = 1500, fit: bool = True, seed: int = 5) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: number}) of patterns that hold the histogram exactly.

    Every length takes part in every round; rounds go on as long as the fit places a fiftieth of the documents left. ``most_patterns`` bounds
    the least-squares problem (each length starts one pattern at least), not the documents. ``fit=False`` packs all
    as residuals, for comparison.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[int, dict[int, int]]] = []
    if capacity in left:
        out.append((left.pop(capacity), {capacity: 1}))
    rng = np.random.default_rng(seed)
    going = fit
    while going and len(left) > 1:
        placed, waiting = 0, sum(left.values())
        lengths = np.array(sorted(left))
        counts = np.array([left[n] for n in lengths.tolist()], float)
        patterns = exact_patterns(lengths, counts, capacity, max(1, most_patterns // len(lengths)), rng)
        if not patterns:
            break
        a = np.stack(patterns, axis=1)
        repeats = np.floor(nnls(a, counts) + 1e-6).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            use = {int(lengths[i]): int(a[i, j]) for i in np.flatnonzero(a[:, j])}
            n = min([int(repeats[j])] + [left.get(v, 0) // k for v, k in use.items()])
            if n > 0:
                out.append((n, use))
                placed += n * sum(use.values())
                for v, k in use.items():
                    left[v] -= n * k
        left = {n: c for n, c in left.items() if c > 0}
        going = placed * 50 >= waiting
    # residual: best fit decreasing over the histogram, whole patterns at a time
    while left:
        room, use = capacity, {}
        for v in sorted(left, reverse=True):
            n = min(left[v], room // v)
            if n:
                use[v] = n
                room -= n * v
            if not room:
                break
        n = min(left[v] // k for v, k in use.items())
        out.append((n, use))
        for v, k in use.items():
            left[v] -= n * k
            if not left[v]:
                del left[v]
    return out


def pack(docs: DataFrame, doc_id: str, text: str, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """container_id, doc_id, piece_no, n_tokens, start_pos, end_pos: every text of at least one token in a container.

    No container holds more than ``capacity`` tokens. A text is split only if it exceeds the capacity, and then
    into full containers and a rest. doc_id must be unique; equal texts are placed one by one; null and empty
    texts are left out. The placing is the same however often a task is repeated.
    """
    sized = checkpoint(measure(docs, doc_id, text, capacity, tokenizer))
    histogram = {r[0]: r[1] for r in sized.groupBy("n_tokens").count().collect()}  # at most ``capacity`` rows
    base, starts = 0, []
    used: dict[int, int] = {}
    for repeats, use in plan(histogram, capacity):
        for length, n in use.items():
            starts.append((length, used.get(length, 0), base, n))
            used[length] = used.get(length, 0) + n * repeats
        base += repeats
    starts.sort()
    table = np.array(starts, np.int64).reshape(-1, 4)
    keys = (table[:, 0] << 44) + table[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((keys, table))

    @F.pandas_udf(T.LongType())
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        k, t = shared.value
        at = np.searchsorted(k, (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64), "right") - 1
        return pd.Series(t[at, 2] + (rank.to_numpy(np.int64) - t[at, 1]) // t[at, 3])

    salts = max(1, sum(histogram.values()) // ROWS_PER_SALT)
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)))
    before = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = before.select("n_tokens", "salt", (F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece_no")) - 1
    ranked = salted.withColumn("own", own).join(before, ["n_tokens", "salt"])
    return ranked.select(container("n_tokens", F.col("before") + F.col("own")).alias("container_id"), "doc_id", "piece_no", "n_tokens", "start_pos", "end_pos")
