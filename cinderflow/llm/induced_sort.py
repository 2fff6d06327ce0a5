"""Repeated byte strings by suffix arrays built through induced sorting.

Text is sorted in shards: groups of regions with a common prefix (see `repeats`), brought together and ordered by Spark's
external sort. What doesn't fit a task's memory waits there, spilled, and a task takes from its front as many whole groups as
SHARD_BYTES allows, so any number of suffixes passes through. In a shard, suffixes are classified; those at local minima (LMS)
are ranked by their substrings and, by doubling over the sequence of ranks, by themselves; from them a scan over the buckets in
ascending order induces the L suffixes and one in descending order the S suffixes. All suffixes of a bucket that are known at a
time move as one tuple array, so the scans take a step for each bucket and run length, not for each suffix. Common-prefix values
of neighbours, counted up to the window size, then tell which windows occur again.

This isn't one induction over all text with queues on disk: a task may keep no files that others need, and a Spark job for each
bucket of each level would cost thousands of jobs. Parting by prefixes and the sort of the shuffle stand in for the queues, and
doubling for the recursion on the reduced string, of which no more than a window's depth is wanted.

Cases: null or empty text has no bytes; rows without doc_id are compared like all others; an empty table
gives an empty result; texts are read whole; clashing columns are dropped before; rows that repeat
doc_id and text are copies, each with a result of its own; of equal strings none is kept, so there are no ties.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ragged
from .repeats import INTERVAL, Windows, by_prefix, changed, copies, covered_mask, distinct_regions, grouped, intervals, keyed, node_intervals, sharing, whole_windows

WINDOW_BYTES = 200
GRAM_BYTES = 64
SHARD_BYTES = 4_000_000
RESULT = "n_removed long, n_spans long, kept_sha256 string"


def suffix_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S: less than the one that starts one place later. The last suffix is L."""
    up = np.zeros(len(text), np.int8)
    up[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    up[-1] = -1
    decides = np.where(up != 0, np.arange(len(text)), len(text))
    return up[np.minimum.accumulate(decides[::-1])[::-1]] > 0


def rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pair = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
    return np.unique(pair, return_inverse=True)[1]


def rank_substrings(text: np.ndarray, is_s: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Order-preserving ranks of text[start:stop], by character and then type, L before S."""
    rank = np.zeros(len(start), np.int64)
    symbol = np.append(2 * text.astype(np.uint64) + is_s + np.uint64(1), np.uint64(0))
    offset = 0
    todo = np.arange(len(start))
    while len(todo):
        key = np.zeros(len(todo), np.uint64)
        for k in range(5):
            at = start[todo] + offset + k
            key = key << np.uint64(12) | symbol[np.where(at < stop[todo], at, len(text))]
        if offset == 0:
            rank[todo] = np.unique(key, return_inverse=True)[1]
        else:  # ties alone are told apart; ranks are spread so that the new ones fit between
            fine = rank_pairs(rank[todo], np.unique(key, return_inverse=True)[1])
            full = np.zeros(len(rank), np.int64)
            full[todo] = fine + 1
            rank = np.unique(rank.astype(np.uint64) << np.uint64(32) | full.astype(np.uint64), return_inverse=True)[1]
        offset += 5
        tied = np.bincount(rank)[rank] > 1
        todo = np.flatnonzero(tied & (start + offset < stop))
    return rank


def sorted_lms(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """The LMS suffixes in order, by at least `depth` characters: ranks of their substrings, doubled along the sequence."""
    stop = np.append(lms[1:] + 1, len(text))
    rank = rank_substrings(text, is_s, lms, np.minimum(stop, len(text)))
    span = 1
    while span < depth // 2 + 1 and span < len(rank) and rank.max() < len(rank) - 1:  # a substring takes two places at least
        after = np.zeros(len(rank), np.int64)
        after[:-span] = rank[span:] + 1
        rank = rank_pairs(rank, after)
        span *= 2
    return lms[np.argsort(rank, kind="stable")]


def induced_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of `text` (values under 1022), exact for the first `depth` characters of each suffix."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    is_s = suffix_types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    top = int(text.max()) + 1
    seeds = sorted_lms(text, is_s, lms, depth) if len(lms) else lms
    by_char = np.split(seeds[np.argsort(text[seeds], kind="stable")], np.cumsum(np.bincount(text[seeds], minlength=top))[:-1])
    l_parts: list[list[np.ndarray]] = [[] for _ in range(top)]
    s_parts: list[list[np.ndarray]] = [[] for _ in range(top)]
    last = np.array([n - 1])
    l_parts[int(text[n - 1])].append(last)

    def send(source: np.ndarray, parts: list[list[np.ndarray]], wanted: np.ndarray) -> None:
        """The suffixes one place before `source`, of the wanted type, go to the ends of their buckets in order."""
        before = source[source > 0] - 1
        before = before[wanted[before]]
        if not len(before):
            return
        char = text[before]
        order = np.argsort(char, kind="stable")
        before, char = before[order], char[order]
        edge = np.flatnonzero(np.append(True, char[1:] != char[:-1]))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(before)], strict=True):
            parts[int(char[a])].append(before[a:b])

    is_l = ~is_s
    for c in range(top):
        done = 0
        while done < len(l_parts[c]):  # what a bucket sends to itself comes in a later turn
            wave, done = l_parts[c][done:], len(l_parts[c])
            send(np.concatenate(wave), l_parts, is_l)
        if len(by_char[c]):
            send(by_char[c], l_parts, is_l)
    whole_l = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in l_parts]
    for c in range(top - 1, -1, -1):
        done = 0
        while done < len(s_parts[c]):
            wave, done = s_parts[c][done:], len(s_parts[c])
            send(np.concatenate(wave), s_parts, is_s)
        if len(whole_l[c]):
            send(whole_l[c][::-1], s_parts, is_s)
    out = []
    for c in range(top):
        out.append(whole_l[c])
        if s_parts[c]:
            out.append(np.concatenate(s_parts[c])[::-1])
    return np.concatenate(out)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes a[i] and b[i], counted in eights up to `most`."""
    eight = np.zeros(len(text) + most + 8, np.uint64)
    for k in range(8):
        eight[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(8 * k)
    length = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    for k in range(0, most, 8):
        todo = todo[eight[a[todo] + k] == eight[b[todo] + k]]
        length[todo] = k + 8
    return length


def shard_intervals(table: pa.Table, size: int) -> pa.RecordBatch:
    """Sorts the suffixes of the distinct regions of some anchors; gives the byte intervals that occur again."""
    once, run_of = distinct_regions(table)
    times = np.bincount(run_of)
    units = table.column("units").take(pa.array(once)).to_pylist()
    n = table.column("n").to_numpy()[once]
    length = np.array([len(u) for u in units]) + 1
    first = np.cumsum(length) - length
    raw = np.frombuffer(b"\0".join(units) + b"\0", np.uint8)
    text = raw.astype(np.uint16) + 1
    text[first + length - 1] = 0  # regions end in a value that no byte has
    window_first = np.cumsum(n) - n
    number = np.full(len(text), -1)
    number[ragged(first, n)] = np.arange(int(n.sum()))
    again = np.repeat(times > 1, n)
    order = induced_order(text, size)
    order = order[number[order] >= 0]  # starts of windows
    same = common_prefix(raw, order[1:], order[:-1], size) >= size
    again[number[order[1:][same]]] = True
    again[number[order[:-1][same]]] = True
    return intervals(table, run_of, window_first, lambda row, window: again[window], size)


def repeated_bytes(docs: DataFrame, size: int = WINDOW_BYTES, gram: int = GRAM_BYTES) -> tuple[DataFrame, DataFrame]:
    """(texts that share an anchor, byte intervals [start, stop) of strings that also start elsewhere)."""
    windows = Windows(size, gram, 1, False, 8)
    texts = sharing(docs, windows, True)
    groups, large = grouped(texts, windows)
    found = by_prefix(groups, lambda t: shard_intervals(t, size), INTERVAL, SHARD_BYTES)
    return texts, found.unionByName(node_intervals(whole_windows(large, windows), windows, True))


def kept_bytes(text: str, spans: np.ndarray) -> tuple[int, int, str]:
    raw = np.frombuffer(text.encode(), np.uint8)
    gone = covered_mask(spans, len(raw))
    starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), starts, hashlib.sha256(raw[~gone].tobytes()).hexdigest()


def dedup_bytes(docs: DataFrame, size: int = WINDOW_BYTES, gram: int = GRAM_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts, found = repeated_bytes(docs, size, gram)
    fewer = changed(texts, found, kept_bytes, RESULT)
    rows = keyed(docs).select("doc_id", "doc", "th", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    all_rows = rows.join(copies(keyed(docs)), "text_key").join(fewer, ["doc", "th"], "left")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= size)
    zero = F.lit(0).cast("long")
    return all_rows.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copied, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
