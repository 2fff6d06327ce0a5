"""Repeated passages of words by prefix-partitioned suffix trees.

Suffixes of all texts are parted by a prefix of variable length into groups that fit a task's memory (see `repeats`), and each
group's suffix tree is built apart. A tree is held as its leaves in order, with the length of the common prefix of each two
neighbours: an internal node is a run of leaves whose common prefixes reach its depth. The order comes from ranks of ever longer
prefixes, doubled; the same ranks, taken from the longest down, give the common prefixes.

The topmost nodes at window depth or deeper stand for the repeats: such a node's depth is the length of a repeat that can't be
longer to the right, and the windows at its leaves are equal. With leaves in several documents every one but those of the
least doc_id goes.

Cases: null or empty text has no words; rows without doc_id keep all words; each of the rows that repeat doc_id and text gets
the same result; texts that share a doc_id keep what they have in common, none being before the other; an empty table gives an empty result; texts are read whole; clashing columns are dropped before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, distinct, ragged, words
from .repeats import INTERVAL, Windows, by_prefix, changed, copies, covered_mask, distinct_regions, grouped, intervals, keyed, node_intervals, sharing, whole_windows

WINDOW_WORDS = 50
GRAM_WORDS = 20
#: Bytes of units that a task builds trees over at a time.
GROUP_BYTES = 12_000_000
RESULT = "n_removed long, kept_sha256 string"


@dataclass
class SuffixTree:
    """Suffixes of a text in order, with the lengths of the common prefixes of neighbours (the first has 0)."""

    order: np.ndarray
    common: np.ndarray

    def deep_nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each leaf, in order, the number of the topmost node of at least that depth it belongs to (leaves without one
        have a number of their own), and for each number the node's depth, 0 for a leaf alone."""
        joined = self.common >= depth
        node = np.cumsum(~joined) - 1
        depths = np.full(int(node[-1]) + 1 if len(node) else 0, np.iinfo(np.int64).max)
        np.minimum.at(depths, node[joined], self.common[joined])
        return node, np.where(depths == np.iinfo(np.int64).max, 0, depths)


def suffix_tree(units: np.ndarray, length: np.ndarray, start: np.ndarray) -> SuffixTree:
    """The tree of the suffixes at `start` of a text of regions, `length` units each. A suffix ends with its region, in a
    terminator that no other region has, so no two are equal."""
    end = np.cumsum(length + 1) - 1
    inside = np.ones(int(end[-1]) + 1, bool)
    inside[end] = False
    rank = np.zeros(len(inside), np.int64)
    rank[end] = np.arange(len(end))
    rank[inside] = distinct(units)[2] + len(end)
    ranks, span = [rank.astype(np.int32)], 1
    while span <= int(length.max()):  # ranks of the first 2 * span units from those of the first span
        pair = rank.astype(np.uint64) << np.uint64(32)
        pair[:-span] |= rank[span:].astype(np.uint64)  # the terminators tell the last ones apart
        rank = distinct(pair)[2]
        ranks.append(rank.astype(np.int32))
        span *= 2
    order = np.argsort(rank[start])
    a, b = start[order[:-1]].copy(), start[order[1:]].copy()
    common = np.zeros(len(start), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][a] == ranks[k][b]
        step = same.astype(np.int64) << k
        common[1:] += step
        a, b = a + step, b + step
    return SuffixTree(order, common)


def subtree_intervals(table: pa.Table, size: int) -> pa.RecordBatch:
    """Builds the tree of the windows of some groups; gives the word intervals that lie below a repeat's node."""
    once, run_of = distinct_regions(table)
    doc = table.column("doc").to_numpy()
    least = np.minimum.reduceat(doc, once)
    units = table.column("units").take(pa.array(once)).to_pylist()
    length = np.array([len(u) // 8 for u in units])
    n = table.column("n").to_numpy()[once]
    first = np.cumsum(length + 1) - (length + 1)
    tree = suffix_tree(np.frombuffer(b"".join(units), np.uint64), length, ragged(first, n))
    node, _ = tree.deep_nodes(size)
    below = np.empty(len(node), np.int64)
    below[tree.order] = node
    lowest = np.full(int(node[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, below, np.repeat(least, n))
    return intervals(table, run_of, np.cumsum(n) - n, lambda row, window: lowest[below[window]] < doc[row], size)


def repeated_words(docs: DataFrame, size: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> tuple[DataFrame, DataFrame]:
    """(texts that share an anchor, word intervals [start, stop) that also occur in a document of a smaller doc_id)."""
    windows = Windows(size, gram, 8, True)
    texts = sharing(docs, windows, False)
    groups, large = grouped(texts, windows)
    found = by_prefix(groups, lambda t: subtree_intervals(t, size), INTERVAL, GROUP_BYTES)
    return texts, found.unionByName(node_intervals(whole_windows(large, windows), windows, False))


def sha_of_words(docs: DataFrame) -> DataFrame:
    """doc_id, doc, th, text_key, n_words and the SHA-256 of all words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(4)):
                start, end, first = words(data, offsets)
                size = end - start + 1  # with the space, or end of text, after it
                source = ragged(start, size)
                joined = np.append(data, np.uint8(32))[source]
                joined[np.cumsum(size) - 1] = 32
                bound = np.concatenate([[0], np.cumsum(size)])[first].tolist()
                raw = memoryview(joined.tobytes())
                sha = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(bound[:-1], bound[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(4)), pa.array(np.diff(first)), pa.array(sha)], ["doc_id", "doc", "th", "text_key", "n_words", "sha"])

    return keyed(docs).select("doc_id", "doc", "th", "text_key", "text").mapInArrow(run, "doc_id long, doc long, th long, text_key string, n_words long, sha string")


def kept_words(text: str, spans: np.ndarray) -> tuple[int, str]:
    parts = text.translate(_TO_SPACE).split(" ")
    parts = [p for p in parts if p]
    gone = covered_mask(spans, len(parts))
    return int(gone.sum()), hashlib.sha256(" ".join(p for p, g in zip(parts, gone.tolist(), strict=True) if not g).encode()).hexdigest()


_TO_SPACE = {c: " " for c in (9, 10, 11, 12, 13)}


def dedup_passages(docs: DataFrame, size: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    texts, found = repeated_words(docs, size, gram)
    fewer = changed(texts, found, kept_words, RESULT)
    rows = sha_of_words(docs)
    all_rows = rows.join(copies(keyed(docs), "doc_id"), "text_key").join(fewer, ["doc", "th"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= size)  # each of its windows is in the first copy
    return all_rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
