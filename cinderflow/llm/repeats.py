"""Groups of suffixes that may hold repeats: what the suffix-tree and the suffix-sorting operators share.

A window is `size` consecutive units (hashed words, or bytes) of one document. Its anchor is the least hash among its
grams of `gram` units; equal windows have equal anchors. So a window can occur twice only if its anchor does, and all
occurrences of a window meet where the rows of one anchor meet:

1. every document gives its distinct anchors, about two in a hundred units; anchors seen once drop out by counting;
2. documents with shared anchors give regions: runs of windows of one anchor with the units they span;
3. regions are grouped by a prefix of variable length. It is the anchor gram, if at most GROUP_ROWS places have it. For a
   more frequent anchor the windows are parted by how far before the anchor they begin, in `parts` runs, and the prefix are all
   units that the windows of a run share, from the last one's first unit to the first one's last: nearly a window. Where even
   that has more than GROUP_ROWS rows, the prefix is the whole window: a group is then one node of the tree, without anything
   below to build, and what is asked of it (how many leaves, the least document) comes from an aggregate;
4. a task takes whole groups, rows sorted by Spark's external sort, and sorts their suffixes.

Only texts that hold a shared anchor are moved, once. Exact copies of a whole text are aggregated before all this: what holds
for the windows of a text holds for those of its copies, and they all start in the first copy too. Rows that repeat doc_id and text are one
text until the results, of which each of them gets its own. Units are compared by 64-bit
hashes where they are words, and whole windows of the third kind of prefix by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_CODE, blocks, gram_hash, mix, prefix_hash, ragged, span_hash, word_hashes, words
from .tables import documents, staged

GROUP_ROWS = 20_000
SALTS = 16
_SECOND = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Windows:
    """What a unit is, how many make a window and how many an anchor's gram."""

    size: int
    gram: int
    width: int  # bytes of a unit
    words: bool
    parts: int = 4  # runs that the windows of a frequent anchor are parted into

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all units, and where each document's begin."""
        if self.words:
            start, end, first = words(data, offsets)
            return word_hashes(data, start, end), first
        return BYTE_CODE[data], offsets

    def anchors(self, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows that lie in one document, their documents and anchors; the hashes of all grams."""
        reach = self.size - self.gram + 1
        count = np.maximum(0, np.diff(first) - self.size + 1)
        doc = np.repeat(np.arange(len(count)), count)
        start = np.repeat(first[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        if not len(start):
            return start, doc, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        grams = gram_hash(prefix_hash(units), self.gram)
        return start, doc, sliding(grams, reach, np.minimum)[start], grams

    def places(self, start: np.ndarray, anchor: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Places of the grams that are the anchor of some window that holds them."""
        if not len(start):
            return start
        reach = self.size - self.gram + 1
        padded = np.zeros(len(grams) + reach - 1, np.uint64)
        padded[start + reach - 1] = anchor
        return np.flatnonzero(sliding(padded, reach, np.maximum) == grams)


def sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """least over x[i:i + width] for each i, by doubling."""
    span = 1
    while span * 2 <= width:
        x, span = least(x[:-span], x[span:]), span * 2
    return least(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc, th, text_key, text: a row is known by doc_id and a hash of its text, so that rows may repeat a doc_id. doc is
    doc_id, and the least long for a null."""
    doc = F.coalesce("doc_id", F.lit(-(2**63)))
    return documents(docs).select("doc_id", doc.alias("doc"), F.xxhash64("text").alias("th"), F.md5("text").alias("text_key"), "text")


def copies(rows: DataFrame, order: str = "doc") -> DataFrame:
    """text_key, first (the least `order`) and copies of each distinct text."""
    return rows.groupBy("text_key").agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def anchor_table(rows: DataFrame, windows: Windows) -> DataFrame:
    """(anchor, doc, th, times): each anchor of each text once, with the number of places it is the anchor at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(2)):
                units, first = windows.units(data, offsets)
                start, _, anchor, grams = windows.anchors(units, first)
                at = windows.places(start, anchor, grams)
                value, row = grams[at], np.searchsorted(first, at, "right") - 1
                _, once, times = np.unique(mix(value + row.astype(np.uint64) * _SECOND), return_index=True, return_counts=True)
                mine = pa.array(row[once] + i)
                yield pa.RecordBatch.from_arrays([pa.array(value[once].view(np.int64)), batch.column(0).take(mine), batch.column(1).take(mine), pa.array(times.astype(np.int32))], ["anchor", "doc", "th", "times"])

    return rows.select("doc", "th", "text").mapInArrow(run, "anchor long, doc long, th long, times int")


def sharing(docs: DataFrame, windows: Windows, within: bool) -> DataFrame:
    """(doc, th, text, anchors) of the texts that share an anchor with another, or with themselves if `within`; of
    copies of one text the first. Staged. Without `within`, rows that have no doc_id are left out, having no place in the order."""
    rows = keyed(docs) if within else keyed(docs).where("doc_id is not null")
    found = staged(anchor_table(rows, windows), "anchors")
    total = found.groupBy("anchor").agg(F.sum(F.col("times").cast("long")).alias("times"), F.max("times").alias("most"), *(f(c).alias(f"{n}_{c}") for c in ("doc", "th") for n, f in (("low", F.min), ("high", F.max))))
    differs = "low_th <> high_th or most > 1" if within else "low_th <> high_th and low_doc <> high_doc"
    total = total.where(differs).select("anchor", (F.col("times") > GROUP_ROWS).alias("hot"))
    lists = found.join(total, "anchor").groupBy("doc", "th").agg(F.collect_set(F.struct("anchor", "hot")).alias("anchors"))
    names = rows.select("doc", "th", "text_key")
    later = names.join(copies(names), "text_key").where("doc > first").select("doc", "th")
    lists = staged(lists.join(later, ["doc", "th"], "left_anti"), "lists")
    texts = rows.groupBy("doc", "th").agg(F.first("text").alias("text")).join(lists, ["doc", "th"])  # equal rows are one text here
    return staged(texts, "sharing")


REGION = "prefix long, doc long, th long, start long, n long, units binary"
WINDOW = "h1 long, h2 long, doc long, th long, start long"
INTERVAL = "doc long, th long, start long, stop long"


def windows_of(batch: pa.RecordBatch, windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of a batch (doc, th, text, anchors): row, units, raw units, window starts, anchors, grams, shared and hot flags."""
    for i, _, data, offsets in blocks(batch.column(2), 1):
        units, first = windows.units(data, offsets)
        start, _, anchor, grams = windows.anchors(units, first)
        if not len(start):
            continue
        mine = batch.column(3)[i].values
        table = mine.field("anchor").to_numpy(zero_copy_only=False).view(np.uint64)
        order = np.argsort(table)
        table, hot = table[order], mine.field("hot").to_numpy(zero_copy_only=False)[order]
        place = np.minimum(np.searchsorted(table, anchor), len(table) - 1)
        shared = table[place] == anchor
        yield i, units, (units if windows.words else data), start, anchor, grams, shared, shared & hot[place]


def run_edges(key: np.ndarray, wanted: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last places of the runs of one key among the wanted places."""
    turn = key[1:] != key[:-1]
    edge = np.flatnonzero(wanted & np.append(True, turn | ~wanted[:-1])).tolist()
    return edge, np.flatnonzero(wanted & np.append(turn | ~wanted[1:], True)).tolist()


def longer_prefixes(units: np.ndarray, start: np.ndarray, anchor: np.ndarray, grams: np.ndarray, hot: np.ndarray, windows: Windows) -> tuple[list[int], list[int], np.ndarray]:
    """For the windows of hot anchors: first and last places of the runs that they are parted into, and the runs' prefixes."""
    reach = windows.size - windows.gram + 1
    width = -(-reach // windows.parts)
    at = np.zeros(len(start), np.int64)  # the first place of the window's anchor
    for a, b in zip(*run_edges(anchor, hot), strict=True):
        places = start[a] + np.flatnonzero(grams[start[a] : start[b] + reach] == anchor[a])
        at[a : b + 1] = places[np.searchsorted(places, start[a : b + 1])]
    part = (at - start) // width
    edge, stop = run_edges(at * windows.parts + part, hot)
    p, k = at[edge], part[edge]
    lo, hi = p - k * width, p - np.minimum((k + 1) * width - 1, reach - 1) + windows.size
    return edge, stop, mix(span_hash(prefix_hash(units), lo, hi) + mix(anchor[edge] + k.astype(np.uint64)))


def regions(texts: DataFrame, windows: Windows, hot: bool) -> DataFrame:
    """Runs of windows of one shared anchor that isn't hot, or the parts of those that are, with the units they span: hashes of
    words, or bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("prefix", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("units", pa.binary())]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for i, units, raw, start, anchor, grams, shared, is_hot in windows_of(batch, windows):
                if hot:
                    edge, stop, prefix = longer_prefixes(units, start, anchor, grams, is_hot, windows)
                else:
                    edge, stop = run_edges(anchor, shared & ~is_hot)
                    prefix = anchor[edge]
                for column, k in ((1, 0), (2, 1)):
                    out[column] += [batch.column(k)[i].as_py()] * len(edge)
                out[0] += prefix.view(np.int64).tolist()
                out[3] += start[edge].tolist()
                out[4] += [b - a + 1 for a, b in zip(edge, stop, strict=True)]
                out[5] += [raw[start[a] : start[b] + windows.size].tobytes() for a, b in zip(edge, stop, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, kinds, strict=True)], [n for n, _ in kinds])

    if hot:
        texts = texts.where(F.exists("anchors", lambda a: a["hot"]))
    return texts.select("doc", "th", "text", "anchors").mapInArrow(run, REGION)


def whole_windows(parts: DataFrame, windows: Windows) -> DataFrame:
    """128-bit hashes of the windows of some regions, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(4).to_numpy()
            units = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64 if windows.words else np.uint8)
            units = units if windows.words else BYTE_CODE[units]
            first = np.cumsum(n + windows.size - 1) - (n + windows.size - 1)
            at, row = ragged(first, n), np.repeat(np.arange(len(n)), n)
            h = [gram_hash(prefix_hash(u), windows.size)[at].view(np.int64) for u in (units, mix(units ^ _SECOND))]
            start = batch.column(3).to_numpy()[row] + at - first[row]
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), *(batch.column(k).take(pa.array(row)) for k in (1, 2)), pa.array(start)], ["h1", "h2", "doc", "th", "start"])

    return parts.select("prefix", "doc", "th", "start", "n", "units").mapInArrow(run, WINDOW)


def node_intervals(found: DataFrame, windows: Windows, within: bool) -> DataFrame:
    """Intervals of the windows that are a node of their own (`whole_windows`): repeated ones if `within`, else those also in a
    document of a smaller doc_id. Counts are aggregated, and what comes of them goes back to the rows by salted keys."""
    total = found.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.count("*").alias("times")).where("times > 1")
    total = total.select("h1", "h2", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gone = found.withColumn("salt", F.pmod(F.xxhash64("doc", "th"), F.lit(SALTS)).cast("int")).join(total, ["h1", "h2", "salt"])
    if not within:
        gone = gone.where("doc > low")
    return gone.select("doc", "th", "start", (F.col("start") + windows.size).alias("stop"))


def grouped(texts: DataFrame, windows: Windows) -> tuple[DataFrame, DataFrame]:
    """(regions in groups of at most GROUP_ROWS rows by their prefix, regions whose groups would be larger)."""
    parts = staged(regions(texts, windows, True), "parts")
    large = staged(parts.groupBy("prefix").count().where(F.col("count") > GROUP_ROWS).select("prefix"), "large")
    small = parts.join(large, "prefix", "left_anti")
    return regions(texts, windows, False).unionByName(small), parts.join(large, "prefix", "left_semi")


def distinct_regions(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the runs of equal (prefix, units), and for each row its run."""
    prefix = table.column("prefix").to_numpy()
    units = table.column("units").to_pylist()
    new = np.append(True, prefix[1:] != prefix[:-1])
    new |= np.array([True, *(a != b for a, b in zip(units[1:], units[:-1], strict=True))])
    return np.flatnonzero(new), np.cumsum(new) - 1


def intervals(table: pa.Table, run_of: np.ndarray, first: np.ndarray, flagged: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> pa.RecordBatch:
    """INTERVAL rows of all regions. flagged(row, window) tells for pairs of a row and the place of a window among those
    of the distinct regions (first: where each one's begin) whether it repeats."""
    n, start = table.column("n").to_numpy(), table.column("start").to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    hit = flagged(row, first[run_of[row]] + inside)
    begin = np.flatnonzero(hit & np.append(True, (row[1:] != row[:-1]) | ~hit[:-1]))
    end = np.flatnonzero(hit & np.append((row[1:] != row[:-1]) | ~hit[1:], True))
    at = pa.array(row[begin])
    return pa.RecordBatch.from_arrays([*(table.column(c).take(at).combine_chunks() for c in ("doc", "th")), pa.array(start[row[begin]] + inside[begin]), pa.array(start[row[begin]] + inside[end] + size)], ["doc", "th", "start", "stop"])


def by_prefix(found: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str, most_bytes: int = 24_000_000) -> DataFrame:
    """`work` on tables of whole groups, each of about `most_bytes`; rows of a group come sorted by their units, so
    that equal regions stand side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            weight += batch.nbytes
            if weight < most_bytes:
                continue
            table = pa.Table.from_batches(held)
            prefix = table.column("prefix").to_numpy()
            cut = int(np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))[-1])
            if cut and (out := work(table.slice(0, cut))) is not None:
                yield out
            held, weight = table.slice(cut).combine_chunks().to_batches(), table.slice(cut).nbytes if cut else weight
        if held and (out := work(pa.Table.from_batches(held))) is not None:
            yield out

    return found.repartition("prefix").sortWithinPartitions("prefix", "units").mapInArrow(run, schema)


def changed(texts: DataFrame, found: DataFrame, work: Callable[[str, np.ndarray], tuple], schema: str) -> DataFrame:
    """`work` on each text with intervals: (text, array of [start, stop) rows) -> values of `schema`; doc and th come first."""
    lists = found.groupBy("doc", "th").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                spans = batch.column(3)[i].values
                rows.append(work(batch.column(2)[i].as_py(), np.column_stack([spans.field(k).to_numpy() for k in ("start", "stop")])))
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string() if "string" in f else pa.int64()) for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc", "th", *names])

    return texts.select("doc", "th", "text").join(lists, ["doc", "th"]).mapInArrow(run, f"doc long, th long, {schema}")


def covered_mask(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n units lie in some [start, stop)."""
    delta = np.bincount(spans[:, 0], minlength=n + 1)[: n + 1] - np.bincount(np.minimum(spans[:, 1], n), minlength=n + 1)[: n + 1]
    return np.cumsum(delta)[:n] > 0
