"""Near-duplicate documents by SetSketch registers.

A document's set are the hashes of its 5-word shingles. Every shingle drives a Poisson process of points, each of which
falls on a random register; a register keeps the least point, truncated and put on an exponential scale, so sketches of
unions are maxima. Bands of registers gather documents into buckets; buckets that share a document become one candidate
group; inside a group the likelihood of the three ways two registers compare, taken jointly over all of them, estimates
the Jaccard similarity, and pairs that it doesn't rule out are verified on full sets.

Documents with equal sets are one class from the start. Groups are found by connected components over (member, least
member) edges, and one with more bytes or pairs than a task should have is dealt out in pairs of blocks; so no pairs are emitted within a
bucket and no group meets in one task without bound. With 32 bands of 5 registers a pair at 0.85 is missed with a
probability of 7e-9.

Cases: null or empty text has an empty set and is linked with nothing; fewer words than a shingle make one shingle; rows
that repeat a doc_id count as one document with the union of their links; null doc_ids are classes of their own text; an
empty table gives an empty result; texts are read whole; clashing columns are dropped before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .arrays import BYTE_CODE, LOWER, blocks, gram_hash, mix, owners, prefix_hash, ragged, span_hash, words
from .tables import documents, staged

SHINGLE = 5
BANDS = 32
ROWS = 5
REGISTERS = BANDS * ROWS
BASE = 1.001
LARGEST = 2.0  # points beyond it leave a register at 0
MARGIN = 0.3  # pairs whose estimate is this much below the threshold aren't verified: over seven standard deviations
GROUP_BYTES = 16_000_000
GROUP_DOCS = 2000  # a group beyond either is dealt out, so that no task compares more than (2 * GROUP_DOCS)**2 / 2 pairs
PROFILE = "doc_id long, n_shingles long, n_bytes long, signature binary, sketch binary"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each document, and where each document's begin."""
    data = LOWER[data]
    start, end, first = words(data, offsets)
    h = span_hash(prefix_hash(BYTE_CODE[data]), start, end)
    prefix = prefix_hash(h)
    doc = owners(first)
    count = np.diff(first)
    place = np.flatnonzero(doc[size - 1 :] == doc[: len(doc) - size + 1]) if len(doc) >= size else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    keys = np.concatenate([gram_hash(prefix, size)[place] if len(place) else np.zeros(0, np.uint64), span_hash(prefix, first[short], first[short] + count[short])])
    owner = np.concatenate([doc[place], short])
    _, once = np.unique(mix(keys + owner.astype(np.uint64) * _STEP), return_index=True)
    once = once[np.argsort(owner[once], kind="stable")]
    return keys[once], np.searchsorted(owner[once], np.arange(len(offsets)), "left")


def sketches(keys: np.ndarray, bounds: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """One row of registers a document. Points of all shingles advance together; a shingle stops when its next point is
    beyond the greatest register of its document."""
    n = len(bounds) - 1
    least = np.full((n, registers), LARGEST)
    flat = least.reshape(-1)
    doc = owners(bounds)
    point = np.zeros(len(keys))
    state = keys.copy()
    turn = 0
    while len(doc):
        state = state + _STEP
        draw = mix(state)
        point = point - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / registers
        where = doc * registers + (mix(draw ^ _TURN) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat, where, point)
        turn += 1
        alive = point < (least.max(1)[doc] if turn % 3 == 0 or turn < 3 else LARGEST)
        if not alive.all():
            doc, point, state = doc[alive], point[alive], state[alive]
    value = np.floor(np.log(LARGEST / least) / np.log(BASE)) + (least < LARGEST)
    return np.minimum(value, 65535).astype(np.uint16)


def likely_jaccard(equal: np.ndarray, greater: np.ndarray, less: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity of the greatest likelihood, for numbers of registers that are equal, greater in the first and
    greater in the second sketch, and set sizes a and b."""
    u, v = a / (a + b), b / (a + b)
    grid = np.linspace(0, 1, 101)[None]
    most = np.minimum(u / v, v / u)[:, None]
    j = np.minimum(grid, most)
    log_b = np.log(BASE)
    ahead = -np.log1p(-(BASE - 1) / BASE * np.clip(u[:, None] - v[:, None] * j, 0, 1)) / log_b
    behind = -np.log1p(-(BASE - 1) / BASE * np.clip(v[:, None] - u[:, None] * j, 0, 1)) / log_b
    same = np.clip(1 - ahead - behind, 1e-12, 1)
    score = equal[:, None] * np.log(same) + greater[:, None] * np.log(np.maximum(ahead, 1e-12)) + less[:, None] * np.log(np.maximum(behind, 1e-12))
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def profiles(docs: DataFrame) -> DataFrame:
    """Set size, signature (equal for equal sets) and sketch of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                keys, bounds = shingle_sets(data, offsets)
                n = np.diff(bounds)
                rows = sketches(keys, bounds)
                totals = [np.concatenate([[np.uint64(0)], np.cumsum(mix(keys ^ t))]) for t in (_STEP, _TURN)]
                signs = np.column_stack([t[bounds[1:]] - t[bounds[:-1]] for t in totals] + [n.astype(np.uint64)])
                empty = n == 0
                binary = lambda x: pa.array([None if e else r.tobytes() for e, r in zip(empty, x, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(np.diff(offsets)), binary(signs), binary(rows)], ["doc_id", "n_shingles", "n_bytes", "signature", "sketch"])

    return documents(docs).mapInArrow(run, PROFILE)


def band_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, class_id): a hash of each band's number and registers. A band that no shingle reached says nothing and has no
    bucket; it comes up in tiny sets alone, where only equal sets are as similar as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS).astype(np.uint64)
                prefix = prefix_hash(mix(rows.ravel() + np.uint64(1)))
                start = np.arange(len(rows) * BANDS) * ROWS
                key = mix(span_hash(prefix, start, start + ROWS) + (start // ROWS % BANDS).astype(np.uint64))
                told = rows.reshape(-1, ROWS).any(1)
                yield pa.RecordBatch.from_arrays([pa.array(key[told].view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)[told])], ["bucket", "class_id"])

    return classes.select("class_id", "sketch").mapInArrow(run, "bucket long, class_id long")


def linked(keys: np.ndarray, bounds: np.ndarray, rows: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of verified links that span the linked components of a group; pairs inside one are passed over."""
    g = len(bounds) - 1
    size = np.diff(bounds)
    _, ids = np.unique(keys, return_inverse=True)
    flag = np.zeros(len(keys) + 1, bool)
    root = np.arange(g)
    found = []
    for i in range(g - 1):
        j = np.arange(i + 1, g)
        small, large = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
        j = j[(root[j] != root[i]) & (100 * small >= percent * large)]
        if not len(j):
            continue
        equal, greater = (rows[j] == rows[i]).sum(1), (rows[i] > rows[j]).sum(1)
        guess = likely_jaccard(equal, greater, rows.shape[1] - equal - greater, np.full(len(j), float(size[i])), size[j].astype(float))
        j = j[guess >= percent / 100 - MARGIN]
        if not len(j):
            continue
        mine = ids[bounds[i] : bounds[i + 1]]
        flag[mine] = True
        hits = np.concatenate([[0], np.cumsum(flag[ids[ragged(bounds[j], size[j])]])])
        flag[mine] = False
        end = np.cumsum(size[j])
        both = hits[end] - hits[end - size[j]]
        for k in j[100 * both >= percent * (size[i] + size[j] - both)].tolist():
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                found.append((i, k))
    return found


def group_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) links of class ids; members has group, class_id, sketch, text, and all rows of a group meet."""

    def links_of(table: pa.Table) -> pa.RecordBatch:
        groups = table.column("group").to_numpy()
        ids = table.column("class_id").to_numpy()
        rows = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        parts, sizes = [], []
        for _, _, data, offsets in blocks(table.column("text").combine_chunks()):
            keys, bounds = shingle_sets(data, offsets)
            parts.append(keys)
            sizes.append(np.diff(bounds))
        keys, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        edge = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])).tolist() + [len(groups)]
        found = []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if e - s > 1:
                found += [(s + i, s + j) for i, j in linked(keys[bounds[s] : bounds[e]], bounds[s : e + 1] - bounds[s], rows[s:e], percent)]
        pair = np.array(found, int).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[pair[:, 0]]), pa.array(ids[pair[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            weight += batch.nbytes
            if weight < 4_000_000:
                continue
            table = pa.Table.from_batches(held)
            groups = table.column("group").to_numpy()
            cut = int(np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))[-1])  # the last group may go on
            if cut:
                yield links_of(table.slice(0, cut))
            held, weight = table.slice(cut).combine_chunks().to_batches(), 0
        if held:
            yield links_of(pa.Table.from_batches(held))

    ordered = members.repartition("group").sortWithinPartitions("group", "class_id")
    return ordered.select("group", "class_id", "sketch", "text").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document. Documents whose sets have a Jaccard similarity of
    `percent` per cent or more are linked; component_id is the least doc_id in reach, and the document that has it is kept."""
    profile = staged(profiles(docs), "profiles")
    classes = profile.where("signature is not null and doc_id is not null").groupBy("signature").agg(F.min("doc_id").alias("class_id"), F.first("sketch").alias("sketch"), F.first("n_bytes").alias("n_bytes"))
    classes = staged(classes, "classes")
    buckets = band_buckets(classes)
    # each bucket's members are tied to its least one
    least = buckets.groupBy("bucket").agg(F.min("class_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    ties = buckets.join(least, "bucket").where("class_id <> least").select("class_id", "least").distinct()
    groups = connected_components(ties, "class_id", "least")
    sized = groups.join(classes, F.col("id") == F.col("class_id")).select("component", "class_id", "sketch", "n_bytes")
    weight = sized.groupBy("component").agg(F.greatest(F.sum("n_bytes") / GROUP_BYTES, F.count("*") / GROUP_DOCS).alias("weight"))
    parts = F.greatest(F.ceil("weight"), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")
    dealt = sized.join(weight, "component").withColumn("parts", parts).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), "class_id", "sketch")
    texts = documents(docs).withColumnRenamed("doc_id", "class_id")
    links = group_links(dealt.join(texts, "class_id"), percent)
    linked_classes = connected_components(links).withColumnRenamed("id", "class_id")
    by_class = classes.select("signature", "class_id").join(linked_classes, "class_id", "left").select("signature", F.coalesce("component", "class_id").alias("component_id"))
    out = profile.select("doc_id", "n_shingles", "signature").join(by_class, "signature", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents with all their columns, without those that have a kept near duplicate. Rows without doc_id stay."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
