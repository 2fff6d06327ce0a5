"""Token ids in Re-Pair compressed shards.

Documents are range-partitioned and sorted by doc_id, encoded, and written as shards of about `SHARD_TOKENS` ids. A
shard is a row of a Parquet table: a grammar (pairs of symbols, each replaced by a nonterminal), the length each
nonterminal expands to, and the compressed symbol sequence. The sums of the expansion lengths find any document's ids
without decoding the others (`decode_range`).

Encoding splits a text only where the tokenizer's own pre-tokenizer always splits (around a lone space or line break
between two visible characters, before a mark that follows a letter), so each distinct piece goes through the tokenizer once and gives the ids of the whole.

Cases: null or empty text is the end id alone; rows with equal doc_id are ordered by text, null doc_ids come first;
an empty table gives an empty result; texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import BYTE_CODE, SPACE, SpanCache, blocks, prefix_hash, ragged, span_hash, sums
from .tables import documents, work_path

END_ID = 2
SHARD_TOKENS = 1 << 18
#: Replacement ends when no pair occurs this often. A rule is two symbols, so one for a pair that occurs twice would store
#: as many symbols as it saves, and its length besides.
LEAST_COUNT = 3
#: The threshold of pair counts falls to 1 / FALL from round to round.
FALL = 4
#: Ids decoded at a time when a shard is read.
RANGE_TOKENS = 1 << 17
BLOCK_BYTES = 1 << 19
CACHE_PIECES = 1 << 21
#: Pieces that go through the tokenizer as the lines of one text.
JOINED = 200
SHARD_SCHEMA = "part int, shard int, n_tokens long, base int, doc_ids array<long>, doc_tokens array<long>, rules binary, lengths binary, symbols binary"

_UNKNOWN = np.iinfo(np.int32).max
_LEAD = np.zeros(256, bool)  # first bytes of characters among which Unicode has white space
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_BLANK = SPACE.copy()
_BLANK[28:32] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)  # ASCII punctuation but the apostrophe, which may begin a contraction, and < | > of special tokens
_MARK[[ord(c) for c in ".,;:!?*$%&#()/=+@[]{}-\""]] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which the text can be cut without changing its ids; all starts of non-empty documents among them."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    start[offsets[:-1]] = True
    if n > 2:
        lone = (data[1:-1] == 32) | (data[1:-1] == 10)
        at = np.flatnonzero(lone) + 1
        before, after = data[at - 1], data[at + 1]
        unsafe = _BLANK[before] | _BLANK[after] | _LEAD[after]
        unsafe |= (before >= 0x80) & (_LEAD[data[at - 2]] | _LEAD[data[np.maximum(at - 3, 0)]])
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        at = at[~unsafe & ~edge[at] & ~edge[at + 1]]
        start[at] = True
        start[at[data[at] == 10] + 1] = True
        start[1:n] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    return np.flatnonzero(start[:n])


class PieceEncoder:
    """Ids of whole texts, each distinct piece encoded once as long as the cache holds it."""

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.cache = SpanCache(CACHE_PIECES)

    def tokenize(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has. Pieces without line breaks go through the tokenizer in
        lines of one text: the pre-tokenizer parts a line break from a piece that has no white space but a space before it,
        and the break's own id, which nothing else has, tells the pieces apart."""
        blank = re.compile(r"(?!^ \S)\s")
        alone = np.array([blank.search(p) is not None for p in pieces], bool)
        lone = [pieces[k] for k in np.flatnonzero(alone).tolist()]
        joined = [p for p, a in zip(pieces, alone.tolist(), strict=True) if not a]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(["\n".join(joined[i : i + JOINED]) + "\n" for i in range(0, len(joined), JOINED)] + lone, add_special_tokens=False)]
        texts = -(-len(joined) // JOINED)
        flat = np.fromiter(chain.from_iterable(found[:texts]), np.int32)
        ends = np.flatnonzero(flat == self.line_break)
        size = np.zeros(len(pieces), np.int64)
        size[~alone] = np.diff(ends, prepend=-1) - 1
        size[alone] = [len(f) for f in found[texts:]]
        out = np.zeros(int(size.sum()), np.int32)
        first = np.cumsum(size) - size
        out[ragged(first[~alone], size[~alone])] = flat[flat != self.line_break]
        out[ragged(first[alone], size[alone])] = np.fromiter(chain.from_iterable(found[texts:]), np.int32)
        return out, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, and how many each document has."""
        start = piece_starts(data, offsets)
        end = np.append(start[1:], len(data))[: len(start)]
        keys = span_hash(prefix_hash(BYTE_CODE[data]), start, end)
        new = self.cache.missing(keys)
        if len(new):
            raw = data.tobytes()
            pieces = [raw[i:j].decode("utf-8", "replace") for i, j in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            self.cache.add(keys[new], *self.tokenize(pieces))
        ids, size = self.cache.get(keys)
        return ids, sums(size, np.searchsorted(start, offsets, "left"))


_encoders: dict[str, PieceEncoder] = {}


def encoder_of(tokenizer_path: str) -> PieceEncoder:
    """Tasks that a Python worker runs one after another share its cache."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = PieceEncoder(tokenizer_path)
    return _encoders[tokenizer_path]


class _Sequence:
    """The symbols of a shard under replacement: a doubly linked list in arrays, so that a replacement moves nothing. Entry
    n is the end mark. `bound` is never less than the number of times that the pair starting at a place occurs, and 0 where
    no pair may start: across the end of a document, at the end, on places that are gone."""

    def __init__(self, symbols: np.ndarray, closed: np.ndarray) -> None:
        n = len(symbols)
        self.symbols = np.append(symbols, END_ID).astype(np.uint32)
        self.after = np.arange(1, n + 2, dtype=np.int32)
        self.before = np.arange(-1, n, dtype=np.int32)
        self.bound = np.append(np.where(closed, 0, _UNKNOWN), 0).astype(np.int32)
        self.bound[max(0, n - 1) :] = 0
        self.live = np.ones(n + 1, bool)
        self.n = self.left = n

    def pairs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs that may occur `least` times or more, and the pairs. Of a run of one symbol every other place."""
        at = np.flatnonzero(self.bound >= least).astype(np.int32)
        left, right = self.symbols[at], self.symbols[self.after[at]]
        code = left.astype(np.uint64) << np.uint64(32) | right
        twin = np.flatnonzero(left == right)
        if len(twin):
            place, k = at[twin], np.arange(len(twin))
            begins = np.append(True, place[1:] != self.after[place[:-1]])
            odd = twin[(k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 1]
            if len(odd):
                chosen = np.ones(len(at), bool)
                chosen[odd] = False
                at, code = at[chosen], code[chosen]
        return at, code

    def replace(self, at: np.ndarray, by: np.ndarray, closes: np.ndarray) -> None:
        """The pairs at these places, which don't overlap, become the symbols `by`."""
        self.symbols[at] = by
        gone = self.after[at]
        after = self.after[gone]
        self.live[gone], self.bound[gone] = False, 0
        self.after[at], self.before[after] = after, at
        earlier = self.before[at]
        touched = np.concatenate([at, earlier[earlier >= 0]])
        self.bound[touched] = np.where(closes[self.symbols[touched]] | (self.after[touched] >= self.n), 0, _UNKNOWN)
        self.left -= len(at)
        if self.left < 0.7 * self.n:  # close the gaps
            live = self.live[:-1]
            symbols, bound = self.symbols[:-1][live], self.bound[:-1][live]
            self.__init__(symbols, np.zeros(len(symbols), bool))
            self.bound[:-1] = bound

    def rest(self) -> np.ndarray:
        return self.symbols[:-1][self.live[:-1]].astype(np.int64)


def _frequent(code: np.ndarray, sequence: _Sequence, at: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, pairs, threshold): pairs whose hash bucket, hence perhaps they, reach the threshold; counts of buckets
    bound those of pairs from above. Without a threshold yet it is a share of the greatest count."""
    bits = max(8, len(code).bit_length())
    bucket = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
    most = np.bincount(bucket, minlength=1 << bits).astype(np.int32)[bucket]
    sequence.bound[at] = most
    if least is None:
        least = max(LEAST_COUNT, int(most.max()) // FALL)
    maybe = np.flatnonzero(most >= least)
    return at[maybe], code[maybe], least


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: the rules (pairs of symbols), the length of each rule's expansion and the symbols left.

    Pairs that don't overlap are counted; the most frequent are replaced from left to right, each where no more frequent one
    overlaps it, until no pair occurs LEAST_COUNT times. A round takes all pairs above a threshold that falls to a share
    1 / FALL from round to round, and only places whose pair may reach it are looked at. No rule crosses the end of a
    document, and every rule is used twice at least.
    """
    closes = np.arange(base) == END_ID
    sequence = _Sequence(ids, closes[ids])
    rules: list[np.ndarray] = []
    length, threshold = np.ones(base, np.int64), None
    while True:
        at, code = sequence.pairs(threshold or LEAST_COUNT)
        if len(at):
            at, code, threshold = _frequent(code, sequence, at, threshold)
        if not len(at):
            if threshold is None or threshold == LEAST_COUNT:
                break
            threshold = max(LEAST_COUNT, threshold // FALL)
            continue
        order = np.argsort(code)
        ordered = code[order]
        begins = np.append(True, ordered[1:] != ordered[:-1])
        edge = np.flatnonzero(begins)
        times = np.diff(np.append(edge, len(ordered))).astype(np.int32)
        pair_of = np.empty(len(order), np.int32)
        pair_of[order] = np.cumsum(begins, dtype=np.int32) - 1
        rank = np.empty(len(times), np.int32)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(times), dtype=np.int32)
        exact = times[pair_of]
        sequence.bound[at] = exact
        good = np.flatnonzero(exact >= threshold)
        threshold = max(LEAST_COUNT, threshold // FALL)
        if not len(good):
            continue
        at, pair_of = at[good], pair_of[good]
        worth = rank[pair_of]
        overlap = at[1:] == sequence.after[at[:-1]]
        take = np.ones(len(at), bool)
        take[1:] &= ~(overlap & (worth[:-1] < worth[1:]))
        take[:-1] &= ~(overlap & (worth[1:] < worth[:-1]))
        often = np.bincount(pair_of[take], minlength=len(times)) >= 2
        take &= often[pair_of]
        made = np.flatnonzero(often)
        number = np.zeros(len(times), np.uint32)
        number[made] = len(length) + np.arange(len(made))
        pair = ordered[edge[made]]
        rule = np.column_stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)]).astype(np.int64)
        rules.append(rule)
        length = np.append(length, length[rule[:, 0]] + length[rule[:, 1]])
        closes = np.append(closes, closes[rule[:, 1]])
        sequence.replace(at[take], number[pair_of[take]], closes)
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), length[base:], sequence.rest()


def decode_range(rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, base: int, first: int, last: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Ids first..last-1 of a shard. Only the symbols that reach into the range are taken apart, and of their parts again
    only those that do; a part's place follows from the expansion lengths. ends: sums of the symbols' lengths, if at hand."""
    size = np.append(np.ones(base, np.int64), lengths)
    if ends is None:
        ends = np.cumsum(size[symbols])
    i, j = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left") + 1
    part = symbols[i:j].astype(np.int32)
    place = (ends[i:j] - size[part] - first).astype(np.int32)
    width = max(0, last - first)
    out = np.zeros(width, np.uint32)
    left, right, size = rules[:, 0].astype(np.int32), rules[:, 1].astype(np.int32), size.astype(np.int32)
    while len(part):
        if place.min() < 0 or int(place.max()) >= width:
            near = (place < width) & (place + size[part] > 0)
            part, place = part[near], place[near]
        plain = part < base
        out[place[plain]] = part[plain]
        rule, place = part[~plain] - base, place[~plain]
        first_part = left[rule]
        part, place = np.concatenate([first_part, right[rule]]), np.concatenate([place, place + size[first_part]])
    return out


def decompress(rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, base: int) -> np.ndarray:
    ends = np.cumsum(np.append(np.ones(base, np.int64), lengths)[symbols])
    return decode_range(rules, lengths, symbols, base, 0, int(ends[-1]) if len(ends) else 0, ends)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the shards of `docs` in ascending order of doc_id as a Parquet table at `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        base = encoder.tokenizer.get_vocab_size()
        part, shard, pending, held = 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([p[2] for p in pending])
            doc_ids = pa.concat_arrays([p[0] for p in pending])
            counts = np.concatenate([p[1] for p in pending])
            rules, lengths, symbols = compress(ids, base)
            width = np.uint16 if base + len(rules) < 1 << 16 else np.uint32
            one = lambda x, kind: pa.array([x], kind)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), x) for x in (doc_ids, pa.array(counts, pa.int64()))]
            columns = [one(part, pa.int32()), one(shard, pa.int32()), one(len(ids), pa.int64()), one(base, pa.int32()), *lists]
            columns += [one(x.tobytes(), pa.binary()) for x in (rules.astype(width), lengths.astype(np.uint32), symbols.astype(width))]
            return pa.RecordBatch.from_arrays(columns, names)

        names = [f.split()[0] for f in SHARD_SCHEMA.split(", ")]
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
            for i, j, data, offsets in blocks(batch.column(2), BLOCK_BYTES):
                ids, counts = encoder.encode(data, offsets)
                ends = np.cumsum(counts + 1) - 1
                whole = np.full(len(ids) + len(counts), END_ID, np.int32)
                inside = np.ones(len(whole), bool)
                inside[ends] = False
                whole[inside] = ids
                pending.append((batch.column(1).slice(i, j - i), counts + 1, whole))
                held += len(whole)
                if held >= shard_tokens:
                    yield flush()
                    shard, pending, held = shard + 1, [], 0
        if pending:
            yield flush()

    ordered = documents(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    parts = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, SHARD_SCHEMA)
    parts.write.option("compression", "zstd").parquet(path)


def symbols_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansion lengths, symbols) of a shard's row."""
    lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
    width = np.uint16 if row["base"] + len(lengths) < 1 << 16 else np.uint32
    rules = np.frombuffer(row["rules"], width).astype(np.int64).reshape(-1, 2)
    return rules, lengths, np.frombuffer(row["symbols"], width).astype(np.int64)


def read_tokens(spark, path: str) -> DataFrame:
    """The shards' table."""
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, shard and the number of ids in all shards before. Sums by part come first, so that the one ordered sum
    over all has a row for each part, not for each shard or document."""
    sizes = shards.select("part", "shard", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(before, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("shard_start"))


def ranges(rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, base: int, end: np.ndarray) -> Iterator[tuple[int, int, memoryview]]:
    """(document, document after the last, their ids as little-endian bytes) for runs of whole documents of about
    RANGE_TOKENS ids, each decoded by itself. end: where each document of the shard ends."""
    ends = np.cumsum(np.append(np.ones(base, np.int64), lengths)[symbols])
    i, begin = 0, 0
    while i < len(end):
        j = max(i + 1, int(np.searchsorted(end, begin + RANGE_TOKENS, "right")))
        last = int(end[j - 1])
        yield i, j, memoryview(decode_range(rules, lengths, symbols, base, begin, last, ends).astype("<u4").tobytes())
        i, begin = j, last


def document_ids(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents whose doc_id is in `wanted`: of their shards only the ranges that hold them are decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules, lengths, symbols = symbols_of(row)
                known = np.array([d is not None for d in row["doc_ids"]], bool)
                doc_ids, end = np.array([d or 0 for d in row["doc_ids"]], np.int64), np.cumsum(row["doc_tokens"])
                for k in np.flatnonzero(known & np.isin(doc_ids, np.array(row["wanted"], np.int64))).tolist():
                    ids = decode_range(rules, lengths, symbols, row["base"], int(end[k]) - row["doc_tokens"][k], int(end[k]))
                    yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][k]], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    names = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    lists = shards.select("part", "shard", F.explode("doc_ids").alias("doc_id")).join(names, "doc_id").groupBy("part", "shard").agg(F.collect_set("doc_id").alias("wanted"))
    return shards.drop("n_tokens").join(lists, ["part", "shard"]).mapInArrow(run, "doc_id long, ids array<long>")


def document_digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the decoded shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in ("part", "shard", "base", "rules", "lengths", "symbols")}
                rules, lengths, symbols = symbols_of(row)
                doc_ids = batch.column("doc_ids")[k].values
                counts = batch.column("doc_tokens")[k].values.to_numpy()
                end = np.cumsum(counts)
                crc: list[int] = []
                for i, j, raw in ranges(rules, lengths, symbols, row["base"], end):
                    at = (end[i:j] - end[i] + counts[i]).tolist()
                    crc += [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(at, counts[i:j].tolist(), strict=True)]
                fill = lambda x, n=len(counts): pa.array(np.full(n, x, np.int32))
                yield pa.RecordBatch.from_arrays([fill(row["part"]), fill(row["shard"]), doc_ids, pa.array(end - counts), pa.array(counts), pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    found = shards.mapInArrow(run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    placed = found.join(shard_starts(shards), ["part", "shard"])
    return placed.select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_shards(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = work_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path)
    return read_tokens(docs.sparkSession, path)
