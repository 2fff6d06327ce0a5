"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words, over all passages of all documents, give the idf weights.
2. A distributed randomised SVD of the passage-by-term TF-IDF matrix A: with a random Gaussian matrix R, every task
   forms its share of A'(A R); the shares are summed by blocks of terms, and the orthonormalised sum spans the
   latent space. What reaches the driver is terms x rank numbers, whatever the input's size.
   Directions are whitened by their eigenvalues, which the same sums give (Nystrom), or else language and common words
   would decide every cosine.
3. Overlapping passages of the documents and of the benchmark items are projected; passages whose cosine with an item's
   passage reaches `LEAST_COSINE` are candidates.
4. A candidate counts if the longest common subsequence of the item and the text around the passage covers
   `LEAST_COMMON` of the item's words, and so are `LEAST_ANSWER` of its last words, its answer, taken alone: this bears paraphrases,
   insertions and gaps. Before a subsequence is computed two upper bounds of its length are, by bit signatures of stretches of
   text and by counting the item's words; they pass over only what can't reach `LEAST_COMMON`.

Items under `LEAST_ITEM_WORDS` words say too little for cosines: they are found where their words stand in a row.

Every document is compared with every item, items in blocks of about `ITEM_BLOCK`, one after another: a block's items are
what the driver holds at a time. No document moves between tasks. Word codes, four bytes a word, are staged once for the
passes over them. Words are compared by 32-bit codes, so two given words are taken for each other with odds of 1 in 4e9.

Cases: null or empty text matches nothing, nor do items without words; repeated rows and tied items each get their rows,
as have rows without doc_id or item_id; of several places in a document the greatest share counts; an empty table on either
side gives an empty result; texts are read whole; clashing columns are dropped before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_CODE, LOWER, blocks, gram_hash, prefix_hash, span_hash, words
from .tables import documents, staged

TERMS = 1 << 15
RANK = 64
PASSAGE = 24
STRIDE = 12  # half a passage
#: Terms in more passages than exp(-STOP_IDF) of them have no weight.
STOP_IDF = 1.0
ITEM_STRIDE = 6
LEAST_COSINE = 0.5  # for items shorter than a passage times the square root of their share of it
SIGNATURE_WORDS = 8  # of 64 bits
CHUNK = 2_000_000
OFTEN = 96
SEGMENTS = 2048
CODE_BYTES = 1 << 20
VERIFIED = 4000  # stretches verified together
SALTS = 32
LEAST_COMMON = 0.6
ANSWER_WORDS = 0.25
LEAST_ANSWER = 0.4
LEAST_ITEM_WORDS = 8
ITEM_BLOCK = 4000
ITEM_BYTES = 16_000_000
TERM_BLOCKS = 64
SEED = 7
MATCH = "doc_id long, item_id long, common double, cosine double"


def coded(docs: DataFrame) -> DataFrame:
    """doc_id and the codes of all words of each document, in bytes. Texts are taken apart once; what follows reads these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                codes, first = word_codes(data, offsets)
                flat = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((4 * first).astype(np.int32).tobytes()), pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), flat], ["doc_id", "codes"])

    return documents(docs).mapInArrow(run, "doc_id long, codes binary")


def code_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word codes, bounds) of blocks of a column of `coded`."""
    for i, _, data, offsets in blocks(column, CODE_BYTES):
        yield i, np.frombuffer(data.tobytes(), np.uint32), offsets // 4


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words, without case of A-Z and without marks at the end, and where each document's begin."""
    data = LOWER[data]
    start, end, first = words(data, offsets)
    for _ in range(2):
        last = data[end - 1] if len(end) else data[:0]
        mark = (end - start > 1) & (last < 128) & ~_ALNUM[last]
        end = end - mark
    return (span_hash(prefix_hash(BYTE_CODE[data]), start, end) >> np.uint64(32)).astype(np.uint32), first


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True


def term_of(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint32(TERMS - 1)).astype(np.int64)


def passages(first: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of windows of `size` words every `stride` words; a shorter document is one passage."""
    count = np.diff(first)
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - size) // stride)), 0)
    doc = np.repeat(np.arange(len(n)), n)
    start = first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * stride
    return doc, start, np.minimum(start + size, first[1:][doc])


def summed_blocks(words_of: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all documents of work(word codes, bounds), an array of fixed shape whose first axis are the terms. Each
    task adds up its own documents; the tasks' arrays meet by blocks of terms, first SALTS groups of tasks apart, so that no
    task reads what all tasks have written."""
    size = int(np.prod(shape)) // TERM_BLOCKS

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.float32)
        for batch in batches:
            for _, codes, first in code_blocks(batch.column(0)):
                total += work(codes, first)
        flat = total.reshape(TERM_BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERM_BLOCKS, dtype=np.int32)), pa.array([b.tobytes() for b in flat], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(raw, np.float32).astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["block", "sums"])

    kind = "block int, sums binary"
    parts = words_of.select("codes").mapInArrow(share, kind).withColumn("salt", F.spark_partition_id() % SALTS)
    some = parts.repartition("block", "salt").select("block", "sums").mapInArrow(add, kind)
    rows = some.repartition("block").mapInArrow(add, kind).collect()
    out = np.zeros((TERM_BLOCKS, size))
    for r in rows:
        out[r.block] += np.frombuffer(r.sums, np.float32)
    return out.reshape(shape)


def term_weights(words_of: DataFrame) -> np.ndarray:
    """idf of each hashed term over all passages."""

    def count(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        _, start, end = passages(first, PASSAGE, PASSAGE)
        out = np.zeros(TERMS + 1, np.float32)
        if len(codes):
            rows = np.sort(terms_of(term_of(codes), start, end, PASSAGE, TERMS).astype(np.uint16), axis=1)
            first_in_row = np.ones(rows.shape, bool)
            first_in_row[:, 1:] = rows[:, 1:] != rows[:, :-1]
            out[:TERMS] = np.bincount(rows[first_in_row], minlength=TERMS + 1)[:TERMS]
        out[TERMS] = len(start)
        return np.concatenate([out, np.zeros(TERM_BLOCKS - 1, np.float32)])  # a multiple of TERM_BLOCKS

    total = summed_blocks(words_of, count, (TERMS + TERM_BLOCKS,))
    idf = np.log((1 + total[TERMS]) / (1 + total[:TERMS])).astype(np.float32)
    return np.where(idf < STOP_IDF, np.float32(0), idf)


def segment_sums(table: np.ndarray, term: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Sum of the table's rows over the terms start..end-1 of each segment of `size` terms at most. The table's last row is 0."""
    out = np.empty((len(start), table.shape[1]), np.float32)
    for a in range(0, len(start), SEGMENTS):
        out[a : a + SEGMENTS] = table[terms_of(term, start[a : a + SEGMENTS], end[a : a + SEGMENTS], size, len(table) - 1)].sum(1)
    return out


def terms_of(term: np.ndarray, start: np.ndarray, end: np.ndarray, size: int, filler: int) -> np.ndarray:
    """A row of `size` terms for each segment, short ones filled up."""
    place = start[:, None] + np.arange(size)[None]
    return np.where(place < end[:, None], term[np.minimum(place, len(term) - 1)], filler)


def term_sums(term: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each term the sum of rows[at] over its occurrences: frequent terms by a product with their count matrix, the
    others by their first, second, ... occurrences."""
    out = np.zeros((TERMS, rows.shape[1]), np.float32)
    count = np.bincount(term, minlength=TERMS)
    number = np.full(TERMS, -1)
    often = np.flatnonzero(count > OFTEN)
    number[often] = np.arange(len(often))
    if len(often):
        hit = number[term] >= 0
        counts = np.bincount(at[hit] * len(often) + number[term[hit]], minlength=len(rows) * len(often))
        out[often] = counts.reshape(len(rows), -1).astype(np.float32).T @ rows
    order = np.argsort(term.astype(np.uint16), kind="stable")
    order = order[number[term[order]] < 0]
    t = term[order]
    nth = np.arange(len(t)) - np.searchsorted(t, t, "left")
    for k in range(int(nth.max()) + 1 if len(t) else 0):
        now = nth == k
        out[t[now]] += rows[at[order[now]]]
        order, t, nth = order[~now], t[~now], nth[~now]
    return out


def passage_vectors(space: np.ndarray, term: np.ndarray, first: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, unit vector) of the passages; those of half a passage's stride share their halves' sums."""
    doc, start, end = passages(first, PASSAGE, stride)
    if 2 * stride == PASSAGE and len(doc):
        c_doc, c_start, c_end = passages(first, stride, stride)
        cells = segment_sums(space, term, c_start, c_end, stride)
        at = np.searchsorted(c_start, start)
        two = (at + 1 < len(c_doc)) & (c_doc[np.minimum(at + 1, len(c_doc) - 1)] == doc)
        vectors = cells[at]
        vectors[two] += cells[at[two] + 1]
    else:
        vectors = segment_sums(space, term, start, end, PASSAGE) if len(doc) else np.zeros((0, space.shape[1]), np.float32)
    return doc, start, end, unit(vectors)


def latent_space(words_of: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """(terms + 1) x rank: whitened eigenvectors of A'A in the range of A'(A R), already times idf, and a row of zeros."""
    plain = np.random.default_rng(SEED).standard_normal((TERMS, rank))
    random = with_zero(plain * idf[:, None])

    def share(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros((TERMS, rank), np.float32)
        if len(codes):
            term = term_of(codes)
            _, start, end = passages(first, PASSAGE, PASSAGE)
            ahead = segment_sums(random, term, start, end, PASSAGE)  # the passages partition the words
            out = term_sums(term, np.repeat(np.arange(len(start)), end - start), ahead)
        return out

    total = summed_blocks(words_of, share, (TERMS, rank)) * idf[:, None]
    basis, _ = np.linalg.qr(total)
    small = np.linalg.lstsq((basis.T @ plain).T, (basis.T @ total).T, rcond=None)[0].T  # basis' A'A basis, as far as R shows it
    value, turn = np.linalg.eigh((small + small.T) / 2)
    value = np.maximum(value, max(float(value.max()), 1e-9) * 1e-6)
    return with_zero(basis @ turn / np.sqrt(value) * idf[:, None])


def with_zero(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, np.zeros((1, rows.shape[1]))]).astype(np.float32)


def word_bits(codes: np.ndarray) -> np.ndarray:
    """The bit of a signature that each word sets."""
    return (codes >> np.uint32(16) & np.uint32(64 * SIGNATURE_WORDS - 1)).astype(np.int64)


def signatures(bit: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row of bits for each stretch start..end-1 of words."""
    out = np.zeros((len(start), SIGNATURE_WORDS), np.uint64)
    for k in range(int((end - start).max()) if len(start) else 0):
        b = bit[np.minimum(start + k, end - 1)]
        out[np.arange(len(b)), b >> 6] |= np.uint64(1) << (b & 63).astype(np.uint64)
    return out


def unions(cells: np.ndarray, widest: int) -> np.ndarray:
    """[k, i]: the union of the signatures of cells i to i + 2**k - 1 (as far as there are), up to `widest` cells."""
    levels = [cells]
    while 1 << len(levels) <= widest:
        last, span = levels[-1], 1 << (len(levels) - 1)
        joined = last.copy()
        joined[: len(last) - span] |= last[span:]
        levels.append(joined)
    return np.stack(levels)


class Items:
    """A block of benchmark items, ready to be searched."""

    def __init__(self, rows: list[tuple[int | None, str | None]], space: np.ndarray) -> None:
        codes, first = [], [0]
        self.ids: list[int | None] = []
        short: dict[int, list[tuple[bytes, int | None]]] = {}
        for i, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            c, _ = word_codes(raw, np.array([0, len(raw)]))
            if len(c) >= LEAST_ITEM_WORDS:
                self.ids.append(i)
                codes.append(c)
                first.append(first[-1] + len(c))
            elif len(c):
                short.setdefault(len(c), []).append((c.tobytes(), i))
        #: By number of words: sorted hashes of the short items' words, and the items (words, id) of each.
        self.short: dict[int, tuple[np.ndarray, list[list[tuple[bytes, int | None]]]]] = {}
        for n, found in short.items():
            by_hash: dict[int, list[tuple[bytes, int | None]]] = {}
            for raw, i in found:
                by_hash.setdefault(int(gram_hash(prefix_hash(np.frombuffer(raw, np.uint32).astype(np.uint64)), n)[0]), []).append((raw, i))
            self.short[n] = (np.array(sorted(by_hash), np.uint64), [by_hash[h] for h in sorted(by_hash)])
        self.codes = codes
        bounds = np.array(first)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        self.item, start, end, self.vectors = passage_vectors(space, term_of(flat), bounds, ITEM_STRIDE)
        self.offset = start - bounds[:-1][self.item] if codes else start
        self.least_cosine = (LEAST_COSINE * np.sqrt(np.minimum(1, (end - start) / PASSAGE))).astype(np.float32)
        self.size = np.diff(bounds)
        self.need = np.ceil(LEAST_COMMON * self.size - 1e-9).astype(np.int64)
        self.spare = self.size - self.need  # words that may lack
        self.bits = signatures(word_bits(flat), bounds[:-1], bounds[1:])
        self.masks: list[dict[int, int]] = []
        for c in codes:
            mask: dict[int, int] = {}
            for k, w in enumerate(c.tolist()):
                mask[w] = mask.get(w, 0) | 1 << (len(c) - 1 - k)
            self.masks.append(mask)
        #: The items' words in order, with the lowest 64 bits of their places.
        self.tables = [(np.array(sorted(m), np.uint32), np.array([m[w] & 0xFFFFFFFFFFFFFFFF for w in sorted(m)], np.uint64)) for m in self.masks]

    def common(self, item: int, region: list[int]) -> int:
        """Bits set where words of the item, bit 0 its last, belong to a longest common subsequence with the region. Both are
        read from the end, so that the lowest k bits count what the item's last k words alone have in common with it."""
        full = (1 << len(self.codes[item])) - 1
        rest, mask = full, self.masks[item]
        for w in reversed(region):
            if m := mask.get(w):
                both = rest & m
                rest = ((rest + both) | (rest - both)) & full
        return full & ~rest

    def covered(self, item: int, found: int) -> bool:
        """Whether the item's words in `found`, bits of `common`, cover the item and its answer."""
        n = len(self.codes[item])
        tail = max(1, int(n * ANSWER_WORDS))
        return found.bit_count() >= self.need[item] and (found & (1 << tail) - 1).bit_count() >= LEAST_ANSWER * tail

    def shares(self, codes: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For stretches codes[lo:hi], each with an item: the share of the item in common if item and answer are covered, else
        0. All stretches advance together, a word at a time; items over 64 words go one by one."""
        out = np.zeros(len(item))
        order = np.argsort(item, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(item[order]) != 0)).tolist() + [len(order)]
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            rows = order[a:b]
            words_of, mask = self.tables[item[rows[0]]]
            place = lo[rows][:, None] + np.arange(int((hi - lo)[rows].max()))[None]
            region = codes[np.minimum(place, len(codes) - 1)]
            at = np.minimum(np.searchsorted(words_of, region), len(words_of) - 1)
            same = (words_of[at] == region) & (place < hi[rows][:, None])
            enough = same.sum(1) >= self.need[item[rows[0]]]
            if self.size[item[rows[0]]] <= 64:
                kept.append((rows[enough], np.where(same[enough], mask[at[enough]], np.uint64(0))))
                continue
            for r in rows[enough].tolist():
                found = self.common(int(item[r]), codes[lo[r] : hi[r]].tolist())
                if self.covered(int(item[r]), found):
                    out[r] = found.bit_count() / self.size[item[r]]
        if not kept:
            return out
        rows = np.concatenate([r for r, _ in kept])
        n = self.size[item[rows]].astype(np.uint64)
        full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - n)
        rest = full.copy()
        table = np.zeros((max(m.shape[1] for _, m in kept), len(rows)), np.uint64)  # words by stretches
        i = 0
        for r, m in kept:
            table[: m.shape[1], i : i + len(r)] = m.T
            i += len(r)
        for hits in table[::-1]:
            both = rest & hits
            rest = ((rest + both) | (rest - both)) & full
        found = full & ~rest
        tail = np.maximum(1, (n * ANSWER_WORDS).astype(np.int64))
        good = (np.bitwise_count(found) >= self.need[item[rows]]) & (np.bitwise_count(found & ((np.uint64(1) << tail.astype(np.uint64)) - np.uint64(1))) >= LEAST_ANSWER * tail)
        out[rows[good]] = np.bitwise_count(found[good]) / n[good]
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def place_of(begin: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first word, word after the last) of the stretch to compare with an item of n words that would begin at the
    word `begin` of a document low..high-1. Beginnings are taken together by quarters of the item, so that the stretch depends on no
    other candidate; it has room for half an item and a stride more on both sides."""
    quarter = np.maximum(1, n // 4)
    place = (begin - low) // quarter
    left = low + place * quarter
    return place, np.maximum(low, left - n // 2 - STRIDE), np.minimum(high, left + quarter + n + n // 2 + STRIDE)


def block_matches(codes: np.ndarray, first: np.ndarray, items: Items, space: np.ndarray) -> list[tuple[int, int | None, float, float]]:
    """(document, item, share of the item in common, cosine) of the verified matches of a block, the best of each pair."""
    if not len(codes):
        return []
    best = short_matches(codes, first, items)
    if not items.ids:
        return best
    doc, start, _, vectors = passage_vectors(space, term_of(codes), first, STRIDE)
    c_doc, c_start, c_end = passages(first, STRIDE, STRIDE)
    longest = int(items.size.max())
    union = unions(signatures(word_bits(codes), c_start, c_end), min((3 * longest) // STRIDE + 8, len(c_doc)))
    c_first = np.searchsorted(c_doc, np.arange(len(first)), "left")

    def bits_of(d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The signature of words lo..hi-1 of a document, rounded up to whole cells."""
        ca, cb = c_first[d] + (lo - first[d]) // STRIDE, c_first[d] + -(-(hi - first[d]) // STRIDE)
        level = np.frexp((cb - ca).astype(float))[1] - 1
        return union[level, ca] | union[level, cb - (1 << level)]

    # whatever item a passage belongs to, the stretch to compare lies in this one
    around = ~bits_of(doc, np.maximum(first[doc], start - 3 * longest // 2 - STRIDE), np.minimum(first[doc + 1], start + longest + 3 * longest // 4 + 2 * STRIDE))
    near_of: dict[tuple[int, int, int], tuple[int, int, float]] = {}
    step = max(1, CHUNK // len(items.vectors))
    for a in range(0, len(doc), step):
        cosine = vectors[a : a + step] @ items.vectors.T
        hit = np.flatnonzero((cosine >= items.least_cosine[None]).ravel())
        w, q = np.divmod(hit, len(items.vectors))
        item = items.item[q]
        # no more words are in common than set bits that the stretch has too
        enough = np.flatnonzero(np.bitwise_count(items.bits[item] & around[w + a]).sum(1, dtype=np.uint16) <= items.spare[item])
        w, q, item, c = w[enough] + a, q[enough], item[enough], cosine.ravel()[hit[enough]]
        place, lo, hi = place_of(start[w] - items.offset[q], first[doc[w]], first[doc[w] + 1], items.size[item])
        enough = np.flatnonzero(hi > lo)
        lost = np.bitwise_count(items.bits[item[enough]] & ~bits_of(doc[w[enough]], lo[enough], hi[enough])).sum(1, dtype=np.uint16)
        enough = enough[lost <= items.spare[item[enough]]]
        for key, value in zip(zip(doc[w[enough]].tolist(), item[enough].tolist(), place[enough].tolist(), strict=True), zip(lo[enough].tolist(), hi[enough].tolist(), c[enough].tolist(), strict=True), strict=True):
            if key not in near_of or near_of[key][2] < value[2]:
                near_of[key] = value
    top: dict[tuple[int, int], tuple[float, float]] = {}
    near = list(near_of.items())
    for a in range(0, len(near), VERIFIED):
        part = near[a : a + VERIFIED]
        item, lo, hi = np.array([(key[1], value[0], value[1]) for key, value in part]).T
        share = items.shares(codes, item, lo, hi)
        for k in np.flatnonzero(share).tolist():
            key = part[k][0][:2]
            top[key] = max(top.get(key, (0.0, 0.0)), (float(share[k]), part[k][1][2]))
    return best + [(d, items.ids[item], s, c) for (d, item), (s, c) in top.items()]


def short_matches(codes: np.ndarray, first: np.ndarray, items: Items) -> list[tuple[int, int | None, float, float]]:
    """(document, item, 1, 1) of the items of few words whose words stand in a row in a document."""
    out: dict[tuple[int, int], tuple[int, int | None, float, float]] = {}
    for n, (keys, found) in items.short.items():
        if len(codes) < n:
            continue
        grams = gram_hash(prefix_hash(codes.astype(np.uint64)), n)
        place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        at = np.flatnonzero(keys[place] == grams)
        doc = np.searchsorted(first, at, "right") - 1
        for k, d in zip(at[at + n <= first[doc + 1]].tolist(), doc[at + n <= first[doc + 1]].tolist(), strict=True):
            for raw, i in found[place[k]]:
                if raw == codes[k : k + n].tobytes():
                    out[d, id(raw)] = (d, i, 1.0, 1.0)
    return list(out.values())


def item_blocks(benchmark: DataFrame, space: np.ndarray) -> Iterator[tuple[bool, Items]]:
    """(whether more follow, items): the benchmark in blocks of about ITEM_BLOCK items and ITEM_BYTES bytes, made one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    n = max(1, -(-total.n // ITEM_BLOCK), -(-(total.bytes or 0) // ITEM_BYTES))
    for k in range(n):
        yield k < n - 1, Items([(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], space)


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, common, cosine): one row for each document and benchmark item found in it."""
    words_of = staged(coded(docs), "codes", "uncompressed")
    space = latent_space(words_of, term_weights(words_of))
    out = None
    for more, items in item_blocks(benchmark, space):
        found = _search(words_of, items, space)
        if more or out is not None:
            found = staged(found, "matches")  # a block is done before the next one is made
        out = found if out is None else out.unionByName(found)
    return out


def _search(words_of: DataFrame, items: Items, space: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, codes, first in code_blocks(batch.column(1)):
                found = block_matches(codes, first, items, space)
                if found:
                    d, item, share, cosine = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(d) + i)), pa.array(item, pa.int64()), pa.array(share), pa.array(cosine)], ["doc_id", "item_id", "common", "cosine"])

    return words_of.mapInArrow(run, MATCH)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no benchmark item is found."""
    words_of = staged(coded(docs), "codes", "uncompressed")
    space = latent_space(words_of, term_weights(words_of))
    place = docs.columns.index("text")
    for more, items in item_blocks(benchmark, space):
        docs = docs.mapInArrow(_clean(items, space, place), docs.schema)
        if more:
            docs = staged(docs, "clean")
    return docs


def _clean(items: Items, space: np.ndarray, place: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, _, data, offsets in blocks(batch.column(place)):
                keep[[i + d for d, *_ in block_matches(*word_codes(data, offsets), items, space)]] = False
            yield batch.filter(pa.array(keep))

    return run
