"""SentencePiece-style encoding by batched Viterbi in numpy, and decoding that gives the text back exactly.

Text becomes code points with U+2581 for each space and one more before a non-empty text. It is cut where no piece can
reach across: before a run of spaces and around line breaks. Distinct chunks of equal length advance together: hashes of
all their substrings probe the sorted hashes of the pieces, and for each end position one vectorised maximum over the
piece lengths stores score and backpointer. Chunks over LONG_CHUNK code points, as in text without spaces, go one by one, in
stretches, to the same end. A code point that no piece covers costs its bytes and becomes byte pieces.

A U+2581 that stands in the text itself is spelled in bytes, so decode(encode(text)) == text for every text.

Cases: of equally good segmentations the one whose last piece is shorter counts, at every place; null or empty text has no ids (and decodes to the empty text); repeated rows are encoded alike; an empty table gives
an empty result; texts are encoded whole; other columns stay out of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .arrays import SpanCache, blocks, mix, prefix_hash, ragged, span_hash, sums
from .tables import documents

SPACE_MARK = 0x2581
FOREIGN_MARK = 0x110000  # a U+2581 of the text itself
#: Score below the least of all pieces that each byte of an uncovered code point costs.
BYTE_PENALTY = 10.0
BLOCK_BYTES = 1 << 20
GROUP_CELLS = 500_000
CACHE_CHUNKS = 1 << 19
SCALE = 1 << 20  # scores are multiples of 1 / SCALE, so sums are exact and equal ones are ties
LONG_CHUNK = 1024  # code points; longer ones go alone
STRETCH = 1 << 16
ENCODED = "doc_id long, text string, ids array<int>"


@dataclass
class Pieces:
    keys: np.ndarray  # sorted hashes of the pieces' code points
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray  # id of each byte's piece
    byte_score: float
    flat: np.ndarray  # UTF-8 bytes of all pieces by id, U+2581 as a space
    at: np.ndarray
    size: np.ndarray
    cache: SpanCache  # chunks seen before; a worker's tasks share it


def point_codes(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x51ED270B))


_loaded: dict[str, Pieces] = {}


def load(model_path: str) -> Pieces:
    """Pieces of a SentencePiece model. Its merges are ordered by rank; a piece of rank r has the probability
    that Zipf's law gives it, and scores its logarithm. Pieces in which a space follows another character are left out, for chunks end before spaces."""
    if model_path in _loaded:
        return _loaded[model_path]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    byte_ids = np.zeros(256, np.int32)
    texts, normal, raw = [], [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            raw.append(piece.replace("▁", " ").encode())
            if "▁" not in piece.lstrip("▁") and "\n" not in piece:
                texts.append(piece)
                normal.append(i)
    length = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    end = np.cumsum(length)
    keys = span_hash(prefix_hash(point_codes(points)), end - length, end)
    ids = np.array(normal, np.int32)
    rank = np.argsort(np.argsort([-model.get_score(i) for i in normal], kind="stable"), kind="stable")
    scores = -np.log((rank + 1.0) * np.sum(1.0 / np.arange(1, len(rank) + 1)))
    scores = np.round(scores * SCALE) / SCALE
    order = np.argsort(keys)
    size = np.array([len(r) for r in raw])
    found = Pieces(keys[order], ids[order], scores[order], int(length.max()), byte_ids, float(scores.min()) - BYTE_PENALTY, np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size, SpanCache(CACHE_CHUNKS))
    _loaded[model_path] = found
    return found


def utf8_length(points: np.ndarray) -> np.ndarray:
    return np.where(points == FOREIGN_MARK, 3, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)


def viterbi(chunks: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of each row of equally long chunks: for each row and each place where a piece ends, the piece's
    id (-1: a code point in bytes), elsewhere -2; and the score of each row."""
    n, length = chunks.shape
    reach = min(pieces.longest, length)
    prefix = prefix_hash(point_codes(chunks.ravel()))
    row = np.arange(n)[:, None] * length
    score = np.full((n, length + 1, reach), -np.inf)
    which = np.full((n, length + 1, reach), -1, np.int32)
    for size in range(1, reach + 1):
        start = (row + np.arange(length - size + 1)[None]).ravel()
        key = span_hash(prefix, start, start + size)
        place = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
        hit = (pieces.keys[place] == key).reshape(n, -1)
        place = place.reshape(n, -1)
        score[:, size:, size - 1] = np.where(hit, pieces.scores[place], -np.inf)
        which[:, size:, size - 1] = np.where(hit, pieces.ids[place], -1)
    single = score[:, 1:, 0]
    score[:, 1:, 0] = np.where(np.isinf(single), utf8_length(chunks) * pieces.byte_score, single)
    best = np.full((n, length + reach + 1), -np.inf)  # place e of a chunk is column e + reach
    best[:, reach] = 0
    back = np.zeros((n, length + 1), np.int16)
    for e in range(1, length + 1):
        via = best[:, e + reach - 1 : e - 1 if e else None : -1][:, :reach] + score[:, e]
        back[:, e] = via.argmax(1)
        best[:, e + reach] = via.max(1)
    out = np.full((n, length), -2, np.int32)
    at, rows = np.full(n, length), np.arange(n)
    while len(rows):
        step = back[rows, at]
        out[rows, at - 1] = which[rows, at, step]
        at = at - step - 1
        more = at > 0
        at, rows = at[more], rows[more]
    return out, best[:, length + reach]


def one_path(points: np.ndarray, pieces: Pieces) -> np.ndarray:
    """`viterbi` for one long chunk, whose code points can't advance beside others: STRETCH of them at a time are probed, and
    only pieces that are there are compared. What is carried from stretch to stretch are scores and the last piece's length."""
    length, reach = len(points), pieces.longest
    best = [0.0] * (length + 1)
    back = np.ones(length + 1, np.int16)
    out = np.full(length, -1, np.int32)
    for a in range(0, length, STRETCH):
        b = min(length, a + STRETCH)
        low = max(0, a - reach + 1)
        prefix = prefix_hash(point_codes(points[low:b]))
        end, size, place = [], [], []
        for n in range(1, min(reach, b) + 1):
            start = np.arange(max(low, a - n + 1), b - n + 1)
            key = span_hash(prefix, start - low, start - low + n)
            at = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            hit = pieces.keys[at] == key
            end.append(start[hit] + n)
            size.append(np.full(int(hit.sum()), n))
            place.append(at[hit])
        ends, sizes, places = (np.concatenate(x) for x in (end, size, place))
        order = np.argsort(ends, kind="stable")  # sizes ascend for each end
        first = np.searchsorted(ends[order], np.arange(a + 1, b + 2)).tolist()
        sizes, scores, ids = sizes[order].tolist(), pieces.scores[places[order]].tolist(), pieces.ids[places[order]].tolist()
        spelled = (utf8_length(points[a:b]) * pieces.byte_score).tolist()
        for e in range(a + 1, b + 1):
            i, j = first[e - a - 1], first[e - a]
            value, n, which = best[e - 1] + spelled[e - a - 1], 1, -1
            if i < j and sizes[i] == 1:  # a piece of its own in place of bytes
                value, which = best[e - 1] + scores[i], ids[i]
                i += 1
            for k in range(i, j):
                other = best[e - sizes[k]] + scores[k]
                if other > value:
                    value, n, which = other, sizes[k], ids[k]
            best[e], back[e], out[e - 1] = value, n, which
    ends = np.zeros(length + 1, bool)
    e = length
    steps = back.tolist()
    while e:
        ends[e] = True
        e -= steps[e]
    return np.where(ends[1:], out, -2)


def encode_chunks(points: np.ndarray, start: np.ndarray, size: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks one after another, and how many each has."""
    order = np.argsort(size, kind="stable")
    counts = np.zeros(len(size), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    i = 0
    while i < len(order):
        length = int(size[order[i]])
        most = max(1, GROUP_CELLS // (length * min(length, pieces.longest) + 1))
        j = min(int(np.searchsorted(size[order], length, "right")), i + most)
        rows = order[i:j]
        chunk = points[start[rows][:, None] + np.arange(length)[None]]
        ids = viterbi(chunk, pieces)[0] if length <= LONG_CHUNK else np.stack([one_path(c, pieces) for c in chunk])
        ends = ids != -2
        flat, at = ids[ends], chunk[ends]
        spelled = flat == -1
        width = np.where(spelled, utf8_length(at), 1)
        out = np.repeat(flat, width)
        if spelled.any():
            raw = np.frombuffer("".join(chr(SPACE_MARK) if p == FOREIGN_MARK else chr(p) for p in at[spelled].tolist()).encode("utf-8", "surrogatepass"), np.uint8)
            out[np.repeat(spelled, width)] = pieces.byte_ids[raw]
        per_row = ends.sum(1)
        counts[rows] = sums(width, np.concatenate([[0], np.cumsum(per_row)]))
        found.append((rows, out))
        i = j
    first = np.cumsum(counts) - counts
    flat = np.zeros(int(counts.sum()), np.int32)
    for rows, out in found:
        flat[ragged(first[rows], counts[rows])] = out
    return flat, counts


def encode_block(data: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a block one after another, and how many each has."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = lead[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    points[points == SPACE_MARK] = FOREIGN_MARK
    points[points == 32] = SPACE_MARK
    full = np.diff(bounds) > 0
    points = np.insert(points, bounds[:-1][full], SPACE_MARK)
    bounds = bounds + np.concatenate([[0], np.cumsum(full)])
    mark, line = points == SPACE_MARK, points == 10
    starts = np.zeros(len(points), bool)
    starts[bounds[:-1][full]] = True
    starts[1:] |= (mark[1:] & ~mark[:-1]) | line[1:] | line[:-1]
    start = np.flatnonzero(starts)
    end = np.append(start[1:], len(points))
    keys = span_hash(prefix_hash(point_codes(points)), start, end)
    new = pieces.cache.missing(keys)
    if len(new):
        pieces.cache.add(keys[new], *encode_chunks(points, start[new], (end - start)[new], pieces))
    ids, size = pieces.cache.get(keys)
    return ids, sums(size, np.searchsorted(start, bounds, "left"))


def decode_block(ids: np.ndarray, counts: np.ndarray, pieces: Pieces) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of all documents, and the bounds of each; the space put before a text is taken off."""
    size = pieces.size[ids]
    data = pieces.flat[ragged(pieces.at[ids], size)]
    bounds = np.concatenate([[0], np.cumsum(sums(size, np.concatenate([[0], np.cumsum(counts)])))])
    full = np.diff(bounds) > 0
    keep = np.ones(len(data), bool)
    keep[bounds[:-1][full]] = False
    return data[keep].tobytes(), bounds - np.concatenate([[0], np.cumsum(full)])


def list_column(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text and the ids of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1), BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 1)), list_column(*encode_block(data, offsets, pieces))], ["doc_id", "text", "ids"])

    return documents(docs).mapInArrow(run, ENCODED)


def ids_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows of `encode` with the text decoded from the ids in the place of the original, as `decoded`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in batches:
            if batch.num_rows:
                raw, bounds = decode_block(*ids_of(batch.column(1)), pieces)
                decoded = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(raw))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), decoded], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trips(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, n_chars of the decoded text, and whether that is the original: `encode` and `decode`
    in one pass, so that neither texts nor ids move between workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1), BLOCK_BYTES):
                ids, counts = encode_block(data, offsets, pieces)
                raw, bounds = decode_block(ids, counts, pieces)
                text = memoryview(data.tobytes())
                same = [raw[a:b] == text[c:d] for a, b, c, d in zip(*(x.tolist() for x in (bounds[:-1], bounds[1:], offsets[:-1], offsets[1:])), strict=True)]
                wire, at = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(counts)]).tolist()
                crc = [zlib.crc32(wire[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(lead[bounds[1:]] - lead[bounds[:-1]], pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "n_chars", "round_trip"])

    return documents(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_chars long, round_trip boolean")


def with_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """The documents with all their columns and `piece_ids`, the ids of their text, and `round_trip`, whether decoding
    gives the text back. Columns of those two names, if any, are replaced."""
    kept = docs.drop("piece_ids", "round_trip")
    place = kept.columns.index("text")
    schema = StructType([*kept.schema.fields, StructField("piece_ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(place), BLOCK_BYTES):
                ids, counts = encode_block(data, offsets, pieces)
                raw, bounds = decode_block(ids, counts, pieces)
                text = memoryview(data.tobytes())
                same = [raw[a:b] == text[c:d] for a, b, c, d in zip(*(x.tolist() for x in (bounds[:-1], bounds[1:], offsets[:-1], offsets[1:])), strict=True)]
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rows.columns, list_column(ids, counts), pa.array(same)], [*rows.schema.names, "piece_ids", "round_trip"])

    return kept.mapInArrow(run, schema)
