"""Line labelling with a linear-chain conditional random field: Viterbi decoding marks each line content or
boilerplate, and the share of words in content lines decides whether a document stays.

Training takes documents with a quality label: lines of good documents count as content and lines of bad ones as
boilerplate. Stretches of good and of bad documents are joined into chains of mixed labels, so that the transition weights
see changes of label, and gradient ascent on the exact conditional likelihood (forward-backward in log space) fits
emission and transition weights. Labels reach it from a sample of at most `rows` labelled documents (SAMPLE_ROWS), taken by
hash of doc_id, with all their lines; the decision itself sees every line of every document.

Cases: null or empty text has no words, fails the base rule and goes; a row without doc_id is judged like any other; repeated
rows are judged alike; of several labels of one doc_id the greatest counts, and of several texts of a sampled doc_id the least
in order; on the best paths a tie goes to boilerplate; an empty table gives an empty result; a table without labels leaves the
built-in prior weights; texts are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_CODE, blocks, gram_hash, covered, mix, owners, prefix_hash, repeated, runs, span_hash, sums, words
from .tables import documents

SAMPLE_ROWS = 3000
#: A line longer than this many words is read as several steps of the chain.
STEP_WORDS = 60
#: Training cuts longer chains into stretches of this many steps; all of them take part.
STRETCH = 300
LEAST_CONTENT = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words
N_FEATURES = 12
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
NOISE = np.zeros(256, bool)
NOISE[[ord(c) for c in "!?=_~^"]] = True
#: Before training: symbols, capitals, noise and repetition speak for boilerplate.
PRIOR = np.array([1.5, -6.0, -3.0, -3.0, -5.0, -4.0, -2.0, -1.0, -1.0, 0.2, 0.0, -2.0])
PRIOR_STAY = 0.8


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts of each document; the chain: features of each step, its words, and the first step of each document."""
    n_docs = len(offsets) - 1
    start, end, first = words(data, offsets)
    n_words = np.diff(first)
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    word_chars = sums(chars[end] - chars[start], first)
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    doc = owners(first)
    h = span_hash(prefix_hash(BYTE_CODE[data]), start, end)

    # words in 3-word windows that occur twice or more in their document
    window = gram_hash(prefix_hash(h), 3)
    place = np.flatnonzero(doc[2:] == doc[: len(doc) - 2]) if len(doc) > 2 else np.zeros(0, np.int64)
    again = repeated(mix(window[place] + doc[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) if len(place) else np.zeros(0, bool)
    in_repeat = covered(place[again], 3, len(h))

    # lines with a word that equal an earlier one
    l_start, l_end = lines(data, offsets)
    l_doc = np.searchsorted(offsets, l_start, "right") - 1
    l_first = np.searchsorted(start, l_start, "left")
    l_last = np.searchsorted(start, l_end, "left")
    has = l_last > l_first
    l_start, l_end, l_doc, l_first, l_last = l_start[has], l_end[has], l_doc[has], l_first[has], l_last[has]
    l_hash = mix(span_hash(prefix_hash(BYTE_CODE[data]), l_start, l_end) + l_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(l_hash, kind="stable")
    dup = np.zeros(len(l_hash), bool)
    dup[order[1:]] = l_hash[order[1:]] == l_hash[order[:-1]]

    base = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]], "n_dup_lines": np.bincount(l_doc[dup], minlength=n_docs), "n_repeat_words": sums(in_repeat, first)}

    # steps of the chain: lines, long ones in pieces of STEP_WORDS words
    pieces = np.maximum(1, -(-(l_last - l_first) // STEP_WORDS))
    line = np.repeat(np.arange(len(l_first)), pieces)
    within = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    s_first = l_first[line] + within * STEP_WORDS
    s_last = np.minimum(s_first + STEP_WORDS, l_last[line])
    b0, b1 = (start[s_first], end[s_last - 1]) if len(line) else (s_first, s_last)
    size = np.maximum(1, b1 - b0)
    count = s_last - s_first

    def share(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return (c[b1] - c[b0]) / size

    def word_share(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return (c[s_last] - c[s_first]) / np.maximum(1, count)

    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    marked = SYMBOL[data[end - 1]] | NOISE[data[end - 1]] if len(end) else np.zeros(0, bool)
    x = np.column_stack([
        np.ones(len(line)), share(SYMBOL[data]), share(UPPER[data]), share(NOISE[data]), word_share(same), word_share(in_repeat),
        word_share(marked), share(DIGIT[data]), dup[line].astype(float), np.minimum(count, STEP_WORDS) / STEP_WORDS,
        (chars[b1] - chars[b0]) / np.maximum(1, count) / 10.0, word_share((end - start) > 30),
    ])
    x *= (np.minimum(count, STEP_WORDS) / STEP_WORDS)[:, None]  # a short line says little
    return base, x, count, np.searchsorted(l_doc[line], np.arange(n_docs + 1), "left")


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the non-empty \\n-split lines."""
    return runs(data != 10, offsets)


def viterbi(x: np.ndarray, first: np.ndarray, weights: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """Whether each step is content (1) on the best path; chains of all documents advance together, longest first."""
    emit = x @ weights
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    starts, length = first[:-1][order], length[order]
    alive = int((length > 0).sum())
    out = np.zeros(len(x), bool)
    if not alive:
        return out
    back = np.zeros((len(x), 2), np.int8)
    score = np.zeros((alive, 2))
    score[:, 1] = emit[starts[:alive]]
    last = np.zeros(len(length), np.int64)
    for t in range(1, int(length[0])):
        done = alive
        alive = int(np.searchsorted(-length, -t, "left"))  # chains with more than t steps
        last[alive:done] = score[alive:done].argmax(1)
        score = score[:alive]
        at = starts[:alive] + t
        via = score[:, :, None] + stay[None]  # from, to
        back[at] = via.argmax(1)
        score = via.max(1)
        score[:, 1] += emit[at]
    last[:alive] = score.argmax(1)
    live = int((length > 0).sum())
    state = last[:live].copy()
    for t in range(int(length[0]) - 1, -1, -1):
        n = int(np.searchsorted(-length, -t, "left"))
        at = starts[:n] + t
        out[at] = state[:n] == 1
        if t:
            state[:n] = back[at, state[:n]]
    return out


def stretches(documents: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, labels, weights of the steps) of the training chains. Every document is cut into stretches of at most
    STRETCH steps; a stretch of a good document and one of a bad one make a chain as long as there are both, in turn the one
    and the other first. Each document counts once and each class half, however long its texts are."""
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}
    count = {k: sum(1 for x, y in documents if y == k and len(x)) for k in (0, 1)}
    for x, y in documents:
        for i in range(0, len(x), STRETCH):
            part = x[i : i + STRETCH]
            parts[y].append((part, np.full(len(part), 0.5 / count[y] / len(x))))
    out = []
    for k in range(max(len(parts[0]), len(parts[1]))):
        turn = [(parts[y][k], y) for y in ((0, 1) if k % 2 else (1, 0)) if k < len(parts[y])]
        out.append((np.concatenate([x for (x, _), _ in turn]), np.concatenate([np.full(len(x), y) for (x, _), y in turn]), np.concatenate([w for (_, w), _ in turn])))
    return out


def train(documents: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of content against boilerplate, and the 2 by 2 transition scores (from, to), by gradient ascent on the
    conditional likelihood of the label sequences of `stretches`. documents: features of the steps, and the label."""
    weights, stay = PRIOR.copy(), np.diag([PRIOR_STAY, PRIOR_STAY])
    documents = [(x, y) for x, y in documents if len(x)]
    if len({y for _, y in documents}) < 2:
        return weights, stay
    chains = sorted(stretches(documents), key=lambda c: -len(c[0]))
    length = np.array([len(x) for x, _, _ in chains])
    x, y, w_step = (np.concatenate([c[k] for c in chains]) for k in range(3))
    starts = np.cumsum(length) - length
    pair = np.flatnonzero(np.diff(np.repeat(np.arange(len(length)), length)) == 0)  # steps with a next one in their chain
    w_pair = np.zeros(len(x))
    w_pair[pair + 1] = (w_step[pair] + w_step[pair + 1]) / 2
    velocity_w, velocity_s = np.zeros_like(weights), np.zeros_like(stay)
    target_w = (w_step * y) @ x
    target_s = np.zeros((2, 2))
    np.add.at(target_s, (y[pair], y[pair + 1]), w_pair[pair + 1])
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]))]
    for _ in range(rounds):
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ weights
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[starts] = emit[starts]
        for t in range(1, len(alive)):
            at = starts[: alive[t]] + t
            forward[at] = np.logaddexp.reduce(forward[at - 1][:, :, None] + stay[None], axis=1) + emit[at]
        expect_s = np.zeros((2, 2))
        total = np.logaddexp.reduce(forward[starts + length - 1], axis=1)
        for t in range(len(alive) - 1, 0, -1):
            at = starts[: alive[t]] + t
            ahead = emit[at] + backward[at]
            joint = forward[at - 1][:, :, None] + stay[None] + ahead[:, None, :] - total[: alive[t], None, None]
            expect_s += (np.exp(joint) * w_pair[at, None, None]).sum(0)
            backward[at - 1] = np.logaddexp.reduce(stay[None] + ahead[:, None, :], axis=2)
        marginal = np.exp(forward[:, 1] + backward[:, 1] - np.repeat(total, length))
        velocity_w = 0.9 * velocity_w + target_w - (w_step * marginal) @ x - decay * (weights - PRIOR)
        velocity_s = 0.9 * velocity_s + target_s - expect_s - decay * stay
        weights, stay = weights + rate * velocity_w, stay + rate * velocity_s
    return weights, stay


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[np.ndarray, int]]:
    """Features of at most `rows` labelled documents, half of each label, the first by hash of doc_id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id")
    half = [marked.where(F.col("quality") == q).orderBy(order, "doc_id").limit(rows // 2) for q in (0, 1)]
    chosen = half[0].unionByName(half[1])
    found = documents(docs).join(F.broadcast(chosen), "doc_id")  # `chosen` has at most `rows` rows
    texts = found.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # a doc_id may have any number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in blocks(batch.column(1), 1):
                x = measure(data, offsets)[1].astype(np.float32)
                if len(x):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([x.tobytes()], pa.binary())], ["doc_id", "quality", "x"])

    sample = sorted(texts.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x binary").collect())
    return [(np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES).astype(float), r.quality) for r in sample]


def fit(docs: DataFrame, labels: DataFrame | None, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    return train(training_sample(docs, labels, rows) if labels is not None else [])


def judge(column: pa.Array, model: tuple[np.ndarray, np.ndarray], least: float = LEAST_CONTENT) -> dict[str, np.ndarray]:
    """The columns of SCHEMA but doc_id, for a column of texts."""
    out: dict[str, list[np.ndarray]] = {}
    for _, _, data, offsets in blocks(column):
        base, x, count, first = measure(data, offsets)
        content = viterbi(x, first, *model)
        n = base["n_words"]
        share = sums(count * content, first) / np.maximum(1, n)
        failed = (n < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * n)
        for k, v in (base | {"base_failed": failed, "kept": ~failed & (share >= least), "content_share": share}).items():
            out.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def score_lines(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: float = LEAST_CONTENT) -> DataFrame:
    """One row a document: base counts, the share of its words in content lines, and whether it is kept."""
    names = [f.split()[0] for f in SCHEMA.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = judge(batch.column(1), model, least)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k] if found[k].dtype in (bool, float) else found[k].astype(np.int64)) for k in names)], ["doc_id", *names])

    return documents(docs).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: float = LEAST_CONTENT) -> DataFrame:
    """The documents that are kept, with all their columns."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judge(batch.column(place), model, least)["kept"]))

    return docs.mapInArrow(run, docs.schema)
