"""Quality of documents from a linear-chain conditional random field over their lines: each line is good or bad, judged by
its own features, those of the lines before and after it, and its neighbours' labels. A document's score is the mean of its
lines' marginals of "good" (forward-backward), weighted by their words.

Training takes documents with a quality label outside the held-out third (`held_out`): at most `rows` of them (SAMPLE_ROWS), half of each
label, by hash of doc_id, cut into stretches of STRETCH lines, of which at most `stretches` (SAMPLE_STRETCHES) a label, by hash, reach the
driver; both bounds are parameters. A good and a bad stretch, in turn the one and the other first, make a chain, so that the transitions see changes of label.
Weights of lines and transitions follow the gradient of the exact conditional likelihood; two numbers then turn the mean
marginal's log odds into the score's. Every line of every document is scored.

Cases: null or empty text, or one without words, has no lines and gets the share of good documents among the training labels (0.5
without labels); a row without doc_id is scored like any other and belongs to the fold of the empty string; repeated
rows are scored alike; of several labels of one doc_id the greatest counts, and of several texts of a sampled doc_id the least in
order; a score of exactly 0.5 predicts 1; an empty table gives no rows; without labels of both kinds the built-in weights stay;
texts are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import blocks
from .line_crf import N_FEATURES, PRIOR, PRIOR_STAY, measure
from .tables import documents

SAMPLE_ROWS, SAMPLE_STRETCHES = 4000, 3000
#: Lines of a training stretch.
STRETCH = 64
FOLDS, HELD_OUT = 3, 1
ROUNDS, RATE, DECAY = 200, 0.3, 1e-3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_lines long"


@dataclass
class Model:
    """weights: N_FEATURES by 3, of a line's own features, those of the line before and of the line after; stay: from label, to label;
    share: of good documents; slope, shift: from the mean marginal's log odds to the score's."""

    weights: np.ndarray = field(default_factory=lambda: np.column_stack([PRIOR, np.zeros(N_FEATURES), np.zeros(N_FEATURES)]))
    stay: np.ndarray = field(default_factory=lambda: np.diag([PRIOR_STAY, PRIOR_STAY]))
    share: float = 0.5
    slope: float = 1.0
    shift: float = 0.0

    def score(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * log_odds(mean) + self.shift)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


class Chains:
    """Where the chains lie in an array of steps, longest first, so that all advance together."""

    def __init__(self, first: np.ndarray) -> None:
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        n = int((length > 0).sum())
        self.starts, self.length = first[:-1][order][:n], length[order][:n]
        self.alive = np.searchsorted(-self.length, -np.arange(int(self.length[0]) if n else 0), "left")
        self.begin = np.zeros(int(first[-1]), bool)
        self.begin[self.starts] = True
        self.end = np.zeros(int(first[-1]), bool)
        self.end[self.starts + self.length - 1] = True

    def before(self, v: np.ndarray) -> np.ndarray:
        """For each step what v has for the one before, 0 at a chain's begin."""
        out = np.zeros_like(v)
        out[1:] = v[:-1]
        out[self.begin] = 0
        return out

    def after(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        out[:-1] = v[1:]
        out[self.end] = 0
        return out

    def emissions(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        own = x @ weights
        return own[:, 0] + self.before(own[:, 1]) + self.after(own[:, 2])

    def marginals(self, emit: np.ndarray, stay: np.ndarray, pair_weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probability of label 1 at each step, by forward-backward in log space; the expected transitions, weighted by `pair_weight` of
        their second step."""
        score = np.zeros((len(emit), 2))
        score[:, 1] = emit
        forward, backward, expected = np.zeros_like(score), np.zeros_like(score), np.zeros((2, 2))
        if not len(self.starts):
            return np.zeros(len(emit)), expected
        forward[self.starts] = score[self.starts]
        for t in range(1, len(self.alive)):
            at = self.starts[: self.alive[t]] + t
            forward[at] = np.logaddexp(forward[at - 1, :1] + stay[0], forward[at - 1, 1:] + stay[1]) + score[at]
        last = forward[self.starts + self.length - 1]
        total = np.logaddexp(last[:, 0], last[:, 1])
        for t in range(len(self.alive) - 1, 0, -1):
            n = self.alive[t]
            at = self.starts[:n] + t
            ahead = score[at] + backward[at]
            if pair_weight is not None:
                joint = np.exp(forward[at - 1][:, :, None] + stay[None] + ahead[:, None, :] - total[:n, None, None])
                expected += (joint * pair_weight[at, None, None]).sum(0)
            backward[at - 1] = np.logaddexp(ahead[:, :1] + stay[:, 0], ahead[:, 1:] + stay[:, 1])
        both = forward + backward
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), expected


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def train(stretches: list[tuple[int, np.ndarray, np.ndarray]], share: float = 0.5, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> Model:
    """stretches: (label, features of the lines, their weights), each label counting half; share: of good documents."""
    model = Model(share=share)
    by_label = {y: [(x, w) for label, x, w in stretches if label == y and len(x)] for y in (0, 1)}
    if not all(by_label.values()):
        return model
    total = {y: sum(w.sum() for _, w in part) for y, part in by_label.items()}
    xs, ys, ws, lengths = [], [], [], []
    for k in range(max(map(len, by_label.values()))):
        length = 0
        for y in (0, 1) if k % 2 else (1, 0):
            if k < len(by_label[y]):
                x, w = by_label[y][k]
                xs.append(x)
                ys.append(np.full(len(x), y))
                ws.append(w * (0.5 / total[y]))
                length += len(x)
        lengths.append(length)
    x, y, w = np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)
    chain = Chains(np.concatenate([[0], np.cumsum(lengths)]))
    pair = np.flatnonzero(~chain.begin)
    w_pair = np.zeros(len(x))
    w_pair[pair] = (w[pair] + w[pair - 1]) / 2
    target = np.zeros((2, 2))
    np.add.at(target, (y[pair - 1], y[pair]), w_pair[pair])
    prior, speed_w, speed_s = model.weights.copy(), np.zeros_like(model.weights), np.zeros((2, 2))
    for _ in range(rounds):
        p, expected = chain.marginals(chain.emissions(x, model.weights), model.stay, w_pair)
        off = w * (y - p)
        slope = x.T @ np.column_stack([off, chain.after(off), chain.before(off)])
        speed_w = 0.9 * speed_w + slope - decay * (model.weights - prior)
        speed_s = 0.9 * speed_s + target - expected - decay * model.stay
        model.weights, model.stay = model.weights + rate * speed_w, model.stay + rate * speed_s
    return calibrated(model, by_label, share)


def calibrated(model: Model, by_label: dict[int, list[tuple[np.ndarray, np.ndarray]]], share: float, rounds: int = 50, decay: float = 1e-4) -> Model:
    """The model with slope and shift from logistic regression of the labels on the stretches' mean marginals (Newton's method), each
    label counting as often as it is among the documents, since the field was trained on as much of the one as of the other."""
    z, y, c = [], [], []
    for label, part in by_label.items():
        chain = Chains(np.cumsum([0, *(len(x) for x, _ in part)]))
        p, _ = chain.marginals(chain.emissions(np.concatenate([x for x, _ in part]), model.weights), model.stay)
        w = np.concatenate([w for _, w in part])
        at = np.cumsum([0, *(len(x) for x, _ in part)])[:-1]
        size = np.add.reduceat(w, at)
        z.append(log_odds(np.add.reduceat(p * w, at) / size))
        y.append(np.full(len(part), label))
        c.append(size * ((share if label else 1 - share) / size.sum()))
    x, y, c = np.column_stack([np.concatenate(z), np.ones(sum(map(len, z)))]), np.concatenate(y), np.concatenate(c)
    at = start = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (c * (y - p)) - decay * (at - start)
        at = at + np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + decay * np.eye(2), slope)
    model.slope, model.shift = at.tolist()
    return model


def fit(docs: DataFrame, labels: DataFrame | None, rows: int = SAMPLE_ROWS, stretches: int = SAMPLE_STRETCHES) -> Model:
    """A model from labels outside the held-out fold; without any, the built-in one."""
    if labels is None:
        return Model()
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    marked = marked.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = marked.agg(F.avg("quality").alias("share")).first().share
    order = F.xxhash64("doc_id")
    halves = [marked.where(F.col("quality") == q).orderBy(order, "doc_id").limit(rows // 2) for q in (0, 1)]
    found = documents(docs).join(F.broadcast(halves[0].unionByName(halves[1])), "doc_id")  # at most `rows` rows
    texts = found.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # a doc_id may have any number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "quality", "part", "x", "w"]
        for batch in batches:
            for i, _, data, offsets in blocks(batch.column(2), 1):
                _, x, count, _ = measure(data, offsets)
                x, w = x.astype(np.float32), (count / max(1, count.sum())).astype(np.float32)
                for k in range(0, len(x), STRETCH):
                    piece = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([k // STRETCH]), *(pa.array([v[k : k + STRETCH].tobytes()], pa.binary()) for v in (x, w))]
                    yield pa.RecordBatch.from_arrays(piece, names)

    parts = texts.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, part long, x binary, w binary")
    taken = [parts.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", "part"), "doc_id", "part").limit(stretches) for q in (0, 1)]
    sample = taken[0].unionByName(taken[1]).collect()  # at most 2 * stretches * STRETCH lines
    read = [(r.quality, np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES).astype(float), np.frombuffer(r.w, np.float32).astype(float)) for r in sample]
    return train(read, 0.5 if share is None else share)


def line_marginals(column: pa.Array, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(probability of good by line, words by line, first line of each document) of each block of texts."""
    for _, _, data, offsets in blocks(column):
        _, x, count, first = measure(data, offsets)
        chain = Chains(first)
        p, _ = chain.marginals(chain.emissions(x, model.weights), model.stay)
        yield p, count, first


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row of SCHEMA a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found, lines = [], []
            for p, count, first in line_marginals(batch.column(2), model):
                full = np.flatnonzero(np.diff(first))  # documents with lines; their sums don't depend on the block they lie in
                mean = np.zeros(len(first) - 1)
                mean[full] = np.add.reduceat(p * count, first[full]) / np.add.reduceat(count, first[full]) if len(full) else 0
                found.append(np.where(np.diff(first) > 0, model.score(mean), model.share))
                lines.append(np.diff(first))
            s = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(np.concatenate(lines).astype(np.int64))],
                ["doc_id", "held_out", "score", "predicted", "n_lines"],
            )

    return documents(docs).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)
