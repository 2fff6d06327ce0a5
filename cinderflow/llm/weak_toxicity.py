"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier on its posteriors.

Voters are lexicons and patterns: a fixed lexicon for each language, lexicons of words and of word beginnings that training
labels single out (by kind and by log odds), and patterns of direct address, shouting, marks and masked letters. The label
model sees votes alone, no label: its latent class is toxic or clean, each voter has a rate of hits in either, given the vote of
one other voter, the one it is correlated with most (a maximum spanning tree by mutual information within the classes). All
this is estimated by expectation maximisation from labelled and unlabelled documents alike. A logistic regression on the
posteriors then scores every document from the features of its own text. Labels pick the mined lexicons, give the
share of toxic documents, and choose between the label model with correlations, the one without, and the plain count of votes;
they are in no posterior.

Training reads at most `rows` documents (SAMPLE_ROWS) and at most as many labelled ones, with crc32(doc_id) mod 5 other than 0, the
first by hash of doc_id, whole texts; the mined lexicons have at most MOST_FEATURES entries, those of the greatest log odds times the
root of their toxic documents. Scores are given for every document. labels, lang, source and doc_id are never inputs of a score.

Cases: null or empty text has the score of a text without features; repeated rows score alike; of several labels of one doc_id
the greatest counts, and of several texts of a sampled doc_id the least in order; rows without doc_id take no part in training; a
score of 0.5 is predicted toxic; an empty table gives an empty result; without usable labels only the fixed lexicons speak;
clashing column names are dropped before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_CODE, LOWER, blocks, mix, prefix_hash, runs, span_hash
from .tables import documents, staged

SAMPLE_ROWS = 12_000
FOLDS = 5
#: Bytes of a word's beginning that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
KINDS = len(BEGINNINGS) + 1
TIERS = (4.0, 5.0)  # log odds that part the mined features of a kind into voters
MOST_FEATURES = 1500
LEAST_TOXIC = 3  # documents
LEAST_LOG_ODDS = 2.0  # even at the low end of what the counts leave open, CONFIDENCE standard errors down
CONFIDENCE = 1.0
# A small lexicon of insults in each of the languages of the corpus.
LEXICONS = {
    "en": ("idiot", "stupid", "moron", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "fool", "dumb", "hate"),
    "es": ("idiota", "estupido", "imbecil", "basura", "asqueroso"),
    "de": ("dumm", "trottel", "abschaum", "ekelhaft", "versager"),
    "fr": ("imbecile", "ordure", "minable", "crétin", "abruti"),
}
PATTERNS = ("address", "shouting", "marks", "masked")
FIXED = len(LEXICONS) + len(PATTERNS)
ADDRESS = re.compile(rb"\b(you|du|tu|vous|usted)\s+(are|bist|es|eres|etes)\s+\w+", re.IGNORECASE)
SHOUTED = 3  # words in capitals

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 0 modulo FOLDS; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and kind of each feature of each word: its beginnings and, last, the word itself."""
    data = LOWER[data]
    start, end = runs(_LETTER[data], offsets)
    prefix = prefix_hash(BYTE_CODE[data])
    doc = np.searchsorted(offsets, start, "right") - 1
    keys, docs, kinds = [span_hash(prefix, start, end)], [doc], [np.full(len(start), KINDS - 1, np.int8)]
    for k, n in enumerate(BEGINNINGS):
        long = end - start > n
        keys.append(mix(span_hash(prefix, start[long], start[long] + n) + np.uint64(n)))
        docs.append(doc[long])
        kinds.append(np.full(int(long.sum()), k, np.int8))
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(kinds)


def lexicon_keys() -> list[np.ndarray]:
    """Sorted hashes of the words of each fixed lexicon."""
    out = []
    for words in LEXICONS.values():
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        start, end = runs(data != 32, np.array([0, len(data)]))
        out.append(np.sort(span_hash(prefix_hash(BYTE_CODE[data]), start, end)))
    return out


def member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted table, -1 where it is not."""
    if not len(table):
        return np.full(len(keys), -1)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[place] == keys, place, -1)


def patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document has each of PATTERNS."""
    n = len(offsets) - 1
    out = np.zeros((n, len(PATTERNS)), bool)

    def mark(k: int, at: np.ndarray) -> None:
        out[np.searchsorted(offsets, at, "right") - 1, k] = True

    mark(0, np.array([m.start() for m in ADDRESS.finditer(data.tobytes())], np.int64))
    start, end = runs((data >= 65) & (data <= 90), offsets)
    alone = (end - start >= 4) & ~_LETTER[np.append(data, 32)[end]] & ~np.where(start > 0, _LETTER[data[np.maximum(start - 1, 0)]], False)
    shouted = np.bincount(np.searchsorted(offsets, start[alone], "right") - 1, minlength=n) if alone.any() else np.zeros(n, int)
    out[:, 1] = shouted >= SHOUTED
    if len(data) > 2:
        loud = (data == 33) | (data == 63)
        mark(2, np.flatnonzero(loud[1:] & loud[:-1]))
        mark(3, np.flatnonzero(_LETTER[data[:-2]] & ((data[1:-1] == 42) | (data[1:-1] == 64)) & _LETTER[data[2:]]))
    return out


def presence(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lexicons: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, feature of the table) pairs, and for each document the hits of the fixed voters."""
    keys, docs, kinds = features(data, offsets)
    place = member(keys, table)
    hit = place >= 0
    pair = np.unique(docs[hit] * max(1, len(table)) + place[hit])
    word = kinds == KINDS - 1
    fixed = np.zeros((len(offsets) - 1, len(lexicons)), bool)
    for k, lexicon in enumerate(lexicons):
        fixed[docs[word][member(keys[word], lexicon) >= 0], k] = True
    return pair // max(1, len(table)), pair % max(1, len(table)), np.column_stack([fixed, patterns(data, offsets)])


@dataclass
class LabelModel:
    """Rates of hits of each voter, given the class and the vote of its parent: rate[class, vote of the parent, voter]."""

    prior: float
    parent: np.ndarray  # -1: none
    rate: np.ndarray

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """Probability of toxic for each row of votes."""
        given = np.where(self.parent >= 0, vote[:, np.maximum(self.parent, 0)], False).astype(int)
        logs = [np.log(p) for p in (1 - self.prior, self.prior)]
        voter = np.arange(vote.shape[1])
        for y in (0, 1):
            p = self.rate[y][given, voter]
            logs[y] = logs[y] + np.log(np.where(vote, p, 1 - p)).sum(1)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))


@dataclass
class Model:
    table: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # of the features, then of the fixed voters
    bias: float
    labels: LabelModel | None = None


def outside(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def training_texts(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, toxic (null: no label) of the sampled documents outside the held-out fold."""
    marked = outside(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))).where(F.col("toxic").isin(0, 1))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    plain = outside(documents(docs).select("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = plain.join(marked, "doc_id", "full")  # at most 2 * rows rows of two numbers
    return documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def mine(texts: DataFrame, most: int = MOST_FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, kinds and log odds of at most `most` features that toxic training documents have more often."""

    texts = texts.where("toxic is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(2).to_pylist(), bool)
            for i, _, data, offsets in blocks(batch.column(1)):
                keys, docs, kinds = features(data, offsets)
                label = toxic[i:][docs]
                counts = []
                for y in (False, True):
                    x = np.rec.fromarrays([keys[label == y], docs[label == y]])
                    order = np.argsort(x, order=("f0", "f1"))
                    k, d = x.f0[order], x.f1[order]
                    first = np.ones(len(k), bool)
                    first[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
                    counts.append(np.unique(k[first], return_counts=True))
                unique, example = np.unique(keys, return_index=True)
                n = [np.zeros(len(unique), np.int64) for _ in counts]
                for y, (k, c) in enumerate(counts):
                    n[y][np.searchsorted(unique, k)] = c
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(kinds[example].astype(np.int32)), pa.array(n[0]), pa.array(n[1])], ["key", "kind", "clean", "toxic"])
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int32()), *(pa.array([int((toxic[i : i + len(offsets) - 1] == y).sum())]) for y in (False, True))], ["key", "kind", "clean", "toxic"])

    found = texts.select("doc_id", "text", "toxic").mapInArrow(run, "key long, kind int, clean long, toxic long").groupBy("key", "kind").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = found.where("key is null").first()
    if totals is None or not totals.toxic or not totals.clean:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0)
    odds = F.log((F.col("toxic") + 0.5) / (totals.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (totals.clean + 1.0))
    doubt = CONFIDENCE * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = found.where(f"key is not null and toxic >= {LEAST_TOXIC}").withColumn("odds", odds).where(F.col("odds") - doubt >= LEAST_LOG_ODDS)
    rows = best.orderBy(F.desc(F.col("odds") * F.sqrt(F.col("toxic"))), "key").limit(most).collect()
    keys = np.array([r.key for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r.kind for r in rows], int)[order], np.array([r.odds for r in rows])[order]


def votes(docs: np.ndarray, places: np.ndarray, fixed: np.ndarray, kinds: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """0/1 of each voter: the mined features of each kind by their log odds, the fixed lexicons, the patterns."""
    tiers = len(TIERS) + 1
    voter = kinds * tiers + np.searchsorted(TIERS, odds)
    out = np.zeros((len(fixed), KINDS * tiers + FIXED), bool)
    out[docs, voter[places]] = True
    out[:, -FIXED:] = fixed
    return out


def spanning_tree(worth: np.ndarray) -> np.ndarray:
    """Parent of each node, -1 for the first, in the spanning tree of the greatest total worth."""
    n = len(worth)
    parent, best, to = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1)
    inside = np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        better = ~inside & (worth[at] > best)
        best[better], to[better] = worth[at][better], at
        at = int(np.where(inside, -np.inf, best).argmax())
        parent[at] = to[at]
    return parent


def dependence(v: np.ndarray, weight: list[np.ndarray]) -> np.ndarray:
    """Mutual information of each two voters within the classes; weight: of the rows in each class."""
    out = np.zeros((v.shape[1], v.shape[1]))
    for w in weight:
        total = w.sum() + 1
        one = (w @ v + 0.5) / total
        both = ((v * w[:, None]).T @ v + one[:, None] * one[None]) / total
        for a, b, joint in ((one, one, both), (one, 1 - one, one[:, None] - both), (1 - one, one, one[None] - both), (1 - one, 1 - one, 1 - one[:, None] - one[None] + both)):
            joint = np.maximum(joint, 1e-12)
            out += total * joint * np.log(joint / np.maximum(a[:, None] * b[None], 1e-12))
    np.fill_diagonal(out, -1)
    return out


def label_model(vote: np.ndarray, prior: float | None = None, start: np.ndarray | None = None, rounds: int = 60) -> LabelModel:
    """Expectation maximisation from the votes alone. It begins with the posterior `start`, or else with the number of votes.
    With a start each voter's rates depend on the vote of its neighbour in the tree of dependence, found anew in each round;
    without one voters are independent given the class. prior: the share of toxic documents, estimated too if None."""
    v = vote.astype(float)
    posterior = np.clip(v.sum(1) / 4, 0.02, 0.98) if start is None else start
    n = vote.shape[1]
    model = LabelModel(0.5, np.full(n, -1), np.full((2, 2, n), 0.5))
    for _ in range(rounds):
        weight = [1 - posterior, posterior]
        parent = np.full(n, -1) if start is None else spanning_tree(dependence(v, weight))
        given = np.where(parent >= 0, v[:, np.maximum(parent, 0)], 0.0)
        rate = np.empty((2, 2, n))
        for y, w in enumerate(weight):
            alone = (w @ v + 0.1) / (w.sum() + 1)
            for u, g in ((0, 1 - given), (1, given)):  # a voter's own rate is worth ten rows where its parent's vote is rare
                rate[y, u] = (w @ (g * v) + 10 * alone) / (w @ g + 10)
        model = LabelModel(float(np.clip(posterior.mean() if prior is None else prior, 1e-3, 0.5)), parent, np.clip(rate, 1e-4, 1 - 1e-4))
        new = model.posterior(vote)
        moved = np.abs(new - posterior).max()
        posterior = new
        if moved < 1e-4:
            break
    return model


def chosen_posterior(vote: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, LabelModel | None]:
    """The posterior of the label model that agrees with most labels (-1: none); ties go to the one with correlations, then to
    the one without, last to the count of votes. The share of toxic ones among the labels is the models' prior."""
    share = float(np.mean(gold[gold >= 0]))
    plain = label_model(vote, share)
    tree = label_model(vote, share, plain.posterior(vote))
    candidates: list[tuple[np.ndarray, LabelModel | None]] = [(m.posterior(vote), m) for m in (tree, plain)]
    candidates.append((np.clip(vote.sum(1) / 4, 0.02, 0.98), None))
    score = [np.mean((p[gold >= 0] >= 0.5) == (gold[gold >= 0] == 1)) for p, _ in candidates]
    return candidates[int(np.argmax(score))]


def logistic(docs: np.ndarray, places: np.ndarray, n: int, width: int, target: np.ndarray, rounds: int = 400, rate: float = 1.0, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression of soft targets on 0/1 features, by accelerated gradient descent."""
    weights, bias, speed, pace = np.zeros(width), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))), np.zeros(width), 0.0
    common = np.sqrt(np.bincount(places, minlength=width) / n + 1e-3)  # steps by how often a feature occurs
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(docs, weights[places], minlength=n) + bias, -30, 30)))
        error = p - target
        speed = 0.9 * speed - rate * (np.bincount(places, error[docs], minlength=width) / n + decay * weights) / common
        pace = 0.9 * pace - rate * error.mean()
        weights, bias = weights + speed, bias + pace
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model; all that reaches the driver are counts of at most MOST_FEATURES features and the sample's presence lists."""
    texts = staged(training_texts(docs, labels, rows), "training")
    table, kinds, odds = mine(texts)
    lexicons = lexicon_keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                d, place, fixed = presence(data, offsets, table, lexicons)
                cut = np.searchsorted(d, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(place, pa.int32()))
                hits = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * FIXED, pa.int32()), pa.array(fixed.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), lists, hits], ["doc_id", "toxic", "places", "fixed"])

    found = sorted(texts.mapInArrow(run, "doc_id long, toxic int, places array<int>, fixed array<boolean>").collect(), key=lambda r: r.doc_id)
    gold = np.array([-1 if r.toxic is None else r.toxic for r in found])
    if not {0, 1} <= set(gold.tolist()):
        return Model(table[:0], np.array([4.0] * len(LEXICONS) + [0.5] + [0.0] * (len(PATTERNS) - 1)), -2.0)
    fixed = np.array([r.fixed for r in found])
    doc = np.repeat(np.arange(len(found)), [len(r.places) for r in found])
    place = np.array([p for r in found for p in r.places], int)
    target, labels_of = chosen_posterior(votes(doc, place, fixed, kinds, odds), gold)
    more = [np.flatnonzero(fixed[:, k]) for k in range(FIXED)]
    all_docs = np.concatenate([doc, *more])
    all_places = np.concatenate([place, *(np.full(len(m), len(table) + k) for k, m in enumerate(more))])
    weights, bias = logistic(all_docs, all_places, len(found), len(table) + FIXED, target)
    return Model(table, weights, bias, labels_of)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_features of every document."""
    lexicons = lexicon_keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                d, place, fixed = presence(data, offsets, model.table, lexicons)
                logit = np.bincount(d, model.weights[place], minlength=j - i) + fixed @ model.weights[-FIXED:] + model.bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30)))), pa.array(np.bincount(d, minlength=j - i).astype(np.int64))], ["doc_id", "score", "n_features"])

    found = documents(docs).mapInArrow(run, "doc_id long, score double, n_features long")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_features")
