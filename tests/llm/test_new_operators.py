"""Conversation repair, line-wise quality and whitening against brute force, enumeration, numpy and held-out labels."""

import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderflow.llm import conversation_repair, oracles, quality_crf, queries, whitening
from cinderflow.llm.line_crf import N_FEATURES

from . import brute

DATA = "/root/testdata/sf0.001"


def same_repairs(got, rows, ids):
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r[1:])
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((c, *brute.repaired(by_conv.get(c, [])))) for c in ids)


def odd_conversations():
    """Null, empty and repeated values, ties, roles outside the grammar; one conversation much longer than a piece; one row repeated often."""
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "", "u", "admin"]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.choice(roles[:2] if rng.random() < 0.7 else roles), rng.choice([None, "", " \n", "a.", "b", "Hello!", "x \x0b", "é.", "long " * 3000])) for _ in range(900)]
    rows += [(100, rng.choice([None, *range(700)]), rng.choice(roles[:3]), rng.choice(["hi.", "yo", *(f"t{k}." for k in range(300))])) for _ in range(2500)]
    return rows + [(101, 5, "user", "same.")] * 3000


@pytest.mark.parametrize("piece_rows", [7, conversation_repair.PIECE_ROWS])
def test_repair(spark, piece_rows):
    rows = odd_conversations()
    frame = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn int, role string, text string, cost int")
    ids = {r[0] for r in rows} | {777}
    every = frame.select("conv_id").unionByName(spark.createDataFrame([(777,)], "conv_id long"))
    same_repairs(conversation_repair.repair(frame, every, piece_rows).collect(), rows, ids)
    assert conversation_repair.repair(frame.limit(0), None, piece_rows).count() == 0


def test_repair_query_and_its_sql(spark):
    frame = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_conversation_repair"](spark, DATA).collect()
    same_repairs(got, brute.damaged(rows), {r[0] for r in rows})
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(oracles.ORACLES["op11_conversation_repair"]).fetchall())
    odd = [r for r in odd_conversations() if r[0] is None or r[0] < 60]
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", odd)
    assert sorted(map(repr, db.execute(oracles.ORACLES["op11_conversation_repair"]).fetchall())) == sorted(repr((c, *brute.repaired([r[1:] for r in brute.damaged(odd) if r[0] == c]))) for c in {r[0] for r in odd})


def test_repaired_turns_follow_the_grammar(spark):
    rows = odd_conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    digest = {r.conv_id: r.repaired_sha256 for r in conversation_repair.repair(frame).collect()}
    turns = {}
    for r in conversation_repair.repaired_turns(frame, 50).orderBy("part", "seq", "place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: brute.sha("\n".join(turns.get(c, []))) for c in digest} == digest


def test_a_conversation_is_spread_over_tasks(spark):
    frame = spark.range(4000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    pieces = conversation_repair.walk(frame, frame, False, 100)
    assert pieces.where("open").select("part").distinct().count() == 4 and pieces.select(F.max(F.size("rows"))).first()[0] == 100
    (row,) = conversation_repair.repair(frame, None, 100).collect()
    assert row.audit == "K" * 4000 and row.cost == 0


def test_line_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 3, 8, 9])
    emit, stay, pair = rng.normal(size=9), rng.normal(size=(2, 2)), rng.random(9)
    got, expected = quality_crf.Chains(first).marginals(emit, stay, pair)
    wanted = np.zeros((2, 2))
    for a, b in itertools.pairwise(first.tolist()):
        paths = list(itertools.product((0, 1), repeat=b - a))
        weight = np.exp([sum(emit[a + i] * s for i, s in enumerate(p)) + sum(stay[p[i], p[i + 1]] for i in range(len(p) - 1)) for p in paths])
        weight /= weight.sum()
        assert np.allclose(got[a:b], [sum(w for w, p in zip(weight, paths, strict=True) if p[i]) for i in range(b - a)])
        for w, p in zip(weight, paths, strict=True):
            for i in range(len(p) - 1):
                wanted[p[i], p[i + 1]] += w * pair[a + i + 1]
    assert np.allclose(expected, wanted)


def test_neighbouring_lines_count():
    x = np.random.default_rng(2).random((7, N_FEATURES))
    w = np.random.default_rng(3).normal(size=(N_FEATURES, 3))
    got = quality_crf.Chains(np.array([0, 4, 7])).emissions(x, w)
    for a, b in ((0, 4), (4, 7)):
        for i in range(a, b):
            assert np.isclose(got[i], x[i] @ w[:, 0] + (x[i - 1] @ w[:, 1] if i > a else 0) + (x[i + 1] @ w[:, 2] if i < b - 1 else 0))


def test_quality_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = quality_crf.fit(docs, labels)
    rows = [r for r in quality_crf.score(docs, model).join(labels, "doc_id").collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    flipped = labels.withColumn("quality", F.when(quality_crf.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_crf.fit(docs, flipped)  # labels of the fold teach nothing
    assert (again.weights == model.weights).all() and (again.stay == model.stay).all() and (again.slope, again.shift, again.share) == (model.slope, model.shift, model.share)
    twice = quality_crf.fit(docs.unionByName(docs), labels.unionByName(labels))
    assert np.allclose(twice.weights, model.weights)


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a line\nanother"), (5, "x" * 500_000), (6, "word " * 100_000), (7, "l\n" * 50_000), (7, "l\n" * 50_000)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, held_out string")
    marks = spark.createDataFrame([(5, 0, 0), (5, 1, 0), (7, 0, 0), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    for model in (quality_crf.fit(docs, marks), quality_crf.fit(docs, None), quality_crf.fit(docs, marks.limit(0))):
        got = quality_crf.score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert all(r.score == model.share and r.n_lines == 0 for r in got if r.doc_id in (1, 2, 3))
        assert len({(r.score, r.n_lines) for r in got if r.doc_id == 7}) == 1
        assert quality_crf.score(docs.limit(0), model).count() == 0


def whitened_by_numpy(rows):
    """vec_id and x of usable rows; n, covariance, exact deviations."""
    x = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    unique = [list(u) for u in {tuple(v) for _, v in x}]
    n, sums = len(unique), [sum(c) for c in zip(*unique, strict=True)]
    off = np.array(unique) - np.array(sums) / n
    return x, n, sums, off.T @ off / n, [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for _, v in x]


def check_whitening(got, rows, d):
    x, n, sums, v, deviation = whitened_by_numpy(rows)
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(16, d)
    assert len(got) == k * len(x)
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation), []).append(r)
    assert sorted(map(repr, by_row)) == sorted({repr((i, dev)) for (i, _), dev in zip(x, deviation, strict=True)})
    table = {}
    for (i, vec), dev in zip(x, deviation, strict=True):
        mine = by_row[i, dev]
        assert sorted({r.component for r in mine}) == list(range(1, k + 1)) and {r.n for r in mine} == {n}
        for r in mine:
            assert abs(r.explained - values[r.component - 1] / np.trace(v)) <= 1e-4 * r.explained + 1e-12
        table[tuple(vec)] = [next(r.whitened for r in mine if r.component == c + 1) for c in range(k)]
    w = np.array(list(table.values()), float)
    live = ~np.isnan(w).any(0)
    w = w[:, live]
    assert np.abs(w.T @ w / len(w) - np.eye(w.shape[1])).max() < 1e-6 and max(r.identity_error for r in got) < 1e-6
    # each component is an eigenvector: covariance with x is the eigenvector times the root of its eigenvalue
    off = np.array(list(table)) - np.array(sums) / n
    c = off.T @ w / n
    for j in range(c.shape[1]):
        assert np.allclose(v @ c[:, j], values[j] * c[:, j], atol=1e-6 * values[0] * np.abs(c[:, j]).max()) and np.isclose(np.square(c[:, j]).sum(), values[j])


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check_whitening(queries.QUERIES["op13_whitening"](spark, DATA).collect(), rows, 64)


def test_whitening_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(40)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (50, rows[5][1]), (51, None), (52, [0.1, None, 0.2, 0.3, 0.4]), (53, [float("nan")] * 5), (54, [1.0, 2.0, 3.0, 4.0, float("inf")])]
    schema = "vec_id long, embedding array<double>, x double, n int"
    run = lambda data: whitening.whiten(v := whitening.whole_vectors(spark.createDataFrame([(*r, 0.5, 7) for r in data], schema)), whitening.fit(v)).collect()
    check_whitening(run(rows), rows, 5)
    check_whitening([r for r in run([*rows, (60, [1.0, 2.0]), (61, []), (62, [1e300] * 5)]) if r.vec_id not in (60, 61, 62)], rows, 5)
    flat = [(k, [*v[:4], v[0]]) for k, v in rows[:40]]  # the last dimension repeats the first
    got = run(flat)
    assert {r.component for r in got if r.whitened is None} == {5} and len(got) == 200 and max(r.identity_error for r in got) < 1e-6
    one = run([(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert [(r.whitened, r.explained, r.identity_error, r.deviation, r.n) for r in one] == [(None, 0.0, None, 0, 1)] * 4
    assert run([]) == [] and run([(1, None)]) == []


def test_deviations_are_exact_or_null():
    x = np.array([[3, -5], [10**12, 7]])
    n, sums = 10**6 + 1, np.array([10**17 + 3, -8], object)
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, n, sums) == [v if v < 2**63 else None for v in exact] and exact[0] >= 2**63
    assert whitening.deviations(x[:1], 2, np.array([4, 4], object)) == [4 + 196]
