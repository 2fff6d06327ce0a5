"""Repair of the turn structure of conversations: the cheapest edits that make the roles an optional system turn and then
user and assistant in turn, `(s?(ua)+)?`.

Edits: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn, anywhere) 2; a row that
is kept or reroled although its text is cut off costs 1 more; blank and repeated rows must go. The audit has one letter an edit.

Rows are counted once for all that are equal, then dealt by ranges of (conversation, turn, role, text) and sorted, so that one
conversation may lie on many tasks. A task cuts its rows into pieces of at most PIECE_ROWS rows, hands batches of pieces to a
recursive query of DuckDB in memory, each recursion of which advances all pieces by one row and keeps the least (cost, audit)
of each grammar state, and finishes the conversations that it has whole. Of a conversation at a border, or of more than one piece, the
least (cost, audit) from each state to each state is kept and the pieces are chained, in order, from these tables. That
is exact: after equal rows at equal cost no audit is the beginning of another, so the less one stays less whatever follows.
(The batches are ranges, not hashes of the conversation, since a hash can't part a conversation that holds a third of all rows.)

Cases: null role or text is one space; rows without turn come first; rows of one turn are ordered by role, then text; equal rows all
but the first are repeated rows; a role counts by its first character, an empty one is no legal neighbour of any; rows without
conv_id make one conversation; a conversation without rows has zeros, an empty audit and the empty string's hash; an
empty table gives no rows; texts and conversations may have any length (an audit, being one value, must fit one row); other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import product

import duckdb
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import staged

#: Rows of a piece: what one recursion goes through from end to end.
PIECE_ROWS = 256
#: Pieces of full length, and characters of text, that a task holds before it hands them to DuckDB.
BATCH_PIECES, BATCH_CHARS = 32, 8 << 20
#: Ties of one turn and role are sorted by this many characters of the text and then by its digest.
SORT_CHARS = 64

BLANKS = " \t\n\x0b\x0c\r"
#: The grammar: state and role initial -> state. States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL_NAME = {"u": "user", "a": "assistant"}
NEIGHBOURS = {"su", "ua", "au"}
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [f.split()[0] for f in RESULT.split(", ")]


def chains(state: int) -> list[tuple[int, str]]:
    """(state, inserted initials) after no, one or two inserted turns; more lead to no other state."""
    found = [(state, "")]
    for _ in range(2):
        found += [(GRAMMAR[s, c], made + c) for s, made in found for c in "ua" if (s, c) in GRAMMAR and (GRAMMAR[s, c], made + c) not in found]
    return found


def steps() -> list[tuple[int, str, bool, int, int, str]]:
    """(state, initial or '-', cut off, next state, cost, letters): the cheapest way over one row; '-' rows must go and have their letters apart."""
    best: dict[tuple[int, str, bool, int], tuple[int, str]] = {}

    def offer(key: tuple[int, str, bool, int], cost: int, letters: str) -> None:
        best[key] = min(best.get(key, (99, "")), (cost, letters))

    for state in range(4):
        offer((state, "-", False, state), 0, "")
        for initial, cut in product("suax", (False, True)):
            offer((state, initial, cut, state), 3, "D")
            for middle, made in chains(state):
                for role, cost, letter in ((initial, 0, "K"), ("u", 2, "R"), ("a", 2, "R")):
                    if (middle, role) in GRAMMAR:
                        offer((state, initial, cut, GRAMMAR[middle, role]), cost + 2 * len(made) + cut, "I" * len(made) + letter)
    return [(*key, *way) for key, way in best.items()]


#: Turns to insert at the end so that the grammar accepts.
CLOSING = {s: min(len(made) for t, made in chains(s) if t == 3 or (t == 0 and not made)) for s in range(4)}

WALK = """
WITH RECURSIVE walk AS (
  SELECT g, 0 AS i, s AS origin, s AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM piece JOIN range(4) AS r(s) ON s = 0 OR open
  UNION ALL
  SELECT w.g, w.i + 1, w.origin, s.target,
    min({'cost': w.best.cost + s.cost + t.extra, 'audit': w.best.audit || s.letters || repeat('D', t.gone)})
  FROM walk AS w JOIN turn AS t ON t.g = w.g AND t.i = w.i JOIN step AS s ON s.source = w.state AND s.initial = t.initial AND s.cut = t.cut
  GROUP BY w.g, w.i, w.origin, s.target)
SELECT g, origin, state, best.cost AS cost, best.audit AS audit FROM walk JOIN piece USING (g) WHERE i = size ORDER BY ALL
"""


def cheapest(pieces: list[tuple[bool, list[dict]]]) -> list[dict[tuple[int, int], tuple[int, str]]]:
    """For each piece (open, rows) the least (cost, audit) by (state before, state after); a piece that isn't open begins in state 0."""
    db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    try:
        rows = [(g, i, r["step"], r["cut"], 3 * r["gone"], r["gone"]) for g, (_, part) in enumerate(pieces) for i, r in enumerate(part)]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
        turn = pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["g", "i", "initial", "cut", "extra", "gone"])
        piece = pa.table({"g": list(range(len(pieces))), "open": [o for o, _ in pieces], "size": [len(p) for _, p in pieces]})
        step = pa.table([pa.array(x) for x in zip(*steps(), strict=True)], ["source", "initial", "cut", "target", "cost", "letters"])
        for name, table in (("turn", turn), ("piece", piece), ("step", step)):
            db.register(name, table)
        out: list[dict[tuple[int, int], tuple[int, str]]] = [{} for _ in pieces]
        for g, origin, state, cost, audit in db.execute(WALK).fetchall():
            out[g][origin, state] = (cost, audit)
        return out
    finally:
        db.close()


def closed(found: dict[int, tuple[int, str]]) -> tuple[int, str, int]:
    """The least (cost, audit, state before the closing turns) by state, once the turns that the grammar still wants are inserted."""
    return min((cost + 2 * CLOSING[s], audit + "I" * CLOSING[s], s) for s, (cost, audit) in found.items())


def edited(rows: list[dict], audit: str, state: int = 0) -> Iterator[tuple[str, str]]:
    """Role and text of the turns that an audit leaves of a piece's rows, begun in `state`."""
    place, left = 0, 0
    for letter in audit:
        if letter != "I":
            while not left:
                left = rows[place]["copies"]
                place += 1
            left -= 1
            if letter == "D":
                continue
        row = rows[place - 1]
        initial = row["role"][:1] if letter == "K" else "a" if (state, "a") in GRAMMAR else "u"
        state = GRAMMAR[state, initial]
        yield (row["role"] if letter == "K" else FULL_NAME[initial]), ("" if letter == "I" else row["text"])


def counted(rows: list[dict]) -> dict:
    """Faults, illegal neighbours and turns within a piece, and what its neighbours have to know."""
    blank = sum(r["copies"] for r in rows if r["blank"])
    first = [r for r in rows if not r["blank"] and r["first"]]
    duplicate = sum(r["copies"] for r in rows if not r["blank"]) - len(first)
    illegal, last = 0, None
    for r in rows:
        initial = r["role"][:1]
        illegal += (last is not None and last + initial not in NEIGHBOURS) + (r["copies"] - 1) * (initial * 2 not in NEIGHBOURS)
        last = initial
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return {
        "blank": blank, "duplicate": duplicate, "truncated": sum(r["cut"] for r in first), "illegal": illegal, "head": rows[0]["role"][:1] if rows else None, "tail": last,
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
    }


def joined(a: dict, b: dict) -> dict:
    """What `counted` says of two neighbouring pieces as one."""
    if a["head"] is None or b["head"] is None:
        return b if a["head"] is None else a
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["tail"] + b["head"] not in NEIGHBOURS
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"head": a["head"], "tail": b["tail"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}


def summary(facts: dict, cost: int, audit: str) -> dict:
    gaps = 0 if facts["low"] is None else facts["high"] - facts["low"] + 1 - facts["turns"]
    return {"gaps": gaps, "blank": facts["blank"], "duplicate": facts["duplicate"], "truncated": facts["truncated"], "illegal": facts["illegal"], "cost": cost, "audit": audit}


def written(turns: Iterator[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def sorted_rows(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, behind a marker each where a (role, text) is first seen, sorted within ranges.
    kind: 0 the conversation exists, 1 the next row's role and text are new here, 2 a row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    digest = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), F.substring("text", 1, SORT_CHARS).alias("beginning"))
    # the first turn of each role and text; the flag puts rows without turn first
    new = digest.groupBy("conv_id", "role", "digest", "beginning").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("at"))
    new = new.select("conv_id", F.col("at.turn").alias("turn"), "role", "beginning", "digest", F.lit(1).alias("kind"))
    rows = rows.select("conv_id", "turn", "role", F.substring("text", 1, SORT_CHARS).alias("beginning"), F.md5("text").alias("digest"), F.lit(2).alias("kind"), "text", "copies")
    exists = ids.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"))
    every = rows.unionByName(new, allowMissingColumns=True).unionByName(exists, allowMissingColumns=True)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "beginning"]
    bare = F.rtrim("text", F.lit(BLANKS))
    return (
        every.repartitionByRange(n, *order)
        .sortWithinPartitions(*order, "digest", "kind")
        .select("conv_id", "turn", "role", "kind", "copies", "text", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    )


def walk(turns: DataFrame, ids: DataFrame, texts: bool, piece_rows: int) -> DataFrame:
    """One row a piece: its place (part, seq), whether it is open, what `counted` says, costs and audits by states; for
    conversations that are whole their results, or with `texts` their repaired turns; for open pieces their rows."""
    key = ids.schema["conv_id"].dataType.simpleString()
    row = "struct<turn: bigint, role: string, text: string, copies: bigint, gone: bigint, blank: boolean, first: boolean, cut: boolean>"
    schema = f"conv_id {key}, part int, seq int, open boolean, facts string, paths array<struct<origin: int, state: int, cost: bigint, audit: string>>, rows array<{row}>, {RESULT}, turns array<struct<role: string, text: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[object, bool, list[dict]]] = []  # conversation, open, rows
        rows_held = chars = 0
        target = None

        def results() -> pa.RecordBatch:
            nonlocal seq, held, rows_held, chars
            out = []
            for (conv, open_, rows), found in zip(held, cheapest([(o, r) for _, o, r in held]), strict=True):
                facts = counted(rows)
                record = {"conv_id": conv, "part": part, "seq": seq, "open": open_}
                seq += 1
                if open_:
                    paths = [{"origin": a, "state": b, "cost": c, "audit": x} for (a, b), (c, x) in found.items()]
                    record |= {"facts": json.dumps(facts), "paths": paths, "rows": rows}
                else:
                    cost, audit, _ = closed({b: p for (_, b), p in found.items()})
                    left = list(edited(rows, audit))
                    record |= summary(facts, cost, audit) | {"repaired_sha256": sha(written(iter(left)))}
                    if texts:
                        record["turns"] = [{"role": r, "text": t} for r, t in left]
                out.append(record)
            held, rows_held, chars = [], 0, 0
            return pa.RecordBatch.from_pylist(out, target)

        current: tuple[object, bool, list[dict]] | None = None  # the conversation being read
        begun = new = False
        for batch in batches:
            target = target or pa.schema([("conv_id", batch.schema.field("conv_id").type), *OUT_FIELDS])
            for r in batch.to_pylist():
                if current is None or r["conv_id"] != current[0]:
                    if current is not None:
                        held.append(current)
                        if rows_held >= BATCH_PIECES * piece_rows or chars >= BATCH_CHARS:
                            yield results()
                    current = (r["conv_id"], not begun, [])  # the first of a task may have begun in the one before
                    begun = True
                if r["kind"] == 1:
                    new = True
                if r["kind"] < 2:
                    continue
                if len(current[2]) >= piece_rows or (rows_held + chars and chars + len(r["text"]) > BATCH_CHARS and current[2]):
                    held.append((current[0], True, current[2]))
                    current = (current[0], True, [])
                    if rows_held >= BATCH_PIECES * piece_rows or chars >= BATCH_CHARS // 2:
                        yield results()
                stays = new and not r["blank"]
                gone = r["copies"] - stays
                initial = r["role"][:1]
                current[2].append({
                    "turn": r["turn"], "role": r["role"], "text": r["text"] if stays else "", "copies": r["copies"], "gone": gone, "blank": r["blank"], "first": new,
                    "cut": stays and r["cut"], "step": (initial if initial in ("s", "u", "a") else "x") if stays else "-",
                })
                rows_held += 1
                chars += len(r["text"]) if stays else 0
                new = False
        if current is not None:
            held.append((current[0], True, current[2]))  # the last of a task may go on in the next
            yield results()

    return staged(sorted_rows(turns, ids).mapInArrow(run, schema), "repair_pieces")


ROW_FIELDS = [("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("gone", pa.int64()), ("blank", pa.bool_()), ("first", pa.bool_()), ("cut", pa.bool_())]
RESULT_FIELDS = [(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in NAMES]
OUT_FIELDS = [
    ("part", pa.int32()), ("seq", pa.int32()), ("open", pa.bool_()), ("facts", pa.string()),
    ("paths", pa.list_(pa.struct([("origin", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))), ("rows", pa.list_(pa.struct(ROW_FIELDS))),
    *RESULT_FIELDS, ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
]


def chained(pieces: DataFrame) -> DataFrame:
    """For each open piece the state before it and its letters on the cheapest way through its whole conversation; the first piece of
    a conversation has the results. One task goes through a conversation's pieces in order and holds no rows of it."""
    key = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, began, target = None, False, None
        best: dict[int, tuple[int, str]] = {}
        facts, trail = {}, []

        def finish() -> list[dict]:
            cost, audit, state = closed(best)
            ways = []
            for place, came in reversed(trail):
                before, letters = came[state]
                ways.append({"part": place[0], "seq": place[1], "state": before, "letters": letters})
                state = before
            ways.reverse()
            ways[-1]["letters"] += audit[sum(len(w["letters"]) for w in ways) :]
            ways[0] |= summary(facts, cost, audit)
            return [{"conv_id": conv} | w for w in ways]

        for batch in batches:
            target = target or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("seq", pa.int32()), ("state", pa.int32()), ("letters", pa.string()), *RESULT_FIELDS[:-1]])
            for r in batch.to_pylist():
                if not began or r["conv_id"] != conv:
                    if began:
                        yield pa.RecordBatch.from_pylist(finish(), target)
                    conv, began = r["conv_id"], True
                    best, facts, trail = {0: (0, "")}, counted([]), []
                ahead: dict[int, tuple[int, str]] = {}
                came: dict[int, tuple[int, str]] = {}
                for p in r["paths"]:
                    if p["origin"] in best:
                        cost, audit = best[p["origin"]]
                        offer = (cost + p["cost"], audit + p["audit"])
                        if p["state"] not in ahead or offer < ahead[p["state"]]:
                            ahead[p["state"]], came[p["state"]] = offer, (p["origin"], p["audit"])
                best, facts = ahead, joined(facts, json.loads(r["facts"]))
                trail.append(((r["part"], r["seq"]), came))
        if began:
            yield pa.RecordBatch.from_pylist(finish(), target)

    results = RESULT.rpartition(", ")[0]
    ordered = pieces.select("conv_id", "part", "seq", "facts", "paths").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return ordered.mapInArrow(run, f"conv_id {key}, part int, seq int, state int, letters string, {results}")


def pieces_and_ways(turns: DataFrame, ids: DataFrame | None, texts: bool, piece_rows: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of conversations that are whole; those of the others, each with its way."""
    found = walk(turns, turns if ids is None else ids, texts, piece_rows)
    open_ = found.where("open").select("conv_id", "part", "seq", "facts", "paths", "rows")
    ways = staged(chained(open_), "repair_ways")
    return found.where("not open"), ways.join(open_.select("part", "seq", "rows"), ["part", "seq"])


def repair(turns: DataFrame, ids: DataFrame | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row a conversation of `ids` (a table with conv_id; else of `turns`): counts of faults, cost, audit, digest of the result.
    turns: conv_id, turn, role, text."""
    whole, parts = pieces_and_ways(turns, ids, False, piece_rows)
    key = whole.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *NAMES]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [written(edited(r["rows"], r["letters"], r["state"])) if r["letters"].strip("D") else None for r in batch.select(["rows", "letters", "state"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in (*names[:-1], "part", "seq")), pa.array(made, pa.string())], [*names[:-1], "part", "seq", "made"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, row, total, empty, target = False, {}, hashlib.sha256(), True, None
        for batch in batches:
            target = target or pa.schema([*(batch.schema.field(n) for n in names[:-1]), ("repaired_sha256", pa.string())])
            for r in batch.to_pylist():
                if not began or r["conv_id"] != row["conv_id"]:
                    if began:
                        yield pa.RecordBatch.from_pylist([row | {"repaired_sha256": total.hexdigest()}], target)
                    began, row, total, empty = True, {n: r[n] for n in names[:-1]}, hashlib.sha256(), True
                if r["made"] is not None:
                    total.update(("" if empty else "\n").encode() + r["made"].encode())
                    empty = False
        if began:
            yield pa.RecordBatch.from_pylist([row | {"repaired_sha256": total.hexdigest()}], target)

    results = RESULT.rpartition(", ")[0]
    made = parts.select(*names[:-1], "part", "seq", "rows", "letters", "state").mapInArrow(texts, f"conv_id {key}, {results}, part int, seq int, made string")
    late = made.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(hashes, f"conv_id {key}, {RESULT}")
    return whole.select(*names).unionByName(late)


def repaired_turns(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The repaired conversations, one row a turn: conv_id, part, seq and place (in this order of three), role, text."""
    whole, parts = pieces_and_ways(turns, None, True, piece_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[{"role": a, "text": b} for a, b in edited(r["rows"], r["letters"], r["state"])] for r in batch.select(["rows", "letters", "state"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("conv_id", "part", "seq")), pa.array(made, OUT_FIELDS[-1][1])], ["conv_id", "part", "seq", "turns"])

    columns = ["conv_id", "part", "seq", "turns"]
    late = parts.select("conv_id", "part", "seq", "rows", "letters", "state").mapInArrow(run, whole.select(columns).schema)
    return whole.select(columns).unionByName(late).select("conv_id", "part", "seq", F.posexplode("turns").alias("place", "t")).select("conv_id", "part", "seq", "place", "t.role", "t.text")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    full stops, exclamation and question marks away, 3 repeats it, 4 makes its role user. Null is one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")
