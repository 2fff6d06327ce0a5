"""Plain Python versions of the contracts, to hold the operators against on small tables."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    assign = re.compile(r"""((?:(?ai:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    found.sort(key=lambda s: (s[1], order.index(s[0])))
    n = Counter(k for k, _, _ in found)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for k, s, e in found))


def private(text: str | None) -> tuple[int, int, int, int, str]:
    text = text or ""
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    found = [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]
    n = Counter(k for k, _, _ in found)
    return n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{s}:{e}" for k, s, e in found))


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] >= 2:
            marked |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)


def repeats(rows: list[tuple[int, str | None]], n: int = 50) -> dict[int, tuple[int, int, str]]:
    """Words of each document, those removed, and the SHA-256 of those kept."""
    first: dict[tuple, int] = {}
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def byte_repeats(rows: list[tuple[int, str | None]], n: int = 200) -> dict[int, tuple[int, int, int, str]]:
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + n] for _, t in texts for i in range(len(t) - n + 1))
    out = {}
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def shingles(text: str | None) -> frozenset:
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near(rows: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    """Shingles and component of each document."""
    sets = {d: shingles(t) for d, t in rows}
    posting = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            posting[g].append(d)
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d, s in sets.items():
        shared = Counter(e for g in s for e in posting[g] if e < d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def folded_words(text: str | None) -> list[str]:
    """Words with A-Z in lower case, without up to two ASCII marks at the end."""
    out = []
    for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
        for _ in range(2):
            if len(w) > 1 and ord(w[-1]) < 128 and not w[-1].isalnum():
                w = w[:-1]
        out.append(w)
    return out


def subsequence(item: list[str], region: list[str]) -> list[bool]:
    """Which of the item's words belong to a longest common subsequence with the region; later words of the region first."""
    rows = [[0] * (len(region) + 1)]
    for x in item:
        last, row = rows[-1], [0]
        for k, y in enumerate(region):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
        rows.append(row)
    return [rows[i + 1][-1] > rows[i][-1] for i in range(len(item))]


def contaminated(rows: list[tuple[int, str | None]], items: list[tuple[int, str | None]], least: float = 0.6, answer: float = 0.4, room: int = 12, short: int = 8) -> dict[tuple[int, int], float]:
    """(doc_id, item_id) -> share of the item found, for every place of every document, without any candidate search."""
    out: dict[tuple[int, int], float] = {}
    texts = [(d, folded_words(t)) for d, t in rows]
    for i, item_text in items:
        item = folded_words(item_text)
        n, known = len(item), set(item)
        for d, w in texts:
            if not n:
                continue
            if n < short:
                if any(w[k : k + n] == item for k in range(len(w) - n + 1)):
                    out[d, i] = 1.0
                continue
            inside = [0]
            for x in w:
                inside.append(inside[-1] + (x in known))
            quarter, tail = max(1, n // 4), max(1, int(n * 0.25))
            for place in range(-5, len(w) // quarter + 1):
                lo = max(0, place * quarter - n // 2 - room)
                hi = min(len(w), place * quarter + quarter + n + n // 2 + room)
                if hi > lo and inside[hi] - inside[lo] >= least * n - 1e-9:
                    found = subsequence(item, w[lo:hi])
                    if sum(found) >= least * n - 1e-9 and sum(subsequence(item[n - tail :], w[lo:hi])) >= answer * tail:
                        out[d, i] = max(out.get((d, i), 0.0), sum(found) / n)
    return out


def damaged(rows: list[tuple]) -> list[tuple]:
    """(conv_id, turn, role, text) with the planted faults."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def repaired(rows: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's (turn, role, text), by trying each edit of
    each row, with up to two inserted turns before it and at the end."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    ways = {((), ()): (0, "")}  # (last initial, turns left) -> (cost, audit): of ways that end alike only the least goes on
    made = [((), 0, "")] + [(tuple((r, "") for r in rs), 2 * len(rs), "I" * len(rs)) for n in (1, 2) for rs in itertools.product(("user", "assistant"), repeat=n)]
    legal_after = {(): "su", ("s",): "u", ("u",): "a", ("a",): "u"}

    def options(fault, role, text):
        if fault in ("blank", "duplicate"):
            return [((), 3, "D")]
        one = [(((role, text),), 0, "K"), ((("user", text),), 2, "R"), ((("assistant", text),), 2, "R")]
        one = [(t, c + (fault == "truncated"), x) for t, c, x in one]
        return [((), 3, "D"), *((a + t, b + c, x + y) for a, b, x in made for t, c, y in one)]

    def step(ways, opts):
        out = {}
        for (last, left), (cost, audit) in ways.items():
            for turns, more, letters in opts:
                end, ok = last, True
                for r, _ in turns:
                    ok = ok and r[:1] != "" and r[:1] in legal_after[end]
                    if not ok:
                        break
                    end = (r[:1],)
                if ok:
                    new = (cost + more, audit + letters, left + turns)
                    if end not in out or new[:2] < out[end][:2]:
                        out[end] = new
        return {(k, v[2]): v[:2] for k, v in out.items()}

    for (_, role, text), fault in zip(rows, faults, strict=True):
        ways = step(ways, options(fault, role, text))
    ways = step(ways, made)
    cost, audit, left = min((c, a, left) for (last, left), (c, a) in ways.items() if last in ((), ("a",)))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = Counter(faults)
    return gaps, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left))
