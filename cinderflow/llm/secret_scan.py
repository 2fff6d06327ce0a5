"""Secrets: an Aho-Corasick pass finds keywords, an anchored regular expression runs only where one was found, and
kinds that embed a checksum are kept only if it holds.

A jwt begins where a run of its characters does, so a long run is tried once.

Cases: null or empty text has no spans; a header that can't be read as JSON, however deep, is no jwt; repeated rows are scanned alike; spans that begin together are ordered as their kinds are listed; an empty table gives an empty result; long
texts are scanned whole; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import documents

# Kinds in the order of their listing, keywords and patterns.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
ANCHORED = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
}
#: Hexadecimal runs have no keyword: of any 32 digits in a row, one stands at a multiple of 32.
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_DIGITS = frozenset("0123456789abcdef")
SHORTEST = {"assign": 8, "access": 16}
SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"


def checksum_holds(kind: str, match: re.Match) -> bool:
    """github and npm tokens end in the base-62 CRC-32 of their body; the first part of a jwt is JSON that names an
    algorithm; the body of a pem block is base64 of whole bytes."""
    if kind in ("github", "npm"):
        value = 0
        for c in match[2]:
            value = value * 62 + BASE62.index(c)
        return value == zlib.crc32(match[1].encode())
    if kind == "jwt":
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(match[1] + "=" * (-len(match[1]) % 4)))
        except (ValueError, RecursionError):  # no JSON, or nested beyond what a header can be
            return False
    if kind == "pem":
        try:
            return bool(base64.b64decode("".join(match[0].split("-----")[2].split()), validate=True))
        except ValueError:  # no whole bytes
            return False
    return True


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def has_hex_run(text: str) -> bool:
    """A cheap test that holds for every text with 32 hexadecimal digits in a row."""
    return not HEX_DIGITS.isdisjoint(text[31::32])


def scan(text: str, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind as listed."""
    spans = []
    after: dict[str, int] = {}
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: places stay
    hits = sorted((end - n + 1, kind) for end, (kind, n) in keywords.iter(folded))
    for start, kind in hits:
        if start < after.get(kind, 0):
            continue
        if match := ANCHORED[kind].match(text, start):
            if kind in SHORTEST or checksum_holds(kind, match):
                after[kind] = match.end()
                size = len(match[1]) if kind == "assign" else match.end() - start
                if size >= SHORTEST.get(kind, 0):
                    spans.append((kind, start, match.end()))
    if has_hex_run(text):
        spans += [("hex", m.start(), m.end()) for m in HEX_RUN.finditer(text)]
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id and its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t or "", keywords)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind_of)], ["doc_id", "spans"])

    return documents(docs).mapInArrow(run, SCHEMA)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
