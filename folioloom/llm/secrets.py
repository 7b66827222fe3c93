"""Secret scans: named patterns, and candidate strings whose characters are too random to be words.

Candidates are runs of token characters. A window slides over each; counts of the characters in it are kept by adding one
and removing one, and so is the sum of n log n over them, which gives the Shannon entropy. Each character class has a
window, an alphabet and a least entropy. Windows above it, joined where they overlap, are one span, unless the candidate is
allowed: identifiers of known public form, paths, repeated examples.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm._common import by_column

# The base patterns, as the query states them, with the least length of what they find.
ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

# A candidate, and by class the characters, window length and least bits a character.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]{20,}"), 20, 3.0),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.1),
)
# Whole candidates that are random, or say that they are examples, and no secret; each must match from end to end.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"(?:{0}[-_])*(?i:your|my|example|sample|dummy|placeholder|changeme|x{{4,}})(?:[-_]{0})*".format(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})")),  # words and short numbers of which one says so
    re.compile(r"EXAMPLE(?:KEY)?[A-Za-z0-9+/=]*|[A-Za-z0-9+/=]*EXAMPLE(?:KEY)?"),  # keys of documentation
    re.compile(r"[A-Za-z]+"),  # a word, however long
    re.compile(r"[0-9_=+/-]+"),  # a number or a rule
    re.compile(r"/?(?:[A-Za-z][a-z_-]*|[0-9]{1,4})(?:/(?:[A-Za-z][a-z_-]*|[0-9]{1,4}))+/?"),  # a path
    re.compile(r"(?:[A-Za-z]+|[0-9]{1,4})(?:[-_](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))+"),  # words and short numbers joined by hyphens
)


def allowed(text: str) -> bool:
    return any(p.fullmatch(text) for p in ALLOWED)


def entropy_spans(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """Joined windows of text whose Shannon entropy, in bits a character, is at least ``least``."""
    if len(text) < window:
        return []
    term = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, spans, most = 0.0, [], window * (math.log2(window) - least)
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        if i >= window:
            old = text[i - window]
            n = counts[old]
            total += term[n - 1] - term[n]
            counts[old] = n - 1
        if i >= window - 1 and total <= most + 1e-9:
            if spans and spans[-1][1] >= i - window + 1:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - window + 1, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end): kinds 0 assign, 1 access, 2 hex, in the order in which the query lists them."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end): kinds 3 hex and 4 base64, by entropy."""
    out = []
    for m in CANDIDATE.finditer(text):
        found = m.group()
        if allowed(found):
            continue
        for kind, (_, pattern, window, least) in enumerate(CLASSES, 3):
            for part in pattern.finditer(found):
                if kind == 4 and not (re.search("[0-9]", part.group()) and re.search("[A-Za-z]", part.group())):
                    continue
                out += [(m.start() + part.start() + a, kind, m.start() + part.start() + b) for a, b in entropy_spans(part.group(), window, least)]
    return out


KINDS = ("assign", "access", "hex", *(f"entropy_{c[0]}" for c in CLASSES))


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each of docs, in one pass without a shuffle.

    Null text is empty. Spans are counted in code points, end exclusive. Entropy spans are added beside the base ones. Repeated rows have a row each, a very
    long text is read whole, an empty table gives no rows, and other columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in by_column(batches, "doc_id", "text"):
            rows = []
            for text in texts.to_pylist():
                base = base_spans(text or "")
                every = sorted(base + added_spans(text or ""))
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, hashlib.sha256(_told(base).encode()).hexdigest(), _told(every)))
            cols = list(zip(*rows))
            arrays = [ids, *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
