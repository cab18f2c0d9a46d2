"""Secret scan: three base patterns, and windows of high Shannon entropy inside candidate strings.

A candidate is a run of at least MIN_RUN token characters with a letter. For each character class a window
slides over the candidate's runs of that class; the sum of c*log2(c) over the counts c is kept up to date from the two
characters that enter and leave, so each step costs the same whatever the window. Windows above the class's threshold are
merged into spans of kind `entropy`. The allow-list suppresses windows that overlap what it matches and candidates that it
matches as a whole, never base spans; a base span suppresses the entropy spans that touch it.

Defined results: a null text is empty; every row returns one row, whatever its id, repeated rows too; offsets are code
points of the whole text, ends exclusive; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run's first AKIA starts its longest match, so the length can be part of it
HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_MARK = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

MIN_RUN = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
#: name, characters of the class, window, bits of entropy that a window must reach
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 20, 3.1),
    ("base36", re.compile(r"[0-9A-Z]+|[0-9a-z]+"), 20, 3.6),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.8),
)
_WORD = r"(?:(?:[A-Z]?[a-z]{2,}+)+|[A-Z][a-z]*|[a-z]+|[A-Z]+)"
#: Strings that look random and are no secrets. Those of the first kind hide the windows that overlap them.
ALLOW_INSIDE = tuple(
    re.compile(p)
    for p in (
        r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
        r"(?i)example|sample|placeholder|changeme|xxxx+|redacted",
        r"(?i)0123456789|abcdefghij[a-z]*|qwertyuiop",
        r"(?i)sha(?:1|224|256|384|512)[-_=:][0-9a-z+/=]*",
    )
)
#: Those of the second kind hide a candidate that they match from end to end: words, and digits with punctuation.
ALLOW_WHOLE = (re.compile(rf"{_WORD}(?:[/_=+-]+{_WORD})*+[/_=+-]*"), re.compile(r"[0-9_=/+-]+"))
#: Characters on either side of a candidate in which an allowed string may begin or end.
ALLOW_CONTEXT = 8
KINDS = ("assign", "access", "hex", "entropy")


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns."""
    out = []
    low = data.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if b"h" * 24 in data.translate(_HEX_MARK):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def window_entropies(run: str, width: int) -> list[float]:
    """Shannon entropy of each window of the run, by incremental counts."""
    counts: dict[str, int] = {}
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    total, out = 0.0, []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        if i >= width:
            old = run[i - width]
            c = counts[old]
            total -= term[c] - term[c - 1]
            counts[old] = c - 1
        if i >= width - 1:
            out.append(math.log2(width) - total / width)
    return out


def entropy_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        word, base = m.group(), m.start()
        if not any(c.isalpha() for c in word) or any(a.fullmatch(word) for a in ALLOW_WHOLE):
            continue
        lo = max(0, base - ALLOW_CONTEXT)
        allowed = [(lo + a.start() - base, lo + a.end() - base) for rule in ALLOW_INSIDE for a in rule.finditer(text[lo : m.end() + ALLOW_CONTEXT])]
        marks = []
        for _, chars, width, bits in CLASSES:
            for run in chars.finditer(word):
                if run.end() - run.start() >= width:
                    marks += [(run.start() + i, run.start() + i + width) for i, h in enumerate(window_entropies(run.group(), width)) if h >= bits]
        end = -1
        for lo, hi in sorted(marks):
            if any(lo < y and x < hi for x, y in allowed):
                continue
            if lo <= end:
                end = max(end, hi)
                out[-1] = (out[-1][0], 3, base + end)
            else:
                end = hi
                out.append((base + lo, 3, base + hi))
    return [s for s in out if not any(s[0] < e and b < s[2] for b, _, e in taken)]


def _needs_look(data: bytes) -> bool:
    return any(len(w) >= MIN_RUN for w in data.translate(_TOKEN_MARK).split()) if data else False


_TOKEN_MARK = bytes(b if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-" else 32 for b in range(256))


def spans_of(data: bytes | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text in UTF-8."""
    if not data:
        return [], []
    look = _needs_look(data)
    low = data.lower()
    if not look and not any(h in low for h in ASSIGN_HINTS) and b"AKIA" not in data and b"h" * 24 not in data.translate(_HEX_MARK):
        return [], []
    text = data.decode("utf-8", "replace")
    base = base_spans(text, data)
    return base, entropy_spans(text, base) if look else []


def _write(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan_batch(batch: pa.RecordBatch):
    texts = batch.column(1).cast(pa.binary())
    out = {"n_assign": [], "n_access": [], "n_hex": [], "n_entropy": [], "base_sha256": [], "spans": []}
    for t in texts:
        base, more = spans_of(t.as_py())
        kinds = [k for _, k, _ in base]
        for i, name in enumerate(("n_assign", "n_access", "n_hex")):
            out[name].append(kinds.count(i))
        out["n_entropy"].append(len(more))
        out["base_sha256"].append(hashlib.sha256(_write(base).encode()).hexdigest())
        out["spans"].append(_write(sorted(base + more)))
    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in out.items())], ["doc_id", *out])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans for each row; no shuffle."""
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _scan_batch, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
