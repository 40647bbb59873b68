"""Operator 7: secret scans by patterns and a randomness test battery with false-discovery control.

Patterns: assignments, access keys and long hex runs, leftmost and non-overlapping per kind. They are always reported.

Battery: every other run of token characters (``CANDIDATE``) that could hold MIN_BITS is a candidate. Its encoding is the
smallest alphabet that has all its characters; three tests ask whether it looks drawn at random from that alphabet: chi-squared
uniformity (Wilson-Hilferty), runs above and below the median code, and lag-1 serial correlation. The smallest p-value times
three is its randomness score.
Ordinary text gives the null: windows of every text with blanks, pattern hits and candidates taken out, one per NULL_STEP
characters and length class. The p-value of a candidate is the share of null windows of its length class that fall into its encoding and look
at least as random, times the number of encodings: ordinary text rarely gets into an encoding with digits and both cases, so
tokens of 20 characters on stand out although their letters alone prove little. Benjamini-Hochberg over all candidates picks the
discoveries at level FDR. What is gathered are histograms of scores (classes x encodings x bins). The smallest p-value
is the number of encodings over that of windows, so discoveries need a corpus of some MB.

Cases: null text is empty; offsets are code points, end exclusive; no candidates or no text give no discoveries; repeated
rows are scanned row by row; an empty table gives an empty result; a text of any length is scanned in one pass over its spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from string import ascii_lowercase, ascii_uppercase, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pick, staged
from gridloom.llm.tokens import byte_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABETS = (
    ("decimal", digits),
    ("hex", digits + "abcdef"),
    ("HEX", digits + "ABCDEF"),
    ("lower", ascii_lowercase),
    ("base32", ascii_uppercase + "234567"),
    ("base36", ascii_lowercase + digits),
    ("letters", ascii_uppercase + ascii_lowercase),
    ("base62", ascii_uppercase + ascii_lowercase + digits),
    ("base64", ascii_uppercase + ascii_lowercase + digits + "+/_-="),
)
SIZES = np.array([len(chars) for _, chars in ALPHABETS])
#: By byte: its code in each alphabet, and a bit for each alphabet that has it.
CODES = np.zeros((len(ALPHABETS), 256), dtype=np.int64)
MEMBER = np.zeros(256, dtype=np.int64)
for _i, (_, _chars) in enumerate(ALPHABETS):
    for _code, _c in enumerate(sorted(_chars)):
        CODES[_i, ord(_c)] = _code
        MEMBER[ord(_c)] |= 1 << _i
#: Length classes: a candidate belongs to the longest one that it reaches.
CLASSES = (16, 20, 24, 32, 48, 64)
MIN_BITS = 64
NULL_STEP = 61
FDR = 0.01
BINS = 400
#: Windows that are tested at a time.
ROWS = 8192
_BLANK = re.compile(r"[^A-Za-z0-9+/_=-]+")
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _tail(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(z / math.sqrt(2)).astype(np.float64)


def encodings(tokens: np.ndarray) -> np.ndarray:
    """Of byte rows: the first alphabet that has all characters."""
    shared = np.bitwise_and.reduce(MEMBER[tokens], axis=1)
    return np.log2(shared & -shared).astype(np.int64)


def battery(tokens: np.ndarray, encoding: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p-values of uniformity, runs and serial correlation of byte rows under randomness."""
    x, (m, n), k = CODES[encoding][tokens], tokens.shape, int(SIZES[encoding])
    counts = np.bincount((np.arange(m)[:, None] * k + x).ravel(), minlength=m * k).reshape(m, k)
    chi, d = (counts * counts).sum(1) * (k / n) - n, k - 1
    p_chi = _tail((np.cbrt(chi / d) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
    high = x > (k - 1) / 2
    a = high.sum(1)
    mean = 1 + 2 * a * (n - a) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    p_runs = np.where(var > 0, 2 * _tail(np.abs(runs - mean) / np.sqrt(np.where(var > 0, var, 1.0))), 1.0)
    p_runs = np.where((a == 0) | (a == n), 0.5 ** (n - 1), p_runs)
    off = x - x.mean(1, keepdims=True)
    spread = (off * off).sum(1)
    serial = np.where(spread > 0, (off[:, :-1] * off[:, 1:]).sum(1) / np.where(spread > 0, spread, 1.0), 1.0)
    return p_chi, p_runs, 2 * _tail(np.abs(serial + 1 / n) * math.sqrt(n))


def scores(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of byte rows of one length: encoding, and bin of -log10 of the combined p-value (0 looks random)."""
    encoding, bins = encodings(tokens), np.zeros(len(tokens), dtype=np.int64)
    for e in np.unique(encoding):
        at = np.flatnonzero(encoding == e)
        p = np.minimum(1.0, 3 * np.minimum.reduce(battery(tokens[at], int(e))))
        bins[at] = np.minimum(BINS - 1, (-10 * np.log10(np.maximum(p, 1e-45))).astype(np.int64))
    return encoding, bins


def as_bytes(token: str) -> np.ndarray:
    return np.frombuffer(token.encode("ascii"), dtype=np.uint8)


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that no base span meets, in one pass over both sorted lists, and that can hold MIN_BITS."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= a and (b - a) * math.log2(SIZES[int(encodings(as_bytes(m[0])[None, :])[0])]) >= MIN_BITS:
            out.append((a, b))
    return out


def null_windows(text: str, taken: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """By class: byte rows of ordinary text, spread over the whole of it, without the spans that are ``taken``."""
    pieces, at = [], 0
    for s, e in sorted(taken):
        if s > at:
            pieces.append(text[at:s])
        at = max(at, e)
    plain = np.frombuffer(_BLANK.sub("", " ".join([*pieces, text[at:]])).encode("ascii"), dtype=np.uint8)
    out = {}
    for i, n in enumerate(CLASSES):
        starts = np.arange(0, len(plain) - n + 1, NULL_STEP)
        if len(plain) >= CLASSES[-1] and len(starts):
            out[i] = plain[starts[:, None] + np.arange(n)]
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CAND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cell", pa.int32()), ("bin", pa.int32())])
_CELL = pa.struct([("cell", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
_KIND = "doc_id long, is_doc boolean, base array<struct<start: long, kind: int, end: long>>, cands array<struct<start: long, end: long, cell: int, bin: int>>, nulls array<struct<cell: int, bin: int, n: long>>"


def _scan(batches):
    """A cell is a length class and an encoding: class * encodings + encoding."""
    null = np.zeros((len(CLASSES) * len(ALPHABETS), BINS), dtype=np.int64)
    waiting: dict[int, list[np.ndarray]] = {i: [] for i in range(len(CLASSES))}

    def count(i: int) -> None:
        for at in range(0, len(rows := np.concatenate(waiting[i])), ROWS):
            encoding, bins = scores(rows[at : at + ROWS])
            np.add.at(null, (i * len(ALPHABETS) + encoding, bins), 1)
        waiting[i].clear()

    def batch_of(ids, flags, base, cands, nulls):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flags, pa.bool_()), pa.array(base, pa.list_(_SPAN)), pa.array(cands, pa.list_(_CAND)), pa.array(nulls, pa.list_(_CELL))], names=["doc_id", "is_doc", "base", "cands", "nulls"])

    for batch in byte_batches(batches, 1):
        base, cands = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            spans = base_spans(text)
            more = []
            runs = candidates(text, spans)
            for a, b in runs:
                encoding, bins = scores(as_bytes(text[a:b])[None, :])
                more.append({"start": a, "end": b, "cell": length_class(b - a) * len(ALPHABETS) + int(encoding[0]), "bin": int(bins[0])})
            for i, rows in null_windows(text, runs + [(s, e) for s, _, e in spans]).items():
                waiting[i].append(rows)
                if sum(map(len, waiting[i])) >= ROWS:
                    count(i)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            cands.append(more)
        yield batch_of(batch.column(0).to_pylist(), [True] * batch.num_rows, base, cands, [[]] * batch.num_rows)
    for i in waiting:
        if waiting[i]:
            count(i)
    yield batch_of([None], [False], [[]], [[]], [[{"cell": int(c), "bin": int(b), "n": int(null[c, b])} for c, b in zip(*np.nonzero(null), strict=True)]])


def cutoffs(null: dict[tuple[int, int], int], seen: dict[tuple[int, int], int], fdr: float = FDR) -> list[int]:
    """Per cell the largest bin that is a discovery (-1: none), by Benjamini-Hochberg over all candidates."""
    counts = np.zeros((len(CLASSES), len(ALPHABETS), BINS))
    for (cell, b), n in null.items():
        counts[*divmod(cell, len(ALPHABETS)), b] = n
    p = np.minimum(1.0, len(ALPHABETS) * (1 + counts.cumsum(2)) / (1 + counts.sum((1, 2)))[:, None, None]).reshape(-1, BINS)
    table = sorted((p[cell, b], cell, b, n) for (cell, b), n in seen.items())
    total, ranks = sum(seen.values()), np.cumsum([n for *_, n in table])
    passing = [i for i, row in enumerate(table) if row[0] <= fdr * ranks[i] / total]
    limit = table[passing[-1]][0] if passing else -1.0
    out = [-1] * (len(CLASSES) * len(ALPHABETS))
    for q, cell, b, _ in table:
        if q <= limit:
            out[cell] = max(out[cell], b)
    return out


def scan_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, base and found: arrays of (start, kind, end), kinds as in KINDS."""
    scanned = staged(pick(docs, doc_id="long", text="string").mapInArrow(_scan, _KIND), "scanned")

    def cells(column: str, n) -> dict:
        rows = scanned.select(F.explode(column).alias("c")).groupBy("c.cell", "c.bin").agg(n.alias("n")).collect()  # at most cells x bins
        return {(r["cell"], r["bin"]): r["n"] for r in rows}

    limits = cutoffs(cells("nulls", F.sum("c.n")), cells("cands", F.count(F.lit(1))), fdr)
    limit = F.array(*(F.lit(b) for b in limits))
    found = F.transform(F.filter("cands", lambda c: c["bin"] <= F.element_at(limit, c["cell"] + 1)), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.filter("is_doc").select("doc_id", "base", found.alias("found"))


def _joined(spans):
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "found")).alias("spans"))
