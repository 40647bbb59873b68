"""The randomness battery of the secret scan: planted tokens in the tables' own prose, against a sequential version."""

from __future__ import annotations

import math
import random
import string
import time
from collections import Counter

import pyarrow.parquet as pq

from gridloom.llm import secrets

KINDS = {"hex": string.digits + "abcdef", "HEX": string.digits + "ABCDEF", "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/"}
LENGTHS = (20, 24, 28, 32, 40, 48, 64)


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def plain_score(token):
    """(encoding, bin) of one token, character by character."""
    i, chars = next((i, c) for i, (_, c) in enumerate(secrets.ALPHABETS) if set(token) <= set(c))
    code = {c: j for j, c in enumerate(sorted(chars))}
    x, n, k = [code[c] for c in token], len(token), len(chars)
    d = k - 1
    chi = sum(c * c for c in Counter(token).values()) * k / n - n
    p_chi = tail(((chi / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))) if chi > 0 else 1.0
    high = [v > (k - 1) / 2 for v in x]
    a = sum(high)
    if a in (0, n):
        p_runs = 0.5 ** (n - 1)
    else:
        mean = 1 + 2 * a * (n - a) / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + sum(u != v for u, v in zip(high, high[1:], strict=False))
        p_runs = 2 * tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    serial = sum((u - m) * (v - m) for u, v in zip(x, x[1:], strict=False)) / spread if spread else 1.0
    p = min(1.0, 3 * min(p_chi, p_runs, 2 * tail(abs(serial + 1 / n) * math.sqrt(n))))
    return i, min(secrets.BINS - 1, int(-10 * math.log10(max(p, 1e-45))))


def plain_scan(texts):
    """Discoveries (row, start, end) by one loop over all texts."""
    null, n_null, found = Counter(), Counter(), []
    for row, text in enumerate(texts):
        base = secrets.base_spans(text)
        hidden = set()
        for s, _, e in base:
            hidden.update(range(s, e))
        for m in secrets.CANDIDATE.finditer(text):
            if not any(s < m.end() and m.start() < e for s, _, e in base):
                i, b = plain_score(m[0])
                if len(m[0]) * math.log2(len(secrets.ALPHABETS[i][1])) >= secrets.MIN_BITS:
                    found.append((row, m.start(), m.end(), sum(len(m[0]) >= c for c in secrets.CLASSES) - 1, i, b))
                    hidden.update(range(*m.span()))
        allowed = set(string.ascii_letters + string.digits + "+/_=-")
        plain = "".join(c for i, c in enumerate(text) if i not in hidden and c in allowed)
        if len(plain) >= 64:
            for cls, n in enumerate(secrets.CLASSES):
                for at in range(0, len(plain) - n + 1, secrets.NULL_STEP):
                    null[cls, *plain_score(plain[at : at + n])] += 1
                    n_null[cls] += 1
    p = {x: min(1.0, len(secrets.ALPHABETS) * (1 + sum(n for (c, i, b), n in null.items() if (c, i) == x[3:5] and b <= x[5])) / (1 + n_null[x[3]])) for x in found}
    ranked = sorted(p.values())
    limit = max((q for k, q in enumerate(ranked, 1) if q <= secrets.FDR * sum(r <= q for r in ranked) / len(ranked)), default=-1)
    return sorted(x[:3] for x, q in p.items() if q <= limit)


def planted(seed):
    rng = random.Random(seed)
    texts = [r["text"] or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist()]
    where = {}
    for row in rng.sample(range(len(texts)), 160):
        kind, n = rng.choice(list(KINDS)), rng.choice(LENGTHS)
        token = "".join(rng.choices(KINDS[kind], k=n))
        at = rng.randrange(len(texts[row]) + 1)
        texts[row] = f"{texts[row][:at]} {token} {texts[row][at:]}"
        where[row] = (at + 1, at + 1 + n, kind, n)
    return texts, where


def test_planted_tokens_are_found_and_equal_a_sequential_scan(spark):
    texts, where = planted(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = secrets.scan_secrets(df).collect()
    got = sorted((r["doc_id"], s["start"], s["end"]) for r in rows for s in r["found"])
    assert got == plain_scan(texts)
    base = {(r["doc_id"], s["start"]) for r in rows for s in r["base"]}
    open_ = {row: w for row, w in where.items() if not any(d == row and w[0] <= s < w[1] for d, s in base)}  # patterns take long hex
    true = {(row, a, b) for row, (a, b, _, _) in open_.items()}
    long = {(row, a, b) for row, (a, b, _, n) in open_.items() if n >= 24}
    assert len(long & set(got)) >= 0.9 * len(long)
    assert len(set(got) - true) <= 0.05 * len(got)  # false discoveries, at a level of 0.01


def test_scores_of_every_encoding():
    rng = random.Random(5)
    for _, chars in secrets.ALPHABETS:
        for n in (16, 33, 64):
            for alphabet in (chars, chars[:2], chars[:1]):
                token = "".join(rng.choices(alphabet, k=n))
                encoding, bins = secrets.scores(secrets.as_bytes(token)[None, :])
                want = plain_score(token)
                assert encoding[0] == want[0] and abs(int(bins[0]) - want[1]) <= 1


def test_two_megabytes_take_linear_time():
    text = "key secret=abcdefgh1 WordsOfSomeLength0123456789 " * 45_000
    times = []
    for part in (text[: len(text) // 4], text):
        start = time.process_time()
        spans = secrets.base_spans(part)
        found = secrets.candidates(part, spans)
        rows = secrets.null_windows(part, found + [(a, b) for a, _, b in spans])
        times.append(time.process_time() - start)
    assert len(found) == 45_000 == len(spans) and len(rows) == len(secrets.CLASSES)
    assert times[1] < 8 * times[0] + 1


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "password = hunter2hunter2 x", 9), (1, "password = hunter2hunter2 x", 9), (None, None, 1), (2, "", 2)]
    df = spark.createDataFrame([(*r, "b") for r in rows], "doc_id long, text string, base int, found string")
    got = sorted((r["doc_id"] or 0, len(r["base"]), len(r["found"])) for r in secrets.scan_secrets(df).collect())
    assert got == [(0, 0, 0), (1, 1, 0), (1, 1, 0), (2, 0, 0)]
