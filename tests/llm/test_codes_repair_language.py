"""Vector codes, chat repair and language identification against plain sequential code, with odd tables."""

from __future__ import annotations

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridloom.llm import chat_repair, language_id, registry, vector_codes

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


# ---- vector codes -----------------------------------------------------------------------------------------------------
def plain_lloyd(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector) that are kept, by id. Codes, errors and codebooks by whole scans of Python integers."""
    x = [[math.floor(1024 * c) for c in v] for _, v in rows]
    d = len(x[0])
    cuts = [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
    books = [[v[a:b] for v in x[:entries]] for a, b in cuts]

    def assign():
        out = []
        for v in x:
            best = [min((sum((s - t) ** 2 for s, t in zip(v[a:b], e, strict=True)), i) for i, e in enumerate(book)) for (a, b), book in zip(cuts, books, strict=True)]
            out.append(([i for _, i in best], sum(s for s, _ in best)))
        return out

    for _ in range(rounds):
        codes = assign()
        for p, (a, b) in enumerate(cuts):
            for e in range(len(books[p])):
                mine = [v[a:b] for v, (c, _) in zip(x, codes, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return assign(), ",".join(str(c) for book in books for e in book for c in e)


def test_vector_codes_query(spark):
    rows = sorted((r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist())
    codes, said = plain_lloyd([r[:2] for r in rows])
    per = {}
    for (_, _, label), (_, error) in zip(rows, codes, strict=True):
        per[label] = per.get(label, 0) + error
    got = {r["vec_id"]: r for r in registry.queries()["op11_vector_codes"](spark, SF).collect()}
    assert len(got) == len(rows)
    for (vec_id, _, label), (code, error) in zip(rows, codes, strict=True):
        r = got[vec_id]
        assert (r["code"], r["error"], r["label_error"]) == ("".join(f"{c:02x}" for c in code), error, per[label])
        assert r["codebooks_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_active_entries_equal_whole_scans():
    rng = np.random.default_rng(1)
    for case in range(60):
        x = rng.integers(-3, 4, (80, 2))
        book = rng.integers(-3, 4, (9, 2))
        code, dist = vector_codes.scan(x, book)
        new = book.copy()
        move = rng.random(9) < (0.0, 0.3, 0.7, 1.0)[case % 4]
        new[move] += rng.integers(-1, 2, (int(move.sum()), 2))
        got = vector_codes.reassign(x, code, dist, new, (new != book).any(1))
        want = vector_codes.scan(x, new)
        assert all((g == w).all() for g, w in zip(got, want, strict=True))  # many ties among small integers
    wide = np.array([[2**25, 0], [-(2**25), 1]])
    assert vector_codes.squared(wide, wide)[0, 1] == 2**52 + 1


def test_vector_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(7, [0.5, -0.25, 0.1]), (3, [0.0, 0.0, 0.0]), (3, [1.0, 1.0, 1.0]), (None, [0.5, -0.25, 0.1]), (9, [0.5, -0.25, 0.1])]
    bad = [(1, None), (1, []), (1, [None, 1.0, 1.0]), (2, [nan, 0.0, 0.0]), (2, [inf, 0.0, 0.0]), (8, [1.0, 2.0]), (8, [4e4, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, None if i == 3 else 1, "x") for i, v in good + bad], "vec_id long, embedding array<double>, label int, _k string")
    state, books = vector_codes.fit_codes(df, entries=4)
    order = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    codes, said = plain_lloyd(order, entries=4)
    got = sorted(((r["vec_id"], list(r["x"]), list(r["code"]), sum(r["dist"])) for r in state.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r[2], r[3]) for r in got] == codes
    assert ",".join(str(v) for b in books for v in b.ravel().tolist()) == said
    assert vector_codes.fit_codes(df.filter("false"))[0].count() == 0


# ---- chat repair ------------------------------------------------------------------------------------------------------
WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain_repair(rows):
    """rows of one conversation after damage, in order: (turn, role, text). Faults, cost, least audit and what it leaves."""
    seen, faults = set(), []
    for _, role, text in rows:
        said = WORD.findall(text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, added):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            _, role, text = rows[i]
            c, a, out = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, out))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if (state, role[:1]) in after:
                    c, a, out = best(i + 1, after[state, role[:1]], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *out)))
                for new in ("user", "assistant"):
                    if (state, new[0]) in after:
                        c, a, out = best(i + 1, after[state, new[0]], 0)
                        found.append((c + 2 + more, "R" + a, (f"{new}:{text}", *out)))
        for new in ("user", "assistant"):
            if added < 3 and (state, new[0]) in after:
                c, a, out = best(i, after[state, new[0]], added + 1)
                found.append((c + 2, "I" + a, (f"{new}:", *out)))
        return min(found, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = zip(rows, rows[1:], strict=False)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    convs = {}
    for r in rows:
        c, t, role, text = (r[k] for k in ("conv_id", "turn", "role", "text"))
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        into = convs.setdefault(c, [])
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        into += [] if k == 0 else [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(x, key=key) for c, x in convs.items()}


def columns(r):
    return tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def test_chat_repair_query(spark):
    want = plain_damage(pq.read_table(f"{SF}/conversations.parquet").to_pylist())
    got = {r["conv_id"]: columns(r) for r in registry.queries()["op12_repair_chats"](spark, SF).collect()}
    assert got == {c: plain_repair(x) for c, x in want.items()}


def test_chat_repair_in_new_workers(tmp_path):
    """Every task in a Python process of its own: no step leans on modules that another one has loaded."""
    conf = {"spark.python.worker.reuse": "false", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": str(tmp_path), "spark.pyspark.python": sys.executable}
    run = f"""from pyspark.sql import SparkSession
from gridloom.llm import registry
spark = SparkSession.builder.master("local[2]").config(map={conf}).getOrCreate()
print("conversations:", registry.queries()["op12_repair_chats"](spark, "{SF}").count())"""
    said = subprocess.run([sys.executable, "-c", run], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert "conversations: 20" in said.stdout, said.stderr[-2000:]


def test_chat_repair_ranks_few_rows_at_once(monkeypatch):
    """Long segments are ranked in slices whose memory is bounded by their rows, with the same results."""
    rng = np.random.default_rng(3)
    codes = ["".join(chr(65 + c) for c in rng.integers(0, 12, n)) for n in [chat_repair.TILE] * 40 + [0, 1, 7] * 30]
    ahead, last = [[0, 9, 9, 0]] * len(codes), [i % 3 > 0 for i in range(len(codes))]
    batch = pa.record_batch([pa.array(codes), pa.array(ahead, pa.list_(pa.int64())), pa.array(last)], ["codes", "ahead", "last"])
    sizes, plain = [], chat_repair.least_paths
    monkeypatch.setattr(chat_repair, "least_paths", lambda codes, ahead: sizes.append(sum(map(len, codes))) or plain(codes, ahead))
    got = pa.Table.from_batches(chat_repair._ranking(iter([batch, batch.slice(0, 0)])))
    assert max(sizes) <= 10 * chat_repair.TILE and got["codes"].to_pylist() == codes
    one = [x for i in range(len(codes)) for b in chat_repair._ranking(iter([batch.slice(i, 1)])) for x in b.to_pylist()]
    assert got.to_pylist() == one
    folded = pa.Table.from_batches(chat_repair._folding(iter([batch, batch.slice(0, 0)])))
    assert folded["m"].to_pylist() == chat_repair.fold(chat_repair._codes(batch["codes"])).reshape(-1, 16).tolist()


def test_least_paths_against_exhaustive_search():
    rng = np.random.default_rng(2)
    lists = [rng.integers(0, 12, int(n)) for n in rng.integers(0, 12, 300)]
    found = chat_repair.least_paths([np.append(c, chat_repair.END) for c in lists], np.zeros((len(lists), 4), dtype=np.int64))
    whole = chat_repair.fold([np.append(c, chat_repair.END) for c in lists])
    text = {0: "said.", 1: "cut", 2: ""}
    for codes, (_, audits), matrix in zip(lists, found, whole, strict=True):
        rows = [(i, "suax"[c // 3], text[c % 3] and f"{i} {text[c % 3]}") for i, c in enumerate(codes)]
        assert (int(matrix[0, 0]), audits[0]) == plain_repair(rows)[5:7]


@pytest.mark.parametrize("tile", [2])
def test_chat_repair_odd_tables(spark, monkeypatch, tile):
    monkeypatch.setattr(chat_repair, "TILE", tile)
    rows = [(1, i, ("user", "assistant", "system", "user2", None, "")[i % 6], f"text {i % 7}{'.?! '[i % 4]}") for i in range(90)]  # long
    rows += [(2, None, "user", "b."), (2, None, "user", "a."), (2, 5, "assistant", None), (2, 5, "assistant", " \t"), (2, 9, "assistant", "c.")]
    rows += [(None, 1, "user", "x."), (None, 2, "assistant", "y.")] * 2 + [(3, None, "user", "same.")] * 9 + [(4, 1, "user", "very " * 50_000 + "long.")]
    rows += [(c, 0, "user", "only.") for c in range(100, 160)]  # some lose their only row
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, idx int").repartition(5)
    want = {c: plain_repair(x) for c, x in plain_damage([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows]).items()}
    got = chat_repair.repair(chat_repair.damage(df)).collect()
    assert {r["conv_id"]: columns(r) for r in got} == want and len(got) == len(want)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()
    assert chat_repair.repair(chat_repair.damage(df.filter("false"))).count() == 0


# ---- language identification ------------------------------------------------------------------------------------------
def plain_counts(text):
    low = [chr(int(language_id.letters()[ord(c)])) if c.isalpha() else " " for c in text]
    s = re.sub(" +", " ", f" {''.join(low)} ")
    out = np.zeros(language_id.FEATURES, dtype=np.int64)
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            codes = [0 if c == " " else ord(c) for c in s[i : i + n]]
            if any(codes):
                gram = sum(c << (21 * k) for k, c in enumerate(codes))
                out[(gram * 0x9E3779B97F4A7C15 % 2**64) >> 50] += 1
    return out if any(c.isalpha() for c in text) else None


@pytest.mark.parametrize("cut", [3, 7, 1 << 20])
def test_ngram_counts(monkeypatch, cut):
    monkeypatch.setattr(language_id, "SLICE", cut)
    for text in ("Ab c", "  Éa--b\n\nçÖ  9x", "x", "12 34", "", "  ", "ab  12  cd", "İstanbul ﬁ \U0001d400\ud800 z" * 3):
        want, got = plain_counts(text), language_id.counts(text)
        assert (want is None) == (got is None) and (want is None or (want == got).all()), text


def test_language_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = registry.queries()["op13_language_id"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] is not None]
    assert len(right) > 200 and sum(right) / len(right) >= 0.98
    for r in got:
        text = docs[r["doc_id"]]["text"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    again = registry.queries()["op13_language_id"](spark, sf).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in got) == sorted((r["doc_id"], r["lang_pred"]) for r in again)


def test_language_odd_tables(spark):
    talk = {"xa": "abba cada baca dabba", "xb": "zwitz ozmy yomz wizzo"}
    rows = [(i + 1000 * k, f"{t} {t[i % 9:]}" * (1 + i % 5), lang, None) for k, (lang, t) in enumerate(talk.items()) for i in range(300)]
    odd = [(5001, None, "xa"), (5002, "", "xb"), (5003, "12 ... 9", "xa"), (None, "abba cada", "xb"), (5005, "baca dabba " * 200_000, None), (5006, "слово за словом", None), (5007, "zwitz", None), (5007, "zwitz", None)]
    df = spark.createDataFrame([*rows, *((i, t, x, 1) for i, t, x in odd)], "doc_id long, text string, lang string, _n int")
    model = language_id.fit(df, centroids=2, sample=50)
    assert model.langs == ["xa", "xb"] and model.by_cell.shape == (language_id.FEATURES, 4)
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in language_id.identify(df, model).collect()]
    assert len(got) == len(rows) + len(odd)
    named = {i: (x, s, r) for i, x, s, r in got if i is None or i > 5000}
    assert all(named[i][:2] == ("und", 0.0) for i in (5001, 5002, 5003))
    assert named[None][0] == "xa" and named[5005][0] == "xa" and named[5007][0] == "xb"
    assert named[5006][2] and named[5006][0] in model.langs  # another script is rejected, the nearest language named
    assert all(x == ("xa" if i < 1000 else "xb") for i, x, _, _ in got if i is not None and i < 5000)
    none = language_id.fit(df.withColumn("lang", df["lang"].substr(0, 0)).filter("lang is null"))
    assert {r["lang_pred"] for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(df.filter("false"), model).count() == 0
