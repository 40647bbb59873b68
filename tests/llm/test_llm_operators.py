"""The ten operators against brute force, on small tables with nulls, empty and repeated rows and clashing extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import chat, exact_dedup, html_text, jaccard, mixing, packing, quality, secrets, suffix_dedup, token_files
from gridloom.llm.common import new_folder

WORDS = ["river", "stone", "Cloud", "apple,", "night.", "paper", "été", "straße", "token", "hill"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, target double, _row string"


def rows():
    """Texts with copies, near copies, shared passages, nulls and an id that occurs twice."""
    rng = random.Random(5)
    base = " ".join(rng.choices(WORDS, k=150))
    passage = " ".join(rng.choices(WORDS, k=60))
    texts = [None, "", " \n\t ", "one two three", base, base.upper(), base.replace("river", "lake", 1), base + " tail end.", "Aa bB", "aA Bb", "x" * 450, "same line\nsame line\nother\n"]
    texts += [" ".join(rng.choices(WORDS, k=rng.randint(5, 120))) + ("\n" + passage if i % 4 == 0 else "") for i in range(40)]
    texts += [" ".join(w if rng.random() > 0.02 else "edit%d" % i for w in base.split()) for i in range(15)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, ""]), 0, 7, 9, 1.5, "clash") for i, t in enumerate(texts)]
    return out + [(3, "one two three", "en", "a", 0, 7, 9, 1.5, "clash"), (None, "lonely null id " * 9, "en", "b", 0, 7, 9, 1.5, "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mixing_meets_targets(spark, docs, empty):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows())
    per = {}
    for r in found:
        assert 0 <= r["copies"] <= 2 and r["size"] >= 0
        s = per.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2] += r["size"]
        s[3] += r["size"] * r["copies"]
    total = sum(s[0] for s in per.values())
    for size, target, seen, taken in per.values():
        assert size == seen and target <= 2 * size + 1e-6 and abs(taken - target) <= max(40, 0.1 * target)
    assert abs(sum(s[1] for s in per.values()) - 1.5 * total) < 1e-6
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)
    assert mixing.mix(empty).count() == 0


def test_jaccard_components(docs, empty):
    data = [(r[0], r[1]) for r in rows()]
    sets = []
    for _, text in data:
        w = words(lower(text))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    label = list(range(len(data)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = sorted((str(d), len(s), str(low.get(find(i)))) for i, ((d, _), s) in enumerate(zip(data, sets, strict=True)))
    got = jaccard.jaccard_components(docs, 4, 85).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    assert jaccard.jaccard_components(empty, 4, 85).count() == 0


def test_jaccard_long_lists(spark):
    """Many near copies of one text, some beyond the threshold of the hub."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    data = [(k, " ".join(w if rng.random() > (k % 9) / 100 else f"e{k}_{i}" for i, w in enumerate(base))) for k in range(60)]
    sets = [{tuple(t.split()[i : i + 4]) for i in range(197)} for _, t in data]
    label = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), 4, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label))


def test_jaccard_links(spark, monkeypatch):
    """Every link between different sets, also inside lists that are longer than ALL_PAIRS and one cell."""
    monkeypatch.setattr(jaccard, "LIST_CELL", 7)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    data = [(k, " ".join(w if rng.random() > (k % 9) / 300 else f"e{k}_{i}" for i, w in enumerate(base))) for k in range(60)]
    data += [(100, data[5][1]), (101, None), (102, "one two")]
    sets = {d: frozenset(tuple(t.split()[i : i + 4]) for i in range(max(1, len(t.split()) - 3))) if t else frozenset() for d, t in data}
    want = {frozenset((sets[a], sets[b])) for a in sets for b in sets if sets[a] != sets[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    links, nodes = jaccard.jaccard_links(spark.createDataFrame(data, "doc_id long, text string"), 4, 85)
    of = {r["node"]: sets[r["doc_id"]] for r in nodes.collect() if r["node"] is not None}
    got = links.collect()
    assert len(of) == len(set(of.values())) == len(set(sets.values()) - {frozenset()}) and nodes.count() == len(data)
    assert len(got) == len(want) > 200 and {frozenset((of[r["a"]], of[r["b"]])) for r in got} == want and all(r["a"] < r["b"] for r in got)


def test_fragment_keys_meet():
    """Any two sets at the threshold share a key."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 6, 11, 40, 300):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, len(a) * 15 // 100 + 1))
            b = np.delete(a, rng.choice(len(a), drop, replace=False))
            if 100 * len(b) >= 85 * len(a):
                assert set(jaccard.fragment_keys(a, 85).tolist()) & set(jaccard.fragment_keys(b, 85).tolist())


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rng = random.Random(1)
    turns = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", " ".join(rng.choices(WORDS, k=90))) for i in range(1, 40)]
    turns += [(2, 0, "user", said), (2, 1, "assistant", said), (3, 0, "assistant", None), (3, 1, None, "<\\|x <|y"), (None, 0, "user", "a"), (4, 5, "us\ner\\", "long " * 3000), (4, None, "assistant", "last")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    samples = chat.format_chat(table, public_tokenizers.path("byte_bpe_50k.json"), budget=600, history=200).collect()
    convs = {}
    for s in sorted(samples, key=lambda s: (s["conv_id"] or -9, s["window"])):
        parsed = chat.parse(s["text"])
        c = convs.setdefault(s["conv_id"], [[], []])
        c[0] += parsed[s["n_context"] :]
        c[1] += [chat.unescape(s["text"][x["start"] : x["end"]]) for x in s["loss"]]
        if s["conv_id"] == 1:
            assert parsed[0] == ("system", "be kind")
    assert sum(s["conv_id"] == 1 for s in samples) > 3 and any(s["n_context"] > 1 for s in samples)
    for conv, (found, loss) in convs.items():
        want = [(r or "", t or "") for c, n, r, t in sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is None, t[1]))]
        assert found == want and loss == [t for r, t in want if r == "assistant"]
    for text in ("<|", "<\\|", "<\\\\|im_end|>", "\\<|<|"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.format_chat(table.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_chat_budget(spark):
    """Greedy windows against brute force; no sample over the budget but a single longer turn; the same for any partitions."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, rng, budget, history = Tokenizer.from_file(path), random.Random(6), 300, 80

    def size(turn):
        return len(tokenizer.encode(f"<|im_start|>{turn[0]}\n{turn[1]}<|im_end|>\n", add_special_tokens=False).ids)

    convs = {}
    for c, (n, longest) in enumerate([(1, 5), (2, 260), (400, 30), (60, 400), (300, 120), (7, 900), (3, 280)] + [(rng.randint(1, 9), 90) for _ in range(20)]):
        roles = ["system" if c % 2 else "user"] + [rng.choice(["user", "assistant", "system"]) for _ in range(n - 1)]
        convs[c or None] = [(r, " ".join(rng.choices(["river", "stone", "paper"], k=rng.randint(0, longest)))) for r in roles]
    convs[500] = [("system", "stone " * 250)] + [("assistant", "river " * (k * 20)) for k in range(20)]
    want = {}
    for c, turns in convs.items():
        sizes, system, start, number = [size(t) for t in turns], turns[0][0] == "system", 0, 0
        while start < len(turns):
            context, end = [], start + 1
            if start and system and sizes[0] + sizes[start] <= budget:
                context = [0]
            back, room = start, min(history, budget - sum(sizes[k] for k in context) - sizes[start])
            while back - 1 >= (1 if system else 0) and sum(sizes[back - 1 : start]) <= room:
                back -= 1
            context += range(back, start)
            while end < len(turns) and sum(sizes[k] for k in context) + sum(sizes[start : end + 1]) <= budget:
                end += 1
            want[c, number] = ([turns[k] for k in context] + turns[start:end], len(context))
            start, number = end, number + 1
    table = spark.createDataFrame([(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 9, 150):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = chat.format_chat(table, path, budget, history).collect()
            for s in got:
                assert len(tokenizer.encode(s["text"], add_special_tokens=False).ids) <= budget or len(chat.parse(s["text"])) == 1
            assert len(got) == len(want) and {(s["conv_id"], s["window"]): (chat.parse(s["text"]), s["n_context"]) for s in got} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_html_text(spark):
    field = html_text.trained()
    right = total = 0
    for page in html_text.labelled_pages(60, 99):
        found = [b for b in html_text.blocks(page) if b.label is not None]
        guess = field.decode(html_text.features(found))
        right += sum(int(b.label) == y for b, y in zip(found, guess, strict=True))
        total += len(found)
    assert right >= 0.98 * total
    page = '<html><head><title>t</title><script>x="</p>"</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy.</div><article><h1>Head &amp; tail</h1><p><b>One\n two<br><p>Three.</p></article><section class="comments"><p>Nice!</p></section><footer>&copy; x</footer>'
    table = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract_text(table, field).collect())
    assert got == [(1, "Head & tail\n\nOne two\n\nThree.")] * 2 + [(2, ""), (3, "")]


def test_html_odd_markup(spark):
    import time

    field = html_text.trained()

    def one(body):
        return html_text.main_text(f"<body><nav><ul><li><a href=x>Menu</a></li></ul></nav><article><h1>Head line</h1>{body}</article></body>", field).split("\n\n")[1:]

    assert one("<p don't>Hello world, good day.</p><p title='a > b' class=\"x\">Two.</p>") == ["Hello world, good day.", "Two."]
    assert one("<p>Let <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math> be <object>small</object>.</p>") == ["Let x<2 be small."]
    assert one("<p>a < b &amp; c<br>d &#233;&nbsp;e</p><script>var x = '<p>no</p>'</script><p>Last one.") == ["a < b & c d é e", "Last one."]
    assert one("<p>Pick <select><option>one</select> now.</p>") == ["Pick now."]
    begin = time.time()
    found = html_text.blocks("<div class='a b'>x " * 20_000 + "</b></i>" * 20_000 + "<p>y" * 20_000)
    assert len(found) == 40_000 and time.time() - begin < 20
    table = spark.createDataFrame([(k, None, f"<article><p>Long text {k}.</p>" + "<p>More of it.</p>" * 30_000, "t", 3) for k in range(2)], "page_id long, url string, html string, text string, n_chars int")
    assert [len(r["text"]) for r in html_text.extract_text(table, field).collect()] == [12 + 30_000 * 13] * 2
    assert html_text.extract_text(table.limit(0), field).count() == 0


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = Counter((r[0], zlib.crc32(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())) for r in rows())
    got = packing.pack(docs, path, size=64).collect()
    pieces, sequences = {}, {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 64
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(64 - sum(n for _, n in s) for s in sequences.values()) < 64
    once = Counter()
    for (d, _), parts in pieces.items():
        if len({s for s, _ in parts}) == len(parts):
            once[d, zlib.crc32(b"".join(x for _, x in sorted(parts)))] += 1
    assert all(want[k] for k in once) and len(once) >= len(want) - 2
    assert sum(r["length"] for r in got) == sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows())
    assert packing.pack(empty, path).count() == 0


def test_cutting_stock():
    need = {300: 100, 400: 50, 324: 100, 700: 10}
    found = packing.patterns(need)
    assert all(sum(x * k for x, k in p.items()) <= 1024 for p, _ in found)
    for length, n in need.items():
        assert sum(p.get(length, 0) * u for p, u in found) <= n + 1e-6
    assert abs(sum(u for p, u in found if p == {300: 1, 324: 1, 400: 1}) - 50) < 1e-6 and abs(sum(u for p, u in found if p == {324: 1, 700: 1}) - 10) < 1e-6
    rng = random.Random(9)
    for n in (1, 40, 3000):
        need = Counter(min(1023, int(rng.lognormvariate(5.5, 0.8)) + 1) for _ in range(n))
        table, loose, sequences, stream = packing.slots(need)
        taken = Counter()
        for length, first, end, copies, start, _ in table:
            assert first == taken[length] and (end - first) % copies == 0 and start < sequences
            taken[length] += end - first
        assert all(first == taken[length] <= need[length] for length, first, _ in loose)
        tokens, rest = sum(x * k for x, k in need.items()), sum(x * (need[x] - taken[x]) for x in need)
        assert stream == -(-rest // 1024) and sequences * 1024 - (tokens - rest) <= sequences * 8
        assert n < 3000 or rest < 0.1 * tokens


def test_suffix_dedup(docs, empty):
    data = [(r[0], (r[1] or "").encode()) for r in rows()]
    seen = Counter(t[i : i + 200] for _, t in data for i in range(len(t) - 199))
    want = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want.append((str(d), len(t), sum(gone), bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], sum(x["hi"] - x["lo"] for x in r["removed"]), bytes(r["kept"])) for r in got) == sorted(want)
    assert sum(w[2] for w in want) > 1000
    assert suffix_dedup.remove_repeats(empty).count() == 0


def removed_by_hand(texts, length):
    """(bytes, removed, kept) by counting every window of every text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(t), sum(gone), bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("heavy", [False, True])
def test_suffix_dedup_hard_cases(spark, monkeypatch, heavy):
    """A passage in a third of all rows, periodic and very long texts, copies, repeats of 199 to 201 bytes; also with every
    anchor heavy, with slices shorter than the texts, and without a filter."""
    rng = random.Random(12)
    if heavy:
        monkeypatch.setattr(suffix_dedup, "UNITS", 1)
        monkeypatch.setattr(suffix_dedup, "HEAVY_UNITS", 1)
        monkeypatch.setattr(suffix_dedup, "FILTER_KEYS", 0)

    def noise(n):
        return "".join(rng.choices("abcdefgh é", k=n))

    passage, short = noise(700), noise(199)
    texts = [noise(rng.randint(0, 400)) + passage + noise(rng.randint(0, 400)) for _ in range(30)]
    texts += [noise(300) + short + "x" + noise(200), short, noise(100) + short + "y"]
    for n in (198, 199, 200, 201, 202):
        part = noise(n)
        texts += [noise(150) + part + noise(50), "@" + part, noise(3) + part + "#"]
    texts += ["a" * 900, "ab" * 300, "a" * 199, "abc" * 70 + "d", noise(40_000) + passage, None, ""] + [noise(500)] * 4 + [noise(900) for _ in range(15)]
    long = noise(2000)
    texts += [long[:1500] + "!" + long[1500:], long, long[:700] + "?" + long[701:]]
    data = list(enumerate(texts))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    want = removed_by_hand([(t or "").encode() for t in texts], 200)
    for r in got:
        assert (r["n_bytes"], sum(x["hi"] - x["lo"] for x in r["removed"]), bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]
    assert len(got) == len(texts)


def test_units_by_slices(monkeypatch):
    """Units do not depend on the slices."""
    text = bytes(random.Random(2).choices(b"abcd ", k=9000)) + b"z" * 700
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.units(text, 200), strict=True)]
    monkeypatch.setattr(suffix_dedup, "SLICE", 777)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.units(text, 200), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert whole[0][0] == 0 and whole[1][-1] == len(text) - 200 and (whole[0][1:] == whole[1][:-1] + 1).all()


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    for high in (3, 2**63):
        rows = rng.integers(0, high, (700, 4), dtype=np.uint64)
        order = suffix_dedup.multikey_quicksort(rows)
        assert sorted(order.tolist()) == list(range(700)) and [tuple(r) for r in rows[order].tolist()] == sorted(tuple(r) for r in rows.tolist())


def test_secrets(spark, empty):
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    prose = " ".join("".join(rng.choices(["ta", "re", "on", "li", "ver", "ing"], k=3)) for _ in range(4000))
    hidden = ["".join(rng.choices(alphabet, k=40)) for _ in range(12)]
    texts = ["PassWord = 'hunter2hunter2' and ſecret=abcdefgh1", "AKIA" + "Q" * 16 + " AKIAX", "f" * 31 + " " + "0a" * 16, None, ""]
    texts += [prose[i * 100 : i * 100 + 30000] + " " + h + " end" for i, h in enumerate(hidden)] + ["reverreverreverreverta " * 5]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [[(x["start"], x["kind"], x["end"]) for x in got[i]["base"]] for i in range(5)] == [[(0, 0, 26)], [(0, 1, 20)], [(32, 2, 64)], [], []]
    caught = sum(any(texts[5 + i][x["start"] : x["end"]] == h for x in got[5 + i]["found"]) for i, h in enumerate(hidden))
    assert caught >= 10 and not got[17]["found"]
    assert secrets.scan_secrets(empty).count() == 0


def test_exact_dedup(docs, empty):
    groups = {}
    for r in rows():
        groups.setdefault(lower(r[1]), []).append(r[0])
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows()) and sum(r["kept"] for r in got) == len(groups)
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[bytes(r["digest"])]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_digest_index_levels(spark, monkeypatch, keep):
    """Ingesting by parts, with merges between, gives the same run as all at once; segments are sorted and carry filters."""
    monkeypatch.setattr(exact_dedup, "FAN", 2)
    data = [(i if i % 7 else None, f"text {i % 30}") for i in range(200)]
    index = exact_dedup.DigestIndex(8, keep)
    for part in range(5):
        index.ingest(spark.createDataFrame(data[part * 40 : part * 40 + 40], "doc_id long, text string").repartition(2))
    assert len(index.levels) > 1
    rows = index.compact().collect()
    for r in rows:
        digests = [r["digests"][i : i + 32] for i in range(0, len(r["digests"]), 32)]
        assert digests == sorted(digests) and r["filter"]
    assert len({r["bucket"] for r in rows}) == len(rows) <= 8
    got = {bytes(r["digest"]): (r["keep_id"], r["n"], r["tied"]) for r in index.repeated(index.levels[-1][0]).collect()}
    want = {}
    for k in range(30):
        ids = [i for i, t in data if t == f"text {k}"]
        known = [i for i in ids if i is not None]
        want[hashlib.sha256(f"text {k}".encode()).digest()] = ((max if keep == "largest" else min)(known), len(ids), 1)
    assert got == want


def test_exact_dedup_hot_and_tied(spark):
    """A third of all rows are one text, and the best id of a group occurs several times."""
    data = [(i, "Hot TEXT" if i % 3 == 0 else f"t{i % 40}") for i in range(3000)] + [(2997, "hot text")] * 3 + [(None, None), (None, "")]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    got = exact_dedup.exact_dedup(table).collect()
    hot = [r for r in got if r["keep_id"] == 2997]
    assert len(got) == len(data) and len(hot) == 1003 and sum(r["kept"] for r in hot) == 1 and all(r["group_size"] == 1003 for r in hot)
    assert sum(r["kept"] for r in got) == len({lower(t) for _, t in data}) and sum(r["kept"] and r["doc_id"] is None for r in got) == 1


def test_texts_with_one_digest_are_told_apart():
    """Byte verification: rows under one digest and salt that differ."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"digest": [b"a", b"a", b"a", b"b"], "salt": [-1, -1, -1, -1], "text": ["x", "X", "y", "z"]})
    assert [r for b in exact_dedup._compare([batch]) for r in b.to_pylist()] == [{"digest": b"a", "same": False, "head": None}]


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4, 60)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labels).collect()
    want = []
    for r in rows():
        text, w = r[1] or "", words(r[1])
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if words(x)]
        want.append((str(r[0]), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == sorted(want)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # too few labels certify nothing
    assert quality.passing(docs, labels).columns == docs.columns
    assert quality.quality_rules(empty, labels).count() == 0


def test_quality_certifies(spark):
    good = [(i, " ".join(f"word{i + k}" for k in range(40)), "en") for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"{k}#$%&*#" for k in range(i, i + 40)), "en") for i in range(30)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 10_000)) for i, *_ in good + bad], "doc_id long, quality int")
    got = quality.quality_rules(table, labels).collect()
    assert all(r["kept"] for r in got if r["doc_id"] < 10_000)
    assert all(not r["kept"] for r in got if r["doc_id"] >= 10_000)
    assert sorted(r["doc_id"] for r in quality.passing(table, labels).collect()) == list(range(3000))
    few = quality.certify(quality.measure(table), labels.filter("doc_id < 58 OR doc_id >= 10000")).collect()
    enough = quality.certify(quality.measure(table), labels.filter("doc_id < 59 OR doc_id >= 10000")).collect()
    assert [r["steps"] for r in few] == [0] and few[0]["cut_symbols"] is None  # 0.95 ** 58 > 0.05
    assert [r["steps"] for r in enough] == [len(quality.LADDER)]  # 0.95 ** 59 < 0.05


def test_quality_ladder_stops(spark):
    """A step whose false rejections are too many for the bound ends the walk, by the exact tail."""
    good = [(i, " ".join(f"word{i + k}" for k in range(40)) + (" ####################" * 2 if i % 20 == 0 else ""), "en") for i in range(1000)]
    table = spark.createDataFrame(good, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good], "doc_id long, quality int")
    row = quality.certify(quality.measure(table), labels).first()
    share = 40 / len(good[0][1].replace(" ", ""))
    assert row["n"] == 1000 and row["steps"] == sum(step[0] > share for step in quality.LADDER) < len(quality.LADDER)


def test_quality_tail_is_exact_at_any_size(spark):
    def tail(k, n, p=quality.ALPHA):
        return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))

    cases = [(0, 59), (1, 59), (15, 320), (16, 340), (50, 1000), (9_999, 205_000), (10_000, 205_000), (10_001, 205_000), (12_238, 250_000), (12_500, 250_000)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), quality.ALPHA).alias("t")).collect()
    assert len(got) == len(cases) and all(r["t"] == pytest.approx(tail(r["k"], r["n"]), rel=1e-7) for r in got)
    far = spark.createDataFrame([(49_985_000, 10**9)], "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), quality.ALPHA)).first()[0]
    assert far == pytest.approx(0.01476, rel=1e-3)  # by the normal approximation


def test_token_files(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    manifest = token_files.write_token_files(docs, path, new_folder(spark, "shards"), shard_tokens=500)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert manifest.count() > 3
    want = Counter((r[0], np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u2").tobytes()) for r in rows())
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 2
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids) and got[0]["doc_id"] is None
    assert token_files.write_token_files(empty, path, new_folder(spark, "none")).count() == 0


def test_wavelet_shard():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40, 3000).astype("<u2") * 1201
    shard = token_files.WaveletShard(token_files.encode_shard(ids, [1, None], [2000, 1000]))
    assert (shard.tokens() == ids).all() and shard.documents()[0] == [1, None]
    for i in (0, 1, 777, 2999):
        assert shard.access(i) == ids[i]
    for token in (0, 1201, 39 * 1201, 7):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places) and shard.count(token, 1500) == (places < 1500).sum()
        for k in (0, len(places) - 1):
            if len(places):
                assert shard.select(token, k) == places[k]
    with pytest.raises(IndexError):
        shard.select(7, 0)


def test_pieces_equal_whole_texts():
    from gridloom.llm.tokens import encoder

    odd = ["", "  a  b", "a \n b", "\ta\tb c", "it's <|endoftext|>x", "a\n\n\nB. c,\nD.\n", "\nab c", "x.\n\n", "S'S don'T.", "<|ENDOFTEXT|>. A.B, c.,", "é. É, ñ.\nÑo", "İß ΑΣ b", "a\x1cb \x1d c", "q.\n.r ,. .", "İ.", "x İ, y", "e\u0301. n\u0303,", "a\u0301", "Å.", "z~ ~", "\0 x"]
    for name, blanks in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        got = encoder(path, "<u2", blanks).encode_list(odd * 2)
        assert got == [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in odd * 2]


def test_pieces_with_runs_of_line_feeds():
    from gridloom.llm.tokens import encoder

    runs = [f"x foo{a * n}{b}{c * m}" for n in range(7) for m in range(7) for a, b, c in (("\n", "bar", "\n"), ("\n", "Bar.", "\n"), ("\n", ".\nq", "\n"), ("\n", "1 two", "\n"))]
    rng = random.Random(4)
    runs += ["".join(rng.choices(["a", "B", ".", ",", "\n", "\n", "\n", " ", "'s", "é", "7", "|"], k=rng.randint(3, 24))) for _ in range(3000)]
    runs += ["x " + "line\n" * 5000 + "\n\nend"]
    for name, blanks in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        for text, ids in zip(runs, encoder(path, "<u2", blanks).encode_list(runs), strict=True):
            assert ids == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes(), repr(text[:60])


def test_pipeline_edges(spark, tmp_path):
    """An empty table, null and repeated ids, and columns whose names clash run through all stages."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kind = "doc_id long, text string, lang string, source string, n_chars long, _keep string, _row string, kept boolean, node long, digest string"
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, None, None, None, "k", "r", True, 1, "d"), (5, text, "en", "a", 3, "k", "r", None, 2, "d"), (5, text + " x", "en", "a", 3, "k", "r", None, 2, "d"), (6, None, "en", "a", 3, "k", "r", None, 2, "d")]
    for data, left in (([], 0), (rows, 1)):
        docs = spark.createDataFrame(data, kind)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [c.split()[0] for c in kind.split(", ")], name
            assert docs.count() >= left, name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert bool(packed) == bool(left)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    data = [(r[0] if r[0] is not None else 999, r[1], r[2] or "en", r[3] or "a", 0) for r in rows()]
    data = list({d[0]: d for d in data}.values())
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    want = {d[0]: d[1] for d in data}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        if name == "quality_rules":
            keep = {}
            for d, t in want.items():
                w = words(t)
                seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
                hit = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
                if len(w) >= 20 and 100 * len(hit) <= 30 * len(w):
                    keep[d] = t
            want = keep
        elif name == "exact_dedup":
            want = {max(d for d in want if lower(want[d]) == lower(t)): t for t in want.values()}
        else:
            sets = {d: {tuple(lower(t).split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t in want.items()}
            low = {d: d for d in sets}
            for _ in sets:
                for a in sets:
                    for b in sets:
                        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                            low[a] = low[b] = min(low[a], low[b])
            want = {d: t for d, t in want.items() if low[d] == d}
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == set(want)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} <= set(want)
