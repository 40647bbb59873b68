"""The registered queries of the ten operators on the smallest tables, against plain sequential code."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def encoded(name, texts, end):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*whole.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def test_op1(spark, documents):
    sizes = Counter()
    for r in documents:
        sizes[r["source"]] += len(words(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    got = run(spark, "op1_mix_sources")
    taken, by_id = Counter(), {r["doc_id"]: r for r in documents}
    for r in got:
        d = by_id[r["doc_id"]]
        n = len(words(d["text"]))
        assert r["size"] == n and r["source_size"] == sizes[d["source"]] and abs(r["target"] - target[d["source"]]) < 1e-3
        assert r["taken"] in (0, n, 2 * n)
        taken[d["source"]] += r["taken"]
    assert len(got) == len(documents)
    largest = max(len(words(r["text"])) for r in documents)
    assert all(abs(taken[s] - target[s]) <= max(0.05 * target[s], largest) for s in order)
    assert sorted(map(str, got)) == sorted(map(str, run(spark, "op1_mix_sources")))


def test_op3(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = pq.read_table(f"{SF}/conversations.parquet").to_pylist() + [{"conv_id": -1, "turn": i, "role": r, "text": said} for i, r in enumerate(("user", "assistant"))]
    convs = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        convs.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = {r["conv_id"]: r for r in run(spark, "op3_format_chat")}
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        r, loss = got[c], "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] >= sum(len(a) + len(b) for a, b in turns)


class Article(HTMLParser):
    """Text of the blocks below <article>, by the standard library's parser."""

    INLINE = {"a", "abbr", "b", "cite", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u"}

    def __init__(self):
        super().__init__()
        self.depth, self.parts, self.found, self.skip = 0, [], [], 0

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        self.parts = []
        if text and self.depth:
            self.found.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag not in self.INLINE:
            self.flush()
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.flush()
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_op4(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    got, right = {r["page_id"]: r for r in run(spark, "op4_extract_html")}, 0
    for p in pages:
        parser = Article()
        parser.feed(p["html"] or "")
        parser.flush()
        r = got[p["page_id"]]
        assert r["n_chars"] == len(r["text"]) and r["url"] == p["url"]
        right += r["text"] == "\n\n".join(parser.found)
    assert len(got) == len(pages) and right >= 0.97 * len(pages)


def test_op5(spark, documents):
    ids = dict(zip((r["doc_id"] for r in documents), encoded("byte_bpe_50k.json", [r["text"] for r in documents], 0), strict=True))
    pieces, sequences = {}, {}
    for r in run(spark, "op5_pack_sequences"):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for group, ends in ((pieces, {d: len(x) for d, x in ids.items()}), (sequences, None)):
        for key, parts in group.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
            assert at == ends[key] if ends else at <= 1024
    assert pieces.keys() == ids.keys() and len(sequences) * 1024 <= 1.02 * sum(map(len, ids.values())) + 1024


def test_op6(spark, documents):
    texts = [(r["text"] or "").encode() for r in documents]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    got = {r["doc_id"]: r for r in run(spark, "op6_suffix_dedup")}
    for d, t in zip((r["doc_id"] for r in documents), texts, strict=True):
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone, strict=False) if not g)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_op7(spark, documents):
    kinds = {
        "assign": re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile("(AKIA[A-Z0-9]+)"),
        "hex": re.compile("([0-9a-f]+)"),
    }
    least = {"assign": 8, "access": 16, "hex": 32}
    got = {r["doc_id"]: r for r in run(spark, "op7_secret_scan")}
    for d in documents:
        base = [(m.start(), k, m.end()) for k, rx in kinds.items() for m in rx.finditer(d["text"] or "") if len(m[1]) >= least[k]]
        base.sort(key=lambda x: (x[0], list(kinds).index(x[1])))
        said = [f"{k}:{a}:{b}" for a, k, b in base]
        r = got[d["doc_id"]]
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[1] == k for x in base) for k in kinds]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r["spans"].split(","))


def test_op10(spark, documents):
    documents = sorted(documents, key=lambda r: r["doc_id"])
    got = sorted(run(spark, "op10_token_files"), key=lambda r: r["doc_id"])
    at = 0
    for r, d, ids in zip(got, documents, encoded("word_bpe_49k.json", [d["text"] for d in documents], 2), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_mix_and_pack_stages(spark, documents):
    """The last two stages of the pipeline: whole documents as often as the mix says, each packed whole."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mix_sources"](spark, docs, SF)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in run(spark, "op1_mix_sources") if r["size"]}
    assert all(copies[d] == n for d, n in taken.items()) and set(copies) <= {r["doc_id"] for r in documents}
    packed = Counter()
    for r in stages["pack_sequences"](spark, mixed, SF).collect():
        packed[r["doc_id"], r["doc_tokens"]] += r["length"]
    ids = dict(zip((r["doc_id"] for r in documents), encoded("byte_bpe_50k.json", [r["text"] for r in documents], 0), strict=True))
    assert packed == Counter({(d, len(ids[d])): n * len(ids[d]) for d, n in copies.items() if n})
