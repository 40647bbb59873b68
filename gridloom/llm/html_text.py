"""Operator 4: main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags. A block's features are its ancestors' tags and the
words of their class, id and role attributes, and coarse features of its text (length, link share, marks). The field has two
labels, article and boilerplate, with weights per feature and for each pair of neighbouring labels. It is trained by
gradient steps on the conditional log-likelihood (forward-backward) over ``labelled_pages``: a bounded, generated set of
pages of many layouts whose blocks carry their labels. Viterbi decoding labels the blocks of a page; article blocks are
joined. Training is driver work of fixed size; the weights travel with the tasks.

Cases: null or empty html gives an empty text; unclosed and stray tags and odd quotes are tolerated, markup nested to any
depth takes linear time; scripts, styles, comments, choice lists and the head are no blocks; formulas stay in their block; a page without article blocks gives an empty text; pages repeated in the table are repeated.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import pick
from gridloom.llm.tokens import byte_batches

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "object"}
_INLINE |= {"math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mtable", "mtr", "mtd"}
_ENDS_P = {"p", "div", "ul", "ol", "li", "table", "section", "article", "aside", "nav", "header", "footer", "main", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "dl", "hr", "address", "fieldset"}
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("label", "linked", "own", "tags", "text", "words")

    def __init__(self, text: str, tags: list[str], words: list[str], own: str | None, linked: int, label: str | None):
        self.text, self.tags, self.words, self.own, self.linked, self.label = text, tags, words, own, linked, label


class _Open:
    """The open elements, with what a block needs of them: distinct tags and words, so that deep markup costs no more than
    the distinct names in it."""

    def __init__(self):
        self.stack: list[tuple[str, tuple, str | None]] = []
        self.places: dict[str, list[int]] = {}  # of each tag
        self.outer: list[int] = []  # places of block-level elements
        self.labels: list[tuple[int, str]] = []
        self.tags: dict[str, int] = {}  # of block-level elements, with their number
        self.words: dict[str, int] = {}

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def push(self, tag: str, words: tuple, label: str | None) -> None:
        at = len(self.stack)
        self.stack.append((tag, words, label))
        self.places.setdefault(tag, []).append(at)
        if label:
            self.labels.append((at, label))
        if tag not in _INLINE:
            self.outer.append(at)
            self.tags[tag] = self.tags.get(tag, 0) + 1
            for w in words:
                self.words[w] = self.words.get(w, 0) + 1

    def cut(self, at: int) -> None:
        """Close all elements from place ``at`` on."""
        while len(self.stack) > at:
            tag, words, label = self.stack.pop()
            self.places[tag].pop()
            if label:
                self.labels.pop()
            if tag not in _INLINE:
                self.outer.pop()
                for counts, names in ((self.tags, (tag,)), (self.words, words)):
                    for x in names:
                        counts[x] -= 1
                        if not counts[x]:
                            del counts[x]


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, with the tags of their ancestors, the words of their class, id and role, and data-label."""
    opened = _Open()
    found: list[Block] = []
    parts: list[str] = []
    linked, at, raw = 0, 0, None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text and opened.last("head") < 0:
                own = opened.stack[opened.outer[-1]][0] if opened.outer else None
                found.append(Block(text, list(opened.tags), list(opened.words), own, linked, opened.labels[-1][1] if opened.labels else None))
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if opened.last("a") >= 0:
                linked += len(piece)

    size = len(page)
    while at < size:
        if raw:
            end = re.compile(rf"</{raw}\s*>", re.IGNORECASE).search(page, at)
            at, raw = (end.end() if end else size), None
            continue
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW:
            if not closing and not m[3].endswith("/"):
                raw = tag
            continue
        if tag in ("br", "wbr"):
            parts.append(" " if tag == "br" else "")
            continue
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        if closing:
            place = opened.last(tag)
            if place >= 0 and not (tag in _INLINE and opened.outer and opened.outer[-1] > place):
                opened.cut(place)
            continue
        if tag in _ENDS_P and opened.last("p") >= 0:
            opened.cut(opened.last("p"))
        if tag == "li" and opened.last("li") > max(opened.last("ul"), opened.last("ol")):
            opened.cut(opened.last("li"))
        words, label = [], None
        for name, a, b, c in _ATTRIBUTE.findall(m[3]):
            value = (a or b or c).lower()
            if name.lower() == "data-label":
                label = value
            else:
                words += _WORD.findall(value)
        opened.push(tag, tuple(words), label)
    flush()
    return found


def features(page_blocks: list[Block]) -> list[list[str]]:
    out, n = [], len(page_blocks)
    for i, b in enumerate(page_blocks):
        size = len(b.text)
        f = ["bias", f"size={min(6, size.bit_length() // 2)}", f"links={min(3, 4 * b.linked // size)}"]
        f += [x for x, yes in (("end", b.text[-1] in ".!?"), ("copyright", "©" in b.text), ("first", i == 0), ("last", i == n - 1), ("bare", b.own is None)) if yes]
        f += [f"tag={t}" for t in sorted(b.tags)] + [f"word={w}" for w in sorted(b.words)]
        f += [f"own={b.own}"] if b.own else []
        out.append(f)
    return out


class ChainField:
    """Two labels: 1 article, 0 boilerplate."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.step = np.zeros((2, 2))

    def _scores(self, page: list[list[str]]) -> np.ndarray:
        zero = np.zeros(2)
        return np.array([sum((self.weights.get(f, zero) for f in fs), zero) for fs in page])

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not page:
            return []
        scores = self._scores(page)
        best, back = scores[0], []
        for s in scores[1:]:
            paths = best[:, None] + self.step
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + s
        label = int(best.argmax())
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-3) -> ChainField:
        """AdaGrad on the conditional log-likelihood of one page at a time."""
        seen: dict[str, np.ndarray] = {}
        seen_step = np.full((2, 2), 1e-6)
        order = random.Random(7)
        for _ in range(epochs):
            pages = order.sample(pages, len(pages))
            for fs, labels in pages:
                scores, n = self._scores(fs), len(fs)
                fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
                fwd[0] = scores[0]
                for i in range(1, n):
                    fwd[i] = scores[i] + np.logaddexp(fwd[i - 1][0] + self.step[0], fwd[i - 1][1] + self.step[1])
                for i in range(n - 2, -1, -1):
                    x = self.step + scores[i + 1] + bwd[i + 1]
                    bwd[i] = np.logaddexp(x[:, 0], x[:, 1])
                total = np.logaddexp(*fwd[-1])
                grad = -np.exp(fwd + bwd - total)
                grad[np.arange(n), labels] += 1
                step = np.zeros((2, 2))
                for i in range(1, n):
                    step -= np.exp(fwd[i - 1][:, None] + self.step + scores[i] + bwd[i] - total)
                    step[labels[i - 1], labels[i]] += 1
                per: dict[str, np.ndarray] = {}
                for g, f in zip(grad, fs, strict=True):
                    for x in f:
                        per[x] = per.get(x, 0) + g
                for x, g in per.items():
                    w = self.weights.setdefault(x, np.zeros(2))
                    g = g - decay * w
                    seen[x] = seen.get(x, 1e-6) + g * g
                    w += rate * g / np.sqrt(seen[x])
                seen_step += step * step
                self.step += rate * step / np.sqrt(seen_step)
        return self


def labelled_pages(count: int = 160, seed: int = 11) -> list[str]:
    """Generated pages of many layouts; data-label on an element labels the blocks below it."""
    rng = random.Random(seed)
    syllables = ("ta", "re", "on", "li", "ver", "sch", "ción", "eau", "um", "ing", "est", "pro")

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int = 1, hi: int = 40) -> str:
        return words(lo, hi).capitalize() + rng.choice((".", ".", "!", "?", ""))

    def junk(tag: str, body: str, *names: str) -> str:
        attribute = f' {rng.choice(("class", "id"))}="{rng.choice(names)}"' if names else ""
        return f'<{tag}{attribute} data-label="0">{body}</{tag}>'

    def links() -> str:
        items = "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 7)))
        return f"<ul>{items}</ul>"

    def paragraphs(k: int) -> str:
        return "".join(rng.choice(("<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<p><a href='/y'>{}</a></p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>", "<figure>{}</figure>")).format(sentence()) for _ in range(k))

    def noise() -> list[str]:
        return [
            junk("nav", links()), junk("header", f"<h1>{words(1, 4)}</h1>{links()}"), junk("footer", f"&copy; {words(1, 30)} &middot; {sentence()}"),
            junk("aside", paragraphs(2), "sidebar", "related", "widget"), junk("div", sentence(), "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored"),
            junk("div", sentence() + " <button>OK</button>", "cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal"), junk("form", f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button><p>{sentence()}</p>"),
            junk("section", f"<h3>{words(1, 2)}</h3>{paragraphs(3)}", "comments", "comment-list", "reader-comments", "discussion", "replies", "responses"), junk("div", links(), "menu", "navbar", "nav", "breadcrumb", "breadcrumbs", "tags", "share", "social", "pagination"),
            junk("div", paragraphs(2), "sidebar", "newsletter", "subscribe", "related-posts", "footer", "header", "site-header", "site-footer", "login", "search"),
            junk("div", sentence(), "masthead", "topbar", "legal", "copyright", "disclaimer", "meta", "byline", "author"), junk("button", words(1, 2)),
        ]

    out = []
    for _ in range(count):
        inner = f"<h1>{words(2, 9)}</h1>{paragraphs(rng.randint(1, 8))}"
        if rng.random() < 0.4:
            inner += rng.choice(noise()) + paragraphs(rng.randint(1, 3))
        if rng.random() < 0.2:
            inner += rng.choice(noise())
        open_tag, close_tag = rng.choice((("article", "article"), ("article", "article"), ("article", "article"), ("main", "main"), ("div class='content'", "div"), ("div id='main-content'", "div"), ("div class='post-body'", "div"), ("section class='article'", "section"), ("div class='entry-content'", "div"), ("div class='story'", "div")))
        body = f'<{open_tag} data-label="1">{inner}</{close_tag}>'
        if rng.random() < 0.2:
            body = f"<main>{body}</main>" if rng.random() < 0.5 else f'<div id="page">{body}</div>'
        before, after = rng.sample(noise(), rng.randint(0, 4)), rng.sample(noise(), rng.randint(0, 4))
        out.append(f"<html><head><title>{words(1, 5)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>")
    return out


def trained(pages: list[str] | None = None) -> ChainField:
    """The field trained on labelled pages (default: the generated ones)."""
    data = []
    for page in labelled_pages() if pages is None else pages:
        found = [b for b in blocks(page) if b.label is not None]
        if found:
            data.append((features(found), [int(b.label) for b in found]))
    return ChainField().train(data)


def main_text(page: str, field: ChainField) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, field.decode(features(found)), strict=True) if y)


def extract_text(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """page_id, url, text, n_blocks for every row of ``pages`` (page_id, url, html)."""
    field = field or trained()

    def run(batches):
        for batch in byte_batches(batches, 2):
            texts, counts = [], []
            for page in batch.column(2).to_pylist():
                found = blocks(page or "")
                texts.append("\n\n".join(b.text for b, y in zip(found, field.decode(features(found)), strict=True) if y))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["page_id", "url", "text", "n_blocks"])

    return pick(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_blocks int")


def op4_extract_html(spark, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.selectExpr("page_id", "url", "text", "CAST(length(text) AS BIGINT) AS n_chars")
