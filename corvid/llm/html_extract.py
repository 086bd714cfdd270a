"""The main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block has features of its ancestors (tags,
class and id names) and of its text (length, link density, punctuation). The field has a weight per feature and per pair of
neighbouring labels, is trained on labelled pages by conditional likelihood, and Viterbi decoding keeps the blocks of the article.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import slices
from corvid.llm.pages_made import labelled_pages

#: Tags that begin and end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul ins button label".split()) - {"ins", "label"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is characters up to their literal end tag, whatever is in it; only ``xmp`` shows it.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Without an end tag these run to the end of the page; the others are taken for empty then.
ENDLESS = frozenset(["script", "style"])
#: What may stand in a head; any other start tag, and text, ends it.
HEAD = frozenset("head title meta link base script style noscript template basefont bgsound".split())
#: A start tag ends these open elements, looking up to the nearest scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol menu dl select body html td th div article section main aside nav header footer form blockquote".split())
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/][^>]*(?:>|\Z)", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_TEMPLATE_END = re.compile(r"</template[\s/>]", re.I)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    tag: str
    tags: frozenset
    names: frozenset
    near: frozenset
    linked: float
    hidden: bool


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order, without empty ones; character references decoded, white space made single spaces.

    Scripts, styles and the like end at their literal end tag, so quotes, tags and comment marks inside them mean nothing. A head
    ends where something comes that can't be in one; what is in a template is not part of the page, unless it is never
    closed.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset, bool]] = []
    pieces: list[str] = []
    links = [0, 0]  # characters within links, open links
    in_head, templates = False, 0

    def flush() -> None:
        if pieces:
            text = " ".join(_html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                names = frozenset().union(*(n for _, n, _ in stack)) if stack else frozenset()
                near = next((n for _, n, _ in reversed(stack) if n), frozenset())
                tag = next((t for t, _, _ in reversed(stack) if t in BLOCK), "none")
                out.append(Block(text, tag, frozenset(t for t, _, _ in stack), names, near, min(1.0, links[0] / len(text)), any(h for _, _, h in stack)))
        links[0] = 0

    def add(piece: str) -> None:
        nonlocal in_head
        if templates or in_head and not piece.strip():
            return
        in_head = False
        pieces.append(piece)
        if links[1]:
            links[0] += len(piece.strip())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        closing = bool(m.group(1))
        if tag in RAW and not closing:
            if tag not in HEAD:
                in_head = False
            stop = _RAW_END[tag].search(page, at)
            if stop is None and tag not in ENDLESS:
                continue
            if tag == "xmp" and not templates:
                flush()
                pieces.append(_html.escape(page[at : stop.start()]))
                flush()
            at = stop.end() if stop else end
            continue
        if tag == "template":
            if closing:
                templates = max(0, templates - 1)
            elif templates or _TEMPLATE_END.search(page, at):
                templates += 1
            continue
        if templates:
            if not (closing and tag in BLOCK and any(t == tag for t, _, _ in stack)):
                continue
            templates = 0
        if tag == "head":
            in_head = not closing
            continue
        if tag not in HEAD:
            in_head = False
        if closing:
            if tag == "a":
                links[1] = max(0, links[1] - 1)
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in BLOCK or all(t not in BLOCK for t, _, _ in stack[i:]):
                        del stack[i:]
                    break
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            ends = CLOSES.get(tag, set()) | ({"p"} if tag not in ("option", "button") else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES and stack[i][0] not in ends:
                    break
        if tag in VOID:
            continue
        if tag == "a":
            links[1] += 1
        names, hidden = set(), False
        for name, value in _ATTR.findall(m.group(3)):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                names.update(w.lower() for w in _WORD.findall(value))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
        if m.group(3).rstrip().endswith("/") and tag not in BLOCK and tag != "a":
            continue
        stack.append((tag, frozenset(names), hidden))
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """The names of each block's features; all are 0 or 1."""
    out = []
    for i, b in enumerate(page):
        n = b.text.count(" ") + 1
        size = "1" if n == 1 else "3" if n < 4 else "8" if n < 9 else "20" if n < 21 else "60" if n < 61 else "long"
        link = "0" if b.linked == 0 else "some" if b.linked < 0.4 else "most" if b.linked < 0.9 else "all"
        body = "art" if b.tags & {"article", "main"} else "no"
        stop = b.text[-1] in ".!?…”\"')"
        f = ["bias", f"t={b.tag}", f"len={size}", f"link={link}", f"body={body}", f"body,link={body},{link}", f"t,link={b.tag},{link}", f"body,t={body},{b.tag}", f"stop={stop},{size}"]
        f += [f"a={t}" for t in b.tags]
        f += [f"c={c}" for c in b.names]
        f += [f"near={c}" for c in b.near]
        if b.hidden:
            f.append("hidden")
        if i == 0:
            f.append("first")
        if i == len(page) - 1:
            f.append("last")
        if b.text[0] == "©" or b.text[:9].lower() == "copyright":
            f.append("copyright")
        out.append(f)
    return out


@dataclass(frozen=True)
class Field:
    """Weights of label 1 by feature, and of label pairs (from, to); label 0 has none."""

    weights: dict[str, float]
    pairs: np.ndarray

    def decode(self, page: list[Block]) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not page:
            return []
        w = self.weights
        emit = [sum(map(w.get, f, [0.0] * len(f))) for f in features(page)]
        p00, p01, p10, p11 = map(float, self.pairs.ravel())
        s0, s1 = 0.0, emit[0]
        back: list[tuple[int, int]] = []
        for e in emit[1:]:
            b0, b1 = int(s1 + p10 > s0 + p00), int(s1 + p11 > s0 + p01)
            s0, s1 = max(s0 + p00, s1 + p10), max(s0 + p01, s1 + p11) + e
            back.append((b0, b1))
        labels = [int(s1 > s0)]
        for b in reversed(back):
            labels.append(b[labels[-1]])
        return labels[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = 30, rate: float = 0.3, decay: float = 2e-4, seed: int = 3) -> Field:
    """Weights by stochastic gradient (AdaGrad) on the conditional likelihood; expectations by the forward-backward recursion."""
    index: dict[str, int] = {}
    data = []
    for page, labels in pages:
        if not page:
            continue
        f = [[index.setdefault(x, len(index)) for x in fs] for fs in features(page)]
        owner = np.repeat(np.arange(len(f)), [len(x) for x in f])
        data.append((np.array([y for x in f for y in x]), owner, np.array(labels)))
    w, t = np.zeros(len(index)), np.zeros((2, 2))
    gw, gt = np.full(len(index), 1e-2), np.full((2, 2), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(data)):
            idx, owner, y = data[k]
            n = len(y)
            e = np.bincount(owner, w[idx], n)
            m = np.exp(t - t.max())
            x = np.exp(np.stack([-np.maximum(e, 0), np.minimum(e, 0)], 1))
            a, b = np.zeros((n, 2)), np.ones((n, 2))
            a[0] = x[0] / x[0].sum()
            for i in range(1, n):
                v = a[i - 1] @ m * x[i]
                a[i] = v / v.sum()
            for i in range(n - 2, -1, -1):
                v = m @ (x[i + 1] * b[i + 1])
                b[i] = v / v.sum()
            post = a * b
            post /= post.sum(1, keepdims=True)
            g = np.bincount(idx, (post[:, 1] - y)[owner], len(w))
            touched = np.unique(idx)
            g = g[touched] + decay * w[touched]
            gw[touched] += g * g
            w[touched] -= rate * g / np.sqrt(gw[touched])
            if n > 1:
                joint = a[:-1, :, None] * m[None] * (x[1:] * b[1:])[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                h = joint.sum(0)
                np.subtract.at(h, (y[:-1], y[1:]), 1)
                h += decay * t
                gt += h * h
                t -= rate * h / np.sqrt(gt)
    return Field({k: float(w[i]) for k, i in index.items()}, t)


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on the made pages: their number and seed are fixed, so it is the same everywhere."""
    pages = [(blocks(p), labels) for p, labels in labelled_pages()]
    return fit([(b, labels) for b, labels in pages if len(b) == len(labels)])


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row: the article's blocks joined by two line feeds, '' where there is none.

    Null html counts as empty, and so does a page without an article. Pages of any length are read whole. Rows are independent:
    repeated pages and page_ids (null ones too) give repeated rows, an empty table none; columns other than page_id, url and html
    are ignored, whatever their names.
    """
    field = field or default_field()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for page in part.column("html").to_pylist():
                    found = blocks(page or "")
                    texts.append("\n\n".join(b.text for b, y in zip(found, field.decode(found), strict=True) if y))
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
