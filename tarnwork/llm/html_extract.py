"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements whose leaves are runs of text. Every node has a hidden label, content or not.
Node potentials weigh features of the element or the text; pair potentials connect each node to its parent. Exact
marginals come from sum-product messages, from the leaves up and from the roots down, for all pages of a batch at
once, one level of depth at a time. A text run belongs to the article if its marginal says so.

Weights maximise the likelihood of labelled pages: the small set in ``labelled_pages`` and at most ``TRAIN_PAGES``
pages of the corpus whose markup marks its own article (an article or main element), chosen by a hash of their id.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.labelled_pages import PAGES

TRAIN_PAGES = 150
#: Pages of more characters are not trained on.
TRAIN_CHARS = 200_000
ROUNDS = 200
#: The labelled pages count as much as this share of the corpus's.
OWN_SHARE = 1.0
SHRINK = 3e-5

#: Elements whose content is raw up to their end tag, or to the end of the page.
_RAW = {tag: re.compile(f"</{tag}", re.I) for tag in ("script", "style")}
#: Elements without readable text, if they have an end tag.
_SILENT = {"noscript", "template", "svg", "iframe", "textarea", "select", "button", "title", "object", "math", "video", "audio", "canvas"}
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*)([^<>\"']*)>")
_TAG_START = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*)")
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_KEEP = re.compile(r"\skeep(?=[\s=>/]|$)", re.I)

#: Block elements by kind, and what names of classes and ids say.
_KINDS = {
    "article": "article main",
    "nav": "nav menu dir",
    "header": "header hgroup",
    "footer": "footer address",
    "aside": "aside dialog details summary",
    "form": "form fieldset legend",
    "list": "ul ol dl",
    "item": "li dt dd",
    "heading": "h1 h2 h3 h4 h5 h6",
    "paragraph": "p",
    "quote": "blockquote pre figure figcaption",
    "table": "table thead tbody tfoot tr td th caption",
    "box": "div section center",
    "page": "html body",
    "head": "head",
}
_KIND_OF = {tag: kind for kind, tags in _KINDS.items() for tag in tags.split()}
_NAMES = {
    "named_main": "article content post entry story main body text articlebody page",
    "named_menu": "nav menu navigation navbar breadcrumb breadcrumbs pagination pager toc links",
    "named_header": "header banner masthead top logo topbar",
    "named_footer": "footer bottom copyright legal imprint contentinfo",
    "named_side": "sidebar side aside widget complementary rail related recommended more bio promo teaser",
    "named_ad": "ad ads advert advertisement adverts sponsor sponsored banner commercial",
    "named_notice": "cookie cookies notice consent gdpr popup modal overlay alert paywall",
    "named_comment": "comment comments commentlist disqus reply replies respond responses discussion feedback",
    "named_share": "share social sharing tweet follow newsletter subscribe signup",
    "named_form": "form search login contact",
}
_SAID_BY = {word: name for name, words in _NAMES.items() for word in words.split()}
_CLOSES = {  # an element that ends open ones of these, up to the boundary
    **dict.fromkeys([t for t in _KIND_OF if t not in ("html", "body", "head")], ({"p"}, {"td", "th", "li", "dd", "div", "section", "article", "body"})),
    "li": ({"li", "p"}, {"ul", "ol"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
}
_TEXT_FEATURES = [f"{a}_{b}" for a in ("size", "links", "stops") for b in range(4)]
#: Elements that often have no end tag.
_OPTIONAL_END = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "html", "head", "body"}
FEATURES = ["any", "leaf", *_KINDS, *_NAMES, *_TEXT_FEATURES, *(f"in_{k}" for k in _KINDS), *(f"under_{n}" for n in _NAMES)]
_AT = {name: i for i, name in enumerate(FEATURES)}


class _TagEnds:
    """Where a tag that starts somewhere ends: at the first > outside of quotes.

    A quote without a partner is an ordinary character; a tag that would not end because of quotes ends at its first >.
    Each special character knows the end for a tag that is open there, so all tags together take linear time.
    """

    def __init__(self, html: str) -> None:
        self.places = [m.start() for m in re.finditer("[>\"']", html)]
        count = len(self.places)
        self.ends, self.plain = [-1] * (count + 1), [-1] * (count + 1)
        partner = {'"': -1, "'": -1}
        for k in range(count - 1, -1, -1):
            c = html[self.places[k]]
            if c == ">":
                self.ends[k] = self.plain[k] = self.places[k]
                continue
            self.plain[k] = self.plain[k + 1]
            self.ends[k] = self.ends[partner[c] + 1] if partner[c] >= 0 else self.ends[k + 1]
            partner[c] = k

    def end(self, start: int) -> int:
        """-1 if no > follows."""
        k = bisect.bisect_left(self.places, start)
        return self.ends[k] if self.ends[k] >= 0 else self.plain[k]


_COMMENT_END = re.compile("--!?>")


def tokens(html: str) -> list[tuple[str, str, str]]:
    """(kind, tag, text) of a page, in linear time: kind is "text", "open", "void" (self-closed) or "close".

    ``text`` is a run's text, with character references decoded, or a tag's attributes. Comments, declarations, scripts
    and styles are left out. A < that starts none of these is text.
    """
    out: list[tuple[str, str, str]] = []
    ends: _TagEnds | None = None
    at, size, last = 0, len(html), html.rfind(">")

    def text(run: str) -> None:
        if run:
            out.append(("text", "", unescape(run) if "&" in run else run))

    while at < size:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        text(html[at:start])
        m = _PLAIN_TAG.match(html, start)
        if m:
            close, tag, attributes = m.groups()
            at = m.end()
        elif html.startswith("<!--", start):
            m = _COMMENT_END.search(html, start + 2)  # two hyphens are the start's own in <!--> and <!--->
            if m and m.start() == start + 2 and m.group() == "--!>":
                m = _COMMENT_END.search(html, start + 4)
            at = m.end() if m else size
            continue
        else:
            ends = ends or _TagEnds(html)
            m = _TAG_START.match(html, start)
            end = ends.end(m.end()) if m else html.find(">", start) if start < last and html[start + 1 : start + 2] in ("!", "?", "/") else -1
            if end < 0:
                text("<")
                at = start + 1
                continue
            at = end + 1
            if not m:
                continue
            close, tag, attributes = m[1], m[2], html[m.end() : end]
        tag = tag.lower()
        if close:
            out.append(("close", tag, ""))
        elif tag in _RAW:
            m = _RAW[tag].search(html, at)
            if not m:
                break
            end = html.find(">", m.end())
            at = end + 1 if end >= 0 else size
        else:
            out.append(("void" if attributes.endswith("/") else "open", tag, attributes))
    return out


def silent_ends(found: list[tuple[str, str, str]]) -> dict[int, int]:
    """For each silent element with an end tag before its parent's, the places of its two tags."""
    pairs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()
    for i, (kind, tag, _) in enumerate(found):
        if kind == "open" and (tag in _SILENT or tag in _KIND_OF and tag not in _OPTIONAL_END):
            stack.append((tag, i))
            open_[tag] += 1
        elif kind == "close" and open_[tag]:
            while stack:
                name, start = stack.pop()
                open_[name] -= 1
                if name == tag:
                    if tag in _SILENT:
                        pairs[start] = i
                    break
    return pairs


@dataclass
class Forest:
    """Nodes of many pages, parents before children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    leaf: list[bool] = field(default_factory=list)
    feature_node: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    kept: list[bool] = field(default_factory=list)
    texts: dict[int, str] = field(default_factory=dict)

    def add(self, parent: int, features: list[int], leaf: bool, kept: bool) -> int:
        n = len(self.parent)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.leaf.append(leaf)
        self.kept.append(kept)
        self.feature.extend(features)
        self.feature_node.extend([n] * len(features))
        return n


def grow(forest: Forest, html: str, label) -> None:
    """Add a page. ``label(tag, names, attributes, parent's label)`` says what is kept, when training."""
    root = forest.add(-1, [_AT["any"], _AT["page"]], False, False)
    stack: list[tuple[str, int, list[int]]] = [("", root, [_AT["in_page"]])]  # (tag, node, what its children inherit)
    run: list[str] = []
    linked = total = links = 0

    def end_run() -> None:
        nonlocal linked, total
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                tag, node, inherited = stack[-1]
                n = len(text)
                size = (n >= 25) + (n >= 80) + (n >= 250)
                share = 0 if not linked else 1 + (linked * 3 > total) + (linked * 3 > 2 * total)
                stops = min(3, text.count(". ") + text.count(", ") + (text[-1] in ".!?:;\""))
                features = [_AT["any"], _AT["leaf"], _AT[f"size_{size}"], _AT[f"links_{share}"], _AT[f"stops_{stops}"], *inherited]
                forest.texts[forest.add(node, features, True, forest.kept[node])] = text
            linked = total = 0

    found = tokens(html)
    silent = silent_ends(found)
    open_: Counter[str] = Counter()

    def leave(place: int) -> None:
        """Close the open elements from this place of the stack on."""
        for tag, _, _ in stack[place:]:
            open_[tag] -= 1
        del stack[place:]

    at = -1
    while (at := at + 1) < len(found):
        kind, tag, value = found[at]
        if kind == "text":
            run.append(value)
            total += len(value)
            if links:
                linked += len(value)
        elif at in silent:
            at = silent[at]
        elif kind == "close":
            if tag == "a":
                links = max(0, links - 1)
            elif open_[tag]:
                end_run()
                leave(max(i for i in range(len(stack)) if stack[i][0] == tag) if stack[-1][0] != tag else len(stack) - 1)
                links = 0
            elif tag == "p":
                end_run()
        elif tag == "a":
            links += kind == "open"
        elif tag == "br":
            run.append(" ")
        elif tag == "hr":
            end_run()
        elif tag in _KIND_OF:
            end_run()
            closes, boundary = _CLOSES.get(tag, ((), ()))
            if any(open_[c] for c in closes):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        leave(i)
                    elif stack[i][0] in boundary:
                        break
            links = 0
            if kind == "void":
                continue
            names = ()
            if value:
                names = {_SAID_BY[w] for v in _NAMED.findall(value) for w in _WORD.findall(v.lower()) if w in _SAID_BY}
            _, above, inherited = stack[-1]
            kind_of = _KIND_OF[tag]
            features = [_AT["any"], _AT[kind_of], *(_AT[x] for x in names), *inherited]
            kept = label(tag, names, value, forest.kept[above]) if label else False
            node = forest.add(above, features, False, kept)
            stack.append((tag, node, [_AT[f"in_{kind_of}"], *(_AT[f"under_{x}"] for x in names)]))
            open_[tag] += 1
    end_run()


@dataclass(frozen=True)
class Weights:
    node: np.ndarray  # by feature, for content
    pair: np.ndarray  # (leaf or not, parent's label, child's label)


class _Beliefs:
    """Sum-product over a forest."""

    def __init__(self, f: Forest) -> None:
        self.parent, depth = np.array(f.parent), np.array(f.depth)
        self.kind = np.array(f.leaf, np.intp)
        self.at, self.what = np.array(f.feature_node, np.intp), np.array(f.feature, np.intp)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(depth) else [0]
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        self.n = len(depth)

    def run(self, w: Weights) -> None:
        own = np.zeros((self.n, 2))
        own[:, 1] = np.bincount(self.at, w.node[self.what], self.n)
        up = np.zeros((self.n, 2))
        pair = w.pair[self.kind]
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp.reduce(own[level][:, None, :] + pair[level], 2)
            np.add.at(own, self.parent[level], up[level])
        whole = own.copy()
        self.joint = np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            without = whole[self.parent[level]] - up[level]
            self.joint[level] = without[:, :, None] + pair[level] + own[level][:, None, :]
            whole[level] = own[level] + np.logaddexp.reduce(without[:, :, None] + pair[level], 1)
        self.content = 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -500, 500)))


def _by_keep(tag, names, attributes, above):
    if attributes and _KEEP.search(attributes):
        return True
    return above and tag not in ("nav", "aside", "footer", "form") and not (names and set(names) - {"named_main"})


def _by_markup(tag, names, attributes, above):
    if tag in ("nav", "aside", "footer", "form") or (set(names or ()) - {"named_main", "named_header"}):
        return False
    return above or tag in ("article", "main")


def train(pages: list[str], rounds: int = ROUNDS) -> Weights:
    """Maximum likelihood, with a little shrinkage, on the labelled pages and those of ``pages`` that mark their article."""
    forest = Forest()
    for html in PAGES:
        grow(forest, html, _by_keep)
    own = len(forest.parent)
    for html in pages:
        if re.search(r"<(article|main)\b", html, re.I):
            grow(forest, html, _by_markup)
    beliefs, y = _Beliefs(forest), np.array(forest.kept, float)
    weight = np.ones(beliefs.n)
    weight[:own] = max(1.0, OWN_SHARE * (beliefs.n - own) / own)
    weight /= weight.sum()
    child = np.flatnonzero(beliefs.parent >= 0)
    true_pair = np.zeros((2, 2, 2))
    np.add.at(true_pair, (beliefs.kind[child], y[beliefs.parent[child]].astype(int), y[child].astype(int)), weight[child])
    seen = np.bincount(beliefs.what, (y * weight)[beliefs.at], len(FEATURES))
    node, pair = np.zeros(len(FEATURES)), np.zeros((2, 2, 2))
    moments = [np.zeros_like(node), np.zeros_like(node), np.zeros_like(pair), np.zeros_like(pair)]
    for step in range(1, rounds + 1):
        beliefs.run(Weights(node, pair))
        joint = beliefs.joint[child]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        joint *= (weight[child] / joint.sum((1, 2)))[:, None, None]
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, beliefs.kind[child], joint)
        slopes = (
            seen - np.bincount(beliefs.what, (beliefs.content * weight)[beliefs.at], len(FEATURES)) - SHRINK * node,
            true_pair - expected - SHRINK * pair,
        )
        for i, (w, g) in enumerate(zip((node, pair), slopes)):
            first, second = moments[2 * i], moments[2 * i + 1]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            w += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Weights(node, pair)


def main_texts(pages: list[str], weights: Weights) -> list[str]:
    """The article of each page: its blocks in page order, joined by newlines."""
    forest, starts = Forest(), []
    for html in pages:
        starts.append(len(forest.parent))
        grow(forest, html, None)
    beliefs = _Beliefs(forest)
    beliefs.run(weights)
    out: list[list[str]] = [[] for _ in pages]
    owner = np.searchsorted(starts, list(forest.texts), "right") - 1
    for (node, text), page in zip(forest.texts.items(), owner.tolist()):
        if beliefs.content[node] >= 0.5:
            out[page].append(text)
    return ["\n".join(blocks) for blocks in out]


def _extracted(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("__html")
            kept = [c for i, c in enumerate(b.columns) if i != at]
            names = [n for i, n in enumerate(b.schema.names) if i != at]
            texts: list[str] = []
            pages, held = [], 0
            for v in b.column(at):
                html = v.as_py() or ""
                pages.append(html)
                held += len(html)
                if held > 1 << 21:
                    texts += main_texts(pages, weights)
                    pages, held = [], 0
            texts += main_texts(pages, weights) if pages else []
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return run


def extract(pages: DataFrame, keep: list[str], train_pages: int = TRAIN_PAGES, id_column: str = "page_id") -> DataFrame:
    """Columns ``keep`` of ``pages`` with text and n_chars (code points) of each page's article.

    Null or empty pages, and pages without an article, get an empty text. Columns named text or n_chars are replaced;
    repeated rows stay repeated.
    """
    total = pages.count()
    draw = F.pmod(F.xxhash64(id_column), F.lit(1 << 20)) < int((1 << 20) * min(1.0, train_pages / max(total, 1)))
    sample = [r["html"] for r in pages.where(F.length("html") <= TRAIN_CHARS).where(draw).select("html").limit(2 * train_pages).collect()]
    keep = [c for c in keep if c not in ("text", "n_chars")]
    rows = pages.select(*keep, F.col("html").alias("__html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string, n_chars long"])
    return rows.mapInArrow(_extracted(train(sample)), schema)


def op4_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
