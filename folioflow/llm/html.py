"""Main text of web pages by a tree-structured graphical model.

Block elements and their stretches of text are nodes of a tree; each is content (it holds or is main text) or not.
Potentials of single nodes depend on tag, names and text, those of edges connect parent and child. Sum-product messages
go up from the leaves and down from the root once each and give every node's marginal. Weights are trained on labelled
pages by gradient ascent on the likelihood, whose gradient needs the same marginals.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.arrow import append_columns

# fixed values: elements of HTML by their role
BLOCKS = """address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul""".split()
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup: what is up to the end tag goes; where that is missing, the code of the first two to the page's end, of the others nothing.
RAW = frozenset("script style textarea title iframe noframes xmp noembed".split())
CODE = frozenset(("script", "style"))
#: Elements that are left out with all that they hold; where the end tag is missing, the tag alone goes.
OUT = frozenset("noscript template svg math object video audio canvas".split())
#: What an opening tag ends, and what holds that from reaching further out.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"})}
#: Words in classes, ids and roles.
NAMES = [re.compile(x) for x in (r"nav|menu|crumb|pagina|toc", r"\b(ad|ads|adv|advert\w*|advertisement|sponsor\w*|promo\w*|banner-ad)\b", r"header|masthead|topbar|\bhead\b", r"foot|copyright|legal|imprint", r"side|aside|widget|related|recommend|popular|complementary", r"comment|respon|discuss|disqus|reply|replies|review", r"cookie|consent|notice|alert|gdpr|popup|modal|newsletter|subscri|banner", r"form|login|search|signup|register", r"share|social|follow|byline|\bmeta\b|tags", r"article|content|main|post|entry|story|text")]

#: Elements within each other beyond this depth are taken as beside each other, as browsers do.
DEEPEST = 512

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: One attribute, or the end of the tag, or a value whose quote is never closed.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?=>)|[^\s>"'][^\s>]*+|(["'])))?+)""")
_COMMENT_END = re.compile("--!?>")
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_LABEL = re.compile(r"""data-label\s*=\s*["']?([01])""")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_BLOCK = {t: i for i, t in enumerate(BLOCKS)}
N_TAGS, N_NAMES = len(BLOCKS), len(NAMES)
N_FEATURES = N_TAGS + N_NAMES + 1 + 10 + N_TAGS


class Tree:
    """Nodes in page order: parent (-1: none), depth, features; text of the nodes that are stretches of text (else None)."""

    def __init__(self, page: str):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.on: list[list[int]] = []
        self.text: list[str | None] = []
        self.tag: list[str] = []
        self.label: list[int | None] = []
        self.open = [self._add("html", -1, "")]
        self._pieces: list[str] = []
        self._linked = self._in_link = 0
        self._ends: dict[str, dict[int, int]] = {}
        self._held: dict[str, list[int]] = {}
        self._dead: set[int] = set()
        self._last = page.rfind(">")
        self._endless: set[str] = set()
        self._read(page)
        self._flush()

    def _read(self, page: str) -> None:
        """Goes through the markup once; everything that is looked for in vain is looked for once only."""
        at = start = 0
        while (start := page.find("<", start)) >= 0:
            past, name, ends, attributes = self._markup(page, start)
            if past is None:  # a character of the text
                start += 1
                continue
            self._words(page[at:start])
            at = past
            if not name:
                pass
            elif ends:
                self._close(name)
            elif name in RAW:
                at = self._past_raw(page, name, at)
            elif name in OUT:
                if not page.startswith("/>", past - 2):
                    at = self._past(page, name, start) or at
            else:
                self._start(name, attributes)
            start = at
        self._words(page[at:])

    def _markup(self, page: str, start: int) -> tuple[int | None, str, bool, str]:
        """Where the markup that begins there ends (None: it is text), and of a tag its name, whether it ends an element, and its attributes."""
        after = page[start + 1 : start + 2]
        if after == "!" and page.startswith("--", start + 2):
            return self._comment_end(page, start + 4), "", False, ""
        if after in ("!", "?"):
            end = -1
            if page.startswith("[CDATA[", start + 2) and "cdata" not in self._endless and (end := page.find("]]>", start + 9)) < 0:
                self._endless.add("cdata")
            end = end + 3 if end >= 0 else page.find(">", start) + 1 if start < self._last else len(page)
            return end, "", False, ""
        m = _NAME.match(page, start)
        if m is None:
            if page.startswith("</>", start):
                return start + 3, "", False, ""
            return None, "", False, ""
        if start > self._last:  # a tag that is cut off ends the page
            return (None if page.find("<", start + 1) >= 0 else len(page)), "", False, ""
        end = self._tag_end(page, m.end()) or page.find(">", start) + 1
        return end, m[2].lower(), bool(m[1]), page[m.end() : end - 1]

    def _comment_end(self, page: str, at: int) -> int:
        for short in (">", "->"):
            if page.startswith(short, at):
                return at + len(short)
        m = _COMMENT_END.search(page, at)
        return m.end() if m else len(page)

    def _tag_end(self, page: str, at: int) -> int | None:
        """Behind the > that ends a tag whose attributes begin there: a quote opens a value only behind =, and an unquoted value ends at white space or >.

        None where a quote is open or values hold every > up to the page's end; attributes that led there are remembered.
        """
        seen = []
        while at not in self._dead:
            seen.append(at)
            m = _ATTRIBUTE.match(page, at)
            if m is None or m[2]:
                break
            if m[1]:
                return m.end()
            at = m.end()
        self._dead.update(seen)
        return None

    def _past_raw(self, page: str, name: str, at: int) -> int:
        """Behind the end tag of an element without markup in it; where there is none, the page's end for code and the tag alone for others."""
        if name not in self._endless:
            m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if m and m.end() <= self._last:
                return page.find(">", m.end()) + 1
            self._endless.add(name)
        return len(page) if name in CODE else at

    def _past(self, page: str, name: str, start: int) -> int | None:
        """Where the element that starts there ends; elements of a name may hold each other. A page's are matched at once."""
        if name not in self._ends:
            ends, held, done = {}, [], 0
            for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", page, re.I):
                if m.start() < done or m.start() > self._last:
                    continue
                done = self._tag_end(page, m.end()) or page.find(">", m.end()) + 1
                if m[1] and held:
                    ends[held.pop()] = done
                elif not m[1] and not page.startswith("/>", done - 2):
                    held.append(m.start())
            self._ends[name] = ends
        return self._ends[name].get(start)

    def _add(self, tag: str, parent: int, attributes: str) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        on = [_BLOCK[tag]]
        if attributes:
            named = _CAMEL.sub(r"\1 \2", " ".join(_NAMED.findall(attributes))).lower().replace("_", " ")
            if named:
                on += [N_TAGS + i for i, x in enumerate(NAMES) if x.search(named)]
        label = _LABEL.search(attributes) if attributes else None
        self.on.append(on)
        self.text.append(None)
        self.tag.append(tag)
        self.label.append(int(label[1]) if label else None)
        return len(self.parent) - 1

    def _words(self, text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            self._pieces.append(text)
            if self._in_link:
                self._linked += len(text)

    def _flush(self) -> None:
        """Makes a node of the stretch of text that has been gathered."""
        text = " ".join("".join(self._pieces).split())
        self._pieces.clear()
        linked, self._linked = self._linked, 0
        if not text:
            return
        top = self.open[-1]
        n = len(text)
        base = N_TAGS + N_NAMES
        size = 0 if n <= 15 else 1 if n <= 40 else 2 if n <= 100 else 3 if n <= 250 else 4
        on = [base, base + 1 + size, base + 11 + _BLOCK[self.tag[top]]]
        for k, yes in enumerate((linked > 0.5 * n, text[-1] in ".!?…。\"'»”", text.count(". ") >= 2, any(c in text for c in "©|»›"), "," in text)):
            if yes:
                on.append(base + 6 + k)
        self.parent.append(top)
        self.depth.append(self.depth[top] + 1)
        self.on.append(on)
        self.text.append(text)
        self.tag.append("")
        self.label.append(None)

    def _start(self, name: str, attributes: str) -> None:
        if name in ("br", "hr"):
            self._pieces.append("\n")
        if name == "a":
            self._in_link = 1
        if name not in _BLOCK:
            return
        self._flush()
        if name == "html":
            return
        if self.tag[self.open[-1]] == "p":
            self._cut(len(self.open) - 1)
        if name in ENDS:
            ended, held = ENDS[name]
            bound = max([self._held[t][-1] for t in held if self._held.get(t)], default=0)
            further = [own[i] for t in ended if (own := self._held.get(t)) and (i := bisect_right(own, bound)) < len(own)]
            if further:
                self._cut(min(further))
        if len(self.open) >= DEEPEST:
            self._cut(DEEPEST - 1)
        self._held.setdefault(name, []).append(len(self.open))
        self.open.append(self._add(name, self.open[-1], attributes))

    def _cut(self, k: int) -> None:
        """Ends the k-th of the open elements and those in it."""
        for i in self.open[k:]:
            self._held[self.tag[i]].pop()
        del self.open[k:]

    def _close(self, name: str) -> None:
        if name == "a":
            self._in_link = 0
        if name not in _BLOCK or name in ("html", "body"):
            return
        self._flush()
        if self._held.get(name):
            self._cut(self._held[name][-1])

    def truth(self) -> np.ndarray:
        """Labels from data-label attributes, the innermost deciding; an element that holds content is content."""
        state = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent):
            state[i] = self.label[i] if self.label[i] is not None else (state[p] if p >= 0 else 0)
        return self._spread(state)

    def _spread(self, state: np.ndarray) -> np.ndarray:
        out = np.array([s if t is not None else 0 for s, t in zip(state, self.text, strict=True)])
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] |= out[i]
        return out

    def semantic(self) -> np.ndarray | None:
        """Labels of a page that marks its one article or main element; None for others."""
        marked = [i for i, t in enumerate(self.tag) if t in ("article", "main")]
        outer = [i for i in marked if self.parent[i] not in marked]
        if len(outer) != 1:
            return None
        state = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent):
            state[i] = i in outer or (p >= 0 and state[p] and self.tag[i] not in ("nav", "aside", "footer", "form", "button", "select", "dialog") and not any(N_TAGS <= k < N_TAGS + N_NAMES - 2 for k in self.on[i]))
        return self._spread(state)


class Forest:
    """The trees of some pages as arrays, nodes ordered by depth for the messages."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        base = np.cumsum([0] + [len(t.parent) for t in trees])
        self.base = base
        self.n = int(base[-1])
        self.parent = np.array([p + b if p >= 0 else -1 for t, b in zip(trees, base, strict=False) for p in t.parent], np.int64)
        depth = np.array([d for t in trees for d in t.depth], np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange((depth.max() if self.n else 0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.row = np.repeat(np.arange(self.n), [len(x) for t in trees for x in t.on])
        self.col = np.array([k for t in trees for x in t.on for k in x], np.int64)
        self.leaf = np.array([x is not None for t in trees for x in t.text], np.int64)

    def unary(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, 2))
        out[:, 1] = np.bincount(self.row, w[self.col], self.n)
        return out

    def marginals(self, w: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and of each node but roots the joint with its parent [parent's, own]; edge[leaf] is a 2 x 2 table."""
        own = self.unary(w)
        up = np.zeros((self.n, 2))
        inside = own.copy()
        for nodes in self.levels[:0:-1]:
            up[nodes] = np.logaddexp.reduce(edge[self.leaf[nodes]] + inside[nodes][:, None, :], axis=2)
            np.add.at(inside, self.parent[nodes], up[nodes])
        down = np.zeros((self.n, 2))
        pair = np.zeros((self.n, 2, 2))
        for nodes in self.levels[1:]:
            p = self.parent[nodes]
            outer = inside[p] + down[p] - up[nodes]
            joint = outer[:, :, None] + edge[self.leaf[nodes]]
            down[nodes] = np.logaddexp.reduce(joint, axis=1)
            joint = joint + inside[nodes][:, None, :]
            pair[nodes] = np.exp(joint - np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None])
        belief = inside + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), pair


def fit(forest: Forest, truth: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of nodes and edges of greatest likelihood."""
    w, edge = np.zeros(N_FEATURES), np.zeros((2, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.leaf[child], truth[forest.parent[child]], truth[child]), 1)
    held = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(edge), np.zeros_like(edge)]
    for k in range(1, rounds + 1):
        p, pair = forest.marginals(w, edge)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, forest.leaf[child], pair[child])
        grads = [np.bincount(forest.col, (truth - p)[forest.row], N_FEATURES) / len(forest.trees) - decay * w, (seen - expected) / len(forest.trees) - decay * edge]
        for i, (g, v) in enumerate(zip(grads, (w, edge), strict=True)):
            a, s = held[2 * i], held[2 * i + 1]
            a += 0.1 * (g - a)
            s += 0.01 * (g * g - s)
            v += rate * (a / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return w, edge


def train(pages: DataFrame, page: Column, key: Column, bound: int = 300, longest: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Weights from the labelled pages of the package and about bound pages of the table that mark their article.

    The chosen pages (by the hash of key; those with one article or main element label themselves) reach the driver;
    the parameters bound their number and, in bytes, the length of each, whatever the size of the table.
    """
    from folioflow.llm.labelled_pages import labelled_pages

    trees = [Tree(x) for x in labelled_pages()]
    truths = [t.truth() for t in trees]
    rows = pages.select(page.alias("page"), key.cast("string").alias("key")).filter(f"octet_length(page) <= {longest} and page rlike '(?i)<(article|main)[ >]'")
    n = rows.count()
    share = min(1.0, bound / n) if n else 0.0
    for r in sorted(rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 24)) < share * (1 << 24)).collect(), key=lambda r: (r["key"] or "", r["page"])):
        tree = Tree(r["page"])
        if (truth := tree.semantic()) is not None:
            trees.append(tree)
            truths.append(truth)
    return fit(Forest(trees), np.concatenate(truths))


def extract(df: DataFrame, page: Column, model: tuple[np.ndarray, np.ndarray], name: str = "text") -> DataFrame:
    """df with the main text of each whole page: the stretches of text whose marginal is at least a half, in page order.

    Character references are decoded; white space inside a block becomes one space; blocks are joined by one space.
    Tags are read as HTML reads them, in time linear in the page, however broken it is. Scripts, styles, what is no text (as svg, object or noscript), comments and markup go; behind an element of these
    that is never closed the page goes on, but for code. A null or empty page, and one without
    content, has the empty text. A column of that name is replaced.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        w, edge = held.value

        def work(pages: pa.Array):
            out: list[str] = []
            for at in range(0, len(pages), 200):
                forest = Forest([Tree(x or "") for x in pages.slice(at, 200).to_pylist()])
                p, _ = forest.marginals(w, edge)
                for t, a in zip(forest.trees, forest.base, strict=False):
                    out.append(" ".join([x for x, q in zip(t.text, p[a : a + len(t.text)], strict=True) if x is not None and q >= 0.5]))
            return [out]

        return work

    return append_columns(df, make, T.StructType([T.StructField(name, T.StringType())]), {"page": page})
