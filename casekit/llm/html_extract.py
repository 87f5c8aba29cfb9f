"""Main text of web pages by a tree-structured graphical model.

Every block element and every run of text of a page is a binary variable,
content or not.  Unary potentials come from tag, attribute words, text shape
and link share; parent-child potentials let a decision about a container reach
its texts.  Sum-product messages run up and down the tree and give exact
marginals; texts with a marginal over 0.5 are content, in page order.

The model is trained by maximum likelihood (observed minus expected features,
the expectations by the same message passing) on labelled pages: those that
mark their main part themselves (``article``, ``main``, ``role="main"``,
``itemprop="articleBody"``).  Every labelled page is used twice, once with its
marks hidden, so that text shape and link share carry weight on pages without
any.  Training reads a bounded sample, the ``train_pages`` pages with the
smallest seeded hashes of those with ``train_chars`` characters at most;
extraction reads every page whole.

Defined results: a null or empty page gives an empty text.  Rows are judged
one by one, so repeated rows and ties give one result each; an empty table
gives an empty result.  Extra columns are carried along.  Without labelled
pages in the sample the built-in prior weights are used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.functions.workers import ship_with_tasks
from casekit.llm.html_tree import TEXT, Tree, parse

ship_with_tasks(__name__)

TRAIN_PAGES = 400
TRAIN_CHARS = 1 << 20  # of a training page: the sample is bounded in bytes too
CHUNK_CHARS = 4 << 20

# Words in class, id and role that name a part of a page.
GOOD_CUES = re.compile(r"\b(article|articlebody|content|entry|main|post|story|body|text|prose)(s|-?body|-?content|-?text)?\b")
# A rights line: the sign, a year behind the word, or the usual phrase.
LEGAL = re.compile(r"(?i)©|\(c\)\s*(19|20)\d\d|^\W*copyright\b.{0,30}\b(19|20)\d\d\b|\ball rights reserved\b")
BAD_CUES = re.compile(
    r"(\b|_)(ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|side|aside|footer|foot|header|masthead|"
    r"cookie\w*|consent|notice|alert|popup|modal|overlay|comments?|replies|respond|discussion|form|login|signup|search|"
    r"subscribe|newsletter|share|social|related|recommend\w*|pagination|pager|widget|toolbar|copyright|legal|disclaimer|"
    r"skip|hidden|complementary|contentinfo|navigation)(\b|_)")
TAG_GROUPS = {
    "main": ("article", "main"), "nav": ("nav", "menu"), "header": ("header",), "footer": ("footer", "address"),
    "aside": ("aside", "dialog", "details"),
    "form": ("form", "button", "select", "option", "label", "fieldset", "legend", "optgroup", "datalist", "output"),
    "p": ("p",), "heading": ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), "list": ("ul", "ol", "li", "dl", "dt", "dd"),
    "table": ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"),
    "quote": ("blockquote", "pre", "figure", "figcaption"), "head": ("head",), "text": (TEXT,),
}
_GROUP_OF = {tag: i for i, tags in enumerate(TAG_GROUPS.values()) for tag in tags}
_N_GROUPS = len(TAG_GROUPS) + 1  # the last: div, section and all others
SHAPE = ["bias", "good_cue", "bad_cue", "log_chars", "links", "sentence_end", "no_end", "short", "commas", "legal",
         "linky_list"]
N_FEATURES = _N_GROUPS + len(SHAPE)
_MARKS = [_GROUP_OF[t] for t in ("article", "nav", "header", "footer", "aside", "form")] + [_N_GROUPS + 1, _N_GROUPS + 2]
_NOISE_TAGS = frozenset(t for g in ("nav", "header", "footer", "aside", "form", "head") for t in TAG_GROUPS[g])


def features(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Features per node, and its kind: 1 if it names itself a part apart (by
    tag, or by attribute words on less than half of the page's text), 2 if its
    parent does, else 0.  The kinds have pair potentials of their own."""
    n = len(tree.parent)
    x = np.zeros((n, N_FEATURES), np.float32)
    chars, links = np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):  # children come after their parents
        chars[i] += len(tree.text[i])
        links[i] += tree.linked[i]
        if i:
            chars[tree.parent[i]] += chars[i]
            links[tree.parent[i]] += links[i]
    share = links / np.maximum(chars, 1)
    for i in range(n):
        tag, cue, text = tree.tag[i], tree.cue[i], tree.text[i]
        x[i, _GROUP_OF.get(tag, _N_GROUPS - 1)] = 1
        if cue:
            bad = BAD_CUES.search(cue) is not None
            x[i, _N_GROUPS + 2] = bad
            x[i, _N_GROUPS + 1] = not bad and GOOD_CUES.search(cue) is not None
        if tag == TEXT:
            end = text.rstrip("'\")]»”’")[-1:] in (".", "!", "?", "…", ":", ";", "。")
            x[i, _N_GROUPS + 5:_N_GROUPS + 10] = (
                end, not end, len(text) < 25, min(text.count(","), 10) / 10,
                len(text) < 300 and LEGAL.search(text) is not None)
    s = _N_GROUPS
    x[:, s] = 1
    x[:, s + 3] = np.log1p(chars) / 8
    x[:, s + 4] = share
    x[:, s + 10] = share > 0.5
    kind = np.zeros(n, np.int64)
    for i in range(1, n):
        if tree.tag[i] in _NOISE_TAGS or (x[i, _N_GROUPS + 2] and 2 * chars[i] < chars[0]):
            kind[i] = 1
        elif kind[tree.parent[i]] == 1:
            kind[i] = 2
    return x, kind


def labels(tree: Tree) -> np.ndarray | None:
    """Content marks by the page's own main part; None where it has none."""
    inside, noise, found = [], [], False
    for i, p in enumerate(tree.parent):
        tag, cue = tree.tag[i], tree.cue[i]
        mark = tag in ("article", "main") or "articlebody" in cue.split() or cue == "main"
        found |= mark
        inside.append(mark or (p >= 0 and inside[p]))
        noise.append((p >= 0 and noise[p]) or tag in _NOISE_TAGS or (tag != TEXT and BAD_CUES.search(cue) is not None))
    return np.array([a and not b for a, b in zip(inside, noise, strict=True)]) if found else None


class Forest:
    """Several trees as one set of arrays, passed over level by level."""

    def __init__(self, parents: list[np.ndarray], kind: np.ndarray):
        self.kind = kind
        offset = np.cumsum([0] + [len(p) for p in parents])
        self.roots = offset[:-1]
        self.parent = np.concatenate([np.where(p >= 0, p + o, -1) for p, o in zip(parents, offset[:-1], strict=True)])
        depth = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1))
        self.levels = np.split(order, cuts)

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) per node and P(parent, child) per node with a parent.

        ``unary`` is the log odds of content, ``pair[k, p, c]`` the log
        potential for a child of kind ``k``.
        """
        n = len(unary)
        own = np.zeros((n, 2))
        own[:, 1] = unary  # potential and messages from below
        up = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            edge = pair[self.kind[level]]
            m = np.logaddexp(own[level, :1] + edge[:, :, 0], own[level, 1:] + edge[:, :, 1])
            up[level] = m
            np.add.at(own, self.parent[level], m)
        down = np.zeros((n, 2))
        both = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            above = own[p] + down[p] - up[level]
            joint = above[:, :, None] + pair[self.kind[level]]
            down[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            joint = joint + own[level][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            both[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        odds = (own + down)[:, 1] - (own + down)[:, 0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500))), both


def prior_weights() -> tuple[np.ndarray, np.ndarray]:
    """Where training starts and what it is drawn to; features that no
    labelled page shows keep these weights."""
    w = np.zeros(N_FEATURES)
    for group, value in (("main", 4), ("nav", -6), ("header", -5), ("footer", -6), ("aside", -6), ("form", -6), ("p", 1),
                         ("head", -6)):
        w[list(TAG_GROUPS).index(group)] = value
    w[_N_GROUPS + 1], w[_N_GROUPS + 2], w[_N_GROUPS + 4], w[_N_GROUPS + 9] = 1, -6, -3, -2
    return w, np.array([
        [[1.0, -1.0], [-1.0, 1.0]], [[0.5, -0.5], [0.0, 0.0]], [[10.0, -10.0], [0.0, 0.0]]])


def train(pages: list[str], steps: int = 200, rate: float = 0.15, l2: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Weights by maximum likelihood on the labelled ones among ``pages``."""
    w, pair = prior_weights()
    xs, ys, parents, ks = [], [], [], []
    for page in pages:
        tree = parse(page)
        y = labels(tree)
        if y is None:
            continue
        x, kind = features(tree)
        hidden = x.copy()
        hidden[:, _N_GROUPS - 1] += hidden[:, _MARKS[:6]].sum(axis=1)
        hidden[:, _MARKS] = 0
        xs += [x, hidden]
        ys += [y, y]
        ks += [kind, np.zeros_like(kind)]
        parents += [np.array(tree.parent)] * 2
    if not xs:
        return w, pair
    x, y = np.concatenate(xs).astype(float), np.concatenate(ys).astype(int)
    forest = Forest(parents, np.concatenate(ks))
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros_like(pair)
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    # Adam on the mean gradient
    prior = np.concatenate([w, pair.ravel()])
    theta, m, v = prior.copy(), 0.0, 0.0
    for t in range(1, steps + 1):
        p, both = forest.marginals(x @ theta[:N_FEATURES], theta[N_FEATURES:].reshape(pair.shape))
        expected = np.stack([both[child][forest.kind[child] == k].sum(axis=0) for k in range(len(pair))])
        grad = np.concatenate([x.T @ (y - p), (seen - expected).ravel()]) / len(parents) - l2 * (theta - prior)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return theta[:N_FEATURES], theta[N_FEATURES:].reshape(pair.shape)


def extract(pages: list[str], weights: tuple[np.ndarray, np.ndarray]) -> list[tuple[str, int, float]]:
    """(text, blocks, mean marginal of the blocks) of every page."""
    trees = [parse(p) for p in pages]
    both = [features(t) for t in trees]
    forest = Forest([np.array(t.parent) for t in trees], np.concatenate([k for _, k in both]))
    p, _ = forest.marginals(np.concatenate([x for x, _ in both]) @ weights[0], weights[1])
    out = []
    for tree, root in zip(trees, forest.roots.tolist(), strict=True):
        kept = [(tree.text[i], p[root + i]) for i in range(len(tree.tag)) if tree.tag[i] == TEXT and p[root + i] > 0.5]
        out.append((" ".join(t for t, _ in kept), len(kept), float(np.mean([q for _, q in kept])) if kept else 0.0))
    return out


def fit(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES, seed: int = 11,
        train_chars: int = TRAIN_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Train on the ``train_pages`` different pages with the smallest seeded
    hashes, of those with ``train_chars`` characters at most."""
    draw = pages.filter(F.length(html_col).between(1, train_chars)).select(F.xxhash64(F.lit(seed), html_col).alias("h"), F.col(html_col).alias("p"))
    # Hashes decide first; then only the drawn pages, one of each, travel.
    hashes = [r.h for r in draw.select("h").distinct().orderBy("h").limit(train_pages).collect()]
    if not hashes:
        return prior_weights()
    drawn = draw.filter(F.col("h") <= hashes[-1]).groupBy("h").agg(F.min("p").alias("p"))
    return train([r.p for r in sorted(drawn.collect(), key=lambda r: r.h)])


def main_text(html_col: Column | str, weights: tuple[np.ndarray, np.ndarray]) -> Column:
    """Column: struct(text, n_blocks, confidence) of a page."""
    @F.arrow_udf("struct<text:string,n_blocks:bigint,confidence:double>")
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, chunk, size = [], [], 0
            for page in batch:
                chunk.append(page.as_py() or "")
                size += len(chunk[-1])
                if size >= CHUNK_CHARS:
                    rows += extract(chunk, weights)
                    chunk, size = [], 0
            if chunk:
                rows += extract(chunk, weights)
            text, blocks, confidence = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(text, pa.string()), pa.array(blocks, pa.int64()), pa.array(confidence, pa.float64())],
                ["text", "n_blocks", "confidence"])

    return work(html_col)
