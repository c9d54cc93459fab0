"""Main text of web pages: gradient-boosted trees over features of DOM nodes, decoded over the tree.

Each block element is a node. Trees score nodes by subtree density, attribute words, depth and siblings; a pass over the DOM
then picks the best assignment in which a node that is article has only article below it, and one that is not has
none, so ancestors and descendants never contradict each other.

The trees are learned from a bounded sample of the given pages. What is article there is read from their markup; as that would
teach the markup of one site only, the texts of each sampled page are also laid out anew in several forms that
sites use (:func:`relayout`), with menus, sidebars, notices, adverts, forms and reader comments made of the page's other texts.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import materialise

#: Pages the trees are fitted on, by the order of a hash, and new layouts of each.
SAMPLE_PAGES = 500
LAYOUTS = 4
TREES = 30
DEPTH = 5
MIXED_COST = 0.5
#: Sampled pages and layouts in one partition of the fit: some 20,000 nodes. Each level of a tree shuffles a histogram per partition.
FIT_PAGES = 500
FLUSH_CHARS = 8 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MAIN_MARK = re.compile(r"\bdata-main\b")
_PART = re.compile(r"[a-z]+")

BLOCKS = frozenset(
    "html body div section article main aside nav header footer p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot "
    "tr td th form fieldset blockquote pre figure figcaption address details summary button label ins dialog center".split()
)
VOID = frozenset("br img meta link input hr area base col embed source track wbr param".split())
#: A start tag of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"button", "label", "ins"}
#: A start tag closes an open one of the same group up to the nearest of the containers.
SAME_LEVEL = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
              "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

MAIN_TAGS = frozenset(["article", "main"])
SIDE_TAGS = frozenset("nav header footer aside form fieldset button label ins dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_WORDS = ("article", "content", "post", "entry", "story", "body", "main", "text", "page", "blog", "hentry", "prose")
SIDE_WORDS = (
    "nav", "menu", "foot", "head", "side", "ad", "ads", "advert", "adsby", "sponsor", "promo", "banner", "cookie", "consent", "gdpr", "notice",
    "alert", "popup", "modal", "overlay", "share", "social", "related", "recommend", "widget", "bread", "crumb", "login", "signup", "subscribe",
    "newsletter", "search", "form", "tool", "pager", "pagination", "tag", "tags", "meta", "legal", "copyright", "skip", "toc", "logo",
)
COMMENT_WORDS = ("comment", "reply", "replies", "disqus", "discuss", "respond", "reader", "thread", "feedback", "review", "guestbook")
_EXACT = frozenset(["ad", "ads", "tag", "tags", "nav", "side", "head", "foot", "text", "page", "post", "main", "body", "meta", "toc", "tool"])


def _hits(parts: list[str], words: tuple[str, ...]) -> int:
    return sum(any(p == w if w in _EXACT else p.startswith(w) for w in words) for p in parts)


class Dom:
    """Block nodes of a page in document order (a parent before its children) and the blocks of text in page order."""

    def __init__(self, page: str):
        self.tag, self.parent, self.depth, self.marked = ["#page"], [-1], [0], [False]
        self.words: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.blocks: list[tuple[int, str, int]] = []  # owner, text, characters in links
        self._buffer: list[str] = []
        self._links = 0
        stack, open_links, at = [0], 0, 0
        for token in _TOKEN.finditer(page):
            if token.start() > at:
                self._add(page[at : token.start()], open_links)
            at = token.end()
            name = (token.group(3) or "").lower()
            if not name:
                continue
            closing = bool(token.group(2))
            if name == "a":
                open_links = 0 if closing else 1
            elif name == "br":
                self._buffer.append(" ")
            elif name in BLOCKS:
                self._end_block(stack[-1])
                if closing:
                    open_links = 0
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == name:
                            del stack[k:]
                            break
                else:
                    self._close_implied(stack, name)
                    stack.append(self._open(stack[-1], name, token.group(4) or ""))
        if at < len(page):
            self._add(page[at:], open_links)
        self._end_block(stack[-1])

    def _add(self, text: str, linked: int) -> None:
        self._buffer.append(text)
        if linked:
            self._links += len(text.strip())

    def _end_block(self, owner: int) -> None:
        if self._buffer:
            text = " ".join(entities.unescape("".join(self._buffer)).split())
            if text:
                self.blocks.append((owner, text, min(self._links, len(text))))
            self._buffer = []
            self._links = 0

    def _close_implied(self, stack: list[int], name: str) -> None:
        if name in ENDS_PARAGRAPH:
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[k]]
                if tag == "p":
                    del stack[k:]
                    break
                if tag not in ("button", "label", "ins"):
                    break
        if name in SAME_LEVEL:
            group, until = SAME_LEVEL[name]
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[k]]
                if tag in until:
                    break
                if tag in group:
                    del stack[k:]
                    break

    def _open(self, parent: int, name: str, attributes: str) -> int:
        parts: list[str] = []
        if "=" in attributes:
            for found in _ATTRIBUTE.finditer(attributes):
                parts += _PART.findall((found.group(2) or found.group(3) or found.group(4) or "").lower())
        self.tag.append(name)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.words.append((_hits(parts, MAIN_WORDS), _hits(parts, SIDE_WORDS), _hits(parts, COMMENT_WORDS)))
        self.marked.append(name == "article" or bool(attributes and _MAIN_MARK.search(attributes)))
        return len(self.tag) - 1

    def features(self) -> np.ndarray:
        """One row per node."""
        n = len(self.tag)
        parent, depth = np.array(self.parent), np.array(self.depth, float)
        chars, linked, count, marks, blocks = np.zeros((5, n))
        first, before = np.full(n, np.inf), 0
        for owner, text, links in self.blocks:
            size = len(text)
            chars[owner] += size
            linked[owner] += links
            count[owner] += text.count(" ") + 1
            marks[owner] += text.count(".") + text.count(",") + text.count("?") + text.count("!") + text.count(";")
            blocks[owner] += 1
            first[owner] = min(first[owner], before)
            before += size
        total = max(before, 1)
        own = chars.copy()
        words = np.array(self.words, float)
        is_p = np.array([t in ("p", "blockquote", "pre") for t in self.tag], float)
        is_item = np.array([t in ("li", "dt", "dd", "td", "th") for t in self.tag], float)
        is_head = np.array([t in HEADINGS for t in self.tag], float)
        is_main = np.array([t in MAIN_TAGS for t in self.tag], float)
        is_side = np.array([t in SIDE_TAGS for t in self.tag], float)
        nodes, children = np.ones(n), np.zeros(n)
        below = np.hstack([words, is_p[:, None], is_item[:, None], is_side[:, None]])
        for k in range(n - 1, 0, -1):
            p = parent[k]
            for column in (chars, linked, count, marks, blocks, nodes):
                column[p] += column[k]
            below[p] += below[k]
            first[p] = min(first[p], first[k])
            children[p] += 1
        above = np.hstack([words, is_main[:, None], is_side[:, None]])
        inherited = np.zeros_like(above)
        index, same, group = np.zeros(n), np.zeros(n), np.zeros(n)
        seen: dict[int, int] = {}
        tags: dict[tuple[int, str], int] = {}
        for k in range(1, n):
            p = parent[k]
            inherited[k] = inherited[p] + above[p]
            index[k] = seen[p] = seen.get(p, -1) + 1
            tags[p, self.tag[k]] = tags.get((p, self.tag[k]), 0) + 1
            group[p] += np.log1p(chars[k])
        for k in range(1, n):
            same[k] = tags[parent[k], self.tag[k]]
        siblings = np.maximum(np.where(parent >= 0, children[parent], 1), 1)
        mean_sibling = np.where(parent >= 0, group[parent], 0) / siblings
        some = np.maximum(chars, 1)
        start = np.where(np.isfinite(first), first, 0) / total
        columns = [
            depth, np.log1p(chars), np.log1p(count), linked / some, np.log1p(chars / nodes), chars / total, start, start + chars / total,
            np.log1p(children), index / siblings, np.log1p(siblings), mean_sibling, np.log1p(chars) - mean_sibling, marks / np.maximum(count, 1),
            count / np.maximum(blocks, 1), np.log1p(own), same / siblings,
            words[:, 0], words[:, 1], words[:, 2], inherited[:, 0], inherited[:, 1], inherited[:, 2], inherited[:, 3], inherited[:, 4],
            below[:, 0] - words[:, 0], below[:, 1] - words[:, 1], below[:, 2] - words[:, 2], np.log1p(below[:, 3]), np.log1p(below[:, 4]),
            below[:, 5] - is_side, is_p, is_item, is_head, is_main, is_side,
        ]
        return np.column_stack(columns)

    def labels(self) -> np.ndarray:
        """1 where all text below is marked as article, 0 where none is, -1 where both or no text is."""
        n = len(self.tag)
        inside = np.array(self.marked)
        for k in range(1, n):
            inside[k] |= inside[self.parent[k]]
        main, chars = np.zeros(n), np.zeros(n)
        for owner, text, _ in self.blocks:
            chars[owner] += len(text)
            main[owner] += len(text) * inside[owner]
        for k in range(n - 1, 0, -1):
            main[self.parent[k]] += main[k]
            chars[self.parent[k]] += chars[k]
        return np.where(chars == 0, -1, np.where(main == chars, 1, np.where(main == 0, 0, -1)))

    def decode(self, logit: np.ndarray) -> str:
        """The text of the best consistent assignment: article, not article, or mixed (free below) for each node."""
        n = len(self.tag)
        has_text = np.zeros(n, bool)
        for owner, _, _ in self.blocks:
            has_text[owner] = True
        yes, no, free = np.zeros(n), np.zeros(n), np.full(n, -MIXED_COST)
        alive = has_text.copy()
        for k in range(n - 1, -1, -1):
            if alive[k]:
                yes[k] += logit[k]
                no[k] -= logit[k]
                free[k] += abs(logit[k]) if has_text[k] else 0.0
            p = self.parent[k]
            if p >= 0 and alive[k]:
                alive[p] = True
                yes[p] += yes[k]
                no[p] += no[k]
                free[p] += max(yes[k], no[k], free[k])
        state = np.zeros(n, np.int8)  # 1 article, 0 not, 2 mixed
        for k in range(n):
            above = state[self.parent[k]] if k else 2
            state[k] = above if above != 2 else int(np.argmax([no[k], yes[k], free[k]]))
        keep = (state == 1) | ((state == 2) & (logit > 0))
        return " ".join(text for owner, text, _ in self.blocks if keep[owner])


FEATURES = 36


def _escape(text: str) -> str:
    return entities.escape(text, quote=False)


def relayout(dom: Dom, seed: int) -> str:
    """The texts of a page in another layout; the element with ``data-main`` holds the article."""
    rng = random.Random(seed)
    labels = dom.labels()
    main = [t for owner, t, _ in dom.blocks if labels[owner] == 1]
    side = [t for owner, t, _ in dom.blocks if labels[owner] == 0] or ["Home"]
    pick = lambda: rng.choice(side)
    piece = lambda: " ".join(rng.choice(main or side).split()[: rng.randint(5, 60)])
    links = lambda n: "".join(f'<li><a href="/{k}">{_escape(" ".join(pick().split()[:3]))}</a></li>' for k in range(n))
    named = lambda tag, names, body: f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">{body}</{tag}>'

    if rng.random() < 0.3:  # a short article among as much of everything else
        main = [" ".join(t.split()[: rng.randint(2, 14)]) for t in main[: rng.randint(1, 3)]]
    style = rng.randrange(3)
    if style == 0:
        body = "".join(f"<p>{_escape(t)}</p>" for t in main)
    elif style == 1:
        body = "".join(f"<div>{_escape(t)}</div>" for t in main)
    else:
        body = "".join(f"<p>{_escape(t)}" for t in main)
    if main and rng.random() < 0.7:
        body = f"<h1>{_escape(' '.join(main[0].split()[:8]))}</h1>" + body
    if rng.random() < 0.3:
        body += f"<ul><li>{_escape(piece())}</li><li>{_escape(piece())}</li></ul>"
    if rng.random() < 0.2:
        body += f"<blockquote>{_escape(piece())}</blockquote>"
    inner = ""
    if rng.random() < 0.3:
        inner = named("div", ["ad", "advert inline-ad", "promo", "share-buttons social"], _escape(pick()))
    holder = rng.choice(
        ['<article data-main>%s</article>', '<article data-main>%s</article>', '<main data-main>%s</main>', '<div class="post-content" data-main>%s</div>', '<div id="content" data-main>%s</div>',
         '<div class="entry" data-main>%s</div>', '<section class="story-body" data-main>%s</section>', '<div data-main>%s</div>', '<div class="article-text" data-main>%s</div>',
         '<td data-main>%s</td>']
    )
    center = holder % body
    if rng.random() < 0.4:
        center = f'<div class="{rng.choice(["wrap", "page", "container", "row", "main-column"])}">{center}{inner}</div>'
    else:
        center += inner

    top, bottom = [], []
    if rng.random() < 0.7:
        top.append(rng.choice([named("header", ["site", "top"], f"<a>{_escape(pick())}</a>"), named("div", ["header", "masthead", "site-header", "topbar"], _escape(pick()))]))
    if rng.random() < 0.8:
        menu = f"<ul>{links(rng.randint(3, 9))}</ul>"
        top.append(rng.choice([f"<nav>{menu}</nav>", named("div", ["menu", "navbar", "topnav", "main-menu"], menu), f'<ul class="menu">{links(5)}</ul>']))
    if rng.random() < 0.3:
        top.append(named("div", ["breadcrumbs", "breadcrumb"], f"<a>{_escape(pick())}</a> / <a>{_escape(pick())}</a>"))
    if rng.random() < 0.5:
        top.append(named(rng.choice(["div", "section", "dialog"]), ["cookie-notice", "consent", "notice", "gdpr-banner", "alert", "popup"], f"<p>{_escape(piece())}</p><button>OK</button>"))
    if rng.random() < 0.5:
        rng.choice([top, bottom]).append(named(rng.choice(["div", "ins"]), ["ad", "ads", "advert", "sponsored", "banner-ad", "promo"], _escape(piece())))
    if rng.random() < 0.5:
        bar = f"<h3>{_escape(pick())}</h3><ul>{links(4)}</ul><p>{_escape(piece())}</p>"
        rng.choice([top, bottom]).append(rng.choice([f"<aside>{bar}</aside>", named("div", ["sidebar", "side-bar", "widget-area", "rightcol sidebar"], bar)]))
    if rng.random() < 0.5:
        form = f'<form><label>{_escape(pick())}</label><input type="text"><button>{_escape(" ".join(pick().split()[:2]))}</button></form>'
        rng.choice([top, bottom]).append(rng.choice([form, named("div", ["newsletter", "subscribe", "search", "login"], f"<p>{_escape(piece())}</p>{form}")]))
    if rng.random() < 0.5:
        each = "".join(f'<{t} class="comment"><p>{_escape(piece())}</p></{t}>' for t in [rng.choice(["div", "li"])] for _ in range(rng.randint(1, 6)))
        plain = "".join(f"<div><b>{_escape(pick().split()[0])}</b><p>{_escape(piece())}</p></div>" for _ in range(3))
        bottom.append(rng.choice([named("section", ["comments", "reader-comments"], each), named("div", ["comments", "discussion", "replies", "comment-list"], rng.choice([each, plain])), f'<ol class="commentlist">{each}</ol>']))
    if rng.random() < 0.4:
        bottom.append(named("div", ["related", "recommended", "related-posts"], f"<h4>{_escape(pick())}</h4><ul>{links(4)}</ul>"))
    if rng.random() < 0.8:
        bottom.append(rng.choice([f"<footer>{_escape(pick())}</footer>", named("div", ["footer", "site-footer", "copyright"], _escape(pick()))]))
    if holder.startswith("<td"):
        return f"<html><body><table><tr><td>{''.join(top)}</td>{center}<td>{''.join(bottom)}</td></tr></table></body></html>"
    return f"<html><head><title>x</title></head><body>{''.join(top)}{center}{''.join(bottom)}</body></html>"


class Trees:
    """Boosted trees as flat arrays; the margin of a row is the weighted sum of its leaves."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], weights: list[float]):
        self.trees, self.weights = trees, weights

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            out += weight * value[at]
        return out


def _flatten(node) -> tuple[np.ndarray, ...]:
    feature, threshold, left, right, value = [], [], [], [], []

    def visit(x) -> int:
        k = len(feature)
        inner = x.subtreeDepth() > 0
        feature.append(x.split().featureIndex() if inner else -1)
        threshold.append(x.split().threshold() if inner else 0.0)
        value.append(x.prediction())
        left.append(0)
        right.append(0)
        if inner:
            left[k], right[k] = visit(x.leftChild()), visit(x.rightChild())
        return k

    visit(node)
    return tuple(np.array(c) for c in (feature, threshold, left, right, value))


def train(pages: DataFrame, html: str = "html", rows: int = SAMPLE_PAGES, layouts: int = LAYOUTS, seed: int = 1) -> Trees:
    """Fit the trees on at most ``rows`` different pages, by the order of a hash of the page, and ``layouts`` new layouts of each.

    Without a page that marks its article there is nothing to learn, and no node is article.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    placed = pages.select(body.alias("html"), F.xxhash64(F.lit(seed), body).alias("place"))
    # first the last place of the sample, from hashes alone; then only pages up to it move
    last = placed.select("place").distinct().orderBy("place").limit(rows).agg(F.max("place")).first()[0]
    sample = placed.where(F.col("place") <= (last if last is not None else 0)).dropDuplicates(["place"])
    # the sample is bounded, so its partitions are too, whatever the session and the table have
    parts = math.ceil(rows * (1 + layouts) / FIT_PAGES)
    sample = sample.repartition(parts, "place").sortWithinPartitions("place")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for page, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                dom = Dom(page)
                versions = [dom]
                if (dom.labels() == 1).any():
                    versions += [Dom(relayout(dom, place * layouts + k)) for k in range(layouts)]
                for version in versions:
                    y = version.labels()
                    xs.append(version.features()[y >= 0])
                    ys.append(y[y >= 0])
            x = np.concatenate(xs) if xs else np.zeros((0, FEATURES))
            y = np.concatenate(ys) if ys else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(y.astype(float))], ["x", "label"])

    told = materialise(sample.mapInArrow(describe, "x array<double>, label double"), "html-nodes")
    kinds = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    if len(kinds) < 2:
        only = np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.array([-1.0])
        return Trees([only], [1.0])
    told = told.select(array_to_vector("x").alias("features"), "label").coalesce(parts)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, cacheNodeIds=False, checkpointInterval=-1).fit(told)
    return Trees([_flatten(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights))


def extract(pages: DataFrame, model: Trees, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the html by default) with ``text``, the article of each page; no shuffle.

    A null or empty page, or one without article, has an empty text. A column named text is replaced.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html, "text")]
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = pages.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            begin = 0
            while begin < len(column):
                doms, end, held = [], begin, 0
                while end < len(column) and held < FLUSH_CHARS and end - begin < 256:
                    page = column[end].as_py() or ""
                    held += len(page)
                    doms.append(Dom(page))
                    end += 1
                rows = [dom.features() for dom in doms]
                # the margin of the trees is half the log odds
                logits = np.split(2 * trees.margin(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts = [dom.decode(logit) for dom, logit in zip(doms, logits)]
                kept = [batch.column(k).slice(begin, end - begin) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*keep, "text"])
                begin = end

    return pages.select(*keep, pages[html].alias("_html")).mapInArrow(run, schema)
