"""Main text of web pages: boosted trees score DOM nodes, a tree decoder makes the choices agree, text follows.

The trees are fitted by Spark ML on a bounded sample of the pages themselves. Labels come from layouts built out of
the sampled pages' own parts (headline, paragraphs, links, notes), so each node's class is known by construction:
the layouts vary wrappers, class names, and what stands around and inside the article. Every page is then parsed,
scored and decoded whole in one pass without a shuffle.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordaudit.session import ship, written

#: Bounds of the training set: pages sampled, layouts built from each, characters of a page that may be sampled.
SAMPLE_PAGES, LAYOUTS, SAMPLE_CHARS = 200, 4, 100_000
#: Pages of built-in sentences in every training set, so that a small or empty table has one too.
SEED_PAGES = 64
TREES, DEPTH = 24, 5

#: A quote opens a value only after "=" and the value has any length; nothing is matched twice, so a tag costs one scan.
#: Where a value is never closed, the tag ends at its first ">".
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+)>"""
                    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "head", "select", "option", "object", "canvas"}
_RAW_TEXT = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong "
              "sub sup time tt u var wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: An open paragraph ends where one of these begins.
_ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
              "menu nav ol p pre section table ul".split())
_SCOPE = set("ul ol table dl td th div section article aside body".split())

#: Words in class, id and role attributes.
_AGAINST = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs bottom byline caption comment comments consent cookie "
               "cookies credit disclaimer discussion dialog disqus feedback flash foot footer form gdpr hd head header hidden legal login "
               "masthead menu message modal nav navbar navigation newsletter note notice notification outbrain overlay pager pagination "
               "paywall popular popup privacy promo promoted promotion recommended related replies reply respond rss search share sharing "
               "side sidebar signup skip social sponsor sponsored subscribe subscription survey tags teaser toolbar tools top "
               "trending widget alert contentinfo complementary".split())
_FOR = set("article articlebody body blog content entry main maincontent page post postcontent richtext story storybody text prose hentry".split())
_ATTRIBUTES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

_GROUPS = (
    {"article", "main"}, {"section", "div", "td", "center"}, {"p", "blockquote", "pre"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"},
    {"li", "dd", "dt"}, {"ul", "ol", "dl", "menu"}, {"a"}, {"nav"}, {"header"}, {"footer"}, {"aside"},
    {"form", "button", "input", "label", "fieldset", "legend", "textarea", "select", "option"}, {"table", "tbody", "tr", "th"},
    {"body", "html", "#root"}, {"figure", "figcaption", "img", "picture"}, {"dialog"}, _INLINE - {"a", "label"},
)
_GROUP_OF = {tag: i for i, group in enumerate(_GROUPS) for tag in group}
#: Groups that ancestors hand down to their subtree.
_HANDED = (0, 8, 9, 10, 11, 12, 16)


class Page:
    """Nodes of a page in document order, and its text pieces with the block and node they belong to."""

    __slots__ = ("tags", "parents", "depths", "against", "favour", "texts", "owners", "blocks", "marks")

    def __init__(self, source: str):
        self.tags, self.parents, self.depths, self.against, self.favour = ["#root"], [0], [0], [0], [0]
        self.texts, self.owners, self.blocks, self.marks = [], [], [], []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, raw, block, at, n = [0], 0, 0, 0, len(source)
        tags = self.tags
        #: Places in the stack of the open elements of each name, so that no tag has to walk the stack.
        places: dict[str, list[int]] = defaultdict(list)

        def cut(keep: int) -> int:
            """Closes all elements from a place of the stack on; the number of raw ones among them."""
            hidden = 0
            while len(stack) > keep:
                gone = tags[stack.pop()]
                places[gone].pop()
                hidden += gone in _RAW
            return hidden

        def last(names: set[str]) -> int:
            return max((places[t][-1] for t in names if places[t]), default=0)

        while at < n:
            found = _TOKEN.search(source, at)
            stop = found.start() if found else n
            if stop > at and not raw:
                text = source[at:stop]
                if not text.isspace():
                    self.texts.append(html.unescape(text) if "&" in text else text)
                    self.owners.append(stack[-1])
                    self.blocks.append(block)
                elif self.texts and self.blocks[-1] == block and self.texts[-1][-1:] != " ":
                    self.texts[-1] += " "
            if not found:
                break
            at = found.end()
            slash, tag, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                if places[tag]:
                    raw -= cut(places[tag][-1])
                if tag not in _INLINE:
                    block += 1
                continue
            if tag == "br":
                if self.texts and self.blocks[-1] == block and self.texts[-1][-1:] != " ":
                    self.texts[-1] += " "
                continue
            if tag not in _INLINE:
                block += 1
            if tag in _ENDS_P or tag in _CLOSES:
                nearest = last(_CLOSES.get(tag, {"p"}))
                if nearest and nearest >= last(_SCOPE):
                    raw -= cut(nearest)
            if tag == "body" and raw:  # a head that was never closed
                cut(1)
                raw = 0
            node = len(tags)
            against = favour = 0
            if rest and "=" in rest or "hidden" in rest:
                for value in _ATTRIBUTES.findall(rest):
                    for piece in _PIECE.findall(value):
                        piece = piece.lower()
                        against += piece in _AGAINST
                        favour += piece in _FOR
                against += 3 * bool(_HIDDEN.search(rest))
                if "data-mark" in rest:
                    self.marks.append((node, "data-mark=1" in rest))
            tags.append(tag)
            self.parents.append(stack[-1])
            self.depths.append(len(stack))
            self.against.append(against)
            self.favour.append(favour)
            if tag in _VOID:
                continue
            if tag in _RAW_TEXT:
                end = _RAW_TEXT[tag].search(source, at)
                at = end.end() if end else n
                continue
            places[tag].append(len(stack))
            stack.append(node)
            raw += tag in _RAW


@dataclass
class Forest:
    """Boosted trees as arrays: (feature, threshold, left child, right child, value) per node, by tree."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                goes_left = x[rows, feature[at]] <= threshold[at]
                at = np.where(goes_left, left[at], right[at])
            total += value[at]
        return total


def export(model: GBTClassificationModel) -> Forest:
    trees = []
    for tree, weight in zip(model.trees, model.treeWeights):
        rows: list[list[float]] = []

        def add(node, rows=rows, weight=weight) -> int:
            k = len(rows)
            rows.append([0, 0.0, k, k, weight * node.prediction()])
            if node.getClass().getSimpleName() == "InternalNode":
                rows[k][0], rows[k][1] = node.split().featureIndex(), node.split().threshold()
                rows[k][2] = add(node.leftChild())
                rows[k][3] = add(node.rightChild())
            return k

        add(tree._java_obj.rootNode())
        columns = list(zip(*rows))
        trees.append((np.array(columns[0], int), np.array(columns[1]), np.array(columns[2], int), np.array(columns[3], int), np.array(columns[4])))
    return Forest(trees)


class Batch:
    """Features of all nodes of many pages, computed level by level over the whole batch."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tags) for p in pages])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat(self.first[:-1], sizes)
        self.parent = np.concatenate([np.array(p.parents) for p in pages]) + shift
        depth = np.concatenate([np.array(p.depths) for p in pages])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        group = np.array([_GROUP_OF.get(t, -1) for p in pages for t in p.tags])
        against = np.concatenate([np.array(p.against) for p in pages])
        favour = np.concatenate([np.array(p.favour) for p in pages])
        n = len(group)

        owner = np.concatenate([np.array(p.owners, int) + f for p, f in zip(pages, self.first)]).astype(int)
        texts = [t for p in pages for t in p.texts]
        self.owner = owner
        own = np.bincount(owner, np.array([len(t) for t in texts], float), n)
        words = np.bincount(owner, np.array([t.count(" ") + 1 for t in texts], float), n)
        marks = np.bincount(owner, np.array([t.count(".") + t.count(",") for t in texts], float), n)
        in_link = self._down(group == 7)
        sums = np.stack([own, words, marks, own * in_link, np.ones(n), (group == 2).astype(float), (group == 5).astype(float)], 1)
        for level in self.levels[:0:-1]:
            np.add.at(sums, self.parent[level], sums[level])
        chars, n_words, n_marks, linked, nodes, n_p, n_li = sums.T
        # Sibling statistics: a parent's children share them.
        child = np.concatenate(self.levels[1:]) if len(self.levels) > 1 else np.empty(0, int)
        family = np.maximum(np.bincount(self.parent[child], minlength=n), 1)
        mean = np.bincount(self.parent[child], chars[child], n) / family
        most = np.zeros(n)
        np.maximum.at(most, self.parent[child], chars[child])
        page = np.repeat(np.arange(len(pages)), sizes)
        total = np.maximum(chars[self.first[:-1]], 1)[page]
        place = (np.arange(n) - shift) / sizes[page]
        up = self.parent
        columns = [
            *[(group == g) for g in range(len(_GROUPS))], *[self._down(group == g) for g in _HANDED],
            against, favour, self._down(against > 0), self._down(favour > 0), depth, place,
            np.log1p(own), np.log1p(chars), chars / total, linked / np.maximum(chars, 1), n_marks / np.maximum(n_words, 1),
            chars / nodes, np.log1p(n_p), np.log1p(n_li), n_words / np.maximum(nodes, 1), family[up], np.log1p(mean[up]),
            chars / np.maximum(most[up], 1), (linked / np.maximum(chars, 1))[up], np.log1p(chars[up]),
        ]
        self.features = np.stack([np.asarray(c, float) for c in columns], 1)
        self.weight = 0.05 + np.log1p(own)

    def _down(self, flag: np.ndarray) -> np.ndarray:
        """Whether the node or an ancestor has the flag."""
        out = flag.copy()
        for level in self.levels[1:]:
            out[level] |= out[self.parent[level]]
        return out

    def decode(self, p: np.ndarray) -> np.ndarray:
        """Which nodes are content, by the best consistent choice for the whole tree.

        From the root down a path is first around, then inside, then cut out of the article, and never goes back: no
        node inside something cut out is content, and nothing inside the article is "around" it. Dynamic programming
        over the levels gives the assignment with the highest weighted log-likelihood.
        """
        p = np.clip(p, 1e-4, 1 - 1e-4)
        yes, no = self.weight * np.log(p), self.weight * np.log(1 - p)
        inside, around, cut = yes.copy(), no.copy(), no.copy()
        for level in self.levels[:0:-1]:
            up = self.parent[level]
            np.add.at(inside, up, np.maximum(inside[level], cut[level]))
            np.add.at(around, up, np.maximum(around[level], inside[level]))
            np.add.at(cut, up, cut[level])
        state = np.zeros(len(p), int)  # 0 around, 1 inside, 2 cut out
        roots = self.levels[0]
        state[roots] = (inside[roots] > around[roots]).astype(int)
        for level in self.levels[1:]:
            above = state[self.parent[level]]
            stays = np.where(inside[level] > cut[level], 1, 2)
            enters = np.where(inside[level] > around[level], 1, 0)
            state[level] = np.where(above == 0, enters, np.where(above == 1, stays, 2))
        return state == 1


def extract(sources: list[str | None], forest: Forest) -> list[str]:
    """Main text per page: blocks in page order, white space inside a block as one space, joined by one space."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    batch = Batch(pages)
    content = batch.decode(1 / (1 + np.exp(-2 * forest.margin(batch.features))))
    out, k = [], 0
    for page in pages:
        blocks: dict[int, list[str]] = {}
        for text, block in zip(page.texts, page.blocks):
            if content[batch.owner[k]]:
                blocks.setdefault(block, []).append(text)
            k += 1
        joined = (" ".join("".join(b).split()) for b in blocks.values())
        out.append(" ".join(b for b in joined if b))
    return out


# ---- training layouts -------------------------------------------------------------------------------------------

_SEED_TEXT = ("The council met on Tuesday evening to discuss the new bridge, which has been planned for several years.",
              "Work is expected to begin in spring. Residents asked about noise, traffic and the cost of the project.",
              "A second report, due in autumn, will describe the effects on the river and on the meadows behind the mill.")
_SEED_LINKS = ("Home", "News", "Sport", "About us", "Contact")
_NAMES = ("content", "post-content", "entry-content", "story-body", "article-body", "main-content", "post", "text", "blog-post")


def _layout(paragraphs: list[str], notes: list[str], links: list[str], draw: random.Random) -> str:
    """A page whose nodes carry data-mark=1 (content) or data-mark=0, built from a page's own parts."""
    e = html.escape
    pick = lambda options: options[draw.randrange(len(options))]
    note = lambda: e(pick(notes))
    prose = lambda: e(pick(paragraphs))

    def listed(n: int) -> str:
        return "<ul data-mark=0>" + "".join(f'<li data-mark=0><a data-mark=0 href="/x">{e(pick(links))}</a></li>' for _ in range(n)) + "</ul>"

    def named(tag: str, names: tuple[str, ...], body: str, mark: int = 0) -> str:
        attribute = pick(("class", "id"))
        return f'<{tag} {attribute}="{pick(names)}" data-mark={mark}>{body}</{tag}>'

    def boiler(kind: str) -> str:
        words = f"<p data-mark=0>{pick((note, prose))()}</p>" * draw.randint(1, 2)
        return {
            "nav": lambda: pick((f"<nav data-mark=0>{listed(6)}</nav>", named("div", ("menu", "navbar", "main-nav", "breadcrumbs"), listed(5)))),
            "header": lambda: pick((f"<header data-mark=0><div data-mark=0>{note()}</div></header>", f"<header data-mark=0><h2 data-mark=0>{note()}</h2>{words}</header>",
                                    named("div", ("header", "masthead", "top-bar"), f"<span data-mark=0>{note()}</span>"))),
            "footer": lambda: pick((f"<footer data-mark=0>&copy; {note()}</footer>", f"<footer data-mark=0>{words}</footer>",
                                    f"<footer data-mark=0>{listed(4)}<p data-mark=0>{note()}</p></footer>", named("div", ("footer", "page-footer", "legal"), words))),
            "aside": lambda: pick((f"<aside data-mark=0><h3 data-mark=0>{note()}</h3>{words}</aside>",
                                   named("div", ("sidebar", "related-posts", "widget", "trending"), words + listed(3)))),
            "ad": lambda: named("div", ("ad", "ads", "advert", "sponsored", "promo", "banner-ad"), pick((note(), words))),
            "notice": lambda: named("div", ("cookie-notice", "cookie-banner", "notice", "consent", "popup", "alert"), pick((note(), words))),
            "form": lambda: f"<form data-mark=0><label data-mark=0>{note()}</label><input data-mark=0><button data-mark=0>{e(pick(links))}</button></form>",
            "newsletter": lambda: named("div", ("newsletter", "subscribe", "signup", "share", "social"), words),
            "comments": lambda: named(pick(("div", "section")), ("comments", "comment-list", "discussion", "respond"), "".join(
                f'<div class="comment" data-mark=0><p data-mark=0>{prose()}</p></div>' for _ in range(draw.randint(1, 4)))),
        }[kind]()

    # Some articles say very little.
    brief = draw.random() < 0.25
    said = lambda: e(" ".join(pick(paragraphs).split()[:draw.randint(1, 5)])) if brief else prose()
    aside = lambda: e(" ".join(pick(notes).split()[:draw.randint(1, 4)])) if brief else note()
    body = [f"<h1 data-mark=1>{said()[:80]}</h1>"] if draw.random() < 0.9 else []
    for _ in range(draw.choice((1, 1, 2, 3, 5, 8, 12, 20))):
        body.append(pick((
            f"<p data-mark=1>{said()}</p>", f"<p data-mark=1>{said()}</p>", f"<p data-mark=1><b data-mark=1>{said()}</b><br></p>",
            f'<p data-mark=1>{said()} <a href="/y" data-mark=1>{e(pick(links))}</a> {aside()}</p>', f"<p data-mark=1>{aside()}</p>",
            f"<h2 data-mark=1>{aside()}</h2>", f"<blockquote data-mark=1>{said()}</blockquote>",
            f"<ul data-mark=1><li data-mark=1>{said()}</li><li data-mark=1>{aside()}</li></ul>",
            f"<div data-mark=1>{said()}</div>", f"<table data-mark=1><tr data-mark=1><td data-mark=1>{aside()}</td></tr></table>",
        )))
    for kind in ("ad", "aside", "newsletter", "form", "comments", "notice", "nav"):
        if draw.random() < 0.15:
            body.insert(draw.randint(0, len(body)), boiler(kind))
    inner = "".join(body)
    wrapped = pick((f"<article data-mark=1>{inner}</article>", f"<article data-mark=1>{inner}</article>", f"<main data-mark=1>{inner}</main>",
                    f"<main data-mark=1><article data-mark=1>{inner}</article></main>", named("div", _NAMES, inner, 1),
                    f'<article class="{pick(_NAMES)}" data-mark=1>{inner}</article>', named("section", _NAMES, inner, 1), inner))
    if draw.random() < 0.3:
        wrapped = f"<div>{wrapped}</div>"
    before = [boiler(k) for k in ("nav", "header", "notice", "ad") if draw.random() < 0.6]
    after = [boiler(k) for k in ("aside", "comments", "ad", "newsletter", "form", "footer", "notice") if draw.random() < 0.45]
    draw.shuffle(before)
    return f"<html><head><title>{note()}</title></head><body>{''.join(before)}{wrapped}{''.join(after)}</body></html>"


def labelled(source: str, seed: str, layouts: int = LAYOUTS) -> Iterator[tuple[list[float], float]]:
    """Features and class of every marked node of layouts made from one page's parts."""
    page = Page(source)
    blocks: dict[int, tuple[str, bool]] = {}
    for text, owner, block in zip(page.texts, page.owners, page.blocks):
        before = blocks.get(block, ("", False))
        blocks[block] = (before[0] + text, before[1] or page.tags[owner] == "a")
    pieces = [(" ".join(t.split()), a) for t, a in blocks.values()]
    paragraphs = [t for t, a in pieces if len(t) >= 60 and not a] + list(_SEED_TEXT)
    notes = [t for t, a in pieces if 0 < len(t) < 120 and not a] + [_SEED_TEXT[0][:40], _SEED_TEXT[2]]
    links = [t for t, a in pieces if t and a and len(t) < 60] + list(_SEED_LINKS)
    draw = random.Random(seed)
    for _ in range(layouts):
        built = Page(_layout(paragraphs, notes, links, draw))
        features = Batch([built]).features
        for node, content in built.marks:
            yield features[node].tolist(), float(content)


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, layouts: int = LAYOUTS, sample_chars: int = SAMPLE_CHARS) -> Forest:
    """Boosted trees fitted on about ``sample_pages`` pages, chosen by hash, of at most ``sample_chars`` characters."""
    ship(pages.sparkSession)
    total = max(pages.select("page_id").count(), 1)
    chosen = pages.filter((F.length("html") <= sample_chars) & (
        F.pmod(F.xxhash64("page_id", "url"), F.lit(total)) < sample_pages)).select(F.xxhash64("page_id", "url").alias("seed"), "html")
    seeded = chosen.sparkSession.range(SEED_PAGES).select(F.col("id").alias("seed"), F.lit("").alias("html"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x for s, h in zip(batch["seed"], batch["html"]) for x in labelled(h, str(s), layouts)]
            yield pd.DataFrame({"x": [f for f, _ in found], "label": [c for _, c in found]})

    data = written(chosen.unionByName(seeded).mapInPandas(rows, "x array<double>, label double"))
    data = data.coalesce(2)  # the sampled rows are few; the scan above keeps its partitions
    model = GBTClassifier(featuresCol="v", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11, maxBins=64).fit(
        data.select(array_to_vector("x").alias("v"), "label"))
    return export(model)


def main_text(pages: DataFrame, forest: Forest | None = None) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages``.

    A null or empty page has an empty text, a page of any length is read whole, repeated rows get the same text,
    other columns are ignored, and an empty table gives an empty result (the trees are then fitted on built-in
    sentences only). Null ids and urls are kept.
    """
    ship(pages.sparkSession)
    shipped = pages.sparkSession.sparkContext.broadcast(fit(pages) if forest is None else forest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sources, texts, start, size = batch["html"].tolist(), [], 0, 0
            for i, s in enumerate(sources):  # parts of bounded size, however long the pages are
                size += len(s or "")
                if size > 1 << 21 or i == len(sources) - 1:
                    texts += extract(sources[start:i + 1], shipped.value)
                    start, size = i + 1, 0
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    kept = pages.select("page_id", "url", "html")
    types = dict(kept.dtypes)
    return kept.mapInPandas(run, f"page_id {types['page_id']}, url {types['url']}, text string").withColumn(
        "n_chars", F.length("text").cast("long"))
