"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks at its block-level tags. Each block has features of its ancestors (tags, words of their
class and id) and of its text (length, links, punctuation), and the chain has weights for adjacent labels, start and
end. The weights are fitted to labelled pages by their likelihood, and pages are labelled by Viterbi's algorithm.

Labelled pages come from two sources. Pages made from a grammar of layouts carry their labels, and cover regions that
a corpus may seldom mark. Pages of the corpus, a bounded sample, are labelled where their markup leaves no doubt. Some
features are hidden at random while fitting, so that text features carry weight of their own.
"""

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.words import frugal

#: Tags that end a block, and tags whose contents are no text. Fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A quote opens a quoted value only after an equals sign; any other is a character like others, as is one that nothing closes.
ENDS = re.compile(r"=\s*([\"'])|>")
NAME = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
#: Elements whose contents are no text: up to their end tag, or without one to the end of the page, or only the tag itself.
RAW_TAGS = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "iframe", "textarea", "title", "template", "noscript", "svg")}
ENDS_ITSELF = frozenset(("template", "noscript", "svg"))


class _TagEnds:
    """Where the tag ends that is open at a place of the page, in time near linear over all its tags, closed or not."""

    def __init__(self, page: str):
        found = [(m.start(), m.end(), m[1]) for m in ENDS.finditer(page)]
        self.at = [f[0] for f in found]
        last = {q: page.rfind(q) for q in "\"'"}
        self.end = [-1] * (len(found) + 1)
        for k in range(len(found) - 1, -1, -1):
            start, after, quote = found[k]
            if quote is None:
                self.end[k] = start
            elif after > last[quote]:
                self.end[k] = self.end[k + 1]
            else:
                self.end[k] = self.end[bisect_left(self.at, page.index(quote, after) + 1)]

    def of(self, place: int) -> int:
        """The place of the closing bracket, -1 if there is none."""
        return self.end[bisect_left(self.at, place)]


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("", text, "") for text, and (mark, tag, attributes) for tags, where the mark is "<" or "</"; comments and contents that are no text are left out."""
    ends, unclosed, pos, n, last, closing = _TagEnds(page), set(), 0, len(page), page.rfind("<"), page.rfind(">")
    while pos < n:
        if page[pos] != "<":
            stop = page.find("<", pos)
            stop = n if stop < 0 else stop
            yield "", page[pos:stop], ""
            pos = stop
            continue
        if page.startswith("<!--", pos):
            stop = page.find("-->", pos + 4)
            pos = n if stop < 0 else stop + 3
            continue
        m = NAME.match(page, pos)
        if not m and page[pos + 1 : pos + 2] not in ("!", "?", "/"):
            yield "", "<", ""
            pos += 1
            continue
        end = ends.of(m.end()) if m else (page.find(">", pos) if pos < closing else -1)
        if end < 0:
            if pos == last:
                return  # a tag that the page's end cuts off
            yield "", "<", ""
            pos += 1
            continue
        pos = end + 1
        if not m:
            continue
        tag, attributes = m[2].lower(), page[m.end() : end]
        raw = None if m[1] or (tag == "svg" and attributes.endswith("/")) else RAW_TAGS.get(tag)
        if raw is None:
            if tag not in RAW_TAGS:
                yield "<" + m[1], tag, attributes
            continue
        over = None if tag in unclosed else raw.search(page, pos)
        if over:
            pos = over.end()
        elif tag in ENDS_ITSELF:
            unclosed.add(tag)  # nor will a later one find an end
        else:
            return


NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
#: Opening one of these ends an open one of the same kind.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


@dataclass
class Block:
    """Features of a block's ancestors, its innermost block tag, whether it is within an article and within another marked region, text, and how much of it is linked."""

    ancestors: frozenset[str]
    inner: str
    main: bool
    other: bool
    text: str
    linked: int


class _Open:
    """The elements open at a place of a page. What a block needs to know of them is counted as they open and close."""

    def __init__(self, known: Container[str] | None):
        self.stack: list[tuple[str, tuple[str, ...], bool, bool]] = []
        self.blocks: list[int] = []
        self.tags, self.counts, self.known = Counter(), Counter(), known
        self.main = self.other = 0
        self.features: frozenset[str] | None = frozenset()

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        found = ("T:" + tag, *("N:" + n for n in names))
        found = found if self.known is None else tuple(f for f in found if f in self.known)
        main, other = tag in ("article", "main"), is_other(tag, names)
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, found, main, other))
        self.tags[tag] += 1
        self.main += main
        self.other += other
        for f in found:
            if not self.counts[f]:
                self.features = None
            self.counts[f] += 1

    def pop(self) -> str:
        tag, found, main, other = self.stack.pop()
        if tag in BLOCK_TAGS:
            self.blocks.pop()
        self.tags[tag] -= 1
        self.main -= main
        self.other -= other
        for f in found:
            self.counts[f] -= 1
            if not self.counts[f]:
                del self.counts[f]
                self.features = None
        return tag

    def inner(self) -> str:
        return self.stack[self.blocks[-1]][0] if self.blocks else ""

    def block(self, text: str, linked: int) -> Block:
        if self.features is None:
            self.features = frozenset(self.counts)
        return Block(self.features, self.inner(), self.main > 0, self.other > 0, text, linked)


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The page's blocks that have text, in order, with character references decoded and white space collapsed. Of the
    ancestors' features only ``known`` ones are kept, if that is given."""
    out: list[Block] = []
    open_ = _Open(known)
    text: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append(open_.block(joined, linked))
        text.clear()
        linked = 0

    for mark, tag, attributes in tokens(page):
        if not mark:
            piece = html.unescape(tag) if tag != "<" else tag
            text.append(piece)
            linked += len(piece) if open_.tags["a"] else 0
            continue
        if tag in BLOCK_TAGS:
            flush()
        if mark == "</":
            if open_.tags[tag]:
                while open_.pop() != tag:
                    pass
        elif tag == "br":
            text.append(" ")
        elif tag not in VOID_TAGS:
            if tag in BLOCK_TAGS and open_.inner() in SELF_CLOSING.get(tag, {"p"}):
                # No further up than the nearest container.
                for _ in range(len(open_.stack) - open_.blocks[-1]):
                    open_.pop()
            open_.push(tag, tuple(p for a in NAMES.findall(attributes) for p in PARTS.findall("".join(a).lower())) if attributes else ())
    flush()
    return out


CUES = re.compile(r"cookie|subscribe|sign ?up|log ?in|share|comment|repl(?:y|ies)|advert|sponsor|related|privacy|newsletter|search|copyright|©|terms|read more|follow us|consent", re.I)


def features(blocks: list[Block]) -> list[list[str]]:
    """The features of each block: ancestors first (they begin with a capital), then text."""
    out = []
    for k, b in enumerate(blocks):
        found = {"B", *b.ancestors}
        found.add("P:" + b.inner)
        words = b.text.count(" ") + 1
        found.add(f"words:{words.bit_length()}")
        found.add(f"links:{4 * b.linked // max(1, len(b.text))}")
        found.add("end:" + ("stop" if b.text[-1] in ".!?…\"'”)" else "word" if b.text[-1].isalnum() else "other"))
        found.add(f"stops:{min(3, sum(map(b.text.count, '.!?')))}")
        found.update("cue:" + c.lower() for c in CUES.findall(b.text))
        found.add("first" if not k else "last" if k == len(blocks) - 1 else "mid")
        out.append(sorted(found))
    return out


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray  # features x 2
    moves: np.ndarray  # from label x to label
    ends: np.ndarray  # start and end x label


def _scores(model: Model, ids: list[list[int]]) -> np.ndarray:
    # Every block has the feature B, so no list is empty.
    starts = np.cumsum([0, *map(len, ids[:-1])])
    s = np.add.reduceat(model.weights[[i for own in ids for i in own]], starts, axis=0)
    s[0] += model.ends[0]
    s[-1] += model.ends[1]
    return s


def viterbi(scores: list[list[float]], moves: list[list[float]]) -> list[int]:
    """The labels of greatest total score; of equal ones, label 0 earlier."""
    a, b = scores[0]
    back = []
    for x, y in scores[1:]:
        a0, b0, a1, b1 = a + moves[0][0], b + moves[1][0], a + moves[0][1], b + moves[1][1]
        back.append((int(b0 > a0), int(b1 > a1)))
        a, b = max(a0, b0) + x, max(a1, b1) + y
    label = int(b > a)
    out = [label]
    for pointers in reversed(back):
        label = pointers[label]
        out.append(label)
    return out[::-1]


def fit_chain(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.3, hide: float = 0.25, l2: float = 1e-4, seed: int = 5) -> Model:
    """Weights that make the pages' labels likely, by AdaGrad on the exact gradient of one page at a time."""
    vocabulary = {f: i for i, f in enumerate(sorted({f for page, _ in pages for fs in page for f in fs}))}
    model = Model(vocabulary, np.zeros((len(vocabulary), 2)), np.zeros((2, 2)), np.zeros((2, 2)))
    seen = [np.full_like(x, 1e-6) for x in (model.weights, model.moves, model.ends)]
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(pages)
        for page, labels in pages:
            ids = [[vocabulary[f] for f in fs if f == "B" or rng.random() >= hide] for fs in page]
            s, n = _scores(model, ids), len(ids)
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = s[0]
            for t in range(1, n):
                ahead[t] = s[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + model.moves, axis=0)
            for t in range(n - 2, -1, -1):
                behind[t] = np.logaddexp.reduce(model.moves + s[t + 1] + behind[t + 1], axis=1)
            total = np.logaddexp.reduce(ahead[-1])
            gap = -np.exp(ahead + behind - total)
            gap[np.arange(n), labels] += 1
            moves = np.zeros((2, 2))
            for t in range(1, n):
                moves -= np.exp(ahead[t - 1][:, None] + model.moves + s[t] + behind[t] - total)
                moves[labels[t - 1], labels[t]] += 1
            rows = np.array([i for own in ids for i in own])
            grad = np.repeat(gap, [len(own) for own in ids], axis=0)
            used, back = np.unique(rows, return_inverse=True)
            summed = np.zeros((len(used), 2))
            np.add.at(summed, back, grad)
            summed -= l2 * model.weights[used]
            seen[0][used] += summed**2
            model.weights[used] += rate * summed / np.sqrt(seen[0][used])
            for k, (x, g) in enumerate(((model.moves, moves), (model.ends, np.stack([gap[0], gap[-1]]))), 1):
                seen[k] += g**2
                x += rate * g / np.sqrt(seen[k])
    return model


#: Regions of the grammar: tags, names that their class or id may have, and the kinds of text in them.
OTHER_REGIONS = {
    "menu": (["nav", "ul", "div"], ["menu", "nav", "navbar", "navigation", "breadcrumb", "links", "topbar"], "links"),
    "header": (["header", "div"], ["header", "masthead", "banner", "top", "branding", "hero"], "short"),
    "footer": (["footer", "div"], ["footer", "bottom", "colophon", "legal", "copyright"], "foot"),
    "sidebar": (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "recent", "popular", "tags", "trending"], "mixed"),
    "notice": (["div", "section", "p", "dialog"], ["notice", "cookie", "cookies", "consent", "alert", "banner", "gdpr", "popup", "modal", "warning"], "prose"),
    "advert": (["div", "aside", "section", "p"], ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "adsense"], "prose"),
    "form": (["form", "form", "div"], ["form", "search", "login", "newsletter", "subscribe", "signup", "contact"], "form"),
    "comments": (["section", "div", "ol", "ul"], ["comments", "comment", "respond", "discussion", "replies", "disqus"], "comments"),
    "share": (["div", "ul"], ["share", "social", "sharing", "follow"], "links"),
}
MAIN_REGIONS = (["article", "article", "main", "div", "section"], ["content", "article", "post", "entry", "story", "body", "text", "main"])


class _Grammar:
    """Pages with labels. Every block of text is emitted with its label beside it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[int] = []

    def words(self, a: int, b: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("aeioutnrslmdp") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def prose(self) -> str:
        return " ".join(self.words(4, 16).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(1, 5)))

    def block(self, tag: str, text: str, label: int) -> None:
        self.out.append(f"<{tag}>{text}</{tag}>")
        self.labels.append(label)

    def other(self, kind: str) -> None:
        r = self.r
        tags, names, style = OTHER_REGIONS[kind]
        tag = r.choice(tags)
        name = f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if r.random() < 0.8 or tag in ("div", "section", "p", "ul", "ol") else ""
        self.out.append(f"<{tag}{name}>")
        for _ in range(r.randint(1, 6) if style in ("links", "mixed", "comments", "form") and tag != "p" else 1):
            pick = style if style != "mixed" else r.choice(["links", "prose", "short"])
            if tag == "p":
                self.out.append(self.prose())
                self.labels.append(0)
            elif pick == "links":
                self.block("li" if tag in ("ul", "nav") else "div", f'<a href="#">{self.words(1, 4)}</a>', 0)
            elif pick == "foot":
                self.block("p", r.choice(["&copy; ", "Copyright ", ""]) + self.prose(), 0)
            elif pick == "form":
                self.block(r.choice(["p", "div", "button"]), self.words(1, 4), 0)
            elif pick == "comments":
                self.block(r.choice(["p", "div", "li"]), self.prose(), 0)
            elif pick == "short":
                self.block(r.choice(["p", "div", "h1", "h2", "h3"]), self.words(1, 5), 0)
            else:
                self.block(r.choice(["p", "div"]), self.prose(), 0)
        self.out.append(f"</{tag}>")

    def main(self) -> None:
        r = self.r
        tags, names = MAIN_REGIONS
        tag = r.choice(tags)
        name = f' class="{r.choice(names)}"' if tag in ("div", "section") or r.random() < 0.3 else ""
        self.out.append(f"<{tag}{name}>")
        if r.random() < 0.8:
            self.block("h1", self.words(2, 9), 1)
        for _ in range(r.randint(1, 14)):
            what = r.random()
            if what < 0.75:
                self.block("p", self.prose(), 1)
            elif what < 0.82:
                self.block(r.choice(["h2", "h3"]), self.words(1, 6), 1)
            elif what < 0.88:
                self.block(r.choice(["blockquote", "pre", "div", "td", "figcaption"]), self.prose(), 1)
            elif what < 0.93:
                self.out.append("<ul>")
                for _ in range(r.randint(1, 5)):
                    self.block("li", self.words(2, 12), 1)
                self.out.append("</ul>")
            else:
                self.other(r.choice(["advert", "share", "sidebar", "form"]))
        if r.random() < 0.1:
            self.other("comments")
        self.out.append(f"</{tag}>")

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        before = [k for k in ("notice", "header", "menu", "advert", "form", "share", "sidebar") if r.random() < 0.4]
        after = [k for k in ("share", "comments", "sidebar", "advert", "form", "menu", "footer") if r.random() < 0.45]
        for k in before:
            self.other(k)
        self.main()
        for k in after:
            self.other(k)
        return "<html><body>" + "".join(self.out) + "</body></html>", self.labels


def grammar_pages(n: int, seed: int = 3) -> list[tuple[list[list[str]], list[int]]]:
    """n labelled pages of the grammar."""
    out = []
    for k in range(n):
        page, labels = _Grammar(seed * 100_003 + k).page()
        blocks = leaf_blocks(page)
        if blocks and len(blocks) == len(labels):
            out.append((features(blocks), labels))
    return out


OTHER_NAMES = frozenset(n for _, ns, _ in OTHER_REGIONS.values() for n in ns)


def is_other(tag: str, names: tuple[str, ...]) -> bool:
    """Whether an element's markup tells that it is no part of the article."""
    return tag in ("nav", "footer", "aside", "form", "header") or (tag in ("div", "section", "ul", "ol", "p") and not OTHER_NAMES.isdisjoint(names))


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page whose markup tells them: text within article or main, and not within a marked other region."""
    if any(not b.other and not b.main for b in blocks):
        return None
    labels = [int(b.main and not b.other) for b in blocks]
    return labels if any(labels) else None


def fit(pages: DataFrame, sample_pages: int = 300, made_pages: int = 500) -> Model:
    """A model from ``made_pages`` pages of the grammar and at most ``sample_pages`` pages of the corpus, chosen by a hash of page_id."""
    order = F.xxhash64("page_id", F.lit("fit"))
    ids = pages.select("page_id").where("page_id is not null").orderBy(order, "page_id").limit(sample_pages)
    picked = pages.join(F.broadcast(ids.distinct()), "page_id").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    found = []
    for row in picked.orderBy("page_id", "html").limit(sample_pages).toLocalIterator():
        blocks = leaf_blocks(row["html"])
        labels = marked_labels(blocks) if blocks else None
        if labels:
            found.append((features(blocks), labels))
    return fit_chain(grammar_pages(made_pages) + found)


def main_text(page: str | None, model: Model, moves: list[list[float]]) -> str:
    known = model.vocabulary
    blocks = leaf_blocks(page or "", known)
    if not blocks:
        return ""
    ids = [[known[f] for f in fs if f in known] for fs in features(blocks)]
    labels = viterbi(_scores(model, ids).tolist(), moves)
    return "\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, text, n_chars.

    Every row has a result; null, empty or textless html has an empty text. Pages are independent of each other, so
    repeated rows get equal answers and nulls in page_id or url are passed on. Other columns are left out.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        moves = model.moves.tolist()
        for part in parts:
            yield pd.Series([main_text(p, model, moves) for p in part], dtype=object)

    return pages.select("page_id", "url", F.pandas_udf(frugal(run), "string")(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
