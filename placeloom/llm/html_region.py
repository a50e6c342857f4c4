"""Main text of HTML pages by a maximum-scoring subsequence.

A page is read once from left to right as words and tags. Each word scores one; each tag costs what labelled pages
have taught about it. One linear scan finds the contiguous run of tokens with the greatest sum, the content region.

Labelled pages are those that mark their content themselves (``article``, ``main``): a tag's cost is the share of its
uses outside the content times the number of words that a tag outside the content brings on average, so that
unmarked lists of links, teasers and the like add up to less than nothing while paragraphs do not. Weights come
from a sample of about ``max_pages`` rows by their hash (equal rows fall into it together), the only bound here, and
cover at most ``max_features`` tags and class words (the commonest; others cost what tags cost on average).

Elements that are no running text by name (``nav``, ``script``, ``form``...) or by a class, id or role (advert, menu,
comments, notice...) bring no words, neither for the score nor for the result. Where the region lies in elements that
mark content, the whole of these is taken; so nothing at their ends is lost.

Rows: a null or empty page gives the empty text; a page without words too. Any length is read in one pass, with a stack
of open elements; broken markup is read as far as it goes. Repeated rows each get their text. All other columns pass
through, but an input column named like the result is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PAGES = 20_000
MAX_FEATURES = 2_000

# Element names of the HTML standard by kind, and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
    " caption option".split())
CONTENT = frozenset(["article", "main"])
NO_TEXT = frozenset(
    "script style title textarea xmp iframe noembed noframes head nav footer aside form button select option datalist"
    " fieldset dialog menu noscript template svg math canvas object video audio map".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner menu menus nav"
    " navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets comment comments respond disqus footer"
    " header masthead cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social related recommended recommendations teaser teasers toolbar"
    " search pagination pager skip copyright contentinfo complementary dialog form reactions replies".split())
TEXTUAL = frozenset("article articles body content entry main post story text page wrapper".split())
PASSIVE = frozenset("has with no without hide".split())
# which open elements a start tag closes, as browsers do
CLOSES = {
    **dict.fromkeys(BLOCK - {"li", "dd", "dt", "td", "th", "tr", "option", "body", "html"}, ("p",)),
    "li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "td": ("p", "td", "th"), "th": ("p", "td", "th"),
    "tr": ("p", "td", "th", "tr"), "option": ("option",)}
# an element of these kinds bounds what a start tag may close
BOUNDS = frozenset("table ul ol dl div section article main body html aside nav header footer form select td th".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?:(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<broken>[^<>]*)(?:>|\Z))", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


def names_of(attributes: str) -> list[list[str]]:
    """Words of each class, id and role, in lower case."""
    found = []
    for match in NAMES.finditer(attributes):
        for name in (match[2] or match[3] or match[4] or "").split():
            found.append([part.lower() for part in PARTS.findall(name)])
    return found


def is_noise(name: str, attributes: str, in_content: bool) -> bool:
    """Whether an element holds no running text of the article."""
    if name in NO_TEXT or (name == "header" and not in_content):
        return True
    if not attributes or name in ("html", "body"):
        return False
    bare = QUOTED.sub("", attributes)
    if HIDDEN.search(bare) or ("none" in attributes or "aria-hidden" in attributes) and HIDDEN.search(attributes):
        return True
    noise = textual = False
    for words in names_of(attributes):
        if words and words[0] not in PASSIVE:
            if NOISE.intersection(words):
                noise = True
            elif TEXTUAL.intersection(words):
                textual = True
    return noise and not textual


class Page:
    """Blocks and tokens of one page.

    ``blocks``: text parts of each block. ``tokens``: (score class, amount, block, content element), where the class is
    None for words and the names of features for a tag.
    """

    def __init__(self, html: str):
        self.blocks: list[list[str]] = [[]]
        self.tokens: list[tuple[tuple[str, ...] | None, int, int, int]] = []
        self._open: list[tuple[str, bool, int]] = []  # name, noise, content element
        self._count: Counter[str] = Counter()
        self._marked = 0
        self._read(html)

    def _top(self) -> tuple[bool, int]:
        return self._open[-1][1:] if self._open else (False, 0)

    def _read(self, html: str) -> None:
        at = 0
        while at < len(html):
            match = TAG.search(html, at)
            self._words(html[at:match.start()] if match else html[at:])
            if not match:
                break
            at = match.end()
            if match[0].startswith("<![CDATA["):
                self._words(match[0][9:].removesuffix("]]>"), raw=True)
            name = (match["name"] or "").lower()
            if not name:
                continue
            if match["end"]:
                self._end(name)
                continue
            self._start(name, match["rest"] or match["broken"] or "")
            if name in RAW:
                closing = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                at = closing.start() if closing else len(html)

    def _words(self, text: str, raw: bool = False) -> None:
        noise, content = self._top()
        if noise or not text:
            return
        text = text if raw or "&" not in text else unescape(text)
        self.blocks[-1].append(text)
        if n := len(text.split()):
            self.tokens.append((None, n, len(self.blocks) - 1, content))

    def _break(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _start(self, name: str, attributes: str) -> None:
        for other in CLOSES.get(name, ()):
            if self._count[other]:
                self._close(other, bounded=True)
        noise, content = self._top()
        if name in BLOCK:
            self._break()
        elif name == "br":
            self.blocks[-1].append(" ")
        if not noise:
            noise = is_noise(name, attributes, content > 0)
            features = (name, *(f"{name}.{w}" for words in names_of(attributes) for w in words))
            if not noise and name in CONTENT:
                self._marked += 1
                content = self._marked
            self.tokens.append((features, 1, len(self.blocks) - 1, content))
        if name not in VOID and not (attributes.endswith("/") and name not in BLOCK):
            self._open.append((name, noise, content))
            self._count[name] += 1

    def _end(self, name: str) -> None:
        if name == "p" and not self._count["p"] or name == "br":
            self._break()
        if self._count[name]:
            noise = self._top()[0]
            self._close(name, bounded=False)
            if not noise:
                self.tokens.append(((name,), 1, len(self.blocks) - 1, self._top()[1]))

    def _close(self, name: str, bounded: bool) -> None:
        """Close the innermost element ``name``; with ``bounded`` only where no table, list or section lies between."""
        if bounded:
            for other, _, _ in reversed(self._open):
                if other == name:
                    break
                if other in BOUNDS:
                    return
        while self._open:
            other = self._open.pop()[0]
            self._count[other] -= 1
            if other in BLOCK:
                self._break()
            if other == name:
                return

    def text(self, costs: dict[str, float], usual: float) -> str:
        """Blocks of the content region."""
        region = best_run([
            amount if kind is None else -max(costs.get(f, usual) for f in kind) for kind, amount, _, _ in self.tokens])
        if not region:
            return ""
        first, last = region
        kept = {token[2] for token in self.tokens[first:last + 1] if token[0] is None}
        marked = {token[3] for token in self.tokens[first:last + 1] if token[0] is None and token[3]}
        kept.update(token[2] for token in self.tokens if token[0] is None and token[3] in marked)
        lines = (" ".join("".join(self.blocks[i]).split()) for i in sorted(kept))
        return "\n".join(line for line in lines if line)


def best_run(scores: list[float]) -> tuple[int, int] | None:
    """First and last place of the contiguous run with the greatest sum above 0; of equal sums the first, then longest."""
    best, found, total, start = 0.0, None, 0.0, 0
    for i, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > best or (found and total == best and start == found[0]):
            best, found = total, (start, i)
    return found


def tag_uses(html: str) -> Counter:
    """Uses of each feature inside and outside the marked content: keys (feature, inside); words count as feature ''."""
    page = Page(html)
    uses: Counter = Counter()
    if page._marked:
        for kind, amount, _, content in page.tokens:
            for feature in ("",) if kind is None else kind:
                uses[feature, content > 0] += amount
    return uses


def learned_costs(pages: DataFrame, html_col: str, max_pages: int, max_features: int) -> tuple[dict[str, float], float]:
    """Cost of each tag feature, and of those that are not among them."""
    n = pages.count()
    sample = pages.filter(F.pmod(F.xxhash64(*pages.columns), F.lit(n)) < max_pages) if n > max_pages else pages
    rows = sample.select(F.col(html_col).cast("string").alias("_html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uses: Counter = Counter()
            for html in batch.column(0):
                uses.update(tag_uses(html.as_py() or ""))
            yield pa.RecordBatch.from_pydict({
                "feature": [k[0] for k in uses], "inside": [v if k[1] else 0 for k, v in uses.items()],
                "outside": [0 if k[1] else v for k, v in uses.items()]},
                pa.schema([("feature", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())]))

    uses = rows.mapInArrow(count, "feature string, inside long, outside long").groupBy("feature").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    words = uses.filter("feature = ''").first()
    # elements without a class word count each tag once
    found = uses.filter("feature <> ''").orderBy((F.col("inside") + F.col("outside")).desc(), "feature").limit(max_features).collect()
    tags = [u for u in found if "." not in u.feature]
    outside = sum(u.outside for u in tags)
    weight = 1 + (words.outside / outside if words and outside else 1.0)
    cost = lambda u: weight * (u.outside + 0.5) / (u.inside + u.outside + 1)
    usual = weight * (outside + 0.5) / (outside + sum(u.inside for u in tags) + 1)
    return {u.feature: cost(u) for u in found}, usual


def extract(
    pages: DataFrame, html_col: str = "html", text_col: str = "text", max_pages: int = MAX_PAGES, max_features: int = MAX_FEATURES,
) -> DataFrame:
    """``pages`` with ``text_col``, the main text, in place of ``html_col``."""
    costs, usual = learned_costs(pages, html_col, max_pages, max_features)
    others = [f for f in pages.schema.fields if f.name not in (html_col, text_col)]
    schema = T.StructType([*others, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([Page(html.as_py() or "").text(costs, usual) for html in batch.column(len(others))], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], text_col])

    return pages.select(*(f"`{f.name}`" for f in others), F.col(html_col).cast("string").alias(html_col)).mapInArrow(run, schema)
