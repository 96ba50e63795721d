"""HTML extraction by a site style tree.

Pages of one host are merged by the paths of their elements (tag, class, id and role from the root
down).  Each path has two nodes: its presentation (the run of child tags) and its content (its own
text).  The importance of a node is the entropy of what it shows over the pages of the host, from 0
(the same on every page) to 1 (different on each).  A branch of a page goes if neither node of its
path matters.  What a path is named for (menus, headers, footers, side bars, notices, adverts,
forms, comments) sets its importance to 0 on hosts of any size, articles included; ``article`` and
``main`` elements that lie in no such branch raise it by ``RAISED``, no more.

Merging counts (host, node, value) rows, so a host with a third of all pages is summed in parts; the
pages then meet the short lists of their host (a skew join splits a hot host): its unimportant
paths, and its important ones beside articles.

The text keeps its page order; character references are decoded; blanks inside a block become one;
blocks are joined by one blank.  On a page with words in ``article`` (else ``main``) elements, what
lies beside them stays if the tree finds it important, and goes where the tree does not know it.

Defined cases: null and empty pages give an empty text; pages without a host form no tree; paths on
fewer than ``least_pages`` pages of a host are not known to the tree; unclosed and stray tags are
tolerated; equal pages of a host count once.  Columns named like a result are replaced.
"""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinchart.llm.common import free_name, map_batches, stored
from kinchart.llm.urls import host_and_path

LEAST_PAGES = 5
THRESHOLD = 0.2
RAISED = 0.1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg select option button object canvas".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_NOISE_TAGS = frozenset("nav header footer aside form menu dialog head".split())
_NOISE_NAMES = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|menubar|header|masthead|footer|sidebar|side|aside|complementary|banner|"
    r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notices?|newsletter|subscribe|popup|modal|overlay|share|"
    r"sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|toolbar|widget|comments?|commentlist|replies|"
    r"discussion|disqus|contentinfo|search|login|skip)(?:$|[-_\s])",
    re.I,
)
_CLOSES = {  # an opening tag ends open elements of these kinds (up to the next container)
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol pre section table ul".split()
)


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class _Open:
    __slots__ = ("tag", "path", "noise", "article", "main", "children")

    def __init__(self, tag: str, path: int, noise: bool, article: bool, main: bool):
        self.tag, self.path, self.noise, self.article, self.main = tag, path, noise, article, main
        self.children: list[str] = []


_PATHS: dict[tuple[int, str, str], tuple[int, bool]] = {}


def _path(parent: int, tag: str, attributes: str) -> tuple[int, bool]:
    """Hash of an element's path, and whether its own name marks noise."""
    known = _PATHS.get((parent, tag, attributes))
    if known is None:
        named = sorted((k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)) if attributes else []
        noise = tag in _NOISE_TAGS or any(_NOISE_NAMES.search(v) for _, v in named)
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        known = _PATHS[parent, tag, attributes] = _hash(str(parent), tag, *[f"{k}={v}" for k, v in named]), noise
    return known


def walk(page: str) -> tuple[list[tuple], dict[int, int]]:
    """Text pieces as (path, noise, article, main, text) in page order, where the text None ends a block;
    and the hash of the child tags of every path.
    """
    out: list[tuple] = []
    styles: dict[int, list[str]] = {}
    root = _Open("", 0, False, False, False)
    stack = [root]
    at = 0

    def close(n: int) -> None:
        for element in stack[n:]:
            styles.setdefault(element.path, []).extend([*element.children, "/"])
        del stack[n:]

    while True:
        token = _TOKEN.search(page, at)
        top = stack[-1]
        end = token.start() if token else len(page)
        if end > at:
            out.append((top.path, top.noise, top.article, top.main, page[at:end]))
        if token is None:
            break
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            out.append((0, False, False, False, None))
        if token[1]:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    close(n)
                    break
            continue
        if tag in _RAW:
            if not token[3].endswith("/"):
                ended = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = ended.end() if ended else len(page)
            continue
        ends = _CLOSES.get(tag, {"p"} if tag in _ENDS_PARAGRAPH else None)
        if ends:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag in ends:
                    close(n)
                elif stack[n].tag not in _INLINE:
                    break
        if tag in _VOID:
            continue
        top = stack[-1]
        path, named = _path(top.path, tag, token[3])
        if tag in _INLINE:
            path = top.path  # words in line belong to the block around them
        else:
            top.children.append(tag)
        noise = top.noise or (named and tag not in ("body", "html", "main"))
        stack.append(_Open(tag, path, noise, not noise and (top.article or tag == "article"), not noise and (top.main or tag == "main")))
    close(1)
    return out, {path: _hash(" ".join(tags)) for path, tags in styles.items()}


def _inside(pieces: list[tuple]) -> list[bool]:
    """Whether each piece lies in the page's articles, else in its main elements; true where it has words in neither."""
    for kind in (2, 3):
        if any(p[kind] and p[4] is not None and not p[4].isspace() for p in pieces):
            return [p[kind] for p in pieces]
    return [True] * len(pieces)


def page_text(page: str | None, unimportant: frozenset[int] = frozenset(), important: frozenset[int] = frozenset()) -> str:
    """The text of one page without named noise and unimportant paths; beside articles, important paths only."""
    if not page:
        return ""
    pieces, _ = walk(page)
    blocks = []
    for (path, noise, _, _, text), inside in zip(pieces, _inside(pieces)):
        if text is None:
            blocks.append(" ")
        elif not noise and path not in unimportant and (inside or path in important):
            blocks.append(text)
    return " ".join(html.unescape("".join(blocks)).split())


def _nodes(pages: DataFrame, url: str, page: str) -> DataFrame:
    """One row per page and node: host, path, kind of node, what it shows, whether it is in an article or main
    element, whether it lies beside those of its page, and the page's hash.
    """
    host, _ = host_and_path(F.col(url))
    names = ["host", "path", "kind", "value", "raised", "beside", "page"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in names]
        for name, text, of in zip(*(c.to_pylist() for c in batch.columns)):
            pieces, styles = walk(text)
            content: dict[int, list[str]] = {}
            raised, beside = set(), set()
            for (path, noise, in_article, in_main, piece), inside in zip(pieces, _inside(pieces)):
                if piece is not None and not noise and not piece.isspace():
                    content.setdefault(path, []).append(piece)
                    if in_article or in_main:
                        raised.add(path)
                    if not inside:
                        beside.add(path)
            for kind, values in ((0, {p: _hash(*v) for p, v in content.items()}), (1, {p: styles.get(p, 0) for p in content})):
                for path, value in values.items():
                    for column, v in zip(rows, (name, path, kind, value, path in raised, path in beside, of)):
                        column.append(v)
        kinds = (pa.string(), pa.int64(), pa.int8(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    useful = pages.select(host.alias("host"), F.col(page).alias("page"), F.xxhash64(page).alias("of")).where("host <> '' and page <> ''")
    return map_batches(useful, each, "host string, path long, kind byte, value long, raised boolean, beside boolean, page long")


def node_importance(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, path, kind (0 content, 1 presentation), pages, importance: entropy over the different pages, from 0 to 1;
    ``raised`` in articles and main elements, ``beside`` where a page has them elsewhere.
    """
    flags = [F.max(c).alias(c) for c in ("raised", "beside")]
    once = _nodes(pages, url, page).groupBy("host", "path", "kind", "value", "page").agg(*flags)
    shown = once.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"), *flags)
    merged = shown.groupBy("host", "path", "kind").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("clogc"), *flags)
    entropy = (F.log("pages") - F.col("clogc") / F.col("pages")) / F.log("pages")
    return merged.select(
        "host", "path", "kind", "pages", F.when(F.col("pages") > 1, entropy).otherwise(1.0).alias("importance"), "raised", "beside"
    )


def main_text(
    pages: DataFrame, url: str = "url", page: str = "html", least_pages: int = LEAST_PAGES, threshold: float = THRESHOLD
) -> DataFrame:
    """``pages`` without the markup, with ``text`` and ``n_chars``."""
    raised = F.when(F.max("raised"), RAISED).otherwise(0.0)
    known = node_importance(pages, url, page).groupBy("host", "path").agg(
        (F.max("importance") + raised).alias("importance"), F.min("pages").alias("pages"), F.max("beside").alias("beside")
    )
    low = F.col("importance") < threshold
    told = known.where((F.col("pages") >= least_pages) & (low | F.col("beside")))
    rest = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in rest]
    name, lows, highs, body = (free_name(pages, n) for n in ("_host", "_low", "_high", "_page"))
    found = [F.collect_list(F.when(test, F.col("path"))).alias(n) for n, test in ((lows, low), (highs, ~low))]
    lists = stored(told.groupBy(F.col("host").alias(name)).agg(*found))
    host, _ = host_and_path(F.col(url))
    joined = pages.select(*rest, F.col(page).alias(body), host.alias(name)).join(lists, name, "left")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for raw, *paths in zip(*(c.to_pylist() for c in batch.columns[len(rest) :])):
            texts.append(page_text(raw, *(frozenset(p or ()) for p in paths)))
        new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *new], [*rest, "text", "n_chars"])

    return map_batches(joined.select(*rest, body, lows, highs), each, ", ".join([*fields, "text string, n_chars long"]))
