"""HTML extraction by consensus host paths.

Each page's containers are scored by the text of their blocks; the best one's generalised
tag-class path is the page's vote. Votes are counted per host in Spark, and every page is
extracted again with its host's winning path, or with its own best one where that path
isn't on the page.

Paths are held as 128-bit hashes, so that neither a page nor a vote grows with their depth.
What looks like boilerplate by its class, id or form is only left out if it neither holds an
article or first heading nor, on pages without, most of the text.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_names, materialise, rebatched, small_batches

#: Winning paths of so many hosts at most are broadcast (some 5 MB); beyond, pages are joined by host.
BROADCAST_HOSTS = 50_000
#: What a container gets of its child containers' scores.
INHERIT = 0.7

CONTAINERS = frozenset("html body main article section div td th center details".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tfoot tr caption figure figcaption hr address nav header footer aside form fieldset head hgroup summary".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = "script|style|noscript|template|textarea|svg|iframe|title|select|object|canvas|math"
#: Elements that are never part of an article.
DROP_TAGS = frozenset("nav footer aside head menu dialog button fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
#: A class or id is a mark if it is one of these words, or starts or ends with one and a hyphen or underscore.
DROP_WORDS = frozenset(
    "nav navbar navigation menu masthead footer sidebar aside ad ads adv advert adverts advertisement sponsor sponsored promo "
    "cookie cookies consent gdpr notice banner alert popup modal overlay share sharing social related recommended breadcrumb breadcrumbs "
    "comment comments disqus replies respond newsletter subscribe subscription signup login pagination pager widget toolbar".split()
)
#: Classes and ids that are marks as they are.
DROP_TOKENS = frozenset("header hidden skip site-header page-header main-header top-header global-header skip-link skip-links".split())
#: Beginnings of classes that tell of a page's layout, not of what an element is.
LAYOUT = frozenset("has no with without is not entry post article content overflow".split())
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
#: Elements that hold the article with all else, or are it: words of their classes and ids say nothing about them.
WHOLE = frozenset("html body main article".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z!?][^>]*(?:>|$)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host(url: str | None) -> str:
    """A URL's host in lower case; empty where there is none."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html_lib.unescape(v.strip("\"'")) for k, v in _ATTR.findall(text)}


def _hidden(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element is surely no part of an article."""
    if tag in WHOLE:
        return False
    if tag in DROP_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in DROP_ROLES:
        return True
    return "none" in attrs.get("style", "") and bool(re.search(r"display\s*:\s*none", attrs["style"]))


def _mark(tag: str, attrs: dict[str, str]) -> int:
    """0: nothing speaks against an element; 1: it looks like boilerplate; 2: like comments."""
    if tag in WHOLE:
        return 0
    found = 1 if tag == "form" or attrs.get("role", "").lower() == "form" else 0
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        words = _WORD.findall(token)
        if not words or (len(words) > 1 and words[0] in LAYOUT):
            # "entry-comments" are comments still, "has-comments" says that there are some
            if len(words) > 1 and words[0] in ("entry", "post", "article", "content") and words[-1] in COMMENT_WORDS:
                found = 2
            continue
        if token in DROP_TOKENS or words[0] in DROP_WORDS or words[-1] in DROP_WORDS:
            found = max(found, 2 if COMMENT_WORDS.intersection(words) else 1)
    return found


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A path's step: tag, classes and id, with numbers generalised."""
    marks = "".join("." + c for c in sorted(set(attrs.get("class", "").lower().split()))) + (f"#{attrs['id'].lower()}" if attrs.get("id") else "")
    return tag + re.sub(r"\d+", "0", marks)


class Page:
    """Containers and blocks (container, text, code points within links, whether a first heading), in page order.

    Memory and time grow with the page's length alone, however deep its elements are nested.
    """

    def __init__(self, source: str, marks: bool = True):
        # of each container: its tag, its parent, its path's hash, and its mark
        self.tags, self.parents, self.paths, self.marks = [""], [-1], [b""], [0]
        self.blocks: list[tuple[int, str, int, bool]] = []
        # open elements: tag, container, dropped, within a link, position of the nearest container and barrier
        self._stack: list[tuple[str, int, bool, bool, int, int]] = [("", 0, False, False, 0, 0)]
        self._open: dict[str, list[int]] = defaultdict(list)
        self._parse(source)
        if marks:
            self._leave_out()

    def _close(self, k: int) -> None:
        """Close the open elements from position k on."""
        for x in reversed(self._stack[k:]):
            self._open[x[0]].pop()
        del self._stack[k:]

    def _parse(self, source: str) -> None:
        stack, opened = self._stack, self._open
        text: list[str] = []
        links = 0

        def flush() -> None:
            nonlocal links
            if text:
                if whole := " ".join(html_lib.unescape("".join(text)).split()):
                    self.blocks.append((stack[-1][1], whole, min(links, len(whole)), bool(opened["h1"])))
                text.clear()
            links = 0

        for m in _TOKEN.finditer(source):
            if (t := m["text"]) is not None:
                if not stack[-1][2]:
                    text.append(t)
                    links += len(t) if stack[-1][3] else 0
                continue
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in BLOCKS:
                flush()
            if tag in VOID:
                continue
            if m["end"]:
                # an inline element's end doesn't close containers
                if opened[tag] and (opened[tag][-1] > stack[-1][4] or tag in CONTAINERS or tag in DROP_TAGS or tag == "form"):
                    self._close(opened[tag][-1])
                continue
            self._imply_ends(tag)
            attrs = _attributes(m["attrs"]) if m["attrs"].strip() else {}
            _, at, gone, link, nearest, barrier = stack[-1]
            # a header right below the body is the site's; an article's own holds its title
            gone = gone or _hidden(tag, attrs) or (tag == "header" and self.tags[at] in ("", "html", "body"))
            mark = 0 if gone else _mark(tag, attrs)
            if (tag in CONTAINERS or mark) and not gone:
                self.tags.append(tag)
                self.parents.append(at)
                self.paths.append(xxhash.xxh3_128_digest(self.paths[at] + _step(tag, attrs).encode("utf-8", "surrogatepass")))
                self.marks.append(mark)
                at = len(self.tags) - 1
            if not m["attrs"].rstrip().endswith("/") or tag in BLOCKS:
                k = len(stack)
                stack.append((tag, at, gone, link or tag == "a", k if tag in CONTAINERS else nearest, k if tag in BLOCKS and tag not in ("head", "td", "th", "p") else barrier))
                opened[tag].append(k)
        flush()

    def _imply_ends(self, tag: str) -> None:
        """Close what a start tag closes: a paragraph before a block, an item before its sibling, the head before the body."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}.get(tag, ())
        if tag in BLOCKS:
            ends = (*ends, "p")
        k = max((self._open[e][-1] for e in ends if self._open[e]), default=0)
        if k and (k >= self._stack[-1][5] or tag == "body"):
            self._close(k)

    def _leave_out(self) -> None:
        """Drop the blocks of marked containers, but not of those that hold an article, a main element
        or a first heading, nor, where the page has none of these, most of the text; comments aren't
        spared for their length."""
        size, spared = [0] * len(self.tags), [t in ("article", "main") for t in self.tags]
        for at, text, _, heading in self.blocks:
            size[at] += len(text)
            spared[at] = spared[at] or heading
        for at in range(len(self.tags) - 1, 0, -1):
            size[self.parents[at]] += size[at]
            spared[self.parents[at]] = spared[self.parents[at]] or spared[at]
        gone = [False] * len(self.tags)
        for at in range(1, len(self.tags)):
            mark = self.marks[at]
            own = mark == 2 or (mark == 1 and (spared[0] or 2 * size[at] <= size[0]))
            gone[at] = gone[self.parents[at]] or (own and not spared[at])
        self.blocks = [b for b in self.blocks if not gone[b[0]]]

    def best(self) -> tuple[bytes, float]:
        """The path of the container with most text beyond links, and its score.

        A container inside an article or main element stands for the outermost such element.
        """
        score = [0.0] * len(self.tags)
        for at, text, links, _ in self.blocks:
            share = float(max(0, len(text) - 2 * links))
            while at >= 0 and share > 0.5:
                score[at] += share
                share *= INHERIT
                at = self.parents[at]
        if not self.blocks:
            return b"", 0.0
        k = at = max(range(len(score)), key=lambda i: (score[i], -i))
        found = k
        while at > 0:
            found = at if self.tags[at] in ("article", "main") else found
            at = self.parents[at]
        return self.paths[found], score[k]

    def text(self, path: bytes) -> str | None:
        """Blocks below the containers of this path, one to a line; None if it isn't on the page.

        Without a first heading in it, the nearest one before it that stands beside one of its
        ancestors comes first.
        """
        inside: list[bool] = []
        for own, parent in zip(self.paths, self.parents, strict=True):
            inside.append(own == path or (parent >= 0 and inside[parent]))
        if not any(inside):
            return None
        lines = [k for k, b in enumerate(self.blocks) if inside[b[0]]]
        out = [self.blocks[k][1] for k in lines]
        if lines and not any(self.blocks[k][3] for k in lines):
            over, at = set(), self.blocks[lines[0]][0]
            while at >= 0:
                over.add(at)
                at = self.parents[at]
            for k in range(lines[0] - 1, -1, -1):
                if self.blocks[k][3]:
                    if self.blocks[k][0] in over:
                        out.insert(0, self.blocks[k][1])
                    break
        return "\n".join(out)


def read(source: str) -> Page:
    """The page; with what marks tell to leave out where nothing else has text."""
    page = Page(source)
    return page if page.blocks else Page(source, marks=False)


def extract(source: str, path: bytes | None) -> str:
    page = read(source)
    got = page.text(path) if path is not None else None
    return got if got else page.text(page.best()[0]) or ""


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, votes``: one vote of each page that has text."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatched(batches):
            hosts, paths = [], []
            for url, source in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                path, score = read(source or "").best()
                if score > 0:
                    hosts.append(host(url))
                    paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.binary())], names=["host", "path"])

    return pages.select("url", "html").mapInArrow(run, "host string, path binary").groupBy("host", "path").agg(F.count("*").alias("votes"))


def winners(pages: DataFrame) -> DataFrame:
    """``host, path``: each host's path with most votes, ties to the first in order."""
    w = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    return votes(pages).withColumn("r", F.row_number().over(w)).where("r = 1").select("host", "path")


def main_text(pages: DataFrame) -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points) to every page.

    A null or empty page has an empty text; a null URL counts as a host without a name. Broken
    pages are read as far as they can be: missing ends are implied, others ignored. Whole pages
    are read, however long or deep. Columns named text and n_chars are replaced; other
    columns, whatever their names, and repeated rows stay. No rows in, no rows out.
    """
    small_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    won, _ = materialise(winners(pages), "html-winners")
    own = list(pages.columns)
    name = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    at, way = free_names(pages, "_host", "_path")
    side = won.select(F.col("host").alias(at), F.col("path").alias(way))
    if won.count() <= BROADCAST_HOSTS:
        side = F.broadcast(side)
    joined = pages.withColumn(at, name).join(side, at, "left").select(*own, way)
    schema = StructType(list(pages.schema.fields)).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatched(batches):
            got = [extract(h or "", p) for h, p in zip(b.column("html").to_pylist(), b.column(way).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], names=[*own, "text", "n_chars"])

    return joined.mapInArrow(run, schema)
