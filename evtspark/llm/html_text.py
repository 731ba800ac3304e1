"""Main text of web pages by consensus of their host.

Every page's containers are scored; each page votes with the scores of all its
containers over a floor, the best one's in full and the others' by half (an outer
container holds all that an inner one does), for their generalised tag-class paths,
summed per host in Spark; each page is then extracted from the containers on its host's winning path,
or from its own best one where the path is absent or holds much less.

Elements whose very tag or role says so (navigation, footers, forms, hidden parts)
are no part of an article. A class or id that names furniture only tips the
balance: the whole name must be furniture, and an element that holds an article, or
most of the page's text where no article stands elsewhere, is kept all the same.

Parsing and scoring take time in proportion to the page, however deep or broken it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtspark.llm.common import chunks, stage

#: Fixed values of HTML and of common page furniture, by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select option button xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr".split())
CONTAINERS = frozenset("article body div main section td center".split())
FURNITURE = frozenset("nav footer aside form dialog menu head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note".split())
#: Parts that may stand beside a furniture name without making it another.
NEUTRAL_NAMES = frozenset(
    """slot box bar list section area container wrapper wrap block inner outer site page global left right top bottom unit item items link links post posts
    panel group header title body text content user primary secondary mobile desktop js id div main inline""".split()
)
FURNITURE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr notice notices
    notification alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar side aside widget widgets rail
    footer foot copyright colophon legal comment comments commentlist disqus respond reply replies discussion share sharing social follow related recommended
    recommendations newsletter subscribe subscription signup login search toolbar skip masthead topbar""".split()
)
#: Of these, the names of readers' comments: what stands in them is no article, whatever its tag.
TALK_NAMES = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[\"'>]")
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
LISTS = frozenset("ul ol dl table".split())
#: A page leaves the host's path if it holds under the first share of the text of the page's own best container, or under
#: the second and that container is not the whole page and on a path that half of the host's pages have or more.
LEAST_SHARE, WHOLE_SHARE = 0.4, 0.9
#: Containers with a lower score have no vote.
FLOOR = 0.3


class Node:
    """An element: numbers of its parent and of its path, and the text in it."""

    __slots__ = ("tag", "parent", "path", "depth", "skip", "named", "link", "inside", "talk", "good", "junk", "article")

    def __init__(self, tag: str, parent: int, path: int, depth: int, skip: bool, named: bool, link: bool, inside: bool, talk: bool = False) -> None:
        self.tag, self.parent, self.path, self.depth, self.skip, self.named, self.link, self.inside, self.talk = tag, parent, path, depth, skip, named, link, inside, talk
        self.good = self.junk = self.article = 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTR.finditer(raw)} if raw else {}


def _generalised(tag: str, attrs: dict[str, str]) -> str:
    """Tag and classes, with numbers as # and without classes that look generated."""
    names = sorted({re.sub(r"\d+", "#", c.lower()) for c in attrs.get("class", "").split()})
    names = [c for c in names if len(c) <= 24 and c.count("#") <= 2]
    return ".".join([tag, *names])


def _path(parent: int, label: str) -> int:
    """A path as one number: the hash of its parent's and its last step."""
    import xxhash

    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), parent & (1 << 64) - 1) - (1 << 63)


def _furniture(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether tag or attributes say that an element is none of the article; ``inside``: within an article, whose own header stays."""
    if tag in FURNITURE or (tag == "header" and not inside):
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in FURNITURE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _named(tag: str, attrs: dict[str, str], names: frozenset[str] = FURNITURE_NAMES) -> bool:
    """Whether a class or the id is a furniture name as a whole: one such part, and no part that means something else. An article can only be a comment."""
    if not attrs or tag == "main" or (tag == "article" and names is not TALK_NAMES):
        return False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if any(x in names for x in parts) and all(x in FURNITURE_NAMES or x in NEUTRAL_NAMES for x in parts):
            return True
    return False


class Page:
    """Elements in page order (parents before children) and text blocks (innermost element, text, characters in links)."""

    def __init__(self, page: str | None) -> None:
        self.page = page or ""
        self.nodes = [Node("body", -1, 0, 0, False, False, False, False)]
        self.blocks: list[tuple[int, str, int]] = []
        self.stack = [0]
        self.open: dict[str, list[int]] = {"body": [0]}  # places on the stack of each open tag
        self.firm = [0]  # places on the stack of what is not inline
        self.text: list[str] = []
        self.linked = 0
        self.last = self.page.rfind(">")
        self.unclosed: dict[str, int] = {}  # from where on a quote is never closed
        self._parse()
        self._weigh()

    def _flush(self) -> None:
        if self.text:
            joined = " ".join("".join(self.text).split())
            if joined:
                self.blocks.append((self.stack[-1], joined, self.linked))
            self.text.clear()
        self.linked = 0

    def _put(self, raw: str) -> None:
        top = self.nodes[self.stack[-1]]
        if raw and not (top.skip and top.tag in INLINE):
            if "&" in raw:
                raw = html.unescape(raw)
            self.text.append(raw)
            if top.link:
                self.linked += len(raw)

    def _cut(self, k: int) -> None:
        """Closes the elements from place k of the stack on."""
        while len(self.stack) > k:
            tag = self.nodes[self.stack.pop()].tag
            self.open[tag].pop()
            if tag not in INLINE:
                self.firm.pop()

    def _push(self, node: Node) -> None:
        place = len(self.stack)
        self.stack.append(len(self.nodes))
        self.nodes.append(node)
        self.open.setdefault(node.tag, []).append(place)
        if node.tag not in INLINE:
            self.firm.append(place)

    def _latest(self, tags: tuple[str, ...] | frozenset[str]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _tag_end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` has its ``>``, outside quotes if these are closed; -1 if nowhere."""
        while at <= self.last:
            m = STOP.search(self.page, at)
            if m[0] == ">":
                return m.start()
            at = m.end()
            if m.start() < self.unclosed.get(m[0], len(self.page)):
                z = self.page.find(m[0], at)
                if z < 0 or z > self.last:
                    self.unclosed[m[0]] = m.start()
                else:
                    at = z + 1
        return -1

    def _parse(self) -> None:
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            z = page.find("<", at)
            if z < 0:
                self._put(page[at:])
                break
            self._put(page[at:z])
            follows = page[z + 1 : z + 2]
            if follows in ("!", "?"):
                end = page.find("-->", z + 4) if page.startswith("<!--", z) else page.find(">", z)
                at = size if end < 0 else end + (3 if page.startswith("<!--", z) else 1)
                continue
            close = follows == "/"
            m = NAME.match(page, z + 1 + close)
            if not m:
                self._put("<")
                at = z + 1
                continue
            end = self._tag_end(m.end())
            if end < 0:
                end = page.find(">", m.end())
                if end < 0:
                    break  # the page ends inside a tag
            at = end + 1
            if close:
                self._end(m[0].lower())
            else:
                at = self._start(m[0].lower(), page[m.end() : end], at)
        self._flush()

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        place = self.open.get(name)
        if place and place[-1] and (name not in INLINE or place[-1] > self.firm[-1]):
            self._cut(place[-1])

    def _start(self, name: str, raw: str, at: int) -> int:
        if name in RAW:
            if raw.endswith("/"):
                return at
            end = RAW_END[name].search(self.page, at)
            return end.end() if end else len(self.page)
        if name not in INLINE:
            self._flush()
        if name in VOID or name in ("html", "body"):
            return at
        if name in CLOSES_P or name in ("li", "dd", "dt", "tr", "td", "th"):
            closes = ("p",) if name in CLOSES_P else ("dd", "dt") if name in ("dd", "dt") else ("td", "th") if name in ("td", "th") else (name,)
            place = self._latest(closes)
            if place and place >= max(self._latest(CONTAINERS - set(closes)), self._latest(LISTS)):
                self._cut(place)
        top, number = self.nodes[self.stack[-1]], self.stack[-1]
        if name in INLINE and not raw:
            self._push(Node(name, number, top.path, top.depth, top.skip, False, top.link or name == "a", top.inside, top.talk))
            return at
        attrs = _attributes(raw)
        path, depth = (top.path, top.depth) if name in INLINE else (_path(top.path, _generalised(name, attrs)), top.depth + 1)
        skip = top.skip or _furniture(name, attrs, top.inside)
        comment = _named(name, attrs, TALK_NAMES)
        self._push(Node(name, number, path, depth, skip, comment or _named(name, attrs), top.link or name == "a", top.inside or name in ("article", "main"), top.talk or comment))
        return at

    def _weigh(self) -> None:
        """Settles what named elements are, and the good and bad characters of every element."""
        nodes = self.nodes
        for k, text, _ in self.blocks:
            if not nodes[k].skip:
                nodes[k].good += len(text)
        for n in reversed(nodes[1:]):
            if n.tag in ("article", "main") and not n.skip and not n.talk:
                n.article = max(n.article, n.good)
            up = nodes[n.parent]
            up.good += n.good
            up.article = max(up.article, n.article)
        total, article = nodes[0].good, nodes[0].article
        for n in nodes[1:]:
            if n.named and not n.article and (2 * n.good <= total or article):
                n.skip = True
            n.skip |= nodes[n.parent].skip
        for n in nodes:
            n.good = 0
        for k, text, links in self.blocks:
            if nodes[k].skip or 2 * links > len(text):
                nodes[k].junk += len(text)
            else:
                nodes[k].good += len(text)
        for n in reversed(nodes[1:]):
            nodes[n.parent].good += n.good
            nodes[n.parent].junk += n.junk

    def containers(self) -> list[Node]:
        return [n for k, n in enumerate(self.nodes) if not k or n.tag in CONTAINERS]

    def score(self, node: Node) -> float:
        """Share of the page's article-like text, less for the furniture that comes with it; semantic tags weigh more, and depth a little."""
        if not node.good or node.skip:
            return 0.0
        bonus = 0.2 if node.tag == "article" else 0.1 if node.tag == "main" else 0.0
        return node.good / self.nodes[0].good + bonus - 0.5 * node.junk / (node.good + node.junk) + 0.001 * min(node.depth, 50)

    def text_of(self, path: int | None, common: frozenset[int] = frozenset()) -> str:
        """Blocks inside the containers on ``path``, or in the page's best container, joined by one space; ``common``: paths of half the host's pages."""
        containers = self.containers()
        own = max(containers, key=self.score)
        chosen = [n for n in containers if n.path == path and n.good] if path is not None else []
        whole = own is not self.nodes[0] and own.path in common  # that the page holds something says nothing of it
        if sum(n.good for n in chosen) < (WHOLE_SHARE if whole else LEAST_SHARE) * own.good:
            chosen = [own]
        wanted, within = {id(n) for n in chosen}, []
        for n in self.nodes:
            within.append(id(n) in wanted or (n.parent >= 0 and within[n.parent]))
        return " ".join(text for k, text, _ in self.blocks if within[k] and not self.nodes[k].skip)


def extract(page: str | None, path: int | None, common: list[int] | None = None) -> str:
    """Text of a page on ``path``, or by its own best container."""
    return Page(page).text_of(path, frozenset(common or ()))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sums: dict[tuple[str, int, int], list[float]] = {}
        for host_, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            parsed = Page(page.as_py())
            found = parsed.containers()
            best = max(found, key=parsed.score)
            had = set()
            for n in found:
                if (score := parsed.score(n)) >= FLOOR:
                    vote = sums.setdefault((host_, n.path, n.depth), [0.0, 0])
                    vote[0] += score if n is best else score / 2
                    vote[1] += n.path not in had
                    had.add(n.path)
        cols = zip(*((*key, *vote) for key, vote in sums.items()), strict=True) if sums else ((),) * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "path", "depth", "score", "pages"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        got = [extract(page.as_py(), path, common) for page, path, common in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string())], names=["id", "url", "text"])


def host(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, path, score, common)``: the path with the largest sum of votes of the host's pages, ties to the deeper, then to the larger number; and the paths that half of the pages with text have."""
    rows = pages.select(host(pages[url_col].cast("string")).alias("host"), pages[html_col].cast("string").alias("html"))
    votes = rows.mapInArrow(_votes, "host string, path long, depth int, score double, pages long")
    votes = stage(votes.groupBy("host", "path", "depth").agg(F.round(F.sum("score"), 6).alias("score"), F.sum("pages").alias("pages")))
    best = votes.groupBy("host").agg(F.max_by("path", F.struct("score", "depth", "path")).alias("path"), F.max("score").alias("score"), F.max("pages").alias("most"))
    # a page votes for few paths, so few can be those of half the pages
    common = votes.join(best.select("host", "most"), "host").where(2 * F.col("pages") >= F.col("most")).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("common"))
    return best.join(common, "host").select("host", "path", "score", "common")


#: Hosts whose winning paths are sent to every task; with more, pages and paths are joined by host.
MAX_BROADCAST_HOSTS = 100_000


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)`` per row of ``pages``; an empty text where there is none.

    Null and empty pages give an empty text. Pages without a host vote together.
    Repeated rows and null ids come back as they are; an empty table gives no
    rows; other columns are ignored.
    """
    paths = stage(winning_paths(pages, url_col, html_col).select("host", "path", "common"))
    if paths.count() <= MAX_BROADCAST_HOSTS:
        paths = F.broadcast(paths)
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    rows = rows.withColumn("host", host(F.col("url"))).join(paths, "host", "left").select("id", "url", "html", "path", "common")
    return rows.mapInArrow(_texts, "id long, url string, text string")
