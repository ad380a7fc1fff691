"""Main text of web pages by consensus host paths.

Each page's containers are scored by the prose that they hold outside links; the best container's path, generalised to
tags and classes without digits, is a vote. Spark adds up the votes of each host, and every page is extracted again with
its host's winning path, all containers of it in page order, or with its own best container where none has that path. So
one odd page, whose advert is longer than its article, follows its host.

Names are a hint only. A container is set aside if the whole of a class, id or role is made of words for menus,
adverts, comments and the like, and no other name on it says content; where that leaves no prose at all, the page is
read without these hints. Headings are never set aside by a name, and paragraphs only by a class for adverts, comments
and sharing: ids there are anchors. Words that an article's parts have too (SOFT) don't count for a section, or for an
id, inside what is named or marked as the article if it holds PROSE characters outside links and few inside. Elements that mean something else
than the article (nav, aside, a site's header and footer) are set aside whatever their names; a form or field set if it
has no article, main part or first heading and less than CONTROL characters of prose for each control.

A page is scanned once from left to right, to any depth. An end tag of an inline element is looked for among the nearest
REACH open elements, so time grows with a page's length, whatever it holds.

Votes are pre-aggregated before they are shuffled. Winners are broadcast only if their counted bytes are at most
MOST_BROADCAST; else pages meet them by host, a host with more than its part of the pages salted by its counted size.
Null or empty html: empty text. Null url: the host is empty. Repeated pages and null ids are rows of their own and vote
each; of paths with equal votes the larger wins. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

REACH = 256
PROSE, CONTROL = 80, 40
MOST_BROADCAST = 8 << 20
#: Pages of a host in one salt, as a share of all pages and at least; slices of all pages.
SLICE, MOST_SLICES = 1000, 200_000
#: A block beside a container with fewer letters and digits than these is a mark, not prose.
LETTERS = 2
#: Elements whose content is no text of the article. RAW ones end only at their own end tag.
RAW = {"script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp"}
DROPPED = {"noscript", "template", "svg", "canvas", "select", "annotation", "annotation-xml", "audio", "video"}
ASIDE = {"nav", "footer", "aside", "button", "dialog", "menu"}
FORM = {"form", "fieldset"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "caption", "figcaption", "summary"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *ASIDE, *FORM,
}
CONTAINER = {"article", "body", "center", "div", "html", "main", "section", "table", "tbody", "td", "tr", "blockquote", "figure", "dl", "ul", "ol"}
CLOSES_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body"}
#: Words for what is not the article, words that may stand with them, and words for the article itself.
OTHER = set(
    """ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar menu nav navbar navigation footer masthead
    comment comments commentlist discussion trackbacks pingbacks reply respond replies disqus cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup share
    sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets toolbar skiplink disclaimer contentinfo complementary topbar alert search searchbox searchform""".split()
)
WITH = set(
    """block box wrapper wrap container holder list section area item items inner outer bar top bottom left right side site page main global primary secondary panel
    row col column group links link buttons button unit slot post article entry the my side-bar skip to form header footer body reader readers user users visitor fb facebook google sticky fixed new latest""".split()
)
HEADER = {"header", "site", "page", "top", "global", "main", "wrapper", "container", "inner", "bar", "banner"}
#: Of OTHER, the words that parts of an article are named by too.
SOFT = {"discussion", "search", "notice", "notices", "alert", "disclaimer", "related", "promotion", "navigation", "menu", "widget", "widgets", "overlay", "banner", "respond", "reply", "replies", "recommended", "recommendations"}
CONTENT = {"content", "post", "article", "entry", "story", "text", "prose", "articlebody", "maincontent"}
TAG = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*(=)\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")
NAMES = ("class", "id", "role", "hidden", "aria-hidden", "style", "type")
BLANK = re.compile(r"\s+")
PART = re.compile(r"[a-z]+")


def tag_at(text: str, at: int) -> tuple[str, dict[str, str], bool, int]:
    """The tag whose name begins at a place: name, the attributes that matter, whether it closes itself, and where it
    ends (-1: the page ends in it). Quotes count after an equals sign only, so one is looked for once."""
    m = TAG.match(text, at)
    tag, at, n, given = m[0].lower(), m.end(), len(text), {}
    while True:
        close = text.startswith("/", at) or text.startswith("/>", at)
        while at < n and (text[at] in "/" or text[at].isspace()):
            close = text[at] == "/"
            at += 1
        if at >= n:
            return tag, given, False, -1
        if text[at] == ">":
            return tag, given, close, at + 1
        m = ATTRIBUTE.match(text, at)
        name, at, value = m[1].lower(), m.end(), ""
        if m[2]:
            if at < n and text[at] in "\"'":
                end = text.find(text[at], at + 1)
                if end < 0:
                    return tag, given, False, -1
                value, at = text[at + 1 : end], end + 1
            else:
                m = UNQUOTED.match(text, at)
                value, at = m[0], m.end()
        if name in NAMES:
            given.setdefault(name, value)


def other(given: dict[str, str], names: tuple[str, ...] = ("class", "id", "role"), firm: bool = False) -> bool:
    """Whether an element's names say that it is not the article. firm: words of SOFT don't count."""
    found, words = False, OTHER - SOFT if firm else OTHER
    for name in " ".join(given.get(x, "") for x in names).lower().split():
        parts = set(PART.findall(name.replace("side-bar", "sidebar")))
        if parts & CONTENT and not parts & OTHER:
            return False
        found |= bool(parts & words and parts <= OTHER | WITH) or ("header" in parts and parts <= HEADER)
    return found


def named_content(given: dict[str, str]) -> bool:
    return any((parts := set(PART.findall(name))) & CONTENT and not parts & OTHER for name in f"{given.get('class', '')} {given.get('id', '')}".lower().split())


@dataclass
class Node:
    tag: str
    name: str  # tag and classes without digits
    parent: int
    aside: bool
    hinted: bool
    first: int  # of the pieces
    last: int = 0  # the piece after its last
    prose: int = 0  # characters outside links and what is set aside, with those of descendants
    headed: bool = False
    core: bool = False  # holds an article, a main part or a first heading
    soft: bool = False  # hinted by words of SOFT alone, or by an id of them
    content: bool = False  # a name says that it is the article, or it is in such a one
    controls: int = 0  # fields and buttons
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    pieces: list[tuple[int, int, str]]  # node, block, text
    skip: list[bool]  # of nodes
    link: list[bool]

    def path(self, k: int) -> str:
        out = []
        while k >= 0:
            out.append(self.nodes[k].name)
            k = self.nodes[k].parent
        return ">".join(reversed(out))

    def at(self, path: str) -> list[int]:
        """The nodes with prose that have a path."""
        reached, out = [-1] * len(self.nodes), []  # how much of the path a node's own path is, or -1
        for k, x in enumerate(self.nodes):
            begin = 0 if x.parent < 0 else reached[x.parent] + 1 if reached[x.parent] >= 0 and path.startswith(">", reached[x.parent]) else -1
            if begin >= 0 and path.startswith(x.name, begin):
                reached[k] = begin + len(x.name)
                if reached[k] == len(path) and x.prose:
                    out.append(k)
        return out


def parse(text: str) -> Page:
    """The tree of containers, with the texts in page order; unclosed and stray tags are mended as browsers do."""
    nodes, pieces, stack, block, at = [Node("html", "html", -1, False, False, 0)], [], [0], 0, 0
    opened: dict[str, int] = {}  # of each tag, how many are in the stack
    unended: set[str] = set()

    def words(raw: str) -> None:
        if raw:
            pieces.append((stack[-1], block, entities.unescape(raw)))

    def close(k: int) -> None:
        for x in stack[k:]:
            nodes[x].last = len(pieces)
            opened[nodes[x].tag] -= 1
        del stack[k:]

    n = len(text)
    while at < n:
        begin = text.find("<", at)
        if begin < 0 or begin + 1 >= n:
            words(text[at:])
            break
        sign = text[begin + 1]
        ending = sign == "/" and text[begin + 2 : begin + 3].isalpha() and text[begin + 2].isascii()
        if not (ending or sign in "!?/" or (sign.isalpha() and sign.isascii())):
            words(text[at : begin + 1])
            at = begin + 1
            continue
        words(text[at:begin])
        if not (ending or sign.isalpha()):
            if text.startswith("<!--", begin) and not text.startswith(("<!-->", "<!--->"), begin):
                end = text.find("-->", begin + 4)
                at = n if end < 0 else end + 3
            else:
                end = text.find(">", begin + 2)
                at = n if end < 0 else end + 1
            continue
        tag, given, closed, at = tag_at(text, begin + 1 + ending)
        if at < 0:
            break
        if tag in ("html", "head"):
            block += 1
            continue
        if ending:
            if opened.get(tag):
                wide = tag in CONTAINER or tag in ASIDE or tag in FORM
                for k in range(len(stack) - 1, 0 if wide else max(0, len(stack) - 1 - REACH), -1):
                    if nodes[stack[k]].tag == tag:
                        close(k)
                        break
                    if nodes[stack[k]].tag in CONTAINER and not wide:
                        break
            block += tag in BLOCK
            continue
        if tag in VOID:
            if tag == "hr":
                block += 1
            elif tag == "br":
                words(" ")
            elif tag == "input":
                nodes[stack[-1]].controls += given.get("type", "").lower() != "hidden"
            continue
        if tag in RAW or tag in DROPPED:
            nodes[stack[-1]].controls += tag in ("select", "textarea")
            if closed and tag == "svg":
                continue
            end = None if tag in unended else re.compile(f"</{tag}(?![a-z0-9-])", re.I).search(text, at)
            if end:
                at = tag_at(text, end.start() + 2)[3]
                if at < 0:
                    break
            elif tag in RAW:
                break
            else:
                unended.add(tag)
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd"):
            ends = {"p"} | ({"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else set())
            if any(opened.get(x) for x in ends):
                for k in range(len(stack) - 1, max(0, len(stack) - 1 - REACH), -1):
                    if nodes[stack[k]].tag in ends:
                        close(k)
                        break
                    if nodes[stack[k]].tag in CONTAINER or nodes[stack[k]].tag in ASIDE or nodes[stack[k]].tag in FORM:
                        break
        block += tag in BLOCK
        if closed and tag not in BLOCK:
            continue
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").lower().replace(" ", "")
        if tag in ("body", "article", "main") or tag in HEADING:
            hinted = soft = False
        elif tag in CONTAINER or tag in BLOCK - {"p", "pre", "address", "hr"}:
            hinted = other(given)
            soft = hinted and not (other(given, ("class", "role")) and tag != "section") and not other(given, firm=True)
        else:
            hinted, soft = other(given, ("class", "role"), firm=True), False
        classes = ".".join(sorted(set(re.sub(r"\d+", "", given.get("class", "")).split())))
        nodes.append(Node(tag, f"{tag}.{classes}" if classes else tag, stack[-1], tag in ASIDE or hidden, hinted, len(pieces), soft=soft, core=tag in ("article", "main", "h1"), content=tag in ("article", "main") or named_content(given), controls=tag == "button"))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
        opened[tag] = opened.get(tag, 0) + 1
    nodes[0].last = len(pieces)
    opened["html"] = 1
    close(0)
    for x in reversed(nodes[1:]):
        x.headed |= x.tag in ("h1", "h2")
        nodes[x.parent].headed |= x.headed
        nodes[x.parent].core |= x.core
        nodes[x.parent].controls += x.controls
    within = [False] * len(nodes)
    for k, x in enumerate(nodes):  # a header is the site's, unless it stands in an article and has its heading
        within[k] = x.tag in ("article", "main") or (x.parent >= 0 and within[x.parent])
        if x.tag == "header":
            x.aside |= not within[k] or not x.headed
        if x.hinted and x.headed and within[k] and "header" in x.name:
            x.hinted = False
        x.content |= x.parent >= 0 and nodes[x.parent].content
        x.soft &= x.content
    link = [False] * len(nodes)
    for k, x in enumerate(nodes):
        link[k] = x.tag == "a" or (x.parent >= 0 and link[x.parent])
    page = Page(nodes, pieces, [], link)
    if not weigh(page, True):
        weigh(page, False)
    return page


def weigh(page: Page, hints: bool) -> bool:
    """Set aside what is not the article and add up the prose of each container. Whether there is any."""
    doubtful = [k for k, x in enumerate(page.nodes) if x.tag in FORM or x.soft] if hints else []
    if doubtful:  # first with all of these, to see what they hold
        tally(page, lambda x: x.aside or (x.hinted and not x.soft))
        for k in doubtful:
            x = page.nodes[k]
            if x.tag in FORM and not x.core and x.prose < CONTROL * x.controls:
                x.aside = True
            elif x.soft and x.prose >= PROSE and 3 * linked(page, x) < x.prose:
                x.hinted = False
    tally(page, lambda x: (x.aside and (hints or x.tag not in FORM)) or (hints and x.hinted))
    return page.nodes[0].prose > 0


def linked(page: Page, x: Node) -> int:
    return sum(len(t.strip()) for k, _, t in page.pieces[x.first : x.last] if page.link[k])


def tally(page: Page, aside) -> None:
    skip = [False] * len(page.nodes)
    for k, x in enumerate(page.nodes):
        skip[k] = aside(x) or (x.parent >= 0 and skip[x.parent])
        x.prose = 0
    for k, _, t in page.pieces:
        if not skip[k] and not page.link[k]:
            page.nodes[k].prose += len(t.strip())
    for x in reversed(page.nodes[1:]):
        page.nodes[x.parent].prose += x.prose
    page.skip = skip


def best_container(page: Page) -> int:
    """From the root down to where the prose parts, or to the article. A child is entered only if no prose stays behind."""
    at = 0
    while True:
        inner = [k for k in page.nodes[at].children if page.nodes[k].tag in CONTAINER and not page.skip[k]]
        semantic = [k for k in inner if page.nodes[k].tag in ("article", "main") and page.nodes[k].prose]
        if semantic:
            at = max(semantic, key=lambda k: page.nodes[k].prose)
            if page.nodes[at].tag == "article":
                return at
            continue
        down = [k for k in inner if page.nodes[k].prose > 0.6 * page.nodes[at].prose and page.nodes[k].tag not in ("ul", "ol", "dl", "blockquote", "figure")]
        if not down or left_behind(page, at, down[0]):
            return at
        at = down[0]


def left_behind(page: Page, at: int, child: int) -> bool:
    """Whether a container holds prose outside one of its children: a block of LETTERS letters or digits outside links."""
    outer, inner, blocks = page.nodes[at], page.nodes[child], {}
    if inner.prose == outer.prose:
        return False
    for part in (range(outer.first, inner.first), range(inner.last, outer.last)):
        for p in part:
            k, b, t = page.pieces[p]
            if not page.skip[k] and not page.link[k]:
                blocks[b] = blocks.get(b, 0) + sum(map(str.isalnum, t))
                if blocks[b] >= LETTERS:
                    return True
    return False


def text_of(page: Page, containers: list[int]) -> str:
    inside, chosen = [False] * len(page.nodes), set(containers)
    for k, x in enumerate(page.nodes):
        inside[k] = k in chosen or (x.parent >= 0 and inside[x.parent])
    blocks: dict[int, list[str]] = {}
    for k, b, t in page.pieces:
        if inside[k] and not page.skip[k]:
            blocks.setdefault(b, []).append(t)
    return "\n".join(x for x in (BLANK.sub(" ", "".join(v)).strip() for v in blocks.values()) if x)


def vote(html: str) -> str:
    page = parse(html)
    return page.path(best_container(page))


def extract(html: str, path: str | None) -> str:
    page = parse(html)
    return text_of(page, (page.at(path) if path else []) or [best_container(page)])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages. broadcast: most bytes of winners that are broadcast."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    def votes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([vote(h or "") for h in b.column(1).to_pylist()], pa.string())], ["host", "path"])

    counted = cut(own.select("host", "html").where("length(html) > 0").mapInArrow(votes, "host string, path string").groupBy("host", "path").count())
    winner = counted.groupBy("host").agg(F.max_by("path", F.struct("count", "path")).alias("path"), F.sum("count").alias("pages"))
    size = winner.agg(F.sum(F.octet_length("path") + F.octet_length("host") + 32).alias("bytes"), F.sum("pages").alias("pages")).first()
    if (size["bytes"] or 0) <= broadcast:
        met = own.join(F.broadcast(winner.drop("pages")), "host", "left")
    else:
        # fewer hosts than slices can have more than a slice of the pages
        most = max(1, (size["pages"] or 0) // min(MOST_SLICES, max(16, size["pages"] // SLICE)))
        salts = F.ceil(F.col("pages") / most).cast("int")
        hot = F.broadcast(winner.where(F.col("pages") > most).select("host", salts.alias("salts")))
        winner = winner.select("host", "path", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.col("salts"))).cast("int")
        met = own.join(hot, "host", "left").withColumn("salt", salt).join(winner, ["host", "salt"], "left")

    def texts(batches):
        for b in batches:
            out = [extract(h or "", p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(own.dtypes)
    return met.select("page_id", "url", "html", "path").mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
