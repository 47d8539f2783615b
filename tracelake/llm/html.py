"""Main text of web pages, with site templates removed.

Each page is parsed in one forward pass into a forgiving element tree. Every block element's subtree gets a hash of its
tag, class, id, text and children. Spark counts on how many different pages of a host each subtree stands, pages with
the same text being one; those on many are the site's template and are deleted before the text is taken. Inside the
page's article or main element a container must stand on more than INNER_SHARE of a host's pages to be template, and an
element of plain text on more than TEXT_SHARE of those of a host with TEXT_PAGES pages, so that what a host prints on
some of its pages stays.

Recurrence can't tell all that is not the article: of a host with few pages there is no template, and readers' comments
are new on each page. So elements that are boilerplate by tag, by role, or by a class or id that says nothing else go
as well ("comments", "ad-box"; not "related-work"), and, outside article and main, containers of at least MENU links
that hold no other text.

The text is that of the article element with the most text, else of main, else of the body. Block elements make blocks;
white space within one becomes one space; blocks are joined by two line feeds.

Plan: the counts of a host's subtrees are partial before the shuffle; what comes out is one small row for each host that
has a template. Pages meet it by host: in place while Spark finds these rows small enough to send to all tasks, else by
a join that adaptive execution splits where a host is too large.

Null html counts as empty and gives an empty text. Null urls have the empty host. Rows with repeated ids are extracted
one by one. Broken markup costs no more time than its length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import sliced, stored, table
from .urls import split_url

#: A template stands on so many pages of its host, and on this share of them: outside the article, its containers, its text.
PAGES, SHARE = 5, 0.05
INNER_PAGES, INNER_SHARE = 10, 0.5
TEXT_PAGES, TEXT_SHARE = 20, 0.9
OUTSIDE, INSIDE, TEXT = 0, 1, 2
MENU = 3

OPEN = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: The rest of a tag. Only a quote after "=" hides a ">"; the pattern never goes back.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>""")
ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?![^\s/>"'])""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text of the page.
RAW = frozenset("script style textarea title noscript template iframe select noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul xmp".split())
INLINE_BLOCK = frozenset(("td", "th"))
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr".split())
#: What an opening tag closes, and where that search stops.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button head input".split())
#: A class or id is boilerplate if its first word is one of these and all others are of the second list or numbers.
KINDS = frozenset("ad ads adv advert adverts advertisement adsense banner promo promos promotion sponsor sponsored cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs toolbar share sharing social related recommended recommendations comment comments commentlist replies reply disqus footer masthead topbar copyright pagination pager search skip".split())
LAYOUT = frozenset("area articles bar big block body bottom box button buttons container content footer form group header holder icons inner item items left link links list main media message module nav outer panel posts primary right row secondary section site slot small stories text thread title top unit wrap wrapper zone".split()) | KINDS
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "hash", "named")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.hash, self.named = tag, attrs, [], 0, None


def parse(html: str) -> Node:
    root = Node("html")
    stack: list[Node] = [root]
    open_: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    at, end, last, quotes = 0, len(html), html.rfind(">"), True

    def close(place: int) -> None:
        while len(stack) > place:
            open_[stack.pop().tag].pop()

    def text(low: int, high: int) -> None:
        if high > low:
            stack[-1].children.append(html[low:high])

    shown = 0  # text up to here is in the tree
    while (at := html.find("<", at)) != -1 and at < last:
        if html.startswith("<!--", at):
            text(shown, at)
            found = html.find("-->", at + 4)
            at = shown = found + 3 if found != -1 else end
            continue
        if html.startswith(("<!", "<?"), at):
            text(shown, at)
            at = shown = html.find(">", at) + 1
            continue
        m = OPEN.match(html, at)
        if not m:
            at += 1
            continue
        rest = REST.match(html, m.end()) if quotes else None
        if rest:
            stop = rest.end()
        else:  # a quote that never ends: from here on quotes hide nothing
            quotes, stop = False, html.find(">", m.end()) + 1
        text(shown, at)
        tag, attrs, closing = m[1].lower(), html[m.end() : stop - 1], html[at + 1] == "/"
        at = shown = stop
        if closing:
            if open_[tag]:
                close(open_[tag][-1])
            continue
        if tag == "html":
            continue
        alone = attrs.endswith("/")
        if tag in RAW and not alone:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = shown = found.end() if found else end
            continue
        if tag in BLOCK and open_["p"]:
            close(open_["p"][-1])
        if tag in CLOSES:
            shut, stops = CLOSES[tag]
            bound = max((open_[t][-1] for t in stops if open_[t]), default=0)
            places = [p for t in shut for p in reversed(open_[t][-1:]) if p > bound]
            while places:
                close(max(places))
                places = [p for t in shut for p in open_[t][-1:] if p > bound]
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag == "xmp":
            found = re.compile(r"</xmp\s*>", re.I).search(html, at)
            node.children.append(html[at : found.start() if found else end].replace("&", "&amp;"))
            at = shown = found.end() if found else end
        elif tag not in VOID and not alone:
            open_[tag].append(len(stack))
            stack.append(node)
    tail = html.find("<!--", max(shown, last + 1))
    text(shown, end if tail == -1 else tail)
    return root


def names(node: Node) -> dict[str, str]:
    if node.named is None:
        node.named = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(node.attrs)} if node.attrs else {}
    return node.named


def telling(value: str) -> bool:
    """Whether one of the names in a class or id says that this isn't the article."""
    for name in value.split():
        first, *others = [w for w in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if w] or [""]
        if first.lower() in KINDS and all(w.lower() in LAYOUT or w.isdigit() for w in others):
            return True
    return False


def boilerplate(node: Node, inside: bool) -> bool:
    """By its tag, role, class or id. A header inside the article is the article's own."""
    if node.tag in BOILERPLATE_TAGS or (node.tag == "header" and not inside):
        return True
    if not node.attrs or node.tag in ("body", "html", "main"):
        return False
    a = names(node)
    if node.tag == "article":
        return bool(re.search(r"(?<![^\s_-])comments?(?![^\s_-])", a.get("class", ""), re.I))
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return a.get("role", "").lower() in ROLES or telling(a.get("class", "")) or telling(a.get("id", ""))


def mark(node: Node, out: dict[int, int]) -> None:
    """Hashes the subtrees, bottom up; `out` gets the place (OUTSIDE, INSIDE or TEXT) of each that may be a template. Walks without recursion."""
    order, todo = [], [(node, False)]
    while todo:
        n, within = todo.pop()
        order.append((n, within))
        within = within or n.tag in ("article", "main")
        todo.extend((c, within) for c in n.children if isinstance(c, Node))
    for n, within in reversed(order):
        parts = [n.tag]
        if n.attrs:
            a = names(n)
            parts += [a.get("class", ""), a.get("id", "")]
        some = False
        for c in n.children:
            if isinstance(c, Node):
                if c.hash:
                    parts.append(str(c.hash))
                    some = True
            elif c := " ".join(c.split()):
                parts.append("=" + c)
                some = True
        n.hash = xxh64_intdigest("\x1f".join(parts)) >> 1 if some else 0
        if n.hash and n.tag in BLOCK and n.tag not in ("html", "body", "article", "main"):
            out[n.hash] = OUTSIDE if not within else TEXT if n.tag in TEXT_BLOCK else INSIDE


def size(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                if c.tag not in BOILERPLATE_TAGS:
                    todo.append(c)
            else:
                total += len(c)
    return total


def main_of(root: Node) -> Node:
    """The non-boilerplate article with the most text, else the main element, else all."""
    articles, mains, todo = [], [], [(root, False)]
    while todo:
        n, in_main = todo.pop()
        if n.tag == "article":
            articles.append(n)
            continue
        if not in_main and (n.tag == "main" or names(n).get("role") == "main"):
            mains.append(n)
            in_main = True
        todo.extend((c, in_main) for c in reversed(n.children) if isinstance(c, Node) and not boilerplate(c, False))
    found = articles or mains
    return max(found, key=size) if found else root


def menus(root: Node) -> set[int]:
    """id() of the outermost blocks with at least MENU links and no text beside them."""
    order, todo = [], [(root, False)]
    while todo:
        n, linked = todo.pop()
        order.append((n, linked))
        linked = linked or n.tag == "a"
        todo.extend((c, linked) for c in n.children if isinstance(c, Node))
    links, plain, out = defaultdict(int), defaultdict(bool), set()
    for n, linked in reversed(order):
        links[id(n)] += n.tag == "a" and bool(n.children)
        for c in n.children:
            if isinstance(c, Node):
                links[id(n)] += links[id(c)]
                plain[id(n)] |= plain[id(c)]
            else:
                plain[id(n)] |= not linked and n.tag != "a" and any(x.isalnum() for x in c)
        if n.tag in BLOCK and n.tag not in ("html", "body") and links[id(n)] >= MENU and not plain[id(n)]:
            out.add(id(n))
    return out


def text_of(root: Node, template: frozenset[int] = frozenset()) -> str:
    start = main_of(root)
    inside = start is not root
    linked = set() if inside else menus(root)
    blocks, buffer = [], []

    def flush() -> None:
        if t := " ".join(unescape("".join(buffer)).split()):
            blocks.append(t)
        buffer.clear()

    todo: list = [start]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            buffer.append(n)
        elif n is not start and (boilerplate(n, inside) or n.hash in template or id(n) in linked):
            if n.tag in BLOCK:
                flush()
        elif n.tag == "br" or n.tag in INLINE_BLOCK:
            buffer.append(" ")
            todo.extend(reversed(n.children))
        else:
            if n.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(n.children))
    flush()
    return "\n\n".join(blocks)


def extract(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """The page's main text without the template's subtrees."""
    if not html:
        return ""
    root = parse(html)
    if template:
        mark(root, {})
    return text_of(root, template)


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, h, place): the hashed subtrees of each page, and one row with h = 0 for the page; `page` is the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            host, page, h, place = [], [], [], []
            for x, html in zip(b.column(0).to_pylist(), b.column(1)):
                found: dict[int, int] = {0: OUTSIDE}
                root = parse(html.as_py().decode())
                mark(root, found)
                host += [x] * len(found)
                page += [xxh64_intdigest(text_of(root)) >> 1] * len(found)
                h += found.keys()
                place += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(h, pa.int64()), pa.array(place, pa.int32())], names=["host", "page", "h", "place"])

    return pages.where("length(html) > 0").select("host", F.col("html").cast("binary").alias("html")).mapInArrow(run, "host string, page long, h long, place int")


def templates(found: DataFrame) -> DataFrame:
    """(host, template): hashes of the subtrees that stand on many pages of their host."""
    counted = stored(found.distinct().groupBy("host", "h", "place").agg(F.count("*").alias("n")).where((F.col("n") >= PAGES) | (F.col("h") == 0)))
    pages = counted.where("h = 0").select("host", F.col("n").alias("pages"))
    place, least = F.col("place"), lambda n, share: F.greatest(F.lit(n), F.col("pages") * share)
    enough = F.when(place == OUTSIDE, least(PAGES, SHARE)).when(place == INSIDE, least(INNER_PAGES, INNER_SHARE)).otherwise(least(TEXT_PAGES, TEXT_SHARE))
    return counted.where("h <> 0").join(pages, "host").where(F.col("n") >= enough).groupBy("host").agg(F.collect_set("h").alias("template"))


def main_texts(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """page_id, url and text of every row, and how many template subtrees its host has."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), split_url(F.col(url))[0].alias("host"), F.col(html).alias("html"))
    of_host = stored(templates(subtrees(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):
            known: dict = {}
            template = [known.setdefault(x, frozenset(x or ())) for x in (tuple(t) if t else None for t in b.column(3).to_pylist())]
            out = [extract(h.as_py().decode() if h.is_valid else None, t) for h, t in zip(b.column(2), template)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, template), pa.int32())], names=["page_id", "url", "text", "templates"])

    joined = rows.join(of_host, "host", "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "template")
    return joined.mapInArrow(run, f"page_id {pages.schema[page_id].dataType.simpleString()}, url string, text string, templates int")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "templates")
