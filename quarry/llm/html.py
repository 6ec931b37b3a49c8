"""Main text of web pages: site templates are found by counting element subtrees per host, then the blocks that are left
are read without the page's furniture.

A subtree that recurs beside many different texts of the host is a template. So is each subtree in a slot, which is a
place in the page (the tags and names down to it), if what the host's pages have there often recurs: a menu, an advert or
a footer that is filled from a stock of texts goes also where its filling is met once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import materialize

#: A subtree is a template's if it is met beside at least this many different texts of the host, and beside this share of
#: them all: outside articles and inside.
LEAST_PAGES = 4
PAGE_SHARE = 0.05
ARTICLE_SHARE = 0.3
#: A slot is a template's if this share of its uses recur, this share of the host's pages use it, and no more than that share
#: of the pages has its longest text there.
SLOT_AGAIN = 0.08
SLOT_SHARE = 0.3
SLOT_LONGEST = 0.05
#: Parts into which the pages of a host are dealt.
SALT = 32
#: A page or article whose other text is shorter than this share of a subtree's text is a copy of that subtree, not one that has it as furniture.
OTHER_TEXT = 0.1

#: HTML element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER = frozenset("script style noscript iframe template svg canvas object head title nav footer aside form button select option textarea input label fieldset dialog menu audio video map math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag of the key closes an open element of its values first.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: Elements out of which a stray end tag or an implied end does not reach.
WALLS = frozenset("html body article main section div table td th ul ol dl blockquote aside nav header footer form figure details".split())
#: Words of class, id and role that name page furniture.
FURNITURE = frozenset(
    "nav navbar navigation menu menus sidebar side rail footer header masthead banner topbar toolbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert "
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments reply replies respond disqus discussion share sharing social "
    "related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager widget search contentinfo complementary dialog skip".split()
)
#: Elements whose content is no text of the page.
UNSEEN = frozenset("script style noscript iframe template svg canvas object head title".split())
#: Blocks of running text, lists and tables, which are never taken out on their own, only with what holds them: headings, labels
#: and fixed phrases recur on the pages of a site too.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 hgroup hr pre blockquote figcaption li dt dd tr td th thead tbody tfoot caption summary legend option address center".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)>", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class Node:
    __slots__ = ("tag", "names", "hidden", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.names = [w.lower() for m in _NAMES.finditer(attributes) for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", m[2] or m[3] or m[4] or "") if w] if attributes else []
        self.hidden = bool(attributes and _HIDDEN.search(attributes))


def parse(html: str | None) -> Node:
    """A tree of elements and texts of any markup, with HTML's usual omitted end tags."""
    root = Node("#root")
    stack, at, html = [root], 0, html or ""
    size = len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in WALLS and tag not in WALLS:
                    break
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag in BLOCK else None)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    if stack[-1].tag not in closes:
                        break
                elif stack[k].tag in WALLS and stack[k].tag not in closes:
                    break
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(html, at)
            if tag not in ("script", "style"):
                node.children.append(html[at : end.start()])
            at = end.end()
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def furniture(node: Node, inside: bool) -> bool:
    """Whether an element is page furniture by its name, its attributes or, outside an article, as a header."""
    if node.tag in NEVER or node.hidden or (node.tag == "header" and not inside):
        return True
    return node.tag not in ("html", "body", "main", "#root") and not FURNITURE.isdisjoint(node.names)


def containers(root: Node, tag: str) -> list[Node]:
    """The outermost elements of that name that aren't inside furniture."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        for x in reversed(node.children):
            if isinstance(x, Node) and (x.tag == tag and not (FURNITURE & set(x.names)) or not furniture(x, False)):
                todo.append(x)
        if node.tag == tag:
            found.append(node)
            todo = [x for x in todo if x not in node.children]
    return found


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def holds_blocks(node: Node) -> bool:
    """Whether an element may be a part of a page on its own, as sections, lists and tables may, but no block of text."""
    return node.tag in BLOCK and node.tag not in PLAIN


def at_edges(root: Node, dropped: set[int]) -> set[int]:
    """Of the elements to be dropped those that stand at an edge of what holds them: between them and its beginning or end is
    nothing but furniture and others that are dropped. What stands between two parts that stay is a part of their text."""
    kept: set[int] = set()
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        parts = [x for x in node.children if (x.tag not in UNSEEN and x.tag not in VOID if isinstance(x, Node) else x.strip())]
        for row in (parts, parts[::-1]):
            for x in row:
                if isinstance(x, str) or not (id(x) in dropped or furniture(x, inside)):
                    break
                kept.add(id(x))
        todo += [(x, inside) for x in parts if isinstance(x, Node) and id(x) not in kept]
    return kept & dropped


def subtree_hashes(root: Node) -> tuple[dict[int, int], dict[int, int]]:
    """The hash of each element's subtree (tag, names and text), by id of the node; and the slots, by id, of those with
    text outside any article or main element and with none in them, which may be a template's."""
    own: dict[int, int] = {}
    found: dict[int, int] = {}
    holders: set[int] = set()
    todo: list[tuple[Node, bool, bool, int]] = [(root, False, False, 0)]
    while todo:
        node, inside, done, above = todo.pop()
        inside = inside or node.tag in ("article", "main")
        if not done:
            slot = signed(xxhash.xxh3_64_intdigest(f"{above:x}<{node.tag} {' '.join(node.names)}>"))
            todo.append((node, inside, True, slot))
            todo += [(x, inside, False, slot) for x in node.children if isinstance(x, Node)]
            continue
        parts = [f"{own[id(x)]:x}" if isinstance(x, Node) else " ".join(x.split()) for x in node.children]
        own[id(node)] = signed(xxhash.xxh3_64_intdigest(f"<{node.tag} {' '.join(node.names)}>" + "\x00".join(p for p in parts if p)))
        if node.tag in ("article", "main") or any(isinstance(x, Node) and id(x) in holders for x in node.children):
            holders.add(id(node))
        elif not inside and any(parts) and holds_blocks(node) and node.tag not in UNSEEN and node.tag not in ("#root", "html", "body"):
            found[id(node)] = above
    return own, found


def tops(root: Node) -> list[Node]:
    """The outermost article elements, and the main elements that aren't in one."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            found.append(node)
        if node.tag != "article":
            todo += [x for x in reversed(node.children) if isinstance(x, Node)]
    return found


def beside(top: Node, enter, able) -> tuple[list[tuple[Node, int | None, bool]], int]:
    """The subtrees with text below `top` that `able` names, each with what tells this page or article apart from others
    that have it too: the hash of the longest text of `top` outside the subtree, None if little else stands there; and
    whether the longest text of all stands in it. Then that text's hash. enter(x) says whether x is read."""
    texts: list[str] = []
    spans: list[tuple[Node, int, int]] = []
    todo: list[tuple[Node, int]] = [(top, -1)]
    while todo:
        node, start = todo.pop()
        if start >= 0:
            if id(node) in able:
                spans.append((node, start, len(texts)))
            continue
        direct = " ".join(" ".join(x for x in node.children if isinstance(x, str)).split())
        todo.append((node, len(texts)))
        if direct:
            texts.append(direct)
        todo += [(x, -1) for x in reversed(node.children) if isinstance(x, Node) and enter(x)]
    sizes = [len(t) for t in texts]
    before, after, sums = [-1], [-1], [0]
    for k in range(len(texts)):
        before.append(k if before[-1] < 0 or sizes[k] > sizes[before[-1]] else before[-1])
        sums.append(sums[-1] + sizes[k])
    for k in range(len(texts) - 1, -1, -1):
        after.append(k if after[-1] < 0 or sizes[k] >= sizes[after[-1]] else after[-1])
    after.reverse()
    marks: dict[int, int] = {}

    def mark(k: int) -> int:
        if k not in marks:
            marks[k] = signed(xxhash.xxh3_64_intdigest(texts[k]))
        return marks[k]

    found = []
    for node, start, end in spans:
        within = sums[end] - sums[start]
        others = [k for k in (before[start], after[end]) if k >= 0]
        if within:
            much = others and sums[-1] - within >= OTHER_TEXT * within
            found.append((node, mark(max(others, key=sizes.__getitem__)) if much else None, start <= before[-1] < end))
    return found, mark(before[-1]) if texts else 0


def outer_parts(root: Node, outer: dict[int, int]) -> tuple[list[tuple[Node, int | None, bool]], int]:
    """beside() of the whole page, for the subtrees outside its articles."""
    return beside(root, lambda x: x.tag not in UNSEEN, outer)


def inner_parts(top: Node) -> list[tuple[Node, int | None, bool]]:
    """beside() of an article (or of a main element, without its articles), for the elements that hold blocks."""
    apart: set[int] = set()
    able: set[int] = set()
    holds = {id(x) for x in tops(top) if x is not top} if top.tag == "main" else set()
    todo: list[tuple[Node, tuple[int, ...]]] = [(top, ())]
    while todo:
        node, above = todo.pop()
        if id(node) in holds:
            apart.update((id(node), *above))
            continue
        for x in node.children:
            if isinstance(x, Node) and not furniture(x, True):
                if holds_blocks(x):
                    able.add(id(x))
                todo.append((x, (*above, id(x)) if holds else ()))
    return beside(top, lambda x: not furniture(x, True), able - apart)[0]


def blocks(node: Node, dropped: set[int]) -> list[str]:
    """The texts between block boundaries in page order, white space folded, empty ones left out. Headers
    count as furniture unless the node is an article or main element."""
    within = node.tag in ("article", "main")
    found: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join(unescape("".join(run)).split()):
            found.append(text)
        run.clear()

    todo: list[object] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif id(x) in dropped or x is not node and furniture(x, within):
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return found


NONE: frozenset[int] = frozenset()


def main_text(html: str | None, templates: frozenset[int] | set[int] = NONE, inner: frozenset[int] | set[int] = NONE, slots: frozenset[int] | set[int] = NONE) -> str:
    """Text of the page's articles, else of its main element, else of the whole page, without furniture and
    templates: subtrees and slots outside of articles, and `inner` subtrees in them. What has no text without these is
    passed over."""
    root = parse(html)
    dropped: set[int] = set()
    if templates or inner or slots:
        own, outer = subtree_hashes(root)
        dropped = {x for x, slot in outer.items() if slot in slots or own[x] in templates}
        if inner:
            dropped |= {id(node) for top in tops(root) for node, *_ in inner_parts(top) if own[id(node)] in inner}
        dropped = at_edges(root, dropped)
    for top in (containers(root, "article"), containers(root, "main"), [root]):
        if text := "\n\n".join(t for x in top for t in blocks(x, dropped)):
            return text
    return ""


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def subtree_counts(pages: DataFrame) -> DataFrame:
    """host, inside, slot, subtree, n: beside how many different texts of the host each subtree is met, outside articles
    (with its slot) and inside. Rows without subtree count the pages whose longest text stands in the slot and, without slot,
    the host's different pages and articles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: set[tuple[str, bool, int | None, int | None, int]] = set()
            for host, html in zip(b["host"], b["html"], strict=True):
                root = parse(html)
                own, outer = subtree_hashes(root)
                parts, longest = outer_parts(root, outer)
                rows.add((host, False, None, None, longest))
                rows.update((host, False, outer[id(node)], own[id(node)], other) for node, other, _ in parts if other is not None)
                rows.update((host, False, outer[id(node)], None, longest) for node, _, holds in parts if holds)
                for top in tops(root):
                    rows.add((host, True, None, None, own[id(top)]))
                    rows.update((host, True, None, own[id(node)], other) for node, other, _ in inner_parts(top) if other is not None)
            host, inside, *numbers = zip(*rows, strict=True) if rows else ((),) * 5
            yield pd.DataFrame({"host": host, "inside": inside} | {c: pd.array(x, dtype="Int64") for c, x in zip(("slot", "subtree", "other"), numbers, strict=True)})

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("host <> ''")
    rows = rows.mapInPandas(run, "host string, inside boolean, slot bigint, subtree bigint, other bigint").distinct()
    return rows.groupBy("host", "inside", "slot", "subtree").agg(F.count(F.lit(1)).alias("n"))


def templates(pages: DataFrame, share: float = PAGE_SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """host, subtrees, inner, slots: hashes of what to delete on the host's pages. Subtrees are counted by the different
    texts they stand beside, so copies of a page or article don't make its parts a template. A host has at most 1 / share
    times as many subtrees as a page has, and as many slots as its pages have places that a share of them use, so its
    row is bounded whatever its number of pages."""
    counts = materialize(subtree_counts(pages), "subtrees")
    whole = counts.where("subtree is null and slot is null").select("host", "inside", F.col("n").alias("whole"))
    held = counts.where("subtree is null and slot is not null").select("host", "slot", F.col("n").alias("longest"))
    counts = counts.where("subtree is not null").join(whole, ["host", "inside"])
    of_host = F.when(F.col("inside"), ARTICLE_SHARE).otherwise(share)
    many = counts.groupBy("host", "inside", "subtree").agg(F.sum("n").alias("n"), F.first("whole").alias("whole")).where((F.col("n") >= least) & (F.col("n") >= of_host * F.col("whole")))
    places = counts.where("not inside").groupBy("host", "slot").agg(F.sum("n").alias("uses"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"), F.first("whole").alias("whole"))
    places = places.join(held, ["host", "slot"], "left").where(F.coalesce("longest", F.lit(0)) <= SLOT_LONGEST * F.col("whole"))
    places = places.where((F.col("uses") >= least) & (F.col("again") >= SLOT_AGAIN * F.col("uses")) & (F.col("uses") >= SLOT_SHARE * F.col("whole")))
    kinds = many.select("host", F.when(F.col("inside"), "inner").otherwise("subtrees").alias("kind"), F.col("subtree").alias("mark"))
    kinds = kinds.union(places.select("host", F.lit("slots"), "slot"))
    return kinds.groupBy("host").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("mark"))).alias(k) for k in ("subtrees", "inner", "slots")])


def extract(pages: DataFrame, share: float = PAGE_SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html gives an empty text, as does a page without text; a null or odd url has no host and no
    templates; very long pages are read whole; repeated rows each give a row (and count once as pages of their host); other
    columns are left out; an empty table gives no rows. Copies of an article on one site keep their text.

    The templates' rows go out SALT-fold, so that pages of a host that has a third of all rows don't meet in one task
    where Spark finds the table too large to broadcast."""
    own = materialize(templates(pages, share, least), "templates")
    own = own.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))

    @F.pandas_udf(T.StringType())
    def run(html: pd.Series, subtrees: pd.Series, inner: pd.Series, slots: pd.Series) -> pd.Series:
        whole = lambda s: NONE if s is None else frozenset(map(int, s))
        return pd.Series([main_text(h, whole(s), whole(i), whole(p)) for h, s, i, p in zip(html, subtrees, inner, slots, strict=True)], dtype=object)

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(own, ["host", "salt"], "left")
    rows = rows.select("page_id", "url", run("html", "subtrees", "inner", "slots").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
