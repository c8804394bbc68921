"""Main text of HTML pages by wrapper induction over the pages of a host.

The first page of a host (least page id) is the pivot.  Every other page's
tree is aligned with the pivot's by simple tree matching (equal tags, order
kept, most nodes matched); a text slot of the pivot whose aligned slots repeat
the pivot's text on nearly all pages that have one is template, other slots
are content.  The text that varies is summed by node of the pivot, too: the
deepest node that holds most of it, with two parts or more, is the host's
content.  Only sums per pivot slot and node are grouped by host, so a host may
hold any part of the pages.

Slots in menus, headers, footers, sidebars, forms, scripts and the like (by
element, role, class or id) are never content.  A form that holds the page's
article, or most of the text of its paragraphs, is none of these, and inside
an article a class such as legal names a subject, not a part.  Where a page
marks an article or a main part that holds at least half of what is left, only
that part is content; elsewhere the host's content node and first-level
headings are, where the host has such a node.

Defined cases: a null or empty page, or one without content, gives the empty
string; a url without a host makes its pages a group of their own (by the text
before the first slash); a cut-off tag, comment or script at a page's end is
left out; copies of the pivot, and pages of which more than half repeats it,
do not vote; a host with fewer than ``least`` voting pages has neither template
nor content node; repeated rows are pages of their own; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import staged

# Element names by their part in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noframes xmp template".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = set("head nav header footer aside form script style textarea title noscript iframe noframes xmp template button select option menu dialog svg canvas object embed video audio fieldset input datalist".split())
MAIN = {"article", "main"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPE = set("table ul ol dl select body html article section div main".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
#: Words of a class or id that mark a part which is not the article's text.
CHROME_NAMES = set(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead topbar toolbar comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription "
    "popup modal overlay login signup search pagination pager widget widgets tags tagcloud copyright legal disclaimer alert".split()
)
#: Last words of a compound that only say what holds the part or what it is made of, as in ad-box and footer-links.
HOLDERS = set("area bar block box column container content group inner item items left link links list outer panel posts articles region right row section slot stories unit wrap wrapper button buttons form top bottom main".split())
NEGATED = {"has", "with", "no", "non", "not", "without"}
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(>|\Z)", re.S)
#: Of these, the words that name a subject inside an article.
SUBJECTS = {"legal", "disclaimer", "copyright"}
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Node:
    """An element: tag, children, and the numbers of the text slots that start in it."""

    __slots__ = ("tag", "chrome", "main", "children", "slots", "shape", "named", "forms")

    def __init__(self, tag: str, chrome: bool = False, main: bool = False, named: tuple[Node, ...] = (), forms: tuple[Node, ...] = ()) -> None:
        self.tag, self.chrome, self.main = tag, chrome, main
        self.named = named  # it and the elements round it whose class or id names no text
        self.forms = forms  # the forms round it
        self.children: list[Node] = []
        self.slots: list[int] = []


def _names_chrome(token: str, inside: bool) -> bool:
    """Whether a class or id names a part that is not text: by its last word but for holders, unless a word before says that it lacks or has one."""
    ws = [w.lower() for w in _NAME.findall(token)]
    if NEGATED.intersection(ws):
        return False
    while len(ws) > 1 and ws[-1] not in CHROME_NAMES and (ws[-1] in HOLDERS or ws[-1].isdigit()):
        ws.pop()
    return bool(ws) and ws[-1] in CHROME_NAMES and not (inside and ws[-1] in SUBJECTS)


def _element(tag: str, attributes: str, above: Node) -> Node:
    """The node of a start tag, with what its name and attributes say and what it has from above."""
    chrome, main, named = tag in CHROME and tag != "form", tag in MAIN, False
    for name, *values in _ATTR.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            chrome = True
        elif name == "role":
            role = value.strip().lower()
            chrome, main = chrome or role in CHROME_ROLES, main or role == "main"
        elif name in ("class", "id") and tag not in ("html", "body", *MAIN):
            named = named or any(_names_chrome(w, above.main) for w in value.split())
    node = Node(tag, above.chrome or chrome, above.main or main, above.named, above.forms)
    if named:
        node.named += (node,)
    if tag == "form":
        node.forms += (node,)
    return node


def parse(page: str | None) -> tuple[Node, list[str], list[Node]]:
    """The tree, the texts of its slots (blocks of text, decoded, white space collapsed), and each slot's element."""
    page = page or ""
    root = Node("#")
    stack, texts, owners, parts, mains = [root], [], [], [], []

    def end_block() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                owner = next((n for n in reversed(stack) if n.tag not in INLINE), root)
                owner.slots.append(len(texts))
                texts.append(text)
                owners.append(owner)
            parts.clear()

    def pop_to(k: int) -> None:
        if any(n.tag not in INLINE for n in stack[k:]):
            end_block()
        del stack[k:]

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or m[4] == "":
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag not in INLINE
        if block:
            end_block()
            ends = CLOSES.get(tag)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or ends and stack[k].tag in ends:
                    pop_to(k)
                elif stack[k].tag in SCOPE:
                    break
        above = stack[-1]
        node = _element(tag, m[3], above)
        if node.main and not above.main and not node.chrome:
            mains.append(node)
        above.children.append(node)
        if tag in VOID or m[3].endswith("/") and not block:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        stack.append(node)
    if at < len(page):
        parts.append(page[at:])
    end_block()
    holds = () if any(not n.named for n in mains) else mains[0].named if mains else ()
    for owner in dict.fromkeys(owners):  # a name does not count on what holds the page's article
        owner.chrome = owner.chrome or any(n not in holds for n in owner.named)
    _judge_forms(texts, owners, mains)
    return root, texts, owners


def _judge_forms(texts: list[str], owners: list[Node], mains: list[Node]) -> None:
    """Forms are chrome but for those round an article or round most of the paragraphs' text."""
    if not any(o.forms for o in owners):
        return
    kept = {f for n in mains for f in n.forms}
    if not kept:
        inside, total = Counter(), 0
        for t, o in zip(texts, owners):
            if o.tag == "p" and not o.chrome:
                total += len(t)
                for f in o.forms:
                    inside[f] += len(t)
        kept = {f for f, n in inside.items() if 2 * n > total}
    for o in dict.fromkeys(owners):
        o.chrome = o.chrome or any(f not in kept for f in o.forms)


def _shapes(*roots: Node) -> None:
    """Give every node the hash of its subtree's tags."""
    for root in roots:
        order = [root]
        for n in order:
            order += n.children
        for n in reversed(order):
            n.shape = hash((n.tag, *(c.shape for c in n.children)))


def align(a: Node, b: Node, most_cells: int = 40_000) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most matched nodes and the pairs, order and ancestry kept.

    Of child lists whose table would exceed most_cells, children at the start
    and at the end that are alike in their whole trees are matched first, which
    loses no match, and the table is made for the rest.
    """
    steps, back = [_align(a, b, most_cells)], None
    shaped = False
    while steps:  # no recursion: trees are as deep as a page likes
        try:
            c, d = steps[-1].send(back)
        except StopIteration as end:
            steps.pop()
            back = end.value
            continue
        back = None
        if c is None:
            if not shaped:
                _shapes(a, b)
                shaped = True
        else:
            steps.append(_align(c, d, most_cells))
    return back


def _align(a: Node, b: Node, most_cells: int):
    """One level of align: asks for the pairs below by yielding two nodes, and for shapes by yielding None twice."""
    if a.tag != b.tag:
        return 0, []
    x, y = a.children, b.children
    pairs, ends = [(a, b)], []
    if len(x) * len(y) > most_cells:
        yield None, None
        lo = 0
        while lo < min(len(x), len(y)) and x[lo].shape == y[lo].shape:
            lo += 1
        hi = 0
        while hi < min(len(x), len(y)) - lo and x[-1 - hi].shape == y[-1 - hi].shape:
            hi += 1
        ends = [*zip(x[:lo], y[:lo]), *zip(x[len(x) - hi :], y[len(y) - hi :])]
        x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    for c, d in ends:  # whole trees alike: every node meets its own
        same = [(c, d)]
        for u, v in same:
            same += zip(u.children, v.children)
        pairs += same
    if not x or not y:
        return len(pairs), pairs
    above = [0] * (len(y) + 1)
    turns = []  # per cell: 0 to the row above, 1 to the column before, 2 to both
    found: dict[tuple[int, int], list] = {}
    for i, c in enumerate(x):
        row, turn = [0] * (len(y) + 1), bytearray(len(y))
        for j, d in enumerate(y):
            best = row[j] if row[j] > above[j + 1] else above[j + 1]
            if c.tag == d.tag:
                if not c.children or not d.children:
                    w = 1
                else:
                    w, found[i, j] = yield c, d
                if above[j] + w > best:
                    best = above[j] + w
            row[j + 1] = best
            turn[j] = 0 if best == above[j + 1] else 1 if best == row[j] else 2
        above = row
        turns.append(turn)
    i, j = len(x), len(y)
    while i and j:
        turn = turns[i - 1][j - 1]
        if turn == 0:
            i -= 1
        elif turn == 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += found.get((i, j)) or [(x[i], y[j])]
    return len(pairs), pairs


def slot_pairs(pivot: Node, page: Node) -> list[tuple[int, int]]:
    """Aligned text slots: (slot of the pivot, slot of the page)."""
    return [p for x, y in align(pivot, page)[1] for p in zip(x.slots, y.slots)]


def _in_order(root: Node) -> list[Node]:
    """A tree's nodes, those above before those below them."""
    nodes = [root]
    for n in nodes:
        nodes += n.children
    return nodes


def varying(pivot: Node, page: tuple[Node, list[str], list[Node]], pairs: list[tuple[Node, Node]], same: set[int]) -> dict[Node, int]:
    """Characters of the page's slots that are no chrome and not in same, by the pivot's node that the nearest aligned element round them has."""
    root, texts, owners = page
    of = {d: c for c, d in pairs}
    near, sums = {root: pivot}, Counter()
    for n in _in_order(root):
        near[n] = of.get(n) or near[n]
        near.update((c, near[n]) for c in n.children)
    for k, (t, o) in enumerate(zip(texts, owners)):
        if not o.chrome and k not in same:
            sums[near[o]] += len(t)
    return sums


def content_node(pivot: Node, sums: dict[int, int], percent: int = 70) -> Node | None:
    """The deepest node that holds so much of the varying text, by sums per node in order, and has it in two parts or more; None if that is the root."""
    nodes = _in_order(pivot)
    own = [sums.get(k, 0) for k in range(len(nodes))]
    number = {n: k for k, n in enumerate(nodes)}
    below = own[:]
    for k in range(len(nodes) - 1, -1, -1):
        below[k] += sum(below[number[c]] for c in nodes[k].children)
    at, best = pivot, None
    while True:
        parts = [c for c in at.children if below[number[c]]]
        if at is not pivot and len(parts) + (own[number[at]] > 0) > 1:
            best = at
        at = next((c for c in parts if below[number[c]] * 100 >= below[0] * percent), None)
        if at is None:
            return best


def main_text(page: str | None, pivot: tuple[Node, list[str]] | None = None, constant: frozenset[int] = frozenset(), content: Node | None = None) -> str:
    root, texts, owners = parse(page)

    def marked(free: list[int]) -> bool:
        return 2 * sum(len(texts[k]) for k in free if owners[k].main) >= max(1, sum(len(texts[k]) for k in free))

    free = [k for k, o in enumerate(owners) if not o.chrome]
    if pivot and free and (constant or content and not marked(free)):
        pairs = align(pivot[0], root)[1]
        template = {j for x, y in pairs for i, j in zip(x.slots, y.slots) if i in constant and pivot[1][i] == texts[j]}
        free = [k for k in free if k not in template]
        at = next((y for x, y in pairs if x is content), None)
        if at is not None and not marked(free):
            inside = set(_in_order(at))
            free = [k for k in free if owners[k] in inside or owners[k].tag == "h1"]
    if marked(free):
        free = [k for k in free if owners[k].main]
    return "\n\n".join(texts[k] for k in free)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/?#:]*)", 1)), F.lit(""))


_SUMS = "host string, slot int, node int, aligned long, equal long, chars long"


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slot of a host's pivot how often it was aligned and equal, per node the pages and the characters of varying text."""
    pivots: dict[str, tuple] = {}
    for b in batches:
        sums: dict[tuple[str, int | None, int | None], list[int]] = {}
        for of, page, pivot in zip(*(c.to_pylist() for c in b.columns)):
            if of not in pivots:
                if len(pivots) > 200:
                    pivots.clear()
                found = parse(pivot)
                pivots[of] = (*found[:2], {n: k for k, n in enumerate(_in_order(found[0]))})
            base, base_texts, number = pivots[of]
            parsed = root, texts, owners = parse(page)
            if texts == base_texts:
                continue
            pairs = align(base, root)[1]
            slots = [p for x, y in pairs for p in zip(x.slots, y.slots)]
            same = {j for i, j in slots if base_texts[i] == texts[j]}
            free = [k for k, o in enumerate(owners) if not o.chrome]
            if 2 * sum(len(texts[k]) for k in free if k in same) > sum(len(texts[k]) for k in free):
                continue
            for i, j in slots:
                s = sums.setdefault((of, i, None), [0, 0, 0])
                s[0] += 1
                s[1] += j in same
            chars = varying(base, parsed, pairs, same)
            for n in {base, *chars}:
                s = sums.setdefault((of, None, number[n]), [0, 0, 0])
                s[0] += 1
                s[2] += chars[n]
        keys, values = list(zip(*sums)) or [()] * 3, list(zip(*sums.values())) or [()] * 3
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((*keys, *values), kinds)], names=["host", "slot", "node", "aligned", "equal", "chars"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pivots: dict[str, tuple] = {}
    for b in batches:
        texts = []
        for page, of, pivot, slots, nodes in zip(*(c.to_pylist() for c in b.columns[2:])):
            if pivot is not None and of not in pivots:
                if len(pivots) > 200:
                    pivots.clear()
                found = parse(pivot)[:2]
                pivots[of] = (found, frozenset(slots), content_node(found[0], {n["node"]: n["chars"] for n in nodes}))
            texts.append(main_text(page, *pivots[of]) if pivot is not None else main_text(page))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", least: int = 2, percent: int = 80) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"), host(F.col(url)).alias("host"))
    pivots = staged(own.groupBy("host").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")).where(F.col("n") > least).select("host", "page_id"), "pivot-ids")
    pivots = staged(own.select("host", "page_id", "html").join(pivots, ["host", "page_id"]).groupBy("host").agg(F.min("html").alias("pivot")), "pivots")
    votes = own.select("host", "html").join(pivots, "host").select("host", "html", "pivot").mapInArrow(_votes, _SUMS)
    sums = votes.groupBy("host", "slot", "node").agg(*(F.sum(c).alias(c) for c in ("aligned", "equal", "chars")))
    constant = F.col("slot").isNotNull() & (F.col("aligned") >= least) & (F.col("equal") * 100 >= F.col("aligned") * percent)
    known = sums.groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(constant, F.col("slot")))).alias("slots"), F.collect_list(F.when(F.col("chars") > 0, F.struct("node", "chars"))).alias("nodes"),
        F.max(F.when(F.col("node") == 0, F.col("aligned"))).alias("voters"),
    )
    wrappers = staged(known.where(F.col("voters") >= least).join(pivots, "host").select("host", "pivot", "slots", "nodes"), "wrappers")
    kind = pages.schema[page_id].dataType.simpleString()
    out = own.join(wrappers, "host", "left").select("page_id", "url", "html", "host", "pivot", "slots", "nodes").mapInArrow(_extract, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
