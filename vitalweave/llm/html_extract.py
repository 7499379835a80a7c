"""Main text of web pages by wrapper induction.

Pages of one host come from one or several templates. The trees of blocks of its pages
are laid on each other: nodes with the same tags and names from the root on are in one
place, as deep and as long as a page is. A text that nearly all pages of the host, or of
one of its layouts, have in a place is part of the template; what varies is a slot. The
article of a page is its article or main element, else the slots; what names itself a
menu, advert, notice, form or comment list goes in either case.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalweave.llm.common import as_bytes, as_text, map_texts, stored, worker_value

#: Elements by what they mean for text. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]), "tfoot": frozenset(["thead", "tbody", "tr", "td", "th"]),
}
SCOPES = frozenset(["table", "ul", "ol", "dl", "select", "body", "html", "article", "section", "div"])
SKIPPED = frozenset("nav footer aside form button select dialog menu head search object audio video canvas".split()) | RAW
SKIPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored banner cookie cookies consent notice sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus share sharing social promo related newsletter subscribe popup modal skip toolbar pagination".split()
)
#: Names of what heads a page, outside an article, and words that change nothing in a name.
HEADER_NAMES = frozenset(["header", "masthead"])
PLAIN_WORDS = frozenset("site page main top bottom left right list box block bar area wrapper wrap container section buttons links widget inner outer global".split())
BOXES = frozenset("div section fieldset details hgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
#: What names parts of a text. Headings between varying text belong to it, even if all pages have them.
LABELS = HEADINGS | frozenset("caption dt figcaption legend summary th".split())
DIVIDING = frozenset("div section article main header table center fieldset".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?|[^<]+|<", re.DOTALL)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: A node is template when this share of the pages that have it agree on its text.
CONSTANT = 0.9
#: Pages of a host, at least, for what is constant to be its template.
PAGES = 3
BROADCAST_BYTES = 64 << 20
#: The place of the page itself.
ROOT = 0


@dataclass
class Node:
    tag: str
    names: frozenset[str]
    children: list = field(default_factory=list)  # nodes and texts

    @property
    def named(self) -> bool:
        return any(_named(n) == "skipped" for n in self.names)

    @property
    def skipped(self) -> bool:
        return self.tag in SKIPPED or self.named

    @property
    def header(self) -> bool:
        return self.tag == "header" or any(_named(n) == "header" for n in self.names)


@lru_cache(100_000)
def _named(name: str) -> str:
    """What a whole class, id or role says: each of its words must say it or nothing, so that no-sidebar and share-price say nothing."""
    words = set(re.split("[_-]+", name)) - {""}
    if not words <= SKIPPED_NAMES | HEADER_NAMES | PLAIN_WORDS:
        return ""
    return "skipped" if words & SKIPPED_NAMES else "header" if words & HEADER_NAMES else ""


def parse(text: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are taken as browsers do for these cases."""
    root = Node("html", frozenset())
    stack = [root]
    at, size = 0, len(text)
    while at < size:
        match = TOKEN.match(text, at)
        at = match.end()
        tag = match[2]
        if tag is None:
            if match[0][0] != "<" or len(match[0]) == 1:
                stack[-1].children.append(html.unescape(match[0]))
            continue
        tag = tag.lower()
        if match[1]:
            if tag == "p" and all(n.tag != "p" for n in stack):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                # An inline end tag does not close a block.
                if tag not in BLOCKS and stack[depth].tag in BLOCKS:
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCKS:
                    break
        ended = CLOSED_BY.get(tag)
        if ended:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ended:
                    del stack[depth:]
                    break
                if stack[depth].tag in SCOPES:
                    break
        names = frozenset(w for m in NAMES.finditer(match[3]) for v in m.groups() if v for w in v.lower().split())
        node = Node(tag, names)
        stack[-1].children.append(node)
        if tag in VOID or match[0].endswith("/>"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(text, at)
            at = end.end() if end else size
            continue
        stack.append(node)
    return root


def blocks(node: Node, dropped: frozenset[int] = frozenset(), inside: bool = False, names: bool = True) -> list[str]:
    """The texts of blocks in order, white space as single spaces, without skipped parts and dropped nodes.

    With ``names`` off, only tags say what is skipped.
    """
    done: list[str] = []
    held: list[str] = []

    def close() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            done.append(line)

    todo: list = [(node, False)]
    while todo:
        item, leaving = todo.pop()
        if leaving:
            close()
        elif isinstance(item, str):
            held.append(item)
        elif item.tag == "br":
            held.append(" ")
        elif item is not node and (
            item.tag in SKIPPED or names and (item.named or item.header and not inside) or id(item) in dropped
        ):
            if item.tag in BLOCKS:
                close()
        else:
            if item.tag in BLOCKS:
                close()
                todo.append((item, True))
            todo.extend((c, False) for c in reversed(item.children))
    close()
    return done


def roots(page: Node) -> list[Node]:
    """The outermost article elements that are not in a skipped part, else the main elements.

    If all are in parts skipped by name, or have such a name, they are taken.
    """
    for names in (True, False):
        for wanted in ("article", "main"):
            found, todo = [], [page]
            while todo:
                node = todo.pop()
                if node.tag == wanted or wanted == "main" and "main" in node.names and node.tag in BLOCKS:
                    found.append(node)
                else:
                    todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in SKIPPED and not (names and c.named))
            if found:
                return found
    return []


@lru_cache(100_000)
def _slot(parent: int, tag: str, names: frozenset[str]) -> int:
    """The number of a place in a tree: the tags and names from the root to it, without the digits in names."""
    key = " ".join([str(parent), tag, *sorted(re.sub(r"\d+", "0", n) for n in names)])
    return _hash(key)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def slots(page: Node) -> list[tuple[Node, int, int]]:
    """Each block element in page order, the place it is in, and a hash of its text without skipped parts.

    Equal siblings are in one place.
    """
    found: list = []
    lines: list[tuple[str, int]] = []
    held: list[str] = []

    def close() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            lines.append((line, levels[-1]))

    levels = [0]  # parts skipped by name that are around
    todo: list = [(page, ROOT, False)]
    while todo:
        item, parent, leaving = todo.pop()
        if leaving:
            close()
            node, slot, first = found[parent]
            level = levels.pop()
            found[parent] = (node, slot, _hash("\n".join(line for line, at in lines[first:] if at == level)))
        elif isinstance(item, str):
            held.append(item)
        elif item.tag == "br":
            held.append(" ")
        elif item.tag in SKIPPED or item.tag not in BLOCKS and item.named:
            if item.tag in BLOCKS:
                close()
        elif item.tag not in BLOCKS:
            todo.extend((c, parent, False) for c in reversed(item.children))
        else:
            close()
            slot = ROOT if item is page else _slot(parent, item.tag, item.names)
            levels.append(levels[-1] + item.named)
            todo.append((item, len(found), True))
            found.append((item, slot, len(lines)))
            todo.extend((c, slot, False) for c in reversed(item.children))
    return found


def layout(page: Node) -> int:
    """A hash of the boxes that divide a page: those of the first two levels below the outermost box that has several parts."""
    level = [page]
    while True:
        parts = [c for n in level for c in n.children if isinstance(c, Node) and c.tag in BLOCKS and c.tag not in SKIPPED]
        if len(parts) != 1 or parts[0].tag in ("article", "main"):
            break
        level = parts
    keys = {(n.tag, *sorted(n.names)) for n in level}
    for depth in (1, 2):
        parts = [n for n in parts if n.tag in DIVIDING]
        keys |= {(depth, n.tag, *sorted(re.sub(r"\d+", "0", w) for w in n.names)) for n in parts}
        parts = [c for n in parts if n.tag not in ("article", "main") for c in n.children if isinstance(c, Node) and c.tag in BLOCKS]
    return _hash(repr(sorted(map(str, keys))))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))


def labels(node: Node) -> bool:
    """Whether all text of a node is in headings, captions, terms and head cells."""
    return node.tag in LABELS or all(not c.strip() if isinstance(c, str) else labels(c) for c in node.children)


def between(root: Node, dropped: set[int]) -> set[int]:
    """The dropped nodes of an article that name its parts: headings and other labels between varying text.

    Pages of one kind have them in common, as recipes have their ingredients. Constant
    paragraphs, lists and boxes are notices and share lines, and what is constant at the border
    of an article may head or end every page.
    """
    order: list[Node | None] = []  # dropped labels, None for varying text
    todo: list = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            if item.strip():
                order.append(None)
        elif id(item) in dropped:
            if labels(item):
                order.append(item)
        elif item is root or not item.skipped:
            todo.extend(reversed(item.children))
    varying = [i for i, x in enumerate(order) if x is None]
    todo = [x for x in order[varying[0] : varying[-1]] if x is not None] if varying else []
    kept: set[int] = set()
    while todo:
        item = todo.pop()
        kept.add(id(item))
        todo.extend(c for c in item.children if isinstance(c, Node))
    return kept


def extract(page: str, constant: dict[tuple[int | None, int], set[int]]) -> str:
    """Main text of a page, given the constant texts (hashes) of places of its host, for all layouts (None) and for each."""
    tree = parse(page)
    own = articles = roots(tree)
    dropped: set[int] = set()
    if constant:
        kind = layout(tree)
        found = slots(tree)
        count = Counter(slot for _, slot, _ in found)
        for node, slot, digest in found:
            known = constant.get((None, slot), set()) | constant.get((kind, slot), set())
            # Outside articles, what stands in the place of one constant text is template too.
            if node is not tree and (digest in known or known and not articles and count[slot] == 1):
                dropped.add(id(node))
        # An article that is the same on nearly all pages is template too.
        own = [r for r in articles if id(r) not in dropped]
        for root in own:
            dropped -= between(root, dropped)
    gone = frozenset(dropped)
    tries = [(own or [tree], gone, True)]
    if articles:
        if own and gone:
            # Where only headings vary, an article's paragraphs, lists and tables are its own, copies of each other.
            heads = gone | {id(n) for n, _, _ in found if n.tag in HEADINGS}
            if not any(blocks(r, heads, True) for r in own):
                tries = [(own, frozenset(id(n) for n, _, _ in found if id(n) in gone and n.tag in BOXES), True)]
        tries += [(articles, frozenset(), True), (articles, frozenset(), False)]
    else:
        tries += [([tree], gone, False)]
    for main, left, names in tries:
        lines = [line for root in main for line in blocks(root, left, bool(articles), names)]
        if lines:
            break
    return "\n".join(lines)


def _sent(table: DataFrame, size: Column) -> DataFrame:
    """A table of hosts, to all executors if it is small and by shuffle if not."""
    return F.broadcast(table) if (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else table


def induce_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper): the constant texts of each host that has some, as JSON.

    A text is constant where most of the pages that have its place agree on it, among the
    different pages of the host or of one layout of it. Null and empty pages do not count.
    """
    text = F.col(f"`{page}`").cast("string")
    rows = pages.filter(text.isNotNull() & (F.trim(text) != "")).select(host_of(F.col(f"`{url}`")).alias("host"), text.alias("page"))

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        kinds, out = [], []
        for content in as_bytes(columns[0]):
            tree = parse(as_text(content))
            places = slots(tree)
            kinds.append(layout(tree))
            # None stands for the place itself.
            each = dict.fromkeys(x for _, slot, digest in places for x in ((slot, None), (slot, digest)))
            out.append([{"slot": slot, "digest": digest} for slot, digest in each])
        return [pa.array(kinds, pa.int64()), pa.array(out, pa.list_(pa.struct([("slot", pa.int64()), ("digest", pa.int64())])))]

    keyed = rows.withColumn("copy", F.xxhash64("page"))
    seen = map_texts(keyed, ["host", "copy"], [F.col("page")], "layout long, seen array<struct<slot:long,digest:long>>", work)
    different = seen.groupBy("host", "copy", "layout").agg(F.first("seen").alias("seen"))
    agreed = stored(different.select("host", "layout", F.inline("seen")).groupBy("host", "layout", "slot", "digest").agg(F.count(F.lit(1)).alias("n")))
    key = ["host", "layout", "slot"]
    found = None
    # A null layout stands for all of them.
    whole = agreed.groupBy("host", "slot", "digest").agg(F.sum("n").alias("n")).select("host", F.lit(None).cast("long").alias("layout"), "slot", "digest", "n")
    for level in (whole, agreed):
        places = level.filter(F.col("digest").isNull())
        enough = level.filter(F.col("digest").isNotNull() & (F.col("n") >= PAGES))
        n_pages = places.filter(F.col("slot") == ROOT).select("host", "layout", F.col("n").alias("n_pages"))
        of_place = places.select(*key, F.col("n").alias("n_place"))
        same = [F.col(f"e.{c}").eqNullSafe(F.col(f"p.{c}")) for c in key]
        judged = enough.alias("e").join(of_place.alias("p"), same).select("e.*", "n_place")
        judged = judged.filter(F.col("n") >= CONSTANT * F.col("n_place")).alias("j")
        judged = judged.join(n_pages.alias("q"), [F.col(f"j.{c}").eqNullSafe(F.col(f"q.{c}")) for c in key[:2]])
        part = judged.filter(2 * F.col("n_place") >= F.col("n_pages")).select(*[F.col(f"j.{c}") for c in [*key, "digest"]])
        found = part if found is None else found.unionByName(part)
    return found.groupBy("host").agg(F.to_json(F.collect_list(F.array("layout", "slot", "digest"))).alias("wrapper"))


def _wrapper(known: dict, packed: bytes | None) -> dict[tuple[int | None, int], set[int]]:
    """The constant texts by layout and place."""
    if packed is None:
        return {}
    key = hashlib.blake2b(packed, digest_size=16).digest()
    if key not in known:
        if len(known) >= 1000:
            known.clear()
        made = known[key] = {}
        for kind, slot, digest in json.loads(packed):
            made.setdefault((kind, slot), set()).add(digest)
    return known[key]


def extract_pages(pages: DataFrame, keep: Sequence[str], url: str = "url", page: str = "html", into: str = "text") -> DataFrame:
    """Columns ``keep`` of each row and the main text of its page.

    Blocks are joined by line ends in page order. A null or empty page has an empty text.
    Repeated rows stay; a null url is a host of its own; kept columns may have any names. An empty
    table gives an empty table.
    """
    wrappers = stored(induce_wrappers(pages, url, page))
    names = [f"_c{i}" for i in range(len(pages.columns))]
    place = {c: n for c, n in zip(pages.columns, names)}
    named = pages.toDF(*names).withColumn("_host", host_of(F.col(place[url])))
    sent = _sent(wrappers, F.length("wrapper"))
    joined = named.join(sent.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper")), "_host", "left")
    kept = [c for c in keep if c != into]
    shared = pages.sparkSession.sparkContext.broadcast(CONSTANT)

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        known = worker_value(shared, lambda _: {})
        return [pa.array([extract(as_text(t), _wrapper(known, w)) for t, w in zip(as_bytes(columns[0]), as_bytes(columns[1]))], pa.string())]

    made = map_texts(joined, [place[c] for c in kept], [F.col(place[page]).cast("string"), F.col("_wrapper")], "_text string", work)
    return made.toDF(*kept, into)
