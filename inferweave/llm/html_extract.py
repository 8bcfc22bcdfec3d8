"""Main text of web pages by site style trees.

The DOMs of one host are merged into a style tree: an element node (a place in the tree) holds the style nodes (the
sequences of children) that pages have there, and leaves hold the texts that pages have there. The entropy of the
styles over the pages of a node is its presentation importance; a text that n of a leaf's m pages share has the content
importance 1 - log n / log m. A branch's composite importance blends its presentation with the mean of what is below,
and branches that are under KEEP with all that is in them are removed from each page.

Marks of meaning come before statistics: elements that can't be main text (navigation, footers, asides, forms,
scripts, and anything whose class, id or role says advert, comment, notice and so on) are removed, and where a page has
an article or main element, text outside it is not main text. What such an element holds is judged by the tree like
everything else; the mark is a prior only, as if PRIOR more pages had had styles and texts of their own there. Nodes on fewer than LEAST pages tell
nothing and count as important, whatever the size of the host. Each page is joined to the statistics of its own nodes.
A page from which statistics would take all text keeps it.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferweave.llm.common import joined, materialize, rows_of, ship_package, table

KEEP, GAMMA, LEAST = 0.3, 0.9, 5
#: Pages with styles and texts of their own that an article or main element counts for, at each node in it.
PRIOR = 50
#: What so many rows share (a node of the tree, a page's copies) is joined by broadcast, so that no task gets all of them;
#: above SHARES x HEAVY rows, what a SHARES-th of them share, so that at most SHARES entries are broadcast.
HEAVY, SHARES = 2000, 10_000
#: Element names and words of class, id or role with a meaning (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("script style noscript template nav footer aside form button select textarea input iframe svg math canvas object embed applet menu dialog head title link meta audio video map frameset noframes noembed datalist".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices alert sidebar comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation footer newsletter subscribe subscription popup modal overlay widget widgets login signin signup pagination pager toolbar complementary contentinfo search masthead".split())
PAGE_HEAD = frozenset("header banner topbar masthead".split())
ENDS_P = BLOCK - frozenset("head title body html option optgroup caption tbody thead tfoot tr td th legend".split())
#: What a start tag ends, up to the elements that bound the search.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "option": ("option",)}
BOUNDS = frozenset("ul ol dl table select html".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "kids", "words", "attrs", "blocky")

    def __init__(self, tag: str, words: frozenset[str] = frozenset(), attrs: str = ""):
        self.tag, self.kids, self.words, self.attrs = tag, [], words, attrs
        self.blocky = False  # whether a block stands somewhere in it


def parse(source: str) -> Node:
    """A DOM of the elements and texts (still with their references); end tags that HTML implies are added. Any depth is read."""
    root = Node("#root")
    stack, at, end = [root], 0, len(source)
    open_ = defaultdict(int)

    def close_from(i: int) -> None:
        for _ in range(len(stack) - i):
            open_[stack.pop().tag] -= 1

    while at < end:
        m = TOKEN.search(source, at)
        if m is None:
            stack[-1].kids.append(source[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(source[at : m.start()])
        at = m.end()
        close, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if close:
            if stack[-1].tag == name and len(stack) > 1:
                open_[name] -= 1
                stack.pop()
            elif open_[name] > 0:
                close_from(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name))
            continue
        if name in ENDS_P and open_["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close_from(i)
                    break
                if stack[i].tag in BLOCK and stack[i].tag != "p":
                    break
        if name in SIBLINGS and any(open_[t] > 0 for t in SIBLINGS[name]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[name]:
                    close_from(i)
                    if name not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[i].tag in BOUNDS:
                    break
        words, attrs = frozenset(), ""
        if rest and "=" in rest or " hidden" in rest.lower():
            found = [(a.lower(), (x or y or z or "").lower()) for a, x, y, z in NAMED.findall(rest)]
            attrs = " ".join(v for a, v in found if a in ("class", "id", "role"))
            words = frozenset(w for a, v in found if a in ("class", "id", "role", "itemprop") for w in WORDS.findall(v))
            if any(a == "hidden" or a == "aria-hidden" and v == "true" for a, v in found):
                words |= {"#hidden"}
        node = Node(name, words, attrs)
        stack[-1].kids.append(node)
        if name in BLOCK:
            for n in reversed(stack):
                if n.blocky:
                    break  # and so are those around it
                n.blocky = True
        if name in RAW:
            tail = re.compile(f"</{re.escape(name)}\\b[^>]*(?:>|\\Z)", re.I).search(source, at)
            at = tail.end() if tail else end
        elif name not in VOID and not rest.endswith("/"):
            stack.append(node)
            open_[name] += 1
    return root


def is_landmark(n: Node) -> bool:
    return n.tag in ("article", "main") or bool(n.words & {"main", "articlebody"})


def is_noise(n: Node, inside: bool) -> bool:
    """Whether an element can't hold main text. inside: within an article or main element."""
    if n.tag in NEVER or "#hidden" in n.words:
        return True
    if n.tag in ("body", "html", "article", "main"):
        return False
    if n.words & NOISE_WORDS:
        return True
    return not inside and (n.tag == "header" or bool(n.words & PAGE_HEAD))


def clean(text: str) -> str:
    return " ".join(html_lib.unescape(text).split())


def inner_text(n: Node) -> str:
    out, todo = [], [iter(n.kids)]
    while todo:
        k = next(todo[-1], None)
        if k is None:
            todo.pop()
        elif isinstance(k, str):
            out.append(k)
        elif k.tag == "br":
            out.append(" ")
        elif k.tag not in NEVER:
            todo.append(iter(k.kids))
    return "".join(out)


class Styled:
    """A node of a page's branch of the style tree: its place, its style (or its text's hash, at leaves) and what is below."""

    __slots__ = ("node", "place", "value", "leaf", "inside", "kids")


def styled(root: Node) -> list[Styled]:
    """The block branches of a page that meaning doesn't settle (noise is left out): the root's first, each before what is below it."""
    from xxhash import xxh64_intdigest

    h = lambda *x: xxh64_intdigest("\0".join(map(str, x))) - (1 << 63)

    def begun(n: Node, place: int, inside: bool) -> Styled:
        s = Styled()
        s.node, s.place, s.inside, s.kids = n, place, inside, []
        return s

    out = [begun(root, 0, False)]
    for s in out:  # grows
        blocks = [k for k in s.node.kids if isinstance(k, Node) and (k.tag in BLOCK or k.blocky)]
        s.leaf = not blocks
        if s.leaf:
            s.value = h(clean(inner_text(s.node)))
            continue
        s.value = h(*(f"{k.tag}.{k.attrs}" for k in blocks))
        for i, k in enumerate(blocks):
            if not is_noise(k, s.inside):
                within = s.inside or is_landmark(k)
                s.kids.append(begun(k, h(s.place, s.value, i, k.tag, *(["in"] if within else [])), within))
        out += s.kids
    return out


def observations(root: Node):
    """Every (place, leaf, inside, value) of a page."""
    for s in styled(root):
        yield s.place, s.leaf, s.inside, s.value


def low_branches(root: Node, known: dict[int, tuple[float, int]]) -> set[int]:
    """ids of the nodes whose composite importance is under KEEP. known: place -> (presentation importance, styles); place ^ value -> content importance."""
    low: set[int] = set()
    importance: dict[int, float] = {}
    for s in reversed(styled(root)):  # what is below comes first
        if s.leaf:
            out = known.get(s.place ^ s.value, (1.0, 0))[0]
        elif s.kids:
            own, styles = known.get(s.place, (1.0, 1))
            share = GAMMA**styles
            out = (1 - share) * own + share * sum(importance[id(k)] for k in s.kids) / len(s.kids)
        else:
            out = 1.0
        importance[id(s)] = out
        # a branch goes if nothing in it is important
        if out < KEEP and all(id(k.node) in low for k in s.kids):
            low.add(id(s.node))
    return low


def has_landmark(root: Node) -> bool:
    todo = [root]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, Node) and not is_noise(k, False):
                if is_landmark(k):
                    return True
                todo.append(k)
    return False


def blocks(root: Node, low: set[int]) -> list[str]:
    """Blocks of main text in page order."""
    marked = has_landmark(root)
    out: list[str] = []
    text: list[str] = []

    def end():
        if joined := clean("".join(text)):
            out.append(joined)
        text.clear()

    todo = [(iter(root.kids), not marked, False)]  # what is left of each open element, whether its text counts and whether it is a block
    within = [False]
    while todo:
        kids, counts, block = todo[-1]
        k = next(kids, None)
        if k is None:
            todo.pop()
            within.pop()
            if block:
                end()
        elif isinstance(k, str):
            if counts:
                text.append(k)
        elif k.tag == "br":
            text.append(" ")
        else:
            block = k.tag in BLOCK
            if block:
                end()
            if not is_noise(k, within[-1]) and id(k) not in low:
                inside = within[-1] or is_landmark(k)
                todo.append((iter(k.kids), inside or not marked, block))
                within.append(inside)
    end()
    return out


def main_text(source: str | None, known: dict[int, tuple[float, int]]) -> str:
    root = parse(source or "")
    low = low_branches(root, known) if known else set()
    return "\n\n".join(blocks(root, low) or blocks(root, set()))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_nodes(pages: DataFrame) -> DataFrame:
    """host, page, place, leaf, inside, value: each node of each page of pages (host, page, html)."""
    kinds = "host string, page bigint, place bigint, leaf boolean, inside boolean, value bigint"

    def run(batches):
        import pyarrow as pa

        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())
        for columns in rows_of(batches, "host", "page", "html"):
            found = [(host, page, *o) for host, page, source in zip(*columns, strict=True) for o in observations(parse(source or ""))]
            cols = list(zip(*found, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in kinds.split(", ")])

    return pages.mapInArrow(run, kinds)


def style_trees(found: DataFrame) -> DataFrame:
    """host, key, imp, styles, rows (how many nodes of pages have the key): what can lower an importance in the trees of page_nodes."""
    counts = found.groupBy("host", "place", "leaf", "inside", "value").agg(F.count("*").alias("n"))
    nodes = counts.groupBy("host", "place", "leaf", "inside").agg(F.sum("n").alias("m"), F.count("*").alias("styles"), F.sum(F.col("n") * F.log("n")).alias("s"))
    nodes = nodes.where(F.col("m") >= LEAST).withColumn("rows", F.col("m"))
    # the prior's pages have styles and texts of their own, which add nothing to s
    nodes = nodes.withColumn("m", F.col("m") + F.when(F.col("inside"), PRIOR).otherwise(0))
    presented = nodes.where("NOT leaf").select("host", F.col("place").alias("key"), (1 - F.col("s") / (F.col("m") * F.log("m"))).alias("imp"), "styles", "rows")
    shared = counts.where("leaf AND n > 1").join(nodes.where("leaf").select("host", "place", "m"), ["host", "place"])
    shared = shared.select("host", F.col("place").bitwiseXOR(F.col("value")).alias("key"), (1 - F.log("n") / F.log("m")).alias("imp"), F.lit(0).cast("bigint").alias("styles"), F.col("n").alias("rows"))
    # a branch goes only if all in it is under KEEP, so texts of more importance need no entry
    return presented.unionByName(shared.where(F.col("imp") < KEEP))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for pages (page_id, url, html).

    Null html gives an empty text; pages whose url has no host form one site; elements may nest to any depth. Rows may repeat; an empty table gives an
    empty table. A task holds one batch of pages, each with the statistics of its own nodes; equal pages of a host
    share them.
    """
    ship_package(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("bigint"), "url", "html", host_of(F.col("url")).alias("host")).withColumn("page", F.xxhash64("html"))
    found = materialize(page_nodes(pages.select("host", "page", "html")), "page-nodes")
    trees = materialize(style_trees(found), "style-trees")
    # the root's place is 0: a page has it once, whatever its copies
    copies = F.count(F.when(F.col("place") == 0, 1)).alias("n")
    key = F.when(F.col("leaf"), F.col("place").bitwiseXOR(F.col("value"))).otherwise(F.col("place")).alias("key")
    bound = lambda n: max(HEAVY, n // SHARES)
    nodes = joined(found.select("host", "page", "place", key), trees, ["host", "key"], [], "inner", bound(found.count()))
    known = nodes.groupBy("host", "page", "key", "imp", "styles").agg(copies)
    known = known.groupBy("host", "page").agg(F.collect_list(F.struct("key", "imp", "styles")).alias("known"), F.max("n").alias("rows"))
    known = materialize(known.where(F.exists("known", lambda e: e["styles"] == 0)), "page-trees")
    rows = joined(pages, known, ["host", "page"], ["page_id", "url"], "left", bound(pages.count()))

    def run(batches):
        import pyarrow as pa

        for columns in rows_of(batches, "page_id", "url", "html", "known"):
            out = []
            for page_id, url, source, entries in zip(*columns, strict=True):
                text = main_text(source, {e["key"]: (e["imp"], e["styles"]) for e in entries or ()})
                out.append((page_id, url, text, len(text)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "known").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
