"""Main text of web pages by site style trees.

All pages of a host share a style tree: elements of their DOMs merged by style path (tag,
class and id from the root on, digits in names as one sign). Inline elements are no nodes of the
tree; their text is that of the block around them. After Yi, Liu, Li, "Eliminating Noisy
Information in Web Pages for Data Mining" (2003), a style node has
- the importance of its content: the entropy, over the host's pages, of its text, divided by log(pages):
  near 1 if it changes from page to page, 0 for a template's fixed text;
- the importance of its presentation: the same of the sequence of its child styles;
- a composite importance: for a node with l presentations
  (1 - DECAY^l) * presentation + DECAY^l * the mean of its children, or its content if that is more.
A branch is as important as its most important node. A node on fewer than MIN_PAGES pages of the host
counts as important, in it and above it.

The main container is found by importance too: from the root on, the only child that holds MAIN_SHARE of
the host's text, each block weighed by its content importance, as long as pages hold it once. Then, on
a host of MIN_PAGES different pages or more,
1. outside the main container branches under BESIDE go, and those that are all links if they are under STRICT;
2. inside it no branch goes by its importance alone, as text that a host's authors repeat is main text, too;
3. names break ties: an element named as advertisement, menu, notice and the like, or a header, goes if it
   is outside the main container, or if it is inside and its branch is under STRICT.
Headings are judged with the block that they stand in, so none goes alone.
On smaller hosts, where entropy cannot tell, names decide as a prior: named elements and headers outside
articles go; the article and main elements are the text if they hold at least as many characters as all
else outside links; blocks outside them that are nearly all links go.

Elements that are no text by their tag (scripts, styles, forms, nav, aside, footer), hidden ones, and
those named as reader comments, whose texts are as varied as articles, are removed on every host.

Text. Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined in page order by a line feed; empty blocks do not count. A line break
element is white space. Markup is read tolerantly: open elements may be missing their ends,
and comments and raw text elements hide what they contain; a drawing or media element hides what
it contains if it is closed.

Scale. Pages emit a row for each style path, which are counted with partial aggregation,
so a host with a third of all pages costs no more in one task than its styles; copies of a page
count once. What is decided for a host travels back to its pages: by broadcast if it is at most
BROADCAST_BYTES in all, else by a join in which a host is split into SALT parts.

Defined cases: null or empty html gives an empty text with 0 characters. A null or odd url is a
host of its own (empty name). Repeated rows give repeated results. Empty tables give no rows. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cut

MIN_PAGES, BESIDE, STRICT, DECAY, MAIN_SHARE = 8, 0.8, 0.98, 0.9, 0.75
BROADCAST_BYTES, SALT = 64 << 20, 32

OUT = "page_id long, url string, text string, n_chars long"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
#: Hide what they contain up to their end, if there is one.
_CLOSED = frozenset("svg math object canvas audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_REMOVED = frozenset("nav aside footer form button select option menu dialog fieldset input".split())
#: Start tags that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of these kinds, up to the nearest of the last set.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Words in a class, id or role that name a part which is no main text.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside toolbar topbar"
    " footer foot cookie cookies consent gdpr notice notices alert popup modal overlay"
    " discussion respond reply"
    " share sharing social related recommended recommendations newsletter subscribe subscription signup login search form"
    " contentinfo complementary".split()
)
_COMMENTS = frozenset("comment comments disqus replies".split())
_HEADERS = frozenset("header masthead head sitehead".split())
_ARTICLE = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What is no node of a style tree.
_FLAT = _INLINE | _HEADINGS

_COMMENT, _SECTION = r"<!--(?:.*?-->|.*)|", r"<!\[CDATA\[.*?\]\]>|"
_TAGS = r"<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
_TOKEN, _TOKEN_PLAIN = re.compile(_COMMENT + _SECTION + _TAGS, re.DOTALL), re.compile(_COMMENT + _TAGS, re.DOTALL)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "path", "removed", "named", "article", "children", "texts")

    def __init__(self, tag, path, removed, named, article):
        self.tag, self.path, self.removed, self.named, self.article = tag, path, removed, named, article
        self.children: list[str] = []
        self.texts: list[str] = []


def _style(tag: str, attrs: str) -> tuple[str, frozenset, bool]:
    """(style of an element, words in its names, whether it is hidden)."""
    if "=" not in attrs and "hidden" not in attrs:
        return tag, frozenset(), False
    names, hidden = [], False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            names.append(value)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    if not names:
        return tag, frozenset(), hidden
    joined = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", " ".join(names)).lower()
    return f"{tag}.{_DIGITS.sub('#', joined)}", frozenset(_WORDS.findall(joined)), hidden


_PATHS: dict[tuple[str, str], str] = {}


def _below(path: str, style: str) -> str:
    """Key of a style path: a digest, so that deep pages have short keys."""
    key = (path, style)
    got = _PATHS.get(key)
    if got is None:
        if len(_PATHS) > 200_000:
            _PATHS.clear()
        got = _PATHS[key] = hashlib.blake2b(f"{path}\0{style}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    return got


def _tokens(html: str):
    """Matches of markup. No search goes to the end for something that isn't there: sections are looked for as
    long as an end of one follows, and nothing but a comment starts behind the last end of a tag."""
    section, tag, at = html.rfind("]]>"), html.rfind(">") + 1, 0
    while at < tag and (m := (_TOKEN if at <= section else _TOKEN_PLAIN).search(html, at, tag)):
        yield m
        at = m.end()
    if (k := html.find("<!--", max(at, tag))) >= 0:
        yield _TOKEN_PLAIN.match(html, k)


def walk(html: str):
    """Events of a page in order: ("open", node), ("close", node), ("text", node, text), ("break", node)."""
    root = Node("", "", False, False, False)
    stack, at, hide = [root], 0, ""
    count: Counter[str] = Counter()  # open elements by tag, so that nothing is looked for in vain
    closes: dict[str, int] = {}  # the last end of each kind that hides what it contains

    def pop_to(k):
        while len(stack) > k:
            count[stack[-1].tag] -= 1
            yield "close", stack.pop()

    for m in _tokens(html):
        if m.start() > at and not hide:
            yield "text", stack[-1], html[at : m.start()]
        at = max(at, m.end())
        tag = m[2] or m[5]
        if not tag:
            if html.startswith("<!--", m.start()) and not html.startswith("-->", m.end() - 3):
                at = len(html)  # a comment without an end hides the rest
            continue
        tag, ends, attrs = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if hide:
            if ends and tag == hide:
                hide = ""
            continue
        if ends:
            if tag == "br":
                yield "break", stack[-1]
                continue
            for k in range(len(stack) - 1, 0, -1) if count[tag] else ():
                if stack[k].tag == tag:
                    yield from pop_to(k)
                    break
            continue
        if tag in _ENDS_P and count["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    yield from pop_to(k)
                    break
                if stack[k].tag not in _INLINE:
                    break
        if tag in _ENDS:
            kinds, limits = _ENDS[tag]
            for k in range(len(stack) - 1, 0, -1) if any(count[x] for x in kinds) else ():
                if stack[k].tag in limits:
                    break
                if stack[k].tag in kinds:
                    yield from pop_to(k)
                    break
        if tag == "br":
            yield "break", stack[-1]
            continue
        if tag in _RAW or tag in _CLOSED:
            if tag in _CLOSED and tag not in closes:
                closes[tag] = max((x.start() for x in re.finditer(f"</{tag}[\\s>/]", html, re.IGNORECASE)), default=-1)
            if not attrs.rstrip().endswith("/") and (tag in _RAW or closes[tag] >= at):
                hide = tag
            continue
        style, words, hidden = _style(tag, attrs)
        up = stack[-1]
        article = up.article or tag in _ARTICLE
        part = tag not in ("body", "html") and tag not in _HEADINGS
        removed = up.removed or hidden or tag in _REMOVED or part and bool(words & _COMMENTS)
        hint = words & _NAMES or (tag == "header" or words & _HEADERS) and not up.article
        named = up.named or part and bool(hint)
        node = Node(tag, _below(up.path, style), removed, named, article)
        up.children.append(style)
        yield "open", node
        if tag in _VOID:
            yield "close", node
        else:
            stack.append(node)
            count[tag] += 1
    if at < len(html) and not hide:
        tail = html[at:]
        unfinished = re.compile(r"<[a-zA-Z/!]").search(tail, tail.rfind(">") + 1)  # a tag that the page's end cuts off
        yield "text", stack[-1], tail[: unfinished.start()] if unfinished else tail
    yield from pop_to(1)


class _Seen:
    """What a page tells of a style path."""

    __slots__ = ("above", "looks", "texts", "chars", "below", "times", "named")

    def __init__(self, above: str, named: bool):
        self.above, self.named, self.looks, self.texts, self.chars, self.below, self.times = above, named, [], [], 0, 0, 0


def features(html: str) -> list[tuple]:
    """(path, path above, presentation digest, content digest, own characters outside links, those of the branch, elements,
    whether it is named) of each style path of a page, and a row of the page itself, with the empty path."""
    seen = {"": _Seen("", False)}
    stack = [(Node("", "", False, False, False), seen[""], [0])]  # open blocks, with the characters of their branches so far
    links = 0  # open links
    for event in walk(html):
        node = event[1]
        links += (event[0] == "open") - (event[0] == "close") if node.tag == "a" else 0
        if event[0] == "open":
            if node.tag not in _FLAT:
                stack.append((node, seen.setdefault(node.path, _Seen(stack[-1][0].path, node.named)) if not node.removed else _Seen("", False), [0]))
        elif event[0] == "close":
            if node.tag not in _FLAT and node.path:
                _, own, held = stack.pop()
                own.looks.append(",".join(c for k, c in enumerate(node.children) if not k or c != node.children[k - 1]))
                own.texts.append(" ".join("".join(node.texts).split()))
                own.times += 1
                own.below += held[0]
                stack[-1][2][0] += held[0]
        elif event[0] == "text" and not node.removed:
            stack[-1][0].texts.append(event[2])
            if not links and (n := len(event[2].strip())):
                stack[-1][1].chars += n
                stack[-1][2][0] += n
    while stack:  # the root, and what a page leaves open
        _, own, held = stack.pop()
        own.below += held[0]
        if stack:
            stack[-1][2][0] += held[0]
    digest = lambda parts: hashlib.blake2b("\1".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    return [(p, o.above, digest(o.looks), digest(o.texts) if any(o.texts) else "", o.chars, o.below, o.times, o.named) for p, o in seen.items()]


def main_text(html: str, noise: frozenset | None = None, main: str | None = None) -> str:
    """The text of a page without removed branches. noise and main: the host's low branches and main container; without
    noise, that is of a host with too few pages, names and articles decide instead."""
    prior, noise = noise is None, noise or frozenset()
    blocks: list[tuple[str, bool, float]] = []  # text, in the article, share of it in links
    buf: list[str] = []
    state = {"linked": 0, "size": 0}  # characters of the open block
    links = gone = within = 0  # open links, low branches, main containers

    def flush(article):
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            if text:
                blocks.append((text, article, state["linked"] / max(1, state["size"])))
            buf.clear()
        state["linked"] = state["size"] = 0

    current = False
    for event in walk(html):
        kind, node = event[0], event[1]
        if kind == "text":
            if not (node.removed or gone or node.named and (prior or not within)):
                buf.append(event[2])
                n = len(event[2].strip())
                state["size"] += n
                state["linked"] += n if links else 0
                current = node.article
        elif kind == "break":
            buf.append(" ")
        else:
            if node.tag not in _INLINE:
                flush(current)
            step = 1 if kind == "open" else -1
            links += step if node.tag == "a" else 0
            if node.tag not in _INLINE:
                gone += step if node.path in noise else 0
                within += step if main is not None and node.path == main else 0
    flush(current)
    if not prior:
        return "\n".join(b[0] for b in blocks)
    inside = sum(len(b[0]) for b in blocks if b[1])
    outside = sum(len(b[0]) for b in blocks if not b[1] and b[2] < 0.9)
    if inside and inside >= outside:
        return "\n".join(b[0] for b in blocks if b[1])
    return "\n".join(b[0] for b in blocks if b[1] or b[2] < 0.9)


_FEATURES = "host string, page string, path string, above string, look string, content string, chars long, below long, times long, named boolean"


def _features(stream):
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _FEATURES.split(", ")])
    for rb in stream:
        out = []
        for h, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            if text:
                ident = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
                out += [(h, ident, *x) for x in features(text)]
        cols = zip(*out, strict=True) if out else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _entropy(rows: DataFrame, feature: str, *sums: str) -> DataFrame:
    """Pages, kinds and normalised entropy of a feature by host and path, and sums of columns."""
    keys = ["host", "path", "above", "named"]
    n = rows.groupBy(*keys, feature).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    total = n.groupBy(*keys).agg(F.sum("n").alias("m"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log("n")).alias("s"), F.max(F.col(feature) != "").alias("filled"), *[F.sum(c).alias(c) for c in sums])
    return total.select(*keys, "m", "kinds", "filled", *sums, F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0).alias(feature))


def importance(pages: DataFrame, host: str = "host", text: str = "html") -> DataFrame:
    """One row per style node: host, path, above, named, pages m, importance of its presentation (look, of so many kinds) and
    content (filled: there is any), and sums of features over pages; the empty path stands for the host."""
    rows = pages.select(F.col(host), F.col(text)).mapInArrow(_features, _FEATURES).dropDuplicates(["host", "page", "path"])
    rows = cut(rows)  # narrow; both entropies read it, and pages are parsed once for them
    look, content = _entropy(rows, "look"), _entropy(rows, "content", "chars", "below", "times")
    return look.drop("filled").join(content.drop("m", "kinds"), ["host", "path", "above", "named"])


def judged(nodes: list[dict]) -> tuple[str, list[str]]:
    """(main container, paths whose branches go) of a host, from its shared style nodes.

    rare, rare_chars: whether rarer paths stand below a node, and their characters.
    """
    at = {n["path"]: n for n in nodes}
    below: dict[str, list[str]] = {p: [] for p in at}
    for p, n in at.items():
        if p and n["above"] in at:
            below[n["above"]].append(p)
    order, todo = [], [p for p, n in at.items() if not p or n["above"] not in at]
    while todo:
        order.append(todo.pop())
        todo += below[order[-1]]
    composite, best, weight = {}, {}, {}
    for p in reversed(order):
        n, kids = at[p], below[p]
        content = n["content"] if n["filled"] else 0.0
        fade = DECAY ** n["kinds"]
        pages = sum(at[c]["m"] for c in kids)
        mean = sum(at[c]["m"] * composite[c] for c in kids) / pages if kids else 0.0
        inner = (1 - fade) * n["look"] + fade * mean if kids else 0.0
        composite[p] = max(content, inner)
        best[p] = max([1.0 if n["rare"] else composite[p], *(best[c] for c in kids)])
        weight[p] = n["chars"] * content + n["rare_chars"] + sum(weight[c] for c in kids)
    main, inside = "", ""
    while inside is not None:
        main = inside
        inside = next((c for c in below.get(main, ()) if weight[c] >= MAIN_SHARE * weight[""] > 0 and at[c]["times"] <= 1.1 * at[c]["m"]), None)
    within, todo = set(), [main]
    while todo:
        within.add(todo[-1])
        todo += below.get(todo.pop(), ())
    above, p = set(), main
    while p:  # what the main container stands in is no branch beside it
        p = at[p]["above"]
        above.add(p)
    low = lambda p: best[p] < (STRICT if at[p]["named"] else 0.0 if p in within else BESIDE if at[p]["below"] else STRICT)
    return main, sorted(p for p in order if p and p not in above and p != main and low(p))


def low_branches(nodes: DataFrame) -> DataFrame:
    """(host, main, noise): of each host of MIN_PAGES pages or more its main container and the paths whose branches go.

    Of paths on fewer pages only a mark and their characters remain on the path above, so a host's row
    holds the paths that its pages share.
    """
    marks = nodes.where(F.col("m") < MIN_PAGES).groupBy("host", F.col("above").alias("path")).agg(F.lit(True).alias("rare"), F.sum("below").alias("rare_chars"))
    shared = nodes.where(F.col("m") >= MIN_PAGES).join(marks, ["host", "path"], "left").fillna(False, ["rare"]).fillna(0, ["rare_chars"])
    names = ["path", "above", "named", "m", "kinds", "look", "content", "filled", "chars", "below", "times", "rare", "rare_chars"]
    tree = shared.groupBy("host").agg(F.collect_list(F.struct(*names)).alias("nodes")).where(F.exists("nodes", lambda n: n["path"] == ""))

    def prune(stream):
        for rb in stream:
            got = [judged(x) for x in rb.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([m for m, _ in got], pa.string()), pa.array([x for _, x in got], pa.list_(pa.string()))], names=["host", "main", "noise"])

    return tree.mapInArrow(prune, "host string, main string, noise array<string>")


def with_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages with what is decided for their host, without bringing a host's pages together: by broadcast if that is small, else salted."""
    hosts = cut(hosts)
    size = hosts.agg(F.sum(64 + F.octet_length("host") + 24 * F.size("noise"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(hosts), "host", "left")
    salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["host", "_salt"], "left")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    decided = with_hosts(rows, low_branches(importance(rows))).select("page_id", "url", "html", "noise", "main")

    def run(stream):
        for rb in stream:
            text = [main_text(h, None if n is None else frozenset(n), m) if h else "" for h, n, m in zip(*(rb.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return decided.mapInArrow(run, OUT)
