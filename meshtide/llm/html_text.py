"""Main text of web pages by a site style tree.

The pages of a host are merged into one style tree, from the whole body of each
page. A node is a branch of the DOM named by its path of tags and classes;
headings and inline elements belong to the branch around them. A page's text is
a sequence of blocks, each of which stands in one node. For each node the tree
counts the pages it occurs on, its presentation styles (the sequence of its
child tags) and the contents of its own blocks (cut at signs such as ``|``).
With m pages:

* presentation importance: -sum p log_m p over the styles, p their page shares;
* content importance: 1 - mean over all occurrences of contents of log_m (pages with it);
* composite: (1 - g^l) presentation + g^l content, for l styles and g = 0.9;
  the larger of it and the content importance counts.

Few hosts have pages enough to judge a branch, so the host's tree is smoothed
towards the tree of all hosts (the same counts by path alone) as if HOST_PRIOR
pages of it had been seen, and that one towards 1 as if PRIOR pages of main text
had: where all hosts agree, a branch can go from five differing pages on. Pages
of a host with the same longest block count as one, so that copies do not lose
their articles. Text in nodes whose importance is below THRESHOLD is removed; a
branch goes when all its nodes do.

What the tree has not seen often enough is left to names: after it, elements
whose tag, role or whole class or id names page furniture are dropped, and if a
page has an article or main element, so is all outside it. Markup that is never
text (scripts, styles, form controls) is not in the DOM at all.

Counts are combined on the map side, and only hashes are shuffled; what goes back
to the pages is one short row for each host, broadcast up to BROADCAST_ROWS.

Defined results: null or empty html gives empty text; null url is a host of its
own; broken and truncated markup is read as far as it goes; repeated rows give
repeated rows; an empty table gives an empty result; other columns are not
looked at. Nodes deeper than MAX_DEPTH count as their ancestor there; their text
is kept whole. Where the tree would leave nothing of a page, the page is left to names.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.session import checkpointed

GAMMA, THRESHOLD, PRIOR, HOST_PRIOR, MAX_DEPTH = 0.9, 0.8, 16, 200, 24
#: Hosts whose lists of low nodes (some 100 bytes each) may be broadcast.
BROADCAST_ROWS = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes"))
#: Elements that do not break a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Never text, whatever the page.
MARKUP = frozenset("head script style noscript template iframe button select option textarea input svg canvas title object embed video audio map xmp noframes".split())
#: Furniture by its tag, where the tree left it.
FURNITURE = frozenset("nav footer aside form menu dialog".split())
#: Of these, the ones that some sites wrap around a whole page.
WRAPPERS = frozenset("form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Whole classes or ids that name furniture. Words that also name content (banner, menu, share, login, legal, related ...) are left to the style tree.
NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsored promo navbar submenu sidebar masthead breadcrumb breadcrumbs"
    " comments disqus gdpr newsletter pagination pager respond toolbar"
).split())
#: Known compounds, whole as well, written with - or _.
COMPOUNDS = frozenset(f"{a}-{b}" for a, b in (
    *((a, b) for a in ("cookie", "cookies", "gdpr", "consent") for b in ("bar", "banner", "notice", "notices", "popup", "modal", "overlay", "alert")),
    *((a, b) for a in ("ad", "ads", "advert") for b in ("box", "banner", "slot", "unit", "container", "wrapper", "block")),
    *((a, b) for a in ("share", "sharing", "social") for b in ("bar", "buttons", "links", "icons", "widget")),
    *((a, b) for a in ("nav", "navigation", "site", "main", "top") for b in ("menu", "nav", "navbar", "navigation")),
    *((a, b) for a in ("comment", "comments", "disqus") for b in ("list", "form", "section", "area", "thread")),
    *((a, b) for a in ("site", "page") for b in ("footer", "sidebar", "breadcrumbs", "masthead")),
    *((a, b) for a in ("newsletter", "subscribe", "signup", "login") for b in ("form", "box", "popup", "modal", "overlay", "banner")),
    *((a, b) for a in ("related", "recommended") for b in ("posts", "articles", "links", "stories")),
    *((a, b) for a in ("reader", "user", "visitor") for b in ("comments", "comment")),
    *((a, b) for a in ("alert", "notice", "notification") for b in ("box", "bar", "banner", "popup")),
    ("comment", "respond"),
))
#: Never furniture by a class or id: the page, its content roots and headings; nor are inline elements.
NEVER = frozenset("html body main article h1 h2 h3 h4 h5 h6 hgroup".split())
#: Classes and ids of an article inside an article that is a reader's.
REPLIES = frozenset("comment reply".split())
#: An open p ends where one of these starts.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: start tag -> open elements it ends, up to the nearest of the barriers
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BARRIERS = frozenset("article section main div td th table body li ul ol dl blockquote nav aside footer header form figure".split())

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*+"|'[^']*+')*+|[^>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")
#: Signs between the contents of one block.
CUT = re.compile(r"\s[|·•»]\s")


class Node:
    __slots__ = ("children", "furniture", "name", "parent", "tag")

    def __init__(self, tag: str, name: str, furniture: bool, parent: Node | None):
        self.tag, self.name, self.furniture, self.parent = tag, name, furniture, parent
        self.children: list[Node | str] = []


def attributes(text: str, tag: str, nested: bool = False) -> tuple[str, bool]:
    """The class name that goes into the node's name, and whether an attribute names furniture; ``nested``: of an article inside another."""
    label, bad, named = "", False, tag not in NEVER and tag not in INLINE
    for key, *values in ATTRIBUTE.findall(text):
        value, key = max(values, key=len).lower(), key.lower()
        if key == "class":
            label = " ".join(sorted(value.split()))
        if key == "role":
            bad |= value.strip() in ROLES
        else:
            bad |= named and any(token in NAMES or token.replace("_", "-") in COMPOUNDS for token in value.split())
            bad |= nested and not REPLIES.isdisjoint(value.split())
    return label, bad


def parse(text: str) -> Node:
    """A tolerant DOM: elements with their children and texts; comments, scripts and styles left out.

    A form, menu or dialog that holds an article or main element, or over half of
    the page's text, is a wrapper and no furniture.
    """
    root = node = Node("", "", False, None)
    pos, lower, chars = 0, None, 0
    wrappers: list[Node] = []
    while m := TOKEN.search(text, pos):
        if m.start() > pos:
            node.children.append(entities.unescape(text[pos : m.start()]))
            chars += len(node.children[-1].strip())
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            x = node
            while x is not root and x.tag != tag:
                x = x.parent
            if x is not root:
                node = x.parent
            continue
        ended, until = ({"p"}, BARRIERS) if tag in ENDS_P else ENDS.get(tag, ((), ()))
        x = node
        while ended and x is not root and x.tag not in until:
            if x.tag in ended:
                node = x.parent
            x = x.parent
        label, bad = attributes(m[3], tag, tag == "article" and within(node, tag)) if m[3] else ("", False)
        child = Node(tag, f"{tag}.{label}" if label else tag, bad or tag in FURNITURE, node)
        node.children.append(child)
        if tag in WRAPPERS and not bad:
            wrappers.append(child)
        if tag in RAW:
            lower = lower or text.lower()
            at = lower.find(f"</{tag}", pos)
            pos = len(text) if at < 0 or len(lower) != len(text) and (at := text.find(f"</{tag}", pos)) < 0 else at
        elif tag not in VOID and not (m[3].endswith("/") and tag in INLINE):
            node = child
    if pos < len(text):
        rest = text[pos:]
        cut = re.search(r"<[/!a-zA-Z][^>]*\Z", rest)  # a tag that was cut off
        node.children.append(entities.unescape(rest[: cut.start()] if cut else rest))
        chars += len(node.children[-1].strip())
    for x in wrappers:
        held, content = holding(x)
        x.furniture = not content and 2 * held <= chars
    return root


def within(node: Node | None, tag: str) -> bool:
    """Whether a node or one around it has the tag."""
    while node is not None and node.tag != tag:
        node = node.parent
    return node is not None


def holding(top: Node) -> tuple[int, bool]:
    """Characters of text below a node, and whether an article or main element that is no furniture is there."""
    chars, content, stack = 0, False, list(top.children)
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            chars += len(x.strip())
        else:
            content |= x.tag in ("article", "main") and not x.furniture
            stack += x.children
    return chars, content


def roots(top: Node) -> list[Node]:
    """The outermost article or main elements that are no furniture; else the whole page."""
    for wanted in (("article",), ("main",)):
        found, stack = [], [top]
        while stack:
            x = stack.pop()
            if x.furniture:
                continue
            if x.tag in wanted:
                found.append(x)
            else:
                stack += [c for c in reversed(x.children) if isinstance(c, Node)]
        if found:
            return found
    return [top]


def blocks_of(top: Node):
    """``(block, path, named)`` of all text in page order: the node it stands in, and whether names drop it.

    With a block of None: one row for each node, its child tags in place of ``named``.
    """
    inside = {id(r) for r in roots(top)}
    within_article = all(r.tag in ("article", "main") for r in roots(top))
    current: list[str] = []
    paths, named, root = [0], [], []  # of the open elements

    def flush():
        block = SPACE.sub(" ", "".join(current)).strip()
        current.clear()
        return [(block, paths[-1], any(named) or not any(root))] if block else []

    stack: list = [(top, False)]
    while stack:
        x, leaving = stack.pop()
        if isinstance(x, str):
            current.append(x)
            continue
        nested = x.tag in INLINE and not x.furniture
        if leaving:
            yield from flush()
            for held in (paths, named, root):
                held.pop()
            continue
        if x.tag in MARKUP:
            if x.tag not in INLINE:
                yield from flush()
            continue
        if nested:
            if x.tag == "br":
                current.append(" ")
            stack += [(c, False) for c in reversed(x.children)]
            continue
        yield from flush()
        deep = x.tag in HEADINGS or len(paths) > MAX_DEPTH
        paths.append(paths[-1] if deep else xxhash.xxh64_intdigest(f"{paths[-1]}>{x.name}") >> 1)
        named.append(x.furniture or (x.tag == "header" and not (within_article and any(root))))
        root.append(id(x) in inside)
        if not deep:
            yield None, paths[-1], " ".join(c.tag for c in x.children if isinstance(c, Node))
        stack.append((x, True))
        stack += [(c, False) for c in reversed(x.children)]
    yield from flush()


def short_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def page_features(text: str) -> tuple[int, set]:
    """A 32-bit hash of a page's longest block, and (path, kind, feature) of its nodes ('m'), presentation styles ('s') and contents ('c')."""
    seen: set = set()
    longest = ""
    for block, path, style in blocks_of(parse(text)):
        if block is None:
            seen.add((path, "m", 0))
            seen.add((path, "s", short_hash(style)))
        else:
            seen.update((path, "c", short_hash(part)) for part in CUT.split(block))
            if len(block) > len(longest):
                longest = block
    return xxhash.xxh32_intdigest(longest) >> 1, seen


def main_text(text: str, removed: frozenset = frozenset(), names: bool = True) -> str:
    """The text of a page without the blocks of the ``removed`` nodes and, after that, without what ``names`` drop."""
    every = [row for row in blocks_of(parse(text)) if row[0] is not None]
    left = [row for row in every if row[1] not in removed] or every
    if names:
        left = [row for row in left if not row[2]] or [row for row in every if not row[2]]
    return " ".join(row[0] for row in left)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def importance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pages, presentation, content, importance`` of nodes from ``rows(keys, kind, feature, n)``, n the pages with a feature."""
    kind = lambda k, x: F.when(F.col("kind") == k, x)
    n = F.col("n").cast("double")
    node = rows.groupBy(*keys).agg(
        F.max(kind("m", F.col("n"))).alias("pages"), F.count(kind("s", n)).alias("styles"),
        F.sum(kind("s", n)).alias("s"), F.sum(kind("s", n * F.log(n))).alias("s_log"),
        F.sum(kind("c", n)).alias("c"), F.sum(kind("c", n * F.log(n))).alias("c_log"))
    many, base = F.col("pages") > 1, F.log(F.col("pages").cast("double"))
    presentation = F.when(many, F.least(F.lit(1.0), (F.log("s") - F.col("s_log") / F.col("s")) / base)).otherwise(1.0)
    content = F.when(many & (F.col("c") > 0), 1 - F.col("c_log") / F.col("c") / base).otherwise(1.0)
    g = F.pow(F.lit(GAMMA), "styles")
    node = node.withColumn("presentation", presentation).withColumn("content", content)
    own = F.greatest((1 - g) * F.col("presentation") + g * F.col("content"), F.col("content"))
    return node.select(*keys, "pages", "presentation", "content", own.alias("importance"))


def style_tree(pages: DataFrame) -> DataFrame:
    """``site, path, pages, presentation, content, own, everywhere, importance`` of the nodes that bear text, from ``pages(site long, html)``.

    ``own``: the importance in the host's tree; ``everywhere``: in that of all hosts, smoothed; ``importance``: both together.
    """

    def run(batches):
        for b in batches:
            found: set = set()
            for site, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page, seen = page_features(text.as_py())
                found.update((site, *k, page) for k in seen)
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["site", "path", "kind", "feature", "page"])

    rows = pages.select("site", "html").mapInArrow(run, "site long, path long, kind string, feature long, page int")
    rows = checkpointed(rows.groupBy("site", "path", "kind", "feature").agg(F.countDistinct("page").alias("n")))
    hosts = importance(rows, ["site", "path"])
    everywhere = importance(rows.groupBy("path", "kind", "feature").agg(F.sum("n").alias("n")), ["path"])
    smoothed = (F.col("pages") * F.col("importance") + PRIOR) / (F.col("pages") + PRIOR)
    everywhere = everywhere.select("path", smoothed.alias("everywhere"))
    bearing = rows.where("kind = 'c'").select("site", "path").distinct()
    both = (F.col("pages") * F.col("own") + HOST_PRIOR * F.col("everywhere")) / (F.col("pages") + HOST_PRIOR)
    return hosts.withColumnRenamed("importance", "own").join(bearing, ["site", "path"]).join(everywhere, "path").select("site", "path", "pages", "presentation", "content", "own", "everywhere", both.alias("importance"))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, names: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; without ``names`` the tree alone decides."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("site", F.xxhash64(host_of(F.col("url"))))
    low = style_tree(rows).where(F.col("importance") < threshold).groupBy("site").agg(F.collect_set("path").alias("removed"))
    low = checkpointed(low)
    few = low.count() <= BROADCAST_ROWS
    page_kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [main_text(t.as_py(), frozenset(r.as_py() or ()), names) for t, r in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.join(F.broadcast(low) if few else low, "site", "left").select("page_id", "url", "html", "removed").mapInArrow(run, f"page_id {page_kind}, url string, text string, n_chars long")
