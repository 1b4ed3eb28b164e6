"""Main text of web pages by site style trees.

The DOMs of one host are merged: a node of the merged tree is a path of tags and classes. A presentation node has the layouts
that pages give it (the sequence of its children, text among them); a content node has the texts that pages hold there. Of m
different pages of a host with the node, a layout or text that k of them share has entropy: of a node's layouts
-sum(k/m * log(k/m)) / log(m + 2), of a text log(k) / log(m + 2). A node's layout importance is that entropy (1 where there is
one page); the importance of the texts at a node is 1 less their mean entropy. Where few pages tell, these lean on what nodes
of the same tag and class have on all hosts, which weighs as ``LEAN`` pages. The importance of a branch on a page is
(1 - g) * its layout importance + g * the mean of its children's, with g = ``DECAY`` to the power of its number of layouts; a
node of texts alone has theirs.

A branch without a node whose texts or branch are of an importance of ``LEAST`` is removed from the page, and so is a text with an entropy of ``ENTROPY``
or more. A node whose kind says that it isn't content (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments) has its
importance times ``PRIOR``, which takes its branch out whatever the tree says: entropy can't see texts that differ on every
page, as
adverts' do. A class counts only if all of its words say so. Where the rest has an article or main element with text, only
that is kept. Copies of a page count once, so an article that is posted several times stays.

Pages are parsed for the tree, which is stored without texts, and again to cut them, with what is known of the nodes and texts
of their own, never a host's whole tree. Defined results: null html is empty and gives empty text; a null url has no host, and its page loses
nodes by kind only; equal rows give equal rows; html of any length is read whole; broken markup is read as browsers do (open
elements end with their parent); an empty table gives no rows; other columns are left out."""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Entropy from which a text counts as part of the site, not of the page.
ENTROPY = 0.9
#: Importance under which a branch goes.
LEAST = 0.3
PRIOR = 0.25
DECAY = 0.9
LEAN = 4.0

# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp template svg math canvas object select".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("thead tbody tfoot tr td th", "table")}
_SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _SIBLINGS.items()}
#: Kinds and names of nodes that aren't content, and words that say nothing of it (fixed values).
_NOT_CONTENT = frozenset("head nav header footer aside form button dialog menu input".split())
_NOT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar side widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar share sharing social related recommended recommendations comment comments commentlist disqus respond replies skip".split()
)
_NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_NEUTRAL = frozenset("area bar block body bottom box container content global group inner item items left line link links list main outer page panel right section site slot text top unit wrap wrapper".split())
_KEEP_KINDS = frozenset("html body main".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in _RAW}


class _Node:
    __slots__ = ("tag", "path", "dropped", "content", "number")

    def __init__(self, tag, path, dropped, content, number):
        self.tag, self.path, self.dropped, self.content, self.number = tag, path, dropped, content, number


def _kind(attrs: str) -> tuple[str, list[list[str]], str]:
    """Label of a node, the words of each of its classes and its id, and its role."""
    label, classes, role = [], [], ""
    for kind, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "")
        if kind.lower() == "role":
            role = value.strip().lower()
        else:
            label.append(("." if kind.lower() == "class" else "#") + re.sub(r"\d+", "0", value.strip()))
            classes += [[x.lower() for x in _NAME.findall(_CAMEL.sub(" ", token))] for token in value.split()]
    return "".join(label), classes, role


def _says_not_content(words: list[str]) -> bool:
    return any(w in _NOT_NAMES for w in words) and all(w in _NOT_NAMES or w in _NEUTRAL or len(w) == 1 for w in words)


class Page:
    """Nodes of a page, each with its parent, path, label and whether its kind says that it isn't content; and its texts in
    page order, each with its node, whether one above it isn't content, and whether one is an article or main element."""

    def __init__(self, page: str):
        self.parent, self.path, self.label, self.named = [-1], [""], [""], [False]
        self.layout: list[list[str]] = [[]]
        self.texts: list[tuple[int, str, bool, bool]] = []
        stack = [_Node("", "", False, False, 0)]
        text: list[str] = []

        def flush() -> None:
            joined = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if joined:
                top = next(n for n in reversed(stack) if n.tag not in _INLINE)
                self.layout[top.number].append("#")
                self.texts.append((top.number, joined, stack[-1].dropped, stack[-1].content))

        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.search(page, at)
            if m is None:
                text.append(page[at:])
                break
            if m.start() > at:
                text.append(page[at : m.start()])
            at = m.end()
            close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if close:
                if tag == "br":
                    flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        if tag not in _INLINE or any(n.tag not in _INLINE for n in stack[k:]):
                            flush()
                        del stack[k:]
                        break
                continue
            if tag not in _INLINE:
                flush()
            if tag in _RAW:
                stop = None if attrs.rstrip().endswith("/") and tag in ("svg", "math") else _END_RAW[tag].search(page, at)
                if stop is not None:
                    at = stop.end()
                elif not attrs.rstrip().endswith("/"):
                    at = end
                continue
            if tag in _VOID:
                continue
            if tag in _ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if stack[k].tag not in _INLINE:
                        break
            if tag in _SIBLINGS:
                ends, stops = _SIBLINGS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in stops:
                        break
                    if stack[k].tag in ends:
                        del stack[k:]
                        if tag not in ("tr", "tbody"):
                            break
            self._open(stack, tag, attrs)
        flush()

    def _open(self, stack: list[_Node], tag: str, attrs: str) -> None:
        up = stack[-1]
        label, classes, role = _kind(attrs) if attrs else ("", [], "")
        content = up.content or tag in ("article", "main") or role in ("main", "article")
        by_name = tag not in _KEEP_KINDS and any(_says_not_content(c) for c in classes if tag != "article" or any(w.startswith("comment") for w in c))
        named = tag in _NOT_CONTENT or by_name or role in _NOT_ROLES
        if up.content and not up.dropped and tag == "header":
            named = False  # an article's own heading
        node = _Node(tag, f"{up.path}/{tag}{label}", up.dropped or named, content, up.number)
        if tag not in _INLINE:
            self.layout[up.number].append(tag + label)
            node.number = len(self.parent)
            for column, value in ((self.parent, up.number), (self.path, node.path), (self.label, tag + label), (self.named, named), (self.layout, [])):
                column.append(value)
        stack.append(node)


_HOST = re.compile(r"\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def _host(url: str | None) -> str | None:
    m = _HOST.match(url) if url else None
    return m[1].lower() if m else None


def _number(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


TREES = """key long, host long, page long, nodes array<struct<path: long, label: long, layout: long>>, features array<struct<path: long, text: long>>"""


def _numbered(page: Page, number) -> tuple[list[int], list[tuple[int, int]]]:
    """Numbers of the nodes' paths, and of each text's path and the text."""
    paths = [number(x) for x in page.path]
    return paths, [(paths[n], _number(t)) for n, t, *_ in page.texts]


def _remembering():
    """``_number``, of paths that come again."""
    known: dict[str, int] = {}

    def number(text: str) -> int:
        if text not in known:
            if len(known) >= 100_000:
                known.clear()
            known[text] = _number(text)
        return known[text]

    return number


def trees(pages: DataFrame) -> DataFrame:
    """Of each different page (its url and html by ``key``): host, number of its text, layout of each path (of all nodes
    there, in order), and the paths' texts."""

    def parse(batches):
        import pyarrow as pa

        number = _remembering()
        node = pa.struct([("path", pa.int64()), ("label", pa.int64()), ("layout", pa.int64())])
        feature = pa.struct([("path", pa.int64()), ("text", pa.int64())])
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                p = Page(html or "")
                paths, features = _numbered(p, number)
                layouts: dict[int, tuple[str, list[str]]] = {}
                for path, label, layout in zip(paths, p.label, p.layout):
                    layouts.setdefault(path, (label, []))[1].append(" ".join(layout))
                host = _host(url)
                columns[0].append(None if host is None else _number(host))
                columns[1].append(_number("\n".join(t for _, t, dropped, _ in p.texts if not dropped)))
                columns[2].append([{"path": path, "label": number(label), "layout": number("|".join(x))} for path, (label, x) in layouts.items()])
                columns[3].append([{"path": path, "text": t} for path, t in sorted(set(features))])
            types = (pa.int64(), pa.int64(), pa.list_(node), pa.list_(feature))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["key", "host", "page", "nodes", "features"])

    return pages.select("key", "url", "html").mapInArrow(parse, TREES).filter("host is not null").dropDuplicates(["key"])


def style_tree(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each host and path: layout importance, number of layouts and importance of its texts; and the texts (host, path,
    text) that are part of the site. Copies of a page count once."""
    once = known.dropDuplicates(["host", "page"])
    layouts = once.select("host", F.explode("nodes").alias("n")).groupBy("host", "n.path", "n.label", "n.layout").agg(F.count("*").alias("k"))
    k, m = F.col("k"), F.col("m")
    nodes = layouts.groupBy("host", "path", "label").agg(F.sum("k").alias("m"), F.count("*").alias("styles"), F.sum(k * F.log(k)).alias("s"))
    nodes = nodes.withColumn("layout", F.when(m == 1, F.lit(1.0)).otherwise((F.log(m) - F.col("s") / m) / F.log(m + 2)))
    texts = once.select("host", F.explode("features").alias("f")).groupBy("host", "f.path", "f.text").agg(F.count("*").alias("k"))
    means = texts.groupBy("host", "path").agg((F.sum(F.log(k)) / F.count("*")).alias("mean"))
    nodes = nodes.join(means, ["host", "path"], "left").withColumn("texts", 1 - F.col("mean") / F.log(m + 2))
    # what nodes of a label have on all hosts; a single page tells nothing
    wide = nodes.groupBy("label").agg(*[F.try_divide(F.sum((m - 1) * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), m - 1))).alias(f"all_{c}") for c in ("layout", "texts")])
    leaning = [((m * F.col(c) + LEAN * F.coalesce(f"all_{c}", c)) / (m + LEAN)).alias(c) for c in ("layout", "texts")]
    stats = nodes.join(wide, "label").select("host", "path", "styles", *leaning)
    shared = texts.filter("k > 1").join(nodes.select("host", "path", "m"), ["host", "path"]).filter(F.log(k) / F.log(m + 2) >= ENTROPY)
    return stats, shared.select("host", "path", "text")


def keep_texts(page: Page, paths: list, features: list, stats: dict, shared: set) -> list[str]:
    """The texts of a page that stay. ``stats`` has (styles, layout, texts) of paths, ``shared`` the site's features."""
    n = len(paths)
    total, count = [0.0] * n, [0] * n
    strong = [False] * n  # whether a node or any below is of importance
    for node in {t[0] for t in page.texts}:
        own = stats.get(paths[node], (1, 1.0, 1.0))[2]
        total[node], count[node] = own, 1
        strong[node] = own * (PRIOR if page.named[node] else 1.0) >= LEAST
    for node in range(n - 1, -1, -1):  # children come after their parents
        if not count[node]:
            continue
        styles, layout, _ = stats.get(paths[node], (1, 1.0, 1.0))
        share = 1.0 if set(page.layout[node]) == {"#"} else DECAY**styles  # a node of texts alone has their importance
        importance = (1 - share) * layout + share * total[node] / count[node]
        strong[node] = not page.named[node] and strong[node] or importance * (PRIOR if page.named[node] else 1.0) >= LEAST
        if node:
            up = page.parent[node]
            total[up] += importance
            count[up] += 1
            strong[up] |= strong[node]
    stay = [True] * n
    for node in range(1, n):
        stay[node] = strong[node] and stay[page.parent[node]]
    rest = [(t, content) for (node, t, dropped, content), f in zip(page.texts, features) if not dropped and stay[node] and f not in shared]
    return [t for t, content in rest if content or not any(c for _, c in rest)] if rest else []


def main_text(page: str) -> str:
    """The main text of a page by itself."""
    p = Page(page)
    return " ".join(keep_texts(p, p.path, [None] * len(p.texts), {}, set()))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("key", F.xxhash64("url", "html"))
    known = materialise(trees(own), "trees")
    stats, shared = style_tree(known)
    stats = materialise(stats, "style-tree")
    # a text goes only with a node whose texts are of low importance, so only pages with such a node need to know more
    weak = stats.filter(F.col("texts") < LEAST).select("host", "path")
    features = known.select("key", "host", F.explode("features").alias("f")).select("key", "host", "f.*")
    asking = features.join(weak, ["host", "path"], "left_semi").select("key").distinct()
    met = known.join(asking, "key", "left_semi").select("key", "host", F.explode("nodes.path").alias("path")).join(stats, ["host", "path"])
    met = met.groupBy("key").agg(F.collect_list(F.struct("path", "styles", "layout", "texts")).alias("stats"))
    hit = features.join(shared, ["host", "path", "text"]).groupBy("key").agg(F.collect_list(F.struct("path", "text")).alias("shared"))
    notes = materialise(met.join(hit, "key", "full"), "notes")

    def cut(batches):
        import pyarrow as pa

        number = _remembering()
        for batch in batches:
            found = []
            for html, stats, shared in zip(*(batch.column(i).to_pylist() for i in range(2, 5))):
                p = Page(html or "")
                paths, features = _numbered(p, number) if stats or shared else (p.path, [None] * len(p.texts))
                known = {x["path"]: (x["styles"], x["layout"], 1.0 if x["texts"] is None else x["texts"]) for x in stats or ()}
                found.append(" ".join(keep_texts(p, paths, features, known, {(x["path"], x["text"]) for x in shared or ()})))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.join(notes, "key", "left").select("page_id", "url", "html", "stats", "shared").mapInArrow(cut, EXTRACTED)
