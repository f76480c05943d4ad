"""HTML extraction by site template removal.

Each page is parsed into a tree.  Element subtrees outside the article are
hashed (tag, class, id and everything below) and counted in Spark per host over
distinct pages (pages of one host with the same text are one); a subtree that recurs
on ``MIN_PAGES`` of them or more, and on ``MIN_SHARE`` of the host's, belongs to the
site's template and is deleted.  What is left loses the elements whose tag
or class says that they are no article text (menus, adverts, forms, comments),
and the article, else the main part, else the body gives the blocks of text.
Class tokens and ids count as a whole, and not on headings.  A form that holds an
article stays; so does any other element that holds one, but nav, footer, aside,
menu and dialog, when the page has no article outside such elements.
Subtrees inside the article are never deleted for recurring: copies of an
article on one host are whole pages, not templates; no more are copies of a page
without a marked article, or passages that a small part of a host's pages share.

Counts are keyed by (host, subtree) and combine map-side, so a hot host is many
keys.  The table of templates reaches the tasks as an array when it is within
``BROADCAST_TEMPLATES`` rows; otherwise a join hands each page its own.

Defined results: a null or empty html gives an empty text; a null url is the
host ''; repeated pages give a row each and count as one for the templates; null page ids stay; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MIN_PAGES = 4
MIN_SHARE = 0.25
BROADCAST_TEMPLATES = 1_000_000

# Element names and class words (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe xmp".split())
DROPPED = set("script style title textarea noscript template iframe xmp head nav footer aside form button select "
              "option svg canvas object audio video dialog menu".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody "
             "tfoot thead tr ul caption".split())
TEASERS = set("nav footer aside menu dialog".split())      # their articles are not the page's
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
HINTS = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
            "consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice "
            "notices pagination pager popup promo promoted recommended related replies reply respond "
            "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
# Compound class tokens and ids: one of these, a hyphen, one of those (fixed values).
HINT_FIRST = set("site page main primary secondary top bottom left right global header footer side mobile post entry article "
                 "blog user".split())
HINT_LAST = set("area bar block body box buttons banner container content form group header icons inner item items label "
                "links list menu meta nav notice overlay popup posts section slot text thread title toggle unit widget "
                "wrap wrapper".split())
HINT_ENDS = set("ad ads advert banner breadcrumb breadcrumbs comments footer menu nav navbar navigation newsletter pagination "
                "pager share sharing sidebar social subscribe toolbar widget".split())
HINT_STARTS = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent footer menu "
                  "modal nav navbar navigation newsletter pagination popup promo recommended related share sharing sidebar "
                  "signup social sponsored subscribe toolbar widget".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
         "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _hint(token: str) -> bool:
    """Whether a class token or an id is a hint word or a known compound of one."""
    if token in HINTS:
        return True
    first, _, last = token.replace("_", "-").partition("-")
    return (first in HINT_FIRST and last in HINT_ENDS) or (first in HINT_STARTS and last in HINT_LAST)


class Node:
    __slots__ = ("tag", "attrs", "parts", "hash")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.parts, self.hash = tag, attrs, [], None

    def hinted(self) -> bool:
        if not self.attrs:
            return False
        for name, *values in _ATTR.findall(self.attrs):
            value = "".join(values).lower()
            if name.lower() == "role":
                if value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog"):
                    return True
            elif self.tag not in HEADINGS and any(map(_hint, value.split())):
                return True
        return False


def parse(text: str) -> Node:
    """Tree of elements and strings; unclosed elements end where HTML ends them."""
    root = Node("#")
    stack, at, n = [root], 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            stack[-1].parts.append(text[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(text[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            names = [x.tag for x in stack]
            if tag in names[1:]:
                del stack[len(names) - 1 - names[::-1].index(tag):]
            continue
        if tag in BLOCKS:
            _close(stack, {"p"}, {"article", "main", "div", "section", "td", "th", "li", "blockquote", "body", "button"})
        if tag in CLOSES:
            _close(stack, CLOSES[tag], HOLDS[tag])
        node = Node(tag, m.group(3))
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
            node.parts.append(text[at:end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m.group(3).endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], tags: set[str], scope: set[str]) -> None:
    """End the innermost open element of ``tags`` unless a ``scope`` element is nearer."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in scope:
            return


def _walk(root: Node):
    """Every element, children before parents (no recursion: pages nest deeply)."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node)]
    return reversed(order)


def hash_subtrees(root: Node, host: str) -> None:
    for node in _walk(root):
        h = xxhash.xxh3_64(f"{host}\0{node.tag}\0{node.attrs.strip()}")
        for p in node.parts:
            h.update(p.hash.to_bytes(8, "little") if isinstance(p, Node) else " ".join(p.split()).encode())
        node.hash = h.intdigest()


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") and not node.hinted()


def _holders(root: Node) -> set[int]:
    """Elements (by id()) that are or hold an article."""
    holds = set()
    for node in _walk(root):
        if _is_article(node) or any(isinstance(p, Node) and id(p) in holds for p in node.parts):
            holds.add(id(node))
    return holds


def outside(root: Node) -> set[int]:
    """Hashes of the block subtrees that neither hold an article nor lie in one."""
    found, holds = set(), _holders(root)
    todo = [root]
    while todo:
        node = todo.pop()
        if _is_article(node):
            continue
        if id(node) not in holds and node.tag in BLOCKS and node.tag not in ("html", "body"):
            found.add(node.hash)
        todo += [p for p in node.parts if isinstance(p, Node)]
    return found


def content(root: Node, host: str) -> int:
    """Hash of the page's text outside the elements dropped by their tag."""
    h, todo = xxhash.xxh3_64(host), [root]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            h.update((" ".join(item.split()) + " ").encode() if item.strip() else b"")
        elif item.tag not in DROPPED:
            todo += reversed(item.parts)
    return h.intdigest()


def blocks(root: Node, template) -> list[str]:
    """Article blocks in page order once template and non-article subtrees are gone."""
    holds = _holders(root)
    articles, mains, body, todo = [], [], root, [root]
    while todo:
        node = todo.pop()
        if node.tag == "body":
            body = node
        if (node.tag in DROPPED and not (node.tag == "form" and id(node) in holds)) or (
                node is not root and node.hinted() and node.tag not in ("html", "body")):
            continue
        if not _is_article(node) and node.tag not in ("#", "html", "body") and template(node.hash):
            continue
        if _is_article(node):
            (articles if node.tag == "article" else mains).append(node)
            if node.tag == "article":
                continue
        todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
    roots = articles or mains or [body]
    inside = bool(articles or mains)
    out, line = [], []

    def flush():
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()
    for top in roots:
        work = [(top, False, False)]
        while work:
            item, done, titles = work.pop()
            if isinstance(item, str):
                if not titles:
                    line.append(item)
                continue
            if done:
                flush()
                continue
            held = not articles and id(item) in holds and item.tag not in TEASERS
            if item is not top and not held and (item.tag in DROPPED or item.hinted()
                                                 or (not inside and template(item.hash))):
                if item.tag in BLOCKS:
                    flush()
                continue
            if item.tag in BLOCKS:
                flush()
                work.append((item, True, titles))
            elif item.tag in ("br", "td", "th", "img"):
                line.append(" ")
            if item.tag == "header" and item is not top:     # of a header only its headings are text
                titles = True
            elif item.tag in HEADINGS:
                titles = False
            work += [(p, False, titles) for p in reversed(item.parts)]
        flush()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower()


def _templates(pages: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """Hashes (host included) of the subtrees that recur on many distinct pages of a host.

    Rows (host, subtree, page) are made distinct before they are counted; subtree 0
    stands for the page itself and counts the host's pages."""
    import pyarrow as pa

    def found(batches):
        for batch in batches:
            urls, texts, out, sizes, keys = batch.column(0).to_pylist(), batch.column(1), [], [], []
            for k, url in enumerate(urls):
                host, root = host_of(url), parse(texts[k].as_py() or "")
                hash_subtrees(root, host)
                mine = [0, *(outside(root) - {0})]
                out += mine
                sizes.append(len(mine))
                keys.append((xxhash.xxh3_64_intdigest(host), content(root, host)))
            keys = np.repeat(np.array(keys, dtype=np.uint64).reshape(-1, 2), np.array(sizes, dtype=np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (
                keys[:, 0], np.array(out, dtype=np.uint64), keys[:, 1])], ["host", "subtree", "page"])
    rows = pages.select("url", "html").mapInArrow(found, "host long, subtree long, page long").distinct()
    counts = saved(rows.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages")).where(
        (F.col("subtree") == 0) | (F.col("pages") >= min_pages)), "template-counts")
    hosts = counts.where("subtree = 0").select("host", F.col("pages").alias("of"))
    return counts.where("subtree <> 0").join(hosts, "host").where(F.col("pages") >= F.lit(min_share) * F.col("of"))


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_TEMPLATES,
            min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks."""
    import pyarrow as pa
    spark = df.sparkSession
    pages = df.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                      F.col(f"`{html}`").cast("string").alias("html"))
    templates = saved(_templates(pages, min_pages, min_share).select("subtree"), "templates")
    if templates.count() <= broadcast_rows:
        known = spark.sparkContext.broadcast(np.sort(templates.toPandas()["subtree"].to_numpy().view(np.uint64)))
        pages = pages.withColumn("own", F.lit(None).cast("array<long>"))
    else:
        known = None
        pages = _with_own_templates(pages, templates)

    def texts(batches):
        table = set(known.value.tolist()) if known else None
        for batch in batches:
            out, counts = [], []
            for k, one in enumerate(batch.column(1).to_pylist()):
                own = table if table is not None else {x % 2 ** 64 for x in batch.column(3)[k].as_py() or ()}
                root = parse(batch.column(2)[k].as_py() or "")
                hash_subtrees(root, host_of(one))
                found = blocks(root, own.__contains__)
                out.append("\n".join(found))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()),
                 pa.array([len(t) for t in out], pa.int64()), pa.array(counts, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks"])
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long, n_blocks long")


def _with_own_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Each page with the template hashes found on it (a page bounds the list)."""
    import pyarrow as pa
    key = F.xxhash64("url", "html")

    def listed(batches):
        for batch in batches:
            keys, found = [], []
            for k, one in enumerate(batch.column(1).to_pylist()):
                root = parse(batch.column(2)[k].as_py() or "")
                hash_subtrees(root, host_of(one))
                mine = outside(root)
                found += mine
                keys += [batch.column(0)[k].as_py()] * len(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["key", "subtree"])
    own = (pages.select(key.alias("key"), "url", "html").mapInArrow(listed, "key long, subtree long")
           .join(templates, "subtree", "left_semi").groupBy("key").agg(F.collect_set("subtree").alias("own")))
    return pages.withColumn("key", key).join(own, "key", "left").drop("key")
