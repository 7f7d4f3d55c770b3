"""Main text of web pages by a site style tree.

The trees of a host's pages are merged: nodes with equal paths of element styles are one
style node. Its presentation importance is the entropy of the sequences of child styles
that its pages show, its content importance the entropy of the texts that its pages hold
below it. What a site repeats (bars, notices, adverts) comes out low and is removed from
each page; what differs page by page is its content.

Entropy needs several pages, and some furniture differs from page to page by design (a
menu of related links, reader comments). So the importance of a node also has a prior by
its HTML meaning: furniture elements and role names have none, and the node that a page
itself marks as its article or main part is never removed for being repeated, though
nodes below it are. What stands outside such a node is kept only if its measured
importance is not low and it holds more text than the marked part, a mere teaser then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_rows
from quillspark.llm.siteparse import Node, blocks, parse
from quillspark.session import durable

#: Different pages of a host from which entropies count.
MIN_PAGES = 4
#: Importance under which a style node is furniture.
LOW = 0.3
#: Judged style nodes (some 60 bytes each in a Python worker) up to which every task holds them all.
BROADCAST_NODES = 400_000
#: The share of presentation in an importance.
PRESENTATION = 0.2

#: Elements that are no part of an article.
FURNITURE = frozenset(
    "nav footer aside form script style noscript template head title iframe object embed applet canvas svg math menu dialog button input select option textarea label "
    "fieldset datalist audio video map noembed noframes xmp plaintext search rp rt".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|adbox|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|"
    r"signup|sidebar|side|rail|widgets?|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|respond|related|recommend(?:ed|ations)?|"
    r"share|sharing|social|pagination|pager|tags|skip|login|search|legal|copyright)(?:$|[\s_-])"
)
_MAIN = frozenset(("article", "main"))


def is_furniture(node: Node) -> bool:
    """The prior: no importance by the element's meaning."""
    attrs = node.attrs
    if node.name in FURNITURE or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if attrs.get("role", "").lower() in _ROLES:
        return True
    if node.name == "header":  # a page's header, not that of the article
        above = node.parent
        while above is not None and above.name not in _MAIN:
            above = above.parent
        return above is None
    if node.name in ("body", "html") or node.name in _MAIN:
        return False
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip().lower()
    return bool(named and _NAMES.search(named)) or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def host_of(url: str | None) -> str:
    """The lower-case host of a URL; the empty string where there is none."""
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def path_name(above: int, style: str) -> int:
    """A style path's name from that of the path above it, so that deep pages need no long paths."""
    return _hash(f"{above:x}/{style}")


def _visit(root: Node) -> Iterator[tuple[Node, int]]:
    """Elements with the names of their style paths, without what the prior removes."""
    stack = [(root, 0)]
    while stack:
        node, above = stack.pop()
        path = path_name(above, node.style)
        if node.parent is not None:
            yield node, path
        stack += [(x, path) for x in node.items if not isinstance(x, str) and not is_furniture(x)]


def _digests(root: Node) -> dict[int, int]:
    """A digest of the text below each element, without what the prior removes; 0 for none."""
    out: dict[int, int] = {}
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if ready:
            parts = [" ".join(x.split()) if isinstance(x, str) else format(out.get(id(x), 0), "x") for x in node.items]
            parts = [x for x in parts if x not in ("", "0")]
            out[id(node)] = _hash("\n".join(parts)) if parts else 0
        else:
            stack.append((node, True))
            stack += [(x, False) for x in node.items if not isinstance(x, str) and not is_furniture(x)]
    return out


def style_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``host, page, node, shape, content`` hashes of each style node of each page."""
    for url, text in rows:
        root = parse(text or "")
        digests, host = _digests(root), _hash(host_of(url))
        for node, path in _visit(root):
            if digests[id(node)] and node.name not in _MAIN:
                shape = " ".join(x.style for x in node.items if not isinstance(x, str))
                yield host, digests[id(root)], path, _hash(shape), digests[id(node)]


def importance(pages: DataFrame) -> DataFrame:
    """``host, node, n_pages, importance`` of the style nodes of ``url, html`` rows.

    Only hashes are grouped, first to counts of equal shapes and contents and then to
    entropies, so a host with any share of all pages is summed map-side. Equal pages of
    a host count once: copies of an article do not make it furniture.
    """
    rows = map_rows(pages.select("url", "html"), style_rows, "host long, page long, node long, shape long, content long").distinct()
    spread = []
    for column in ("shape", "content"):
        counts = rows.groupBy("host", "node", column).agg(F.count("*").alias("c"))
        spread.append(counts.groupBy("host", "node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s")).select("host", "node", F.col("n").alias(f"n_{column}"), F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0).alias(column)))
    both = spread[0].join(spread[1], ["host", "node"])
    return both.select("host", "node", F.col("n_content").alias("n_pages"), (PRESENTATION * F.col("shape") + (1 - PRESENTATION) * F.col("content")).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """One row ``page_id, url, text`` for each row of ``pages``.

    A null html has the empty text; a null url is a host of its own (the empty one);
    repeated rows get equal texts; an empty table gives no rows; other columns are not
    read. Up to ``broadcast_nodes`` judged style nodes are sent to every task; the nodes of
    more hosts are joined to the pages by URL, so that a host of any size stays spread.
    """
    own = pages.select(F.col(id_col).alias("page_id"), "url", "html")
    measured = importance(own).where(F.col("n_pages") >= MIN_PAGES)
    is_low = F.col("importance") < LOW
    furniture = durable(measured.groupBy("host").agg(F.collect_list(F.when(is_low, F.col("node"))).alias("low"), F.collect_list(F.when(~is_low, F.col("node"))).alias("high")))
    nodes = furniture.agg(F.sum(F.size("low") + F.size("high") + 4)).first()[0] or 0
    ddl = "page_id long, url string, text string"
    if nodes <= broadcast_nodes:
        held = pages.sparkSession.sparkContext.broadcast({r["host"]: (frozenset(r["low"]), frozenset(r["high"])) for r in furniture.collect()})

        def known(rows: Iterator[tuple]) -> Iterator[tuple]:
            for page_id, url, text in rows:
                yield page_id, url, main_text(text or "", *held.value.get(_hash(host_of(url)), (frozenset(), frozenset())))

        return map_rows(own, known, ddl)
    hosts = map_rows(own.select("url").distinct(), lambda rows: ((url, _hash(host_of(url))) for (url,) in rows), "url string, host long")
    marked = hosts.join(furniture, "host").select(F.col("url").alias("__url"), "low", "high")
    with_low = own.join(marked, own["url"].eqNullSafe(marked["__url"]), "left").select("page_id", "url", "html", "low", "high")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for page_id, url, text, low, high in rows:
            yield page_id, url, main_text(text or "", frozenset(low or ()), frozenset(high or ()))

    return map_rows(with_low, run, ddl)


def main_text(text: str, low: frozenset[int] = frozenset(), high: frozenset[int] = frozenset()) -> str:
    """The blocks of a page that are neither furniture nor of low importance.

    On a page with a marked main part, blocks outside it count only if they are of
    measured (``high``) importance and hold more text than that part.
    """
    root = parse(text)
    gone: set[int] = set()
    if low:
        holding = _above_main(root)
        gone = {id(node) for node, path in _visit(root) if node.name not in _MAIN and path in low and id(node) not in holding}
    found = blocks(root, lambda node: is_furniture(node) or id(node) in gone, _MAIN)
    inside = [b.inside for b in found]
    if any(inside) and not all(inside):
        weighty = {id(node) for node, path in _visit(root) if path in high} if high else set()
        outside = [not main and id(b.node) in weighty for b, main in zip(found, inside, strict=True)]
        if sum(len(b.text) for b, x in zip(found, outside, strict=True) if x) > sum(len(b.text) for b, x in zip(found, inside, strict=True) if x):
            inside = [a or b for a, b in zip(inside, outside, strict=True)]
        found = [b for b, x in zip(found, inside, strict=True) if x]
    return "\n\n".join(b.text for b in found)


def _above_main(root: Node) -> set[int]:
    """Elements that hold a main part somewhere below."""
    out: set[int] = set()
    stack = [root]
    while stack:
        node = stack.pop()
        above = node.parent if node.name in _MAIN else None
        while above is not None and id(above) not in out:
            out.add(id(above))
            above = above.parent
        stack += [x for x in node.items if not isinstance(x, str)]
    return out
