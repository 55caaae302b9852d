"""Main text of web pages by site style trees.

The DOMs of one host are merged: a style node is an element's path of labels (tag, class, id)
with the sequence of its children's labels, a content node is a block of text under its path.
Over the m pages of a host, a node that k pages hold has importance ``1 - log k / log m``: one
that all pages share has the largest entropy and says nothing about any page, one of its own
has importance one. A branch's importance mixes that of its presentation with that of its
content, and is weighed by a prior: elements whose tag, role or name stands for a menu, footer,
advert and so on weigh little, those whose name only holds such a word among others somewhat
less than others. Branches of low weighed importance are removed from each page. Hosts with too
few pages for a tree have the prior alone. What stands in an article without such a mark stays,
however many pages hold it.

Only nodes of low importance travel back to the pages, and those are few: with blocks of which
at most B stand on a page, at most ``B * m ** (1 - t)`` nodes of a host are held by ``m ** t`` pages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from citelode.llm.common import stage

#: Branches, and blocks outside an article, with less importance than this are removed.
BRANCH = 0.4
#: Priors of branches that are never content, that their tag or name marks, and whose name only
#: holds a marking word beside others; and the importance of branches that no tree knows.
NEVER, MARKED, HINTED, UNKNOWN = 0.0, 0.25, 0.45, 0.9
#: A host with fewer pages says nothing, nor do nodes on fewer pages.
MIN_PAGES, MIN_SHARED = 4, 3
DAMP = 0.9
SALTS = 32

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?/][^>]*>|</?[a-zA-Z][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul head".split()
)
#: What an opening tag closes, up to the nearest of the second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NOISE_TAGS = frozenset("nav footer aside form button select noscript template svg object canvas dialog menu head audio video map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tooltip".split())
NOISE_NAMES = frozenset(
    "nav navbar navigation menu sidebar sidenav aside footer ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations breadcrumb breadcrumbs pagination pager comment comments disqus respond widget toolbar copyright disclaimer masthead topbar offcanvas".split()
)
#: Words that say nothing beside a marking one.
PLAIN_NAMES = frozenset(
    "area bar block bottom box button buttons card cell col column container content group head holder icon icons inline inner item items label left line link links list main "
    "panel page right row section site slot small text title top unit wrap wrapper info warning error success primary secondary global post the".split()
)
COMMENT_NAMES = frozenset("comment comments disqus respond".split())
HEADER_NAMES = frozenset("header masthead topbar".split())


class Node:
    """An element, with the order of what stands in it."""

    __slots__ = ("tag", "parent", "path", "inside", "prior", "named", "around", "holds", "labels")

    def __init__(self, tag: str, parent: Node | None, label: str, prior: float, named: bool, article: bool):
        self.tag, self.parent, self.prior, self.named, self.around = tag, parent, prior, named, False
        self.path = xxhash.xxh3_64_intdigest(f"{parent.path if parent else 0}>{label}")
        self.inside = article or bool(parent and parent.inside)
        self.holds: list[Node | Block] = []
        self.labels: list[str] = []
        if parent:
            parent.holds.append(self)
            parent.labels.append(label)

    def style(self) -> int:
        """The style node: this path with these children."""
        return _signed(xxhash.xxh3_64_intdigest(f"{self.path}[{','.join(dict.fromkeys(self.labels))}]"))


class Block:
    """A run of text without a block boundary."""

    __slots__ = ("text", "node", "content")

    def __init__(self, text: str, node: Node):
        self.text, self.node = text, node
        self.content = _signed(xxhash.xxh3_64_intdigest(f"{node.path}|{text}"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _marks(names: list[str]) -> float:
    """The prior of an element by the words of one class or id."""
    if not NOISE_NAMES.intersection(names):
        return 1.0
    return MARKED if all(n in NOISE_NAMES or n in PLAIN_NAMES for n in names) else HINTED


def _prior(tag: str, attrs: dict[str, str], parent: Node | None) -> tuple[float, bool]:
    """An element's prior, and whether its name or its being a header gave it.

    Names count on block elements alone: a word inside a sentence is no branch.
    """
    if tag in ("html", "body", "main"):
        return 1.0, False
    words = [[w.lower() for w in _NAME.findall(x)] for x in (*attrs.get("class", "").split(), attrs.get("id", ""))]
    if tag in BLOCKS and any(COMMENT_NAMES.intersection(w) and _marks(w) == MARKED for w in words):
        return NEVER, False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return NEVER, False
    if tag in NOISE_TAGS or attrs.get("role", "").lower() in NOISE_ROLES:
        return MARKED, False
    if tag == "article" or tag not in BLOCKS:
        return 1.0, False
    inside = parent is not None and parent.inside
    if not inside and (tag == "header" or any(HEADER_NAMES.intersection(w) for w in words)):
        return MARKED, True
    return min(map(_marks, words)), True


def parse(html: str) -> Node:
    """The tree of a page. Open and misnested tags are closed as browsers do for text."""
    root = Node("", None, "", 1.0, False, False)
    here, text, at = root, [], 0

    def end_block() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                here.holds.append(Block(joined, here))
                here.labels.append("#")

    def close(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        nonlocal here
        node = here
        while node.parent and node.tag not in tags and node.tag not in stop:
            node = node.parent
        if node.parent and node.tag in tags:
            end_block()
            here = node.parent

    end = len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            text.append(unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                text.append(" ")
            elif tag in BLOCKS or tag in NOISE_TAGS:
                node = here
                while node.parent and node.tag != tag:
                    node = node.parent
                end_block()
                if node.parent:
                    here = node.parent
            elif tag in ("td", "th"):
                text.append(" ")
            else:
                close({tag}, BLOCKS) if here.tag == tag else None
            continue
        if tag in RAW:
            gone = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            at = gone.end() if gone else end
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in ("td", "th"):
            text.append(" ")
            continue
        if tag not in BLOCKS and tag not in NOISE_TAGS and "=" not in m[3]:
            continue  # plain inline markup only carries text
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m[3])}
        prior, named = _prior(tag, attrs, here)
        noise = prior < HINTED
        if tag not in BLOCKS and not noise:
            continue
        if tag in BLOCKS:
            end_block()
            close({"p"}, {"article", "section", "div", "td", "li", "body", "button", "object"})
        elif noise:
            end_block()
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ("article", "main") and not noise:
            above = here
            while above:  # what holds the article is no noise itself
                above.around = True
                if above.named:
                    above.prior = 1.0
                above = above.parent
        label = tag + "".join(f".{re.sub(r'[0-9]+', '0', n)}" for n in sorted(attrs.get("class", "").split())) + (f"#{re.sub(r'[0-9]+', '0', attrs['id'])}" if attrs.get("id") else "")
        here = Node(tag, here, label, prior, named, tag == "article" and not noise)
        if m[3].rstrip().endswith("/") and tag not in BLOCKS:
            here = here.parent
    end_block()
    return root


def nodes_of(root: Node) -> set[int]:
    """The style and content nodes of a page."""
    out: set[int] = set()
    stack = [root]
    while stack:
        node = stack.pop()
        out.add(node.style())
        for x in node.holds:
            if isinstance(x, Node):
                stack.append(x)
            else:
                out.add(x.content)
    return out


def _in_order(root: Node) -> list[Node]:
    """The elements of a page, each before what it holds."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in reversed(node.holds) if isinstance(x, Node)]
    return out


def importances(root: Node, low: dict[int, float]) -> dict[int, float]:
    """The importance of every branch, by ``id``: its presentation's, mixed with that of its content by size."""
    out, sums = {}, {}
    for node in reversed(_in_order(root)):
        total, weight = 0.0, 0
        for x in node.holds:
            t, w = sums[id(x)] if isinstance(x, Node) else (low.get(x.content, 1.0) * len(x.text), len(x.text))
            total, weight = total + t, weight + w
        value = 1.0
        if weight:
            mix = DAMP ** min(len(node.holds), 8)
            value = (1 - mix) * low.get(node.style(), 1.0) + mix * total / weight
        out[id(node)], sums[id(node)] = value, (value * weight, weight)
    return out


def _kept(root: Node, low: dict[int, float]) -> list[Block]:
    """Blocks outside removed branches: of the articles, else of main, else all."""
    value = importances(root, low) if low else {}
    found: dict[str, list[Block]] = {"article": [], "main": [], "": []}
    stack: list[tuple[Node | Block, str]] = [(root, "")]
    while stack:
        x, place = stack.pop()
        if isinstance(x, Block):
            if x.node.inside or low.get(x.content, 1.0) >= BRANCH:
                found[""].append(x)
                if place:
                    found["main"].append(x)
                if place == "article":
                    found["article"].append(x)
            continue
        spared = x.prior == 1.0 and (x.inside or x.around or x.tag in ("", "html", "body", "main"))
        if not spared and value.get(id(x), UNKNOWN) * x.prior < BRANCH:
            continue
        place = "article" if x.inside else place or ("main" if x.tag == "main" else "")
        stack += [(y, place) for y in reversed(x.holds)]
    return found["article"] or found["main"] or found[""]


def main_blocks(root: Node, low: dict[int, float]) -> list[str]:
    """The main text's blocks, given the importance of the host's low nodes (none: no tree).

    A page of which nothing is left holds only what others hold: it is a copy, and the prior
    alone decides.
    """
    return [b.text for b in _kept(root, low) or _kept(root, {})]


def host_of(url: str) -> Column:
    """Lower-case host of an address; empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``df`` without ``html``, with ``text`` (empty if there is none) and ``n_chars``.

    Character references are decoded, white space inside a block is one space, blocks are
    trimmed and joined in page order by two line feeds. Null html gives the empty text; rows
    with a null url are one host. Repeated rows are extracted alike. ``df`` must not hold the
    new names, nor ``__host``, ``__salt`` and ``__low``.
    """
    df = df.drop(*({"text", "n_chars"} - {html, url}))
    pages = df.withColumn("__host", host_of(url))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(held), 200_000):
                some = list(held.items())[at : at + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k, _ in some], pa.string()), pa.array([k[1] for k, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64())], names=["host", "node", "n"]
                )
            held.clear()

        for batch in batches:
            for host, raw in zip(batch.column("__host").to_pylist(), batch.column("__html"), strict=True):
                for node in [*(nodes_of(parse(raw.as_py())) if raw.is_valid else ()), 0]:
                    held[host, node] = held.get((host, node), 0) + 1
            if len(held) > 400_000:
                yield from flush()
        yield from flush()

    counts = pages.select("__host", F.col(html).alias("__html")).mapInArrow(count, "host string, node long, n long").groupBy("host", "node").agg(F.sum("n").alias("k")).where(F.col("k") >= MIN_SHARED)
    counts = stage(counts, "site-nodes")  # read twice below, and small
    # Node 0 stands for every page of its host; it meets the others over salts.
    salt = F.pmod(F.col("node"), F.lit(SALTS)).cast("int")
    many = counts.where(f"node = 0 and k >= {MIN_PAGES}").select("host", F.col("k").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rated = counts.where("node <> 0").withColumn("salt", salt).join(many, ["host", "salt"]).withColumn("imp", 1 - F.log(F.col("k")) / F.log(F.col("m")))
    low = rated.where(F.col("imp") < BRANCH).groupBy("host").agg(F.collect_list(F.struct("node", "imp")).alias("__low"))
    low = low.select(F.col("host").alias("__host"), "__low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [packer.compress(x.as_py().encode("utf-8", "surrogatepass")) if x.is_valid else None for x in batch.column(html)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()) if c == html else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    small = pages.withColumn("__salt", F.pmod(F.xxhash64(html), F.lit(SALTS)).cast("int"))
    squeezed = StructType([StructField(f.name, BinaryType() if f.name == html else f.dataType) for f in small.schema.fields])
    joined = small.mapInArrow(squeeze, squeezed).join(low, ["__host", "__salt"], "left")

    gone = {html, "text", "n_chars"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for raw, lows in zip(batch.column(html), batch.column("__low"), strict=True):
                known = {int(x["node"]): float(x["imp"]) for x in lows.as_py()} if lows.is_valid else {}
                out.append("\n\n".join(main_blocks(parse(unpacker.decompress(raw.as_py()).decode("utf-8", "surrogatepass")), known)) if raw.is_valid else "")
            kept = [c for c in batch.schema.names if c not in gone and not c.startswith("__")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=[*kept, "text", "n_chars"])

    fields = [f for f in joined.schema.fields if f.name not in gone and not f.name.startswith("__")]
    return joined.mapInArrow(read, StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
