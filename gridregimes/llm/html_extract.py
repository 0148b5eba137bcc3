"""Main text of web pages by equivalence classes of tokens across the pages of a host.

A page's tokens are its tags and the words of its text, each told apart by the path of elements it stands in. Tokens
that occur on the same pages of a host, each equally often on all of them, are an equivalence class. Pages are compared
by order-free sums of hashes, so classes come from one aggregation with partial sums and no host's pages are ever
gathered. Tokens that share all pages share those that a task has seen of them, so a task hands on only the words that
agree with some tag on its own pages. A class is valid if an element opens and closes once in it, on three pages at least
(``SUPPORT``). A word is the template's if it is of a valid class and stands within such an element of it; so classes of
pages that lack parts of the template nest in it, each with words of its own.

The template's elements cut a page into slots. How much varies in each is known from the same sums: the words within it
on the pages that have it, less the template's. An element that holds ``SHARE`` of what varies on its pages is the place
of the main text, and all outside it is left out, whatever it is called. A block of words that are all the template's is
no slot. Names break ties only: among nested places one named article or main is taken before the innermost; inside, and
where no place stands out, what stands in menus, headers, footers, sidebars, notices, adverts, forms and comments by its
tag or class is left out though it varies. Words in an article or main element are kept though they recur, unless their
class names boilerplate too.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, Scratch, release

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0  -     　]+")

# Element names of HTML by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_DROPPED = frozenset("head script style noscript template textarea title xmp iframe noembed noframes svg math nav aside form button select option footer dialog menu object audio video canvas".split())
_BLOCK_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"div", "article", "section", "main", "td", "li", "blockquote", "body"}}
_BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo|promotion|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|header|masthead|cookies?|consent|notice|notices|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|comment-list|disqus|replies|reply|respond|widget|toolbar|pagination|pager|skip|copyright|disclaimer|gdpr)(?:$|[\s_-]|\d)", re.I)
#: Pages that a class must be on; on fewer, what pages share is no evidence of a template.
SUPPORT = 3
#: What an element has of all that varies on its pages to be the place of the main text.
SHARE = 0.7
#: Occurrences of tokens that a task gathers before it hands on the partial sums: some 30 MB.
HELD = 500_000
#: Elements nested more deeply share the path of this level, so that paths stay as short as pages are long.
DEEPEST = 60
#: Hosts whose templates a task remembers.
HOSTS = 256
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


@lru_cache(1 << 18)
def _hash(word: str) -> int:
    """The same 64 bits in every process."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_OPEN, _CLOSE, _WORD = 0, 1, 2
_TAGS = (_hash("<"), _hash("</"))


class Node:
    """An open element: name, key and hash of its path, depth, whether it is left out, is of a main element, and of boilerplate in one by its class."""

    __slots__ = ("name", "key", "at", "depth", "drop", "main", "named")

    def __init__(self, name: str, key: str, depth: int, drop: bool, main: bool, named: bool):
        self.name, self.key, self.depth, self.drop, self.main, self.named = name, key, depth, drop, main, named
        self.at = _hash(f"path {key}")


def _element(name: str, attrs: str, parent: Node) -> Node:
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs.strip() else {}
    label = " ".join(found.get(k, "") for k in ("class", "id"))
    role = found.get("role", "").lower()
    page = name in ("html", "body")
    main = name in ("article", "main") or role == "main" or (not page and "article" in label.lower().split())
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    header = name == "header" and not parent.main
    named = not main and not page and bool(_BOILERPLATE.search(label))
    drop = parent.drop or name in _DROPPED or header or hidden or role in _ROLES or (named and not parent.main)
    mark = re.sub(r"\d+", "#", label)
    mark = f".{mark}" if 0 < len(mark) <= 64 else mark and f".{_hash(mark):x}"
    key = f"{parent.key}/{name}{mark}" if parent.depth < DEEPEST else parent.key
    return Node(name, key, parent.depth + 1, drop, main or parent.main, named or parent.named)


def parse(page: str) -> Iterator[tuple[str, Node, str]]:
    """("open" | "close" | "break" | "text", element, text) in page order; inline elements only pass their text.

    Elements that HTML closes by itself (p, li, cells) are closed here, as is a page that breaks off.
    """
    root = Node("", "", 0, False, False, False)
    stack, at = [root], 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        name = (m["tag"] or m["tag2"] or "").lower()
        if m["text"] is not None or m["cdata"] is not None:
            yield "text", stack[-1], html.unescape(m["text"]) if m["text"] is not None else m["cdata"]
            continue
        if not name:
            continue
        if m["close"] or m["close2"]:
            if name in _INLINE:
                continue
            level = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if level:
                while len(stack) > level:
                    yield "close", stack.pop(), ""
            else:
                yield "break", stack[-1], ""
            continue
        if name in _VOID:
            if name not in _INLINE:
                yield "break", stack[-1], ""
            continue
        if name in _INLINE:
            continue
        ends = _SIBLINGS.get(name) or ({"p"} if name in _BLOCK_ENDS_P else set())
        stops = _STOPS.get(name, _STOPS["p"])
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in ends:
                while len(stack) > i:
                    yield "close", stack.pop(), ""
                break
            if stack[i].name in stops:
                break
        node = _element(name, m["attrs"] or "", stack[-1])
        stack.append(node)
        yield "open", node, ""
        if name in _RAW and not (m["attrs"] or "").rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)  # what it holds is not markup
    while len(stack) > 1:
        yield "close", stack.pop(), ""


def tokens_of(page: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, dict[int, tuple[int, Node]]]:
    """(token, how often, element's hash, words within it if it opens an element) of each token in the page, all words of
    the page, and (side, element) of its tags."""
    tags: dict[int, tuple[int, Node]] = {}
    found, ats, inside, words, sizes, places, open_, total = [], [], [], [], [], [], [], 0
    for kind, node, text in parse(page or ""):
        if kind == "text":
            if own := text.split():
                words += own
                sizes.append(len(own))
                places.append(node.at)
                total += len(own)
        elif kind != "break":
            side = _CLOSE if kind == "close" else _OPEN
            token = node.at ^ _TAGS[side]
            tags[token] = side, node
            if side == _OPEN:
                open_.append((len(found), total))
                inside.append(0)
            else:
                begun, before = open_.pop()
                inside[begun] = total - before
                inside.append(0)
            found.append(token)
            ats.append(node.at)
    within = np.repeat(np.array(places, np.int64), sizes)
    token, first, n = np.unique(np.r_[np.array(found, np.int64), np.fromiter(map(_hash, words), np.int64, len(words)) ^ within], return_index=True, return_counts=True)
    held = np.r_[np.array(inside, np.int64), np.zeros(len(words), np.int64)][first]
    return token, n, np.r_[np.array(ats, np.int64), within][first], held, total, tags


def partial_sums(held: list[tuple], tags: dict[int, tuple[int, Node]]) -> pa.RecordBatch:
    """Sums over pages of the tags, and of the words that are on the same pages, of those held, as one of their host's tags."""
    host, token, at, n, a, b, inside, page = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((token, host))
    host, token, at, n, a, b, inside, page = (x[order] for x in (host, token, at, n, a, b, inside, page))
    starts = np.flatnonzero(np.r_[True, (host[1:] != host[:-1]) | (token[1:] != token[:-1])])
    host, token, at = host[starts], token[starts], at[starts]
    support = np.diff(np.r_[starts, len(n)])
    least, most = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
    a, b, inside, page = (np.add.reduceat(x, starts) for x in (a, b, inside, page))
    is_tag = np.isin(token, np.fromiter(tags, np.int64, len(tags)))
    vector = np.stack([host, a, b, support], axis=1).astype("<i8").view("V32").ravel()
    keep = np.flatnonzero(is_tag | ((least == most) & np.isin(vector, vector[is_tag & (most == 1)])))
    tag = [tags.get(t) if k else None for t, k in zip(token[keep].tolist(), is_tag[keep].tolist(), strict=True)]
    longs = [pa.array(x[keep].astype(np.int64)) for x in (host, token, at, a, b, support, least, most, inside, page)]
    kind, path = pa.array([_WORD if x is None else x[0] for x in tag], pa.int32()), pa.array([None if x is None else x[1].key for x in tag], pa.string())
    return pa.RecordBatch.from_arrays([*longs, kind, path], ["host", "token", "at", "a", "b", "support", "least", "most", "inside", "page", "kind", "path"])


def blocks(page: str | None, template: frozenset[int], places: frozenset[int] = frozenset()) -> list[str]:
    """The page's main text, block by block. ``template``: the words of its host's template, as tokens; ``places``: the
    elements of the template that hold most of what varies.

    Of the places on the page the first that is named article or main is read, else the innermost; a page whose place is
    empty, and one without places, is read by names: its own main elements if the words of their slots are as many as
    those of all other slots, else all slots, so that a teaser or card in an article element does not stand for the page.
    A page without slots is read whole.
    """
    out, held, open_, seen = [], [], [], []

    def flush() -> None:
        if line := _SPACE.sub(" ", "".join(text for _, text in held)).strip(" "):
            words = [(node.at, text.split()) for node, text in held]
            slot = any(at ^ _hash(word) not in template for at, own in words for word in own)
            if slot or not all(node.named for node, text in held if text.strip()):
                out.append((line, any(node.main for node, _ in held), sum(len(own) for _, own in words) if slot else 0, frozenset(open_)))
        held.clear()

    for kind, node, text in parse(page or ""):
        if kind != "text":
            flush()
            if node.at in places and kind == "open":
                open_.append(node.at)
                seen.append((node.at, node.main))
            elif node.at in places and kind == "close":
                open_.pop()
        elif not node.drop:
            held.append((node, text))
    flush()
    place = next((at for at, named in seen if named), seen[-1][0] if seen else None)
    if place is not None and (own := [line for line, _, _, within in out if place in within]):
        return own
    within = sum(n for _, main, n, _ in out if main)
    if any(main for _, main, _, _ in out) and within >= sum(n for _, main, n, _ in out if not main):
        return [line for line, main, _, _ in out if main]
    return [line for line, _, n, _ in out if n] or [line for line, _, _, _ in out]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, words, places): hash of each host, the words of its template as tokens, and the elements that hold most of
    what varies.

    A class is told by the sums of two hashes of its pages. Tags open and close once on each page of a valid class; its
    words occur equally often on each, and within an element of the class.
    """
    rows = pages.select(F.xxhash64(host_of(F.col(url_col))).alias("host"), F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("page"), F.col(html_col).alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, tags, size = [], {}, 0
        for batch in batches:
            for h, p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                token, n, at, inside, total, own = tokens_of(x.as_py())
                if len(token):
                    tags |= own
                    held.append((np.full(len(token), h), token, at, n, np.full(len(token), p & 0x7FFFFFFF), np.full(len(token), p >> 32 & 0x7FFFFFFF), inside, np.full(len(token), total)))
                    size += len(token)
                if size > HELD:
                    yield partial_sums(held, tags)
                    held, tags, size = [], {}, 0
        if held:
            yield partial_sums(held, tags)

    tokens = rows.mapInArrow(count, "host long, token long, at long, a long, b long, support long, least long, most long, inside long, page long, kind int, path string")
    whole = [f(c).alias(c) for f, cs in ((F.sum, ("a", "b", "support", "inside", "page")), (F.min, ("least",)), (F.max, ("most",))) for c in cs]
    vectors = tokens.groupBy("host", "token", "kind", "at", "path").agg(*whole)
    vectors = scratch.write(vectors.where((F.col("support") >= SUPPORT) & ((F.col("least") == F.col("most")) | (F.col("kind") == _OPEN))), "vectors")
    paths = vectors.where(F.col("kind") == _OPEN).select("host", "at", F.concat("path", F.lit("/")).alias("place"))
    tags = vectors.where((F.col("kind") != _WORD) & (F.col("most") == 1))
    opened = F.col("kind") == _OPEN
    valid = tags.groupBy("host", "path", "at", "a", "b", "support").agg(F.count(F.lit(1)).alias("sides"), *[F.max(F.when(opened, F.col(c))).alias(c) for c in ("inside", "page")]).where("sides = 2")
    valid = valid.select(*[F.col(c).alias(f"of_{c}") for c in ("host", "path", "at", "a", "b", "support", "inside", "page")])
    same = [F.col(c) == F.col(f"of_{c}") for c in ("host", "a", "b", "support")]
    words = vectors.where(F.col("kind") == _WORD).select("host", "token", "at", "a", "b", "support", "least").join(paths, ["host", "at"])
    words = scratch.write(words.join(valid, [*same, F.col("place").startswith(F.concat("of_path", F.lit("/")))], "left_semi"), "words")
    found = words.groupBy("host").agg(F.collect_set("token").alias("words"))
    places = _places(valid, words).groupBy("host").agg(F.collect_set("of_at").alias("places"))
    empty = F.array().cast("array<long>")
    return found.join(places, "host", "full").select("host", F.coalesce("words", empty).alias("words"), F.coalesce("places", empty).alias("places"))


def _places(valid: DataFrame, words: DataFrame) -> DataFrame:
    """(host, of_at) of the elements with ``SHARE`` of what varies on their pages.

    On an element's pages the template's words are those of classes that are on as many pages or more.
    """
    steps = F.split("place", "/")  # begins and ends with an empty step
    ancestors = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    fixed = words.select("host", "support", "least", F.explode(ancestors).alias("path")).groupBy("host", "path", "support").agg(F.sum("least").alias("n"))
    fixed = fixed.select(F.col("host").alias("w_host"), F.col("path").alias("w_path"), F.col("support").alias("w_support"), "n")
    own = ["of_host", "of_at", "of_path", "of_support", "of_inside", "of_page"]

    def less(path: Column, name: str, df: DataFrame) -> DataFrame:
        met = df.join(fixed, (F.col("of_host") == F.col("w_host")) & (F.col("w_path") == path) & (F.col("w_support") >= F.col("of_support")), "left")
        return met.groupBy(*df.columns).agg((F.coalesce(F.sum("n"), F.lit(0)) * F.col("of_support")).alias(name))

    both = less(F.lit(""), "of_page_fixed", less(F.col("of_path"), "of_inside_fixed", valid.select(*own)))
    varies, of_all = F.col("of_inside") - F.col("of_inside_fixed"), F.col("of_page") - F.col("of_page_fixed")
    page = ~F.col("of_path").rlike("/(html|body)[^/]*$")
    return both.where(page & (of_all > 0) & (varies >= SHARE * of_all)).select(F.col("of_host").alias("host"), "of_at")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The rows and columns of ``pages`` and ``main_text`` (replaced if there): blocks joined by one newline, or empty.

    Null or empty html gives an empty text; a null url counts as a host of its own name, ''. Pages repeated with one
    id count as pages of their own. Nothing is cut: a page is read whole. An empty table gives none.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html_extract")
    found = scratch.write(templates(pages, scratch, id_col, url_col, html_col), "templates")
    size = found.select(F.coalesce(F.sum(8 * F.size("words") + 8 * F.size("places") + 64), F.lit(0))).first()[0]

    def sets(row: tuple) -> tuple[frozenset[int], frozenset[int]]:
        return tuple(frozenset(x or ()) for x in row)

    # the page is one column meanwhile, so that none of its own names can clash
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.xxhash64(host_of(F.col(url_col))).alias("host"), F.col(html_col).alias("html"))
    if size <= BROADCAST_LIMIT:  # tasks are told all templates
        told = spark.sparkContext.broadcast({r["host"]: (r["words"], r["places"]) for r in found.collect()})

        def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            release()
            known: dict[int, tuple] = {}
            for htmls, hosts in batches:
                out = []
                for x, host in zip(htmls, hosts.to_pylist(), strict=True):
                    if host not in known:
                        if len(known) >= HOSTS:
                            known.clear()
                        known[host] = sets(told.value.get(host, ((), ())))
                    out.append("\n".join(blocks(x.as_py(), *known[host])))
                yield pa.array(out, pa.string())

        joined = rows.select("row", F.arrow_udf(read, "string")(F.col("html"), F.col("host")).alias("text"))
    else:

        def read_joined(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            release()
            known: dict[int, tuple] = {}
            for htmls, hosts, words, places in batches:
                out = []
                for x, host, *own in zip(htmls, hosts.to_pylist(), words, places, strict=True):
                    if host not in known:
                        if len(known) >= HOSTS:
                            known.clear()
                        known[host] = sets(tuple(y.as_py() for y in own))
                    out.append("\n".join(blocks(x.as_py(), *known[host])))
                yield pa.array(out, pa.string())

        joined = rows.join(found.withColumnRenamed("host", "of_host"), F.col("host") == F.col("of_host"), "left")
        joined = joined.select("row", F.arrow_udf(read_joined, "string")(F.col("html"), F.col("host"), F.col("words"), F.col("places")).alias("text"))
    return joined.select(*[F.col(f"row.`{c}`") for c in pages.columns if c != "main_text"], F.col("text").alias("main_text"))
