"""Main text of web pages by removal of site templates.

A page becomes a tree of elements. Every element subtree of the whole page
(menus, headers, footers, boxes, paragraphs) is hashed by its tags, names, roles
and text; Spark counts on how many differing pages of a host, and of a section of it, each
hash occurs, and the subtrees that recur there are deleted. Of what is left the
article (or the body, on pages without one) is read block by block. What cannot
recur is left to HTML itself: elements whose tag or role says that they are no
content, and reader comments. Class names settle nothing more where a host has
enough pages to count on; there they only ask for less recurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import durable, row_keys

# Elements by their roles in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style head nav header footer aside form noscript iframe template button select option input textarea svg canvas object embed applet audio video map menu dialog title xmp noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert status".split())
#: Words of a class or id that name furniture.
DROPPED_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner
nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside rail widget widgets toc
cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay newsletter subscribe subscription signup login register
share sharing social follow comment comments commentlist disqus reply replies respond discussion reactions related recommended recommendations
trending popular toolbar search form tags copyright skip""".split())
#: Of these, those that name what even an article element is not.
ASIDE_NAMES = frozenset("comment comments commentlist reply replies respond discussion related recommended recommendations teaser card promo promotion sponsored ad advert advertisement".split())
#: Title words as well: alone, they name furniture only where the element is mostly links; what recurs on the host goes as a template.
AMBIGUOUS = frozenset("""related discussion search social form tags header notice notices alert follow login register popular trending recommended recommendations
reactions respond disclaimer copyright consent menu skip promotion banner""".split())
#: Words that make compounds with names in a class: related-posts, share-buttons, cookie-bar.
COMPANIONS = frozenset("""articles area bar block box button buttons container content entry form icons inner item items left link links list main module page panel post posts right
site stories top bottom unit wrap wrapper""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Class tokens and ids of reader comments, which differ from page to page, so recurrence can't tell them.
COMMENT_NAMES = frozenset("comment comments commentlist comment-list comments-area disqus disqus_thread replies respond".split())
#: Elements that an opening tag ends, if they are open nearer than the elements in SCOPE.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tbody", "tfoot"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote address li pre dt dd figcaption summary".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote address pre".split())
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}

#: Kinds of the subtrees that are counted: around the content; in it boxes and lists, links and spans, paragraphs and
#: the like, named ones, and boxes without paragraphs.
OUTSIDE, BOX, INLINE, TEXT, NAMED, BARE = 1, 2, 3, 4, 5, 6
BOXES = frozenset("article div section ul ol dl table figure details fieldset center".split())
#: Places among which a host's pages are dealt when they meet its templates.
SALT = 32

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)|(\bhidden\b)""")
NAME = re.compile(r"[a-z0-9]+")


def named(token: str, known: frozenset[str], is_id: bool) -> str:
    """What a class token or a whole id says: "sure" of furniture, "maybe", or "".

    A token is one name or a compound of names; in classes also of names and
    companions. Ids are often slugs of titles, so theirs are names only, and
    words of titles alone never settle one.
    """
    words = NAME.findall(token)
    found = [w for w in words if w in known]
    if not found or any(w not in known and (is_id or w not in COMPANIONS) for w in words):
        return ""
    if len(words) == 1 or is_id:
        return "maybe" if all(w in AMBIGUOUS for w in found) else "sure"
    return "sure"


HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[^/?#]*)?(?:/([^/?#]*)/)?", re.I)


class Node:
    """An element: its children are nodes and strings (text with references decoded)."""

    __slots__ = ("tag", "names", "role", "hidden", "children", "hash", "holds", "title", "named", "comments", "full", "words")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.names, self.role, self.hidden, self.children, self.hash = tag, frozenset(), "", False, [], 0
        self.named, self.comments = "", False
        self.full, self.words = False, 0  # a paragraph or heading below; words below
        self.holds = self.title = False  # an article, main element or first heading below; a first heading below
        if attributes and not attributes.isspace():
            for key, value, hidden in ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key in ("class", "id"):
                    value = value.strip("\"'").lower()
                    self.names |= frozenset(NAME.findall(value))
                    known = ASIDE_NAMES if tag == "article" else DROPPED_NAMES
                    for token in value.split():
                        self.comments = self.comments or token in COMMENT_NAMES
                        if self.named != "sure":
                            self.named = named(token, known, key == "id") or self.named
                elif key == "role":
                    self.role = value.strip("\"' ").lower()
                elif hidden or key == "hidden" or key == "aria-hidden" and "true" in value:
                    self.hidden = True

    def furniture(self, names: bool = True) -> bool:
        """Whether its tag or role says that it is not content, or, with `names`, its name. Names say nothing of an
        element around the content; without `names` they count for reader comments and for what is mostly links."""
        if self.tag in DROPPED or self.role in DROPPED_ROLES or self.hidden:
            return True
        if not self.named or self.holds or self.tag in ("html", "body", "main") or self.tag in HEADINGS:
            return False
        if names and self.named == "sure" or self.comments:
            return True
        return bool(self.children) and linked(self)


def linked(node: Node) -> bool:
    """Whether more than half of an element's text is in links."""
    inside, whole, todo = 0, 0, [(node, node.tag == "a")]
    while todo:
        n, link = todo.pop()
        for c in n.children:
            if isinstance(c, str):
                size = len("".join(c.split()))
                whole += size
                inside += size * link
            else:
                todo.append((c, link or c.tag == "a"))
    return 2 * inside > whole


def parse(html: str) -> Node:
    """The tree of a page; tags that are missing or misplaced are mended as browsers do in the common cases."""
    root = Node("#root")
    stack, at, size = [root], 0, len(html)

    def text(a: int, b: int) -> None:
        if a < b:
            stack[-1].children.append(unescape(html[a:b]) if "&" in html[a:b] else html[a:b])

    def close(tags: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in within:
                return

    while at < size:
        m = TAG.search(html, at)
        if not m:
            break
        text(at, m.start())
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if any(n.tag == tag for n in stack[1:]):
                close({tag}, {"article", "main", "body"} - {tag} if tag not in ("html", "body", "article", "main") else set())
            continue
        if tag in ENDS_P:
            close({"p"}, {"table", "td", "th", "li", "div", "article", "section", "main", "body", "button"})
        if tag in ENDS:
            for _ in range(3):
                before = len(stack)
                close(ENDS[tag], SCOPE[tag])
                if len(stack) == before:
                    break
        if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            del stack[-1]
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in ("h1", "main") or tag == "article" and not node.furniture():
            for n in stack:
                n.holds = True
                n.title = n.title or tag == "h1"
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(html, at)
            at = stop.end() if stop else size
            continue
        stack.append(node)
    text(at, size)
    return root


def squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def digest(node: Node) -> int:
    """Set the hash of every element of a subtree, of tags, names, roles and squeezed text; iteratively, as trees can be deep."""
    todo = [(node, False)]
    while todo:
        n, ready = todo.pop()
        if not ready:
            todo.append((n, True))
            todo += [(c, False) for c in n.children if not isinstance(c, str)]
            continue
        h = xxhash.xxh64(f"{n.tag}|{' '.join(sorted(n.names))}|{n.role}")
        for c in n.children:
            h.update(b"\0" + " ".join(c.split()).encode("utf-8", "surrogatepass") if isinstance(c, str) else b"\1" + c.hash.to_bytes(8, "little"))
            n.words += len(c.split()) if isinstance(c, str) else c.words
            n.full = n.full or not isinstance(c, str) and (c.full or c.tag in PARAGRAPHS)
        n.hash = h.intdigest()
    return node.hash


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def content(root: Node) -> list[Node]:
    """The elements that hold the content: the outermost articles (those with a first heading, if any has one), else main, else the body, else the root."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if (n.tag == wanted or wanted == "main" and n.role == "main") and not (n.tag == "article" and n.furniture()):
                found.append(n)
            elif not n.furniture() or n.tag in ("html", "body"):
                todo += [c for c in reversed(n.children) if not isinstance(c, str)]
        if found:
            return [n for n in found if n.title] or found
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag == "body":
            return [n]
        todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    return [root]


def candidates(root: Node) -> list[tuple[Node, int]]:
    """With their kinds: the subtrees of a page that can be templates; `digest` comes first.

    Around the content, and in menus, forms and the like inside it, these are
    all block elements; in the content boxes and lists, links and spans, and
    paragraphs, headings and items. An element that holds one other and nothing
    else stands for both. Tables count as a whole, not by cells, and emphasis
    inside sentences doesn't count, nor do paragraphs of one or two words, which
    recur by chance; of several articles each is a box.
    """
    held = content(root)
    inner = {id(n) for n in held}
    out, todo = [], [(root, False, False)]
    while todo:
        n, inside, alone = todo.pop()
        if n.tag in RAW or n.tag == "head":
            continue
        own = id(n) in inner
        outside = not (inside or own) or n.furniture(names=False)
        kind = 0
        if outside:
            kind = OUTSIDE if n.tag in BLOCKS and n.tag not in ("html", "body") and not n.holds else 0
        elif n.tag in BOXES and (not own or len(held) > 1):
            kind = BOX
        elif not own:
            kind = INLINE if n.tag in ("span", "a") else TEXT if n.tag in TEXTS and n.words >= 3 else 0
        if kind and not alone:
            out.append((n, kind))
            if kind == BOX and not n.full:
                out.append((n, BARE))
            if n.named and not outside and not n.holds and n.tag not in HEADINGS:
                out.append((n, NAMED))
        kids = [c for c in n.children if not isinstance(c, str)]
        only = bool(kind) and len(kids) == 1 and not any(isinstance(c, str) and not c.isspace() for c in n.children)
        todo += [(c, not outside, only and not kids[0].named) for c in kids]
    return out


def alike(root: Node) -> int:
    """What pages with equal content have in common, whatever is around it. `digest` comes first."""
    h = xxhash.xxh64()
    for n in content(root):
        h.update(n.hash.to_bytes(8, "little"))
    return signed(h.intdigest())


def prune(root: Node, host: str, inner: set[int], outer: set[int]) -> int:
    """Delete the topmost subtrees whose hashes on the host are templates, of `inner` in the content and of `outer` around it; how many they were."""
    held = {id(n) for n in content(root)}
    removed, todo = 0, [(root, id(root) in held)]
    while todo:
        n, inside = todo.pop()
        kept = []
        for c in n.children:
            if isinstance(c, str):
                kept.append(c)
                continue
            outside = not (inside or id(c) in held) or c.furniture(names=False)
            if signed(on_host(host, c.hash)) in (outer if outside else inner) and not (outside and c.holds):
                removed += 1
                kept.append(" ")
                continue
            kept.append(c)
            todo.append((c, not outside))
        n.children = kept
    return removed


def blocks(nodes: list[Node], template: frozenset[int] = frozenset(), names: bool = True) -> list[str]:
    """The squeezed text of each block in page order; furniture and subtrees with a template's hash are left out."""
    out: list[str] = []
    parts: list[str] = []

    def cut() -> None:
        if parts:
            if line := squeeze(parts):
                out.append(line)
            parts.clear()

    for top in nodes:
        cut()
        todo: list = [iter(top.children)]
        block = [True]
        while todo:
            c = next(todo[-1], None)
            if c is None:
                todo.pop()
                if block.pop():
                    cut()
            elif isinstance(c, str):
                parts.append(c)
            elif c.tag in ("br", "hr", "wbr", "img"):
                if c.tag == "hr":
                    cut()
                elif c.tag == "br":
                    parts.append(" ")
            elif (not c.furniture(names) or c.tag == "header" and c.title and top.tag in ("article", "main") and not c.hidden) and c.hash not in template:
                if c.tag in BLOCKS:
                    cut()
                todo.append(iter(c.children))
                block.append(c.tag in BLOCKS)
    cut()
    return out


def host_of(url: str | None) -> tuple[str, str]:
    """A page's host and the first folder of its path (empty without one)."""
    m = HOST.match(url or "")
    return (m[1].lower(), m[2] or "") if m else ("", "")


def on_host(host: str, h: int) -> int:
    """A subtree's hash among those of its host: hashes of different hosts never meet, so they alone are the key."""
    return xxhash.xxh64_intdigest(h.to_bytes(8, "little") + host.encode("utf-8", "surrogatepass"))


def page_hashes(html: str | None, url: str | None = None) -> tuple[int, int, int, list[tuple[int, int]]]:
    """A page's host and section as numbers, what equal contents have in common, and (hash on its host, kind) of its subtrees, each once."""
    host, section = host_of(url)
    root = parse(html or "")
    digest(root)
    found = sorted({(signed(on_host(host, n.hash)), k) for n, k in candidates(root)})
    return signed(on_host(host, 0)), signed(on_host(f"{host}/{section}", 1)), alike(root), found


def template_counts(seen: DataFrame, min_pages: int, share: float, many: int, few: int) -> DataFrame:
    """(h, kinds): the templates and the kinds in which they are; a host's own number stands for a host of `few` pages or more, with the kind 0.

    `seen` has host, section, alike and hashes. Pages with equal content count
    once. Two levels of sums, so no task holds a host's pages; a page counts as
    its host's number.
    """
    each = seen.select("host", "section", "alike", F.explode(F.concat(F.array("host"), F.array_distinct("hashes.h"))).alias("h"))
    apart = each.groupBy("section", "alike", "h").agg(F.first("host").alias("host"), F.count("*").alias("copies"))
    by_section = durable(apart.groupBy("section", "h").agg(F.first("host").alias("host"), F.count("*").alias("n"), F.sum("copies").alias("copies")))
    pages = by_section.where("h = host").select(F.col("section").alias("_section"), F.col("n").alias("pages"))
    found = by_section.where(f"h <> host and n >= {int(min_pages)}").join(pages, F.col("section") == F.col("_section"))
    # Regular: on more than `share` of the pages of the host, or of one section of it.
    most = found.where(F.col("n") > share * F.col("pages")).groupBy("h").agg(F.max("n").alias("at")).withColumnRenamed("h", "_h")
    of_host = by_section.groupBy("h").agg(F.first("host").alias("host"), F.sum("n").alias("n"), F.sum("copies").alias("copies")).where("copies >= 2")
    whole = of_host.where("h = host").select(F.col("host").alias("_host"), F.col("n").alias("pages"), F.col("copies").alias("all_pages"))
    shared = of_host.where("h <> host").join(whole, F.col("host") == F.col("_host")).select("h", "n", "copies", (F.col("n") > share * F.col("pages")).alias("regular"), (F.col("copies") > share * F.col("all_pages")).alias("usual"))
    joined = shared.join(most, F.col("h") == F.col("_h"), "left")
    n, regular = F.col("n"), F.coalesce(F.when(F.col("regular"), F.col("n")), F.col("at"), F.lit(0))
    rules = {OUTSIDE: n >= min_pages, BOX: (regular >= min_pages) | (n >= many), INLINE: regular >= many, TEXT: regular >= many, NAMED: n >= 2, BARE: F.col("usual") & (F.col("copies") >= min_pages)}
    kinds = F.array_compact(F.array(*(F.when(rule, F.lit(kind)) for kind, rule in rules.items())))
    big = whole.where(f"pages >= {int(few)}").select(F.col("_host").alias("h"), F.array(F.lit(0)).alias("kinds"))
    return joined.select("h", kinds.alias("kinds")).where("size(kinds) > 0").unionByName(big)


def zipped(pages: DataFrame) -> DataFrame:
    """`pages` (k, page_id, url, html) with the html compressed page by page (zstd), and `size`, its bytes; null html is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for b in batches:
            raw = [None if html is None else html.encode() for html in (x.as_py() for x in b.column("html"))]
            small = pa.array([None if x is None else codec.compress(x, asbytes=True) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k", "page_id", "url")), small, pa.array([len(x or b"") for x in raw], pa.int64())], ["k", "page_id", "url", "zipped", "size"])

    kept = [pages.schema[c] for c in ("k", "page_id", "url")]
    return pages.select("k", "page_id", "url", "html").mapInArrow(run, T.StructType([*kept, T.StructField("zipped", T.BinaryType()), T.StructField("size", T.LongType())]))


def unzipped(small: bytes | None, size: int) -> str:
    """The html again; empty for null."""
    return pa.Codec("zstd").decompress(small, size, asbytes=True).decode() if small else ""


def extract(pages: DataFrame, min_pages: int = 3, share: float = 0.3, many: int = 20, few: int = 20) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, url, text, n_chars, n_removed (topmost template subtrees deleted).

    Pages count apart if their contents differ, so copies of a page count once,
    but for boxes and lists without a paragraph or heading, which count on all.
    A subtree is a template of its host if it occurs

    * around the content, on `min_pages` pages;
    * as a box or list in the content, on `many` pages, or on `min_pages` that are
      more than `share` of the host's or of one of its sections (the path's first folder);
    * as a paragraph, heading, item, link or span in the content, on `many` pages
      that are more than `share` as well, as articles share lines of their own;
    * with a name of furniture, on two pages. On hosts with fewer than `few` pages,
      too few to count on, the name alone is enough.

    Null and empty html give an empty
    text; rows without a url are of one host without a name; repeated rows are
    pages of their own with equal results; pages of any length are read whole; other columns are
    ignored, whatever their names; an empty table gives an empty one; ties at a
    limit: `min_pages`, `many` and `few` are reached by equality, `share` must be exceeded. White space of any kind inside a
    block becomes one space, and blocks are joined by two newlines.
    """
    (k,) = row_keys("page_id", "url", "html")[:1]
    pages = pages.select("page_id", "url", "html", k.alias("k"))
    schema = "k long, host long, section long, alike long, hashes array<struct<h:bigint,kind:int>>"

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("h", pa.int64()), ("kind", pa.int32())]))
        for b in batches:
            found = [page_hashes(html.as_py(), url) for html, url in zip(b.column("html"), b.column("url").to_pylist())]
            numbers = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("k"), *numbers, pa.array([[{"h": h, "kind": k} for h, k in f[3]] for f in found], pairs)], ["k", "host", "section", "alike", "hashes"])

    seen = durable(pages.select("url", "html", "k").mapInArrow(hashes, schema))
    template = durable(template_counts(seen, min_pages, share, many, few))
    # Templates go to `SALT` places each, as a hot host's pages all have them; pages are dealt by row, not by host.
    # A page is named by one 64-bit hash: were two pages to share it, templates that a page doesn't contain change nothing in it.
    spots = template.select(F.col("h").alias("_h"), "kinds", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    own = F.filter("hashes", lambda x: x["kind"] == NAMED)
    marks = seen.select("k", F.pmod("k", F.lit(SALT)).cast("int").alias("salt"), F.inline(F.concat(F.when(F.size(own) > 0, F.array(F.struct(F.col("host").alias("h"), F.lit(0).alias("kind")))).otherwise(F.array().cast("array<struct<h:bigint,kind:int>>")), "hashes")))
    met = marks.join(spots, (F.col("h") == F.col("_h")) & (F.col("salt") == F.col("_salt"))).where(F.array_contains("kinds", F.col("kind")))
    lists = durable(met.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("h", "kind"))).alias("templates"))).withColumnRenamed("k", "_k")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes, removed = [], [], []
            for small, size, url, known in zip(b.column("zipped"), b.column("size").to_pylist(), b.column("url").to_pylist(), b.column("templates")):
                root, marks, gone = parse(unzipped(small.as_py(), size)), known.as_py() or [], 0
                names = not any(t["kind"] == 0 for t in marks)
                if any(t["kind"] for t in marks):
                    host = host_of(url)[0]
                    digest(root)
                    gone = prune(root, host, *({t["h"] for t in marks if t["kind"] and (t["kind"] == OUTSIDE) == outside} for outside in (False, True)))
                texts.append("\n\n".join(blocks(content(root), names=names)))
                sizes.append(len(texts[-1]))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], ["page_id", "url", "text", "n_chars", "n_removed"])

    # Both are dealt by page at any size: the lists grow with the pages, and so disk grows in proportion, not by a change of join.
    # Most of the disk is the html on its way, so it travels compressed.
    known = zipped(pages).join(lists.hint("merge"), F.col("k") == F.col("_k"), "left").select("page_id", "url", "zipped", "size", "templates")
    return known.mapInArrow(text, T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_removed", T.LongType())]))
