"""Main text of HTML pages with removal of site templates.

1. Every page is parsed; the hash of each element subtree (its tags, and its
   text with numbers taken as one) is emitted with the page's host and a hash
   of the page's main text.  Inside an article or main element and beside a
   first-level title only containers count (lists, tables, divisions).
2. Spark counts, per host and subtree hash, the distinct main texts it came
   with, so copies of one page count once.  A subtree that recurs on at
   least ``min_share`` of the host's texts is a template: on five or more
   outside these places, on ``min_pages`` inside.
3. A second pass deletes template subtrees and, by tag, role and class,
   menus, headers, footers, sidebars, notices, adverts, forms, scripts,
   styles and reader comments, and joins the blocks of the main elements.

Titles and paragraphs inside an article, and whatever holds it, are never
template subtrees: text repeated inside articles stays.  Elements may be
nested to any depth; nothing here recurses.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, stored, text_slices

MIN_PAGES, MIN_PAGES_OUTSIDE, MIN_SHARE = 10, 5, 0.02
#: Template hashes that are broadcast (8 bytes each); beyond, they are joined to the pages.
BROADCAST_TEMPLATES = 2_000_000
#: Share of the main element's text from which its articles stand for it; share of the largest article from which
#: another one of a page without a main element counts too.
ARTICLES_OF_MAIN, ARTICLE_OF_LARGEST = 0.5, 0.25

_NUMBER = re.compile(r"\d+")
_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:-->|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes plaintext".split())
#: Elements that are never main text.
DROPPED = frozenset("script style template noscript head title nav footer aside form iframe object embed svg math canvas button "
                    "select option input textarea datalist dialog menu audio video map applet frameset noframes noembed xmp".split())
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table "
                  "caption thead tbody tfoot tr td th header footer nav aside form fieldset address hgroup details summary center hr "
                  "search menu dialog".split())
CONTAINER = frozenset("div section ul ol dl table nav header footer aside form figure details center fieldset search".split())
_CLOSES_P = BLOCK - frozenset("html body li dt dd td th tr thead tbody tfoot caption figcaption summary".split())
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
             "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_SCOPE = frozenset("html body article main section div td th li dd table blockquote figure aside nav header footer form".split())
#: Words of class and id names that mark what is not main text (fixed values).
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
                  "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall sidebar "
                  "sidebars nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager masthead footer topbar comment "
                  "comments disqus respond replies reply discussion related recommended recommendations share sharing social toolbar "
                  "widget widgets skip login search disclaimer".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())


class Node:
    __slots__ = ("tag", "attrs", "items", "dropped", "in_main", "by_title", "holds_main", "holds_article")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.items = tag, attrs, []
        self.dropped = self.in_main = self.by_title = self.holds_main = self.holds_article = False

    def children(self) -> list[Node]:
        return [c for c in self.items if isinstance(c, Node)]


def preorder(root: Node) -> list[Node]:
    """All elements, each before those inside it."""
    out, stack = [], [root]
    while stack:
        out.append(stack.pop())
        stack += reversed(out[-1].children())
    return out


def parse(page: str) -> Node:
    """Element tree of a page; unclosed and stray tags are repaired as browsers do for common cases."""
    root = Node("html")
    stack = [root]
    opened: Counter[str] = Counter()  # tags on the stack, so that a stray end tag needs no search
    at, n = 0, len(page)

    def cut(depth: int) -> None:
        opened.subtract(node.tag for node in stack[depth:])
        del stack[depth:]

    def close(tags: set[str], scope) -> None:
        if not any(opened[t] for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                cut(depth)
                return
            if stack[depth].tag in scope:
                return
    while at < n:
        found = _MARKUP.search(page, at)
        if found is None:
            stack[-1].items.append(page[at:])
            break
        if found.start() > at:
            stack[-1].items.append(page[at:found.start()])
        at = found.end()
        closing, tag, attrs = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[depth].tag == tag:
                    cut(depth)
                    break
                if tag not in BLOCK and stack[depth].tag in _SCOPE:
                    break  # a stray inline end tag does not close blocks
            continue
        if tag == "html":
            continue
        if tag in _CLOSES_P:
            close({"p"}, _SCOPE)
        if tag in _SIBLINGS:
            close(*_SIBLINGS[tag])
        node = Node(tag, attrs)
        stack[-1].items.append(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            stop = page.find(">", end.start()) if end else -1
            node.items.append(page[at:end.start() if end else n])
            at = stop + 1 if stop >= 0 else n
            continue
        stack.append(node)
        opened[tag] += 1
    return root


def _mark(order: list[Node]) -> None:
    """Marks what is dropped and what holds the article, main element or first-level title (elements in preorder)."""
    for node in order:
        inside = node.in_main or node.tag in ("article", "main")
        children = node.children()
        by_title = node.by_title or inside or any(c.tag == "h1" for c in children)
        for child in children:
            child.in_main, child.by_title = inside, by_title
    for node in reversed(order):
        children = node.children()
        main = node.tag in ("article", "main")
        node.holds_article = main or any(c.holds_article for c in children)
        holds = node.holds_main = main or node.tag == "h1" or any(c.holds_main and not c.dropped for c in children)
        if node.tag in DROPPED:
            node.dropped = node.tag not in ("form", "dialog") or not node.holds_article
        elif node.tag == "header":
            node.dropped = not node.in_main and not node.holds_article
        if node.attrs and not node.dropped:
            values = {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(node.attrs)}
            if "hidden" in values or values.get("aria-hidden") == "true" or values.get("role") in ROLES:
                node.dropped = not node.holds_article
            names = set(re.split(r"[^a-z0-9]+", values.get("class", "") + " " + values.get("id", "")))
            if names & MARKS and (not holds or node.tag == "article" and names & {"comment", "comments", "reply", "ad", "related", "sponsored", "promo"}):
                node.dropped = True


def main_elements(root: Node) -> list[Node]:
    """What holds the main text, in page order.

    The main element with most text that is not dropped, or the articles in
    it if they hold half of its text; without a main element the largest
    article and others that hold a quarter of its text; else the whole page.
    """
    mains: list[tuple[int, Node]] = []
    articles: list[tuple[int, Node, Node | None]] = []
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        node, main = stack.pop()
        if node.dropped:
            continue
        if node.tag == "article":  # what is nested in an article belongs to it
            articles.append((sum(map(len, blocks(node))), node, main))
            continue
        if node.tag == "main" and main is None:
            main = node
            mains.append((sum(map(len, blocks(node))), node))
        stack += [(c, main) for c in reversed(node.children())]
    size, best = max(mains, key=lambda m: m[0], default=(0, root))
    if size:
        inside = [(n, a) for n, a, of in articles if of is best and n]
        return [a for _, a in inside] if sum(n for n, _ in inside) >= ARTICLES_OF_MAIN * size else [best]
    largest = max((n for n, _, _ in articles), default=0)
    return [a for n, a, _ in articles if n >= ARTICLE_OF_LARGEST * largest] if largest else [root]


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, white space collapsed."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    stack = [(iter(node.items), False)]
    while stack:
        items, block = stack[-1]
        for item in items:
            if isinstance(item, str):
                line.append(item)
            elif item.dropped:
                if item.tag in BLOCK:
                    flush()
            elif item.tag == "br":
                line.append("\n")
            else:
                if item.tag in BLOCK:
                    flush()
                stack.append((iter(item.items), item.tag in BLOCK))
                break
        else:
            stack.pop()
            if block:
                flush()
    flush()
    return out


def main_text(root: Node) -> str:
    return "\n\n".join(text for node in main_elements(root) for text in blocks(node))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def subtree_hashes(order: list[Node], host: str) -> list[tuple[int, Node]]:
    """(hash of host, tags and text, node) of the elements that may be templates; odd: beside the title or inside an article or main element."""
    found = []
    said: dict[int, str] = {}
    for node in reversed(order):
        parts = [node.tag]
        for item in node.items:
            parts.append(_NUMBER.sub("0", " ".join(item.split())) if isinstance(item, str) else said.pop(id(item)))
        own = "\x01".join(parts)
        if len(own) > 200:
            own = f"{node.tag}\x02{_digest(own)}"
        said[id(node)] = own
        if not node.holds_main and not node.dropped and (node.tag in CONTAINER or not node.by_title and node.tag not in VOID):
            found.append((_digest(f"{host}\x00{own}") & ~1 | node.by_title, node))
    return found


def _prepared(page: str | None, host: str) -> tuple[Node, list[tuple[int, Node]]]:
    root = parse(page or "")
    order = preorder(root)
    _mark(order)
    return root, subtree_hashes(order, host)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def extract(page: str | None, url: str | None, is_template) -> str:
    """Main text of one page; is_template says which subtree hashes recur on the host."""
    if not page:
        return ""
    root, found = _prepared(page, host_of(url))
    for h, node in found:
        if is_template(h):
            node.dropped = True
    return main_text(root)


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES,
                   min_share: float = MIN_SHARE) -> DataFrame:
    """(hash) of the subtrees that recur across a host's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "html"):
            hosts, hashes, mains = [], [], []
            for url, page in zip(part.column(0).to_pylist(), texts):
                if not page:
                    continue
                host = host_of(url)
                root, found = _prepared(page, host)
                main = _digest(main_text(root))
                own = {h for h, _ in found} | {None}  # the row without a hash counts the host's pages
                hosts += [_digest(host)] * len(own)
                hashes += own
                mains += [main] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(hashes, pa.int64()), pa.array(mains, pa.int64())],
                                             names=["host", "hash", "main"])

    seen = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "host long, hash long, main long")
    counts = stored(seen.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")), "subtrees")
    whole = counts.where(F.col("hash").isNull()).select("host", F.col("n").alias("pages"))
    least = F.when(F.col("hash") % 2 == 0, MIN_PAGES_OUTSIDE).otherwise(min_pages)
    often = counts.where(F.col("hash").isNotNull() & (F.col("n") >= least))
    return often.join(whole, "host").where(F.col("n") >= F.col("pages") * min_share).select("hash").distinct()


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_limit: int = BROADCAST_TEMPLATES) -> DataFrame:
    """pages with text (main text, empty if none) and n_chars, replacing columns of these names.

    A null or empty html has an empty text; a null or odd url belongs to the
    host without a name; repeated rows get the same text and count once as
    evidence for a template; an empty table gives an empty table.
    """
    templates = stored(site_templates(pages, url_col, html_col), "templates")
    base = pages.drop("text", "n_chars")
    n = templates.count()
    schema = extended(base.schema, "text string, n_chars long")
    if n <= broadcast_limit:
        known = np.sort(np.array([r["hash"] for r in templates.collect()], np.int64))
        held = pages.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recurring = frozenset(held.value.tolist())
            for part, texts in text_slices(batches, html_col):
                urls = part.column(part.schema.get_field_index(url_col)).to_pylist()
                yield _with_texts(part, [extract(t, u, recurring.__contains__) for t, u in zip(texts, urls)])

        return base.mapInArrow(run, schema)

    # too many to broadcast: the templates of each distinct page are joined to it
    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "html"):
            keys, hashes = [], []
            for key, url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                own = {h for h, _ in _prepared(page, host_of(url))[1]}
                keys += [key] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], names=["page_key", "hash"])

    key = F.xxhash64(url_col, html_col).alias("page_key")
    of_page = (pages.select(key, F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(occurring, "page_key long, hash long")
               .distinct().join(templates, "hash").groupBy("page_key").agg(F.collect_list("hash").alias("recurring")))
    columns = base.columns
    packed = base.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("page"), key)
    joined = packed.join(of_page, "page_key", "left").select("page.*", F.col("recurring").alias("__recurring"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, html_col):
            urls = part.column(part.schema.get_field_index(url_col)).to_pylist()
            lists = part.column(part.num_columns - 1).to_pylist()
            out = [extract(t, u, frozenset(r or ()).__contains__) for t, u, r in zip(texts, urls, lists)]
            yield _with_texts(part.select(columns), out)

    return joined.mapInArrow(run_joined, schema)


def _with_texts(part: pa.RecordBatch, out: list[str]) -> pa.RecordBatch:
    out = [t.encode("utf-8", "replace").decode() for t in out]
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
                                      names=[*part.schema.names, "text", "n_chars"])
