"""HTML extraction: the DOMs of a host merged into a style tree, whose branches of low importance leave each page."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, small_batches, stage
from .url_rules import host_of

#: Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option select".split())
NOISE = frozenset("head nav footer aside form script style title noscript iframe template svg button select option textarea menu dialog search fieldset object canvas audio video".split())
ENDS_P = BLOCK - frozenset("body html option select".split())
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
LIMITS = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
#: Words of class, id and role attributes that name what isn't the article.
NAMED = frozenset("""ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion promoted banner nav navbar navigation menu
breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe
subscription signup social share sharing related recommended recommendations comment comments commentlist disqus respond reply replies discussion widget widgets toolbar pagination
pager login search contentinfo complementary dialog form hidden copyright disclaimer""".split())  # fmt: skip
HEADERS = frozenset(["header", "pageheader", "siteheader"])
#: Whole class names and ids that even inside an article name what isn't its text.
NAMED_WITHIN = frozenset("ad ads advert advertisement adbox sponsored promo comment comments comment-list commentlist comments-area replies respond disqus_thread share sharing share-buttons social-share newsletter newsletter-signup related-posts related-articles".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>|(?P<text>[^<]+|<)""", re.S)
REST = re.compile(r"<!--.*|(?P<text>(?:(?!<!--).)+)(?P<data>)(?P<tag>\b\B)?", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PARTS = re.compile(r"[^a-z]+")

#: A branch is judged on a host where so many different pages have its path. Its importance is a mean, PRESENTATION parts of
#: it presentation and the rest content, times NAMED_WEIGHT if it names itself as something else; below LEAST it goes.
PAGES, PRESENTATION, NAMED_WEIGHT, LEAST = 4, 0.1, 0.05, 0.1
#: So many unimportant contents are broadcast (8 bytes each); more are joined to the pages.
MOST = 500_000
BY_KIND, BY_NAME = 1, 2
TAG, PARENT, NOISY, PATH, LABEL, LINKED, LINKS, CHARS, WITHIN = range(9)


class Page:
    """Elements in page order, each [tag, parent, noisy, path, label, characters in links, links, characters,
    whether in an article or main element], and blocks (element, text)."""

    def __init__(self, source: str) -> None:
        self.nodes: list[list] = [["", -1, False, 0, "", 0, 0, 0, False]]
        self.blocks: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        nodes, stack, text, owner, at = self.nodes, [0], [], 0, 0
        opened: Counter = Counter()
        last = source.rfind(">")

        def flush() -> None:
            nonlocal owner
            if text:
                words = " ".join("".join(text).split())
                if words:
                    self.blocks.append((owner, words))
                    nodes[owner][CHARS] += len(words)
                text.clear()

        def pop(tag: str, limits: tuple = ()) -> None:
            if not opened[tag]:
                return
            for k in range(len(stack) - 1, 0, -1):
                own = nodes[stack[k]][TAG]
                if own in limits:
                    return
                if own == tag:
                    if any(nodes[x][TAG] in BLOCK for x in stack[k:]):
                        flush()
                    opened.subtract(nodes[x][TAG] for x in stack[k:])
                    del stack[k:]
                    return

        while at < len(source):
            found = TOKEN.match(source, at) if at <= last else REST.match(source, at)  # after the last > no tag can end
            at = found.end()
            tag = found["tag"]
            if tag is None:
                raw = found["text"] or found["data"]
                if raw:
                    if not text:
                        owner = stack[-1]
                        while nodes[owner][TAG] not in BLOCK and owner:
                            owner = nodes[owner][PARENT]
                    value = html.unescape(raw) if "&" in raw and found["text"] else raw
                    text.append(value)
                    if opened["a"]:
                        nodes[owner][LINKED] += len("".join(value.split()))
                continue
            tag = tag.lower()
            if found["end"]:
                if tag == "br":
                    text.append(" ")
                elif tag == "p" and not opened["p"]:
                    flush()
                else:
                    pop(tag, ("table",) if tag in ("p", "li", "div") and tag != "table" else ())
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else len(source)
                continue
            if tag in VOID:
                if tag == "br":
                    text.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in ENDS_P:
                pop("p", ("table", "article", "section", "li"))
            for other in SIBLINGS.get(tag, ()):
                pop(other, LIMITS[tag])
            if tag in BLOCK:
                flush()
            parent = stack[-1]
            names, whole, hidden = self._names(found["attrs"]) if found["attrs"] else ((), (), False)
            above = nodes[parent]
            within = tag in ("article", "main") or above[WITHIN]
            noisy = BY_KIND if hidden or tag in NOISE or (tag == "header" or not HEADERS.isdisjoint(names)) and not within else 0
            if not noisy and tag not in ("html", "body", "main"):
                named = tag not in TEXTUAL and not NAMED_WITHIN.isdisjoint(whole) if above[WITHIN] else not NAMED.isdisjoint(names)
                noisy = BY_NAME if named else 0
            label = f"{tag}.{'.'.join(names)}"
            nodes.append([tag, parent, noisy, xxhash.xxh64_intdigest(f"{above[PATH]}/{label}") - 2**63, label, 0, int(tag == "a"), 0, within])
            stack.append(len(nodes) - 1)
            opened[tag] += 1
        flush()

    @staticmethod
    def _names(attrs: str) -> tuple[tuple, tuple, bool]:
        """The words of class, id and role, the whole names, and whether the element is hidden."""
        names, whole, hidden = [], [], False
        for name, value in ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                hidden = True
            elif name in ("class", "id", "role"):
                names += [x for x in PARTS.split(value) if x]
                whole += value.split()
        return tuple(dict.fromkeys(names)), tuple(whole), hidden

    def sums(self) -> None:
        """Characters, links and linked characters of whole branches, and which of them are no text whatever the host's pages say.

        A branch of links alone, outside articles and main elements, is a menu. A name counts for nothing on a branch around
        the page's first heading, its main element or its only article: such a name speaks of the layout.
        """
        nodes = self.nodes
        alone = sum(node[TAG] == "article" and not node[NOISY] for node in nodes) == 1
        core = [False] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            node = nodes[k]
            own = not node[NOISY] and (node[TAG] in ("h1", "main") or node[TAG] == "article" and alone)
            if own or core[k] and node[NOISY] != BY_KIND:
                core[node[PARENT]] = True
        for node in reversed(self.nodes[1:]):
            above = self.nodes[node[PARENT]]
            for k in (LINKED, LINKS, CHARS):
                above[k] += node[k]
        for k in range(1, len(nodes)):
            node = nodes[k]
            menu = not node[WITHIN] and node[TAG] in ("ul", "ol", "div", "table", "section", "p") and node[LINKS] >= 3 and node[LINKED] >= 0.7 * node[CHARS]
            if menu or nodes[node[PARENT]][NOISY] == BY_KIND:
                node[NOISY] = BY_KIND
            elif node[NOISY] == BY_NAME and core[k]:
                node[NOISY] = 0

    def gone(self, removed: frozenset | set = frozenset()) -> list[bool]:
        """Which elements leave: those of no text, those whose name alone makes them unimportant, those of ``removed``, and what they hold."""
        out = [False]
        for node, (path, content) in zip(self.nodes[1:], self.contents()[1:], strict=True) if removed else ((n, (0, 0)) for n in self.nodes[1:]):
            out.append(out[node[PARENT]] or node[NOISY] == BY_KIND or node[NOISY] == BY_NAME and NAMED_WEIGHT < LEAST or (path, content) in removed)
        return out

    def scope(self, gone: list[bool]) -> list[bool]:
        """Which elements lie in the page's articles if these hold half of the main element's text (or there is none), else in the main element, else everywhere."""
        inside = {}
        for tag in ("article", "main"):
            inside[tag] = [False]
            for node in self.nodes[1:]:
                inside[tag].append(inside[tag][node[PARENT]] or node[TAG] == tag)
        size = {tag: sum(len(text) for k, text in self.blocks if own[k] and not gone[k]) for tag, own in inside.items()}
        if size["article"] and 2 * size["article"] >= size["main"]:
            return inside["article"]
        return inside["main"] if size["main"] else [True] * len(self.nodes)

    def contents(self) -> list[tuple[int, int]]:
        """The path and a hash of the whole text of every element (0 if it has none)."""
        held: list[list[int]] = [[] for _ in self.nodes]
        for k, text in self.blocks:
            held[k].append(xxhash.xxh64_intdigest(text))
        out = [(0, 0)] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            if held[k]:
                out[k] = self.nodes[k][PATH], xxhash.xxh64_intdigest(repr(held[k])) - 2**63
                if k:
                    held[self.nodes[k][PARENT]].append(out[k][1])
        return out

    def branches(self) -> Iterator[tuple[int, int, int]]:
        """(path, presentation, content) of every element with text that isn't gone anyway: paragraphs, headings, articles and all others."""
        style: list[list[str]] = [[] for _ in self.nodes]
        for node in self.nodes[1:]:
            style[node[PARENT]].append(node[LABEL])
        gone, contents = self.gone(), self.contents()
        for k in range(1, len(self.nodes)):
            if contents[k][1] and not gone[k]:
                yield contents[k][0], xxhash.xxh64_intdigest(repr(style[k])) - 2**63, contents[k][1]

    def text(self, removed: frozenset | set = frozenset()) -> str:
        """The blocks that stay. The page's scope is found before the host's contents leave, so that these never decide it."""
        first = self.gone()
        inside, gone = self.scope(first), self.gone(removed) if removed else first
        return "\n".join(text for k, text in self.blocks if inside[k] and not gone[k])


def parsed(source: str | None) -> Page:
    page = Page(source or "")
    page.sums()
    return page


def style_nodes(pages: DataFrame) -> DataFrame:
    """_id, _site, path, style, content, page: the branches of every page of a known host; pages with the same text left are one page."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for ident, site, source in zip(rows["_id"], rows["_site"], rows["_html"], strict=True):
                page = parsed(source)
                whole = xxhash.xxh64_intdigest(page.text()) - 2**63
                out += [(ident, site, *x, whole) for x in dict.fromkeys(page.branches())]
            if out:
                yield pd.DataFrame(out, columns=["_id", "_site", "path", "style", "content", "page"])

    kind = dict(pages.dtypes)["_id"]
    return pages.filter("_site is not null").select("_id", "_site", "_html").mapInPandas(made, f"_id {kind}, _site long, path long, style long, content long, page long")


def unimportant(nodes: DataFrame) -> DataFrame:
    """(_site, path, content, rows) of the branches whose importance is below LEAST; rows: how many of ``nodes`` they are.

    Over the m different pages of a host that have a path, its presentation's importance is the entropy of the sequences of
    child elements, as a share of log m; a content's importance is 1 less the entropy of its spread over the pages: it lies
    on c of them alike, so 1 - log c / log m. Pages are counted in parts, so a host may hold any share of them.
    """
    where = ["_site", "path"]
    pages = nodes.select(*where, "page").distinct().groupBy(*where).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= PAGES)
    styles = nodes.select(*where, "style", "page").distinct().groupBy(*where, "style").agg(F.count(F.lit(1)).cast("double").alias("c"))
    n = F.sum("c")
    styles = styles.groupBy(*where).agg(((F.log(n) - F.sum(F.col("c") * F.log("c")) / n) / F.log(F.greatest(n, F.lit(2.0)))).alias("style"))
    contents = nodes.groupBy(*where, "content", "page").agg(F.count(F.lit(1)).alias("rows")).groupBy(*where, "content").agg(F.count(F.lit(1)).alias("c"), F.sum("rows").alias("rows")).filter(F.col("c") > 1)
    own = 1 - F.log(F.col("c").cast("double")) / F.log(F.col("m").cast("double"))
    judged = contents.join(pages, where).filter((1 - PRESENTATION) * own < LEAST).join(styles, where)
    return judged.filter(PRESENTATION * F.col("style") + (1 - PRESENTATION) * own < LEAST).select(*where, "content", "rows")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page.

    What is no text by its kind leaves (scripts, forms, nav, header, footer, aside, hidden elements, menus of links). All
    other elements, with paragraphs, headings and articles, are merged by host and path into a style tree. An element's
    importance comes from the entropies of its presentation and content over the host's different pages (those with the
    same text left are one page), and names that speak of something else (advert, sidebar, cookie notice; inside an article
    only whole names like ``comments``, and never on paragraphs) weigh it down; below LEAST it leaves the page. The text is
    that of the articles, or of the main element where these hold less than half of its text, else of the whole page.
    Blocks are joined by line feeds; a line break inside a block is white space.

    Returns the id, the url, text (empty if none) and n_chars. A null html is empty; pages without a host have only the
    weights of names, as have those with a null id. Very long pages are read whole, one batch of rows at a time. Repeated
    rows are returned each and count as one page. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(pages.sparkSession, 500)
    host = host_of(F.col(url_col))
    site = F.when((host != "") & F.col(id_col).isNotNull(), F.xxhash64(host))
    one = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), site.alias("_site"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    nodes = stage(style_nodes(one), "nodes")
    noise = stage(unimportant(nodes), "noise")
    few = noise.limit(MOST + 1).count() <= MOST
    if few:
        by_site: dict[int, set] = {}
        for r in noise.select("_site", "path", "content").collect():
            by_site.setdefault(r[0], set()).add((r[1], r[2]))
        shared = pages.sparkSession.sparkContext.broadcast(by_site)
        ready = one.select("_id", "_url", "_html", F.coalesce("_site", F.lit(0)).alias("_site"), F.lit(None).cast("array<long>").alias("_paths"), F.lit(None).cast("array<long>").alias("_contents"))
    else:
        shared = None
        met = join_hot(nodes.select("_id", "_site", "path", "content"), noise, ["_site", "path", "content"], "rows", ["_id"])
        marks = met.groupBy("_id").agg(F.collect_list("path").alias("_paths"), F.collect_list("content").alias("_contents"))
        ready = one.join(marks, "_id", "left").select("_id", "_url", "_html", F.coalesce("_site", F.lit(0)).alias("_site"), "_paths", "_contents")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value if shared else {}
        for rows in batches:
            texts = []
            for source, site, paths, contents in zip(rows["_html"], rows["_site"], rows["_paths"], rows["_contents"], strict=True):
                removed = known.get(site, frozenset()) if paths is None else frozenset(zip(map(int, paths), map(int, contents), strict=True))
                texts.append(parsed(source).text(removed))
            ident = rows["_id"].to_numpy() if rows["_id"].notna().all() else rows["_id"].astype("Int64")
            yield pd.DataFrame({"_id": ident, "_url": rows["_url"].to_numpy(), "text": texts}, columns=["_id", "_url", "text"])

    found = ready.mapInPandas(extract, f"_id {dict(one.dtypes)['_id']}, _url string, text string")
    return found.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
