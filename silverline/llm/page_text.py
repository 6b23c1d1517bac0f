"""Main-text extraction with a site style tree.

The pages of a host are merged into a style tree: a style node is a path of element
styles (tag, id, class) from the root.  For each node the entropy of its contents and
of its presentations (sequences of child styles) over the distinct pages that
have it is taken (a page counts with all its elements of the node, in page order), as
a share of the largest possible; the importance is the larger share.  Pages are
distinct by their main text: copies that differ in a script, a comment or a menu
are one page.  In nodes seen on at least ``MIN_PAGES`` distinct pages with importance under
``LOW`` the contents that themselves repeat are boilerplate: those whose surprisal, as
a share of the largest possible, is under ``LOW`` too (n of N pages: n > N ** 0.7).  They
are removed from the pages that have them; a content seen once never is.  Also removed are
elements that HTML or their class names mark as menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments.  Of what
remains, the article (else the main element, else the body) is the text.

Plain content elements without class or id (paragraphs, headings, lists, tables) inside
the article are never removed for being alike, and pages with one main text count once, so a site
that repeats one article keeps it.  Copies of a classed article whose main texts differ (say
by a date) are still distinct pages, and what most of the host's pages share of them is removed from them.

Text: character references decoded, white space inside a block (``br`` too) turned into one
blank, trimmed; blocks joined in page order by one LF.

Defined results: null or empty html gives an empty text; a null url belongs to the
host ''; repeated rows each give a row and count as one page of their host; an
empty table gives an empty table; other columns are ignored.  Broken markup is
read tolerantly: an open element ends with its parent; a script, style or other raw element
ends at its own closing tag, else with the page, whatever it holds.

Scale: page trees are parsed in two narrow passes; between them only hashes of
branches move, pre-aggregated.  The table of removed contents (per host a short list: at most
N ** 0.3 of a node on N pages) is written and re-read, so Catalyst broadcasts it only when it is small.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverline.session import materialize

MIN_PAGES = 5
LOW = 0.3

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""(id|class|role|hidden|aria-hidden)(?![\w-])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in "script style title textarea xmp iframe noembed noframes".split()}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike "
                    "strong sub sup time tt u var wbr".split())
_SECTION = frozenset("html body main article section aside nav header footer div table td th tr ul ol dl blockquote figure form "
                     "fieldset details".split())
_ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                    "hr main menu nav ol p pre section table ul".split())
_CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th pre blockquote figure figcaption main article body html "
                     "section".split())
_NOISE_TAGS = frozenset("nav footer aside form script style noscript template head title iframe button select option textarea input "
                        "object svg canvas dialog menu".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner nav navbar navigation menu "
    "topbar header masthead footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager comment comments reply "
    "replies respond disqus toolbar widget widgets search copyright skip".split())
_WORD = re.compile(r"[A-Za-z]+")


def _noise(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Do HTML or the names of the element mark it as something beside the text?"""
    if tag in _NOISE_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _NOISE_ROLES:
        return True
    if tag == "header":
        return not in_article
    if tag in ("html", "body", "main") or tag == "article" and not in_article and "comment" not in attrs.get("class", ""):
        return False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))]
        if words and (words[0] in _NOISE_WORDS or words[-1] in _NOISE_WORDS):
            return True
    return False


class Page:
    """Elements (path hash, parent, flags, range of text pieces) and text pieces (element, block, text) of one page."""

    __slots__ = ("path", "parent", "tag", "plain", "noise", "first", "last", "styles", "pieces")

    def __init__(self, source: str):
        self.path, self.parent, self.tag, self.plain, self.noise = [], [], [], [], []
        self.first, self.last, self.styles = [], [], []
        self.pieces: list[tuple[int, int, str]] = []
        stack: list[int] = []
        self._open("", {}, -1, False)
        stack.append(0)
        block, at, articles = 0, 0, 0

        def close(to: int) -> int:
            nonlocal articles
            ended = 0
            while len(stack) > to:
                e = stack.pop()
                self.last[e] = len(self.pieces)
                articles -= self.tag[e] == "article"
                ended |= self.tag[e] not in _INLINE
            return ended

        def text(value: str) -> None:
            if value:
                self.pieces.append((stack[-1], block, unescape(value)))

        while m := _TOKEN.search(source, at):
            text(source[at:m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == tag:
                        block += close(i)
                        break
                    if tag not in _SECTION and self.tag[stack[i]] in _SECTION:
                        break
                if tag not in _INLINE:
                    block += 1
                continue
            if tag == "br":
                self.pieces.append((stack[-1], block, " "))
                continue
            if tag not in _INLINE:
                block += 1
            if tag in _ENDS_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                ends = {"p"} if tag in _ENDS_P else {tag, "p"} | ({"dt", "dd"} if tag in ("dt", "dd") else set()) | (
                    {"td", "th"} if tag in ("tr", "td", "th") else set())
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] in ends:
                        close(i)
                        break
                    if self.tag[stack[i]] in _SECTION and self.tag[stack[i]] not in ends:
                        break
            attrs = {a[1].lower(): (a[2] or "").strip("\"'") for a in _ATTR.finditer(m[3])} if m[3] else {}
            e = self._open(tag, attrs, stack[-1], articles > 0)
            if tag not in _VOID and not (m[3] or "").endswith("/"):
                stack.append(e)
                articles += tag == "article"
                if tag in _RAW:  # nothing inside is markup: go on after its own closing tag, else at the end of the page
                    end = _RAW[tag].search(source, at)
                    if end and tag == "title":
                        text(source[at:end.start()])
                    at = end.end() if end else len(source)
                    block += close(len(stack) - 1)
        text(source[at:])
        close(0)

    def _open(self, tag: str, attrs: dict[str, str], parent: int, in_article: bool) -> int:
        style = f"{tag}#{attrs.get('id', '')}.{' '.join(sorted(attrs.get('class', '').split()))}"
        e = len(self.path)
        self.path.append(xxhash.xxh3_64_intdigest(style, seed=self.path[parent] if parent >= 0 else 0))
        self.parent.append(parent)
        self.tag.append(tag)
        self.plain.append(tag in _INLINE or tag in _CONTENT and not attrs.get("class") and not attrs.get("id"))
        self.noise.append(bool(tag) and (parent >= 0 and self.noise[parent] or _noise(tag, attrs, in_article)))
        self.first.append(len(self.pieces))
        self.last.append(len(self.pieces))
        self.styles.append([])
        if parent >= 0:
            self.styles[parent].append(style)
        return e

    def branches(self):
        """(path, content hash, presentation hash) of every path that a style tree may remove, over all its elements in page order."""
        found: dict[int, tuple[xxhash.xxh3_64, xxhash.xxh3_64]] = {}
        for e in range(1, len(self.path)):
            if not self.plain[e] and not self.noise[e]:
                content = _SPACE.sub(" ", "".join(p[2] for p in self.pieces[self.first[e]:self.last[e]])).strip()
                contents, looks = found.setdefault(self.path[e], (xxhash.xxh3_64(seed=self.path[e]), xxhash.xxh3_64(seed=self.path[e])))
                contents.update(content + "\0")
                looks.update("|".join(self.styles[e]) + "\0")
        for path, (contents, looks) in found.items():
            yield path, contents.intdigest(), looks.intdigest()

    def text(self, low: frozenset[int] | set[int] = frozenset()) -> str:
        """Blocks of the main text, without the branches whose path is in ``low``."""
        n = len(self.path)
        gone, inside = [False] * n, [""] * n
        for e in range(1, n):
            p = self.parent[e]
            gone[e] = gone[p] or self.noise[e] or (not self.plain[e] and self.path[e] in low)
            inside[e] = inside[p] if inside[p] == "article" else self.tag[e] if self.tag[e] in ("article", "main") and not gone[e] else inside[p]
        for kind in ("article", "main", None):
            blocks: dict[int, list[str]] = {}
            for e, block, value in self.pieces:
                if not gone[e] and (kind is None or inside[e] == kind or kind == "main" and inside[e] == "article"):
                    blocks.setdefault(block, []).append(value)
            lines = [x for x in (_SPACE.sub(" ", "".join(v)).strip() for v in blocks.values()) if x]
            if lines:
                return "\n".join(lines)
        return ""


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _branches(pages: DataFrame) -> DataFrame:
    """host, path, main, content and look of every style node of every distinct page."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hosts, out = batch.column(0).to_pylist(), []
            for h, source in zip(hosts, batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                main = xxhash.xxh3_64_intdigest(page.text())
                for path, content, look in page.branches():
                    out.append((h, path, main, content, look))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.record_batch([pa.array(cols[0], pa.string()), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[1:])],
                                  names=["host", "path", "main", "content", "look"])

    rows = (pages.select(host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).where("html is not null")
            .mapInArrow(run, "host string, path long, main long, content long, look long"))
    rows = rows.groupBy("host", "path", "main").agg(F.min(F.struct("content", "look")).alias("x"))
    return materialize(rows.select("host", "path", "main", "x.content", "x.look"), "html-branches")


def _counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy("host", "path", column).agg(F.count("*").alias("n"))


def style_tree(rows: DataFrame) -> DataFrame:
    """host, path, pages and importance of every style node in ``rows`` (of ``_branches``)."""

    def entropy(column: str) -> DataFrame:
        return _counts(rows, column).groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("nln")).select(
            "host", "path", "pages", F.when(F.col("pages") > 1, (F.ln("pages") - F.col("nln") / F.col("pages")) / F.ln("pages"))
            .otherwise(F.lit(1.0)).alias(f"{column}_share"))

    return entropy("content").join(entropy("look").drop("pages"), ["host", "path"]).select(
        "host", "path", "pages", F.greatest("content_share", "look_share").alias("importance"))


def _text(source: str, gone: list[int] | None) -> str:
    """Main text of a page without the branches whose content hash is in ``gone``."""
    page = Page(source)
    if not gone:
        return page.text()
    known = {x % (1 << 64) for x in gone}
    return page.text({path for path, content, _ in page.branches() if content in known})


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = _branches(pages)
    nodes = style_tree(rows).where((F.col("pages") >= min_pages) & (F.col("importance") < low))
    contents = _counts(rows, "content").where("n > 1").join(nodes, ["host", "path"]).where(F.ln("pages") - F.ln("n") < F.lit(low) * F.ln("pages"))
    removed = materialize(contents.groupBy("host").agg(F.collect_set("content").alias("low")), "html-removed")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [_text(source, gone) if source else ""
                         for source, gone in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                      names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    joined = rows.withColumn("host", host(F.col("url"))).join(removed, "host", "left").select("page_id", "url", "html", "low")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
