"""HTML extraction by consensus host paths.

Every page is parsed once to score its containers: how much block text they hold that isn't links. Each page
votes for the path of its best container, written in tags and classes with digits generalised, and for the
paths near it. Votes are summed by host in Spark; each host's winning paths, in order, are then used to
extract all its pages again, so that an odd page follows its host's template. Where none of a host's paths
fits a page, the page's own best container is taken.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.scratch import Scratch
from lodestone.llm.worker import lean

#: Fixed values of HTML: elements without content, with raw text, that hold others, and that begin a block.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
HOLDS = {"html", "body", "main", "article", "section", "div", "td", "center", "blockquote", "table", "tbody", "tr"}
BLOCK = HOLDS | {
    "address", "aside", "caption", "dd", "details", "dialog", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hgroup", "hr", "li", "menu", "nav", "ol", "p", "pre", "search", "summary", "th", "thead", "tfoot", "ul",
}
#: What is never main text, by tag, by role, and by a name of its class or id: one that is made of these words and
#: others that only tell where something stands, such as cookie-notice or site-footer, but not share-price.
SKIP_TAGS = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "head", "label", "datalist"}
SKIP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
SKIP_WORDS = {
    "ad", "ads", "adsense", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "discussion", "footer", "foot", "form", "gdpr", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promoted", "promotion", "recommend", "recommended", "related", "replies",
    "reply", "respond", "responses", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toc",
    "toolbar", "widget", "widgets",
}
PLACE_WORDS = {
    "a", "and", "area", "article", "articles", "bar", "block", "bottom", "box", "btn", "button", "buttons", "center", "column", "container", "content", "count", "desktop", "footer", "global",
    "group", "header", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "mobile", "outer", "page", "panel", "post", "posts", "primary", "right",
    "row", "secondary", "section", "site", "slot", "stories", "story", "thread", "top", "unit", "view", "wrap", "wrapper", "zone",
}
PAGE_HEADERS = {"header"}
#: Blocks that stay in the article even if all their text is a link, unless a list holds them.
FIRM = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
#: Paths that a page votes for, paths that a host keeps, and the bound under which winners are broadcast.
VOTES, WINNERS, BROADCAST_ROWS = 3, 3, 100_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
#: The host of a url that names one, in lower case; for Spark.
HOST = r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]*)"
#: A paragraph or list item ends where another begins, whether it was closed or not.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def host_of(url: Column) -> Column:
    """Empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def attributes(raw: str) -> dict[str, str]:
    if not raw.strip():
        return {}
    return {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(raw)}


def step(tag: str, attrs: dict[str, str]) -> str:
    """A container in a path: its tag, and its classes or else its id with digits generalised."""
    names = sorted(set((attrs.get("class") or attrs.get("id") or "").lower().split()))
    return ".".join([tag, *(re.sub(r"\d+", "#", n) for n in names)])


def skipped(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    if tag in SKIP_TAGS or (tag in PAGE_HEADERS and not inside_article) or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if (attrs.get("role") or "").lower() in SKIP_ROLES or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main", "article", "h1"):
        return False
    return any(boilerplate(name) for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split())


@lru_cache(maxsize=1 << 14)
def boilerplate(name: str) -> bool:
    words = {w.lower() for w in WORD.findall(name)}
    return not words.isdisjoint(SKIP_WORDS) and words <= SKIP_WORDS | PLACE_WORDS


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, int, bool, str]]:
    """(path of containers, text, characters in links, in a paragraph or heading, kind) of each block that may be text.
    Kind: ``links`` for a row without a letter or digit outside its links, ``item`` for such an item of a list, and
    empty for any other block; paragraphs, headings and quotations are others, unless they stand in a list."""
    stack: list[tuple[str, str | None]] = []  # open elements; a step for containers
    skip_from: int | None = None
    text: list[str] = []
    free: list[str] = []  # what of it isn't in links
    linked = links = 0
    prose = firm = False
    at, end = 0, len(page)

    def flush():
        nonlocal text, free, linked
        whole = " ".join(html.unescape("".join(text)).split()) if text else ""
        n, outside, text, free, linked = linked, free, [], [], 0
        if whole:
            listed = any(t == "li" for t, _ in stack)
            held = listed or firm or any(t == "blockquote" for t, _ in stack)
            bare = n > 0 and not any(c.isalnum() for c in html.unescape("".join(outside)))
            kind = "" if not bare or (held and not listed) else "item" if listed else "links"
            yield tuple(s for _, s in stack if s), whole, min(n, len(whole)), prose, kind

    while at < end:
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and skip_from is None:
            text.append(piece)
            if links:
                linked += len(piece.strip())
            else:
                free.append(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and skip_from is None:
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
                if not links:
                    free.append(text[-1])
            continue
        if not m[1]:
            if tag in BLOCK or tag == "head":
                yield from flush()
            if tag in ("br", "wbr", "img"):
                if tag == "br" and skip_from is None:
                    text.append(" ")
                continue
            if tag in VOID or (m[3].endswith("/") and tag not in BLOCK | RAW):
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else end
                continue
            if tag == "body":
                # a head that was never closed ends here
                while stack and stack[-1][0] != "html":
                    stack.pop()
                if skip_from is not None and len(stack) <= skip_from:
                    skip_from = None
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "div", "article", "section"):
                        break
                if skip_from is not None and len(stack) <= skip_from:
                    skip_from = None
            attrs = attributes(m[3])
            if skip_from is None and skipped(tag, attrs, any(t in ("article", "main") for t, _ in stack)):
                skip_from = len(stack)
            if tag in BLOCK or tag in SKIP_TAGS or tag == "a" or skip_from == len(stack):
                if tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "hr"):
                    stack.append((tag, step(tag, attrs) if tag in HOLDS else None))
                elif skip_from == len(stack):
                    stack.append((tag, None))
            if tag == "a":
                links += 1
            prose = tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li") if tag in BLOCK else prose
            firm = tag in FIRM if tag in BLOCK else firm
        else:
            if tag in BLOCK or tag == "head":
                yield from flush()
                prose = firm = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            if tag == "a" and links:
                links -= 1
            if skip_from is not None and len(stack) <= skip_from:
                skip_from = None
    yield from flush()


def path_scores(page: str | None) -> dict[str, float]:
    """Score of each container path: text of blocks in it that isn't links, paragraphs counting in full and other
    text by a half, less for each level that separates them. ``article`` and ``main`` count for more."""
    scores: dict[str, float] = {}
    for path, text, linked, prose, _ in blocks(page or ""):
        worth = (len(text) - 2 * linked) * (1.0 if prose else 0.5)
        for up in range(min(3, len(path))):
            inner = path[len(path) - 1 - up]
            gain = 1.5 if inner.split(".")[0] in ("article", "main") else 0.5 if inner in ("html", "body") else 1.0
            key = ">".join(path[: len(path) - up])
            scores[key] = scores.get(key, 0.0) + worth * gain * 0.8**up
    return scores


def inside(path: tuple[str, ...], container: str) -> bool:
    whole = ">".join(path)
    return whole == container or whole.startswith(container + ">")


def reads_like_text(some: list) -> bool:
    """Mostly paragraphs, and few links."""
    size = sum(len(text) for _, text, *_ in some)
    return 2 * sum(len(text) for _, text, _, prose, _ in some if prose) > size and 5 * sum(linked for _, _, linked, *_ in some) < size


def extract(page: str | None, winners: list[str]) -> str:
    """Blocks within the first of ``winners`` that the page has, and within others of them beside it if they read like
    text; where it has none, within its own best container."""
    found = list(blocks(page or ""))
    if not found:
        return ""
    held = {w: [inside(b[0], w) for b in found] for w in winners}
    mine = [w for w in winners if any(held[w])]
    if mine:
        chosen = mine[0]
        beside = [w for w in mine[1:] if w.rpartition(">")[0] == chosen.rpartition(">")[0] and reads_like_text([b for b, h in zip(found, held[w]) if h])]
        kept = [b for k, b in enumerate(found) if any(held[w][k] for w in (chosen, *beside))]
    else:
        scores = path_scores(page)
        chosen = max(scores, key=lambda p: (scores[p], -len(p), p), default="")
        chosen = chosen if chosen and scores[chosen] > 0 else ""
        kept = [b for b in found if not chosen or inside(b[0], chosen)]
    # a row of links is a menu wherever it stands, and a list of links where nothing but the page holds it
    whole_page = chosen.split(">")[-1] in ("", "html", "body")
    return "\n\n".join(text for _, text, _, _, kind in kept if not kind or (kind == "item" and not whole_page))


@lean
def _votes(batches):
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            scores = path_scores(page)
            best = max(scores.values(), default=0.0)
            for path in sorted(scores, key=lambda p: (-scores[p], p))[:VOTES]:
                if scores[path] > 0:
                    for column, value in zip(out, (host, path, scores[path] / best)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["host", "path", "vote"])


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, winners: its paths by votes. Votes are summed per task before they are shuffled; a host has few paths."""
    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_votes, "host string, path string, vote double")
    # whole thousandths, so that sums don't depend on their order
    summed = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("vote") * 1000).cast("long")).alias("votes"))
    top = summed.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("rank") <= WINNERS)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("winners"))


@lean
def _extract(batches):
    for batch in batches:
        texts = [extract(page, winners or []) for page, winners in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    Null and empty html gives empty text. Pages without a usable url vote together, as one host. Rows with
    equal ids are pages of their own. Winners are broadcast while hosts are few, and joined by host otherwise.
    Other columns are not read. An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "html-text")
    winners = scratch.save(winning_paths(pages, url_col, html_col), "winners")
    small = winners.count() <= BROADCAST_ROWS
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    met = source.join(F.broadcast(winners) if small else winners, "host", "left").select("id", "url", "html", "winners")
    return met.mapInArrow(_extract, "id bigint, url string, text string, n_chars bigint")
