"""Main text of web pages by consensus of each host.

Every page scores its containers; the best one's generalised path (tags and
classes from the root, digits folded) is the page's vote. Spark counts the votes
per host, and each page is extracted again with its host's winning path, or with
its own best container where the path does not occur.

A null or empty html gives an empty text; a null or odd url belongs to the host
''. Repeated rows vote and are extracted like any others. Broken markup is read
leniently: an end tag without a start is ignored, an open element ends with its
parent, an unfinished script swallows the rest. Formulas, drawings and what stands
in for objects and scripts are text like other; scripts, styles, titles and controls
are none. An empty table gives no rows. Of equally good containers of a page the first
counts, of equally many votes the higher score, then the path that sorts last. Very long
pages are read whole.
Only page_id, url and html are read, so extra columns cannot clash.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast, staged

RAW = r"script|style|textarea|title|template|iframe|select|button|noframes"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:!\[CDATA\[.*?\]\]>|[!?][^>]*>)"
    rf"|<(?:{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?:{RAW})\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
RAW_START = re.compile(rf"<({RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
CONTAINERS = frozenset(
    "html body main article section div td th table tbody tr ul ol dl li dd blockquote figure details center "
    "nav header footer aside form dialog menu address fieldset".split()
)
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre dt hr caption figcaption summary thead tfoot legend hgroup".split())
DROPPED = frozenset("nav footer aside form dialog menu fieldset head".split())
VOTED = frozenset("html body main article section div td center blockquote".split())
# words in a class, id or role that mark what is not article text
STRONG = frozenset(
    "nav navbar navigation menu footer footnav masthead ad ads advert adverts advertisement advertising adbox adslot "
    "sponsor sponsored promo promotion cookie cookies consent gdpr comment comments commentlist disqus replies respond "
    "share sharing social related recommended newsletter subscribe subscription signup breadcrumb breadcrumbs "
    "pagination pager popup modal widget widgets contentinfo complementary skip toolbar login".split()
)
WEAK = frozenset("sidebar side aside header banner notice notices alert search hidden copyright legal disclaimer warning bar".split())
CONTENT = frozenset("content main article post entry body text story page with has no wrapper container layout".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def attributes(text: str) -> dict[str, str]:
    found = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), value.strip("\"'"))
    return found


def is_clutter(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main", "article") and "comment" not in attrs.get("class", "").lower():
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}"
    if not names.strip():
        return False
    words = {w.lower() for w in NAME_PARTS.findall(names)}
    if words & STRONG:
        return True
    return bool(words & WEAK) and not words & CONTENT and not in_article


def generalised(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "0", c) for c in attrs.get("class", "").split()})
    return ".".join([tag, *classes])


def parsed(html: str):
    """Containers as lists (parent, tag, path, clutter) and blocks (container, text, text outside links)."""
    parent, tags, paths, clutter = [-1], [""], [""], [False]
    stack = [0]
    blocks: list[tuple[int, str, int]] = []
    text: list[str] = []
    links = linked = 0  # open links, characters in them since the last block

    def close_block():
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                blocks.append((stack[-1], joined, max(0, len(joined) - linked)))
            text.clear()
        linked = 0

    def add(piece):
        nonlocal linked
        if "&" in piece:
            piece = entities.unescape(piece)
        text.append(piece)
        if links:
            linked += len(piece)

    at, article = 0, 0  # article: open article or main elements
    for token in TOKEN.finditer(html):
        if token.start() < at:
            continue
        if token.start() > at:
            add(html[at : token.start()])
        at = token.end()
        tag = token[2] or token[5]
        if not tag:
            raw = RAW_START.match(html, token.start())
            if raw:  # its own end tag, whatever other raw tags it holds
                end = re.compile(rf"</{raw[1]}\s*>", re.I).search(html, raw.end())
                at = end.end() if end else len(html)
            continue
        tag = tag.lower()
        ends = bool(token[1] or token[4])
        if tag == "a":
            links = max(0, links + (-1 if ends else 1))
        elif tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        close_block()
        if tag not in CONTAINERS:
            continue
        if ends:
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] == tag:
                    del stack[depth:]
                    break
            article = sum(tags[c] in ("article", "main") for c in stack)
            continue
        if tag == "li":  # a new item ends the one before
            if tags[stack[-1]] == "li":
                stack.pop()
        attrs = attributes(token[3] or token[6] or "")
        own = len(parent)
        up = stack[-1]
        parent.append(up)
        tags.append(tag)
        paths.append(f"{paths[up]}>{generalised(tag, attrs)}")
        clutter.append(clutter[up] or is_clutter(tag, attrs, article > 0))
        if not (token[3] or token[6] or "").endswith("/"):
            stack.append(own)
            article += tag in ("article", "main")
    if at < len(html):
        add(html[at:])
    close_block()
    return (parent, tags, paths, clutter), blocks


def best_container(containers, blocks) -> tuple[int, float]:
    """The container with most text outside links, counted less the farther below it stands."""
    parent, tags, _, clutter = containers
    scores = [0.0] * len(parent)
    for container, _, plain in blocks:
        if clutter[container]:
            continue
        share, c = 1.0, container
        while c >= 0 and share > 0.05:
            if c == 0 or tags[c] in VOTED:
                scores[c] += plain * share
                share *= 0.6
            c = parent[c]
    for c, tag in enumerate(tags):
        if tag in ("article", "main"):
            scores[c] *= 1.8
    best = max(range(len(scores)), key=lambda c: (scores[c], -c))
    return best, scores[best]


def text_under(containers, blocks, roots: set[int]) -> str:
    parent, _, _, clutter = containers
    inside = [False] * len(parent)
    for c in range(len(parent)):  # parents come before children
        inside[c] = c in roots or (parent[c] >= 0 and inside[parent[c]])
    return "\n\n".join(t for c, t, _ in blocks if inside[c] and not clutter[c])


def vote(html: str) -> tuple[str, float]:
    containers, blocks = parsed(html)
    best, score = best_container(containers, blocks)
    return containers[2][best], score


def extract(html: str, path: str | None) -> str:
    containers, blocks = parsed(html)
    roots = {c for c, p in enumerate(containers[2]) if p == path and not containers[3][c]}
    found = text_under(containers, blocks, roots) if roots else ""
    return found or text_under(containers, blocks, {best_container(containers, blocks)[0]})


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def winning_paths(pages: DataFrame) -> DataFrame:
    """Rows (host, path): the container path that most pages of a host vote for."""

    def votes(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                path, score = vote(html.as_py() or "")
                if score:
                    rows.append((host_of(url), path, int(score)))
            columns = list(zip(*rows)) or [[]] * 3
            kinds = [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "path", "score"])

    counted = (
        pages.select("url", "html")
        .mapInArrow(votes, "host string, path string, score long")
        .groupBy("host", "path")
        .agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    )
    return counted.groupBy("host").agg(F.max(F.struct("votes", "score", "path"))["path"].alias("path"))


def main_text(pages: DataFrame, salts: int = 16) -> DataFrame:
    """Per page page_id, url, text (empty if none), n_chars."""
    winners = staged(winning_paths(pages), "host-paths")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    side = sized_broadcast(winners)
    if side is winners:  # too many hosts to send around: split hot hosts over salts
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
        side = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("long"))
        joined = rows.join(side, ["host", "salt"], "left")
    else:
        joined = rows.join(side, "host", "left")

    def texts(batches):
        import pyarrow as pa

        for batch in batches:
            found = [
                extract(h.as_py() or "", p) for h, p in zip(batch.column(2), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(found, pa.string()),
                    pa.array(list(map(len, found)), pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.select("page_id", "url", "html", "path").mapInArrow(
        texts, "page_id long, url string, text string, n_chars long"
    )
