"""Main text of web pages: what the markup says, and a suffix array of each host for the rest.

Elements decide first.  Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments are left out by their names, roles and classes; where a page
marks its article (or its main part), that is the main text.

What the markup doesn't tell, the host does.  The token streams of all pages of a host
are one text, and its suffixes, by their first ``LONG`` words, show which long substrings
occur on many distinct pages.  A substring that also stands outside any article is page
furniture; words covered by it are taken out and unique runs stay.

Not every suffix is shuffled.  Any ``LONG`` words hold ``LONG - PART + 1`` runs of ``PART``
words, and the one with the smallest hash is their anchor: equal substrings have equal
anchors, so a substring is on no more pages than its anchor.  Anchors are counted first
(a page has about one for seven words), and only suffixes whose anchor is on enough pages
are counted themselves, each of them, so a common run goes from its first word to its last.

Ordering all suffixes of a host in one place would not hold for a large host.  Only
suffixes with equal first words have to stand together, so these are what is shuffled,
and what is counted is combined before.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.llm.common import tidied, whole_texts
from cellfold.runtime import written

#: Words of a substring that counts as long, and of the runs of which one is its anchor.
LONG, PART = 24, 12
#: Distinct pages, and share of the host's distinct pages, that make a substring furniture;
#: on so many pages it is furniture whatever the share.
PAGES, SHARE, MANY = 5, 0.2, 100

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)

#: Element names as HTML has them.
RAW = {"script", "style", "noscript", "textarea", "title", "template", "iframe", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
""".split())
LEFT_OUT = {"nav", "footer", "aside", "form", "head", "menu", "button", "select", "dialog", "object"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}
#: Words in a class or id that name page furniture.
FURNITURE = set("""ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices
popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs
pagination pager sidebar sidebars widget menu nav navbar navigation masthead footer comment comments disqus replies reply toolbar
skip alert
""".split())
#: Words that may stand beside them in such a name: site-footer, related-posts.
BESIDE = set("""site page top bottom left right box bar block list wrap wrapper container section area primary secondary global local inner
outer post posts article articles link links item items button buttons slot unit zone icon icons col column row header main text form
""".split())
#: Words that make a name a statement about the element: has-sidebar.
STATING = set("has have with without no not of on in is and or for to".split())


def names_furniture(value: str) -> bool:
    """Whether one of the names in a class or id is one of furniture: as a whole or by what
    it ends with (user-comments), not by any word in it (has-sidebar, notice-of-motion)."""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if FURNITURE.isdisjoint(words) or not STATING.isdisjoint(words):
            continue
        if words[-1] in FURNITURE or FURNITURE | BESIDE >= set(words):
            return True
    return False


def is_left_out(name: str, tag: str, in_article: bool) -> bool:
    if name in LEFT_OUT or (name == "header" and not in_article):
        return True
    for key, value in ATTRIBUTE.findall(tag):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id") and name not in ("body", "html", "main", "article") and names_furniture(value):
            return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """``(zone, text)`` of each block in page order; zones are article, main, body and out.
    What is left out within a block is skipped."""
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    zone = "body"

    def end_block():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((zone, text))
            parts.clear()

    page, place = page or "", 0
    while place < len(page):
        token = TOKEN.match(page, place).group()
        place += len(token)
        if token[0] != "<" or len(token) == 1:
            if zone != "skipped":
                parts.append(token)
            continue
        named = NAME.match(token)
        if not named:
            continue
        name, closing = named.group(1).lower(), token[1] == "/"
        if name in BLOCK:
            end_block()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    zone = stack[-1][1] if stack else "body"
                    break
        elif name in RAW:
            if not token.endswith("/>"):  # only its own end tag ends it
                end = re.compile(f"</{name}", re.I).search(page, place)
                place = end.start() if end else len(page)
        elif name == "br":
            parts.append(" ")
        elif name not in VOID and not token.endswith("/>"):
            if name in BLOCK:  # a block ends an open paragraph
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        zone = stack[-1][1] if stack else "body"
                        break
                    if stack[k][0] in BLOCK:
                        break
            if zone not in ("out", "skipped"):
                if is_left_out(name, token, zone == "article"):
                    zone = "out" if name in BLOCK else "skipped"
                elif name == "article":
                    zone = "article"
                elif name == "main" and zone != "article":
                    zone = "main"
            stack.append((name, zone))
    end_block()
    return found


def runs(own: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of so many words, from a hash of each word."""
    found, n = np.zeros(len(own) - length + 1, np.uint64), len(own) - length + 1
    for k in range(length):
        found = found * np.uint64(0x9E3779B97F4A7C15) + own[k:k + n]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ found >> np.uint64(32)


def suffixes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word that ``LONG`` words start at, a hash of them and their anchor."""
    if len(words) < LONG:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    anchors = np.lib.stride_tricks.sliding_window_view(runs(own, PART), LONG - PART + 1).min(axis=1)
    return runs(own, LONG).view(np.int64), anchors.view(np.int64)


def stream(blocks: list[tuple[str, str]]) -> tuple[list[str], list[int]]:
    """The page's words, and each one's block."""
    words, at = [], []
    for k, (_, text) in enumerate(blocks):
        own = text.split()
        words += own
        at += [k] * len(own)
    return words, at


def main_text(blocks: list[tuple[str, str]], furniture: set[int]) -> str:
    zones = {z for z, _ in blocks}
    zone = next((z for z in ("article", "main", "body") if z in zones), None)
    chosen = [k for k, (z, _) in enumerate(blocks) if z == zone]
    if not furniture:
        return "\n".join(blocks[k][1] for k in chosen)
    words, at = stream(blocks)
    covered = bytearray(len(words))
    for k, key in enumerate(suffixes(words)[0].tolist()):
        if key in furniture:
            covered[k:k + LONG] = b"\1" * LONG
    kept: dict[int, list[str]] = {k: [] for k in chosen}
    for word, k, gone in zip(words, at, covered):
        if k in kept and not gone:
            kept[k].append(word)
    return "\n".join(" ".join(w) for w in kept.values() if w)


def host(url: str | Column) -> Column:
    """The host of an address, lower-cased; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _rows(frames: Iterator[pd.DataFrame], dense: bool) -> Iterator[pd.DataFrame]:
    """A page's anchors, or its suffixes with an anchor in ``asked``: once each, and
    whether ``LONG`` words of it start outside an article."""
    def joined(parts):
        lengths = [len(found) for found, *_ in parts]
        at, page, of = (np.repeat(np.array(x, np.int64), lengths) for x in list(zip(*parts))[2:])
        return pd.DataFrame({"at": at, "key": np.concatenate([p[0] for p in parts]), "page": page,
                             "outside": np.concatenate([p[1] for p in parts]), "of": of})

    for frame in frames:
        parts, count = [], 0
        for host_, page, of, asked in zip(frame["at"], frame["html"], frame["of"], frame["asked"]):
            blocks = blocks_of(page)
            words, at = stream(blocks)
            keys, anchors = suffixes(words)
            if not len(keys):
                continue
            seen = xxhash.xxh64_intdigest("\n".join(t for z, t in blocks if z != "out")) - (1 << 63)
            zones = np.array([z not in ("article", "main") for z, _ in blocks])[np.array(at[:len(keys)])]
            if dense:
                met = np.isin(anchors, np.array(asked, np.int64))
                keys, zones = keys[met], zones[met]
            else:
                keys = anchors
            found, where = np.unique(keys, return_inverse=True)
            parts.append((found, np.bincount(where, zones, len(found)) > 0, host_, seen, of))
            count += len(found)
            if count > 20_000:
                yield joined(parts)
                parts, count = [], 0
        if parts:
            yield joined(parts)


def _rows_of(marked: DataFrame, dense: bool) -> DataFrame:
    return marked.mapInPandas(tidied(lambda frames: _rows(frames, dense)), "at long, key long, page long, outside boolean, of long")


def _often(rows: DataFrame, total: DataFrame) -> DataFrame:
    """``at, key`` of what is on enough distinct pages of its host."""
    once = rows.groupBy("at", "key", "page").agg(F.max("outside").alias("outside"))
    counts = once.groupBy("at", "key").agg(F.count("*").alias("pages"), F.max("outside").alias("outside"))
    enough = (F.col("pages") >= SHARE * F.col("total")) | (F.col("pages") >= MANY)
    return counts.where(F.col("outside") & (F.col("pages") >= PAGES)).join(total, "at").where(enough).select("at", "key")


def by_page(rows: DataFrame, often: DataFrame, name: str) -> DataFrame:
    """``_of`` and the keys among ``often`` of each page: no more than the page has words."""
    met = rows.select("of", "at", "key").join(often, ["at", "key"])
    return written(met.groupBy(F.col("of").alias("_of")).agg(F.collect_set("key").alias(name)), name)


def furniture(pages: DataFrame) -> DataFrame:
    """``_of, keys``: for pages that hold any (``_of`` hashes host and html), hashes of the
    long substrings that are furniture of the host.

    Pages with the same text outside furniture count once, those of fewer than ``LONG``
    words never.
    """
    at = host("url")
    marked = pages.select(F.xxhash64(at).alias("at"), "html", F.xxhash64(at, "html").alias("of"))
    none = F.lit(None).cast("array<long>").alias("asked")
    rows = written(_rows_of(marked.select("*", none), False), "anchors")
    total = written(rows.select("at", "page").distinct().groupBy("at").agg(F.count("*").alias("total")), "totals")
    asked = by_page(rows, written(_often(rows, total), "often"), "asked")
    dense = written(_rows_of(marked.join(asked, F.col("of") == F.col("_of")).drop("_of"), True), "suffixes")
    return by_page(dense, written(_often(dense, total), "long"), "keys")


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (``page_id, url, html`` and any others) with ``text`` and ``n_chars`` for ``html``.

    Blocks are joined by \\n, white space in a block is one space, character references are
    decoded.  A null, empty or furniture-only page has an empty text; a null or odd address
    belongs to the host without a name.  Repeated rows stay.  Columns called ``text`` or
    ``n_chars`` are replaced.
    """
    kept = [f for f in pages.schema if f.name not in ("html", "text", "n_chars")]
    known = furniture(whole_texts(pages))
    joined = pages.join(known, F.xxhash64(host("url"), "html") == F.col("_of"), "left").select(*(f.name for f in kept), "html", "keys")

    def run(frames):
        import pyarrow as pa

        for batch in frames:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(blocks_of(page), set(keys or ())) for page, keys in
                         zip(part.column("html").to_pylist(), part.column("keys").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(texts, pa.string())],
                                                 [*(f.name for f in kept), "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string"])
    return joined.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
