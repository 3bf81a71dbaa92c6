"""Main text of web pages: markup that names its role is followed, and repeated runs of a host's other text are removed.

Blocks inside an article (or main element) are text, and blocks inside menus, footers, adverts, forms and the like are not.
What markup leaves open, and parts of an article whose names only hint at boilerplate, is decided per host: the token streams of all
blocks of its pages go into a suffix array whose ranks come from prefix doubling, until nothing longer is shared. A stretch of RUN
tokens or more that LEAST_PAGES pages of different content share outside articles is boilerplate, unless as many pages have it in
articles alone. What such stretches cover goes, unique runs and the articles' own stretches stay.
"""

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.suffixes import ranked
from logsieve.llm.work import spread_join, stored

#: Tokens that a repeated stretch has at least; a block's edges count as tokens.
RUN = 6
#: Pages of different content that share a stretch of boilerplate at least; two may be versions of one page.
LEAST_PAGES = 3
#: Hosts with a page to decide are first told by a remainder of their hash, which bounds what is broadcast.
HOST_BUCKETS = 1 << 18

#: HINTED: inside an article, with a name that may mean boilerplate or may be the article's own.
BOILERPLATE, UNDECIDED, ARTICLE, HINTED = 0, 1, 2, 3

# Elements and names with a known role.
UNSEEN = {"head", "title", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "math"}
OUTER = {"nav", "aside", "footer", "form", "button", "select", "textarea", "dialog", "menu", "option", "header"}
ROOTS = {"article", "main"}
BLOCKS = {
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "caption", "tr", "blockquote", "pre",
    "section", "article", "main", "figure", "figcaption", "hr", "address", "body", "html", "details", "summary", "center",
} | OUTER | UNSEEN
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
SECTIONS = ROOTS | OUTER | UNSEEN | {"body", "table"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "menu",
    "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "masthead", "header", "footer", "cookie", "cookies", "consent", "notice", "popup",
    "modal", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "comment", "comments", "reply", "replies",
    "disqus", "widget", "toolbar", "pagination", "pager", "login",
}
# Of these, names that mean boilerplate as a part of a longer class name too, wherever it stands.
ALWAYS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored", "cookie", "cookies", "newsletter", "subscribe", "signup", "navbar",
    "breadcrumb", "breadcrumbs", "comment", "comments", "disqus", "pagination", "toolbar", "popup",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\b(hidden)\b")
_NAME = re.compile(r"[a-z0-9]+")


def _marked(tag: str, attributes: str, in_article: bool) -> int | None:
    """BOILERPLATE if class, id, role or visibility says that an element is not main text, HINTED if it may be, or None.

    Inside an article a heading is never boilerplate by its name. A whole class name or id counts there, and a part of a class name
    if it has no other use; other parts ("related-work", "notice-period") are hints.
    """
    if tag in ("html", "body") or tag in ROOTS:
        return None
    hinted = None
    for key, value, hidden in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if hidden or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return BOILERPLATE
        if key == "role" and value in ROLES:
            return BOILERPLATE
        if key in ("class", "id"):
            names = NAMES.intersection(_NAME.findall(value))
            if names and not in_article:
                return BOILERPLATE
            names.discard("header")
            if names and tag not in HEADINGS:
                if tag != "p" and names.intersection(value.split()) or key == "class" and names & ALWAYS:
                    return BOILERPLATE
                hinted = HINTED
    return hinted


class _Open:
    """The open elements, each with the kind of text inside it (-1: unseen), and how many of a name are open.

    Counts are kept per section, so that an end tag without a start costs no search of the elements below it.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.sections: Counter[str] = Counter()
        self.small: list[Counter[str]] = [Counter()]

    def push(self, tag: str, kind: int) -> None:
        self.stack.append((tag, kind))
        if tag in SECTIONS:
            self.sections[tag] += 1
            self.small.append(Counter())
        else:
            self.small[-1][tag] += 1

    def close(self, tag: str) -> int:
        """Close the innermost open ``tag``, and what is open inside it; small elements do not close the section around them."""
        section = tag in SECTIONS
        found = self.sections[tag] if section else self.small[-1][tag]
        while found:
            name, _ = self.stack.pop()
            if name in SECTIONS:
                self.sections[name] -= 1
                self.small.pop()
            else:
                self.small[-1][name] -= 1
            if name == tag:
                break
        return self.stack[-1][1] if self.stack else UNDECIDED


def blocks_of(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of every block with text, in page order. A '<' that opens no tag is text."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    open_, kind, at = _Open(), UNDECIDED, 0

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text and kind >= 0:
                out.append((kind, text))
            held.clear()

    source = html or ""
    for found in _TAG.finditer(source):
        if found.start() > at and kind >= 0:
            held.append(source[at : found.start()])
        at = found.end()
        tag = found[3]
        if tag is None:  # comment, declaration, or an element with its content
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            held.append(" ")
        if tag in VOID:
            continue
        if found[2]:
            kind = open_.close(tag)
            continue
        if tag == "body" or tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_.stack and open_.stack[-1][0] == tag:
            kind = open_.close("head" if tag == "body" else tag)
        if kind > BOILERPLATE:
            inside = kind != UNDECIDED
            marked = _marked(tag, found[4], inside) if found[4] else None
            if tag in UNSEEN:
                kind = -1
            elif tag in OUTER and not (tag == "header" and inside):
                kind = BOILERPLATE
            elif marked is not None:
                kind = marked
            elif not inside and (tag in ROOTS or "main" in found[4] and re.search(r"role\s*=\s*[\"']?main\b", found[4])):
                kind = ARTICLE
        open_.push(tag, kind)
    if at < len(source) and kind >= 0:
        held.append(source[at:])
    flush()
    return out


def _stream(texts: list[str]) -> list[int]:
    """Token hashes of blocks, an edge token before and after each."""
    tokens = [0]
    for text in texts:
        tokens += [xxhash.xxh3_64_intdigest(w.lower()) - (1 << 63) for w in text.split()]
        tokens.append(0)
    return tokens


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        blocks = [blocks_of(h) for h in frame["html"]]
        to_decide = [any(k in (UNDECIDED, HINTED) for k, _ in b) for b in blocks]
        yield pd.DataFrame(
            {
                "page_id": frame["page_id"], "url": frame["url"], "page": frame["page"], "host": frame["host"], "open": to_decide,
                "content": [xxhash.xxh3_64_intdigest("\n".join(t for _, t in b)) - (1 << 63) for b in blocks],
                "kinds": [[k for k, _ in b] for b in blocks], "texts": [[t for _, t in b] for b in blocks],
            }
        ).astype({"page_id": "Int64"})


def _streams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens of a page: first those of its ``others``, the blocks that are no article, then those of its articles."""
    for frame in frames:
        blocks = [list(zip(k, t)) for k, t in zip(frame["kinds"], frame["texts"])]
        other = [_stream([t for k, t in b if k != ARTICLE]) for b in blocks]
        article = [_stream([t for k, t in b if k == ARTICLE]) for b in blocks]
        tokens = [np.array(o + a, np.int64) for o, a in zip(other, article)]
        yield frame[["host", "page", "content"]].assign(others=[len(o) for o in other], tokens=tokens)


def shared_stretches(tokens: DataFrame, run: int = RUN, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page, at, length, own): the longest stretch from every place outside articles that ``least_pages`` contents of one host have there.

    ``tokens``: host, page, content, at, token, article, one row per place. ``own``: as many contents have the stretch in articles alone.
    Prefix doubling: the rank of a suffix's first 2h tokens comes from the ranks of h tokens at ``at`` and ``at + h``; the step
    to ``run`` overlaps. Suffixes that too few contents share outside articles leave at every step, and the doubling goes on until none
    is left, so ``length`` is the largest of run, 2 run, 4 run, ... that the common prefix has. A stretch of any length between is
    covered by those that start at its places.
    """
    keyed = tokens.withColumn("key", F.struct("host", "token")).drop("host", "token")
    outside = F.when(~F.col("article"), F.col("content"))
    done, found = 1, []
    while True:
        if done < run:
            groups = keyed.groupBy("key").agg(F.min(outside).alias("low"), F.max(outside).alias("high")).where("low != high")
            groups = groups.select("key", F.lit(False).alias("own"))
        else:
            per_content = keyed.groupBy("key", "content").agg(F.min("article").alias("article"))
            groups = per_content.groupBy("key").agg(F.count_if(~F.col("article")).alias("n"), F.count_if("article").alias("articles"))
            groups = groups.where(F.col("n") >= least_pages).select("key", (F.col("articles") >= F.col("n")).alias("own"))
        # stored, since dealing by range reads the keys twice and the join reads the pairs again
        ranks = spread_join(keyed, ranked(stored(groups, "groups"), "key"), "key").select("page", "content", "at", "article", "own", "rank")
        ranks = stored(ranks, "suffixes")
        if done >= run:
            found.append(ranks.where("not article").select("page", "at", F.lit(done).alias("length"), "own"))
        if ranks.isEmpty():
            break
        step = done if done >= run else min(done, run - done)
        then = ranks.select("page", (F.col("at") - step).alias("at"), F.col("rank").alias("then"))
        keyed = stored(ranks.join(then, ["page", "at"]).select("page", "content", "at", "article", F.struct("rank", "then").alias("key")), "pairs")
        done += step
    if not found:
        return ranks.select("page", "at", F.lit(done).alias("length"), "own")
    longest = reduce(DataFrame.unionByName, found).groupBy("page", "at").agg(F.max(F.struct("length", "own")).alias("longest"))
    return longest.select("page", "at", "longest.length", "longest.own")


def parts_to_go(at: list[int], length: list[int], own: list[bool]) -> list[int]:
    """Where parts of RUN tokens begin that lie in a shared stretch and in none of the articles' own."""
    at, length, own = np.asarray(at, np.int64), np.asarray(length, np.int64), np.asarray(own, bool)
    if not len(at):
        return []
    size, inside = int((at + length).max()) + 1, []
    for chosen in (~own, own):
        change = np.zeros(size, np.int64)
        np.add.at(change, at[chosen], 1)
        np.add.at(change, (at + length)[chosen] - RUN + 1, -1)
        inside.append(change.cumsum() > 0)
    return np.flatnonzero(inside[0] & ~inside[1]).tolist()


def _unique_runs(kinds: pd.Series, texts: pd.Series, at: pd.Series, length: pd.Series, own: pd.Series) -> pd.Series:
    return pd.Series([kept_text(list(zip(k, t)), parts_to_go(*s)) for k, t, *s in zip(kinds, texts, at, length, own)], dtype=object)


def kept_text(blocks: list[tuple[int, str]], starts: list[int]) -> str:
    """Article blocks and what is left of the others, given where shared parts of RUN tokens begin in the stream of the others.

    A block to decide goes when stretches cover all of it. Otherwise an undecided one loses the stretches that lie inside it, and a hinted
    one stays. A page without an article, and with fewer than RUN words that are its own, is a version of other pages: its
    undecided text stays whole.
    """
    words = {i: text.split() for i, (kind, text) in enumerate(blocks) if kind != ARTICLE}
    places, size = [], 1
    for i, w in words.items():
        if blocks[i][0] != BOILERPLATE:
            places.append((i, size))
        size += len(w) + 1
    covered, begins = np.zeros(size, bool), np.asarray(starts, np.int64)
    for i in range(RUN):
        covered[begins + i] = True
    flags = {}
    for i, first in places:
        last = first + len(words[i])
        flags[i] = covered[first:last].copy()
        if not flags[i].all():
            flags[i][:] = False
            if blocks[i][0] == UNDECIDED:
                for a in begins[(begins >= first) & (begins + RUN <= last)] - first:
                    flags[i][a : a + RUN] = True
    own = sum(int((~f).sum()) for f in flags.values())
    if own < RUN and not any(k in (ARTICLE, HINTED) for k, _ in blocks):
        flags = {}
    out = []
    for i, (kind, text) in enumerate(blocks):
        if kind == BOILERPLATE:
            continue
        if i in flags:
            text = " ".join(w for w, gone in zip(words[i], flags[i]) if not gone)
        if text:
            out.append(text)
    return "\n\n".join(out)


PARSED = "page_id long, url string, page binary, host string, open boolean, content long, kinds array<int>, texts array<string>"


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (blocks joined by two line ends), n_chars (code points).

    Pages are parsed once. Only hosts with a page to decide have a suffix array, of all blocks of all their pages; the texts of
    other hosts are not shuffled. A host or a stretch with a third of all rows is spread over tasks. Exact copies of a page
    are one page to this rule.

    Character references are decoded, white space inside a block becomes one space. A null or empty page has an empty text, as
    has one without any. A null url is one host. Repeated rows get the same text each. An empty table gives an empty
    result. Other columns are ignored.
    """
    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    page = F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))).cast("binary")))
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), page.alias("page"), host.alias("host"), F.coalesce(html, F.lit("")).alias("html"))
    parsed = stored(rows.mapInPandas(_parse, PARSED), "pages")
    undecided = parsed.where("open")
    # every block of a settled page has its role from markup
    article = F.filter("texts", lambda _, i: F.element_at("kinds", i + 1) == ARTICLE)
    settled = parsed.where("not open").select("page_id", "url", F.array_join(article, "\n\n").alias("text"))

    hosts = stored(undecided.select("host").distinct(), "hosts")
    bucket = F.pmod(F.xxhash64("host"), F.lit(HOST_BUCKETS))
    near = parsed.withColumn("bucket", bucket).join(F.broadcast(hosts.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi")
    evidence = spread_join(near.select("host", "page", "content", "kinds", "texts"), hosts, "host").dropDuplicates(["page"])
    streams = evidence.mapInPandas(_streams, "host string, page binary, content long, others int, tokens array<long>")
    tokens = streams.select("host", "page", "content", "others", F.posexplode("tokens").alias("at", "token")).withColumn("article", F.col("at") >= F.col("others"))
    # a place is left out between the two streams of a page
    tokens = stored(tokens.withColumn("at", F.col("at") + F.col("article").cast("int")).drop("others"), "tokens")
    stretches = shared_stretches(tokens).groupBy("page").agg(F.collect_list(F.struct("at", "length", "own")).alias("found"))
    decided = undecided.join(stretches, "page", "left")
    found = [F.coalesce(f"found.{name}", F.array().cast(f"array<{kind}>")) for name, kind in (("at", "int"), ("length", "int"), ("own", "boolean"))]
    decided = decided.select("page_id", "url", F.pandas_udf(_unique_runs, "string")("kinds", "texts", *found).alias("text"))
    return settled.unionByName(decided).withColumn("n_chars", F.length("text").cast("long"))
