"""Main text of web pages by line-block distribution.

Markup is stripped first: each block element gives a line, and elements that never hold article text (scripts, forms,
menus, adverts, comments ...) give a gap of empty lines instead. Text lengths are then summed over sliding windows of
lines; lines made of links have none. A region begins at a surge point, where the sum rises over a threshold, and ends at the dive point,
where it falls to nothing. The regions say where the story is: in the article or main elements, if their lines alone make a region (or no region is on the
page), else in the body's own child that holds all regions and a heading, else in the whole body. As nothing of a story may be dropped, what is kept
between surge and dive is carried on to the ends of that block, over gaps and however short: all lines of article and main elements that
are not links alone, and elsewhere all lines but those made of links.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetspark.llm.common import bound_batches, texts_of

#: Lines in a window; the sum at which a region begins.
WINDOW, SURGE = 3, 80

_RAW = "script style noscript template iframe svg canvas object select textarea button title xmp noembed noframes audio video map"
_DROPPED = set("nav aside footer form dialog menu head datalist".split()) | set(_RAW.split())
_BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
_SPACES = {"br", "td", "th", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark what is no article text.
_MARKS = set(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner "
    "menu menus nav navbar navigation navi breadcrumb breadcrumbs topbar toolbar masthead header footer foot bottombar sidebar sidebars "
    "sidemenu aside rail cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog "
    "newsletter subscribe subscription signup login signin search searchbox share sharing social related recommended "
    "recommendations comment comments commentlist reply replies respond disqus discussion widget widgets pager pagination "
    "copyright legal disclaimer skip skiplink contentinfo complementary paywall teaser teasers".split()
)
#: Words that may stand beside a mark in a name, as in site-footer or comment-list; beside any other word, as in share-prices, notice-text, has-sidebar
#: or comments-open, a mark says nothing about the element.
_NEUTRAL = set(
    "site page main global top bottom left right upper lower inner outer primary secondary sticky fixed mobile desktop wrapper wrap container box block "
    "bar area zone slot unit panel module row col column section list item items link links button buttons btn icon icons group content js "
    "reader readers user users visitor visitors post posts article articles entry entries story stories blog news".split()
)
#: Words before "header" that make it the header of the story.
_OWN = set("entry post article story".split())
#: A self-closed tag after its name; a slash that ends an unquoted value closes nothing.
_CLOSED = r"(?:[^>\"'=/]++|/(?!>)|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)?+|\"[^\"]*+\"|'[^']*+')*+/>"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(_RAW.split())})(?=[\s/>])(?!{_CLOSED})(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
#: A tag or comment that is cut off at the end of the page, and a comment or raw element that was begun and goes on to it.
_CUT = re.compile(r"<[a-zA-Z!?/]")
_OPEN = re.compile(rf"<!--(?!.*-->)|<({'|'.join(_RAW.split())})(?=[\s/>])(?!{_CLOSED})(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?!.*</\1\s*>)", re.S | re.I)
#: Elements that may hold an article even where they are dropped.
_HOLDERS = {"article", "div", "section", "template"}
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: See _read().
Line = tuple[str, int, int, int, bool]
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _hidden(attributes: str) -> bool:
    """Whether an element's attributes say that it is hidden."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = next((x for x in values if x), ""), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _marked(attributes: str, main: bool = False) -> bool:
    """Whether an element's class, id or role says that it is no article text; inside the article or main element a header is."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in next((x for x in values if x), "").split():
                words = [x.lower() for x in _WORD.findall(token)]
                marks = [i for i, x in enumerate(words) if x in _MARKS]
                if not marks or any(x not in _MARKS and x not in _NEUTRAL and len(x) > 1 for x in words):
                    continue
                if any(words[i] != "header" or not (main or i and words[i - 1] in _OWN) for i in marks):
                    return True
    return False


@dataclass
class _Part:
    """An element dropped for its class, id or role: whether it is an article, the next such element around it, and what it holds outside
    those in it: characters without links, first headings, articles and main elements."""

    article: bool
    outer: _Part | None
    text: int = 0
    titles: int = 0
    articles: int = 0
    mains: int = 0


def lines_of(html: str) -> list[Line]:
    """A page's lines. A class, id or role is passed over where the element holds the page's main element, or more text than stands outside
    all such elements while there is no article outside and the story must be within: it is or holds an article or the only first heading, or
    less than a passage (SURGE characters) stands outside."""
    kept: set[int] = set()
    while True:
        lines, parts, titles, articles = _read(html, kept)
        more = _stories(parts, sum(len(x[0]) - x[1] for x in lines), titles, articles)
        if not more:
            return lines
        kept |= more


def _stories(parts: dict[int, _Part], outside: int, titles: int, articles: int) -> set[int]:
    """Places of the parts that are no boilerplate, from the outermost inwards, given what stands outside them all."""
    whole = {id(x): replace(x) for x in parts.values()}  # with the parts inside
    inner: dict[int | None, list[int]] = {}
    for at in sorted(parts, reverse=True):
        outer = parts[at].outer
        inner.setdefault(id(outer) if outer else None, []).append(at)
        if outer:
            x, sums = whole[id(parts[at])], whole[id(outer)]
            sums.text, sums.titles, sums.articles, sums.mains = sums.text + x.text, sums.titles + x.titles, sums.articles + x.articles, sums.mains + x.mains

    def rank(at: int) -> tuple[int, int]:
        x = whole[id(parts[at])]
        held = 3 if x.article or x.titles else 2 if x.articles else 0
        if x.mains:
            return 4, x.text
        if articles or x.text <= outside:
            return 0, 0
        return held if held and (not titles or outside < SURGE) else int(outside < SURGE <= x.text), x.text

    found: set[int] = set()
    some = inner.get(None, [])
    while some := [x for x in some if rank(x)[0] or whole[id(parts[x])].text > outside]:
        best = max(some, key=rank)
        if not rank(best)[0]:
            break
        found.add(best)
        x = parts[best]
        outside, titles, articles = outside + x.text, titles + x.titles, articles + x.articles + x.mains + x.article
        some = [at for at in some if at != best] + inner.get(id(x), [])
    return found


def _read(html: str, kept: set[int]) -> tuple[list[Line], dict[int, _Part], int, int]:
    """A page's lines, the parts dropped for their class, id or role by place, and the first headings and articles outside them; marks
    at the places in `kept` don't count. A line: text, characters of it in links, the number of the outermost article or main element around it (0: none), the
    number of the body's child that holds it (0: the body itself), and whether it is a heading. Gaps are empty lines. Takes time in proportion to
    the page: what is open is counted by name, and what follows the last tag's end is not searched for tags."""
    lines: list[Line] = []
    stack: list[tuple[str, int, bool]] = []  # open containers: name, dropped (2: whatever its class, id or role), main
    words: list[str] = []
    parts: dict[int, _Part] = {}
    part: _Part | None = None
    open_names: Counter[str] = Counter()
    dropped = hard = main = titles = articles = story = holding = 0  # story: number of the outermost article; holding: open dropped elements that may hold one
    deep = child = 0  # open containers inside the body, and the number of the outermost
    link, linked = 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(words)).split()) if words else ""
        if text:
            lines.append((text, linked, story if main else 0, child if deep else 0, bool(stack) and stack[-1][0] in _HEADINGS))
        words.clear()
        linked = 0

    def gap() -> None:
        close()
        lines.extend([("", 0, 0, 0, False)] * WINDOW)

    def pop(at: int) -> None:
        nonlocal part, dropped, hard, main, deep, holding
        for name, was_dropped, was_main in stack[at:]:
            open_names[name] -= 1
            dropped -= was_dropped > 0
            holding -= was_dropped > 0 and name in _HOLDERS
            hard -= was_dropped > 1
            if was_dropped == 1 and part:
                part = part.outer
            main -= was_main
            deep -= name not in ("html", "body")
        del stack[at:]

    end, last, opened = 0, html.rfind(">") + 1, 0
    for found in _TOKEN.finditer(html, 0, last):
        if not dropped and found.start() > end:
            text = html[end : found.start()]
            words.append(text)
            if link:
                linked += len(text)
        elif part and not hard and not link:
            part.text += len(html[end : found.start()].strip())
        end, opened = found.end(), found.start()
        if found[3] is None:
            if found[1] and not dropped and found[1].lower() in _BLOCKS:
                gap()
            continue
        name, closing = found[3].lower(), bool(found[2])
        if name in _SPACES:
            words.append(" ")
        elif name == "a":
            link = not closing
        if closing:
            at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name) if open_names[name] else -1
            if name in _BLOCKS or at >= 0 and stack[at][1]:
                (close if not dropped else words.clear)()
                if at >= 0:
                    was = dropped
                    pop(at)
                    if was and not dropped:
                        gap()
            continue
        attributes = found[4] or ""
        if name in ("article", "main") and dropped and not holding:
            pop(next(i for i, x in enumerate(stack) if x[1]))  # a menu or the like that was never closed
        marked = 0
        if name not in ("html", "body", "main"):
            if name in _DROPPED or name == "header" and not main or attributes and _hidden(attributes):
                marked = 2
            elif attributes and found.start() not in kept and _marked(attributes, main > 0):
                marked = 2 if hard else 1
        if name in _BLOCKS and not dropped:
            close()
        if name in _VOID or attributes.endswith("/") and name not in _BLOCKS:
            continue
        if marked and not dropped:
            gap()
        if marked == 1:
            part = parts[found.start()] = _Part(name == "article", part)
        if not dropped and not marked:
            titles += name == "h1"
            articles += name in ("article", "main")
        elif part and not hard and marked < 2:
            part.titles += name == "h1"
            part.articles += name == "article" and marked == 0
            part.mains += name == "main"
        is_main = name in ("article", "main") and not marked
        if name in _BLOCKS - {"p", "li", "dd", "dt", "option", "hr"} or marked:
            stack.append((name, marked, is_main))
            open_names[name] += 1
            dropped += marked > 0
            holding += marked > 0 and name in _HOLDERS
            story += is_main and not main
            hard += marked > 1
            main += is_main
            child += not deep
            deep += name not in ("html", "body")
    rest = html[end:] if not _OPEN.match(html, opened, last) else ""
    cut = _CUT.search(rest)
    rest = rest[: cut.start()] if cut else rest
    if not dropped:
        words.append(rest)
    elif part and not hard and not link:
        part.text += len(rest.strip())
    close()
    return lines, parts, titles, articles


def regions(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Of each line whether it lies in a region and has a length: from a surge point, where the lengths of the lines from it on, a window of them, come to
    `surge`, to the dive point, where they come to nothing."""
    out, begun = [], False
    total = sum(lengths[:window])
    for i, n in enumerate(lengths):  # total: of the window from i
        begun = begun or n > 0 and total >= surge
        out.append(begun and n > 0)
        total += (lengths[i + window] if i + window < len(lengths) else 0) - n
        begun = begun and total > 0
    return out


def main_text(html: str) -> str:
    """The article of a page: its blocks, joined by an empty line."""
    lines = lines_of(html)
    lengths = [0 if text and 2 * linked >= len(text) else len(text) for text, linked, _, _, _ in lines]
    within = regions(lengths)
    marked = {x[2] for x in lines if x[2]}
    if marked and (not any(within) or any(regions([n if x[2] else 0 for x, n in zip(lines, lengths, strict=True)]))):
        stories = {x[2] for x, n in zip(lines, lengths, strict=True) if n} & marked or marked
        return "\n\n".join(x[0] for x in lines if x[2] in stories and x[0])
    holders = {x[3] for x, r in zip(lines, within, strict=True) if r}  # children of the body that hold regions
    only = holders.pop() if len(holders) == 1 else 0
    if only and any(n and x[3] == only and x[4] for x, n in zip(lines, lengths, strict=True)):
        lengths = [n if x[3] == only else 0 for x, n in zip(lines, lengths, strict=True)]
    return "\n\n".join(x[0] for x, n in zip(lines, lengths, strict=True) if n)


def article(html: Column) -> Column:
    """The main text of a page; null is the empty page."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([main_text(x) for x in texts_of(column)], pa.string())

    return extract(html)


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: id, url, text, n_chars (code points).

    Nulls: a null page is empty and gives the empty text; a null id or url stays null. Repeated rows give a row each; an empty table
    gives none. Further columns are not read. Pages of any length are read whole, well-formed or not.
    """
    bound_batches(pages.sparkSession)
    return pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias(url_col), article(F.col(f"`{html_col}`")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


#: The same rows on pages that mark their article, whose only elements are headings, paragraphs, line breaks and bold text.
ORACLE_SQL = r"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (SELECT page_id, url, array_to_string(list_filter(list_transform(
  regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>'),
  lambda x: trim(regexp_replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM pages) t"""
