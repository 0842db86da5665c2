"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams over a page and the text between block tags becomes lines,
each with its number of characters, link characters and inline tags, and the container (article,
main, section, division, cell, body) it stands in. Scripts, styles and controls are not read. Menus,
page headers and footers, sidebars, forms, what is hidden, and elements named as notices, adverts or
comments are hints: a name of other words as well counts only where links are most of the text, a
container with most of the page's text is not hidden by its name, and an element left open ends at
the next landmark.

The ratio of text to tags of each line is smoothed with a Gaussian. Where a page has main or article
elements, their lines are the text, with headings right before; main is one region with the articles
in it; runs of link lines at which the smoothed ratio falls to a fraction of the article's are left
out, and so are articles under a heading for comments. Elsewhere, lines at or above the standard
deviation of the smoothed ratios are seeds. Neighbouring containers form a region, which only a
container of mostly links ends; all lines between the first and the last region with a seed or a
heading are kept, but those of link containers. No block goes for being short beside a seed.

Cases: null or empty html gives an empty text; broken markup is read as browsers read it (open
paragraphs end at the next block, open inline tags at the end); unknown references stay as they
are; an article of mostly links is left out beside others; a page of nothing but links is kept.
Rows are independent of each other; further columns are kept.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from hexlytics.llm.tables import map_columns

CHUNK = 1 << 16  # characters fed to the parser at once
SIGMA = 1.0
RADIUS = 2

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset(
    "script style noscript template select option button textarea iframe svg canvas object audio video "
    "head title".split())
ASIDE = frozenset("nav aside form dialog menu footer".split())
LANDMARKS = frozenset("article main nav aside header footer".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var ruby rb rt rp wbr br img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body".split())
HIDDEN_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu "
    "menubar toolbar".split())
# Words of class names and ids: of what is no article, of talk and adverts, and what goes with either.
CHROME = frozenset(
    "banner cookie cookies consent gdpr notice notices notification notifications popup modal overlay "
    "newsletter subscribe subscription signup login sidebar side aside menu menus nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer share sharing social related recommended widget widgets "
    "pagination pager toolbar hidden skip copyright".split())
TALK = frozenset(
    "ad ads advert adverts advertisement advertising adslot adsense dfp gpt sponsor sponsored sponsors promo "
    "promoted taboola outbrain comment comments commentlist respond reply replies disqus".split())
WITH = frozenset(
    "site page post posts article articles link links user reader global top bottom left right first last "
    "section container wrapper wrap inner outer box block area list item items group row col column bar panel "
    "slot unit zone thread primary secondary main the buttons icons message text news".split())
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TALK_HEADING = re.compile(
    r"(?:\d+\s+)?(?:(?:reader|user)\s+)?(?:discussion|comments?|responses?|replies|kommentare|commentaires|"
    r"comentarios|leave a (?:comment|reply))\W*\d*\W*", re.I)
RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)


def hint_of(names: str) -> str | None:
    """What class names and ids say: "talk", "chrome", "maybe" (beside words of another kind), or
    nothing. A name is one word of several parts, as in cookie-notice or page-with-sidebar."""
    best = None
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_\d]+", name) if p]
        if TALK.intersection(parts) and TALK.union(WITH, CHROME).issuperset(parts):
            return "talk"
        if CHROME.intersection(parts):
            best = "chrome" if CHROME.union(WITH).issuperset(parts) or best == "chrome" else "maybe"
    return best


class Hint:
    """An element that may not belong to the article."""

    def __init__(self, kind: str, line: int) -> None:
        self.kind, self.first, self.stop = kind, line, None  # stop: line after its last one
        self.closed = self.holds_article = False
        self.limit = None  # line at which a landmark begins inside


class _Lines(HTMLParser):
    """Events to lines: (text, link characters, tags, container number, is heading)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.article: list[bool] = [False]  # by container number; 0 stands for the page
        self.main: list[bool] = [False]  # likewise; the articles in it belong to it
        self.body: list[bool] = [True]  # likewise; its lines are no block
        self.talk: list[bool] = [False]  # likewise; an article inside another or under a talk heading
        self.hints: list[Hint] = []
        self.stack: list[tuple[str, bool, int, Hint | None]] = []  # element, unread, container, hint
        self.hiding = 0
        self.words: list[str] = []
        self.links = self.tags = self.in_link = 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            where = self.stack[-1][2] if self.stack else 0
            self.lines.append((text, min(self.links, len(text)), self.tags, where,
                               any(t in HEADINGS for t, *_ in self.stack[-4:])))
        self.words, self.links, self.tags = [], 0, 0

    def _hint(self, tag: str, attrs) -> str | None:
        role = (attrs.get("role") or "").lower()
        if tag in ASIDE or role in HIDDEN_ROLES and tag not in ("body", "main"):
            return "form" if tag == "form" or role == "form" else "tag"
        if tag == "header" and not any(self.article[entry[2]] for entry in self.stack[-1:]):
            return "tag"
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or HIDING.search(
                attrs.get("style") or ""):
            return "tag"
        if attrs.get("itemprop") == "comment":
            return "talk"
        if tag in ("body", "html", "main", "p") or tag in HEADINGS:
            return None
        hint = hint_of(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")
        return None if tag == "article" and hint != "talk" else hint

    def _open_hint(self, kind: str | None) -> Hint | None:
        if kind is None or self.hiding:
            return None
        self.hints.append(Hint(kind, len(self.lines)))
        return self.hints[-1]

    def _end(self, entry: tuple, closed: bool) -> None:
        """An element ends: by its own end tag, or with what is around it."""
        self.hiding -= entry[1]
        if entry[0] == "a":
            self.in_link = max(0, self.in_link - 1)
        if entry[3] is not None:
            entry[3].stop, entry[3].closed = len(self.lines), closed

    def handle_starttag(self, tag, attrs) -> None:
        if tag in VOID:
            if tag == "br":
                self.words.append(" ")
            elif tag not in INLINE:
                self.flush()
            self.tags += not self.hiding
            return
        if tag in INLINE:
            self.tags += not self.hiding
            self.in_link += tag == "a"
            if tag in ("a", "span"):
                kind = self._hint(tag, dict(attrs)) if tag == "span" else None
                # Within a line only what cannot be seen is left out.
                unread = kind in ("tag", "talk")
                self.stack.append((tag, unread, self.stack[-1][2] if self.stack else 0, None))
                self.hiding += unread
            return
        if not self.hiding:
            self.flush()
        # Open paragraphs and items end where the next block starts.
        if tag in ("p", "div", "article", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4",
                   "h5", "h6", "footer", "header", "nav", "aside", "main", "form", "blockquote"):
            self._close("p", barrier=CONTAINERS | {"li", "blockquote", "td", "th"})
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close(tag, barrier={"ul", "ol", "dl", "table", "select"} | (
                {"tr"} if tag in ("td", "th") else set()))
        attributes = dict(attrs)
        unread = tag in UNREAD
        where = self.stack[-1][2] if self.stack else 0
        if tag in LANDMARKS and not self.hiding:
            for *_, hint in self.stack:
                if hint is not None:
                    hint.limit = len(self.lines) if hint.limit is None else hint.limit
                    hint.holds_article |= tag in ("article", "main")
        hint = None if unread else self._open_hint(self._hint(tag, attributes))
        if tag in CONTAINERS and not self.hiding and not unread:
            main = tag in ("article", "main") or (attributes.get("role") or "") in (
                "main", "article") or (attributes.get("itemprop") or "") == "articleBody"
            # Divisions inside an article belong to it, and everything inside main.
            talk = tag == "article" and self._after_talk_heading()
            if talk or not (self.main[where] or self.article[where] and not main):
                self.article.append(main or self.article[where])
                self.main.append(self.main[where] or tag == "main" or attributes.get("role") == "main")
                self.body.append(tag == "body")
                self.talk.append(talk or self.talk[where])
                where = len(self.article) - 1
        self.stack.append((tag, unread, where, hint))
        self.hiding += unread

    def _after_talk_heading(self) -> bool:
        """Whether the article that begins is the first under such a heading, or follows another one."""
        if not self.lines:
            return False
        text, _, _, where, heading = self.lines[-1]
        return self.talk[where] or heading and bool(TALK_HEADING.fullmatch(text))

    def _close(self, tag: str, barrier=frozenset()) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if not self.hiding:
                    self.flush()
                for entry in self.stack[k + 1:]:
                    self._end(entry, False)
                self._end(self.stack[k], True)
                del self.stack[k:]
                return
            if self.stack[k][0] in barrier:
                return

    def handle_endtag(self, tag) -> None:
        if tag in VOID:
            return
        if tag in INLINE:
            if tag in ("a", "span"):
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == tag:
                        self._end(self.stack[k], True)
                        del self.stack[k]
                        break
                    if self.stack[k][0] not in ("a", "span"):
                        break
            return
        if not self.hiding:
            self.flush()
        self._close(tag)

    def handle_data(self, data) -> None:
        if not self.hiding:
            self.words.append(data)
            if self.in_link > 0:
                self.links += len(data.strip())


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian over a line and its neighbours, weights renewed at the ends."""
    reach = np.arange(-RADIUS, RADIUS + 1)
    weights = np.exp(-(reach ** 2) / (2.0 * SIGMA ** 2))
    total = np.convolve(ratios, weights)[RADIUS:RADIUS + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), weights)[RADIUS:RADIUS + len(ratios)]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    for k in range(0, len(html), CHUNK):
        parser.feed(html[k:k + CHUNK])
    parser.close()
    parser.flush()
    if not parser.lines:
        return ""
    seen = ~hinted(parser)
    out = np.zeros(len(seen), bool)
    out[seen] = chosen(parser, np.flatnonzero(seen))
    return " ".join(t for (t, *_), k in zip(parser.lines, out) if k)


def hinted(parser: _Lines) -> np.ndarray:
    """Lines of elements that stand beside the article. A name is a hint: one with words of another kind
    counts where links are most of the text, and none hides most of the page's text."""
    n = len(parser.lines)
    size = np.array([len(line[0]) for line in parser.lines], float)
    links = np.array([line[1] for line in parser.lines], float)
    out = np.zeros(n, bool)
    spans = []
    for hint in parser.hints:
        stop = n if hint.stop is None else hint.stop
        if not hint.closed and hint.limit is not None:
            stop = min(stop, hint.limit)  # left open: it ends where a landmark begins
        spans.append((hint, slice(hint.first, stop)))
        if hint.kind in ("tag", "talk"):
            out[spans[-1][1]] = True
    rest = ((size - links) * ~out).sum()
    outside = any(parser.article[line[3]] for line, hidden in zip(parser.lines, out) if not hidden)
    for hint, span in spans:
        own = ((size - links) * ~out)[span].sum()
        if hint.kind == "maybe":
            out[span] |= links[span].sum() > 0.5 * size[span].sum()
        elif hint.kind in ("chrome", "form") and not (
                2 * own > rest and (hint.holds_article or not outside)):
            out[span] = True
    return out


def chosen(parser: _Lines, seen: np.ndarray) -> np.ndarray:
    """Which of the lines ``seen`` are main text."""
    lines = [parser.lines[k] for k in seen]
    if not lines:
        return np.zeros(0, bool)
    size = np.array([len(line[0]) for line in lines], float)
    links, tags = (np.array([line[k] for line in lines], float) for k in (1, 2))
    where = np.array([line[3] for line in lines])
    heading = np.array([line[4] for line in lines])
    many = len(parser.article)
    ratio = smoothed((size - links) / (1.0 + tags))
    of_links = np.bincount(where, links, many) > 0.5 * np.bincount(where, size, many)
    marked = np.array(parser.article)[where]
    if marked.any():
        kept = marked & (np.array(parser.main) | ~of_links)[where] & ~np.array(parser.talk)[where]
        kept = kept if kept.any() else marked
        # Within articles too, the ratio tells regions that are lists of links: it falls to a fraction of
        # that of the article's lines.
        of_list = kept & ~heading & (links > 0.8 * size)
        rest = kept & ~heading & ~of_list
        usual = np.median(ratio[rest]) if rest.any() else 0.0
        for first, stop in _runs(of_list, RADIUS + 1):
            if ratio[first:stop].min() >= 0.25 * usual:
                continue
            kept[first:stop] = False
            if first and heading[first - 1] and (stop == len(kept) or heading[stop] or not kept[stop]):
                kept[first - 1] = False  # a heading of nothing else
        for k in np.flatnonzero(heading & kept):
            if TALK_HEADING.fullmatch(lines[k][0]) and k + 1 < len(kept) and parser.talk[where[k + 1]]:
                kept[k] = False
        kept = kept if kept.any() else marked
        for k in range(len(kept) - 2, -1, -1):
            kept[k] |= heading[k] and kept[k + 1] and not of_links[where[k]]
        return kept
    # Menus straight in the body take no heading or paragraph along.
    text = ~of_links[where] | np.array(parser.body)[where] & (links <= 0.5 * size)
    if not text.any():
        return ~text
    # The line about rights at the end is no text, if there is any other.
    last = np.flatnonzero(text)[-1]
    if RIGHTS.match(lines[last][0]) and text.sum() > 1:
        text[last] = False
    seeds = text & (heading | (ratio >= min(ratio.std(), ratio[text].max())))
    region = np.cumsum(~text)
    with_seed = np.flatnonzero(np.isin(region, region[seeds]) & text)
    inside = np.arange(len(text))
    return text & (inside >= with_seed[0]) & (inside <= with_seed[-1])


def _runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, stop) of the runs of at least that many."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least]


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns plus ``main_text``; one pass over each partition."""
    return map_columns(pages, [html], lambda h: [[main_text(x) for x in h]], "main_text string")
