"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of tags from the root. For every path the page's text, link text
and punctuation are summed over its blocks; their ratios make a score, which is smoothed over the blocks in page order,
fused with the best score under the same container, and compared with a share of the page's best. Scores choose among
articles and the paths outside them: of an article (or main) that holds a path of enough score, every block is kept, be
it a list, a table or a heading. Where no article is named, the same holds for the box that most chosen text lies in.
Containers that name themselves (nav, footer, class="ad", ...) count as what they say; within an article only where the
name says nothing else (class="share-price" does). Time and memory grow in proportion to the page, however it is nested.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s/>="']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed")}
PUNCTUATION = re.compile(r"[,.;:!?،。，、؟！？；：…]")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag closes these, up to the nearest of the tags after them.
CLOSES = {t: ({"p"}, {"td", "th", "button", "table"}) for t in BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}} | {
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir", "table", "td"}), "dt": ({"dt", "dd", "p"}, {"dl", "table"}), "dd": ({"dt", "dd", "p"}, {"dl", "table"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Containers that are no article text whatever they hold.
NEVER = set("head nav footer aside form script style noscript template svg math select button iframe object canvas audio video textarea input label dialog menu".split())
#: Names (class or id) of boxes that are no article text, and those of them that name a whole page's layout as well:
#: an article within such a box counts again.
CALLED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adbox|banner|breadcrumbs?|comments?|commentlist|respond|reply|replies|disqus|cookies?|consent|gdpr|notices?|alert|footer|header|masthead|menu|nav|navbar|navigation|newsletter|subscribe|signup|login|popup|modal|overlay|promo\w*|sponsor\w*|related|recommend\w*|share|sharing|social|sidebar|skip|toolbar|widget|pagination|pager|copyright|legal|outbrain|taboola)(?=$|[\s_-])", re.I)
LAYOUT = re.compile(r"header|footer|menu|nav|sidebar|banner|notice|widget|share|social|login", re.I)
#: Words that such a name may have besides, within an article, and still say nothing else.
BESIDES = set("area author avatar bar block body bottom box btn button buttons card cell col column container content count entry form global grid group head icon icons inline inner item items js label left link links list main media message meta module narrow outer page panel posts primary right row secondary section side site slot small stack sticky stories story text thread title top unit wide wrap wrapper".split())
#: Within an article, headers hold its heading.
HEADING = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN = set("article main".split())

#: Tags whose names say nothing of what is in them, and tags that hold whole pages.
NAMELESS = re.compile(r"html|body|h[1-6]|article|main")
WHOLE = set("html body".split()) | {""}
#: A path, or the article it is in, is content from this share of the page's best fused score; outside the page's
#: article, scores count this much.
SHARE, OUTSIDE = 0.35, 0.3
#: A box without an article tag is the article if it holds this share of the chosen text, this much of its own is chosen.
HOLDS, CHOSEN = 0.8, 0.5


def _says(value: str, inside: bool) -> str:
    """What of a class or id names a box that is no article text, if it does."""
    found = CALLED.search(HEADING.sub(" ", value) if inside else value)
    if not found or not inside:
        return found[0] if found else ""
    for token in value.split():
        words = [w for w in re.split(r"[_-]+|\d+", token.lower()) if w]
        named = [w for w in words if CALLED.fullmatch(w) and not HEADING.fullmatch(w)]
        if named and all(w in BESIDES for w in words if w not in named):
            return named[0]
    return ""


class _Paths:
    """Paths of tags as numbers: a path is its parent's number and the last tag's name. A parent's is smaller."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}
        self.up, self.tag = [0], [""]

    def number(self, up: int, name: str, tag: str) -> int:
        if (up, name) not in self.known:
            self.known[up, name] = len(self.up)
            self.up.append(up)
            self.tag.append(tag)
        return self.known[up, name]


class _Node:
    __slots__ = ("tag", "path", "never", "soft", "main", "article", "within", "box", "link")

    def __init__(self, tag: str, up: _Node | None, attributes: str, paths: _Paths, by_name: bool = True) -> None:
        self.tag = tag
        self.main = bool(up and up.main) or tag in MAIN
        called, never, soft = "", tag in NEVER, True
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                kind, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
                if kind in ("class", "id"):
                    called += " " + value
                    if by_name and not never and not NAMELESS.fullmatch(tag) and (said := _says(value, self.main)):
                        never, soft = True, bool(LAYOUT.search(said))
                elif kind == "role" and value.lower() in ROLES or kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
                    never, soft = True, False
        name = tag + "".join("." + x for x in sorted(set(re.sub(r"\d+", "", called).split())))
        self.path = paths.number(up.path, name, tag) if up else 0
        # The outermost article that the node is in, or else the outermost main; 0 is none.
        self.article = bool(up and up.article) or tag == "article"
        held = bool(up and up.main and up.article == self.article)
        self.within = up.within if held else self.path if self.main else 0
        # A header above the article is the page's; one within it holds the article's heading.
        never |= tag == "header" and not self.main
        kept = bool(up and up.never) and not (tag in MAIN and up.soft and not up.main)
        self.never = kept or never
        self.soft = (not kept or up.soft) and (not never or soft and tag not in NEVER)
        self.link = bool(up and up.link) or tag == "a"
        self.box = self if tag in BLOCKS or up is None else up.box


class _Stack:
    """The open tags, and of each name where it is open."""

    def __init__(self, root: _Node) -> None:
        self.nodes, self.at = [root], {}

    def push(self, node: _Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> _Node:
        node = self.nodes.pop()
        self.at[node.tag].pop()
        return node

    def last(self, tags: set[str]) -> int:
        """Where the innermost of these is open, 0 if none is."""
        return max((held[-1] for t in tags if (held := self.at.get(t))), default=0)

    def first(self, tags: tuple[str, ...]) -> int:
        return min((held[0] for t in tags if (held := self.at.get(t))), default=0)

    def cut(self, to: int) -> None:
        while len(self.nodes) > to:
            self.pop()


class _Reader:
    """Finds tags. What is looked for and isn't there is not looked for again, so a page is read in one pass."""

    def __init__(self, page: str) -> None:
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        """The next place of a string, -1 if there is none."""
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end_of_tag(self, at: int) -> int:
        """Where the > is that ends a tag whose attributes begin here: the first outside quotes, or else the first."""
        first, place = self.find(">", at), at
        if first < 0:
            return -1
        while True:
            stop = self.find(">", place)
            quotes = [(q, c) for c in "\"'" if 0 <= (q := self._before(c, place, stop))]
            if stop < 0 or not quotes:
                return stop if stop >= 0 else first
            opened, kind = min(quotes)
            shut = self.find(kind, opened + 1)
            if shut < 0 or shut - at > LONGEST:
                return first
            place = shut + 1

    def _before(self, what: str, at: int, end: int) -> int:
        return self.page.find(what, at, end if end >= 0 else None)

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it closes, attributes) of each tag, and of what is skipped, without a name. A tag
        handler may move `at` beyond a tag's end."""
        page, self.at = self.page, 0
        while (start := self.find("<", self.at)) >= 0:
            rest = page[start + 1 : start + 4]
            if rest == "!--":
                end = self._comment(start)
                yield start, end, "", False, ""
            elif rest[:1] in ("!", "?") or rest[:1] == "/" and not rest[1:2].isalpha() and rest[1:2] not in ("", ">"):
                close = self.find(">", start)
                if close < 0 and rest[:1] == "/":
                    return
                yield start, close + 1 if close >= 0 else len(page), "", False, ""
            elif m := NAME.match(page, start + 1 + (closing := rest[:1] == "/")):
                close = self.end_of_tag(m.end())
                if close < 0:
                    return  # no tag ends from here on
                yield start, close + 1, m[0].lower(), closing, page[m.end() : close]
            else:
                yield start, start, "", False, ""  # a plain <
                self.at = max(self.at, start + 1)

    def _comment(self, start: int) -> int:
        for short in ("<!-->", "<!--->"):
            if self.page.startswith(short, start):
                return start + len(short)
        ends = [e + len(x) for x in ("-->", "--!>") if (e := self.find(x, start + 4)) >= 0]
        return min(ends, default=len(self.page))


#: A quoted value that would make a tag longer than this is no quoted value.
LONGEST = 1 << 16


def blocks(page: str, by_name: bool = True) -> tuple[list[tuple[_Node, str, int]], _Paths]:
    """The page's blocks in order: their node, their text and how much of it is in links; and the paths. Boxes that never
    count are left out, those by name only if asked."""
    paths, reader, out = _Paths(), _Reader(page), []
    stack = _Stack(_Node("", None, "", paths))
    parts: list[str] = []
    links, plain, no_end = 0, 0, set()

    def text(s: str) -> None:
        nonlocal links
        if s and not stack.nodes[-1].never:
            parts.append(s)
            links += len(s) * stack.nodes[-1].link

    def flush() -> None:
        nonlocal links
        if parts:
            words = " ".join(entities.unescape("".join(parts)).split())
            if words:
                out.append((stack.nodes[-1].box, words, min(links, len(words))))
        parts.clear()
        links = 0

    for start, end, tag, closing, attributes in reader.tags():
        text(page[plain:start])
        plain = reader.at = end
        if not tag:
            continue
        if closing:
            if tag == "br":
                text(" ")
            elif stack.at.get(tag):
                if tag in BLOCKS:
                    flush()
                while (gone := stack.nodes[-1]).tag != tag:
                    if gone.tag in BLOCKS and parts:
                        flush()
                    stack.pop()
                stack.pop()
            continue
        if tag in BLOCKS:
            flush()
        if tag in MAIN and (left := stack.first(("nav", "header", "footer"))):  # no menu or header that was left open reaches into the article
            stack.cut(left)
        if tag in CLOSES:
            shut, until = CLOSES[tag]
            if (place := stack.last(shut)) > stack.last(until):
                stack.cut(place)
        if tag in VOID:
            if tag == "br":
                text(" ")
            continue
        node = _Node(tag, stack.nodes[-1], attributes, paths, by_name)
        if tag in RAW:
            over = RAW[tag].search(page, end) if tag not in no_end else None
            if over:
                plain = reader.at = over.end()
            else:  # code to the page's end, or a tag that was left open
                no_end.add(tag)
                if tag in ("script", "style"):
                    plain = len(page)
                    break
            continue
        if not attributes.endswith("/") or tag in BLOCKS:
            stack.push(node)
    text(page[plain:])
    flush()
    return out, paths


def scores(found: list[tuple[_Node, str, int]], paths: _Paths) -> dict[int, float]:
    """The fused score of each path."""
    sums: dict[int, list[float]] = {}
    for node, words, links in found:
        s = sums.setdefault(node.path, [0, 0, 0, 0])
        s[0] += len(words)
        s[1] += links
        s[2] += len(PUNCTUATION.findall(words))
        s[3] += 1
    own = {p: math.log1p((size - links) / k) * (1 + math.log1p(marks / k)) * (1 - links / size) for p, (size, links, marks, k) in sums.items()}
    row = [own[node.path] for node, _, _ in found]
    smooth: dict[int, list[float]] = {}
    for i, (node, _, _) in enumerate(found):
        near = [row[j] for j in (i - 1, i + 1) if 0 <= j < len(row) and found[j][0].main == node.main]
        smooth.setdefault(node.path, []).append((2 * row[i] + sum(near)) / (2 + len(near)))
    best: dict[int, float] = {}
    for p, xs in smooth.items():
        best[paths.up[p]] = max(best.get(paths.up[p], 0), sum(xs) / len(xs))
    return {p: (sum(xs) / len(xs) + best[paths.up[p]]) / 2 * (1 - sums[p][1] / sums[p][0]) for p, xs in smooth.items()}


def _box_of(found: list[tuple[_Node, str, int]], chosen: set[int], paths: _Paths) -> set[int]:
    """The paths within the innermost box that holds most of the chosen text, if that is most of its own; else none."""
    kept, own = [0] * len(paths.up), [0] * len(paths.up)
    for node, words, _ in found:
        own[node.path] += len(words)
        kept[node.path] += len(words) * (node.path in chosen)
    every = list(own)
    for p in range(len(paths.up) - 1, 0, -1):
        every[paths.up[p]] += every[p]
        kept[paths.up[p]] += kept[p]
    boxes = [p for p in range(1, len(paths.up)) if kept[p] >= HOLDS * kept[0] and kept[p] >= CHOSEN * every[p] > CHOSEN * own[p] and paths.tag[p] in BLOCKS - WHOLE]
    if not boxes:
        return set()
    within = {max(boxes)}  # of nested boxes the inner one has the larger number
    for p in range(max(boxes) + 1, len(paths.up)):
        if paths.up[p] in within:
            within.add(p)
    return within


def extract(page: str) -> str:
    """The article's blocks, joined by newlines."""
    found, paths = blocks(page)
    if not found:  # a page whose every box is named for what it isn't is read by its tags
        found, paths = blocks(page, False)
    if not found:
        return ""
    fused = scores(found, paths)
    main = {node.path for node, _, _ in found if node.main}
    if main and max(fused[p] for p in main) >= SHARE * max(fused.values()):
        fused = {p: s if p in main else s * OUTSIDE for p, s in fused.items()}
        bar = SHARE * max(fused.values())
        articles = {node.within for node, _, _ in found if node.main and fused[node.path] >= bar}
        chosen = {p for p, s in fused.items() if s >= bar} | {node.path for node, _, _ in found if node.within in articles and node.within}
    else:
        bar = SHARE * max(fused.values())
        chosen = {p for p, s in fused.items() if s >= bar}
        chosen |= _box_of(found, chosen, paths)
    return "\n".join(words for node, words, _ in found if node.path in chosen)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "html", 512, 1 << 24)):
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(map(extract, batch.column("html").to_pylist()), pa.string())], ["id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id_col, url_col, text) of every row, repeated ones and null ids too.

    Null, empty and textless pages give an empty text. Character references are decoded, white space within a block is
    one space, blocks are joined in page order by one newline. Other columns are ignored; no rows give no rows.
    """
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    made = named.mapInArrow(_extract, f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string")
    return made.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
