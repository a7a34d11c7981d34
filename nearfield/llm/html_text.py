"""Main text of web pages from flat text blocks, classified by a small decision tree.

A page is cut into text blocks at block-level tags. A block knows its words, the share of them inside links (link density) and how
many end sentences, the same of the blocks before and after it and of the element that holds it, whether it is a heading, and where it
stands: in an article, in the main part, or in neither, and how far the page goes itself. The innermost element around it whose tag, role,
class or id is usual for a part other than the article counts with how plainly it says so and which share of the page's words it
holds, as does one that is usual for the article: a name is a hint among others, and an element that holds most of a page is no
sidebar, whatever its name. No list of words of the text is used.
A decision tree, trained on the blocks of the labelled pages of `TEMPLATES`, says which blocks are content. All of them are kept whole, in order.

Defined results: null and empty html and pages without content give an empty text; broken markup is
read as far as it goes (unclosed tags end with their parents, a `<` that begins no tag is text);
rows are independent, so repeated rows, null identifiers and empty tables need no care; only the
columns named are read.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import column
from .tables import table

#: Names of HTML elements by what they do to the text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style noscript template textarea select button svg math iframe object canvas audio video title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Class and id names of parts other than the article, alone or within longer names,
STRONG = r"ads?|adverts?|advertis\w*|sponsor\w*|sidebar|side-bar|widget\w*|comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|masthead|site-header|page-header|toolbar"
#: and those that say so alone, but only hint at it within longer names.
WEAK = r"promo\w*|banner|notices?|alerts?|login|search|share|sharing|social|related|recommend\w*|topbar|tags|copyright|legal|disclaimer"
#: Names of parts that hold an article.
OWN = r"article|articles?-?body|post|entry|content|story|text|main|body|prose|page-content"
WHOLE_STRONG, WHOLE_WEAK, WHOLE_OWN = (re.compile(rf"(?:^|\s)(?:{x})(?:$|\s)", re.I) for x in (STRONG, WEAK, OWN))
PART_STRONG, PART_WEAK, PART_OWN = (re.compile(rf"(?:^|[\s_-])(?:{x})(?:$|[\s_-])", re.I) for x in (STRONG, WEAK, OWN))
#: How plainly an element says that it isn't part of the article: by a weak name, a strong name within a longer one, a strong name, its tag or role, or as it isn't shown.
WEAKLY, PARTLY, PLAINLY, BY_TAG, HIDDEN = 1, 2, 3, 4, 5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Dropped elements that only their own end tag closes; of others without one the tag alone is dropped.
RAW = frozenset("script style textarea title".split())
#: Dropped elements that can't hold their like: a second start tag says that the first has no end tag.
FLAT = frozenset("button select".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
#: At the end of a tag that has no end tag; the slash of `href=/` is the attribute's.
SLASH = re.compile(r"(?:^|[\s\"'])/$")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")



def _said(n: int) -> str:
    """So many words of prose."""
    some = "the old house by the river was sold in spring and nobody knew who had lived there before it stood empty".split()
    return " ".join(some[i % len(some)] + ("." if i % 11 == 10 or i == n - 1 else "") for i in range(n))


def _links(n: int) -> str:
    return "".join(f"<li><a href=/{i}>Topic {i}</a>" for i in range(n))


def _bodies(n: int, k: int) -> list[str]:
    """Articles of several kinds of blocks and about n words a paragraph; each block begins with a section sign."""
    p = lambda m: f"<p>§{_said(m)}</p>"
    title = _said(2 + k % 9).replace(".", "")
    return [
        f"<h1>§{title}</h1>{p(n)}{p(2 * n)}<h2>§Part two</h2>{p(25)}{p(3)}<ul><li>§first point<li>§second one of them<li>§and the last</ul>",
        f"<h2>§{title}</h2><div>§{_said(n + 20)}</div><div>§{_said(n)}</div><blockquote>§{_said(9)}</blockquote><div>§{_said(40)} <a href=x>see there</a></div>",
        f"<h1>§{title}</h1>{p(4)}{p(5)}{p(n + 60)}<pre>§{_said(n)}</pre>{p(6)}",
        f"{p(n)}{p(1)}{p(n)}<h3>§{title}</h3><p>§{_said(n).replace('.', '')}</p><ol><li>§mix the flour<li>§bake for an hour</ol>{p(2)}",
        f"<h1>§{title}</h1>{p(n + 8)}<p><a href=a>§{_said(6)}</a></p>{p(n)}<dl><dt>§a term<dd>§{_said(8)}</dl><table><tr><td>§one<td>§two</table>{p(n)}",
        f"<h1>§{title}</h1><h2>§Method</h2><ul><li>§two eggs<li>§a cup of milk<li>§salt</ul><p>§{_said(n)}</p><ul><li>§{_said(7)}<li>§{_said(n)}<li>§{_said(5)}</ul>",
        f"<h1>§{title}</h1>{p(n + 30)}{p(n + 50)}",
        f"<h1>§{title}</h1>{p(n)}{p(2 * n + 5)}{p(n + 9)}{p(n + 20)}",
    ]


NOTICES = ("This page keeps small files on your machine", "Get one letter a week", "Send this to a friend", "All rights reserved", "A word from those who pay for this page", "Written by readers like you", "2020 by the site. Nothing may be copied.", "More", "Please become a member to go on with this text and all others that we have.")
#: Pages around an article {b}: {n} is a notice, {t} prose that isn't the article's, {l} a list of links. The last of them are held out in the tests.
TEMPLATES = (
    "<header><a href=/>Site</a></header><nav><ul>{l}</ul></nav><main><article>{b}</article></main><aside><p>{n}</p><p>{t}</p></aside><footer>{n}</footer>",
    "<nav><ul>{l}</ul></nav><div class=ad>{t}</div><article>{b}</article><footer>{n}</footer>",
    "<nav><ul>{l}</ul></nav><div>{n}</div><article>{b}</article><div>{t}</div><div>{t}</div><p>{n}</p>",
    "<div class=nav><ul>{l}</ul></div><div class=post>{b}</div><div class=comments><p>{t}</p><p>{t}</p></div><div class=related><ul>{l}</ul></div><div class=footer><p>{n}</p></div>",
    "<div id=menu>{l}</div><div id=content>{b}</div><div id=sidebar><h3>News</h3><p>{t}</p><ul>{l}</ul></div><div id=footer>{n}</div>",
    "<ul>{l}</ul>{b}<ul>{l}</ul><p>{n}</p>",
    "<ul>{l}</ul>{b}",
    "{b}",
    "<article>{b}</article>",
    "<main>{b}</main>",
    "<main>{b}</main><footer>{n}</footer>",
    "<div class=modal-verbs>{b}</div>",
    "<div class=post-menu-design><ul>{l}</ul>{b}</div><div class=footer>{n}</div>",
    "<div class='page sidebar-right'><div class=nav>{l}</div><div class=entry>{b}</div><div class=widget><p>{t}</p></div></div>",
    "<form action=/><ul>{l}</ul><div>{b}</div><div class=footer>{n}</div></form>",
    "<form action=/><nav>{l}</nav><article>{b}</article></form>",
    "<div class=legal-news>{b}</div><div class=share-box><p>{n}</p></div><div class=related-posts><p><a href=1>{t}</a></p><p><a href=2>{t}</a></p></div>",
    "<table><tr><td><a href=1>Home</a><td><a href=2>About us</a></table><table><tr><td>{b}<td class=alert-box>{n}</table><p>{n}</p>",
    "<article>{b}<section class=comments><p>{t}</p><p>{t}</p></section></article>",
    "<article>{b}<div class=advert>{n}</div><div class=promo-box><p>{n}</p></div>{b}</article>",
    "<main><article>{b}<section id=comments><article><p>{t}</p></article><article><p>{t}</p></article></section></article></main>",
    "<main><article>{b}</article><section><h2>What readers say</h2><p>{t}</p></section></main>",
    "<article><section id=related><p>§{q}</p></section>{b}<section id=legal><p>§{q}</p></section><div class=related><p>{q}</p></div></article>",
    "<article>{b}<div class=related><p>{q}</p></div></article>",
    "<article>{b}<section class=notices><p>{q}</p><p>{q}</p></section></article><footer>{n}</footer>",
    "<article><div class=cookies>{b}</div></article>",
    "<article><aside>{n}</aside>{b}<div class=sidebar><p>{t}</p></div><form><label>{n}</label></form></article>",
    "<div role=navigation>{l}</div><div role=main>{b}</div><div role=complementary><p>{t}</p></div><div role=contentinfo>{n}</div>",
    "<div class=cookie-notice><p>{n}</p></div><div class=header><a href=/>Home</a></div>{b}<div class=footer><p>{n}</p><ul>{l}</ul></div>",
    "<div style='display:none'><p>{t}</p></div>{b}<div hidden>{t}</div>",
    "<div class=newsletter><p>{n}</p><p>{t}</p></div><div class=story>{b}</div><div class=disqus><div>{t}</div></div>",
    "<div class=crumbs><a href=1>One</a></div><div class=page-content>{b}</div><div class=user-comments><p>{t}</p><p>{t}</p></div><div class=ad-box>{n}</div>",
    "<ul>{l}</ul>{b}<div class=comment-list><div>{t}</div><div>{t}</div></div><div class=footer-links>{l}</div>",
    "<div class=wrapper><div class=top><a href=1>One</a> <a href=2>Two</a></div><div class=text>{b}</div><div class=end><a href=1>Three</a></div></div>",
    # held out
    "<div id=top><a href=/>Post</a></div><div id=links><a href=1>World</a> <a href=2>Trade</a> <a href=3>Sea</a></div><div id=story>{b}</div><div id=comments><p>{t}</p></div>",
    "<header><h1><a href=/>Site</a></h1><nav>{l}</nav></header><article><header>{b}</header><div class=comments><p>{t}</p></div></article><div>{t}</div>",
    "<section class=subscribe><p>{n}</p></section><main><div class=body>{b}</div></main><section class=widgets><p>{t}</p><ul>{l}</ul></section>",
    "<div class=navigation-theory>{b}</div><div class=footer>{n}</div>",
    "<ul class=menu>{l}</ul><div class=content><div class=entry>{b}</div></div><div class=sidebar><p>{t}</p></div><div class=article-comments><p>{t}</p></div>",
    "<nav>{l}</nav><article>{b}</article><div><div>{t}</div></div><div>{n}</div><footer><ul>{l}</ul></footer>",
)
HELD_OUT = 6
#: Elements around a whole page, and around its article alone, whatever their names.
AROUND = ("{x}", "<div class=site>{x}</div>", "<div id=page class='has-sidebar menu-open'>{x}</div>", "<div class=cookies-page>{x}</div>", "<div><div class=wrapper>{x}</div></div>", "<form>{x}</form>", "<div class=content>{x}</div>")
WITHIN = ("{x}", "{x}", "<div class=modal-verbs>{x}</div>", "<div class=post-menu-design>{x}</div>", "<div>{x}</div>", "<div class=post-body><div>{x}</div></div>", "<div class='search social-history'>{x}</div>", "<section id=copyright>{x}</section>", "<section class=legal-history>{x}</section>", "<div class=comments-on-trade>{x}</div>", "<div class=widget-makers>{x}</div>", "<section>{x}</section>")


def _pages(templates: tuple[str, ...]) -> list[str]:
    """Labelled pages: content blocks begin with a section sign."""
    out, count = [], itertools.count()
    for i, template in enumerate(templates):
        for n in (3, 8, 20, 50, 130):
            for k, body in enumerate(_bodies(n, i)):
                for _ in range(2):
                    at = next(count)
                    within = WITHIN[at % len(WITHIN)].replace("{x}", body)
                    values = {"b": within, "n": NOTICES[(i + n + at) % len(NOTICES)], "t": _said(n + 5 * k), "l": _links(2 + (n + at) % 9), "q": _said(n)}
                    page = re.sub(r"\{(\w)\}", lambda m, v=values: v[m[1]], template)
                    out.append(f"<body>{AROUND[at % len(AROUND)].replace('{x}', page)}</body>")
    return out + [page.replace(".", "") for page in out]


def tree_of(rows: list[tuple], depth: int = 12, least: int = 2):
    """A decision tree by Gini impurity: (feature, threshold, below, from there on) or the content flag of a leaf. least: rows of a leaf."""
    x, y = np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows], float)

    def grown(x: np.ndarray, y: np.ndarray, depth: int):
        n, share = len(y), y.mean()
        if not depth or share in (0, 1) or n < 2 * least:
            return bool(share >= 0.5)
        order = np.argsort(x, axis=0, kind="stable")
        v, ones = np.take_along_axis(x, order, 0), np.cumsum(y[order], axis=0)
        m = np.arange(1, n)[:, None]
        left, right = ones[:-1], ones[-1] - ones[:-1]
        impurity = left * (m - left) / m + right * (n - m - right) / (n - m)
        impurity[(v[1:] == v[:-1]) | (m < least) | (m > n - least)] = np.inf
        at = np.unravel_index(impurity.argmin(), impurity.shape)
        if not impurity[at] < share * (1 - share) * n - 1e-9:
            return bool(share >= 0.5)
        feature, threshold = int(at[1]), float((v[at] + v[at[0] + 1, at[1]]) / 2)
        low = x[:, feature] < threshold
        return feature, threshold, grown(x[low], y[low], depth - 1), grown(x[~low], y[~low], depth - 1)

    return grown(x, y, depth)


def decide(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] < tree[1], decide(tree[2], x), decide(tree[3], x))


def stands(tag: str, attributes: str, in_article: bool) -> tuple[int, int, bool]:
    """What an element says of what it holds: its level (2 an article, 1 the main part, 0 nothing), how plainly that it isn't the article's, and whether it has a name that an article has."""
    names = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    role = names.get("role", "").lower()
    if "hidden" in names or names.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", names.get("style", ""), re.I):
        return 0, HIDDEN, False
    if tag in APART or (tag == "header" and not in_article) or role in ROLES:
        return 0, BY_TAG, False
    if tag in ("body", "html"):
        return 0, 0, False
    level = 2 if tag == "article" or role == "article" or names.get("itemprop") == "articleBody" else 1 if tag == "main" or role == "main" else 0
    if tag in HEADINGS:  # their ids, like a section's, come from their words
        return level, 0, False
    own = f"{names.get('class', '')} {names.get('id', '') if tag != 'section' else ''}"
    if not own.strip():
        return level, 0, level > 0
    against = PLAINLY if WHOLE_STRONG.search(own) else PARTLY if PART_STRONG.search(own) else WEAKLY if PART_WEAK.search(own) else 0
    return level, against, level > 0 or bool(PART_OWN.search(own))


class Element:
    """An open element, with what it holds: its own words and links, and the nearest elements around or at it that say something."""

    __slots__ = ("name", "up", "level", "against", "bad", "good", "articles", "words", "linked")

    def __init__(self, name: str, up: Element | None, attributes: str = ""):
        self.name, self.up, self.words, self.linked = name, up, 0, 0
        if up is None:
            self.level = self.against = self.articles = 0
            self.bad = self.good = None
            return
        level, self.against, good = stands(name, attributes, up.level == 2)
        self.level, self.articles = max(level, up.level), up.articles + (level == 2)
        self.bad, self.good = self if self.against else up.bad, self if good else up.good
        if up.bad is not None and up.bad.against == HIDDEN:
            self.bad = up.bad


class Block:
    """A text block: its text, words, words in links, element and whether it is a heading."""

    __slots__ = ("text", "words", "linked", "inside", "heading")

    def __init__(self, text: str, words: int, linked: int, inside: Element, heading: bool):
        self.text, self.words, self.linked, self.inside, self.heading = text, words, linked, inside, heading


def blocks(page: str) -> Iterator[Block]:
    """A page's text blocks, in order."""
    parts: list[str] = []
    words = linked = 0
    root = Element("", None)
    stack = [root]
    opened: Counter[str] = Counter()
    absent: set[str] = set()  # dropped elements that have no end tag from here on
    links, at, end = 0, 0, len(page)
    heading = False

    def flushed():
        text = " ".join("".join(parts).split())
        parts.clear()
        return text

    while at < end:
        tag = TAG.search(page, at)
        raw = page[at : tag.start() if tag else end]
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            n = len(text.split())
            words += n
            linked += n * (links > 0)
        if not tag:
            break
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if tag[0].startswith("<![CDATA["):
            parts.append(tag[0][9:].removesuffix("]]>"))
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS:
            if text := flushed():
                yield Block(text, words, min(linked, words), stack[-1], heading)
            words = linked = 0
        elif name == "br":
            parts.append(" ")
        if not closing:
            alone = bool(SLASH.search(attributes))
            if name in DROPPED and not alone:
                close = None if name in absent else re.compile(rf"</{re.escape(name)}(?![\w-])[^>]*>", re.I).search(page, at)
                if name == "head" and not close:
                    close = re.compile(r"(?=<body[\s>])", re.I).search(page, at)
                if close and name in FLAT and re.compile(rf"<{name}(?![\w-])", re.I).search(page, at, close.start()):
                    close = None
                elif not close:
                    absent.add(name)
                at = close.end() if close else end if name in RAW else at
                continue
            if name in VOID or (alone and name not in BLOCKS):
                continue
            while len(stack) > 1 and stack[-1].name in CLOSES.get(name, ()):
                opened[stack.pop().name] -= 1
            stack.append(Element(name, stack[-1], attributes))
            opened[name] += 1
        elif opened[name]:  # an end tag without a start changes nothing
            while (last := stack.pop().name) != name:
                opened[last] -= 1
            opened[name] -= 1
        links = links + 1 if name == "a" and not closing else 0 if name == "a" or name in BLOCKS else links
        if name in BLOCKS:
            heading = not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()
    if text := flushed():
        yield Block(text, words, min(linked, words), stack[-1], heading)


def _holders(found: list[Block]) -> list[Element]:
    """The element that holds each block among others, and every element's words and links."""
    holders = []
    for b in found:
        b.inside.words += b.words
        b.inside.linked += b.linked
        holder = b.inside
        while holder.up is not None and (holder.name not in BLOCKS or holder.name in ("p", "li", "td", "th", "tr", "dt", "dd", "pre") or holder.name in HEADINGS):
            holder = holder.up
        holders.append(holder)
    seen: dict[int, Element] = {}
    depth: dict[int, int] = {}
    for b in found:  # each element once, whatever hangs below it
        chain, e = [], b.inside
        while e is not None and id(e) not in seen:
            seen[id(e)] = e
            chain.append(e)
            e = e.up
        base = depth[id(e)] if e is not None else -1
        for i, x in enumerate(reversed(chain), 1):
            depth[id(x)] = base + i
    for e in sorted(seen.values(), key=lambda e: -depth[id(e)]):
        if e.up is not None:
            e.up.words += e.words
            e.up.linked += e.linked
    return holders


def _kind(e: Element) -> int:
    """1 in an item of a list, 2 in a cell of a table."""
    while e.up is not None and e.name not in BLOCKS:
        e = e.up
    return 1 if e.name in ("li", "dt", "dd") else 2 if e.name in ("td", "th", "tr") else 0


def _features(found: list[Block]) -> np.ndarray:
    holders = _holders(found)
    n, k = np.array([b.words for b in found], float), np.array([b.linked for b in found], float)
    ends = np.array([sum(map(b.text.count, ".!?")) for b in found]) / np.maximum(n, 1)
    own = np.column_stack([n, k / np.maximum(n, 1), ends])
    none = np.zeros((1, 3))
    total = max(1, n.sum())
    at = np.array([b.inside.level for b in found])
    share = lambda e: 0 if e is None else e.words / total
    more = [(b.inside.level, b.inside.articles > 1, b.heading, _kind(b.inside), 0 if b.inside.bad is None else b.inside.bad.against, share(b.inside.bad), share(b.inside.good), h.words, h.linked / max(1, h.words), h.words / total) for b, h in zip(found, holders, strict=True)]
    more = np.array(more, float)
    below = np.column_stack([at.max() - at, more[:, 6].max() - more[:, 6]])  # how far the page's plainest article is from here
    return np.column_stack([own, np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none]), more, below])


def labelled(templates: tuple[str, ...] = TEMPLATES[:-HELD_OUT]) -> list[tuple]:
    """The features of all blocks of the labelled pages, each kind once, and whether it is content."""
    rows = {}
    for page in _pages(templates):
        found = list(blocks(page))
        marks = [b.text[0] == "§" for b in found]
        for b in found:
            b.text = b.text.removeprefix("§")
        for x, y in zip(_features(found).tolist(), marks, strict=True):
            rows.setdefault(tuple(x), int(y))
    return [(*x, y) for x, y in rows.items()]


@functools.cache
def _tree():
    return tree_of(labelled(TEMPLATES))


def main_text(page: str | None, tree) -> str:
    found = list(blocks(page or ""))
    if not found:
        return ""
    x = _features(found)
    return "\n".join(b.text for b, keep in zip(found, decide(tree, x), strict=True) if keep)


def extracted(pages: DataFrame, keep: list[str] | None = None, rows: list[tuple] | None = None) -> DataFrame:
    """The columns to keep (page_id and url if not given) and text, the main text, of every row's whole html. rows: labelled blocks to learn from instead of those of all templates."""
    keep = ["page_id", "url"] if keep is None else keep
    tree = tree_of(rows) if rows else _tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in column(batch, "_html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    read = pages.select(*keep, F.col("html").alias("_html"))
    return read.mapInArrow(run, ", ".join([*(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in keep), "text string"]))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
