"""Main text of web pages by tree scoring.

A page becomes a small tree. Every paragraph earns points for its length and its commas and passes
them to its ancestors, half as many at each further container; a container's points are discounted by the share of its text
that stands in links. The best container is kept with those of its siblings that look like part of
the same text, and inside an article with what stands beside its ancestors there; parts of a page that are never article text (menus, forms, notices, comments ...) are
left out before that, by their element or by the names in their class, id and role. Names (and forms and headers) only
suggest: they don't leave out what holds the article or most of the text, nor anything if nothing would be left. Inside an article, a name that
can also be the subject of one of its parts (tags, rating ...) leaves out only what looks the part: links, form fields, short labels.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("head script style noscript template iframe noembed noframes object svg math canvas audio video nav aside footer form button select textarea input dialog menu title xmp".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote li td dd".split())
CONTAINERS = frozenset("article body blockquote center details div dl main ol section table tbody td tr ul".split())
#: An open element that ends when one of the given elements starts.
ENDED_BY = {
    "p": BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["head", "body", *(BLOCKS - {"html"})]),
}
#: Elements that an implied end or a stray end tag doesn't reach through.
FENCE = {"p": frozenset("table td th button object".split()), "li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
HINTS_AGAINST = frozenset(
    """ad ads advert advertisement adsbygoogle adsense adbox adslot alert banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent cookie cookies cta disqus donate feedback footer gdpr hidden
    login masthead menu modal nav navbar navigation newsletter noprint notice notification outbrain overlay pager pagination paywall popup promo promoted promotion rating recommended related replies reply respond search
    share sharing shares sidebar signup skip social sponsor sponsored subscribe taboola tags teaser toc toolbar tooltip tracking widget widgets complementary contentinfo""".split()
)
HINTS_FOR = frozenset("article articlebody body content entry main maincontent post story text".split())
HEADER = frozenset(["header"])
#: Of those that speak against, names that parts of an article have for their subject or looks too.
SUBJECTS = frozenset("menu rating search skip social tags teaser tracking".split())
#: The same for headings, which are no notices.
SUBJECTS_OF_HEADINGS = SUBJECTS | frozenset("alert banner masthead notice notification".split())
FIELDS = frozenset("button form input select textarea".split())
TABLE_PARTS = frozenset("tbody td tfoot th thead tr".split())
SENTENCE_ENDS = tuple(".!?\u2026\u3002\uff01\uff1f\"'\u201d\u00bb)")
#: Characters up to which a text that is no sentence is a label.
LABEL = 80
#: Characters from which on a part can be a page's text.
SUBSTANTIAL = 200

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z]+")


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    parent: Node | None
    against: bool = False
    liked: bool = False
    suggested: bool = False
    subject: bool = False
    names: str = ""
    children: list = field(default_factory=list)
    points: float = 0.0


def _element(tag: str, attributes: str, parent: Node, inside_article: bool) -> Node:
    """A new node: whether it is left out, whether that is only suggested (by a subject's name, in an article), and whether its names speak for it.

    A name speaks against an element as a whole or if all its words do: sidebar and cookie-banner, not has-sidebar.
    """
    forbidden = tag in LEFT_OUT and tag != "form"
    bad = tag == "form" or tag == "header" and not inside_article
    if not attributes or attributes.isspace():
        return Node(tag, parent, forbidden or bad, suggested=bad)
    words: set[str] = set()
    against = HINTS_AGAINST if inside_article else HINTS_AGAINST | HEADER
    subjects = frozenset() if not inside_article else SUBJECTS_OF_HEADINGS if tag in HEADINGS else SUBJECTS
    hidden, subject, names = False, not bad, ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role"):
            names = value.lower() if name == "class" else names
            for one in value.lower().split():
                own = WORDS.findall(one)
                words.update(own)
                if own and against.issuperset(own) and tag not in ("html", "body", "article", "main"):
                    bad, subject = True, subject and subjects.issuperset(own)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    forbidden = forbidden or hidden
    suggested = bad and not forbidden
    return Node(tag, parent, forbidden or bad, bool(words & HINTS_FOR), suggested, suggested and subject, names)


def parse(page: str) -> Node:
    """The tree of a page. Broken markup never fails: what isn't a tag is text.

    Where the open elements of each name stand is kept, so no tag walks over what is open: time follows the page's length.
    """
    root = Node("html", None)
    opened = [root]
    places: dict[str, list[int]] = {}  # in `opened`, of each name
    ending: list[int] = []  # in `opened`, of elements that end at others' starts or shield what is around them
    at = 0
    end_of_raw: dict[str, re.Pattern[str]] = {}
    last = page.rfind(">")

    def close(place: int) -> None:
        while len(opened) > place:
            places[opened.pop().tag].pop()
            if ending and ending[-1] == len(opened):
                ending.pop()

    while at <= last and (m := TOKEN.search(page, at)):
        if m.start() > at:
            opened[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            own = places.get(tag)
            if own and not any(places[f][-1] > own[-1] for f in FENCE.get(tag, ()) if places.get(f)):
                close(own[-1])
            continue
        if tag in ("html", "body") and (tag == "html" or opened[-1].tag == "body"):
            continue
        k = len(ending) - 1  # from here inwards out: what the new element ends, up to what shields the rest
        while k >= 0:
            name = opened[ending[k]].tag
            if tag in ENDED_BY.get(name, ()):
                close(ending[k])
            elif name in BLOCKS and name not in ENDED_BY:
                break
            k -= 1
        node = _element(tag, m[3], opened[-1], bool(places.get("article") or places.get("main")))
        opened[-1].children.append(node)
        if tag in RAW:
            end = end_of_raw.get(tag) or end_of_raw.setdefault(tag, re.compile(rf"</{tag}\b[^>]*>", re.I))
            found = end.search(page, at)
            if not node.against:
                node.children.append(page[at : found.start() if found else len(page)])
            at = found.end() if found else len(page)
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag in BLOCKS and tag not in VOID:
            if tag in BLOCKS or tag in ENDED_BY:
                ending.append(len(opened))
            places.setdefault(tag, []).append(len(opened))
            opened.append(node)
    if at < len(page):
        opened[-1].children.append(page[at:].partition("<!--")[0])
    return root


def blocks(nodes: list[Node]) -> list[tuple[str, Node, int]]:
    """(text, the block element, characters in links) of the blocks below the nodes, in page order, without what is left out."""
    found: list[tuple[str, Node, int]] = []
    run: list[str] = []
    owner, linked, depth = nodes[0] if nodes else None, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        if text:
            found.append((text, owner, min(linked, len(text))))
        run.clear()
        linked = 0

    stack: list[tuple[object, bool]] = [(n, False) for n in reversed(nodes)]
    while stack:
        node, leaving = stack.pop()
        if isinstance(node, str):
            run.append(node)
            linked += len(node) if depth else 0
        elif leaving:
            if node.tag == "a":
                depth -= 1
            else:
                flush()
                owner = node.parent
        elif not node.against:
            if node.tag == "br" or node.tag in VOID and node.tag != "wbr":
                run.append(" ")
                if node.tag == "hr":
                    flush()
                continue
            if node.tag in BLOCKS:
                flush()
                owner = node
                stack.append((node, True))
            elif node.tag == "a":
                depth += 1
                stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
    flush()
    return found


def _points(text: str, owner: Node, linked: int) -> float:
    return 0.0 if owner.tag in HEADINGS else (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def _below(root: Node) -> list[Node]:
    """The nodes that aren't left out, parents before children."""
    order = [root]
    for node in order:  # grows while it is read
        order.extend(c for c in node.children if isinstance(c, Node) and not c.against)
    return order


def _relent(root: Node) -> list[Node]:
    """Takes back suggestions against what holds the article or most of the text; the suggestions that stay."""
    asked, stack = [], [root]
    while stack:
        node = stack.pop()
        for c in node.children:
            if isinstance(c, Node) and (not c.against or c.suggested):
                stack.append(c)
                if c.suggested:
                    asked.append(c)
    if not asked:
        return []
    for node in asked:
        node.against = False
    points: dict[Node, float] = {}
    chars: dict[Node, int] = {}
    looks: dict[Node, list[int]] = {}  # characters, those in links, those of texts that are no labels, fields
    for text, owner, linked in blocks([root]):
        look = looks.setdefault(owner, [0, 0, 0, 0])
        for i, n in enumerate((len(text), linked, len(text) * (len(text) >= LABEL or text.endswith(SENTENCE_ENDS)))):
            look[i] += n
        if n := _points(text, owner, linked):
            points[owner] = points.get(owner, 0.0) + n
            chars[owner] = chars.get(owner, 0) + len(text) - linked
    own, holds, outside = dict(chars), set(), 0  # own: without what is below suggestions
    for node in reversed(_below(root)):
        article = node.tag in ("article", "main")
        look = looks.setdefault(node, [0, 0, 0, 0])
        look[3] += node.tag == "form" or any(isinstance(c, Node) and c.tag in FIELDS for c in node.children)
        if node.parent is not None:
            above = looks.setdefault(node.parent, [0, 0, 0, 0])
            for i in range(4):
                above[i] += look[i]
            for sums in (points, chars) if node.suggested else (points, chars, own):
                sums[node.parent] = sums.get(node.parent, 0) + sums.get(node, 0)
            if article or node in holds:
                holds.add(node.parent)
    order = [root]
    for node in order:
        order.extend(c for c in node.children if isinstance(c, Node) and not c.against and not c.suggested)
        if node.tag in ("article", "main"):
            outside = max(outside, own.get(node, 0))
    stay = []
    for node in asked:
        if node.subject and node.tag in BLOCKS:
            n, linked, prose, fields = looks[node]
            if node.tag in HEADINGS or 3 * linked < n and 2 * prose >= n and not fields:
                continue
        most = points.get(node, 0.0) > points.get(root, 0.0) / 2
        if not (node in holds and (most or not outside) or most and chars[node] >= SUBSTANTIAL > outside):
            node.against = True
            stay.append(node)
    return stay


def _score(root: Node) -> tuple[Node | None, dict[Node, tuple[int, int]]]:
    """The best container, the first in the page of equal ones, and (characters, characters in links) below each element.

    Points are summed once, from the leaves up, so a page of any depth takes time in proportion to its length.
    """
    sizes: dict[Node, tuple[int, int]] = {}
    order = _below(root)
    for text, owner, linked in blocks([root]):
        n, k = sizes.get(owner, (0, 0))
        sizes[owner] = (n + len(text), k + linked)
        owner.points += _points(text, owner, linked)
    best, most = None, -1.0
    for node in reversed(order):
        if node not in sizes:
            continue
        n, k = sizes[node]
        if node.tag in CONTAINERS or node is root:
            final = (node.points + 15 * node.liked * (node.points > 0)) * (1 - k / n)
            if final >= most:
                best, most = node, final
        if node.parent is not None:
            above = sizes.get(node.parent, (0, 0))
            sizes[node.parent] = (above[0] + n, above[1] + k)
            node.parent.points += node.points / (2 if node.tag in CONTAINERS else 1)
    return best, sizes


def main_text(page: str) -> str:
    """The article's blocks, one a line; empty if the page has no text."""
    root = parse(page)
    stay = _relent(root)
    text = _best_text(root)
    if not text and stay:
        for node in stay:
            node.against = False
        text = _best_text(root)
    return text


def _kept_siblings(node: Node, sizes: dict[Node, tuple[int, int]], inner: list, inside: bool) -> list:
    """The children of the node's parent that stay, in order; the node itself is `inner`.

    A sibling needs a fifth of the node's points, or to be a heading or paragraph beside a node that is no article, or an element
    like it (the same tag and class) that says a sentence without links; inside an article it only must not be a list of links.
    """
    limit, kept, run, whole = node.points * 0.2, [], [], node.tag in ("article", "main")

    def end_run() -> None:
        """Text that stands between blocks stays unless it is mostly links."""
        found = blocks(run)
        if sum(b[2] for b in found) < 0.25 * sum(len(b[0]) for b in found):
            kept.extend(run)
        kept.append(Node("hr", None))
        run.clear()

    for child in node.parent.children:
        if child is not node and (isinstance(child, str) or child.tag not in BLOCKS):
            run.append(child)
            continue
        end_run()
        if child is node:
            kept.extend(inner)
        elif not child.against and child in sizes:
            n, k = sizes[child]
            text_like = child.tag == "h1" if whole else child.tag in HEADINGS or child.tag in PARAGRAPHS and k / n < 0.25 and (n > 80 or k == 0)
            alike = not whole and child.tag == node.tag and child.names == node.names and not k and _sentence(child)
            if text_like or alike or child.points > 0 and child.points * (1 - k / n) >= limit or inside and k / n < 0.5:
                kept.append(child)
    end_run()
    return kept


def _sentence(node: Node) -> bool:
    """Whether the text ends as sentences do, and isn't a copyright line."""
    found = blocks([node])
    return bool(found) and found[-1][0].endswith(SENTENCE_ENDS) and not any("\u00a9" in b[0] for b in found)


def _best_text(root: Node) -> str:
    node, sizes = _score(root)
    if node is None:
        return "\n".join(b[0] for b in blocks([root]))
    article = node
    while article is not None and article.tag not in ("article", "main"):
        article = article.parent
    kept = [node]
    while node.parent is not None:
        inside = article is not None and node is not article
        kept = _kept_siblings(node, sizes, kept, inside)
        node = node.parent
        if node is article or not inside and node.tag not in TABLE_PARTS:
            break
    return "\n".join(b[0] for b in blocks(kept))


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of `pages` without the html, and `text` and `n_chars` (code points).

    A null or empty page, or one without text, gives an empty text. Every row gives a row: nulls, repeats and
    ties in other columns pass through. Columns of `pages` named text or n_chars are replaced. An
    empty table gives an empty result.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    own = pages.select(*kept, text_of(html_col).alias(html_col))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]), "text string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return own.mapInArrow(run, schema)
