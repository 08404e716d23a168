"""Main text of web pages by tree scoring.

The page becomes a tree of its block elements.  Parts that are never the article are left
out: by element (menus, forms, scripts), by role, and by words of class and id.  The words
and the form don't count against a part that holds most of the page's paragraph text (nearly
all, in several paragraphs, where nothing else speaks for it; comments never) unless it lies
outside the page's ``article`` or ``main``, nor where no text were left.  Every paragraph
passes points for its length and its commas to all elements around it, all of them to the
nearest, half to the next and a third of that with each further one; an element's points are discounted by the share of its
text that is links.  The best container is kept (the ``article`` or ``main`` around it where
there is one), with those of its siblings that score well or are plain paragraphs; lists and
boxes inside that are mostly links go.  A part made of boxes of one shape, a short line with a
date or the like before some text, is reader comments, unless it has half the page's text.

A link lasts to its end tag; without one, to the next link or block.  A named place isn't a link.

Character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by an empty line.  A null or empty page has an empty text, as has a
page without any.  Nothing is capped.  Rows are independent; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glucolake.llm.shared import batched, steps

# Names of elements and words of class, id and role that tell what a part is.
DROPPED = frozenset("nav aside footer form script style noscript template button select textarea input dialog iframe object embed svg canvas audio video map menu head title".split())
RAW = frozenset("script style textarea title iframe noscript template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption html body".split())
SPACED = frozenset("br td th img".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HARD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall social share sharing sharebar related recommended recommendations comment comments disqus respond replies reply discussion menu nav navbar navigation breadcrumb breadcrumbs pager pagination footer outbrain taboola login copyright".split()
)
SOFT = frozenset("sidebar header masthead banner widget toolbar tools search tags legal disclaimer meta byline rail side alert bar skip".split())
GOOD = frozenset("article body content entry main page post text story blog column hentry".split())
BASE = {"article": 10, "main": 10, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "address": -3}
COMMENTS = frozenset("comment comments disqus respond replies reply discussion".split())
#: Share of the page's paragraph text above which a part stays in spite of its class, id or form: where an element or a word speaks for it, where none does, and never.
MOST, NEARLY_ALL, NEVER = 0.5, 0.8, 2.0
#: Paragraphs of a part that only its share of the text speaks for.
FEWEST = 3
CLEANED = frozenset("ul ol dl div section table".split())
#: The least length of a plain paragraph beside an article that belongs to it; the longest line that can head a reader's comment.
LONE, HEAD = 80, 80
#: No block.
NONE = 1 << 60
# What a line over a reader's comment tells.
SAID = re.compile(
    r"\b\d{1,2}:\d{2}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}\.? [^\W\d]{3,9}\.?,? \d{4}\b|\b[^\W\d]{3,9} \d{1,2},? \d{4}\b"
    r"|\b(?:ago|says|said|wrote|writes|replied|reply|antworten|schrieb|sagt|répondre|dit|responder|dice)\b|\b(?:vor|hace|il y a) \d+",
    re.I,
)
#: Inline elements that class, id and style can leave out.
INLINE = frozenset("span small label ins".split())

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?P<name>class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
INLINE_TAGS = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in INLINE}
ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)
NAMED = re.compile(r"(?:^|[\s\"'])(?:name|id)\s*=", re.I)
CLOSERS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
#: Start tags that end an open element of the same kind, up to the element that bounds it.
SAME = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Node:
    __slots__ = ("tag", "up", "out", "inside", "points", "passed", "chars", "links", "weight", "need", "prose", "paragraphs", "texts", "first", "dated")

    def __init__(self, tag: str, up: Node | None, out: bool, weight: int, inside: bool = False, need: float = 0.0):
        self.tag, self.up, self.out, self.weight, self.inside = tag, up, out, weight, inside
        self.need = need  # share of the page's paragraph text without which the part is left out
        self.points, self.passed, self.chars, self.links = 0.0, 0.0, 0, 0
        self.prose, self.paragraphs, self.texts = 0, 0, 0
        self.first, self.dated = NONE, False  # number of the first block inside; whether a short one tells a date


def judged(tag: str, rest: str, inside: bool) -> tuple[bool, int, float]:
    """Whether an element is left out by its attributes, the weight of its class and id, and the share of text without which these leave it out."""
    words: set[str] = set()
    good = False  # a whole name, not the part of one that says comments or the like
    for m in ATTRIBUTE.finditer(rest):
        name, value = m["name"].lower(), m["a"] or m["b"] or m["c"] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, 0, 0.0
        if name == "role" and ROLES & set(value.lower().split()):
            return True, 0, 0.0
        if name in ("class", "id"):
            for one in value.split():
                found = {w.lower() for w in WORD.findall(one)}
                words |= found
                good = good or bool(found & GOOD) and not found & HARD
    any_good = bool(words & GOOD)
    weight = 25 * any_good - 25 * bool(words & SOFT)
    if tag in ("html", "body") or tag in ("article", "main") and (good or not words & {"comment", "comments", "ad", "ads", "advert"}):
        return False, 25 * any_good, 0.0
    if words & HARD or words & SOFT and not any_good and not inside:
        return False, weight, MOST if good or tag in ("article", "main") else NEVER if words & COMMENTS else NEARLY_ALL
    return False, weight, 0.0


def ended(page: str, tag: str) -> set[int]:
    """Where start tags of this name are that have an end tag of their own."""
    open_, found = [], set()
    for m in INLINE_TAGS[tag].finditer(page):
        if not m[1]:
            open_.append(m.start())
        elif open_:
            found.add(open_.pop())
    return found


def ended_links(page: str) -> set[int]:
    """Where ``a`` start tags are that the next ``a`` tag ends: links aren't nested."""
    found, last = set(), -1
    for m in ANCHOR.finditer(page):
        if not m[1]:
            last = m.start()
        elif last >= 0:
            found.add(last)
            last = -1
    return found


def leave_out_comments(root: Node, nodes: list[Node], written: list[tuple[Node, str, int]]) -> None:
    """Leave out parts that look like reader comments: two boxes or more, and nearly no others, with a short line that tells a date or the like before some text."""
    for k, (node, words, _) in enumerate(written):
        node.first = min(node.first, k)
        node.dated = node.dated or len(words) <= HEAD and bool(SAID.search(words))
    for x in reversed(nodes[1:]):
        x.up.first = min(x.up.first, x.first)
        x.up.dated = x.up.dated or x.dated
    boxes: Counter[int] = Counter()
    shaped: Counter[int] = Counter()
    for x in nodes[1:]:
        if x.texts and not x.out and x.tag in BLOCKS:
            boxes[id(x.up)] += 1
            head, words, _ = written[x.first]
            if x.texts >= 2 and x.dated and len(words) <= HEAD and words[-1] not in ".!?" and not re.fullmatch("h[1-6]", head.tag):
                shaped[id(x.up)] += 1
    for x in nodes[1:]:
        like = shaped[id(x)] >= 2 and shaped[id(x)] >= 0.8 * boxes[id(x)]
        x.out = x.out or x.up.out or like and x.prose < MOST * root.prose and x.tag not in ("html", "body", "article", "main")


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = Node("#root", None, False, 0)
    nodes, stack = [root], [root]
    links, lasting = 0, False  # whether text is in a link, and in one that has an end tag
    whole_links: set[int] | None = None
    opened: Counter[str] = Counter()  # open elements by name: the stack is searched only for what it has
    blocks: list[tuple[Node, list[str], list[int]]] = []  # element, text pieces, [characters in links]
    fresh = True  # the next text begins a block
    pairs: dict[str, set[int]] = {}

    def text(piece: str) -> None:
        nonlocal fresh
        if stack[-1].out or not piece:
            return
        if fresh:
            if not piece.strip():
                return
            blocks.append((stack[-1], [], [0]))
            fresh = False
        if "&" in piece:
            piece = _html.unescape(piece)
        blocks[-1][1].append(piece)
        if links:
            blocks[-1][2][0] += len(piece)

    def close_to(depth: int) -> None:
        nonlocal fresh, links
        for x in stack[depth:]:
            fresh = fresh or x.tag in BLOCKS
            opened[x.tag] -= 1
        if fresh and not lasting:
            links = 0
        del stack[depth:]

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "a":
                links, lasting = 0, False
            if opened[tag]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close_to(depth)
                        break
                    if stack[depth].tag in ("article", "table") and tag in ("div", "p", "section"):
                        break
            if tag in BLOCKS:
                fresh, links = True, links if lasting else 0
            if tag in SPACED:
                text(" ")
            continue
        if tag in SPACED:
            text(" ")
        if tag in VOID:
            fresh = fresh or tag == "hr"
            continue
        if tag == "a":
            if whole_links is None:
                whole_links = ended_links(page)
            links = 1 if HREF.search(m["rest"] or "") or not NAMED.search(m["rest"] or "") else 0
            lasting = bool(links) and m.start() in whole_links
            continue
        if tag in RAW:
            end = CLOSERS[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag not in BLOCKS and tag not in DROPPED:
            # Inline elements are no part of the tree, but for those that are left out and what they hold.
            if tag in INLINE and not m[0].endswith("/>"):
                out = bool(stack[-1].out and opened[tag])
                if not out and m["rest"] and ("class" in m["rest"] or "id" in m["rest"] or "style" in m["rest"]):
                    hidden, _, need = judged(tag, m["rest"], True)
                    if hidden or need:
                        if tag not in pairs:
                            pairs[tag] = ended(page, tag)
                        out = m.start() in pairs[tag]
                if out:
                    node = Node(tag, stack[-1], True, 0)
                    opened[tag] += 1
                    nodes.append(node)
                    stack.append(node)
            continue
        if tag in CLOSES_P and opened["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close_to(depth)
                    break
                if stack[depth].tag in ("td", "th", "table", "button") or stack[depth].tag in INLINE:
                    break
        if tag in SAME:
            ends, bound = SAME[tag]
            for depth in range(len(stack) - 1, 0, -1) if any(opened[e] for e in ends) else ():
                if stack[depth].tag in bound:
                    break
                if stack[depth].tag in ends:
                    close_to(depth)
                    if tag != "tr":
                        break
        up = stack[-1]
        inside = up.inside or up.tag in ("article", "main")
        out, weight, need = (True, 0, 0.0) if up.out or tag in DROPPED and tag != "form" or tag == "header" and not inside else judged(tag, m["rest"] or "", inside)
        node = Node(tag, up, out, weight, inside, max(need, MOST) if tag == "form" else need)
        opened[tag] += 1
        nodes.append(node)
        stack.append(node)
        fresh = True
        links = links if lasting else 0

    written = []
    for node, pieces, linked in blocks:
        words = " ".join("".join(pieces).split())
        if words:
            written.append((node, words, linked[0]))
            node.texts += 1
            if len(words) >= 25:
                node.prose += len(words) - min(len(words), linked[0])
                node.paragraphs += 1
    for x in reversed(nodes[1:]):  # elements come after those around them
        x.up.prose += x.prose
        x.up.paragraphs += x.paragraphs
        x.up.texts += x.texts
    always = [x.out for x in nodes]
    doubted: set[int] = set()
    has_article = False
    for x in nodes[1:]:
        if x.need or id(x.up) in doubted:
            doubted.add(id(x))
        elif x.tag in ("article", "main") and x.texts:
            has_article = True
    for x in nodes[1:]:
        stays = x.prose > x.need * root.prose and (x.need < NEARLY_ALL or x.paragraphs >= FEWEST) and (not has_article or x.inside)
        x.out = x.out or x.up.out or x.need > 0 and not stays
    leave_out_comments(root, nodes, written)
    if best := main_part(root, nodes, written):
        return best
    for x, out in zip(nodes, always, strict=True):  # once more without the filter
        x.out, x.points, x.passed, x.chars, x.links = out, 0.0, 0.0, 0, 0
    return main_part(root, nodes, written) or "\n\n".join(words for node, words, _ in written if not node.out)


def main_part(root: Node, nodes: list[Node], written: list[tuple[Node, str, int]]) -> str:
    """The text of the best container and its good siblings, of blocks (element, words, characters in links) that aren't left out."""
    found = []
    for node, words, linked in written:
        if node.out:
            continue
        found.append((node, words))
        size = len(words)
        node.chars += size
        node.links += min(size, linked)
        if size >= 25:
            points = 1 + sum(words.count(c) for c in ",،、，") + min(size // 100, 3)
        else:
            points = 0.2
        x = node if node.tag not in ("p", "pre", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "figcaption") else node.up
        if x is not None:
            x.points += points
    if not found:
        return ""
    for x in reversed(nodes[1:]):  # elements come after those around them
        x.up.chars += x.chars
        x.up.links += x.links
        x.up.passed += x.points / 2 + x.passed / 3
        x.points += x.passed
    root.points = 0.0

    def score(x: Node) -> float:
        return (x.points + (BASE.get(x.tag, -5 if x.tag[0] == "h" and x.tag != "html" else 0) + x.weight) * min(1.0, x.points / 5)) * (1 - x.links / max(1, x.chars))

    best = max((x for x in nodes[1:] if x.points and not x.out), key=score, default=root)
    x = best
    while x is not None and x.tag != "article":
        x = x.up
    if x is None:
        x = best
        while x is not None and x.tag != "main":
            x = x.up
    top = x or best
    kept = {id(top)}
    if top.up is not None:
        least = max(2.0, 0.2 * max(score(best), score(top)))
        for s in nodes:
            if s.up is top.up and s is not top and not s.out and s.chars:
                # Beside an article a heading or a short line may be anything.
                plain = s.tag in ("p", "pre", "blockquote", "h1", "h2", "h3") if x is None else s.tag in ("p", "pre", "blockquote") and s.chars >= LONE
                if score(s) >= least or plain and s.links < 0.25 * s.chars:
                    kept.add(id(s))
    shown: set[int] = set()
    for x in nodes:
        if id(x) in kept or x.up is not None and id(x.up) in shown and not (x.tag in CLEANED and x.links > 0.5 * x.chars):
            shown.add(id(x))
    texts = [words for node, words in found if id(node) in shown]
    return "\n\n".join(texts)


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: id, url, ``text`` (empty if none), ``n_chars`` (its code points)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 2):
                texts = [extract(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [id_column, url_column, "text", "n_chars"])

    return batched(pages.select(id_column, url_column, html_column)).mapInArrow(run, f"`{id_column}` {kinds[id_column]}, `{url_column}` {kinds[url_column]}, text string, n_chars long")
