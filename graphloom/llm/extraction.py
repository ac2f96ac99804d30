"""Main text of web pages by two passes of block rules.

A page is cut into blocks; the first pass decides each by its stop-word density, length and link density, and by the part of
the page it stands in: outer parts hold no main text, in an article or main element less evidence is enough. The second gives
blocks too short or too mixed to decide the label of their nearest decided neighbours, of the same article or main element if
it has any. What a class, id or form tag says is weak evidence of an outer part: what holds the page's principal article, or
most stop words of the element around it, is a wrapper whatever it is called.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import narrow

#: Elements that end a block, whose content is never text, and that hold no main text.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NO_TEXT_TAGS = frozenset("script style noscript template title textarea svg math iframe object select button canvas video audio map".split())
OUTER_TAGS = frozenset("nav aside footer menu".split())
WEAK_TAGS = frozenset("form dialog header".split())
MAIN_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run to the end of the page if nothing closes them; of others without an end only the tag is passed over.
RUNNING_TAGS = frozenset("script style title textarea".split())
OUTER_ROLES = frozenset("navigation contentinfo complementary menu".split())
WEAK_ROLES = frozenset("banner search dialog alert alertdialog form".split())
#: Words of a class or id that name such a part, those that name reader comments, those that tell of a state or layout.
OUTER_NAMES = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent\w*|gdpr|notice|newsletter|subscri\w*|sidebar\w*|widget\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|masthead|share|sharing|social\w*|related\w*|recommend\w*|popup|modal|overlay|login|signup|search\w*|pagination|pager|copyright)\Z")
COMMENT_NAMES = re.compile(r"(?:comments?|commentlist|respond|disqus\w*)\Z")
STATE_WORDS = frozenset("has no not with without is show hide open opened closed enabled disabled on off".split())
#: Frequent words of four languages.
STOP_WORDS = frozenset("a and are as at be by for from in is it not of on or that the this to was were which with you au aux avec ce dans de des du elle en est et il je la le les mais ne nous ou par pas pour que qui sur un une das dem den der die ein eine er es für ich im ist mit nicht sich sie und von zu auf al como con del el los las lo más no o para pero por se sin su una y".split())

LINK_DENSITY = 0.5
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.12, 0.22
#: A block that is linked to a greater part than this is no prose, whatever its stop words.
ALL_LINKED = 0.9
#: Stop words that make an outer-named part a wrapper, if they are most of those around it.
WRAPPER_STOPS = 20

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag: a > in quotes does not end it. Quotes open after = only.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


@dataclass(slots=True)
class Part:
    """An element that may be outer, or is an article or main one."""

    up: Part | None = None
    outer: int = 0  # WEAK, STRONG or 0
    main: int = 0  # number of the innermost article or main element, 0 outside
    begins_main: bool = False
    stops: int = 0
    hidden: bool = False


WEAK, STRONG = 1, 2


@dataclass(slots=True)
class Block:
    part: Part
    texts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    text: str = ""
    words: int = 0
    stops: int = 0

    @property
    def outer(self) -> bool:
        return self.part.hidden

    @property
    def main(self) -> int:
        return self.part.main


def _named(value: str) -> int:
    """What the words of a class or id say."""
    said = 0
    for word in value.split():
        parts = {word, *re.split(r"[-_]+", word)}
        if not parts & STATE_WORDS:
            said = max(said, STRONG if any(map(COMMENT_NAMES.match, parts)) else WEAK if any(map(OUTER_NAMES.match, parts)) else 0)
    return said


def _outer(tag: str, attributes: str, in_main: int) -> int:
    """How surely an element is an outer part."""
    said = STRONG if tag in OUTER_TAGS else WEAK if tag in WEAK_TAGS and not (tag == "header" and in_main) else 0
    if tag in ("html", "body") or not attributes:
        return said
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            said = max(said, STRONG if value in OUTER_ROLES else WEAK if value in WEAK_ROLES else 0)
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            said = STRONG
        elif name in ("class", "id"):
            found = _named(value)
            # an article may be a comment, but its class says nothing else against it
            said = max(said, found if tag not in MAIN_TAGS or found == STRONG else 0)
    return said


def tags(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """The text before each tag, whether the tag closes, its name and its attributes; last the text after all tags.

    Every place is looked at a bounded number of times: after quotes or a CDATA section that never end, quotes or such sections
    mean nothing in the rest of the page. A comment that never ends takes the rest.
    """
    held: list[str] = []
    endless: set[str] = set()
    at, last, quotes, sections = 0, page.rfind(">"), True, True
    while (start := page.find("<", at)) >= 0:
        held.append(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 2)
            at = stop + 3 if stop >= 0 else len(page)
            continue
        if start > last:
            at = start
            break
        if sections and page.startswith("<![CDATA[", start):
            stop = page.find("]]>", start)
            if sections := stop >= 0:
                held.append(page[start + 9 : stop])
                at = stop + 3
                continue
        if page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1
            continue
        name = _NAME.match(page, start + 1)
        if name is None:
            held.append("<")
            at = start + 1
            continue
        rest = _REST.match(page, name.end()) if quotes else None
        quotes = rest is not None
        stop = rest.end() if rest else page.find(">", name.end()) + 1
        at = stop
        if name[2].lower() in NO_TEXT_TAGS and not name[1] and not page.startswith("/", stop - 2):
            tag = name[2].lower()
            closer = None if tag in endless else _CLOSERS[tag].search(page, stop)
            if closer:
                at = closer.end()
            elif tag in RUNNING_TAGS:
                at = len(page)
            else:
                endless.add(tag)
        yield "".join(held), bool(name[1]), name[2].lower(), page[name.end() : stop - 1]
        held = []
    yield "".join(held) + page[at:], True, "", ""


_CLOSERS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in NO_TEXT_TAGS}


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, those without text left out."""
    out: list[Block] = []
    root = Part()
    parts = [root]
    now = Block(root)
    stack: list[tuple[str, Part]] = []
    open_: Counter[str] = Counter()
    links, breaks, mains = 0, 0, 0

    def end(tag: str = "") -> None:
        nonlocal now
        now.text = " ".join("".join(now.texts).split())
        if now.text:
            words = now.text.lower().split()
            now.words, now.stops = len(words), sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words)
            now.part.stops += now.stops
            out.append(now)
        now = Block(stack[-1][1] if stack else root, heading=len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())

    def part_of(tag: str, attributes: str) -> Part:
        nonlocal mains
        around = stack[-1][1] if stack else root
        said, begins = _outer(tag, attributes, around.main), tag in MAIN_TAGS
        mains += begins
        if not said and not begins:
            return around
        parts.append(Part(around, said, mains if begins else around.main, begins))
        return parts[-1]

    for raw, closing, tag, attributes in tags(page):
        if raw:
            text = html.unescape(raw)
            now.texts.append(text)
            if links:
                now.linked += len(text)
            if breaks and not raw.isspace():
                breaks = 0
        if tag in NO_TEXT_TAGS and not closing:
            now.texts.append(" ")
        elif tag == "br":
            breaks += 1
            now.texts.append(" ")
            if breaks == 2:
                end()
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCK_TAGS:
            if closing:
                while open_[tag]:
                    gone = stack.pop()[0]
                    open_[gone] -= 1
                    if gone == tag:
                        break
                end()
            else:
                part = part_of(tag, attributes)
                if tag not in VOID_TAGS and tag != "p" and tag != "li":
                    stack.append((tag, part))
                    open_[tag] += 1
                    end(tag)
                else:
                    end(tag)
                    now.part = part
            links = breaks = 0
    end()
    _hide(parts)
    return out


def _hide(parts: list[Part]) -> None:
    """Decide which parts are outer. Every part comes after the one around it."""
    for p in reversed(parts[1:]):
        if p.outer < STRONG:
            p.up.stops += p.stops
    # an article in a part that is called outer is the principal one only if it has most of the page's stop words
    worst = {id(parts[0]): 0}
    for p in parts[1:]:
        worst[id(p)] = max(p.outer, worst[id(p.up)])
    may_be = lambda p: p.begins_main and (worst[id(p)] == 0 or worst[id(p)] == WEAK and 2 * p.stops > parts[0].stops)
    principal = max(filter(may_be, parts), key=lambda p: p.stops, default=None)
    around, p = set(), principal
    while p is not None:
        around.add(id(p))
        p = p.up
    scope = {id(parts[0]): parts[0]}
    for p in parts[1:]:
        scope[id(p)] = p if p.begins_main else scope[id(p.up)]
        within = scope[id(p.up)]
        most = p.stops >= WRAPPER_STOPS and 2 * p.stops > within.stops and (principal is None or within is not parts[0])
        wraps = id(p) in around or p.outer == WEAK and most
        p.hidden = p.up.hidden or bool(p.outer) and not wraps


def first_pass(all_blocks: list[Block]) -> list[int]:
    """1 main text, -1 not, 0 undecided, 2 undecided but likely."""
    labels = []
    for b in all_blocks:
        n = len(b.text)
        density = b.linked / n
        stops = b.stops / max(b.words, 1)
        if b.outer or density > ALL_LINKED:
            labels.append(-1)
        elif density > LINK_DENSITY:
            # a sentence that is mostly one link goes with its neighbours
            labels.append(0 if b.main and stops >= STOP_LOW else -1)
        elif n < SHORT:
            likely = 2 if b.heading or b.main else 0
            labels.append(likely if density <= 0.2 else 0 if b.main else -1)
        else:
            some = stops >= STOP_LOW or n >= LONG
            labels.append(1 if stops >= STOP_HIGH or (b.main and some) else 2 if b.main or some else 0)
    return labels


def second_pass(labels: list[int], parts: list[int] | None = None) -> list[bool]:
    """Undecided blocks take the label of the nearer decided neighbour; at equal distance of unlike ones likely blocks are kept.

    A block of one of the ``parts`` (0 is none) looks for neighbours there first. On a page without any main text there is nothing
    to inherit: all undecided ones are kept.
    """
    if 1 not in labels:
        return [label >= 0 for label in labels]
    out = _nearest(labels)
    places: dict[int, list[int]] = {}
    for i, part in enumerate(parts or ()):
        if part:
            places.setdefault(part, []).append(i)
    for own in places.values():
        inside = [labels[i] for i in own]
        if any(abs(label) == 1 for label in inside):
            for i, keep in zip(own, _nearest(inside), strict=True):
                out[i] = keep
    return out


def _nearest(labels: list[int]) -> list[bool]:
    n = len(labels)
    before, after, last = [None] * n, [None] * n, None
    for i in range(n):
        before[i] = last
        last = i if abs(labels[i]) == 1 else last
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if abs(labels[i]) == 1 else last
    out = []
    for i, label in enumerate(labels):
        if abs(label) == 1:
            out.append(label == 1)
            continue
        left, right = before[i], after[i]
        if left is None and right is None:
            out.append(label == 2)
        elif left is None or right is None:
            out.append(labels[right if left is None else left] == 1)
        elif labels[left] == labels[right]:
            out.append(labels[left] == 1)
        elif i - left == right - i:
            out.append(label == 2)
        else:
            out.append(labels[left if i - left < right - i else right] == 1)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    kept = second_pass(first_pass(found), [0 if b.outer else b.main for b in found])
    return "\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text and n_chars, its code points. A null or empty page has the empty text.

    A very long page is one row of one task, worked through in time proportional to its length, however broken it is.
    """
    pages = narrow(pages, "page_id", "url", "html")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    out = pages.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
