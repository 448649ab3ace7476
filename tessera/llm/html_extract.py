"""Main text of web pages by two-pass block rules.

Pass one cuts the page into blocks at block-level tags and decides each by its section, link density, length and stop-word
density: boilerplate, main text, or undecided. Pass two gives undecided blocks, short ones mostly, the label of the nearest
decided neighbour; neighbours beyond a section's border count as further away, and a section without any decided block goes
by its kind.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The commonest words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could do for from had has have he her his how if in into is it its more
    most my no not of on one or our out she so some than that the their them then there these they this to up was we were what when which who will with
    would you your aber als am an auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer eines er es für hat hatte ich
    ihr im in ist ja kann man mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur au aux
    avec ce ces cette comme dans de des du elle en est et été être il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa sans se
    ses son sont sur un une vous al como con del desde donde el ella ellos entre era esta este fue ha hasta hay la las lo los más me mi muy no nos para
    pero por porque que se ser si sin sobre son su sus también te tiene todo un una y ya""".split()
)
#: Tags that start and end a block.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head
    header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements whose content is never text of the page.
DROPPED = frozenset("script style head title noscript template svg math iframe object select button textarea canvas audio video map datalist".split())
#: Of those, elements whose content is not markup.
RAW = frozenset("script style title textarea noscript iframe".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Sections that are boilerplate by their element or role.
BAD_SECTIONS = frozenset("nav footer aside form menu dialog search".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
#: Words in a class or id that name a boilerplate section.
BAD_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright
    disclaimer discussion disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination
    popup promo promoted promotion recommended related reply replies respond share sharing shares sidebar sidebars signup social sponsor sponsored sponsors
    subscribe subscription tagcloud tags toolbar topbar widget widgets""".split()
)
#: Of these, words that have other senses and need company; words beside them that keep the sense; words that say
#: a section isn't what the rest of its name says; words for main content; words for readers' comments.
VAGUE_NAMES = frozenset("ad banner discussion footer header login notice notices overlay promo promoted promotion related reply replies respond share shares social tags widget widgets".split())
COMPANIONS = frozenset(
    """area articles bar block body bottom box btn button buttons center col column container content group holder icons inner item items layer left line link links list lower
    menu mobile module news outer page panel placeholder posts primary right row secondary section site slot small sticky stories text title top unit upper wrap wrapper zone""".split()
)
DENIALS = frozenset("no not without with has have is free hide show enable enabled disable disabled".split())
MAIN_NAMES = frozenset("article post entry content story".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can hold an article and are never hidden by a class word such as "header-image".
MAIN_SECTIONS = frozenset("article main".split())
#: Elements that an end tag of another kind doesn't close, and end tags that close them all the same.
HOLDERS, CLOSERS = frozenset("article main body table".split()), frozenset("html body article main".split())
#: Block-level elements that may stand in a form control.
IN_CONTROLS = frozenset("option optgroup hr legend".split())

#: Pass one: link density from which a block is boilerplate; words from which a block may be main text, and stop-word
#: densities from which one of those, or a long one, is; words from which a block is long.
LINKS, WORDS, STOPS, LONG, LONG_STOPS = 0.5, 10, 0.2, 40, 0.1
#: Pass two: what a section border adds to the distance between blocks.
BORDER = 1000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_HINT = re.compile(r"class|id|role|hidden|style", re.I)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*)))?")
_NAME = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_EDGE = re.compile(r"^\W+|\W+$")


class Block:
    __slots__ = ("good", "head", "linked", "parts", "section", "text")

    def __init__(self, section: int, head: bool = False):
        self.section, self.head, self.parts, self.linked, self.good, self.text = section, head, [], 0, None, ""


def _bad(tag: str, attrs: str, in_main: bool) -> bool:
    """Whether an element starts a boilerplate section, by its name or its attributes."""
    if tag in BAD_SECTIONS or (tag == "header" and not in_main):
        return True
    for name, a, b, c in _ATTR.findall(attrs) if tag not in ("html", "body") and _HINT.search(attrs) else ():
        name, value = name.lower(), html.unescape(a or b or c)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", "")):
            return True
        if name == "role" and BAD_ROLES.intersection(value.lower().split()):
            return True
        if name in ("class", "id") and any(map(_bad_name, [_NAME.findall(_CAMEL.sub("-", w).lower()) for w in value.split()], [tag in MAIN_SECTIONS] * len(value.split()))):
            return True
    return False


def _bad_name(parts: list[str], main_tag: bool) -> bool:
    """Whether the words of one class or id name boilerplate: by their first or last word, unless another one denies it
    ("no-sidebar", "page-with-header"). A word with other senses counts where all the rest are boilerplate words, companions
    or numbers ("share-buttons", not "share-price-report"); "article-header" names a part of the content, "story-comments" doesn't. On
    ``article`` and ``main`` only readers' comments count."""
    if not parts or DENIALS.intersection(parts):
        return False
    ends = {parts[0], parts[-1]}
    if main_tag:
        return bool(COMMENT_NAMES & ends) and not MAIN_NAMES.intersection(parts[1:])
    if parts[-1] in ("header", "footer") and MAIN_NAMES.intersection(parts):
        return False
    if (ends & BAD_NAMES) - VAGUE_NAMES:
        return True
    if parts[0] in VAGUE_NAMES and MAIN_NAMES.intersection(parts[1:]):
        return False
    plain = BAD_NAMES | COMPANIONS | (MAIN_NAMES if parts[-1] in VAGUE_NAMES else frozenset())
    return bool(ends & VAGUE_NAMES) and "main" not in parts and all(w in plain or w.isdigit() for w in parts)


def _is_main(attrs: str) -> bool:
    return "main" in attrs.lower() and any(name.lower() == "role" and "main" in (a or b or c).lower().split() for name, a, b, c in _ATTR.findall(attrs))


def tokens(page: str) -> list[tuple[int, str, str]]:
    """(0, text, ""), (1, tag, attributes) and (2, tag, "") in page order; comments, and elements whose content isn't markup, are
    left out. Each character is passed a bounded number of times: what was once searched in vain isn't searched again."""
    out: list[tuple[int, str, str]] = []
    at, n = 0, len(page)
    missing: set[str] = set()  # strings that don't occur any more

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        if (found := page.find(what, start)) < 0:
            missing.add(what)
        return found

    while at < n:
        lt = find("<", at)
        if lt < 0:
            out.append((0, page[at:], ""))
            break
        if lt > at:
            out.append((0, page[at:lt], ""))
        m = _TAG.match(page, lt)
        if not m:
            if page.startswith("<!--", lt):
                end = lt + 4 if page.startswith((">", "->"), lt + 4) else find("-->", lt + 4)
                at = n if end < 0 else page.index(">", end) + 1
            elif page.startswith("<![CDATA[", lt) and (end := find("]]>", lt)) >= 0:
                at = end + 3
            elif page.startswith(("<!", "<?", "</"), lt):
                at = find(">", lt) + 1 or n
            else:
                out.append((0, "<", ""))
                at = lt + 1
            continue
        at = start = m.end()
        while stop := _STOP.search(page, at) if ">" not in missing else None:  # quotes hold the end of a tag only behind an equals sign
            at = stop.end()
            if stop[0] == ">":
                break
            if page[start : at - 1].rstrip()[-1:] == "=" if at - start < 64 else page[max(start, at - 64) : at - 1].rstrip()[-1:] == "=":
                close = find(stop[0], at)
                if close >= 0:
                    at = close + 1
        else:
            break  # the page's end cuts the tag off
        tag, attrs = m[2].lower(), page[start : at - 1]
        if m[1]:
            out.append((2, tag, ""))
        elif tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
        else:
            out.append((1, tag, attrs))
    return out


_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


def _self_closing(tag: str, attrs: str) -> bool:
    """Only foreign elements can be; a slash at the end of an unquoted value is part of it."""
    return tag in ("svg", "math") and attrs.endswith("/") and not re.search(r"=\s*[^\s\"'=]*/\Z", attrs[-256:])


def _ends(found: list[tuple[int, str, str]]) -> dict[int, int]:
    """Where dropped elements end, by the place of their start tags; those without an end tag are left out."""
    open_at: dict[str, list[int]] = {}
    out = {}
    for i, (kind, tag, attrs) in enumerate(found):
        if kind and tag in DROPPED:
            if kind == 2:
                if open_at.get(tag):
                    out[open_at[tag].pop()] = i
            elif not _self_closing(tag, attrs):
                open_at.setdefault(tag, []).append(i)
    return out


class _Open:
    """The stack of open elements, with the places of each tag, of blocks, of holders and of dropped elements, so that none
    of the rules for leaving elements has to look through it."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, bool]] = []  # element, section before it, whether it is a link, whether that section is main
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.holders: list[int] = []
        self.dropped: list[int] = []
        self.links = self.mains = 0

    def push(self, tag: str, section: int, in_main: bool, dropped: bool = False) -> None:
        k = len(self.stack)
        self.stack.append((tag, section, tag == "a", in_main))
        self.places.setdefault(tag, []).append(k)
        for where, own in ((self.blocks, tag in BLOCK_TAGS), (self.holders, tag in HOLDERS), (self.dropped, dropped)):
            if own:
                where.append(k)
        self.links += tag == "a"
        self.mains += in_main

    def leave(self, k: int) -> int:
        """Closes elements from place k on; the section before it."""
        section = self.stack[k][1]
        while len(self.stack) > k:
            tag, _, link, in_main = self.stack.pop()
            self.places[tag].pop()
            self.links -= link
            self.mains -= in_main
        for where in (self.blocks, self.holders, self.dropped):
            while where and where[-1] >= k:
                where.pop()
        return section

    def last(self, tag: str) -> int:
        own = self.places.get(tag)
        return own[-1] if own else -1


def blocks(page: str) -> tuple[list[Block], list[str]]:
    """Blocks in page order, and the kind of each section: bad, form, main or plain."""
    kinds, out, opened, section, now = ["plain"], [], _Open(), 0, Block(0)
    found = tokens(page)
    ends = _ends(found)

    def cut(head: bool = False) -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = Block(section, head)

    i, n = 0, len(found)
    while i < n:
        kind, tag, attrs = found[i]
        i += 1
        if kind == 0:
            if not opened.dropped:
                s = html.unescape(tag)
                now.parts.append(s)
                if opened.links:
                    now.linked += len("".join(s.split()))
            continue
        if kind == 1 and tag in DROPPED and i - 1 in ends:
            if tag in BLOCK_TAGS:
                cut()
            i = ends[i - 1] + 1
            continue
        if tag in BLOCK_TAGS:
            cut(kind == 1 and tag in HEADINGS)
        if kind == 2:
            k = opened.last(tag)
            if k >= 0 and (tag in CLOSERS or not opened.holders or k >= opened.holders[-1]):  # a stray end tag doesn't close what holds it
                section = opened.leave(k)
                now.section = section if not now.parts else now.section
            continue
        if tag in VOID or _self_closing(tag, attrs):
            continue
        if opened.dropped and tag in BLOCK_TAGS and tag not in IN_CONTROLS:  # a control without an end tag ends where a block begins
            section = opened.leave(opened.dropped[0])
        if tag in DROPPED:
            opened.push(tag, section, kinds[section] == "main", dropped=True)
            continue
        if tag in BLOCK_TAGS and (k := opened.last("p")) >= 0 and opened.blocks[-1] == k and (tag == "p" or k == len(opened.stack) - 1):
            opened.leave(k)  # an open paragraph ends here, and inline elements left open in it
        before = section
        in_main = opened.mains > 0 or kinds[section] == "main"
        if (kinds[section] != "bad" and (tag in BLOCK_TAGS or tag in BAD_SECTIONS or tag == "span")) and (kinds[section] != "form" or tag in MAIN_SECTIONS):
            kind_of = ("form" if tag == "form" else "bad") if _bad(tag, attrs, in_main) else "main" if tag in MAIN_SECTIONS or _is_main(attrs) else None
            if kind_of:
                kinds.append(kind_of)
                section = len(kinds) - 1
                if tag not in BLOCK_TAGS and now.parts:
                    cut()
        opened.push(tag, before, kinds[before] == "main")
        if not now.parts:
            now.section = section
    cut()
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text], kinds


def decide(b: Block, kind: str) -> bool | None:
    """Pass one: True for main text, False for boilerplate, None for undecided."""
    if kind in ("bad", "form"):
        return False
    letters = len("".join(b.text.split()))
    if letters and b.linked / letters >= LINKS:
        return False
    words = [_EDGE.sub("", w) for w in b.text.lower().split()]
    if len(words) < WORDS:
        return None
    stops = sum(w in STOP_WORDS for w in words) / len(words)
    if len(words) >= LONG and not b.linked and not stops:
        return True  # prose of a language whose stop words aren't listed
    return True if stops >= (LONG_STOPS if len(words) >= LONG else STOPS) else None


def extract(page: str | None) -> str:
    """The main text: blocks judged main, in page order, joined by one space; empty if there are none."""
    found, kinds = blocks(page or "")
    for b in found:
        b.good = decide(b, kinds[b.section])
    if "form" in kinds and not any(b.good for b in found):  # a form around the whole page is no form of the page
        kinds = ["plain" if k == "form" else k for k in kinds]
        for b in found:
            b.good = decide(b, kinds[b.section])
    first = [b.good for b in found]
    outside = any(b.good is not None and kinds[b.section] not in ("bad", "form") for b in found)
    n = len(found)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for side, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        near, previous = None, None
        for i in order:
            if near is not None:
                near = (near[0] + 1 + BORDER * (found[i].section != found[previous].section), near[1])
            previous = i
            if first[i] is None:
                side[i] = near
            else:
                near = (0, first[i])
    for i, b in enumerate(found):
        if first[i] is not None:
            continue
        near = [x for x in (before[i], after[i]) if x and x[0] < BORDER]
        if kinds[b.section] == "main":
            near = [x for x in near if x[1]] or [(0, True)] if not near or any(x[1] for x in near) else near
            b.good = min(near, key=lambda x: (x[0], not x[1]))[1] if any(x[1] for x in near) else not b.linked
        elif near or before[i] or after[i]:
            near = near or [x for x in (before[i], after[i]) if x]
            if not outside and not b.linked and len(b.text.split()) >= WORDS:
                b.good = True  # only menus and the like are decided: they don't decide what stands outside them
                continue
            b.good = min(near, key=lambda x: (x[0], x[1] if x is not after[i] or not b.head else -1))[1]  # a heading goes with what follows
        else:
            b.good = kinds[b.section] not in ("bad", "form") and b.linked == 0
    return " ".join(b.text for b in found if b.good)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; null html is empty, and a page without main text gives "".

    Repeated rows come out as often as they come in, null ids and urls stay null, an empty table gives no rows, other columns
    whatever their names, are not read. A page costs time and memory in proportion to its own length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
