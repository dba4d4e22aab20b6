"""Main text of web pages by two-pass block rules.

A page becomes blocks of text. Blocks inside menus, headers, footers, sidebars,
notices, adverts, forms and comments are known by their elements, classes and roles
and are out. The first pass labels every other block by its own link density,
length and stop-word density: good, bad or undecided. In the second, each undecided
block takes the label of the nearest decided block around it; at equal distance,
good wins, and where nothing is decided the block is kept.

If an ``article`` or ``main`` element has good blocks, only such elements count, and
in them lack of stop words, many links or a copyright sign make a block undecided, not
bad, and class names of paragraphs and the like count only for adverts and comments.
Stop words are known for some languages only: unless half of a page's long text or more
has their density, its other blocks are judged by length and links alone.

Cases: null and empty pages give an empty text; pages are read whole, in one pass;
unclosed and stray tags end with what contains them; repeated pages give equal
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import dataclasses
import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK_DENSITY = 0.5
SHORT = 70
STOP_LOW, STOP_HIGH = 0.1, 0.2

# fixed values: frequent function words of some languages
STOP_WORDS = frozenset((
    "the of and to in a is that for it as was with be by on not he his but at are this have "
    "from or an which you were they their has will would there been if more when "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il "
    "sont avec son aux ou elle mais nous vous cette "
    "el los y las del se por con una su para al lo como más o pero sus le ha me si sin sobre "
    "este ya entre cuando todo esta ser "
    "di che è per non il una sono da con gli della nel "
    "do os no da em dos uma não ao mais "
    "het een van op te dat niet zijn voor"
).split())

BLOCK_TAGS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noscript ol optgroup option p pre section summary table tbody "
    "td tfoot th thead tr ul").split())
VOID_TAGS = frozenset((
    "area base br col embed hr img input link meta param source track wbr").split())
FOREIGN_TAGS = frozenset(("svg", "math"))
#: elements that hold text of an article, whatever their classes say about sharing or notices
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote li td th dd dt pre".split())
#: classes of advertisements and reader comments, which hold inside an article as well
FOREIGN_WORDS = frozenset((
    "ad ads advert advertisement advertising adverts comment comments disqus discussion "
    "feedback promo promoted promotion reactions replies respond responses sponsor "
    "sponsored").split())
#: their content is not markup and never text of the page
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp".split())
BOILERPLATE_TAGS = frozenset((
    "aside button canvas datalist dialog footer form head header menu nav noscript object "
    "select svg template").split())
BOILERPLATE_ROLES = frozenset((
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search").split())
BOILERPLATE_WORDS = frozenset((
    "ad ads advert advertisement advertising adverts aside banner breadcrumb breadcrumbs "
    "comment comments consent cookie cookies copyright discussion disqus footer form gdpr "
    "header login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination popup promo promoted promotion reactions feedback "
    "recommended related replies respond responses search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription teaser toolbar widget widgets").split())
#: what follows them in a class name is about another part of the page
QUALIFIERS = frozenset("has is no not with without".split())
MAIN_TAGS = frozenset(("article", "main"))
#: an open element of the first kind ends where one of the others starts, up to a border
IMPLIED_END = {
    "p": (BLOCK_TAGS, frozenset("article aside body div section td th li blockquote".split())),
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th", "tr")), frozenset(("table",))),
    "th": (frozenset(("td", "th", "tr")), frozenset(("table",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "option": (frozenset(("option", "optgroup")), frozenset(("select",))),
}

# a quoted value may hold another tag if its end looks like that of a value; an unclosed
# quote reaches to the next quote at most, so it stays cheap
TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])"""
    r"""|"[^"<]*+"|'[^'<]*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^<>]*+)>""")
ATTRIBUTE = re.compile(
    r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclasses.dataclass
class Block:
    text: str
    link_chars: int
    boilerplate: bool
    main: bool
    label: bool | None = None  # good, bad, undecided


def _is_boilerplate(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in BOILERPLATE_TAGS and not (tag == "header" and in_main):
        return True
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value.lower() in BOILERPLATE_ROLES:
            return True
        if name not in ("class", "id") or tag in MAIN_TAGS and "comment" not in value.lower():
            continue
        for one in value.split():
            for word in map(str.lower, NAME_WORD.findall(one)):
                if word in QUALIFIERS:
                    break
                if word not in BOILERPLATE_WORDS or word == "header" and in_main:
                    continue
                if not in_main or tag not in TEXT_TAGS or word in FOREIGN_WORDS:
                    return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without labels."""
    found: list[Block] = []
    open_tags: list[tuple[str, bool]] = []  # name, boilerplate
    out, main, links = 0, 0, 0
    pieces: list[str] = []
    link_chars = 0

    def flush():
        nonlocal link_chars
        text = " ".join("".join(pieces).split())
        if text:
            found.append(Block(text, link_chars, out > 0, main > 0))
        pieces.clear()
        link_chars = 0

    def close(to: int):
        nonlocal out, main, links
        while len(open_tags) > to:
            name, boilerplate = open_tags.pop()
            out -= boilerplate
            main -= name in MAIN_TAGS
            links -= name == "a"

    def add(text: str):
        nonlocal link_chars
        text = entities.unescape(text)
        pieces.append(text)
        if links:
            link_chars += len("".join(text.split()))

    at, end = 0, len(page)
    while at < end:
        less = page.find("<", at)
        if less < 0:
            add(page[at:])
            break
        if less > at:
            add(page[at:less])
        if page.startswith("<!--", less):
            stop = page.find("-->", less + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), less):
            stop = page.find(">", less)
            at = end if stop < 0 else stop + 1
            continue
        match = TAG.match(page, less)
        if match is None:
            add("<")
            at = less + 1
            continue
        at = match.end()
        closing = match[1] or match[4]
        name = (match[2] or match[5]).lower()
        attributes = match[3] or match[6] or ""
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCK_TAGS:
            flush()
        if closing:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    close(i)
                    break
            continue
        if name in RAW_TAGS:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end if stop is None else stop.end()
            continue
        for i in range(len(open_tags) - 1, -1, -1):
            ended, border = IMPLIED_END.get(open_tags[i][0], ((), ()))
            if name in ended:
                close(i)
                break
            if open_tags[i][0] in border or not ended:
                break
        # of other elements a slash at the end closes foreign ones only
        if name in VOID_TAGS or name in FOREIGN_TAGS and attributes.endswith("/"):
            continue
        boilerplate = _is_boilerplate(name, attributes, main > 0)
        # plain inline elements change nothing and are not kept open
        if boilerplate or name in BLOCK_TAGS or name == "a":
            if boilerplate:
                flush()
            open_tags.append((name, boilerplate))
            out += boilerplate
            main += name in MAIN_TAGS
            links += name == "a"
    flush()
    return found


def _by_links(block: Block) -> bool:
    density = block.link_chars / max(1, len(block.text.replace(" ", "")))
    return density > LINK_DENSITY or block.text[0] == "©"


def _stops(block: Block) -> float:
    tokens = block.text.lower().split()
    return sum(t.strip(".,;:!?\"'()") in STOP_WORDS for t in tokens) / len(tokens)


def _first_pass(found: list[Block]) -> None:
    linked = [_by_links(b) for b in found]
    stops = [None if b.boilerplate or out or len(b.text) < SHORT else _stops(b)
             for b, out in zip(found, linked)]
    # is most of the long text in a language whose stop words are known?
    long = [(len(b.text), s >= STOP_LOW) for b, s in zip(found, stops) if s is not None]
    known = 2 * sum(n for n, has in long if has) >= sum(n for n, _ in long)
    for b, out, s in zip(found, linked, stops):
        if b.boilerplate:
            b.label = False
        elif out:
            b.label = None if b.main else False
        elif s is None:
            b.label = None
        elif s >= STOP_HIGH or (s >= STOP_LOW and len(b.text) > 2 * SHORT):
            b.label = True
        else:
            b.label = None if b.main or s >= STOP_LOW else not known


def _second_pass(found: list[Block]) -> None:
    before: list[tuple[int, bool] | None] = []
    last = None
    for i, b in enumerate(found):
        last = (i, b.label) if b.label is not None else last
        before.append(last)
    last = None
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if b.label is not None:
            last = (i, b.label)
            continue
        near = [(abs(i - n[0]), not n[1]) for n in (before[i], last) if n]
        b.label = not min(near)[1] if near else True


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line ends."""
    found = blocks(page or "")
    _first_pass(found)
    if any(b.main and not b.boilerplate and b.label is not False for b in found):
        found = [b for b in found if b.main and not b.boilerplate]
    _second_pass(found)
    return "\n".join(b.text for b in found if b.label)


def extracted(html: Column) -> Column:
    """The main text of each page."""

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return extract(html)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    return pages.select("page_id", "url", extracted(F.col(html_col)).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))
