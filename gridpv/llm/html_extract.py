"""HTML extraction by tag-path ratios.

Method: text nodes are grouped by their root-to-leaf tag path.  Each path gets the ratios of text
length and of punctuation to its nodes.  Both are smoothed over the page in node order and averaged per path,
fused with the share of text outside links and with a prior (``NAMED_PRIOR``) for elements whose tag, role, class or id says
that they are a menu, header, footer, sidebar, notice, advert, form or comment section.  Paths whose fused
score reaches THRESHOLD of the page's mean are content, and blocks with content are always
kept.  The article is the deepest element that holds all of the content, or the ``article`` or ``main``
around it, or, if it has no main heading, the ``div`` or ``section`` around it that has one.  If its own mean score
reaches the threshold too, its headings and short blocks belong to it unless they are link lists or so named.  Where only
the body holds all of the content, that goes for each outermost section, list or table with content.  There, and where the
main heading stands outside the article, the headings and short blocks that stand directly before content are kept as well.

Names are weighed.  Of a class or id like ``user-comments`` the last word counts (``box``, ``list`` and the like are passed by),
so ``ad-free`` and ``hidden-gems`` say nothing.  Those of headings never count; inside an article those of paragraphs, list items,
cells and inline elements do not either, and there a name that may also be a topic (``legal``, ``search``) or
comes from a section's id counts only if that is a link list or a few words without
punctuation.  A form, or a container with such a name, that holds the whole article stays.  A ``header`` inside an
article and the ``footer`` of a quotation are part of it; buttons and labels count where they stand among other text.  What
is not shown at all (scripts, styles, ``hidden``) is no text.

Character references are decoded (a number without a character becomes U+FFFD), white space inside a block (a line break
included) becomes one space, blocks are joined in page order by two line feeds, and nothing else is
dropped or shortened.  Broken markup is read as browsers do in the main: unclosed paragraphs and
list items end where the next one begins, an unclosed comment or script runs to the end, a lost quote ends with its tag.
A tag that does not end before the next ``<`` is text.  The scanner never goes back, so its time is linear in the page.

A null or empty page, and one without content, gives an empty text.  Pages are handled one by one.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpv.llm.common import add_columns, read_table, slices

#: A path is content from this share of the page's mean score (weighted by text length).
THRESHOLD = 0.4
#: Weights of a node and its neighbours when ratios are smoothed.
SMOOTH = (0.5, 0.25)
#: Factor of the score of text whose element is named as boilerplate.
NAMED_PRIOR = 0.005

# A tag without its end.  An unquoted "<" ends it; a quote counts behind "=" and if a space, "/" or ">" follows its end.
_TAG = re.compile(
    r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)"
    r"(?P<attrs>(?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')(?=[\s/>])|=)*+)"
)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，]")
_NUMBER = re.compile(r"&#(?:([xX])0*+([0-9a-fA-F]++)|0*+([0-9]++));?")

#: Fixed values of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in "script style noscript template svg textarea title iframe".split()}
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Open elements that the start of a block ends: those of its kind and paragraphs.
_ENDED = {tag: ("p", *_ENDS.get(tag, ())) for tag in _BLOCK | set(_ENDS)}
_SCOPE = set("article section div body main table ul ol dl td th aside blockquote form nav footer header figure fieldset details".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that can be a whole article or one of its parts.
_REGIONS = {"article", "main", "section", "div"}
#: Elements whose content is not shown, or only by a program.
_UNSEEN_TAGS = set("head select datalist object audio video canvas map annotation annotation-xml".split())
#: Elements that are never part of an article, and words of class or id that say the same.
_OFF_TAGS = set("nav footer aside menu dialog search fieldset".split())
#: Elements that say something of their text without any attribute.
_TELLING_TAGS = _UNSEEN_TAGS | _OFF_TAGS | {"header", "form"}
_OFF_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tooltip status".split())
_OFF_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements sponsored promo cookie cookies consent gdpr popup modal sidebar footer masthead "
    "comment comments commentlist disqus newsletter subscribe signup login hidden".split()
)
#: Of these, the ones that an id keeps also under a heading of its own.
_READER_WORDS = set("comment comments commentlist disqus".split())
#: Words that name boilerplate or a topic of the article.
_DOUBTFUL_WORDS = set(
    "advertising sponsor promotion banner notice notices notification alert overlay aside menu menus nav navbar navigation breadcrumb "
    "breadcrumbs topbar toolbar discussion reply replies respond share sharing social related recommended recommendations subscription "
    "search pagination pager widget widgets skip copyright legal disclaimer".split()
)
_HEADER_WORDS = {"header", "head", "top"}
#: Last words of a name that say nothing, and first words that turn it into a remark on something else.
_PLAIN_WORDS = set(
    "area bar block box button buttons col column container content count cta dialog element elements feed form frame group holder icon icons "
    "inner input item items left line link links list module outer panel right row section slot space tag text thread unit view wrap wrapper zone".split()
)
_REMARK_WORDS = set("has with no not without is".split())
#: Controls that are read as words where they stand among other text.
_CONTROLS = {"button", "label"}
#: Elements whose name speaks for all below them, also inside an article.
_HOLDERS = set("blockquote center details dir div dl figure hgroup ol section table ul".split())
#: Characters from which a text without any punctuation is not taken for a label.
BRIEF = 200


class _Element:
    __slots__ = (
        "tag", "path", "gone", "off", "named", "parent", "link", "control", "quote", "held", "titled", "headed", "title", "part", "base",
        "inside", "article", "size", "linked", "marks", "heads", "score", "fill",
    )

    def __init__(self, tag: str, path: int, parent: _Element | None):
        self.tag, self.path, self.parent = tag, path, parent
        self.gone = bool(parent and parent.gone)  # not shown
        self.off = bool(parent and parent.off)  # boilerplate
        self.named = ""
        self.link = tag == "a" or bool(parent and parent.link)
        self.control = tag in _CONTROLS or bool(parent and parent.control)
        self.quote = tag == "blockquote" or bool(parent and parent.quote)
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.held = 0  # its text on content paths
        self.titled = self.title = False  # a main heading stands right in it (or in its header); anywhere in it
        self.headed = False  # a heading of the first or second level stands right in it
        self.part = tag in _SCOPE and tag != "body" or bool(parent and parent.part)  # in a section, list, table or the like
        # what the headings in it name, if not itself
        self.base: _Element | None = parent and (parent.base or parent) if tag in ("header", "hgroup") else None
        self.inside = False  # an article
        self.size = self.linked = self.marks = self.heads = 0  # of its text, and articles and main headings
        self.score = 0.0  # of its text, weighted by length
        self.fill = False  # part of the article


def _off(tag: str, attrs: dict[str, str], around: _Element) -> bool:
    """Whether an element is boilerplate for certain; inside an article headers are not."""
    if tag == "footer" and around.quote:
        return False
    return tag in _OFF_TAGS or tag == "header" and not around.article or attrs.get("role", "").lower() in _OFF_ROLES


def _gone(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element is not shown."""
    if tag in _UNSEEN_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    return "display:none" in attrs.get("style", "").replace(" ", "")


def _meaning(names: str) -> str:
    """The word that a class or id says of its element: one of _OFF_WORDS, _DOUBTFUL_WORDS or _HEADER_WORDS, or nothing."""
    found = ""
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or words[0] in _REMARK_WORDS:
            continue
        while len(words) > 1 and (words[-1] in _PLAIN_WORDS or words[-1].isdigit()):
            words.pop()
        off = [w for w in words if w in _OFF_WORDS]
        if words[-1] in _OFF_WORDS or off and words[-1] in _DOUBTFUL_WORDS:
            return off[-1]
        if words[-1] in _DOUBTFUL_WORDS or words[-1] in _HEADER_WORDS and found not in _DOUBTFUL_WORDS:
            found = words[-1]
    return found


def _named(tag: str, attrs: dict[str, str]) -> str:
    """What the name of an element says of it: "off", "topic" (off unless a heading names it), "doubtful", "header", "form" or nothing."""
    if tag == "form" or attrs.get("role", "").lower() == "form":
        return "form"
    if tag in ("html", "body", "article", "main") or tag in _HEADINGS:
        return ""
    kind, own = _meaning(attrs.get("class", "")), _meaning(attrs.get("id", ""))
    if kind in _OFF_WORDS:
        return "off"
    if own in _OFF_WORDS:  # ids of sections are often made from their headings
        if tag == "section" or "section" in attrs.get("class", "").lower():
            return "doubtful"
        return "off" if own in _READER_WORDS else "topic"
    if kind in _DOUBTFUL_WORDS or own in _DOUBTFUL_WORDS:
        return "doubtful"
    return "header" if kind or own else ""


def _dropped(element: _Element, page: _Element) -> bool:
    """Whether a named element is boilerplate, by where it stands and what it holds."""
    named = element.named
    if not named:
        return False
    most = 2 * element.size >= page.size and (not page.heads or element.inside)
    if named == "header":
        return not element.inside and not most
    if 0 < element.heads == page.heads:
        return False  # the whole article
    if named == "form":
        return not most
    if element.tag not in _HOLDERS:
        return not element.inside
    if named == "topic":
        named = "doubtful" if element.headed else "off"
    if named == "off" or not element.inside and not most:
        return True
    return 2 * element.linked >= element.size or not element.headed and not element.marks and element.size < BRIEF


def _settle(elements: list[_Element], nodes: list[tuple[str, _Element]]) -> None:
    """Decides which of the named elements count as boilerplate; ``elements`` are in order."""
    for text, element in nodes:
        if not element.off and not element.gone and (size := len(_clean(text))):
            element.size += size
            element.linked += size * element.link
            element.marks += len(_PUNCTUATION.findall(text))
    for element in reversed(elements[1:]):
        above = element.parent
        if element.off or element.gone:
            continue
        element.heads += element.tag in ("article", "main", "h1")
        above.size += element.size
        above.linked += element.linked
        above.marks += element.marks
        above.heads += element.heads
        if element.tag in _HEADINGS:
            base = above.base or above
            base.titled |= element.tag == "h1"
            base.headed |= element.tag in ("h1", "h2")
    for element in elements[1:]:
        above = element.parent
        element.inside = above.inside or above.tag in ("article", "main") or above.headed and above.tag in ("div", "section")
        element.off = element.off or above.off or _dropped(element, elements[0])
    for element in reversed(elements[1:]):
        element.parent.title |= element.title or element.tag == "h1" and not element.off and not element.gone


def _number(match: re.Match) -> str:
    """A numeric character reference without leading zeros; U+FFFD for one that is too large for any character."""
    mark, digits = match[1] or "", match[2] or match[3]
    return "\ufffd" if len(digits) > 8 else f"&#{mark}{digits};"


def _decode(raw: str) -> str:
    return html.unescape(_NUMBER.sub(_number, raw) if "&#" in raw else raw) if "&" in raw else raw


class _Parser:
    """Text nodes (text, element) in order, the elements, and the blocks as lists of node numbers.  The open elements are
    a stack; ``places`` holds the positions of each tag in it, so no end tag searches it."""

    def __init__(self, page: str):
        root = _Element("", 0, None)
        self.stack, self.elements = [root], [root]
        self.nodes: list[tuple[str, _Element]] = []
        self.blocks: list[list[int]] = [[]]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []  # positions of _SCOPE without cells
        self.paths: dict[tuple[int, str], int] = {}
        self.read(page)
        _settle(self.elements, self.nodes)
        self.blocks = [b for b in self.blocks if b]

    def text(self, raw: str) -> None:
        if raw:
            self.nodes.append((_decode(raw), self.stack[-1]))
            self.blocks[-1].append(len(self.nodes) - 1)

    def cut(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def last(self, *tags: str) -> int:
        """The position of the innermost open element of the tags, 0 without one."""
        place = 0
        for tag in tags:
            if (at := self.places.get(tag)) and at[-1] > place:
                place = at[-1]
        return place

    def scope(self, cells: bool = True) -> int:
        """The position of the innermost open _SCOPE, with or without ``cells`` of tables."""
        place = self.scopes[-1] if self.scopes else 0
        return max(place, self.last("td", "th")) if cells else place

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in _SCOPE and tag not in ("td", "th"):
                self.scopes.pop()

    def open(self, tag: str, raw: str) -> None:
        attrs, name, above = {}, tag, self.stack[-1]
        if raw and not raw.isspace():
            attrs = {k.lower(): _decode(a or b or c or "") for k, a, b, c in _ATTR.findall(raw)}
            name = ".".join([tag, *attrs.get("class", "").split()])
        element = _Element(tag, self.paths.setdefault((above.path, name), len(self.paths) + 1), above)
        if attrs or tag in _TELLING_TAGS:
            element.gone = element.gone or _gone(tag, attrs)
            element.off = element.off or _off(tag, attrs, above)
            element.named = _named(tag, attrs)
        self.places[tag].append(len(self.stack))
        if tag in _SCOPE and tag not in ("td", "th"):
            self.scopes.append(len(self.stack))
        self.stack.append(element)
        self.elements.append(element)

    def end_tag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.cut()
        place = self.last(tag)
        if place and (tag in _BLOCK or place >= self.scope()):  # else a stray inline end tag
            self.close(place)

    def start_tag(self, tag: str, raw: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        if tag in _BLOCK:
            self.cut()
            ends = _ENDED[tag]
            place = self.last(*ends)
            if place and place >= self.scope("td" not in ends):
                self.close(place)
        if tag not in _VOID:
            self.open(tag, raw)

    def read(self, page: str) -> None:
        start = at = 0  # of the text that waits, and of the search
        declared = 0  # the next ">" from here is known
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                self.text(page[start:at])
                end = page.find("-->", at + 4)
                start = at = len(page) if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), at):
                if declared <= at:
                    declared = page.find(">", at) + 1 or len(page) + 1
                if declared > len(page):  # no end: text
                    at += 2
                    continue
                self.text(page[start:at])
                start = at = declared
            elif match := _TAG.match(page, at):
                end = match.end()
                if not page.startswith(">", end):  # text
                    at = end
                    continue
                self.text(page[start:at])
                start = at = end + 1
                tag = match["tag"].lower()
                if match["close"]:
                    self.end_tag(tag)
                elif tag in _RAW:
                    end = _RAW[tag].search(page, at)
                    start = at = end.end() if end else len(page)
                else:
                    self.start_tag(tag, match["attrs"])
            else:
                at += 1
        self.text(page[start:])


def _clean(text: str) -> str:
    return " ".join(text.split())


def ratio_scores(nodes: list[tuple[str, _Element]]) -> list[float]:
    """The score of each text node from the ratios of its tag path, without the prior; 0 for what is not shown."""
    paths: dict[tuple[int, bool], list[float]] = defaultdict(lambda: [0.0] * 6)
    seen: list[tuple[int, list[float]]] = []
    for i, (text, element) in enumerate(nodes):
        if not element.gone and (size := len(_clean(text))):
            sums = paths[element.path, element.off]
            sums[0] += 1
            sums[1] += size
            sums[2] += len(_PUNCTUATION.findall(text))
            sums[3] += size * element.link
            seen.append((i, sums))
    ratios = [(math.log1p(s[1] / s[0]), math.log1p(s[2] / s[0])) for _, s in seen]
    for at, (_, sums) in enumerate(seen):
        near = [ratios[o] for o in (at - 1, at + 1) if 0 <= o < len(seen)]
        weight = SMOOTH[0] + SMOOTH[1] * len(near)
        for part in (0, 1):
            smooth = SMOOTH[0] * ratios[at][part] + SMOOTH[1] * sum(r[part] for r in near)
            sums[4 + part] += smooth / weight / sums[0]  # the mean over the path's nodes
    out = [0.0] * len(nodes)
    for i, (_, size, _, linked, long, dense) in seen:
        out[i] = long * (0.25 + dense) * (1 - linked / size)
    return out


def fused_scores(nodes: list[tuple[str, _Element]]) -> list[float]:
    """``ratio_scores`` times the prior of the elements' names."""
    return [s * (NAMED_PRIOR if e.off else 1) for s, (_, e) in zip(ratio_scores(nodes), nodes, strict=True)]


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    parsed = _Parser(page)
    nodes, elements = parsed.nodes, parsed.elements
    scores = fused_scores(nodes)
    sizes = [0 if e.gone else len(_clean(t)) for t, e in nodes]
    limit = THRESHOLD * _mean([(s, n) for s, n, (_, e) in zip(scores, sizes, nodes, strict=True) if not e.off])
    if not limit:
        return ""
    content = [i for i, n in enumerate(sizes) if n and scores[i] >= limit]
    chosen = set(content)
    whole = _fill(elements, nodes, sizes, scores, content, limit)
    out: list[str] = []
    pending: list[str] = []  # headings and short blocks that wait for content
    for block in parsed.blocks:
        own = [i for i in block if not nodes[i][1].gone and (i in chosen or not nodes[i][1].off)]
        text = _clean("".join(nodes[i][0] for i in own))
        size = sum(sizes[i] for i in own)
        if not text or not size or all(nodes[i][1].control for i in own if sizes[i]):
            continue
        linked = sum(sizes[i] for i in own if nodes[i][1].link)
        if chosen.intersection(own) or 2 * linked <= size and nodes[own[0]][1].fill:
            out += [*pending, text]
            pending = []
        elif whole or 2 * linked > size:
            pending = []
        else:
            pending.append(text)
    return "\n\n".join(out)


def _mean(rows: list[tuple[float, int]]) -> float:
    total = sum(n for _, n in rows)
    return sum(s * n for s, n in rows) / total if total else 0.0


def _fill(
    elements: list[_Element], nodes: list[tuple[str, _Element]], sizes: list[int], scores: list[float], content: list[int], limit: float
) -> bool:
    """Marks the article element, or without one the outermost elements with content, and all below, if their mean score
    reaches the limit; and says whether that is all."""
    for i in content:
        nodes[i][1].held += sizes[i]
    for element in elements:
        element.size = 0
    for i, (_, element) in enumerate(nodes):
        if not element.off:
            element.size += sizes[i]
            element.score += scores[i] * sizes[i]
    for element in reversed(elements[1:]):
        above = element.parent
        above.held += element.held
        above.size += element.size
        above.score += element.score
    weight = sum(sizes[i] for i in content)
    around = []  # the elements that hold all of the content, from the inside
    inner = nodes[content[0]][1] if content else None
    while inner is not None:
        if inner.held == weight:
            around.append(inner)
        inner = inner.parent
    parts = [e for e in around if e.tag in _REGIONS]
    if parts:
        named = [e for e in parts if e.tag in ("article", "main")]
        article = (named or parts)[0]
        if not article.title:
            article = next((e for e in named or parts if e.titled), article)
        regions = {article}
        whole = article.title or not any(e.titled for e in around[around.index(article) :])
    else:
        regions, whole = {e for e in elements[1:] if e.held and e.part and not e.parent.part}, False
    for element in elements[1:]:
        element.fill = element.parent.fill or element in regions and element.score >= limit * element.size
    return whole


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col``, the main text of ``html_col``, in its place."""

    def run(batch):
        for part in slices(batch, html_col):
            yield part, ([extract(x) for x in part.column(html_col).to_pylist()],)

    out = add_columns(pages, f"`{text_col}` string", run)
    return out if html_col.lower() == text_col.lower() else out.drop(html_col)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page of ``pages``: its main text and that text's length."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))
