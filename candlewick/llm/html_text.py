"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text. Every block has a path of block-level tags from the root
to it; inline tags belong to the block. Per path the operator sums text length, punctuation
and link text over its blocks, and forms two ratios: text per block and punctuation per
block. Both are smoothed over the blocks' order on the page and fused by multiplication, so
that long paths of sentences score high and menus low. Paths above a threshold (a share of
the spread of all scores) are content; the innermost container that holds all of them and
has no boilerplate role gives the article, of which all blocks are kept, short ones too.

A path is that of the tags with the classes that several blocks share; ids and classes of one
block make no path of its own, its sums are those of its like.

Paths through boilerplate elements (navigation, footers, asides, scripts, ...) score
nothing. A form, a fieldset, or a class, id or role that names such a part (ads, cookie
notices, sidebars, comments, ...) only makes an element suspect: it is boilerplate if most text below it lies on paths with
short blocks, few marks or many links, or, for advertisements, consent and comments, if it
holds less than half of the page's text. Headings, what surrounds the article or ``main`` (also
if it is hidden, as pages are that a script shows), and
names that say what a layout has or lacks (``has-sidebar``) are never suspect; ids of sections
only as a whole. If suspects are all there is, they are kept.

Formulas (``math``) and the fallback contents of ``object`` and ``canvas`` are text. Contents of
drawings, lists of choices, ``noscript`` and ``template`` are not; if such an element is not
closed, what follows is the page's. Raw text elements, of scripts and the like, end as in HTML.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by an empty line in page order. Unclosed and overlapping tags, truncated pages, markup
inside scripts and quoted ``>`` in attributes are handled; nothing is cut or capped.

Edge cases: null and empty pages give the empty text; repeated rows give repeated results; an
empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame

from candlewick.llm.common import map_documents

#: Element names, in HTML's own sense.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements inside a block whose contents are no text of it; these are never left open to the page's end.
UNSHOWN = frozenset("svg select noscript template annotation annotation-xml".split())
#: Block-level elements that end an open drawing or list of choices.
BREAKS = frozenset("article blockquote center div dl footer h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr "
    # formulas and embedded objects: their text belongs to the block
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction menclose mfenced semantics object canvas".split()
)
BOILERPLATE = frozenset("nav header footer aside button dialog menu head input option datalist".split())
#: Elements that may hold controls or, around a whole page, the article: the ratios below them decide.
CONTROLS = frozenset(("form", "fieldset"))
#: Words in class, id or role that name parts around an article.
PARTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|"
    r"sidebar|side|widget|related|recommend\w*|share|social|comments?|replies|respond|disqus|nav|navbar|navigation|menu|breadcrumbs?|"
    r"footer|header|masthead|topbar|pager|pagination|login|search|toolbar|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Elements that end an open one of the same group when they begin, and what shields an outer one.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()), "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<name>/?[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"'=]+|=\s*(?>\"[^\"]*\"|'[^']*'|[^\s>\"']*)|[\"'=])*+)(?:>|\Z)",
    re.S,
)
#: Of these, parts that read like an article.
PROSE_PARTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|cookies?|consent|gdpr|newsletter|comments?|replies|respond|disqus)(?:$|[\s_-])", re.I
)
#: Names that say what a layout has or lacks, and an article's own header.
MODIFIERS = re.compile(r"(?:has|have|with|no|not|non|without)[_-]", re.I)
OWN_HEADER = re.compile(r"(?:post|article|entry|story|page|content|section|chapter)[_-]+header$", re.I)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SENTENCE = re.compile(r"[.,;:!?…。、，！？；：]")
SIGMAS = 0.25
#: Characters a block and share of links that tell sentences from lists.
SENTENCES, LINKS = 40, 1 / 3


@dataclass(eq=False)
class Open:
    name: str
    label: str
    bad: bool
    suspect: str = ""  # "part" or "prose part", by its names
    hidden: bool = False  # bad for nothing but that


@dataclass
class Block:
    path: tuple[str, ...]
    bad: bool
    text: str
    linked: int
    inside: tuple[Open, ...] = ()  # suspect elements and articles around it


def suspected(name: str, names: list[tuple[str, str]], inside: bool) -> str:
    """What part an element's class, id and role name, if any."""
    if name in HEADINGS or name in ("html", "body", "article", "main") or name == "header" and inside:
        return ""
    found = ""
    for kind, value in names:
        for word in value.split():
            if MODIFIERS.match(word) or OWN_HEADER.match(word):
                continue
            part = PARTS.search(word)
            if not part or inside and part[0].strip("_-").lower() == "header" and not PARTS.search(word, part.end() - 1):
                continue
            if kind == "id" and name == "section" and len(part[0]) < len(word):
                continue  # made from a title
            if kind == "role" or PROSE_PARTS.search(word):
                return "prose part"
            found = "part"
    return found


@dataclass
class Blocks:
    """Cuts one page into blocks."""

    stack: list[Open] = field(default_factory=list)
    found: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    linked: int = 0
    unshown: list[str] = field(default_factory=list)  # open elements from the outermost that is not shown

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                path = tuple(o.label for o in self.stack)
                inside = tuple(o for o in self.stack if o.suspect or o.name in ("article", "main"))
                # what hides a whole article is for a script to show
                around = max((i for i, o in enumerate(self.stack) if o.name in ("article", "main")), default=-1)
                bad = any(o.bad and not (o.hidden and i < around) for i, o in enumerate(self.stack))
                self.found.append(Block(path, bad, text, min(self.linked, len(text)), inside))
            self.parts = []
        self.linked = 0

    def text(self, raw: str) -> None:
        if not raw or self.unshown:
            return
        if "&" in raw:
            raw = entities.unescape(raw)
        self.parts.append(raw)
        if self.links:
            self.linked += len(raw)

    def close_to(self, at: int) -> None:
        self.flush()
        del self.stack[at:]

    def start(self, name: str, rest: str) -> None:
        if self.unshown:
            if self.unshown[0] not in ("svg", "select") or name not in BREAKS or "foreignobject" in self.unshown:
                if name not in VOID and name not in INLINE and not rest.endswith("/"):
                    self.unshown.append(name)
                return
            self.unshown = []
        if name == "br":
            self.parts.append(" ")
            return
        if name in INLINE:
            self.links += name == "a" and not rest.endswith("/")
            return
        self.flush()
        # a block-level element ends an open paragraph, and some end their own kind
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == "p":
                del self.stack[i:]
                break
            if self.stack[i].name in ("td", "th", "button", "object"):
                break
        kinds, shields = ENDS.get(name, ((), ()))
        if kinds:
            last = None
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].name in shields:
                    break
                if self.stack[i].name in kinds:
                    last = i
            if last is not None:
                del self.stack[last:]
        if name in VOID or rest.endswith("/"):
            return
        names = [(kind.lower(), a or b or c) for kind, a, b, c in NAMES.findall(rest)] if rest else []
        named = any(value for _, value in names)
        # a page's or an article's own header is no boilerplate if it is inside the article
        inside = any(o.name in ("article", "main") for o in self.stack)
        bad = name in BOILERPLATE and not (name == "header" and inside)
        hidden = bool(rest and HIDDEN.search(rest)) and name not in ("html", "body")
        suspect = (suspected(name, names, inside) if named else "") or ("part" if name in CONTROLS else "")
        label = " ".join(sorted(c for kind, value in names if kind == "class" for c in value.split()))
        self.stack.append(Open(name, f"{name}.{label}" if label else name, bad or hidden, suspect, hidden and not bad))
        self.links = 0

    def end(self, name: str) -> None:
        if self.unshown:
            if name in self.unshown:
                del self.unshown[len(self.unshown) - 1 - self.unshown[::-1].index(name) :]
                return
            if name in INLINE or not any(o.name == name for o in self.stack):
                return
            self.unshown = []  # what is around it ends
        if name in INLINE:
            if name == "a" and self.links:
                self.links -= 1
            return
        if name in ("br", "p") and not any(o.name == name for o in self.stack):
            self.flush() if name == "p" else self.parts.append(" ")
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                self.close_to(i)
                return


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    out, at = Blocks(), 0
    last: dict[str, int] = {}  # where the last end tag of an unshown element is
    match = TOKEN.search
    while True:
        m = match(page, at)
        if m is None:
            break
        out.text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name[0] == "/":
            out.end(name[1:])
        elif name in RAW:
            if not m["rest"].endswith("/"):
                closed = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = closed.end() if closed else len(page)
        elif name in UNSHOWN and not out.unshown:
            out.parts.append(" " if name in ("svg", "select") else "")
            if name not in last:
                last[name] = max((e.start() for e in re.finditer(rf"</{name}", page, re.I)), default=-1)
            if at <= last[name] and not m["rest"].endswith("/"):
                out.unshown.append(name)
        else:
            out.start(name, m["rest"])
    out.text(page[at:])
    out.flush()
    return shared_paths(out.found)


def smooth(values: np.ndarray) -> np.ndarray:
    """Each value with a quarter of its neighbours on both sides."""
    padded = np.concatenate((values[:1], values, values[-1:]))
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


def shared_paths(found: list[Block]) -> list[Block]:
    """Blocks whose paths keep only the classes that another block's path, alike so far, has too."""
    # counted level by level, from the root: one place in the tree per (place above, label)
    often: dict[tuple[str, ...], int] = {}
    for b in found:
        for k in range(1, len(b.path) + 1):
            often[b.path[:k]] = often.get(b.path[:k], 0) + 1
    return [replace(b, path=tuple(x if often[b.path[: k + 1]] > 1 else x.split(".")[0] for k, x in enumerate(b.path))) for b in found]


def path_sums(found: list[Block]) -> dict[tuple[str, ...], list[float]]:
    """Blocks, characters, marks and linked characters of every path."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(SENTENCE.findall(b.text))
        s[3] += b.linked
    return sums


def fused_scores(found: list[Block], sums: dict[tuple[str, ...], list[float]]) -> np.ndarray:
    """Per block the smoothed text per block of its path (links count against it) times the smoothed punctuation per block."""
    length = np.array([(sums[b.path][1] - sums[b.path][3]) / sums[b.path][0] for b in found])
    marks = np.array([(1 + sums[b.path][2]) / sums[b.path][0] for b in found])
    return smooth(length) * smooth(marks)


def unsuspected(found: list[Block]) -> list[Block]:
    """Without the blocks of suspect elements that the ratios of the paths below them condemn."""
    below: dict[Open, list[int]] = {}
    for i, b in enumerate(found):
        for o in b.inside:
            below.setdefault(o, []).append(i)
    if not any(o.suspect for o in below):
        return found
    chars = [len(b.text) - b.linked for b in found]
    whole = sum(chars)
    articles = [o for o in below if o.name == "article"]
    largest = max(articles, key=lambda o: sum(chars[i] for i in below[o]), default=None)
    around = {o for b in found for k, a in enumerate(b.inside) if a.name == "main" or a is largest for o in b.inside[:k]}
    sums = path_sums(found)
    # a path reads like text if its score is that of short sentences or more, and few of its characters are links
    scores = fused_scores(found, sums)
    prose = [s >= 2 * SENTENCES and sums[b.path][3] <= LINKS * sums[b.path][1] for s, b in zip(scores, found)]
    gone: set[int] = set()
    # inner elements come after the ones around them
    order = dict.fromkeys(o for b in found for o in b.inside if o.suspect and o not in around)
    for o in reversed(order):
        left = [i for i in below[o] if i not in gone]
        text, held = sum(len(found[i].text) for i in left), sum(chars[i] for i in left)
        reads = 2 * sum(len(found[i].text) for i in left if prose[i]) >= text
        if not reads or o.suspect == "prose part" and 2 * held < whole:
            gone.update(left)
    return [b for i, b in enumerate(found) if i not in gone] or found


def content(found: list[Block]) -> list[Block]:
    """The blocks of the article."""
    usable = unsuspected([b for b in found if not b.bad])
    if not usable:
        return []
    sums = path_sums(usable)
    fused = fused_scores(usable, sums)
    threshold = SIGMAS * float(fused.std())
    chosen = {b.path for b, s in zip(usable, fused) if s >= threshold and s > 0} or {b.path for b in usable}
    inner = [p for p in chosen if any(x.split(".")[0] in ("article", "main") for x in p)]
    if inner:  # an article element says itself where the article is
        chosen = set(inner)
    first = min(chosen)
    depth = 0
    for depth in range(len(first) + 1):
        if depth == len(first) or any(len(p) <= depth or p[depth] != first[depth] for p in chosen):
            break
    # leaf elements hold single blocks: the container is what is around them
    while depth and first[depth - 1].split(".")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "pre", "blockquote", "ul", "ol"):
        depth -= 1
    around = first[:depth]
    kept = [b for b in usable if b.path[:depth] == around]
    if inner or around and around[-1].split(".")[0] not in ("body", "html"):
        return kept
    # the page itself is the container: link lists outside paragraphs are menus
    return [b for b in kept if b.path in chosen or b.linked < 0.5 * len(b.text)]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in content(blocks(page))) if page else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def factory():
        def apply(page_id, url, html):
            texts = [main_text(h) for h in html]
            return {"page_id": page_id, "url": url, "text": texts, "n_chars": [len(t) for t in texts]}

        return apply

    schema = "page_id long, url string, text string, n_chars long"
    return map_documents(pages.select(pages["page_id"].cast("long"), "url", html), schema, factory, step=64)
