"""Main text of HTML pages by tree scoring.

The page is read into a tree by HTML's rules for raw text, void elements and implied ends. Only what a reader never sees, or
what its own tag calls something else (scripts, styles, navigation, footers, asides, hidden elements), is set aside unread.
Each paragraph earns points for its commas and its length and passes them on to its ancestors, the whole to the parent and
less with each level. An element whose class, id or role names an advert, a notice, a menu, a share bar or reader comments, a
form, a page's header, and what follows a heading "Comments" are doubted: they pass on DOUBTED of their points. A container's
points are discounted by its link density. The best container is kept, widened to the `article` or `main` it stands in, and
joined by siblings that score well or read like paragraphs. Inside what is kept, doubted elements are left out unless they hold
the best container; of a header the headings stay.

extract(): blocks in page order joined by one newline; white space inside a block (also a line break element) is one
space; character references are decoded once. A null or empty page, or one without text, gives the empty text; a page
all of whose text is hidden or doubted gives all of it. Broken markup never fails: unclosed elements end with their parents, stray ends are
ignored. extract_pages() keeps page_id and url as they are, null or repeated; other columns don't matter.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkforge.llm.common import map_batches, read_table

#: Fixed lists of HTML's elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROP = frozenset("script style textarea title xmp iframe noembed noframes noscript head nav footer aside menu svg canvas audio video object embed map template dialog select datalist button input label legend progress meter applet rp rt".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
FORMATTING = frozenset("a abbr b bdi bdo big cite code em font i kbd mark nobr q s samp small span strike strong sub sup time tt u var ins del".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of the first kind ends an open element of the second, up to one of the third.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "body": (frozenset(["head"]), frozenset()),
}
PARAGRAPH_SCOPE = frozenset("table td th caption html object template button".split())
#: Fixed lists of words in a class or id by what they mean here; a paragraph is only doubted for the first.
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login paywall breadcrumb breadcrumbs pagination pager copyright share sharing social".split()
)
LAYOUT_WORDS = frozenset("nav navbar navigation navi menu menus toolbar footer colophon sidebar sidebars rail widget widgets related recommended recommendations trending popular skip toc".split())
TALK_WORDS = frozenset("comment comments commentlist disqus replies reply respond responses reactions discussion".split())
HEADER_WORDS = frozenset("header masthead topbar banner banners".split())
#: The words of a reader's or visitor's element that make it comments, and words before which a listed word says what is inside.
READER_WORDS, READER_TALK = frozenset("reader readers visitor visitors user users guest".split()), frozenset("notes feedback opinions reviews thoughts letters voices".split())
HOLDER_WORDS = frozenset("has have with without no non is".split())
DOUBTED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist tooltip status".split())
#: Headings of reader comments, and of link lists that belong to a text.
TALK_HEADING = re.compile(r"(?:(?:\d+|no|all|latest|recent|(?:reader|user|visitor)(?:s|['’]s|s['’])?)\s+)?comments?(?:\s*[(:]?\s*\d*\s*\)?)|(?:leave|post|add|write)\s+(?:a|your)\s+(?:comment|reply)|join\s+the\s+(?:discussion|conversation)", re.I)
REFERENCES = re.compile(r"references|sources|bibliography|literature|citations|further reading|external links|links|see also|notes", re.I)
#: What a doubted element passes on of its points; the letters of a link that is more than a menu's label.
DOUBTED, LABEL = 0.2, 20
#: Kinds of doubt.
HEADER, OTHER = 1, 2
BASE_SCORE = {"article": 10.0, "main": 10.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "form": -3.0, "th": -5.0}
SCORED = frozenset("p pre td blockquote dd li figcaption".split())

TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+(?:>|\Z)|/?[a-zA-Z][^>]*+\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "aside", "doubt", "chars", "linked", "links", "score", "top")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.aside, self.doubt = False, 0
        self.chars = self.linked = self.links = 0
        self.score = BASE_SCORE.get(tag, 0.0)
        self.top = parent.top if parent is not None and parent.top is not None else None


def _word_doubt(tag: str, value: str) -> int:
    """What the words of a class or an id say of an element."""
    found = 0
    for one in value.split():
        words = [w.lower() for w in WORDS.findall(one)]
        held = next((k for k, w in enumerate(words) if w in HOLDER_WORDS), len(words))
        own = set(words[:held])
        if own & NOISE_WORDS:
            return OTHER
        if tag == "p":
            continue
        if own & TALK_WORDS or own & LAYOUT_WORDS or (own & READER_WORDS and own & READER_TALK):
            return OTHER
        if own & HEADER_WORDS:
            found = HEADER
    return found


def _marks(node: Node, raw: str) -> None:
    """Sets an element aside, or doubts it, for its attributes."""
    if not raw or raw.isspace():
        return
    for m in ATTRIBUTE.finditer(raw):
        name = m[1].lower()
        if name == "hidden":
            node.aside = True
        if name not in ("role", "aria-hidden", "style", "class", "id"):
            continue
        value = html.unescape(m[2] or m[3] or m[4] or "")
        if name == "style":
            node.aside |= bool(HIDDEN.search(value))
        elif name == "role" and value.strip().lower() in DOUBTED_ROLES or name == "aria-hidden" and value.strip().lower() == "true":
            node.doubt = OTHER
        elif name in ("class", "id") and node.tag not in ("html", "body", "main", "h1"):
            node.doubt = max(node.doubt, _word_doubt(node.tag, value))


def parse(page: str) -> Node:
    root = Node("#root", None)
    stack, open_ = [root], {"p": 0}
    at, end = 0, len(page)

    def text(a: int, b: int) -> None:
        if a < b:
            run = page[a:b]
            stack[-1].children.append(html.unescape(run) if "&" in run else run)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop().tag] -= 1

    def pop_nearest(tags: frozenset, scope: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                pop_to(k)
                return
            if stack[k].tag in scope:
                return

    while at < end:
        m = TAG.search(page, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, raw = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if not open_.get(tag):
                continue
            k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
            if tag not in FORMATTING or not any(n.tag in BLOCK for n in stack[k + 1 :]):
                pop_to(k)
            continue
        if tag in BLOCK and open_["p"]:
            pop_nearest(frozenset(["p"]), PARAGRAPH_SCOPE)
        if tag in ENDS and any(open_.get(t) for t in ENDS[tag][0]):
            while True:
                depth = len(stack)
                pop_nearest(*ENDS[tag])
                if len(stack) == depth:
                    break
        if tag in HEADING and stack[-1].tag in HEADING:
            pop_to(len(stack) - 1)
        node = Node(tag, stack[-1])
        node.aside = tag in DROP
        node.doubt = OTHER if tag == "form" else HEADER if tag == "header" else 0
        _marks(node, raw)
        if tag in ("article", "main") and not node.aside and not node.doubt and (node.top is None or node.top.tag == "main"):
            node.top = node
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not (raw.endswith("/") and tag in ("svg", "path")):
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
    return root


def _prepare(root: Node) -> list[Node]:
    """Nodes in page order without what is set aside; text and link lengths are summed on the way back."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.aside:
            continue
        order.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    for node in reversed(order):
        node.chars += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.links += node.links
    for node in order:
        if node.tag in HEADING and node.chars < 60 and TALK_HEADING.fullmatch(_own_text(node)):
            _doubt_talk(node)
    return order


def _blocks(node: Node) -> list[Node]:
    """An element's children that have text."""
    return [c for c in node.children if isinstance(c, Node) and not c.aside and c.chars]


def _doubt_talk(heading: Node) -> None:
    """Doubts the comments under their heading: its section if it opens one, and what follows up to the next heading of its rank."""
    first = heading
    while first.parent is not None and first.parent.tag not in ("body", "html", "main", "article", "#root") and _blocks(first.parent)[:1] == [first] and first.parent.chars > first.chars:
        first = first.parent
        first.doubt = OTHER
        if first.tag in ("section", "aside", "div", "ol", "ul"):
            return
    if first.parent is None:
        return
    after = False
    for one in first.parent.children:
        if isinstance(one, Node):
            if after and one.tag in HEADING and one.tag <= heading.tag:
                return
            if after or one is first:
                after, one.doubt = True, OTHER


def _density(node: Node) -> float:
    return min(1.0, node.linked / node.chars) if node.chars else 0.0


def _own_text(node: Node) -> str:
    """Text of a node and its inline descendants."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or (x.tag not in BLOCK and not x.aside):
            todo += reversed(x.children)
    return " ".join(" ".join(out).split())


def _score(order: list[Node]) -> list[Node]:
    """Containers that got points, which paragraphs pass on to them."""
    got: dict[int, Node] = {}
    for node in order:
        if node.tag not in SCORED and not (node.tag in ("div", "section", "article", "main", "body", "#root", "center") and any(isinstance(c, str) and not c.isspace() for c in node.children)):
            continue
        words = _own_text(node)
        if not words:
            continue
        points = 1.0 + len(re.findall("[,،、，]", words)) + min(len(words) // 100, 3)
        up, level = node, 0
        if node.tag in SCORED and node.parent is not None:
            points *= DOUBTED if node.doubt else 1.0
            up = node.parent
        while up is not None and level < 6:
            points *= DOUBTED if up.doubt else 1.0
            up.score += points / (1 if level == 0 else 2 * level)
            got[id(up)] = up
            up, level = up.parent, level + 1
    return list(got.values())


def _worth(node: Node) -> float:
    return node.score * (1 - _density(node)) * (DOUBTED if node.doubt and node.score < 0 else 1.0)


def _siblings(best: Node) -> list[Node]:
    """The best container and those beside it that score well or read like paragraphs; beside an article, only what scores well."""
    floor, out = max(10.0, 0.2 * _worth(best)), []
    for one in best.parent.children:
        if not isinstance(one, Node) or one.aside or (one.doubt and one is not best):
            continue
        reads = one.tag == "p" and best.tag != "article" and (_density(one) < 0.25 if one.chars > 80 else one.linked == 0 and one.chars > 0)
        if one is best or reads or one.tag == "h1" or (one.tag == "h2" and best.tag != "article") or _worth(one) >= floor:
            out.append(one)
    return out


def _chosen(order: list[Node]) -> tuple[list[Node], Node]:
    """The elements that are kept, in page order, and the best container."""
    found = _score(order)
    if not found:
        return [next((n for n in order if n.tag in ("article", "main")), order[0])], order[0]
    best = max(found, key=_worth)  # the first of equals
    whole = best if best.top is None else best.top
    if whole.parent is None or whole.tag in ("body", "html", "main"):
        return [whole], best
    return _siblings(whole), best


def _is_menu(node: Node, heading: str, read: bool) -> bool:
    """A list of bare links: a menu if its labels are short and it opens the text or isn't introduced as references."""
    if node.tag not in ("ul", "ol", "div", "section", "table") or node.links < 3 or _density(node) <= 0.8:
        return False
    return node.linked < LABEL * node.links and not (read and REFERENCES.search(heading))


FLUSH = object()


def _text(roots: list[Node], best: Node, page: Node) -> str:
    blocks: list[str] = []
    run: list[str] = []
    spine = set()
    while best is not None:
        spine.add(id(best))
        best = best.parent
    whole_page = any(r is page or r.tag in ("body", "html") for r in roots)

    def flush() -> None:
        if words := " ".join("".join(run).split()):
            blocks.append(words)
        run.clear()

    heading, read = "", False
    todo: list = [(r, False) for r in reversed(roots)]
    while todo:
        one, only_headings = todo.pop()
        if one is FLUSH:
            flush()
            continue
        if isinstance(one, str):
            if not only_headings:
                run.append(one)
            continue
        block = one.tag in BLOCK
        if block:
            flush()
        if one.tag == "br":
            run.append(" ")
            continue
        if one.aside:
            continue
        if id(one) not in spine and one.doubt == HEADER and one.tag not in HEADING and not (whole_page and one.top is None):
            only_headings = True  # of an article's header
        elif id(one) not in spine and one.doubt and not (one.doubt == HEADER and one.tag in HEADING):
            continue
        elif one.links and id(one) not in spine and _is_menu(one, heading, read):
            continue
        if one.tag in HEADING:
            heading, only_headings = _own_text(one), False
        read = read or one.tag == "p"
        if block:
            todo.append((FLUSH, False))
        todo += [(c, only_headings) for c in reversed(one.children)]
    flush()
    return "\n".join(blocks)


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    order = _prepare(root)
    text = _text(*_chosen(order), root) or _text([root], root, root)
    if not text:
        # All text is hidden or doubted: it is the page.
        todo = [root]
        while todo:
            node = todo.pop()
            node.aside, node.doubt = node.tag in DROP, 0
            todo += [c for c in node.children if isinstance(c, Node)]
        text = _text([root], root, root)
    return text


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of pages(page_id, url, html)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return step

    return map_batches(pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html"), make, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
