"""Main texts of web pages by wrapper induction over the pages of a host.

A page is read into a tree of its block elements, neighbouring siblings of one kind being one node.
Pages of one tree have one layout. Each layout of a host is aligned by simple tree matching with the one
that most of the host's pages have; nodes without a match go by their path. A block whose text stands at
the same aligned node on enough different pages is the host's template, the others are slots. A page's main
text are the slots of its article where it marks one, else the slots that are not mostly links; menus,
headers, footers and the like, known by tag, class or id, are never part of it.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import map_rows, written

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.DOTALL
)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORDS = re.compile(r"[^\W\d_]+")
NUMBERS = re.compile(r"\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

# Fixed by the HTML standard: elements without content, with raw text, and inside running text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noscript iframe template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span"
    " strike strong sub sup time tt u var wbr nobr ruby rt rp".split()
)
# Elements that a start tag of the same group closes, up to the element that holds the group.
CLOSES = {
    **{t: ({"li"}, {"ul", "ol", "menu"}) for t in ("li",)},
    **{t: ({"dt", "dd"}, {"dl"}) for t in ("dt", "dd")},
    **{t: ({"td", "th"}, {"tr", "table"}) for t in ("td", "th")},
    "tr": ({"tr", "td", "th"}, {"table"}),
    **{t: ({"option"}, {"select"}) for t in ("option", "optgroup")},
}
# Parts of a page that are not its main text: by tag, and by a class or id made of these words alone.
ASIDE_TAGS = set("nav footer aside button select head dialog svg object canvas audio video".split()) | RAW
ASIDE_WORDS = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " copyright disqus footer form login masthead menu modal nav navbar navigation newsletter notice notices"
    " pagination popup promo promoted related respond search share sharing sidebar signup social sponsor sponsored"
    " subscribe toolbar widget widgets".split()
)
MAIN = {"article", "main"}
# Their ids are made from headings, and so say what the text is about.
SLUGGED = set("h1 h2 h3 h4 h5 h6 section article main body html".split())
# Template blocks are on at least so many different pages of a host, and this share of those with their path.
SAME, PAGES = 0.5, 3
LINKED = 0.6
# Where more of a marked article's blocks were template, its host's pages are copies of one another.
COPIED = 0.75
# A form with most of a page's text and one of these is what the page is built in.
BUILT = MAIN | {"h1", "h2", "p"}
# Elements nested deeper belong to the node that holds them.
DEEPEST = 150


@dataclass
class Node:
    """An element with those of its neighbours that have its kind; ``blocks`` are numbers of texts."""

    key: str
    id: int = 0
    aside: bool = False
    main: bool = False
    path: int = 0
    form: bool = False
    depth: int = 0
    children: list[Node] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)


@dataclass
class Page:
    root: Node
    texts: list[str]
    linked: list[int]
    nodes: list[Node]

    def skeleton(self) -> str:
        """The tree as JSON: depth and kind of each node, in page order."""
        return json.dumps([(n.depth, NUMBERS.sub("0", n.key)) for n in self.nodes])

    def blocks(self) -> list[Block]:
        """The blocks that may be main text, in page order."""
        found = [
            (b, node.id, node.main, self.texts[b], self.linked[b])
            for node in self.nodes
            if not node.aside
            for b in node.blocks
        ]
        return [block[1:] for block in sorted(found)]


# Number of the node, whether it is in a marked article, text, characters of it in links.
Block = tuple[int, bool, str, int]


def _mark(text: str) -> int:
    """A hash of 64 bits that fits a long; zero for no text."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) if text else 0


def block_mark(path: int, text: str) -> int:
    return _mark(f"{path} {text}")


def _says_aside(name: str) -> bool:
    words = WORDS.findall(name)
    return bool(words) and ASIDE_WORDS.issuperset(words)


def _kind(tag: str, attributes: str, in_main: bool) -> tuple[str, bool, bool]:
    """An element's key for matching, whether it stands aside, and whether it marks the main text.

    A class or id tells so as a whole, not by one of its words; ids do not inside the main text.
    """
    key, aside, main = tag, tag in ASIDE_TAGS, tag in MAIN
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
            if name in ("class", "id"):
                key += f" {value}"
                names = value.split()
                if name == "class":
                    aside = aside or (tag not in ("body", "html") and any(map(_says_aside, names)))
                elif not in_main and tag not in SLUGGED:
                    aside = aside or any(map(_says_aside, names))
            elif name == "role":
                aside = aside or value in ("navigation", "banner", "contentinfo", "complementary", "search", "form")
                main = main or value == "main"
            elif name == "style":
                aside = aside or bool(HIDDEN.search(value))
            elif name == "hidden":
                aside = True
            elif value == "true":
                aside = True
    return key, aside, main


def parse(text: str) -> Page:
    """The block tree of a page; unclosed and misplaced tags are taken as browsers take them."""
    root = Node("")
    page = Page(root, [], [], [root])
    # Open elements: tag, node, whether text in it stands aside, whether it is a link.
    stack: list[tuple[str, Node, bool]] = [("", root, False)]
    words: list[str] = []
    linked = links = 0

    def close_block() -> None:
        nonlocal linked
        told = " ".join("".join(words).split()) if words else ""
        if told:
            stack_node().blocks.append(len(page.texts))
            page.texts.append(told)
            page.linked.append(min(linked, len(told)))
        words.clear()
        linked = 0

    def stack_node() -> Node:
        return stack[-1][1]

    def add(part: str) -> None:
        nonlocal linked
        part = html.unescape(part) if "&" in part else part
        words.append(part)
        if links:
            linked += len(part.strip())

    def pop_to(n: int) -> None:
        nonlocal links
        while len(stack) > n:
            tag = stack[-1][0]
            if tag == "a":
                links -= 1
            if tag not in INLINE:
                close_block()
            stack.pop()

    at = 0
    size = len(text)
    while at < size:
        begin = text.find("<", at)
        if begin < 0:
            add(text[at:])
            break
        if begin > at:
            add(text[at:begin])
        match = TOKEN.match(text, begin) or LOOSE.match(text, begin)
        if match is None:
            if begin + 1 < size and (text[begin + 1].isalpha() or text[begin + 1] in "/!?"):
                break  # a tag that the end of the page cuts off
            add("<")
            at = begin + 1
            continue
        at = match.end()
        if match.lastindex is None or match.group(2) is None:
            continue
        tag = match.group(2).lower()
        if match.group(1):
            if tag == "p" and not any(s[0] == "p" for s in stack):
                close_block()
                continue
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            # An inline end tag does not close blocks opened since.
            if depth and not (tag in INLINE and any(s[0] not in INLINE for s in stack[depth + 1 :])):
                pop_to(depth)
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "hr"):
                if tag == "hr":
                    close_block()
                elif tag == "br":
                    words.append(" ")
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(text, at)
            stop = text.find(">", end.start()) if end else -1
            at = stop + 1 if stop >= 0 else size
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            stack.append((tag, stack_node(), stack[-1][2]))
            continue
        # A block ends the running text, and a paragraph that is open.
        open_p = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p"), 0)
        if open_p:
            pop_to(open_p)
        if tag in CLOSES:
            ends, holder = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in holder:
                    break
                if stack[k][0] in ends:
                    pop_to(k)
        close_block()
        key, aside, main = _kind(tag, match.group(3), stack_node().main)
        parent, under = stack_node(), stack[-1][2]
        if tag == "header" and not _inside_main(stack):
            aside = True
        if len(stack) > DEEPEST and (not aside or parent.aside):
            node = parent
        elif parent.children and parent.children[-1].key == key:
            node = parent.children[-1]
        else:
            # Numbers in names tell pages apart, not places.
            path = _mark(f"{parent.path} {NUMBERS.sub('0', key)}")
            node = Node(key, len(page.nodes), aside or under or parent.aside, main or parent.main, path, tag == "form")
            node.depth = parent.depth + 1
            parent.children.append(node)
            page.nodes.append(node)
        if not match.group(3).endswith("/") or tag not in ("svg", "path"):
            stack.append((tag, node, node.aside))
    pop_to(0)
    _judge_forms(page)
    return page


def _judge_forms(page: Page) -> None:
    """Forms stand aside, but for one that holds most of the page's text, as some frameworks write pages."""
    if not any(node.form for node in page.nodes):
        return
    chars = {n.id: sum(len(page.texts[b]) for b in n.blocks) for n in page.nodes if not n.aside}
    whole = sum(chars.values())
    # Nodes below a node follow it and are deeper.
    inside: dict[int, list[Node]] = {}
    form = None
    for node in page.nodes:
        if form is not None and node.depth <= form.depth:
            form = None
        if form is None and node.form:
            form = node
        if form is not None:
            inside.setdefault(form.id, []).append(node)
    for nodes in inside.values():
        held = sum(chars.get(n.id, 0) for n in nodes)
        built = any(n.key.split(" ", 1)[0] in BUILT for n in nodes)
        if not built or 2 * held <= whole:
            for node in nodes:
                node.aside = True


def _inside_main(stack: list[tuple[str, Node, bool]]) -> bool:
    return any(node.main for _, node, _ in stack)


def matched(one: list, other: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two skeletons: the most nodes that match in order, and their ids."""
    if one[0] != other[0]:
        return 0, []
    a, b = one[5], other[5]
    pairs = [(one[1], other[1])]
    total = 1
    # Equal kinds at both ends match each other; the table is for what lies between.
    head = 0
    while head < min(len(a), len(b)) and a[head][0] == b[head][0]:
        n, found = matched(a[head], b[head])
        total += n
        pairs += found
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail][0] == b[-1 - tail][0]:
        n, found = matched(a[-1 - tail], b[-1 - tail])
        total += n
        pairs += found
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if a and b:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        inner = {}
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n = 0
                if x[0] == y[0]:
                    inner[i, j] = matched(x, y)
                    n = inner[i, j][0]
                table[i + 1][j + 1] = max(table[i + 1][j], table[i][j + 1], table[i][j] + n)
        i, j = len(a), len(b)
        total += table[i][j]
        while i and j:
            if (i - 1, j - 1) in inner and table[i][j] == table[i - 1][j - 1] + inner[i - 1, j - 1][0]:
                pairs += inner[i - 1, j - 1][1]
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return total, pairs


def tree(skeleton: str) -> list:
    """Nested lists ``[kind, number, path, 0, 0, children]`` of a skeleton."""
    root: list = []
    above: list[list] = []
    for number, (depth, kind) in enumerate(json.loads(skeleton)):
        del above[depth:]
        path = _mark(f"{above[-1][2]} {kind}") if above else 0
        node = [kind, number, path, 0, 0, []]
        if above:
            above[-1][5].append(node)
        else:
            root = node
        above.append(node)
    return root


def _paths(root: list) -> list[int]:
    """The paths of all nodes by number."""
    found, left = {}, [root]
    while left:
        node = left.pop()
        found[node[1]] = node[2]
        left += node[5]
    return [found[k] for k in range(len(found))]


def aligned(skeleton: str, reference: str) -> list[int]:
    """A name for each node: that of the node it matches in the reference, else its own path."""
    one, other = tree(skeleton), tree(reference)
    names, paths = _paths(one), _paths(other)
    for k, at in matched(one, other)[1]:
        names[k] = _mark(f"{at} {paths[at]}")
    return names


def chosen(blocks: list[Block], names: list[int] | None, template: set[int]) -> str:
    """The main text among the blocks of a page, given the block marks of its layout's ``template``.

    Without names, nothing is template.
    """
    has_main = any(main for _, main, _, _ in blocks)
    looked = [(n, t) for n, main, t, linked in blocks if (main if has_main else linked <= LINKED * len(t))]
    if not template or names is None:
        return "\n".join(t for _, t in looked)
    # A marked article tells where to look; what all pages of the host say there is template too.
    slots = [t for n, t in looked if block_mark(names[n], t) not in template]
    if has_main and len(looked) - len(slots) > COPIED * len(looked):
        slots = [t for _, t in looked]
    return "\n".join(slots)


def main_text(page: Page, names: list[int] | None, template: set[int], links: set[int]) -> str:
    """The main text of a parsed page; ``links`` are marks of more blocks to leave out."""
    return chosen(page.blocks(), names, template | links)


def host_of(url: Column) -> Column:
    """The host of an address in lower case, empty where there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``id, url, host, layout, skeleton, mark`` and the blocks of each page, every page parsed once."""

    def read(columns: list) -> Iterator[tuple]:
        for key, url, host, source in zip(*columns, strict=True):
            page = parse(source)
            blocks = page.blocks()
            skeleton = page.skeleton()
            yield key, url, host, _mark(skeleton), skeleton, _mark("\n".join(page.texts)), blocks

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        host_of(F.col(f"`{url_col}`")).alias("host"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )
    block = "array<struct<node: int, main: boolean, text: string, linked: int>>"
    schema = f"id {kind}, url string, host string, layout long, skeleton string, mark long, blocks {block}"
    return map_rows(rows, read, schema)


def wrappers(parsed: DataFrame) -> DataFrame:
    """``host, layout, names, template`` for each layout of a host: names of its nodes, marks of constant blocks.

    All pages of a host vote, but one and the same text votes once however many pages have it. Votes
    are counted before they are shuffled, and a template is cut to its layout, so neither a host with most of
    the pages nor one of very many layouts is a burden.
    """

    def align(columns: list) -> Iterator[tuple]:
        for host, layout, skeleton, reference in zip(*columns, strict=True):
            yield host, layout, aligned(skeleton, reference)

    layouts = parsed.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("skeleton").alias("skeleton"))
    layouts = written(layouts, "layouts")
    most = layouts.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "layout")).alias("reference"))
    names = written(
        map_rows(
            layouts.join(most, "host").select("host", "layout", "skeleton", "reference"),
            align,
            "host string, layout long, names array<long>",
        ),
        "names",
    )

    def cast(columns: list) -> Iterator[tuple]:
        for host, mark, blocks, own in zip(*columns, strict=True):
            found = {(own[b["node"]], 0) for b in blocks}
            found.update((own[b["node"]], block_mark(own[b["node"]], b["text"])) for b in blocks)
            for name, block in found:
                yield host, name, block, mark

    named = parsed.join(names, ["host", "layout"]).select("host", "mark", "blocks", "names")
    votes = map_rows(named, cast, "host string, name long, block long, mark long")
    counted = votes.groupBy("host", "name", "block").agg(F.count_distinct("mark").alias("n")).where(F.col("n") >= PAGES)
    counted = written(counted, "votes")
    of = counted.where("block = 0").select("host", "name", F.col("n").alias("of"))
    shared = counted.where("block <> 0").join(of, ["host", "name"]).where(F.col("n") >= SAME * F.col("of"))
    nodes = names.select("host", "layout", F.explode(F.array_distinct("names")).alias("name"))
    templates = nodes.join(shared, ["host", "name"]).groupBy("host", "layout")
    return names.join(templates.agg(F.collect_set("block").alias("template")), ["host", "layout"], "left")


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """The id, address, main ``text`` and ``n_chars`` of each page.

    White space in a block is one space, character references are decoded, blocks are joined by line
    ends in page order. Null or empty pages and pages without a main text have an empty one; pages
    without a host are one host; repeated rows each have their result; an empty table gives none.
    """
    parsed = written(parsed_pages(pages, id_col, url_col, html_col), "pages")
    told = written(wrappers(parsed.drop("id", "url")), "wrappers")

    def extract(columns: list) -> Iterator[tuple]:
        for key, url, blocks, names, template in zip(*columns, strict=True):
            rows = [(b["node"], b["main"], b["text"], b["linked"]) for b in blocks]
            text = chosen(rows, names, set(template or ()))
            yield key, url, text, len(text)

    kind = pages.schema[id_col].dataType.simpleString()
    joined = parsed.join(told, ["host", "layout"], "left")
    return map_rows(
        joined.select("id", "url", "blocks", "names", "template"),
        extract,
        f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long",
    )
