"""Main text of web pages by a minimum cut between content and boilerplate.

A page is cut into blocks of text. A linear classifier over tags, names and text statistics gives
each block the cost of either label; these costs are the capacities of its edges to the two
terminals. Neighbouring blocks and blocks under one parent are tied by smoothness edges, weaker
the more the tree lies between them. A maximum flow finds the cheapest labelling.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallygrid.llm.common import table

# Elements of the page language and names that sites give to their boilerplate.
RAW = "script style title textarea".split()
EMBEDDED = set("noscript template iframe svg object canvas select audio video annotation annotation-xml".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr br input picture source map area math semantics mrow mi mo mn ms mtext mspace "
    "mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts none mtable mtr mtd".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set("nav header footer aside form head menu dialog button fieldset address".split())
MAIN = {"article", "main"}
# Names of what is not the page's own text, wherever it stands and however long it is.
FOREIGN = set(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus gdpr login newsletter pager pagination popup promo promoted recommended related replies reply "
    "respond signup sponsor sponsored subscribe".split()
)
# Names that also stand on wrappers of the text.
NAMES = FOREIGN | set(
    "banner disclaimer footer form header masthead menu modal nav navbar navigation notice search share sharing sidebar "
    "skip social tags toc toolbar widget".split()
)
# Beside one of these a name tells the state or layout of what is inside.
STATES = set("no not has have with without free hide hidden hides show shows off on layout enabled disabled wrapper".split())
OWN_NAMES = {"article", "content", "entry", "main", "post", "story"}
IMPLIED_END = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?P<end_>/?)(?P<tag_>[a-zA-Z][^\s/>]*)(?P<attrs_>[^>]*)>|<[!?/][^>]*>",  # a quote that is never closed
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)

# Weights of the classifier, in log-odds of content.
BIAS, IN_MAIN, IN_BOILERPLATE, PER_WORD, MOST_WORDS, LINKED, TEASER = -1.0, 3.0, -8.0, 0.1, 30, -4.0, -8.0
SHORT = 3.0  # of the best block of a page without any content, more than its ties to what surrounds it
NEXT, SAME_PARENT = 2.0, 1.4  # smoothness
FEW = 15  # words; a shorter run of text does not show where the content is


class Block:
    __slots__ = ("parts", "path", "parent", "linked", "text", "main", "bad", "named", "teaser", "words")

    def __init__(self, path, parent, main, bad, teaser):
        self.parts, self.path, self.parent, self.linked, self.teaser = [], path, parent, 0, teaser
        self.main, self.bad, self.named, self.text, self.words = main, bad, False, "", 0


def _name(attrs: str) -> str:
    """``foreign`` or ``weak`` if a class, id or role has a name of boilerplate, else empty."""
    found = ""
    for attribute, value in ATTRIBUTE.findall(attrs):
        if attribute.lower() in ("class", "id", "role"):
            tokens = [set(re.split(r"[^a-z0-9]+", t)) for t in value.strip("\"'").lower().split()]
            if any(names & OWN_NAMES for names in tokens):
                continue
            for names in tokens:
                if not names & STATES and names & NAMES:
                    if names & FOREIGN:
                        return "foreign"
                    found = "weak"
    return found


def _longest_run(blocks: list[Block], named: set[int]) -> int:
    """Most words of neighbouring blocks outside of all ``named`` elements."""
    best = run = 0
    for b in blocks:
        run = run + b.words if named.isdisjoint(b.path) else 0
        best = max(best, run)
    return best


def _mark_named(blocks: list[Block], named: dict[int, str], mains: dict[int, str]) -> None:
    """Mark the blocks within the ``named`` elements that are not wrappers of the content.

    Main, and articles at least half as long as the longest, hold the content of a page that has them; what
    they lie in is a wrapper. Inside of them, or in a page without them, an element with a weak name is a
    wrapper only where hardly any text lies outside of the named elements and it holds far more.
    """
    if not named:
        return
    plain = [b for b in blocks if not b.bad]
    words: dict[int, int] = {}
    for b in plain:
        for k in b.path:
            words[k] = words.get(k, 0) + b.words
    articles = {k: words[k] for k in mains if words.get(k)}
    longest = max((n for k, n in articles.items() if mains[k] == "article"), default=0)
    held = {k for k, n in articles.items() if mains[k] == "main" or 2 * n >= longest}
    left = set(named)
    if held:
        for b in blocks:
            inner = max((d for d, k in enumerate(b.path) if k in held), default=0)
            left.difference_update(b.path[:inner])
        own = {k for k in held if mains[k] == "article"}
        # Named articles beside others are comments or teasers; if all long ones have a name, it says nothing.
        left -= held - own
        if own <= left:
            left -= own
        plain = [b for b in plain if not held.isdisjoint(b.path)]
    while (run := _longest_run(plain, left)) < FEW:
        weak = [k for k in left if named[k] == "weak" and words.get(k, 0) > 8 * run]
        if not weak:
            break
        left.discard(max(weak, key=lambda k: (words[k], -k)))
    for b in blocks:
        b.named = not left.isdisjoint(b.path)


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    # tag, number, within main, within boilerplate, and for embedded elements what goes on after them
    stack = [("", 0, False, False, None)]
    out: list[Block] = []
    named: dict[int, str] = {}
    mains: dict[int, str] = {}
    ends: dict[str, int] = {}  # where the last end tag of an embedded element begins
    numbers, at = 0, 0
    links, around = False, 0  # inside a link, and how many elements were open when it began
    block = None
    # Links that are closed before the next one begins hold on beyond the blocks within them.
    marks = [(m.start(), bool(m[1])) for m in LINK.finditer(page)]
    closed = {a for (a, end), (_, then) in zip(marks, marks[1:], strict=False) if not end and then}
    whole = False

    def add(raw: str) -> None:
        nonlocal block
        if not raw or (block is None and raw.isspace()):
            return
        if block is None:
            block = Block([s[1] for s in stack], stack[-1][1], stack[-1][2], stack[-1][3], links and len(stack) > around)
            out.append(block)
        block.parts.append(raw)
        if links:
            block.linked += len(raw.split())

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag, end, attrs = (m["tag"], m["end"], m["attrs"]) if m["tag"] else (m["tag_"], m["end_"], m["attrs_"])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                links, around, whole = not end, len(stack), m.start() in closed
            continue
        outer, block = (block, links), None
        links = links and whole
        if end:
            if any(s[0] == tag for s in stack):
                while (last := stack.pop())[0] != tag:
                    pass
                block, links = last[4] or (None, links and len(stack) >= around)
            elif tag in EMBEDDED:
                block, links = outer
        elif tag in EMBEDDED:
            if tag not in ends:
                ends[tag] = max((e.start() for e in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
            if attrs.endswith("/") or ends[tag] < at:  # empty, or open to the end of the page
                block, links = outer
            else:
                numbers += 1
                stack.append((tag, numbers, stack[-1][2], True, outer))
        elif tag not in VOID:
            if tag in IMPLIED_END and stack[-1][0] == tag:
                stack.pop()
            if tag == "body" and any(s[0] == "head" for s in stack):
                stack = stack[:1]
            numbers += 1
            main = stack[-1][2] or tag in MAIN
            bad = stack[-1][3] or (tag in BOILERPLATE and not (tag in ("header", "address") and main))
            if tag in MAIN:
                mains[numbers] = tag
            # A form around the whole page is a wrapper like one with a name.
            if tag == "form" and not stack[-1][3]:
                bad = False
            if tag not in ("html", "body") and (name := _name(attrs) or ("weak" if tag == "form" else "")):
                named[numbers] = name
            stack.append((tag, numbers, main, bad, None))
            if attrs.endswith("/") and len(stack) > 1:
                stack.pop()
    add(page[at:])
    for b in out:
        b.text = " ".join(unescape("".join(b.parts)).split())
        b.words = len(b.text.split())
    out = [b for b in out if b.text]
    _mark_named(out, named, mains)
    return out


def classify(block: Block) -> float:
    """Log-odds of content."""
    z = BIAS + PER_WORD * min(block.words, MOST_WORDS) + LINKED * min(1.0, block.linked / block.words)
    z += IN_MAIN * block.main + TEASER * block.teaser
    return z + IN_BOILERPLATE * (block.bad or block.named)


def costs(blocks: list[Block]) -> list[float]:
    """Log-odds of all blocks. Where none is likelier content than not, as in a page of a few words, all are raised
    until the best of those that are neither boilerplate nor links is."""
    gains = [classify(b) for b in blocks]
    own = [g for g, b in zip(gains, blocks, strict=True)
           if not (b.bad or b.named or b.teaser) and 2 * b.linked < b.words]
    shift = SHORT - max(own) if own and max(gains) <= 0 else 0.0
    return [g + shift for g in gains]


def _distance(a: list[int], b: list[int]) -> int:
    """Steps through the tree from one block's element to the other's."""
    shared = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        shared += 1
    return len(a) + len(b) - 2 * shared


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and to the previous block under the same grandparent."""
    edges, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            edges.append((k - 1, k, NEXT / (1 + _distance(blocks[k - 1].path, b.path))))
        above = b.path[-2] if len(b.path) > 1 else -1
        if above in last and last[above] != k - 1:
            edges.append((last[above], k, SAME_PARENT / (1 + _distance(blocks[last[above]].path, b.path))))
        last[above] = k
    return edges


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (true: on the source side) that minimise the costs of terminals and cut edges.

    ``gains`` are the log-odds of true. Maximum flow by blocking flows in layered networks.
    """
    n = len(gains)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def arc(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for k, gain in enumerate(gains):
        arc(source, k, max(gain, 0.0), 0.0)
        arc(k, sink, max(-gain, 0.0), 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn, path = [0] * (n + 2), []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= tiny)
                u = to[path[first] ^ 1]
                del path[first:]
            while turn[u] < len(graph[u]):
                e = graph[u][turn[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(graph[u]):
                path.append(graph[u][turn[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                turn[u] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """Text of the content blocks, one a line; empty for a null or empty page or one without content."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    labels = minimum_cut(costs(blocks), smoothness(blocks))
    return "\n".join(b.text for b, content in zip(blocks, labels, strict=True) if content)


def extracted(html: str = "html") -> Column:
    @pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype=object)

    return extract(F.col(html))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row.

    A null, empty or broken page is no error: what has no content gives an empty text. Repeated
    rows come out each, null ids and urls stay null, other columns are not read and an empty
    table gives none.
    """
    return pages.select("page_id", "url", extracted().alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
