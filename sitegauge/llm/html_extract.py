"""Main-text extraction by minimum-cut labelling of text blocks.

A page is cut into text blocks (runs of text between block-level tags). A linear classifier over the block's place in the page,
its words, links and punctuation, and the whole names of the elements around it (a cost, not a veto), gives each block a cost for being content and one for being boilerplate; these are terminal
capacities. Neighbours in page order, and neighbours under one parent element, are tied by smoothness capacities. The maximum
flow from content to boilerplate separates the blocks: what the source still reaches is content.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by an empty line.

Scale: pages are independent, so this is one pass over the scan without a shuffle; a task holds a few megabytes of pages.

Defined cases: null and empty pages, and pages without content, give an empty text; unclosed and stray tags are tolerated, and an
unclosed button or the like ends at the next block; a form that wraps an article, or many words for its controls, is no form;
script, style and other raw elements, comments and hidden elements never give text; repeated rows give repeated results; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

RAW = {
    t: re.compile(rf"</{t}(?=[\s/>])", re.I)
    for t in "script style noscript template svg math iframe object select textarea button title canvas audio video".split()
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CLOSES = {  # a start tag that ends an open element of these kinds
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "body": {"head"},
}
SCOPE = frozenset("article aside blockquote body div footer form header main nav section table ul ol dl menu fieldset".split())
AWAY = frozenset("nav footer aside menu dialog search head".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
AWAY_WORD = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|cookies?|consent|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|"
    r"popup|promo\w*|related|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|toolbar|widgets?"
)
REPLY_WORD = re.compile(r"comments?|disqus|replies|respond")
HOME_WORD = re.compile(r"article|articlebody|content|entry|main|post|story")
STATE_HEADS = frozenset("has no not with without is hide show".split())  # names that tell how a page is set up, not what an element is
STATE_TAILS = frozenset("open closed free enabled disabled on off active layout wrapper container page template body grid row".split())
FORM_WORDS = 80  # words for each control (and one more) from which on a form is a wrapper
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
WORD = re.compile(r"\w+")
SCALE = 1000
RAW_TAG = {t: re.compile(rf"<(/)?{t}(?=[\s/>])[^<>]*?(/)?(?=>)", re.I) for t in RAW}
NESTING = frozenset("svg math template object".split())
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)
CONTROLS = frozenset("input select textarea button".split())


@dataclass(frozen=True)
class Costs:
    """Weights of the classifier (in favour of content) and of the smoothness edges."""

    home: float = 5.0
    away: float = -9.0
    away_name: float = -5.0
    per_word: float = 0.06
    most_words: int = 40
    links: float = -4.0
    sentence: float = 0.6
    heading: float = 0.4
    bias: float = -1.0
    adjacent: float = 0.5
    same_parent: float = 0.7


@dataclass
class Block:
    text: str
    parent: int
    tag: str
    home: bool
    away: bool
    link_share: float
    away_name: bool = False
    forms: tuple[int, ...] = ()


@dataclass
class _Element:
    """An open element with what it and its ancestors say about content."""

    tag: str
    number: int
    home: bool = False
    away: bool = False  # by its kind: never content
    away_name: bool = False  # by its name: a cost, which a main element inside takes back
    forms: tuple[int, ...] = ()


@dataclass
class _Form:
    words: int = 0
    controls: int = 0
    holds_home: bool = False

    def is_wrapper(self) -> bool:
        return self.holds_home or self.words >= FORM_WORDS * (self.controls + 1)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def name_kind(name: str) -> str:
    """What one whole class name or id says: "home", "away", "reply" or nothing."""
    parts = [p for p in re.split("[-_]+", name.lower()) if p]
    if not parts or parts[0] in STATE_HEADS or parts[-1] in STATE_TAILS:
        return ""
    away = [bool(AWAY_WORD.fullmatch(p)) for p in parts]
    if any(REPLY_WORD.fullmatch(p) for p in parts):
        return "reply"
    if any(HOME_WORD.fullmatch(p) for p in parts):
        return "home" if not any(away) else "away" if away[-1] and parts[-1] != "header" else ""
    return "away" if away[0] or away[-1] else ""


def _open(tag: str, source: str, number: int, parent: _Element, forms: list[_Form]) -> _Element:
    """The element below ``parent``."""
    out = _Element(tag, number, parent.home or tag in ("article", "main"), parent.away or tag in AWAY, parent.away_name, parent.forms)
    if tag == "header" and not parent.home:
        out.away = True
    if tag == "form":
        forms.append(_Form())
        out.forms = (*parent.forms, len(forms) - 1)
    is_main = tag == "main"
    if source and tag not in ("html", "body"):
        given = _attributes(source)
        kinds = {name_kind(n) for n in f"{given.get('class', '')} {given.get('id', '')}".split()}
        roles = set(given.get("role", "").lower().split())
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        is_main = is_main or "main" in roles or given.get("itemprop") == "articleBody"
        if hidden or roles & AWAY_ROLES or "reply" in kinds:
            out.away = True
        elif is_main or kinds >= {"home"} and "away" not in kinds:
            out.home = True
        elif "away" in kinds and "home" not in kinds and tag not in ("article", "main"):
            out.away_name = True
    if is_main:
        out.away_name = False
    if is_main or tag == "article":
        for f in out.forms:
            forms[f].holds_home = True
    return out


def _raw_end(html: str, tag: str, at: int) -> int:
    """Where the content of a raw element ends. One that isn't closed before its like opens again ends at the next block-level tag."""
    close = RAW[tag].search(html, at)
    if tag in ("script", "style"):
        return len(html) if close is None else (html.find(">", close.end()) + 1 or len(html))
    open_ = 1
    for m in RAW_TAG[tag].finditer(html, at):
        open_ += -1 if m[1] else 0 if m[2] else 1
        if not open_:
            return html.find(">", m.end()) + 1 or len(html)
        if open_ > 1 and tag not in NESTING:
            break
    block = BLOCK_TAG.search(html, at)
    return len(html) if block is None else block.start()


def blocks_of(html: str | None) -> list[Block]:
    """Text blocks of a page in page order."""
    html = html or ""
    out: list[Block] = []
    forms: list[_Form] = []
    stack = [_Element("", 0)]
    pieces: list[str] = []
    number = linked = total = in_link = at = 0

    def flush() -> None:
        nonlocal linked, total
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1]
                parent = stack[-2] if len(stack) > 1 and top.tag not in SCOPE else top
                out.append(Block(text, parent.number, top.tag, top.home, top.away, linked / total if total else 0.0, top.away_name, top.forms))
                for f in top.forms:
                    forms[f].words += len(text.split())
            pieces.clear()
        linked = total = 0

    end = len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            text = html[at:lt]
            pieces.append(text if "&" not in text else unescape(text))
            size = len(text) - text.count(" ")
            total += size
            linked += size if in_link else 0
        if lt == end:
            break
        follow = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        closing = follow == "/"
        name = NAME.match(html, lt + 1 + closing)
        if not name:
            if follow in ("!", "?", "/"):
                close = html.find(">", lt)
                at = end if close < 0 else close + 1
            else:
                pieces.append("<")
                at = lt + 1
            continue
        gt = html.find(">", name.end())
        if gt < 0:
            break  # an unfinished tag at the end of a cut page
        source = html[name.end() : gt]
        while source.count('"') % 2 and not closing:  # ">" inside a quoted value
            more = html.find(">", gt + 1)
            if more < 0:
                break
            gt = more
            source = html[name.end() : gt]
        at = gt + 1
        tag = name[0].lower()
        if tag in CONTROLS and not closing and 'type="hidden"' not in source:
            for f in stack[-1].forms:
                forms[f].controls += 1
        if tag in RAW:
            if tag in ("iframe", "object", "video", "audio", "canvas"):
                flush()
            if not closing and not source.endswith("/"):
                at = _raw_end(html, tag, at)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        if tag in VOID:
            continue
        ends = CLOSES.get(tag, {"p"})
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                del stack[i:]
            elif stack[i].tag in SCOPE:
                break
        number += 1
        stack.append(_open(tag, source, number, stack[-1], forms))
    flush()
    for block in out:
        block.away = block.away or not all(forms[f].is_wrapper() for f in block.forms)
    return out


def content_scores(blocks: list[Block], costs: Costs = Costs()) -> list[float]:
    """Classifier value of each block; above 0 speaks for content."""
    out = []
    for b in blocks:
        words = len(WORD.findall(b.text))
        out.append(
            costs.bias + (costs.away if b.away else costs.home * b.home + costs.away_name * b.away_name) + costs.per_word * min(words, costs.most_words)
            + costs.links * b.link_share + (costs.sentence if b.text[-1] in ".!?…\"'»”" else 0.0)
            + (costs.heading if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 0.0)
        )
    return out


def smooth_edges(blocks: list[Block], costs: Costs = Costs()) -> list[tuple[int, int, float]]:
    """(block, block, capacity): neighbours in page order, and the next block of the same parent."""
    weights: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            weights[i - 1, i] = weights.get((i - 1, i), 0.0) + costs.adjacent
        parent = b.parent
        if parent in last:
            weights[last[parent], i] = weights.get((last[parent], i), 0.0) + costs.same_parent
        last[parent] = i
    return [(i, j, w) for (i, j), w in weights.items()]


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for blocks on the content side of a minimum cut (Dinic's algorithm on integer capacities).

    Of several minimum cuts it is the one with the fewest content blocks.
    """
    n = len(scores)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def add(u: int, v: int, forth: int, back: int) -> None:
        heads[u].append(len(to))
        to.append(v)
        room.append(forth)
        heads[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, score in enumerate(scores):
        capacity = round(abs(score) * SCALE)
        if capacity:
            add(source, i, capacity, 0) if score > 0 else add(i, sink, capacity, 0)
    for i, j, weight in edges:
        add(i, j, round(weight * SCALE), round(weight * SCALE))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in heads[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if not room[e])
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[u] < len(heads[u]):
                e = heads[u][tried[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    break
                tried[u] += 1
            else:
                if not path:
                    break
                u = to[path.pop() ^ 1]
                tried[u] += 1
                continue
            path.append(heads[u][tried[u]])
            u = to[path[-1]]


def labelled(html: str | None, costs: Costs = Costs()) -> list[tuple[str, bool]]:
    """The blocks of a page with their label (True: content)."""
    blocks = blocks_of(html)
    if not blocks:
        return []
    return list(zip((b.text for b in blocks), minimum_cut(content_scores(blocks, costs), smooth_edges(blocks, costs))))


def main_text(html: str | None, costs: Costs = Costs()) -> str:
    return "\n\n".join(text for text, content in labelled(html, costs) if content)


def extract(pages: DataFrame, costs: Costs = Costs(), page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points)."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                texts = [main_text(h, costs) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
