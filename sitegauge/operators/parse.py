"""H1: the one parse job. HTML text in, typed element rows out.

``mapInArrow`` keeps the work partition-parallel. The helper below only rebuilds the element tree
(implied end tags, raw text, reopened formatting) and writes the elements down; every selector,
predicate and aggregate after that is a Spark expression over the arrays.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from . import structured

# The helper travels inside the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ELEMENT = (
    "struct<ord:int,last:int,tag:string,up:string,attrs:map<string,string>,abs:string,host:string,text:string,"
    "hid:boolean,excl:boolean,crumb:boolean,rel:boolean>"
)
_ARROW_ELEMENT = pa.struct(
    [
        ("ord", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("up", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())), ("abs", pa.string()), ("host", pa.string()), ("text", pa.string()),
        ("hid", pa.bool_()), ("excl", pa.bool_()), ("crumb", pa.bool_()), ("rel", pa.bool_()),
    ]
)
FAMILIES = ("headings", "anchors", "images", "scripts", "link_tags", "metas", "nodes")
_FAMILY_OF = {
    **{f"h{i}": "headings" for i in range(1, 7)},
    "a": "anchors", "img": "images", "script": "scripts", "link": "link_tags", "meta": "metas",
}
_DOM_FIELDS = [
    ("title", "string", pa.string()),
    ("body_text", "string", pa.string()),
    ("visible_words", "int", pa.int32()),
    ("first_p", "string", pa.string()),
    ("dom_nodes", "int", pa.int32()),
    ("http_refs", "int", pa.int32()),
    ("class_text", "string", pa.string()),
    ("id_text", "string", pa.string()),
    ("tag_counts", "map<string,int>", pa.map_(pa.string(), pa.int32())),
    ("h2_sections", "array<struct<title:string,text:string>>",
     pa.list_(pa.struct([("title", pa.string()), ("text", pa.string())]))),
    ("jsonld", "array<string>", pa.list_(pa.string())),
    ("ld", structured.TABLE, structured.ARROW_TABLE),
    ("parse_error", "string", pa.string()),
    *[(name, f"array<{ELEMENT}>", pa.list_(_ARROW_ELEMENT)) for name in FAMILIES],
]
DOM_COLUMNS = tuple(name for name, _, _ in _DOM_FIELDS)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe noembed noframes xmp".split())
_ESCAPABLE_RAW = frozenset(("title", "textarea"))
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW | _ESCAPABLE_RAW}
SLICE_BYTES = structured.SLICE_BYTES  # source text that one task holds as parsed elements
_HEAD = frozenset("title meta link base script style noscript template".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
_TABLE_PARTS = frozenset("tr td th tbody thead tfoot caption col colgroup option optgroup".split())
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_SCOPE = frozenset("html table td th caption template object button".split())
_KEEP = frozenset(
    "html body main article section aside header footer nav table caption blockquote cite dfn time b strong picture "
    "source style svg desc video track iframe details form label button input select textarea ins sup".split()
)
_KEEP_ATTRS = frozenset(
    "id class style hidden role aria-hidden aria-expanded aria-label data-nosnippet itemscope itemtype itemprop "
    "property typeof rel data-reactroot src href poster".split()
)
_WITH_TEXT = frozenset("caption blockquote cite dfn time b strong label button footer table h1 h2 h3 h4 h5 h6 a".split())
_TEXT_MARK = re.compile(
    "contact|address|phone|email|location|office|transcript|service|product|treatment|solution|footer|breadcrumb", re.I
)
_EXCLUDED_CLASS = re.compile("modal|menu|accordion|tab", re.I)
_RELATED = re.compile(r"\b(see also|related|learn more|next|recommended|further reading|resources)\b", re.I)
_HIDDEN_STYLES = ("display:none", "display: none", "visibility:hidden", "visibility: hidden")
_HIDDEN_WORD = re.compile(r"\b(d-none|hidden|invisible|sr-only|visually-hidden|hide|collapsed)\b", re.I)
_HIDDEN_STYLE = re.compile(
    r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0|font-size:\s?0|text-indent:-|left:-", re.I
)
HID, SKIP, EXCL, CRUMB, MAIN = 1, 2, 4, 8, 16
_DEFAULT_PORT = {"http": ":80", "https": ":443"}


def resolve(base: str, href: str) -> str:
    """Absolute form of ``href``, ``''`` when it cannot be resolved."""
    try:
        joined = urljoin(base, href.strip().replace("\t", "").replace("\n", ""))
        parts = urlsplit(joined)
        if not parts.scheme:
            return ""
        if parts.scheme not in _DEFAULT_PORT:
            return joined
        host = parts.netloc.lower()
        if not host:
            return ""
        host = host.removesuffix(_DEFAULT_PORT[parts.scheme])
        path = quote(parts.path.replace("\\", "/") or "/", safe="/%:@!$&'()*+,;=~-._[]|^")
        query = "?" + quote(parts.query, safe="/%:@!$&()*+,;=~-._?[]|^{}`\\") if parts.query else ""
        hash_ = "#" + quote(parts.fragment, safe="/%:@!$&'()*+,;=~-._?[]|^{}#\\") if parts.fragment else ""
        return f"{parts.scheme}://{host}{path}{query}{hash_}"
    except ValueError:
        return ""


def bare_host(url: str) -> str:
    """U4: host without port and leading ``www.``, ``''`` for addresses without one."""
    if "://" not in url:
        return ""
    return url.split("://", 1)[1].split("/", 1)[0].split("?", 1)[0].rsplit("@", 1)[-1].split(":", 1)[0].removeprefix("www.")


class _Tree:
    """Elements of one document in preorder, with text as offsets into one string."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.attrs: list[dict[str, str]] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.up: list[str] = []
        self.flags: list[int] = []
        self.stack: list[int] = []
        self.formatting: list[tuple[str, dict[str, str], int] | None] = []
        self.parts: list[str] = []
        self.visible: list[str] = []
        self.visible_main: list[str] = []
        self.size = 0
        self.body = -1
        self.open("html", {})
        self.head = self.open("head", {})

    def open(self, tag: str, attrs: dict[str, str]) -> int:
        index = len(self.tag)
        above = self.stack[-1] if self.stack else -1
        self.tag.append(tag)
        self.parent.append(above)
        self.last.append(index)
        self.attrs.append(attrs)
        self.start.append(self.size)
        self.end.append(self.size)
        self.up.append(f"{self.up[above]}{self.tag[above]}/" if above >= 0 else "/")
        self.flags.append((self.flags[above] if above >= 0 else 0) | self._own_flags(tag, attrs))
        self.stack.append(index)
        return index

    @staticmethod
    def _own_flags(tag: str, attrs: dict[str, str]) -> int:
        flags = 0
        style = attrs.get("style", "")
        squeezed = "".join(style.split()).lower()
        aria_hidden = attrs.get("aria-hidden") == "true"
        if "hidden" in attrs or aria_hidden:
            flags |= HID | SKIP
        if "display:none" in squeezed or "visibility:hidden" in squeezed:
            flags |= HID
        if any(mark in style for mark in _HIDDEN_STYLES):
            flags |= SKIP
        if tag in ("script", "style", "noscript", "template", "svg"):
            flags |= SKIP
        cls, ident = attrs.get("class", ""), attrs.get("id", "")
        if (
            tag in ("nav", "header", "footer")
            or attrs.get("role") == "navigation"
            or attrs.get("aria-modal") == "true"
            or _EXCLUDED_CLASS.search(cls)
        ):
            flags |= EXCL
        label = attrs.get("aria-label", "") if tag == "nav" else ""
        if "breadcrumb" in f"{label}\n{cls}\n{ident}".lower():
            flags |= CRUMB
        if tag == "main":
            flags |= MAIN
        return flags

    def ensure_body(self, attrs: dict[str, str] | None = None) -> None:
        if self.body < 0:
            while len(self.stack) > 1:
                self.pop()
            self.body = self.open("body", attrs or {})
        elif attrs:
            for key, value in attrs.items():
                self.attrs[self.body].setdefault(key, value)

    def pop(self) -> int:
        index = self.stack.pop()
        self.last[index] = len(self.tag) - 1
        self.end[index] = self.size
        if self.tag[index] in ("td", "th", "caption", "object"):
            while self.formatting and self.formatting.pop() is not None:
                pass
        return index

    def pop_to(self, index: int) -> None:
        while self.stack and self.pop() != index:
            pass

    def nearest(self, tags: tuple[str, ...] | frozenset[str], stop: frozenset[str]) -> int:
        for index in reversed(self.stack):
            if self.tag[index] in tags:
                return index
            if self.tag[index] in stop:
                return -1
        return -1

    def add_text(self, text: str, target: int | None = None) -> None:
        self.parts.append(text)
        self.size += len(text)
        flags = self.flags[self.stack[-1] if target is None else target]
        if not flags & SKIP and self.body >= 0:
            self.visible.append(text)
            if flags & MAIN:
                self.visible_main.append(text)

    def reopen_formatting(self) -> None:
        on_stack = set(self.stack)
        begin = len(self.formatting)
        while begin and self.formatting[begin - 1] is not None and self.formatting[begin - 1][2] not in on_stack:
            begin -= 1
        for i in range(begin, len(self.formatting)):
            tag, attrs, _ = self.formatting[i]
            self.formatting[i] = (tag, attrs, self.open(tag, attrs))

    def remember(self, tag: str, attrs: dict[str, str], index: int) -> None:
        same = [i for i, f in enumerate(self.formatting) if f and f[0] == tag and f[1] == attrs]
        if len(same) >= 3:
            del self.formatting[same[0]]
        self.formatting.append((tag, attrs, index))

    def begin(self, tag: str, attrs: dict[str, str], self_closing: bool) -> int:
        """Insert one start tag with the implied end tags it needs; returns the element."""
        if tag == "html":
            for key, value in attrs.items():
                self.attrs[0].setdefault(key, value)
            return -1
        if tag == "head":
            return -1
        if tag == "body":
            self.ensure_body(attrs)
            return -1
        if self.body < 0 and tag not in _HEAD:
            self.ensure_body()
        if tag in _CLOSES_P:
            if tag in ("li", "dd", "dt"):
                item = self.nearest(("li",) if tag == "li" else ("dd", "dt"), _SCOPE | {"ul", "ol", "dl"})
                if item >= 0:
                    self.pop_to(item)
            paragraph = self.nearest(("p",), _SCOPE)
            if paragraph >= 0:
                self.pop_to(paragraph)
            if tag[0] == "h" and tag[1:].isdigit() and self.tag[self.stack[-1]] in _FAMILY_OF \
                    and _FAMILY_OF[self.tag[self.stack[-1]]] == "headings":
                self.pop()
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
            table = frozenset(("table", "html", "template"))
            closes = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, ("tbody", "thead", "tfoot"))
            row = self.nearest(closes, table | ({"tr"} if tag in ("td", "th") else set()))
            if row >= 0:
                self.pop_to(row)
            if tag == "tr" and self.tag[self.stack[-1]] == "table":
                self.open("tbody", {})
            elif tag in ("td", "th") and self.tag[self.stack[-1]] == "table":
                self.open("tbody", {})
                self.open("tr", {})
        elif tag in ("option", "optgroup"):
            if self.tag[self.stack[-1]] == "option":
                self.pop()
        elif tag in ("a", "button"):
            earlier = self.nearest((tag,), frozenset(("html", "td", "th", "caption", "template", "object")))
            if earlier >= 0:
                self.pop_to(earlier)
            if tag == "a":
                self.formatting = [f for f in self.formatting if f is None or f[0] != "a"]
        if self.body >= 0 and tag not in _CLOSES_P and tag not in _HEAD and tag not in _TABLE_PARTS:
            self.reopen_formatting()
        index = self.open(tag, attrs)
        if tag in _FORMATTING:
            self.remember(tag, attrs, index)
        elif tag in ("td", "th", "caption", "object"):
            self.formatting.append(None)
        if tag in _VOID or (self_closing and "/svg/" in self.up[index]):
            self.pop()
        return index

    def finish(self, tag: str) -> None:
        """Handle one end tag."""
        if tag in ("html", "body", "head"):
            return
        if tag == "br":
            self.begin("br", {}, False)
            return
        if tag in _FORMATTING:
            for i in range(len(self.formatting) - 1, -1, -1):
                if self.formatting[i] is None:
                    break
                if self.formatting[i][0] == tag:
                    index = self.formatting[i][2]
                    del self.formatting[i]
                    if index in self.stack:
                        blocks = [n for n in self.stack[self.stack.index(index) + 1:] if self.tag[n] in _CLOSES_P]
                        if blocks:
                            self.stack.remove(index)
                            self.last[index], self.end[index] = len(self.tag) - 1, self.size
                        else:
                            self.pop_to(index)
                    return
            return
        stop = frozenset(("html",)) if tag in ("table", "td", "th", "caption", "template", "object") else _SCOPE
        index = self.nearest((tag,), stop - {tag})
        if index >= 0:
            self.pop_to(index)
        elif tag == "p":
            self.begin("p", {}, False)
            self.pop()


def _read_attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        if "&" in value:
            value = entities.unescape(value)
        out.setdefault(name.lower(), value)
    return out


def _build(source: str) -> _Tree:
    tree = _Tree()
    position, length = 0, len(source)
    while position < length:
        token = _TOKEN.search(source, position)
        stop = token.start() if token else length
        if stop > position:
            chunk = source[position:stop]
            if tree.body >= 0 or chunk.strip():
                tree.ensure_body()
                tree.reopen_formatting()
                tree.add_text(entities.unescape(chunk) if "&" in chunk else chunk)
        if not token:
            break
        position = token.end()
        tag = token.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if token.group(1):
            tree.finish(tag)
            continue
        raw = token.group(3)
        index = tree.begin(tag, _read_attrs(raw) if raw.strip(" /") else {}, raw.endswith("/"))
        if index >= 0 and (tag in _RAW or tag in _ESCAPABLE_RAW) and "/svg/" not in tree.up[index]:
            close = _RAW_END[tag].search(source, position)
            content_end = close.start() if close else length
            content = source[position:content_end]
            if content:
                tree.add_text(entities.unescape(content) if tag in _ESCAPABLE_RAW and "&" in content else content)
            tree.pop()
            end = source.find(">", content_end) if close else length
            position = end + 1 if end >= 0 else length
    tree.ensure_body()
    while tree.stack:
        tree.pop()
    return tree


def _h2_sections(tree: _Tree, text: str) -> list[dict[str, str]]:
    heads = [i for i, tag in enumerate(tree.tag) if tag == "h2"]
    if not heads:
        return []
    parents = {tree.parent[i] for i in heads}
    children: dict[int, list[int]] = {p: [] for p in parents}
    for i, parent in enumerate(tree.parent):
        if parent in children:
            children[parent].append(i)
    out = []
    for head in heads:
        following = []
        for sibling in children[tree.parent[head]]:
            if sibling <= head:
                continue
            if tree.tag[sibling] == "h2":
                break
            following.append(text[tree.start[sibling]:tree.end[sibling]])
        out.append({"title": text[tree.start[head]:tree.end[head]].strip(), "text": " ".join(following)})
    return out


def parse_page(source: str, base: str) -> dict:
    """Typed elements of one document."""
    tree = _build(source)
    text = "".join(tree.parts)
    slice_of = lambda i: text[tree.start[i]:tree.end[i]]
    families: dict[str, list[dict]] = {name: [] for name in FAMILIES}
    counts: dict[str, int] = {}
    classes, ids, jsonld = [], [], []
    related: dict[int, bool] = {}
    http_refs, title, first_p = 0, "", None
    for i, tag in enumerate(tree.tag):
        counts[tag] = counts.get(tag, 0) + 1
        attrs = tree.attrs[i]
        in_svg = "/svg/" in tree.up[i]
        if tag == "title" and counts[tag] == 1:
            title = slice_of(i)
        elif tag == "p" and first_p is None:
            first_p = slice_of(i)
        cls, ident = attrs.get("class", ""), attrs.get("id", "")
        if cls:
            classes.append(" ".join(cls.split()))
        if ident:
            ids.append(" ".join(ident.split()))
        href = attrs.get("href", attrs.get("src"))
        http_refs += attrs.get("src", "").startswith("http://") or attrs.get("href", "").startswith("http://")
        family = _FAMILY_OF.get(tag)
        if family is None:
            crumb_span = tag == "span" and tree.flags[i] & CRUMB
            if not (tag in _KEEP or (tag == "title" and in_svg) or crumb_span or not _KEEP_ATTRS.isdisjoint(attrs)):
                continue
            family = "nodes"
        hidden_like = (
            "hidden" in attrs or "data-nosnippet" in attrs or "aria-hidden" in attrs or "aria-expanded" in attrs
            or "itemprop" in attrs or "property" in attrs or attrs.get("role") in ("tabpanel", "button", "link")
            or (tag == "details" and "open" not in attrs)
            or bool(_HIDDEN_STYLE.search(attrs.get("style", ""))) or bool(_HIDDEN_WORD.search(cls))
        )
        wants_text = (
            tag in _WITH_TEXT or hidden_like or (tag == "script" and "src" not in attrs) or tag == "style"
            or bool((cls or ident) and _TEXT_MARK.search(f"{cls} {ident}"))
            or (tag == "section" and "Transcript" in slice_of(i))
            or (tree.flags[i] & CRUMB and tag == "span")
        )
        absolute = resolve(base, href) if href is not None else None
        rel = False
        if tag == "a" and tree.parent[i] >= 0:
            parent = tree.parent[i]
            if parent not in related:
                related[parent] = bool(_RELATED.search(slice_of(parent)))
            rel = related[parent]
        if tag == "script" and attrs.get("type") == "application/ld+json":
            jsonld.append(slice_of(i))
        families[family].append(
            {
                "ord": i, "last": tree.last[i], "tag": tag, "up": tree.up[i], "attrs": list(attrs.items()),
                "abs": absolute,
                "host": bare_host(absolute) if absolute else None,
                "text": slice_of(i) if wants_text else None,
                "hid": bool(tree.flags[i] & HID), "excl": bool(tree.flags[i] & EXCL),
                "crumb": bool(tree.flags[i] & CRUMB), "rel": rel,
            }
        )
    visible = "".join(tree.visible_main) or "".join(tree.visible)
    return {
        "title": title, "body_text": slice_of(tree.body), "visible_words": len(visible.split()),
        "first_p": first_p, "dom_nodes": len(tree.tag), "http_refs": http_refs,
        "class_text": "\n".join(classes), "id_text": "\n".join(ids), "tag_counts": list(counts.items()),
        "h2_sections": _h2_sections(tree, text), "jsonld": jsonld, "ld": structured.table_of(jsonld), "parse_error": None, **families,
    }


_EMPTY = {name: None for name in DOM_COLUMNS}


def _safe_parse(source: str | None, base: str | None) -> dict:
    try:
        return parse_page(source or "", base or "")
    except Exception as error:  # one broken page must not fail the job; its checks are skipped with this reason
        return {**_EMPTY, **parse_page("", base or ""), "parse_error": f"{type(error).__name__}: {error}"[:200]}


def _slices(batch: pa.RecordBatch, html: str) -> Iterator[pa.RecordBatch]:
    return structured.slices(batch, [len(cell.as_buffer()) if cell.is_valid else 0 for cell in batch.column(html)], SLICE_BYTES)


def parse_pages(pages: DataFrame, html: str = "html", base: str = "url", keep_html: bool = True) -> DataFrame:
    """H1: every input row with its document columns added; ``base`` resolves relative links."""
    kept = [c for c in pages.columns if keep_html or c != html]
    extra = ", ".join(f"`{name}` {kind}" for name, kind, _ in _DOM_FIELDS)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in kept] + [extra]
    )
    arrow_types = {name: kind for name, _, kind in _DOM_FIELDS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, html):
                rows = [_safe_parse(s.as_py(), b.as_py()) for s, b in zip(part.column(html), part.column(base))]
                arrays = [part.column(name) for name in kept]
                arrays += [pa.array([r[name] for r in rows], type=arrow_types[name]) for name in DOM_COLUMNS]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *DOM_COLUMNS])

    return pages.mapInArrow(run, schema)
