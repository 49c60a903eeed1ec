"""Node table of a page's structured-data blocks (J1-J6), made next to the parse with an explicit stack: any depth.

One row per JSON value in reading order. ``n`` numbers them, ``last`` is the last value inside, ``up`` the value around: what lies
inside is an interval of ``n``. ``flat`` objects are those met through arrays and ``@graph`` alone (records); ``chain`` is the
outermost object that leads here through ``@graph`` lists, so "types through the graph" is an interval test as well. Texts that
follow name, url or ``@id`` are resolved bottom up.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # as the parse step, it travels inside the task

_FIELDS = [
    ("n", "int", pa.int32()), ("last", "int", pa.int32()), ("up", "int", pa.int32()), ("key", "string", pa.string()), ("kind", "string", pa.string()),
    ("text", "string", pa.string()), ("said", "string", pa.string()), ("counted", "string", pa.string()),
    ("top", "boolean", pa.bool_()), ("flat", "boolean", pa.bool_()), ("typed", "boolean", pa.bool_()), ("chain", "int", pa.int32()),
    ("types", "array<string>", pa.list_(pa.string())), ("kids", "map<string,int>", pa.map_(pa.string(), pa.int32())),
    ("items", "array<int>", pa.list_(pa.int32())), ("plain_urls", "array<string>", pa.list_(pa.string())), ("json", "string", pa.string()),
]
NODE = f"struct<{','.join(f'{name}:{kind}' for name, kind, _ in _FIELDS)}>"
TABLE = f"struct<nodes:array<{NODE}>,bad:int,blank:int>"
ARROW_TABLE = pa.struct([
    ("nodes", pa.list_(pa.struct([(name, kind) for name, _, kind in _FIELDS]))), ("bad", pa.int32()), ("blank", pa.int32()),
])

# White space that the compatible result trims, and the keys a text is taken from, in order.
BLANKS = "".join(map(chr, (*range(9, 14), 32, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
TEXT_KEYS = ("name", "url", "@id")
_URL = re.compile(r"https?://[^\"',\]\s}]+")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


def _refuse(word: str):
    raise ValueError(f"{word} is not JSON")


def _deep_parse(text: str):
    """JSON of a nesting beyond what the built-in reader's recursion allows: containers stand on a list."""
    holder: list = []
    open_, keys, at, want = [holder], [None], 0, "value"
    while True:
        at = _SPACE.match(text, at).end()
        here = open_[-1]
        if here is holder and holder and want != "value":
            if at != len(text):
                raise ValueError("text after the value")
            return holder[0]
        c = text[at:at + 1]
        if want == "comma" or (want in ("first", "key") and c == "}" and isinstance(here, dict)) or (want == "first" and c == "]" and isinstance(here, list)):
            if c in ("]", "}") and (c == "}") == isinstance(here, dict) and here is not holder and want != "key":
                open_.pop()
                keys.pop()
                at, want = at + 1, "comma"
                continue
            if c != "," or want != "comma":
                raise ValueError("comma expected")
            at, want = at + 1, "key" if isinstance(here, dict) else "value"
            continue
        if isinstance(here, dict) and want in ("first", "key"):
            if c != '"':
                raise ValueError("key expected")
            keys[-1], at = scanstring(text, at + 1)
            at = _SPACE.match(text, at).end()
            if text[at:at + 1] != ":":
                raise ValueError("colon expected")
            at, want = at + 1, "value"
            continue
        if c == '"':
            value, at = scanstring(text, at + 1)
        elif c in ("{", "["):
            value, at = ({} if c == "{" else []), at + 1
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            number = None if word else _NUMBER.match(text, at)
            if not word and not number:
                raise ValueError("value expected")
            value = _WORDS[word] if word else (float(number[0]) if number[1] or number[2] else int(number[0]))
            at += len(word or number[0])
        if isinstance(here, dict):
            here[keys[-1]] = value
        else:
            here.append(value)
        if c in ("{", "["):
            open_.append(value)
            keys.append(None)
            want = "first"
        else:
            want = "comma"


def parse_json(text: str):
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _deep_parse(text)


def number_text(value: int | float) -> str:
    """A number as a script writes it: whole numbers without point."""
    number = float(value)
    if abs(number) < 1e21 and number == int(number):
        return str(int(number)) if abs(number) >= 1 << 53 else str(int(value))
    return re.sub(r"e([-+])0*(\d)", r"e\1\2", repr(number)).replace("inf", "Infinity")


def _script_text(value) -> str:
    if isinstance(value, str):
        return value
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, dict):
        return "[object Object]"
    return ",".join(map(str, value)) if isinstance(value, list) else number_text(value)


def _scalar(value) -> tuple[str, str | None]:
    if isinstance(value, str):
        return "s", value
    if value is None or isinstance(value, bool):
        return {None: "z", True: "t", False: "f"}[value], _script_text(value)
    return "n", number_text(value)


def _walk(value, nodes: list[dict]) -> None:
    first = len(nodes)
    stack = [(value, -1, None, True, True, -1)]
    while stack:
        value, up, key, flat, top, chain = stack.pop()
        n = len(nodes)
        node = {"n": n, "last": n, "up": up, "key": key, "top": top and not isinstance(value, list), "flat": False, "said": "", "counted": ""}
        nodes.append(node)
        if up >= 0:
            around = nodes[up]
            if around["kind"] == "o":
                around["kids"].append((key, n))
            else:
                around["items"].append(n)
        if isinstance(value, dict):
            chain = chain if chain >= 0 else n
            kinds = value.get("@type", [])
            node.update(kind="o", kids=[], flat=flat, chain=chain, types=[_script_text(t) for t in (kinds if isinstance(kinds, list) else [kinds])],
                        typed=not (kinds is None or kinds is False or kinds == "" or (kinds == 0 and not isinstance(kinds, list)) or "@type" not in value))
            stack += [(v, n, k, flat and k == "@graph", False, chain if k == "@graph" and isinstance(v, list) else -1) for k, v in reversed(value.items())]
            if key is not None and up >= 0 and nodes[up]["flat"] and key != "@graph":
                node["json"] = _dumped(value)
        elif isinstance(value, list):
            node.update(kind="a", items=[])
            # a list passes the chain of its object to its own objects, not to lists inside
            stack += [(v, n, None, flat, top, chain if isinstance(v, dict) else -1) for v in reversed(value)]
            if key is not None and up >= 0 and nodes[up]["flat"] and key != "@graph":
                node["json"] = _dumped(value)
        else:
            node["kind"], node["text"] = _scalar(value)
            if node["kind"] == "s":
                node["said"] = node["counted"] = value.strip(BLANKS)
            elif node["kind"] == "n":
                node["counted"] = node["text"]
        found = [u for t in (key, value) if isinstance(t, str) and "http://" in t for u in _URL.findall(json.dumps(t, ensure_ascii=False)) if not u.startswith("https://")]
        if found:
            node["plain_urls"] = found
    for node in reversed(nodes[first:]):
        if node["kind"] == "o":
            kids = dict(node["kids"])
            for mark in ("said", "counted"):
                node[mark] = next((nodes[kids[k]][mark] for k in TEXT_KEYS if k in kids and nodes[kids[k]][mark]), "")
        if node["up"] >= 0:
            around = nodes[node["up"]]
            around["last"] = max(around["last"], node["last"])


def _dumped(value) -> str | None:
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:  # shown as evidence only
        return None


def table_of(blocks: list[str] | None) -> dict:
    """Nodes of all blocks that parse, and how many do not (of these, how many are blank)."""
    nodes: list[dict] = []
    bad = blank = 0
    for text in blocks or []:
        try:
            value = parse_json(text or "")
        except ValueError:
            bad += 1
            blank += not (text or "").strip(BLANKS)
            continue
        _walk(value, nodes)
    return {"nodes": nodes, "bad": bad, "blank": blank}


SLICE_BYTES = 256 << 10  # source text that one task holds as Python values


def slices(batch: pa.RecordBatch, sizes: list[int], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of source each, whatever batch size the session has."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def with_nodes(rows: DataFrame, blocks: str = "jsonld", name: str = "ld") -> DataFrame:
    """``rows`` with the node table of their script texts added; parsed pages have it already."""
    kept = [c for c in rows.columns if c != name]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept), f"`{name}` {TABLE}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, [sum(len(text or "") for text in b.as_py() or ()) for b in batch.column(blocks)]):
                tables = pa.array([table_of(b.as_py()) for b in part.column(blocks)], type=ARROW_TABLE)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), tables], names=[*kept, name])

    return rows.mapInArrow(run, schema)
