"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items go into one suffix automaton over words (items are added one by one, so no match
runs over the edge of an item). A training text is streamed through it: at each word the automaton gives the length of the
longest run of words, ending there, that occurs in an item. Runs of at least ``window`` words, and whole items that are
shorter than a window, are hits. Words of hits are removed; a document whose hits cover more than ``max_coverage`` of its
words is dropped.

Scale: one pass over the texts, no shuffle, no exchange of texts. The benchmark is a test set: it is taken in blocks of about
``BLOCK_WORDS`` words, one automaton each, and long items are cut into pieces that overlap by a window less one word. A task
holds one automaton at a time: with more than one block it takes ``HELD_BYTES`` of texts, passes them through the blocks one after
another and merges the hits within the row. Only runs in which every pair of
words occurs in the block are fed to the automaton; others cannot hold a match of two words.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

Defined cases: null and empty texts have no words and no hits, an item without words matches nothing, equal items are
each reported, an empty benchmark leaves every document as it is, repeated rows are treated one by one, input columns
named like a result give way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, text_slices

BLOCK_WORDS = 500_000  # words of benchmark text in one automaton (about 250 MB of Python objects at most)
HELD_BYTES = 64 << 20  # texts that meet all blocks together where there are several
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_PLAIN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Limits:
    """``window``: words of a hit; ``max_coverage``: a document with more than this share of hit words is dropped."""

    window: int = 10
    max_coverage: float = 0.5


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_PLAIN).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window and of each short item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        coded = [(item, [number(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        self.span = len(self.vocabulary) + 1
        pairs = {a * self.span + b for _, codes in coded for a, b in zip(codes, codes[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.single = {codes[0] for _, codes in coded if len(codes) == 1}
        self._label(coded)

    def _extend(self, last: int, code: int) -> int:
        """The state of the sequence so far plus ``code``; existing states are reused, so items share them."""
        nxt, link, length = self.next, self.link, self.length
        if code in nxt[last]:
            known = nxt[last][code]
            return known if length[known] == length[last] + 1 else self._split(last, known, code)
        state = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in nxt[at]:
            nxt[at][code] = state
            at = link[at]
        if at >= 0:
            known = nxt[at][code]
            link[state] = known if length[known] == length[at] + 1 else self._split(at, known, code)
        return state

    def _split(self, at: int, known: int, code: int) -> int:
        """Part the shorter strings of ``known`` from its longer ones."""
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[known]))
        length.append(length[at] + 1)
        link.append(link[known])
        link[known] = twin
        while at >= 0 and nxt[at].get(code) == known:
            nxt[at][code] = twin
            at = link[at]
        return twin

    def _label(self, coded: list[tuple[str, list[int]]]) -> None:
        """Which items a window state stands for; ``short``: whole items of fewer words, by their state."""
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for item, codes in coded:
            state = matched = 0
            for code in codes:
                state, matched = self.step(state, matched, code)
                if matched >= self.window:
                    self.items.setdefault(self.window_state(state), set()).add(item)
            if len(codes) < self.window:
                self.short.setdefault(self.exact_state(state, len(codes)), (len(codes), set()))[1].add(item)

    def step(self, state: int, matched: int, code: int) -> tuple[int, int]:
        nxt = self.next
        while state and code not in nxt[state]:
            state = self.link[state]
            matched = self.length[state]
        if code in nxt[state]:
            return nxt[state][code], matched + 1
        return 0, 0

    def exact_state(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a match that is at least that long."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def window_state(self, state: int) -> int:
        return self.exact_state(state, self.window)

    def runs(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximal runs of words in which all neighbours occur side by side in the block."""
        known = codes >= 0
        if not known.any():
            return
        wide = codes[:-1] * self.span + codes[1:]
        joined = known[:-1] & known[1:]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, wide), len(self.pairs) - 1)
            joined &= self.pairs[at] == wide
        else:
            joined[:] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        yield from zip(edges[0::2].tolist(), (edges[1::2] + 1).tolist())
        if self.single:
            alone = known.copy()
            alone[:-1] &= ~joined
            alone[1:] &= ~joined
            yield from ((i, i + 1) for i in np.flatnonzero(alone).tolist())

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (end exclusive, may overlap) and the items with an occurring window."""
        get = self.vocabulary.get
        codes = np.array([get(w, -1) for w in words], dtype=np.int64)
        least = self.window if not self.short else min(n for n, _ in self.short.values())
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for start, end in self.runs(codes):
            if end - start < min(least, self.window):
                continue
            state = matched = 0
            for at, code in enumerate(codes[start:end].tolist(), start):
                state, matched = self.step(state, matched, code)
                if matched >= self.window:
                    spans.append((at + 1 - self.window, at + 1))
                    found |= self.items[self.window_state(state)]
                if self.short:
                    up = state
                    while up:
                        n, items = self.short.get(up, (0, ()))
                        if items and n <= matched:
                            spans.append((at + 1 - n, at + 1))
                            found.update(items)
                        up = self.link[up]
        return spans, found


def item_pieces(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> DataFrame:
    """(item, text) with items of more than ``block_words`` words cut into overlapping pieces, in which every window stands whole."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("w"))
    most = max(block_words, 2 * window)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(most - window + 1))
    return rows.select("item", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, F.lit(most)), " "))).alias("text"))


def item_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The benchmark cut by hash into blocks of about ``block_words`` words."""
    rows = item_pieces(benchmark, item_id, text, window, block_words)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (2 * block_words)))  # a word and its gap take two characters at least
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [rows]


def block_automaton(rows: list[tuple[str, str]], window: int) -> Automaton:
    return Automaton([(item, words_of(body)) for item, body in rows], window)


def hits_of(parts: list[list[str | None]], blocks: list[list[tuple[str, str]]], window: int, only: Automaton | None) -> list[tuple[list, list]]:
    """Merged hit ranges and item ids for lists of texts; the automaton of one block goes before the next is built."""
    out = [([[] for _ in texts], [set() for _ in texts]) for texts in parts]
    for rows in blocks:
        automaton = only or block_automaton(rows, window)
        for texts, (spans, items) in zip(parts, out):
            for i, body in enumerate(texts):
                new_spans, new_items = automaton.hits(words_of(body))
                if new_spans:
                    spans[i] = merged(spans[i] + new_spans)
                    items[i] |= new_items
        del automaton
    return [(spans, [sorted(x) for x in items]) for spans, items in out]


Finish = Callable[[dict, list, list, list], pa.RecordBatch]


def scan(
    docs: DataFrame, keep: list[str], benchmark: DataFrame, limits: Limits, finish: Finish, schema: T.StructType, text: str,
    item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One pass over the texts. ``finish`` gets columns ``k0``, ``k1``, ... of ``keep``, texts, merged hit ranges and item ids."""
    rows = bounded_batches(docs).select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    window, packed = limits.window, []
    for block in item_blocks(benchmark, item_id, item_text, window, block_words):
        items = [(r["item"] if r["item"] is not None else "", r["text"]) for r in block.collect()]  # about block_words words
        packed.append(docs.sparkSession.sparkContext.broadcast(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = block_automaton(packed[0].value, window) if len(packed) == 1 else None

        def finished(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = [{n: part.column(i) for i, n in enumerate(part.schema.names)} for part in held]
            texts = [c["text"].to_pylist() for c in cells]
            for c, t, (spans, items) in zip(cells, texts, hits_of(texts, [p.value for p in packed], window, only)):
                yield finish(c, t, spans, items)

        held, size = [], 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                held.append(part)
                size += part.nbytes
                if only or size >= HELD_BYTES:
                    yield from finished(held)
                    held, size = [], 0
        yield from finished(held)

    return rows.mapInArrow(run, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given (merged) ranges of words; what stands between two removed words goes as well."""
    data, kept, at = text.encode(), [], 0
    ends = [m.span() for m in WORD.finditer(data.lower())]
    for start, end in spans:
        kept.append(data[at : ends[start][0]])
        at = ends[end - 1][1]
    kept.append(data[at:])
    return b"".join(kept).decode()


def report(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Per row: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, the cleaned text's length and ``dropped``."""
    names = ["k0", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "kept_chars", "dropped"]
    kinds = [T.LongType()] * 3 + [T.StringType(), T.BooleanType(), T.LongType(), T.BooleanType()]
    schema = T.StructType([T.StructField("k0", docs.schema[doc_id].dataType), *map(T.StructField, names[1:], kinds)])
    types = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.int64(), pa.bool_()]
    most = limits.max_coverage

    def finish(cells: dict, texts: list, spans: list, items: list) -> pa.RecordBatch:
        rows = []
        for body, ranges, found in zip(texts, spans, items):
            n, hit = len(words_of(body)), sum(b - a for a, b in ranges)
            cleaned = without_words(body, ranges) if ranges else body or ""
            rows.append((n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0, len(cleaned), hit > most * n))
        return pa.RecordBatch.from_arrays([cells["k0"], *[pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate(types)]], names=names)

    return scan(docs, [doc_id], benchmark, limits, finish, schema, text, **kw).withColumnRenamed("k0", "doc_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), text: str = "text", length: str | None = None, **kw) -> DataFrame:
    """``docs`` without hit words and without documents over the coverage limit; ``length`` names a column that follows the text."""
    names, kinds = docs.columns, [f.dataType for f in docs.schema]
    schema = T.StructType([T.StructField(f"k{i}", k) for i, k in enumerate(kinds)])
    fields, place = schema.fieldNames(), f"k{names.index(text)}"
    sized = f"k{names.index(length)}" if length else None
    most = limits.max_coverage

    def finish(cells: dict, texts: list, spans: list, items: list) -> pa.RecordBatch:
        keep = [not r or sum(b - a for a, b in r) <= most * len(words_of(t)) for t, r in zip(texts, spans)]
        hit = [bool(r) and k for r, k in zip(spans, keep)]
        if any(hit):
            cleaned = [without_words(t, r) if h else t for t, r, h in zip(texts, spans, hit)]
            cells[place] = pa.array(cleaned, type=pa.string())
            if sized:
                old = cells[sized]
                cells[sized] = pa.array([len(t) if h else o for t, h, o in zip(cleaned, hit, old.to_pylist())], type=old.type)
        return pa.RecordBatch.from_arrays([cells[f] for f in fields], names=fields).filter(pa.array(keep, type=pa.bool_()))

    out = scan(docs, names, benchmark, limits, finish, schema, text, **kw)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])
