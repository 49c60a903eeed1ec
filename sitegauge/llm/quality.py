"""Quality rules: repetition counts, and the divergence of a text's histograms from its language.

Each document gives a character-class histogram and, where its language has a list, a histogram of common words. Every value of
``lang`` has a reference of its own: the mean of the normalised histograms of all its documents (so one long text weighs as much
as a short one), if at least ``min_documents`` are long enough to measure. A document is rejected
when its Jensen-Shannon distance (base 2, 0 to 1) from the reference is above a limit, or when both distances are above
lower limits; texts below a minimum length are not judged by that histogram, as short texts stray by chance.

The base rule rejects texts of fewer than ten words and texts with more than a fifth of the words in repeated 5-word
windows.

Scale: two scans and no shuffle of texts while there are at most ``MOST_LANGUAGES`` references. The first adds up histograms per
language, which Spark merges as a few rows per language; the second measures, decides and may pass the text through. The number
of references is counted before they travel with the tasks; beyond that bound each row gets its own by a join on the language.

Defined cases: null text is an empty text and fails the base rule; a null language, or one with too few measurable documents, is
judged by the base rule only; a language without a word list is judged by characters only; repeated rows are
judged one by one; an empty table gives an empty table; input columns named like a measure give way to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, bounded_batches, stage, text_slices

# The most common words of each language that has a word reference.
COMMON_WORDS = {
    "de": "als auf auß das dem den der des die ein eine für im in ist mit nicht sich und von zu".split(),
    "en": "a and are as at be by for from he in is it of on that the this to was with".split(),
    "es": "al con de del el en es la las lo los no para por que se su un una y".split(),
    "fr": "au avec dans de des du elle en est et il la le les par pas pour que qui sur un une".split(),
}
MOST_LANGUAGES = 2000
HELD_LANGUAGES = 10_000
CLASSES = ("lower", "upper", "letter_beyond_ascii", "digit", "space", "stop", "symbol")
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Limits; the defaults are the production values."""

    min_words: int = 10
    repeat_percent: int = 20
    char_limit: float = 0.30
    char_min: int = 250
    word_limit: float = 0.45
    word_min: int = 60
    both_char: float = 0.145
    both_word: float = 0.25
    both_min: int = 100
    min_documents: int = 10


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(CLASSES)))
    for byte in range(256):
        if 0x80 <= byte < 0xC0:
            continue  # continuation bytes are part of the code point before
        char = chr(byte)
        kind = (
            "letter_beyond_ascii" if byte >= 0xC0 else "lower" if char.islower() else "upper" if char.isupper()
            else "digit" if char.isdigit() else "space" if byte in BLANKS else "stop" if char in ".,;:!?'\"()-" else "symbol"
        )
        table[byte, CLASSES.index(kind)] = 1
    return table


CLASS_TABLE = _class_table()
_POINTS = np.array([not 0x80 <= b < 0xC0 for b in range(256)])
_PLAIN = bytes(b if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 0x20 for b in range(256))


def histograms(data: bytes, key: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Byte counts, character-class counts, common-word counts (the last cell is all other words) and number of words."""
    counted = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.lower().translate(_PLAIN).split()
    if key not in COMMON_WORDS:
        return counted, counted @ CLASS_TABLE, np.zeros(0), len(words)
    seen = Counter(words)
    common = [seen.get(w.encode(), 0) for w in COMMON_WORDS[key]]
    return counted, counted @ CLASS_TABLE, np.array([*common, len(words) - sum(common)], dtype=float), len(words)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms; 0 when one is empty."""
    if not len(p) or not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def part(x):
        some = x > 0
        return float((x[some] * np.log2(x[some] / m[some])).sum())

    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def reference_histograms(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, chars, words): the references of every language of ``docs``, written down; null where too few documents measure."""
    bounded_batches(docs)
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])

    def rows_of(held: dict) -> pa.RecordBatch:
        rows = [(*key, n, total.tolist()) for key, (n, total) in held.items()]
        return arrow_rows(schema, {f: [r[i] for r in rows] for i, f in enumerate(schema.names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                for value, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    _, chars, words, n_words = histograms((value or "").encode(), key)
                    for kind, found, enough in (("c", chars, chars.sum() >= rules.char_min), ("w", words, n_words >= rules.word_min)):
                        if enough and len(found) and found.sum():
                            n, total = held.get((key, kind), (0, 0))
                            held[key, kind] = n + 1, total + found / found.sum()
                if len(held) > HELD_LANGUAGES:
                    yield rows_of(held)
                    held = {}
        yield rows_of(held)

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = rows.mapInArrow(run, "lang string, kind string, n bigint, total array<double>")
    cells = parts.select("lang", "kind", "n", F.posexplode("total").alias("cell", "value"))
    # sums differ in the last bits between runs
    sums = cells.groupBy("lang", "kind", "cell").agg(F.round(F.sum("value"), 6).alias("value"), F.sum("n").alias("n")).where(F.col("n") >= rules.min_documents)
    kind = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("cell", "value")))), lambda c: c["value"])  # at most some 25 cells
    return stage(sums.groupBy("lang").agg(kind("c").alias("chars"), kind("w").alias("words")), "language_references")


def repeated_words(words: list) -> int:
    """Words inside 5-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    if len(ids) == n:
        return 0
    window = code[: n - WINDOW + 1]
    span = len(ids)
    for i in range(1, WINDOW):
        nxt = code[i : n - WINDOW + 1 + i]
        if span * len(ids) >= 1 << 62:
            _, window = np.unique(window, return_inverse=True)
            span = int(window.max()) + 1
        window, span = window * len(ids) + nxt, span * len(ids)
    ordered = np.sort(window)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    hits = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[inverse] > 1)
    np.add.at(hits, starts, 1)
    np.add.at(hits, starts + WINDOW, -1)
    return int((np.cumsum(hits) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    seen: set = set()
    repeats = 0
    for line in text.split(b"\n"):
        if line.strip(BLANKS):
            repeats += line in seen
            seen.add(line)
    return repeats


MEASURES = T.StructType([
    T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
] + [T.StructField("base_failed", T.BooleanType()), T.StructField("char_distance", T.DoubleType()),
     T.StructField("word_distance", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def measure(value: str | None, lang: str | None, reference: tuple | None, rules: Rules) -> tuple:
    """The measures of one text, in the order of :data:`MEASURES`; ``reference`` holds its language's character and word histograms."""
    data = (value or "").encode()
    counted, chars, common, n_plain = histograms(data, lang)
    words = data.split()
    n, repeats = len(words), repeated_words(words)
    points = int(counted[_POINTS].sum())
    failed = n < rules.min_words or 100 * repeats > rules.repeat_percent * n
    ref_chars, ref_words = (np.array(r if r is not None else ()) for r in reference or (None, None))
    by_char = js_distance(chars, ref_chars) if points >= rules.char_min and len(ref_chars) else None
    by_word = js_distance(common, ref_words) if n_plain >= rules.word_min and len(ref_words) else None
    both = n_plain >= rules.both_min and (by_char or 0) > rules.both_char and (by_word or 0) > rules.both_word
    strange = (by_char or 0) > rules.char_limit or (by_word or 0) > rules.word_limit or both
    return (
        n, points - int(counted[list(BLANKS)].sum()), int(counted[list(SYMBOLS)].sum()), duplicate_lines(data), repeats,
        failed, by_char, by_word, not failed and not strange,
    )


def judge(
    docs: DataFrame, rules: Rules = Rules(), keep: list[str] | None = None, text: str = "text", lang: str = "lang",
    only_kept: bool = False,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with the measures; ``only_kept`` returns kept rows without measures."""
    stored = reference_histograms(docs, rules, text, lang)
    few = stored.count() <= MOST_LANGUAGES
    references = {r["lang"]: (np.array(r["chars"]), np.array(r["words"])) for r in stored.collect()} if few else {}
    names = MEASURES.fieldNames()
    columns = [c for c in (docs.columns if keep is None else keep) if only_kept or c not in names]
    inputs = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)], F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    if not few:
        inputs = inputs.join(stored, "lang", "left").select(*(f"k{i}" for i in range(len(columns))), "text", "lang", "chars", "words")
    kinds = [docs.schema[c].dataType for c in columns]
    schema = T.StructType([T.StructField(f"k{i}", k) for i, k in enumerate(kinds)] + ([] if only_kept else list(MEASURES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                cell = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()
                texts, langs = cell("text"), cell("lang")
                own = [references.get(g) for g in langs] if few else zip(cell("chars"), cell("words"))
                found = [measure(t, g, r, rules) for t, g, r in zip(texts, langs, own)]
                held = pa.RecordBatch.from_arrays(part.columns[: len(columns)], schema=pa.schema([part.schema.field(i) for i in range(len(columns))]))
                if only_kept:
                    yield held.filter(pa.array([f[-1] for f in found], type=pa.bool_()))
                    continue
                types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
                cells = [pa.array([f[i] for f in found], type=kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*held.columns, *cells], names=[*held.schema.names, *names])

    out = inputs.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)], *([] if only_kept else names))
