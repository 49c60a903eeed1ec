"""Periodic run detection: stretches of words that repeat themselves at once, by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q and length >= max(``min_length``, 2q) that no neighbouring word
extends keeping period q. All of them are found, of any period, over whole texts.

Method: periods below twice the first scale come from direct scans of each lag. For periods from 2k to 4k, the scale k takes k-word
windows and, of every k consecutive ones, the smallest hash. Inside a run these minima come back at the distance of the period,
so pairs of equal minimizers seed a lag; a seed is extended word by word to both sides and kept if no divisor of the lag is a
period too. Windows whose own period is at most k/2 (they lie in runs already found) are left out of the minima, so equal
windows lie more than k/2 apart and eight following ones cover all distances. The one kind of run without any other window
has its halves inside two touching runs of one short period; its lags follow from their phase and are extended too.

Scale: one pass over the scan, no shuffle. Texts are taken in slices of about two megabytes, whose words stand in one array
with a unique mark between texts; a text is never cut. The work is near n log n for a text of n words.

Defined cases: null or empty text has no words and no runs; rows with null or equal ids are judged row by row; all columns named in ``keep`` come
along; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import text_slices
from .line_dedup import BLANKS

MIN_LENGTH = 12
FIRST_SCALE = 16
U64 = W.U64
NONE = U64(0xFFFFFFFFFFFFFFFF)
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _agree(w: np.ndarray, i: int, j: int, limit: int) -> int:
    """How many words from i on equal those from j on, at most ``limit``."""
    done, step = 0, 64
    while done < limit:
        n = min(step, limit - done)
        same = w[i + done:i + done + n] == w[j + done:j + done + n]
        if not same.all():
            return done + int(same.argmin())
        done += n
        step *= 4
    return limit


def _agree_back(w: np.ndarray, i: int, j: int, limit: int) -> int:
    """How many words before i equal those before j."""
    done, step = 0, 64
    while done < limit:
        n = min(step, limit - done)
        same = (w[i - done - n:i - done] == w[j - done - n:j - done])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done += n
        step *= 4
    return limit


def _prime_factors(q: int) -> list[int]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return out + [q] if q > 1 else out


def _smallest(w: np.ndarray, start: int, end: int, q: int) -> bool:
    """No divisor of q is a period of the stretch; a smaller period of two or more turns of q would divide it."""
    for r in _prime_factors(q):
        d = q // r
        if _agree(w, start, start + d, end - start - d) == end - start - d:
            return False
    return True


def _direct(w: np.ndarray, q: int, least: int) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) with period q of at least max(least, 2q) words."""
    same = np.flatnonzero(w[q:] == w[:-q])
    if len(same):
        cuts = np.flatnonzero(np.diff(same) != 1)
        first, last = same[np.concatenate([[0], cuts + 1])], same[np.concatenate([cuts, [len(same) - 1]])]
        long = last - first + 1 >= max(least - q, q)
        yield from zip(first[long].tolist(), (last[long] + 1 + q).tolist())


def _sliding(v: np.ndarray, k: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every k consecutive values, by running extremes from both ends of blocks of k."""
    pick, fill = (np.minimum, NONE) if least else (np.maximum, U64(0))
    n = len(v) - k + 1
    padded = np.full(-(-len(v) // k) * k, fill)
    padded[:len(v)] = v
    ahead = pick.accumulate(padded.reshape(-1, k), axis=1).ravel()
    behind = pick.accumulate(padded.reshape(-1, k)[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[k - 1:k - 1 + n])


def _seeds(hashes: np.ndarray, k: int) -> np.ndarray:
    """Pairs (lag, place) of equal minimizers 2k to 4k apart."""
    floor = _sliding(hashes, k, True)
    edge = np.zeros(k - 1, U64)
    chosen = np.flatnonzero((_sliding(np.concatenate([edge, floor, edge]), k, False) == hashes) & (hashes != NONE))
    marks = hashes[chosen]
    order = np.argsort(marks, kind="stable")
    chosen, marks = chosen[order], marks[order]
    found = [np.empty((0, 2), np.int64)]
    for j in range(1, 9):
        lags = chosen[j:] - chosen[:-j]
        ok = (marks[j:] == marks[:-j]) & (lags >= 2 * k) & (lags < 4 * k)
        found.append(np.stack([lags[ok], chosen[:-j][ok]], 1))
    pairs = np.concatenate(found)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def _phase_seeds(w: np.ndarray, runs: list[tuple[int, int, int]], k: int) -> Iterator[tuple[int, int]]:
    """Pairs (lag, place) between touching runs of one period of at most k/2, both of 2k words or more."""
    some = sorted((q, s, e) for s, e, q in runs if 2 * q <= k and e - s >= 2 * k)
    for (q, s, e), (p, t, f) in zip(some, some[1:]):
        if p != q or t > e:
            continue
        shift = next((x for x in range(q) if np.array_equal(w[t + x:t + x + q], w[s:s + q])), None)
        if shift is None:
            continue
        base = t + shift - s
        for lag in range(2 * k + (base - 2 * k) % q, min(4 * k, f - s), q):
            place = max(s, t - lag)
            if place < e and place + lag < f:
                yield lag, place


def runs_of(w: np.ndarray, sizes: list[int], min_length: int = MIN_LENGTH, scale: int = FIRST_SCALE) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of an array of marks; ``sizes`` are the lengths of its texts, longest first, each followed by one mark of its own."""
    least, runs = min(min_length, scale), []
    longest = sizes[0] if sizes else 0
    for q in range(1, min(2 * scale, longest // 2 + 1)):
        runs += [(s, e, q) for s, e in _direct(w, q, least) if _smallest(w, s, e, q)]
    k = scale
    hashes = None
    while 4 * k <= longest:
        whole = int(sum(n + 1 for n in sizes if n >= 4 * k))  # shorter texts hold no period of this scale
        part = w[:whole]
        if hashes is None:
            hashes = W.window_marks(part, k)
        else:
            hashes = W.joined(hashes[:whole - k + 1], hashes[k // 2:whole - k + 1 + k // 2])
        inner = np.zeros(len(hashes) + 1, np.int64)
        for s, e, q in runs:
            if 2 * q <= k and e - s >= k and s < len(hashes):
                inner[s] += 1
                inner[min(e - k + 1, len(hashes))] -= 1
        open_hashes = np.where(np.cumsum(inner[:-1]) > 0, NONE, hashes)
        seeds = [tuple(x) for x in _seeds(open_hashes, k).tolist()] if len(hashes) >= k else []
        lag_now, covered = 0, -1
        for lag, place in sorted([*seeds, *_phase_seeds(part, runs, k)]):
            if lag != lag_now:
                lag_now, covered = lag, -1
            if place < covered:
                continue
            ahead = _agree(part, place, place + lag, whole - place - lag)
            if not ahead:
                continue
            back = _agree_back(part, place, place + lag, place)
            covered = place + ahead
            if ahead + back >= lag and _smallest(part, place - back, covered + lag, lag):
                runs.append((place - back, covered + lag, lag))
        k *= 2
    return [r for r in runs if r[1] - r[0] >= min_length]


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    cover = np.zeros(n + 1, np.int64)
    for start, end, q in runs:
        cover[start + q] += 1
        cover[end] -= 1
    return np.cumsum(cover[:-1]) == 0


def _texts(texts: list[bytes], min_length: int, scale: int) -> list[tuple[int, list[dict], str]]:
    marks = [W.marks(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(marks[i]))
    whole = np.concatenate([x for n, i in enumerate(order) for x in (marks[i], np.array([n], U64))])
    sizes = [len(marks[i]) for i in order]
    starts = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
    mine: list[list] = [[] for _ in texts]
    for start, end, q in sorted(runs_of(whole, sizes, min_length, scale)):
        at = int(np.searchsorted(starts, start, "right")) - 1
        mine[order[at]].append((start - int(starts[at]), end - int(starts[at]), q))
    out = []
    for text, m, runs in zip(texts, marks, mine):
        runs.sort(key=lambda r: (r[0], r[2]))
        words = text.split()
        if runs:
            words = [x for x, stays in zip(words, collapsed(len(m), runs).tolist()) if stays]
        out.append((len(m), [{"start": s, "length": e - s, "period": q} for s, e, q in runs], b" ".join(words).decode()))
    return out


def find(docs: DataFrame, keep: list[str] = ["doc_id"], text: str = "text", min_length: int = MIN_LENGTH, scale: int = FIRST_SCALE) -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, n_words, runs (by start, then period) and the collapsed text."""
    rows = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_words"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"n_words bigint, runs {RUNS}, collapsed string"])
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_words"):
                n, runs, rest = zip(*_texts([t.encode() for t in part.column(part.num_columns - 1).to_pylist()], min_length, scale))
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(runs, runs_type), pa.array(rest, pa.string())],
                                                 [*keep, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(work, schema)


def with_turns(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, where one id in ten has its words from some place on repeat themselves: h = crc32 of the id names which, from where and how often."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.split(F.trim("text", F.lit(BLANKS)), f"[{BLANKS}]+")
    turned = F.expr("""transform(_w, (x, i) -> CASE WHEN i < _a THEN x
        ELSE get(_w, CAST(_a + (i - _a) % (1 + (size(_w) - _a) div (3 + _g % 8)) AS INT)) END)""")
    rows = docs.select("doc_id", "text", h.alias("_h"), F.floor(h / 10).alias("_g"))
    some = F.coalesce((F.col("_h") % 10 == 0) & (F.length(F.trim("text", F.lit(BLANKS))) > 0), F.lit(False))
    rows = rows.withColumn("_w", F.when(some, words)).withColumn("_a", F.when(some, F.col("_g") % F.size("_w")))
    return rows.select("doc_id", F.when(some, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Per row: how many runs, the longest (then first, then of smallest period), and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("place"), (-r["period"]).alias("turn"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.place")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.turn")).alias("period"), F.expr("best.length * 1000 div -best.turn").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
