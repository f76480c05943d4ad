"""Periodic runs of words by recursive frequency splitting, and texts without them.

A run of period q is a stretch of consecutive words in which words q apart are
identical, that no neighbouring word extends, and whose smallest period is q; it
qualifies with ``max(min_length, min_repeats * q)`` words.

*Splitting.*  A word of a qualifying run of period q stands in it once per period,
so at least ``min_repeats`` times.  A word that occurs fewer times within its
segment (at first: the text) is in no qualifying run of it and splits it; parts
shorter than ``min_length`` go; the words of what is left are counted again, part
by part, until no part changes.  Common prose is gone after few rounds.

*Lag scan.*  In what survives, for window widths k = 1, 2, 4, ..., the lag from
every word to the next equal k-word window of its segment is found by sorting.  A
run of period q with k/2 < q <= k shows as a stretch of positions of lag q, from
its first word to the last whose window has an equal one q later; its smallest
period is q as the next equal window is nearest.  Windows that occur once drop out
before the next width.  This finds every run that a scan of all lags finds, in time
n log^2 n instead of n^2.  The scan is exact on any segment, so a splitting that
goes on for ``MAX_ROUNDS`` rounds (a text made for it) is ended without loss.

A text is one cell and one task's work, and no row meets another: the job has no
shuffle, and lost tasks are run again.  Texts are taken 2 MB at a time.

Defined results: a null or empty text has no words, no run and an empty collapsed
text; repeated rows are results of their own; extra columns stay, but one that
bears a result's name is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import SPACE, beside, runs

MIN_LENGTH = 24
MIN_REPEATS = 3
MAX_ROUNDS = 1000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def survivors(word: np.ndarray, segment: np.ndarray, min_length: int, min_repeats: int):
    """(positions, segments) of the words that splitting leaves; segments are
    numbered in order, words are integers, equal for equal words."""
    at, seg = np.arange(len(word)), segment
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for turn in range(MAX_ROUNDS):
        at, seg = _long_enough(at, seg, min_length)
        if not len(at):
            break
        _, inverse, count = np.unique(seg * (int(word.max()) + 1) + word[at], return_inverse=True, return_counts=True)
        frequent = count[inverse] >= min_repeats
        changed = np.zeros(int(seg[-1]) + 1, dtype=bool)
        changed[seg[~frequent]] = True
        stable = ~changed[seg] if turn < MAX_ROUNDS - 1 else np.ones(len(at), dtype=bool)
        kept.append((at[stable], seg[stable]))
        go_on = frequent & ~stable
        at, seg = at[go_on], seg[go_on]
    if not kept:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.concatenate([a for a, _ in kept])
    # parts of different rounds never touch: the word between them was split off
    at.sort()
    return at, _numbered(at, segment[at])


def _numbered(at: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """New segment numbers: a gap in the positions or a change of segment starts one."""
    if not len(at):
        return at
    return np.cumsum(np.concatenate(([False], (np.diff(at) != 1) | (np.diff(seg) != 0))))


def _long_enough(at: np.ndarray, seg: np.ndarray, min_length: int):
    seg = _numbered(at, seg)
    keep = np.bincount(seg)[seg] >= min_length if len(seg) else np.zeros(0, dtype=bool)
    return at[keep], _numbered(at[keep], seg[keep])


def lag_scan(word: np.ndarray, seg: np.ndarray, min_length: int, min_repeats: int):
    """(first, length, period) arrays of the qualifying runs within the segments of
    ``word``; positions count from 0 over all of it."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = len(word)
    if n:
        _, rank = np.unique(seg * (int(word.max()) + 1) + word, return_inverse=True)
        active, width, longest = np.arange(n), 1, int(np.bincount(seg).max())
    while n and len(active) and (width // 2 + 1) * min_repeats <= longest:
        order = np.argsort(rank[active], kind="stable")
        place, same = active[order], np.diff(rank[active][order]) == 0
        lag = np.zeros(n, dtype=np.int64)
        lag[place[:-1][same]] = np.diff(place)[same]
        hits = active[(lag[active] > width // 2) & (lag[active] <= width)]
        if len(hits):
            breaks = np.flatnonzero((np.diff(hits) != 1) | (np.diff(lag[hits]) != 0) | (np.diff(seg[hits]) != 0))
            first, last = hits[np.concatenate(([0], breaks + 1))], hits[np.concatenate((breaks, [len(hits) - 1]))]
            period = lag[first]
            length = last - first + width + period
            good = length >= np.maximum(min_length, min_repeats * period)
            found.append((first[good], length[good], period[good]))
        # windows that occur twice, and the double windows made of two such
        repeated = np.zeros(len(order), dtype=bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        alive = np.zeros(n + width, dtype=bool)
        alive[place[repeated]] = True
        active = np.sort(place[repeated])
        active = active[alive[active + width]]
        active = active[seg[np.minimum(active + 2 * width - 1, n - 1)] == seg[active]]
        active = active[active + 2 * width <= n]
        pair = rank[active] * (int(rank.max()) + 1) + rank[active + width]
        _, doubled = np.unique(pair, return_inverse=True)
        rank = np.full(n, 0, dtype=np.int64)
        rank[active] = doubled
        width *= 2
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    first, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, first))
    return first[order], length[order], period[order]


def text_runs(texts: list[bytes], min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS):
    """Per text: (number of words, [(start, length, period)], collapsed text)."""
    numbers: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in split for w in ws), dtype=np.int64, count=total)
    text = np.repeat(np.arange(len(texts)), sizes)
    at, seg = survivors(word, text, min_length, min_repeats)
    first, length, period = lag_scan(word[at], seg, min_length, min_repeats)
    first = at[first]
    of_text = text[first]
    bounds = np.searchsorted(of_text, np.arange(len(texts) + 1))
    out = []
    for k, words in enumerate(split):
        a, b = bounds[k], bounds[k + 1]
        spans = list(zip((first[a:b] - begins[k]).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
        if spans:
            keep = np.ones(len(words), dtype=bool)
            for s, n, p in spans:
                keep[s + p:s + n] = False
            words = [words[i] for i in np.flatnonzero(keep)]
        out.append((int(sizes[k]), spans, b" ".join(words)))
    return out


def find(df: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """``df`` with n_words, runs (ordered by start, then period) and collapsed: the
    words without those that a run repeats after its first period, joined by one
    space."""
    import pyarrow as pa
    if min_repeats < 3 or min_length < min_repeats:
        raise ValueError("min_repeats must be at least 3 and min_length at least that")
    ship_package(df.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def step(packed: DataFrame) -> DataFrame:
        row = packed.schema["row"].dataType.simpleString()

        def found(batches):
            for batch in batches:
                for run in runs(batch, 1):
                    texts = [t or b"" for t in run.column(1).cast(pa.binary()).to_pylist()]
                    results = text_runs(texts, min_length, min_repeats)
                    yield pa.RecordBatch.from_arrays(
                        [run.column(0), pa.array([r[0] for r in results], pa.int64()),
                         pa.array([[dict(zip(("start", "length", "period"), s, strict=True)) for s in r[1]] for r in results], kind),
                         pa.array([r[2] for r in results], pa.binary()).cast(pa.string())],
                        ["row", "n_words", "runs", "collapsed"])

        return packed.mapInArrow(found, f"row {row}, n_words long, runs {RUNS}, collapsed string")
    return beside(df, text, step, ["n_words", "runs", "collapsed"])


def planted(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with a repeated tail put into the texts whose crc32(doc_id) divides by
    ten: from word a = g % n on, the text goes on with the p words from a, where
    g = crc32 div 10 and p = 1 + (n - a) div (3 + g % 8).  SQL functions only; rows
    without an id stay as they are."""
    source = F.col(f"`{text}`").cast("string")
    h = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))
    words = F.filter(F.split(source, SPACE), lambda w: w != F.lit(""))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # the repeated part is less than 3 + 7 periods long
    tail = F.flatten(F.array_repeat(F.slice(words, a.cast("int") + 1, p.cast("int")), 11))
    changed = F.concat_ws(" ", F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return df.withColumn(text, F.when((h % 10 == 0) & (n > 0), changed).otherwise(source))


def longest_exponent() -> Column:
    """The run of greatest length / period, compared exactly; the first of equals."""
    return F.expr(f"""aggregate(runs, CAST(NULL AS {RUNS[6:-1]}), (best, r) ->
        CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)""")


def digest(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``find``: counts, the run of greatest exponent and hashes."""
    d = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest_exponent().alias("best"),
                  F.expr("sha2(cast(concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))) AS binary), 256)")
                  .alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return d.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
