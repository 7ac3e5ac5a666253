"""Periodic runs of words: stretches that repeat one block again and again, and texts without the repeats.

A run with period q and length of at least ``power`` times q holds each of its words ``power`` times or more. So a word
that occurs more rarely than that within a segment of a text is in none of the segment's runs, and splits it; inside
the parts words are rarer again, so the parts are split further until nothing changes (recursive frequency splitting).
Prose mostly falls apart into parts that are too short for any run. The parts that survive are scanned lag by lag: a
run with period q covers a multiple i of q with i + 3q still inside, so only multiples of q have to be looked at, and
of those only such whose words agree one, two and three periods on. What agrees is extended word by word to the run.

A text is worked on alone and as a whole, with memory and (but for texts made to defeat it) time near linear in its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.words import frugal, sliced, small_batches

#: At most so many pairs of a place and a lag are looked at at once.
PAIRS_AT_ONCE = 2_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """For each word the place where it occurs first, so that equal words have equal numbers."""
    return np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))


def segments(w: np.ndarray, power: int, shortest: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of ``w`` in which each word occurs ``power`` times or more; all runs are inside them."""
    found, n = [], len(w)
    if n < shortest:
        return found
    common = np.bincount(w, minlength=n)[w] >= power
    at, of = np.arange(n), np.zeros(n, np.int64)
    while True:
        if not common.any():
            return found
        first = np.flatnonzero(np.diff(of, prepend=-1))
        whole = np.logical_and.reduceat(common, first)
        for k in np.flatnonzero(whole):  # segments that lose no word
            found.append((int(at[first[k]]), int(at[first[k + 1] - 1] if k + 1 < len(first) else at[-1]) + 1))
        at = at[common & ~np.repeat(whole, np.diff(first, append=len(at)))]
        if not len(at):
            return found
        starts = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
        lengths = np.diff(starts, append=len(at))
        long = lengths >= shortest
        at, of = at[np.repeat(long, lengths)], np.repeat(np.arange(long.sum()), lengths[long])
        if not len(at):
            return found
        _, each, times = np.unique(of * n + w[at], return_inverse=True, return_counts=True)
        common = times[each] >= power


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many words of x and y agree from their start on."""
    n, done, step = min(len(x), len(y)), 0, 32
    while done < n:
        end = min(n, done + step)
        other = x[done:end] != y[done:end]
        if other.any():
            return done + int(other.argmax())
        done, step = end, step * 2
    return n


def _lags(m: int, power: int) -> Iterator[tuple[int, int]]:
    """Ranges of lags, each less than the double of its first, so that none holds a lag and its multiple."""
    low = 1
    while low <= m // power:
        most = max(1, PAIRS_AT_ONCE * low // m)
        high = min(2 * low, low + most, m // power + 1)
        yield low, high
        low = high


def scan(w: np.ndarray, power: int, shortest: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one segment. ``power`` is 4 or more."""
    m, found = len(w), set()
    covered = np.zeros(m, np.int64)  # where the longest run that holds a place ends
    for low, high in _lags(m, power):
        lag = np.arange(low, high)
        places = np.maximum(0, (m - 1) // lag - 2)  # multiples i of the lag with i + 3 lags inside
        q = np.repeat(lag, places)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(places) - places, places)) * q
        here = w[i]
        near = (here == w[i + q]) & (here == w[i + 2 * q]) & (here == w[i + 3 * q])
        i, q = i[near], q[near]
        half = i + q // 2
        near = (w[half] == w[half + q]) & (w[half] == w[half + 2 * q]) & (covered[i] < i + 2 * q)
        i, q = i[near], q[near]
        k = 0
        while k < len(i):
            at, period = int(i[k]), int(q[k])
            k += 1
            # Two periods inside a run found before: it is the same run, or one whose smallest period is smaller.
            if covered[at] >= at + 2 * period:
                continue
            end = at + period + _agree(w[at:], w[at + period :])
            if end < at + 2 * period:
                continue
            start = at - _agree(w[:at][::-1], w[period : at + period][::-1])
            if end - start >= max(shortest, power * period):
                found.add((start, end - start, period))
                np.maximum(covered[start:end], end, out=covered[start:end])
                # on to the first place whose two periods are not inside
                stop = int(np.searchsorted(q, period, "right"))
                k = max(k, k + int(np.searchsorted(i[k:stop], end - 2 * period, "right")))
    return list(found)


def runs_of(words: list[bytes], power: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text's words, by start and period."""
    w = numbered(words)
    return sorted(
        ((s + start, length, period) for s, e in segments(w, power, shortest) for start, length, period in scan(w[s:e], power, shortest)), key=lambda r: (r[0], r[2])
    )


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(stays)]


def periodic_runs(docs: DataFrame, power: int = 4, shortest: int = 6) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, runs, collapsed.

    Words are what ASCII white space separates. A run is a stretch of words with smallest period q (words q apart are
    identical) and length >= max(shortest, power * q) that no neighbouring word extends; ``power`` is at least 4. runs
    has all of them, by start and period; runs may overlap. collapsed has the words that no run holds after its first
    period, joined by a space: the text itself, with single spaces, where there is no run. A null or empty text has no
    words, no runs and an empty collapsed text. Rows that repeat, or share a doc_id, are answered each for itself; an
    empty table gives an empty result; other columns are ignored, and doc_id may be null and of any type.
    """
    if power < 4:
        raise ValueError("power must be at least 4")
    small_batches(docs.sparkSession)
    only = docs.select("doc_id", "text")
    kind = only.schema["doc_id"].dataType.simpleString()

    @frugal
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n, runs, texts = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                got = runs_of(words, power, shortest)
                n.append(len(words))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in got])
                texts.append(b" ".join(collapsed(words, got)).decode())
            of = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, of), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return only.mapInArrow(find, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where, of every tenth document by crc32 of its doc_id, the tail repeats one block."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", F.when((h % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]"), words).alias("__words"), F.floor(h / 10).alias("__g"))
    a = F.expr("__g % size(__words)")
    some = some.withColumn("__a", a).withColumn("__p", F.expr("1 + (size(__words) - __a) div (3 + __g % 8)"))
    again = F.expr("transform(__words, (x, i) -> if(i < __a, x, __words[int(__a + (i - __a) % __p)]))")
    return some.select("doc_id", F.when(F.col("__words").isNull(), F.col("text")).otherwise(F.array_join(again, " ")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest, and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("__best")
    return found.withColumn("__best", F.when(F.size("runs") > 0, longest)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.expr("1000 * __best.length div -__best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
