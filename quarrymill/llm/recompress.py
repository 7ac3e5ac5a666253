"""Substring dedup by recompression.

Each document's word sequence is rewritten in rounds: runs of one symbol become a symbol, then adjacent pairs whose
left member falls into the left half of the alphabet and whose right member into the right half become a symbol. A
new symbol's name is a 64-bit hash of what it stands for, so that all documents use the same names without a table of
them, and which half a symbol falls into is a bit of its name. Equal substrings are therefore rewritten equally but
for a few symbols at either end: whether a border between two symbols is there depends on the words of a known
interval around it.

That makes pairs of neighbouring symbols anchors. In a window of 20 words, the pairs whose interval lies inside the
window are the same wherever the window's words occur, and so is the one of least name among them (a window without
any, as in long runs, is its own anchor). The names of anchors, one for some seven windows, are counted over all
documents; only windows whose anchor occurs in different texts are revealed as possible repeats. These are verified by
a 96-bit fingerprint of their 20 words, whose earliest place in the corpus is found by one aggregation, and every
other place of it is a repeat. Repeats within a document, and copies of whole word sequences, are settled without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.words import M1, M2, M3, frugal, mix, word_hash
from quarrymill.session import Scratch

#: Up to so many doc_ids are broadcast to pick the texts that are looked at again; more are joined by a shuffle.
BROADCAST_IDS = 500_000


class _Powers:
    """Powers of two odd bases and their inverses, as many as the longest text so far needs."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int):
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            self.up, self.down = [], []
            for base in (int(M1), int(M3)):
                for out, b in ((self.up, base), (self.down, pow(base, -1, 1 << 64))):
                    p = np.full(self.n, b, np.uint64)
                    p[0] = 1
                    out.append(np.cumprod(p))
        return self


def spans(h: np.ndarray, which: int, lo: np.ndarray, hi: np.ndarray, powers: _Powers) -> np.ndarray:
    """A fingerprint of the entries lo to hi of h, for each lo and hi."""
    powers.upto(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers.up[which][: len(h)])])
    return mix((sums[hi] - sums[lo]) * powers.down[which][lo] + (hi - lo).astype(np.uint64))


def recompress(h: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols of h after some rounds; the places of their borders; and for each border the interval of
    words that its being there depends on. Borders at the ends of a text depend on more than its words."""
    n = len(h)
    name, at = h, np.arange(n + 1)
    lo, hi = at.copy(), at.copy()

    def divide(stays: np.ndarray) -> np.ndarray:
        nonlocal at, lo, hi
        wide_lo, wide_hi = np.concatenate([[-1], lo[:-1]]), np.concatenate([hi[1:], [n + 1]])
        k = np.flatnonzero(np.concatenate([[True], stays, [True]]))
        at, lo, hi = at[k], wide_lo[k], wide_hi[k]
        return k

    for r in range(rounds):
        k = divide(name[1:] != name[:-1])
        name = mix(name[k[:-1]] * M2 + np.diff(k).astype(np.uint64))
        left = (mix(name + np.uint64(r)) & np.uint64(1)).astype(bool)
        k = divide(~(left[:-1] & ~left[1:]))
        first, pair = name[k[:-1]], np.diff(k) == 2
        second = name[np.minimum(k[:-1] + 1, len(name) - 1)]
        name = np.where(pair, mix(mix(first) * M1 + second), first)
    return name, at, lo, hi


def anchors(h: np.ndarray, window: int, rounds: int, powers: _Powers) -> np.ndarray:
    """For each window of h, the name of its anchor."""
    starts = np.arange(len(h) - window + 1)
    name, at, lo, hi = recompress(h, rounds)
    # The pair of symbols around each inner border.
    lo, hi = lo[:-2], hi[2:]
    inside = (lo >= 0) & (hi <= len(h))
    i = np.flatnonzero(inside)
    lo, hi = lo[i], hi[i]
    own = spans(h, 0, starts, starts + window, powers) | np.uint64(1)
    if not len(i):
        return own
    key = mix(name[i] * M3 + name[i + 1]) ^ spans(h, 1, lo, hi, powers)
    first, last = np.searchsorted(lo, starts, "left"), np.searchsorted(hi, starts + window, "right")
    width = last - first
    # Least name in each range of pairs, the leftmost of equal ones, by a table of minima over powers of two.
    packed = (key >> np.uint64(32) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
    table = [packed]
    while 2 << (len(table) - 1) <= max(1, width.max()):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    out = own.copy()
    for level, mins in enumerate(table):
        w = np.flatnonzero((width >= 1 << level) & (width < 2 << level))
        best = np.minimum(mins[first[w]], mins[last[w] - (1 << level)])
        out[w] = key[(best & np.uint64(0xFFFFFFFF)).astype(np.int64)] & ~np.uint64(1)
    return out


def _fresh(prints: np.ndarray) -> np.ndarray:
    """Which entries aren't repeats of an earlier entry."""
    out = np.zeros(len(prints), bool)
    out[np.unique(prints, return_index=True)[1]] = True
    return out


def _covered(repeat: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that is marked."""
    edges = np.zeros(n + 1, np.int64)
    w = np.flatnonzero(repeat)
    edges[w] += 1
    edges[w + window] -= 1
    return np.cumsum(edges[:-1]) > 0


def _kept(words: list[bytes], covered: np.ndarray) -> str:
    return sha256(b" ".join(words[i] for i in np.flatnonzero(~covered)) if covered.any() else b" ".join(words)).hexdigest()


class _Doc:
    """The words and windows of one text."""

    def __init__(self, text: str | None, window: int, powers: _Powers):
        self.words = (text or "").encode().split()
        # A third of the words are rare ones, so to hash them all takes less than to look them up.
        self.h = np.fromiter(map(word_hash, self.words), np.uint64, len(self.words))
        self.window, self.n = window, len(self.words)
        self.starts = np.arange(max(0, self.n - window + 1))
        self.prints = spans(self.h, 0, self.starts, self.starts + window, powers) if len(self.starts) else np.zeros(0, np.uint64)
        self.fresh = _fresh(self.prints)


FIRST = "doc_id long, sequence binary, n_words long, n_removed long, kept_sha256 string, anchors array<long>"


def _first_pass(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch, rows, names = whole.slice(start, 1000), [], []
                for text in batch.column("text").to_pylist():
                    d = _Doc(text, window, powers)
                    covered = _covered(~d.fresh, d.n, window)
                    rows.append((blake2b(d.h.tobytes(), digest_size=16).digest(), d.n, int(covered.sum()), _kept(d.words, covered)))
                    names.append(np.unique(anchors(d.h, window, rounds, powers)[d.fresh]) if len(d.starts) else np.zeros(0, np.uint64))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(names).view(np.int64) if names else np.zeros(0, np.int64)))
                a, b, c, d_ = zip(*rows) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d_, pa.string()), lists], ["doc_id", "sequence", "n_words", "n_removed", "kept_sha256", "anchors"])

    return run


def _possible(d: _Doc, shared: list[int], rounds: int, powers: _Powers) -> np.ndarray:
    """The windows, the first of equal ones in the document, whose anchor other texts have."""
    names = np.sort(np.array(shared, np.int64).view(np.uint64))
    own = anchors(d.h, d.window, rounds, powers)
    return d.fresh & (names[np.minimum(np.searchsorted(names, own), len(names) - 1)] == own)


#: ``repeat`` has a bit for each window that goes unless it turns out to be the first of its words.
MARKED = "doc_id long, text string, repeat binary, f1 array<long>, f2 array<int>, start array<int>"


def _marked(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch, repeats, out = whole.slice(start, 200), [], [[], [], []]
                for text, shared in zip(*(batch.column(c).to_pylist() for c in ("text", "shared"))):
                    d = _Doc(text, window, powers)
                    possible = _possible(d, shared, rounds, powers)
                    at = np.flatnonzero(possible)
                    second = spans(mix(d.h), 1, at, at + window, powers) >> np.uint64(32)
                    repeats.append(np.packbits(~d.fresh | possible).tobytes())
                    for column, x in zip(out, (d.prints[at].view(np.int64), second.astype(np.uint32).view(np.int32), at.astype(np.int32))):
                        column.append(x)
                if repeats:
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out[0]])]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in out]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(repeats, pa.binary()), *lists], ["doc_id", "text", "repeat", "f1", "f2", "start"])

    return run


def _last_pass(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch, removed, kept, n = whole.slice(start, 1000), [], [], []
                for text, bits, firsts in zip(*(batch.column(c).to_pylist() for c in ("text", "repeat", "firsts"))):
                    words = (text or "").encode().split()
                    repeat = np.unpackbits(np.frombuffer(bits, np.uint8), count=max(0, len(words) - window + 1)).astype(bool)
                    # Another text of the doc_id may have more windows.
                    firsts = np.array(firsts or [], np.int64)
                    repeat[firsts[firsts < len(repeat)]] = False
                    covered = _covered(repeat, len(words), window)
                    removed.append(int(covered.sum()))
                    kept.append(_kept(words, covered))
                    n.append(len(words))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, window: int = 20, rounds: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    Words are what ASCII white space divides. A word goes if a window of ``window`` words that covers it also starts
    earlier: in a document of smaller doc_id, or earlier in the same one. A null text has no words. Rows that repeat a
    doc_id and its text are the same document and get equal answers; of several texts under one doc_id, only repeats
    within each are found beside those of other doc_ids. A row with a null doc_id is compared with itself alone. Other
    columns are ignored, and an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = scratch.table(docs.mapInArrow(frugal(_first_pass(window, rounds)), FIRST), "first")
    able = first.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    texts = able.groupBy("sequence").agg(F.min("doc_id").alias("rep"))

    # Anchors that different texts have. A text counts once however many documents are copies of it.
    posted = able.select("doc_id", F.xxhash64("sequence").alias("t"), F.explode("anchors").alias("anchor"))
    shared = posted.groupBy("anchor").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("anchor")
    hits = posted.select("doc_id", "anchor").join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    hits = scratch.table(hits.join(texts.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "hits")
    n = hits.count()

    small = first.drop("anchors")
    rep = F.col("rep")
    copy = rep.isNotNull() & (F.col("doc_id") != rep)
    whole = F.sha2(F.lit(""), 256)
    out = small.join(texts, "sequence", "left").select(
        "doc_id", "n_words", F.when(F.col("n_words") >= window, F.when(copy, F.col("n_words"))).alias("all"), "n_removed", "kept_sha256"
    )
    out = out.select("doc_id", "n_words", F.coalesce("all", "n_removed").alias("n_removed"), F.when(F.col("all").isNotNull(), whole).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
    if not n:
        return out
    ids = hits.select("doc_id")
    again = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id")
    # Written with what is told of a text's windows, so that anchors are looked for once here and not with each reading.
    again = scratch.table(again.join(hits, "doc_id").mapInArrow(frugal(_marked(window, rounds)), MARKED), "again")
    places = again.select("doc_id", F.inline(F.arrays_zip("f1", "f2", "start")))
    firsts = places.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.min_by("start", "doc_id").alias("start"))
    firsts = scratch.table(firsts.groupBy("doc_id").agg(F.collect_list("start").alias("firsts")), "firsts")
    done = again.select("doc_id", "text", "repeat").join(firsts, "doc_id", "left").mapInArrow(frugal(_last_pass(window)), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    rest = out.join(ids, "doc_id", "left_anti")
    return rest.unionByName(done)
