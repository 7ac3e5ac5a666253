"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, and what is left of a text is its template. Windows of template
tokens of documents and benchmark items meet in a hash join, which also finds questions asked again with other numbers
or names. Then slots are checked: within one alignment of a document and an item, each of the item's values must
stand for one value of the document. A document is contaminated by an item if consistent windows make up at least a
given share of the item's windows.

Numbers, and units after them, are told by themselves. A name is told by its capital letter, and a copy may have it in
another letter case, or a word of any kind there. So names are looked for in items alone: their places are left out of
the window's hash, and any word of a document may stand there. Documents are hashed once for each pattern of places that
the benchmark has (at most the ways to leave two of five places out). Adjacent names are one placeholder, as a name may
have any number of words; windows of documents with two or more adjacent words in capitals are looked at both ways. A
word in capitals that begins a sentence may be a name or not, so items post their windows both ways.

The windows of all documents aren't shuffled: the item windows' hashes, if they are few enough, go to every task, and
only windows that have one of them are joined, from documents that have as many as some item needs. With a larger
benchmark all windows are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.words import M2, M3, frugal, mix, sliced, small_batches, word_hash
from quarrymill.session import Scratch

#: Units of measure that count as a unit after a number. Fixed values.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees meter meters metre "
    "metres kilometer kilometers kilometre kilometres mph kmh km/h w kw j kj v a hz °c °f % $ €".split()
)
NUMERAL = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*(%|[a-z°]{1,4})?$", re.I)
EDGE = "\"'`.,;:!?()[]{}<>|*#$&%“”‘’«»¿¡…-–—_=+/\\~^"


@dataclass(frozen=True)
class Settings:
    window: int = 5
    #: Windows with fewer plain words than this aren't a template; their values themselves must agree.
    plain: int = 3
    #: Contaminated from this share of an item's windows on.
    share: float = 0.5
    #: Share of an alignment's values that may stand for several.
    conflicts: float = 0.1
    #: Up to so many item windows are sent to every task (8 bytes each).
    broadcast_windows: int = 2_000_000


PLAIN, NUMBER, UNIT, NOTHING = range(4)
UNIT_LIST = pa.array(sorted(UNITS))
BARE = EDGE.translate(str.maketrans("", "", "$%-+"))
CLOSING = "\"')]}”’»"


def properties(token: pa.Array) -> tuple[np.ndarray, ...]:
    """Of distinct tokens: hash, kind, whether in title case, whether a sentence ends with it."""
    word = pc.utf8_trim(token, EDGE)
    # Of % or $ alone nothing is left, but it may be a unit.
    word = pc.if_else(pc.and_(pc.equal(word, ""), pc.is_in(token, UNIT_LIST)), token, word)
    low = pc.utf8_lower(word)
    kind = np.where(pc.equal(low, ""), NOTHING, np.where(pc.is_in(low, UNIT_LIST), UNIT, PLAIN)).astype(np.int8)
    for k in np.flatnonzero(pc.match_substring_regex(token, r"\pN")):
        if NUMERAL.match(token[k].as_py().strip(BARE)):
            kind[k] = NUMBER
    title = pc.and_(pc.not_equal(word, low), pc.equal(pc.utf8_slice_codeunits(word, 1), pc.utf8_slice_codeunits(low, 1)))
    ends = pc.match_substring_regex(pc.utf8_rtrim(token, CLOSING), r"[.!?:…|]$")
    hashes = np.fromiter(map(word_hash, low.cast(pa.binary()).to_pylist()), np.uint64, len(token))
    return hashes, kind, np.asarray(title, bool), np.asarray(ends, bool)


NUM, UNI = (np.uint64(x) for x in (0x6E756D0000000001, 0x756E690000000005))


class Texts:
    """The words of some texts that aren't mere punctuation, one text after the other, and how they make template tokens."""

    def __init__(self, texts: pa.Array):
        split = pc.utf8_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        text, ids = np.repeat(np.arange(len(texts)), sizes), words.indices.to_numpy(zero_copy_only=False)
        self.distinct = words.dictionary
        hashes, *columns = properties(self.distinct)
        kind, title, ends = (c[ids] for c in columns)
        first = np.ones(len(ids), bool)
        first[1:] = text[1:] != text[:-1]
        begins = first.copy()
        begins[1:] |= ends[:-1]
        unit = kind == UNIT
        unit[1:] &= kind[:-1] == NUMBER
        unit &= ~first
        real = np.flatnonzero(kind != NOTHING)
        self.ids, self.text = ids[real], text[real]
        number, unit = (kind == NUMBER)[real], unit[real]
        self.valued, self.name = number | unit, title[real] & ~number & ~unit
        self.begins, self.h = begins[real], hashes[self.ids]
        self.t = np.where(number, NUM, np.where(unit, UNI, self.h))
        self.size = np.bincount(self.text, minlength=len(texts))
        # The first word of each template token, and the token of each word.
        more = self.name.copy()
        more[:1] = False
        more[1:] &= self.name[:-1] & ~self.begins[1:] & (self.text[1:] == self.text[:-1])
        self.first = np.flatnonzero(~more)
        self.token = np.cumsum(~more) - 1
        self.stop = np.append(self.first[1:], len(real))

    def word(self, k: int) -> str:
        return self.distinct[self.ids[k]].as_py().strip(EDGE)

    def slots(self, at: int, n: int, mask: int, runs: bool) -> list[str | None]:
        """The values in a window: of words from word ``at`` on, or of template tokens from token ``at`` on. That of a run is
        its last word, since the first may be no part of the name where a sentence begins. It is null, and not compared, where
        the run may be cut: at either end of a window, and in windows of words."""
        out = []
        for k in range(at, at + n):
            token = k if runs else self.token[k]
            if mask >> (k - at) & 1 or self.valued[self.first[k] if runs else k]:
                cut = (not runs or k in (at, at + n - 1)) and self.stop[token] - self.first[token] > 1
                out.append(None if cut else self.word(self.stop[k] - 1 if runs else k))
        return out


#: The mask of windows whose words themselves must agree.
LITERAL = -1


def _salt(n: int, mask: int) -> np.uint64:
    return mix(np.array([n * 1000 + mask + 2], np.uint64))[0]


def _places(column: np.ndarray, n: int) -> list[np.ndarray]:
    """Hashes of each entry for each place that it may have in a window."""
    return [mix(column * M3 + np.uint64((k + 1) * int(M2) % 2**64)) for k in range(n)]


def _windows(places: list[np.ndarray], at: np.ndarray | None, n: int, mask: int) -> np.ndarray:
    """The hashes of the windows of n entries at ``at`` (at each entry, if that is None), without the places in the mask."""
    count = len(places[0]) - n + 1 if at is None else len(at)
    out = np.full(max(0, count), _salt(n, mask), np.uint64)
    for k in range(n):
        if mask == LITERAL or not mask >> k & 1:
            out += places[k][k : k + count] if at is None else places[k][at + k]
    return out


#: Columns of windows beside the key. mask: the places left out. window: the window of the item that is meant.
POSTED = "item_id long, hash long, n int, mask int, at int, word int, window long, slots array<string>"
FOUND = "doc_id long, hash long, at int, word int, slots array<string>"


def postings(texts: Texts, k: int, s: Settings) -> list[tuple]:
    """What the k-th text, an item, posts: hash, n, mask, place among template tokens, place among words, window, slots."""
    begin, size = int(np.searchsorted(texts.text, k)), int(texts.size[k])
    if not size:
        return []
    n, words = min(s.window, size), np.arange(begin, begin + size)
    least = min(s.plain, n)
    first = texts.first[(texts.first >= begin) & (texts.first < begin + size)]
    runs = len(first) >= n
    first = first if runs else words
    stop = np.append(first[1:], begin + size)
    by_word, by_value = _places(texts.t[words], n), _places(texts.h[words], n)
    by_token = _places(texts.t[first], n)
    name, valued, begins = texts.name[words], texts.valued[words], texts.begins[words]
    out = []
    for a in range(len(first) - n + 1):
        # All of a window's words tell which window it is, wherever it stands.
        span = texts.h[first[a] : stop[a + n - 1]]
        window = int(_windows(_places(span, len(span)), np.zeros(1, np.int64), len(span), LITERAL)[0])
        heads = first[a : a + n] - begin
        mask = sum(1 << j for j in range(n) if name[heads[j]])
        if n - int(name[heads].sum()) - int(valued[heads].sum()) >= least:
            found = _windows(by_token, np.array([a]), n, mask)[0]
            out.append((int(found), n, mask, a, int(heads[0]), window, texts.slots(int(texts.token[first[a]]), n, mask, True) if runs else texts.slots(int(first[a]), n, mask, False)))
        for w in range(int(heads[0]), min(int(stop[a]) - begin, size - n + 1)):
            own, here = slice(w, w + n), np.array([w])
            masks = set()
            for slot in (name[own], name[own] & ~begins[own]):
                if n - int(slot.sum()) - int(valued[own].sum()) >= least:
                    masks.add(sum(1 << j for j in range(n) if slot[j]))
            for mask in sorted(masks):
                out.append((int(_windows(by_word, here, n, mask)[0]), n, mask, a, w, window, texts.slots(begin + w, n, mask, False)))
            if not masks:
                out.append((int(_windows(by_value, here, n, LITERAL)[0]), n, LITERAL, a, w, window, []))
    return out


def _posted(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 200_000):
            texts = Texts(batch.column("text"))
            rows = [(key, *row) for k, key in enumerate(batch.column("item_id").to_pylist()) for row in postings(texts, k, s)]
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            for c in (1, 6):
                columns[c] = np.array(columns[c], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["item_id", "hash", "n", "mask", "at", "word", "window", "slots"])

    return run


@dataclass
class Wanted:
    """The patterns (n, mask) of the benchmark's windows; its hashes, sorted, with the least number of windows that an item with
    that hash needs and the most windows of an item that it stands for. Without hashes, every window is wanted."""

    patterns: list[tuple[int, int]]
    hashes: np.ndarray | None = None
    needs: np.ndarray | None = None
    stands: np.ndarray | None = None


def found_windows(texts: Texts, wanted: Wanted, s: Settings, seen: np.ndarray | None) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """text, hash, place (among words, or template tokens in runs), n, mask, whether in runs: the wanted windows of documents that may be contaminated."""
    by_word, by_value = _places(texts.t, s.window), _places(texts.h, s.window)
    by_token = _places(texts.t[texts.first], s.window)
    owner = texts.text[texts.first]
    long_run = np.concatenate([[0], np.cumsum(texts.stop - texts.first > 1)])
    starts = np.concatenate([[0], np.cumsum(texts.size)[:-1]])
    got = []
    for n, mask in wanted.patterns:
        for runs, places, text in ((False, by_value if mask == LITERAL else by_word, texts.text), (True, by_token, owner)):
            if runs and mask == LITERAL or len(text) < n:
                continue
            at = None if n == s.window else starts[texts.size == n]
            if runs and at is not None:
                continue
            h = _windows(places, at, n, mask)
            k = np.arange(len(h)) if seen is None else np.flatnonzero(seen[(h >> np.uint64(42)).astype(np.int64)])
            where = k if at is None else at[k]
            own = text[where] == text[where + n - 1]
            if runs:
                # Windows without a run are there by their words.
                own &= long_run[where + n] > long_run[where]
            k, where = k[own], where[own]
            if wanted.hashes is not None:
                place = np.minimum(np.searchsorted(wanted.hashes, h[k]), len(wanted.hashes) - 1)
                hit = wanted.hashes[place] == h[k]
                k, where, place = k[hit], where[hit], place[hit]
            else:
                place = np.zeros(len(k), np.int64)
            got.append((text[where], h[k], where, np.full(len(k), n), np.full(len(k), mask), np.full(len(k), runs), place))
    if not got:
        return
    text, h, where, n, mask, runs, place = (np.concatenate(c) for c in zip(*got))
    keep = np.ones(len(text), bool)
    if wanted.hashes is not None and len(text):
        have = np.bincount(text, wanted.stands[place], len(texts.size))
        need = np.full(len(texts.size), np.inf)
        np.minimum.at(need, text, wanted.needs[place])
        keep = (have >= need)[text]
    order = np.flatnonzero(keep)[np.argsort(text[keep], kind="stable")]
    yield from zip(*(c[order].tolist() for c in (text, h.view(np.int64), where, n, mask, runs)))


def _found(s: Settings, wanted: Wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        if wanted.hashes is not None:
            seen = np.zeros(1 << 22, bool)
            seen[(wanted.hashes >> np.uint64(42)).astype(np.int64)] = True
        for batch in sliced(batches, "text", 1_500_000):
            texts, keys = Texts(batch.column("text")), batch.column("doc_id").to_pylist()
            starts = np.concatenate([[0], np.cumsum(texts.size)[:-1]])
            rows = []
            for k, h, where, n, mask, runs in found_windows(texts, wanted, s, seen):
                word = int(texts.first[where]) if runs else where
                token = where if runs else int(texts.token[where])
                rows.append((keys[k], h, token - int(texts.token[starts[k]]), word - int(starts[k]), [] if mask == LITERAL else texts.slots(where, n, mask, runs)))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "hash", "at", "word", "slots"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, share) of the documents and items where share, that of the item's windows, is large enough.

    Null texts, null doc_ids and null item_ids take no part, nor do items without tokens; an item shorter than a window
    is one window, which documents of that length alone can have. Rows that repeat a doc_id are looked at together.
    Several items that a document has are all named.
    """
    s, scratch = settings, scratch or Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = scratch.table(items.mapInArrow(frugal(_posted(s)), POSTED), "items")
    n = items.count()
    if not n:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("false").select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("share"))
    sizes = scratch.table(items.groupBy("item_id").agg(F.countDistinct("window").alias("of")), "sizes")
    # At most 2 ** window patterns for each n up to the window.
    wanted = Wanted(sorted(map(tuple, items.select("n", "mask").distinct().collect())))
    if n <= s.broadcast_windows:
        stands = items.groupBy("item_id", "hash").agg(F.countDistinct("window").alias("stands")).join(sizes, "item_id")
        few = stands.groupBy("hash").agg(F.min(F.ceil(F.col("of") * s.share - 1e-9)).alias("needs"), F.max("stands").alias("stands")).toPandas()
        few = few.assign(hash=few["hash"].to_numpy().view(np.uint64)).sort_values("hash")
        wanted.hashes, wanted.needs, wanted.stands = few["hash"].to_numpy(), few["needs"].to_numpy(np.float64), few["stands"].to_numpy(np.float64)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(frugal(_found(s, wanted)), FOUND)
    # Of a window that an item has several times the first is enough, so a document's windows meet one of each item.
    side = items.groupBy("item_id", "hash", "window").agg(F.min(F.struct("word", "at", "slots")).alias("p"))
    side = side.select("item_id", "hash", "window", F.col("p.at").alias("at2"), F.col("p.word").alias("word2"), F.col("p.slots").alias("theirs"))
    met = found.join(side, "hash").select("doc_id", "item_id", "window", (F.col("at") - F.col("at2")).alias("by_token"), (F.col("word") - F.col("word2")).alias("by_word"), "slots", "theirs")
    met = scratch.table(met.distinct(), "met")
    # Copies with other names are in line by template tokens, and those without capitals by words. What holds more windows in one line is taken.
    most = lambda by: met.groupBy("doc_id", "item_id", by).agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", "item_id").agg(F.max("n").alias(f"most_{by}"))
    lines = most("by_token").join(most("by_word"), ["doc_id", "item_id"])
    lines = lines.select("doc_id", "item_id", (F.col("most_by_word") > F.col("most_by_token")).alias("words"))
    met = met.join(lines, ["doc_id", "item_id"]).withColumn("shift", F.when(F.col("words"), F.col("by_word")).otherwise(F.col("by_token")))
    met = scratch.table(met.drop("by_word", "by_token", "words"), "in_line")
    pairs = met.select("doc_id", "item_id", "shift", F.explode(F.arrays_zip("theirs", "slots")).alias("p")).where("p.theirs is not null and p.slots is not null")
    values = pairs.groupBy("doc_id", "item_id", "shift", F.lower("p.theirs").alias("value")).agg(F.countDistinct(F.lower("p.slots")).alias("stands_for"))
    clashes = values.groupBy("doc_id", "item_id", "shift").agg(F.avg((F.col("stands_for") > 1).cast("double")).alias("clash")).where(F.col("clash") > s.conflicts)
    good = met.join(clashes, ["doc_id", "item_id", "shift"], "left_anti")
    shares = good.groupBy("doc_id", "item_id").agg(F.countDistinct("window").alias("n")).join(sizes, "item_id")
    return shares.select("doc_id", "item_id", (F.col("n") / F.col("of")).alias("share")).where(F.col("share") >= s.share)


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, contaminated, item_ids (ascending), share (the largest; 0 if none).

    Null and empty texts are clean, as all documents are beside an empty benchmark. Other columns are ignored.
    """
    bad = contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), settings, scratch)
    bad = bad.groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("share").alias("share"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(bad, "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))
