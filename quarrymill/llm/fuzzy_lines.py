"""Line dedup: near-equal lines by MinHash over character shingles.

Equal lines (without white space at their ends) form a class, and the earliest of each goes on with its signature. The
signature is cut into bands; lines that agree in a band meet, are verified by the exact Jaccard similarity of their
shingle sets, and are joined by a distributed union-find. Of each component the earliest line stays, by doc_id and
then by place.

Shingles of 5 characters let a line of 49 characters or more meet its variant with one other letter; a shorter line's
variant is below 80 % unless the letter is near an end. With 5 rows in each of 16 bands, two lines that are 80 % similar
meet with a chance of 0.998, at 90 % of 0.999999; unrelated lines of one language, some of which share 10 % of such short
shingles, meet by chance in fewer bands the more rows a band has.

How many lines meet by chance grows with the square of their number, so a member of a list goes on only if another member
may be similar to it: of each of 64 coordinates of the signature a line has two bits, which agree with a chance of
0.85 for lines that are 80 % similar and of 0.33 for lines at 10 %. A list is read in order, so its members meet without a join.

Documents are cut into lines once, in the task that signs them; what a line is known by is written and read again. Bands
are dealt to buckets in pieces of many, and a task sorts one bucket at a time, so no row of a single band is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from quarrymill.llm.pairing import BUCKETS, WORDS, linked_components
from quarrymill.llm.words import M2, frugal, mix, sliced
from quarrymill.session import Scratch

#: Up to so many documents or lines are picked by a broadcast of their ids; more by a shuffle.
BROADCAST_IDS = 500_000
#: Coordinates of a signature that have bits in a line's sketch, and the members of a list up to which sketches are compared.
SKETCHED, SKETCHED_LIST = 64, 1_000
#: Lines whose bands a task deals to buckets at once, the rows that a bucket of a band should have, and beyond which it is cut.
DEALT_LINES, ROWS_A_BUCKET, BUCKET_ROWS = 20_000, 100_000, 1_000_000
SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Settings:
    shingle: int = 12
    percent: int = 80
    bands: int = 12
    rows: int = 4
    pivot_rounds: int = 4
    pairs_a_line: int = 4


#: What lines are compared by unless a caller says otherwise.
LINES = Settings(shingle=5, bands=16, rows=5)


#: Brings what all bits of a coordinate tell into its highest ones.
SPREAD = np.uint32(0x9E3779B1)


def shingle_hashes(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle of every line, and where each line's begin. A shorter line is one shingle."""
    lengths = np.array([len(x) for x in lines], np.int64)
    padded = np.maximum(lengths, size)
    codes = np.frombuffer("".join(x if len(x) >= size else x + "\0" * (size - len(x)) for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # A polynomial of the shingle's characters, from the last to the first.
    n = len(codes) - size + 1
    h = codes[size - 1 :].copy()
    for i in range(size - 2, -1, -1):
        h *= M2
        h += codes[i : i + n]
    counts = padded - size + 1
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    # Drop the shingles that cross from one line into the next.
    inside, begin = np.ones(n, bool), np.cumsum(padded)[:-1]
    for back in range(1, size):
        inside[begin - back] = False
    return mix(h[inside]), starts


def _signed(s: Settings):
    k = s.bands * s.rows
    rng = np.random.default_rng(17)
    factors = rng.integers(0, 2**31, k, np.uint32) * np.uint32(2) + np.uint32(1)

    def of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h, starts = shingle_hashes(lines, s.shingle)
        h = (h >> np.uint64(32)).astype(np.uint32)
        least, scaled = np.empty((k, len(lines)), np.uint32), np.empty_like(h)
        for j in range(k):
            np.minimum.reduceat(np.multiply(h, factors[j], out=scaled), starts, out=least[j])
        band, out = np.arange(s.bands, dtype=np.uint64)[:, None], np.zeros((s.bands, len(lines)), np.uint64)
        for r in range(s.rows):
            out = mix(out * M2 + least[r :: s.rows] + band)
        bits = (least[:SKETCHED] * SPREAD >> np.uint32(30)).astype(np.uint8)
        sketch = np.zeros((2, SKETCHED // 8, len(lines)), np.uint8)
        for i, b in enumerate((bits >> 1, bits & 1)):
            sketch[i, : -(-len(bits) // 8)] = np.packbits(b, axis=0, bitorder="little")
        sketch = np.ascontiguousarray(sketch.transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
        return np.ascontiguousarray((out >> np.uint64(32)).astype(np.uint32).T), sketch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [(i, at, x) for i, text in enumerate(batch.column("text").to_pylist()) for at, x in enumerate(map(_trimmed, text.split("\n"))) if x]
            if not found:
                continue
            doc, at, lines = zip(*found)
            bands, sketch = (np.concatenate(x, axis) for x, axis in zip(zip(*(of(lines[i : i + 256]) for i in range(0, len(lines), 256))), (0, 1)))
            keys = np.frombuffer(b"".join(xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines), np.int64).reshape(-1, 2)
            ends = pa.py_buffer(np.arange(0, bands.nbytes + 1, 4 * s.bands, dtype=np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(lines), [None, ends, pa.py_buffer(bands)])
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(at, pa.int32()), *(pa.array(x) for x in keys.T.copy()), packed, *(pa.array(x.view(np.int64)) for x in sketch)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "k1", "k2", "bands", "s1", "s2"])

    return run


def _trimmed(line: str) -> str:
    return line.strip(SPACE)


def _dealt(s: Settings, parts: int):
    """(bucket, hashes, nodes): the bands' hashes of some lines that fall into one of ``parts`` buckets of a band, as 32-bit
    integers, and the lines' nodes, as 64-bit ones."""

    def deal(rows: list[tuple[pa.Array, pa.Array]]) -> pa.RecordBatch:
        node = np.concatenate([x.to_numpy() for x, _ in rows])
        hashes = np.frombuffer(b"".join(b for _, x in rows for b in x.to_pylist()), np.uint32).reshape(-1, s.bands)
        out = []
        for band in range(s.bands):
            h = hashes[:, band]
            bucket = h % np.uint32(parts)
            order = np.argsort(bucket, kind="stable")
            h, of, n = np.ascontiguousarray(h[order]), bucket[order], node[order]
            cuts = np.append(np.flatnonzero(np.diff(of, prepend=np.uint32(parts))), len(of))
            out += [(band * parts + int(of[i]), h[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["bucket", "hashes", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            if batch.num_rows:
                rows.append((batch.column("node"), batch.column("bands")))
                n += batch.num_rows
            if n >= DEALT_LINES:
                yield deal(rows)
                rows, n = [], 0
        if n:
            yield deal(rows)

    return run


def _in_order(parts: int):
    """(token, node) list after list, from buckets that come one after another.

    A bucket is sorted in memory. Of one that grows beyond BUCKET_ROWS, by lists far longer than others, what its lists have
    over two goes on before it ends, by two at least.
    """

    def batch(token: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(node)], ["token", "node"])

    def joined(held: list) -> tuple[np.ndarray, np.ndarray]:
        h, node = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        return h[order], node[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, n, most = None, [], 0, BUCKET_ROWS

        def tokens(h: np.ndarray) -> np.ndarray:
            return np.int64(last // parts << 32) | h.astype(np.int64)

        for rows in batches:
            for bucket, hashes, nodes in zip(*(rows.column(c).to_pylist() for c in ("bucket", "hashes", "nodes"))):
                if bucket != last and held:
                    h, node = joined(held)
                    yield batch(tokens(h), node)
                    held, n, most = [], 0, BUCKET_ROWS
                last = bucket
                held.append((np.frombuffer(hashes, np.uint32), np.frombuffer(nodes, np.int64)))
                n += len(held[-1][0])
                if n > most:
                    h, node = joined(held)
                    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                    sizes = np.diff(np.append(starts, len(h)))
                    go = np.repeat(sizes > 3, sizes) & (np.arange(len(h)) - np.repeat(starts, sizes) > 1)
                    yield batch(tokens(h[go]), node[go])
                    held, n = [(h[~go], node[~go])], int((~go).sum())
                    most = max(BUCKET_ROWS, 2 * n)
        if held:
            h, node = joined(held)
            yield batch(tokens(h), node)

    return run


def _in_lists(rows: DataFrame, run: Callable) -> DataFrame:
    """(token, node): what ``run`` keeps of rows that come list after list."""
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(frugal(run), "token long, node long")


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose token the row before or the row after has too."""
    token, node, met = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        token, node = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((token, "token"), (node, "node")))
        same = token[1:] == token[:-1]
        keep = np.concatenate([[met], same]) | np.concatenate([same, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in (token, node)], ["token", "node"])
        # The last row waits for the one after it.
        token, node, met = token[-1:], node[-1:], bool(keep[-1])
    if met:
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node)], ["token", "node"])


def most_apart(s: Settings) -> int:
    """In how many coordinates the sketches of two lines may differ that are to be compared; lines at ``percent`` differ
    in more with a chance under 1e-5."""
    n, p = min(SKETCHED, s.bands * s.rows), s.percent / 100
    differ = (1 - p) * 3 / 4
    return math.ceil(n * differ + 5.2 * math.sqrt(n * differ * (1 - differ)))


def _alike(token: np.ndarray, s1: np.ndarray, s2: np.ndarray, most: int) -> np.ndarray:
    """Which rows have a row of their token, all of which stand together, whose sketch differs in ``most`` coordinates at most."""
    ends = np.flatnonzero(np.append(token[1:] != token[:-1], True)) + 1
    sizes = np.diff(np.append(0, ends))
    left = np.repeat(ends, sizes) - np.arange(len(token))
    out = np.repeat(sizes > SKETCHED_LIST, sizes)
    i, d = np.flatnonzero((left > 1) & ~out), 1
    while len(i):
        near = i[np.bitwise_count(s1[i] ^ s1[i + d] | s2[i] ^ s2[i + d]) <= most]
        out[near] = out[near + d] = True
        d += 1
        i = i[left[i] > d]
    return out


def _named(token: np.ndarray, node: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """Tokens by what their lists' members are, so that lists of the same members have one; those that ``stay`` are kept. Lists
    that a chance gives one name are one longer list."""
    if not len(token):
        return token
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    sizes = np.diff(np.append(starts, len(token)))
    names = mix(np.add.reduceat(mix(node.view(np.uint64)), starts) + sizes.astype(np.uint64)).view(np.int64)
    return np.where(stay, token, np.repeat(names, sizes))


def _similar(s: Settings):
    """The rows with another of their token that may be similar. Lists of over SKETCHED_LIST rows go on whole; the others' tokens
    are made anew from their members."""
    most = most_apart(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "node", "s1", "s2"]
        rest, long = [np.zeros(0, np.int64)] * 4, []

        def kept(rows: list[np.ndarray]) -> pa.RecordBatch:
            token, node, s1, s2 = rows
            whole = np.isin(token, np.array(long, np.int64))
            keep = _alike(token, s1.view(np.uint64), s2.view(np.uint64), most) | whole
            token, node = token[keep], node[keep]
            return pa.RecordBatch.from_arrays([pa.array(_named(token, node, whole[keep])), pa.array(node)], names[:2])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(rest, names)]
            # The last list waits for its end, unless it is a long one.
            start = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            going_on = len(rows[0]) - start > SKETCHED_LIST or rows[0][-1] in long[-1:]
            cut, last = len(rows[0]) if going_on else start, rows[0][-1]
            if cut:
                # One that ends here, before another begins, is a long one still.
                long = [*long[-1:], last] if going_on else long
                yield kept([x[:cut] for x in rows])
            rest = [x[cut:] for x in rows]
        if len(rest[0]):
            yield kept(rest)

    return run


def _keys(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of up to 256 lines: the line's number in the top 8 bits and the shingle's hash below, sorted; and the
    place of each in its line, of its first occurrence."""
    h, starts = shingle_hashes(lines, size)
    line = np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(np.append(starts, len(h))))
    keys, at = np.unique(line << np.uint64(56) | h >> np.uint64(8), return_index=True)
    return keys, at - starts[(keys >> np.uint64(56)).astype(np.int64)]


def _per_line(keys: np.ndarray, lines: int) -> np.ndarray:
    return np.bincount((keys >> np.uint64(56)).astype(np.int64), minlength=lines)


def _sizes(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                n = _per_line(_keys(batch.column("line").to_pylist(), s.shingle)[0], batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("line"), pa.array(n, pa.int32())], ["node", "line", "n"])

    return run


def _compared(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                a, b = (_keys(batch.column(c).to_pylist(), s.shingle)[0] for c in ("la", "lb"))
                sizes = [pa.array(_per_line(x, batch.num_rows), pa.int32()) for x in (a, b, np.intersect1d(a, b, assume_unique=True))]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *sizes], ["a", "b", "na", "nb", "common"])

    return run


def _spread(s: Settings):
    """Counts of the shingles of line a that line b has, by their places in line a, as an edit of b costs most of one count;
    and a bitmap of the other shingles of line b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                n = batch.num_rows
                (a, at), (b, _) = (_keys(batch.column(c).to_pylist(), s.shingle) for c in ("la", "lb"))
                pair = (a >> np.uint64(56)).astype(np.int64)
                most = np.zeros(n, np.int64)
                np.maximum.at(most, pair, at)
                bucket = pair * BUCKETS + at * BUCKETS // (most[pair] + 1)
                spread = np.bincount(bucket[np.isin(a, b, assume_unique=True)], minlength=n * BUCKETS).astype(np.int32)
                rest = np.setdiff1d(b, a, assume_unique=True)
                bits = np.zeros(n * WORDS, np.uint64)
                place = (rest >> np.uint64(56)) * np.uint64(WORDS) + rest % np.uint64(WORDS)
                np.bitwise_or.at(bits, place.astype(np.int64), np.uint64(1) << (rest >> np.uint64(8) & np.uint64(63)))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(x)) for k, x in ((BUCKETS, spread), (WORDS, bits.view(np.int64)))]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *lists], ["a", "b", "spread", "bits"])

    return run


#: A document is its id and the hash of its text, since rows with one id may have several texts.
DOC = "struct<doc_id:bigint,text_hash:bigint>"


def _document() -> Column:
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def repeated_lines(docs: DataFrame, settings: Settings = LINES, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, at): the lines to remove, as places in their documents (see ``DOC``), from 0."""
    s, scratch = settings, scratch or Scratch(docs.sparkSession)
    docs = docs.where("doc_id is not null").select(_document().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = scratch.table(docs.mapInArrow(frugal(_signed(s)), f"doc_id {DOC}, at int, k1 long, k2 long, bands binary, s1 long, s2 long"), "signed")
    # All of a class have the same signature, so any of them will do. Its number is written with it, and means nothing else.
    signature = F.first(F.struct("bands", "s1", "s2")).alias("signature")
    classes = signed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("lines"), signature)
    classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()).select("*", "signature.*").drop("signature"), "classes")
    parts = 1 + classes.count() // ROWS_A_BUCKET
    dealt = classes.select("node", "bands").mapInArrow(frugal(_dealt(s, parts)), "bucket long, hashes binary, nodes binary")
    ordered = _in_order(parts)
    met = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frugal(lambda batches: _meeting(ordered(batches))), "token long, node long")
    met = scratch.table(met, "met")
    postings = _in_lists(met.join(classes.select("node", "s1", "s2"), "node").select("token", "node", "s1", "s2"), _similar(s))
    # Similar lines meet in most bands, in lists of the same members, of which one will do.
    postings = scratch.table(postings.distinct(), "similar")
    scratch.drop("met")
    nodes = scratch.table(postings.select("node").distinct().join(classes.select("node", "first.*"), "node"), "nodes")
    # A class of one line that is linked to no other keeps it.
    root = classes.where("lines > 1").select("k1", "k2", "first")
    if not nodes.isEmpty():
        # Only documents that have such a line are cut into lines again.
        some = nodes.groupBy("doc_id").agg(F.collect_list(F.struct("at", "node")).alias("wanted"))
        some = docs.join(F.broadcast(some) if nodes.count() <= BROADCAST_IDS else some, "doc_id").withColumn("lines", F.split("text", "\n", -1))
        wanted = some.select(F.inline(F.transform("wanted", lambda w: F.struct(w["node"].alias("node"), F.btrim(F.get("lines", w["at"]), F.lit(SPACE)).alias("line"))))).dropDuplicates(["node"])
        texts = scratch.table(wanted.mapInArrow(frugal(_sizes(s)), "node long, line string, n int"), "texts")
        postings = scratch.table(postings.join(texts.select("node", "n"), "node"), "postings")

        def both(pairs: DataFrame, run, schema: str) -> DataFrame:
            # Lines are some ten times shorter than their shingle sets, so the sets are made where two lines meet.
            ta, tb = (texts.select(F.col("node").alias(x), F.col("line").alias(f"l{x}")) for x in "ab")
            return pairs.select("a", "b").join(tb, "b").join(ta, "a").select("a", "b", "la", "lb").mapInArrow(frugal(run), f"a long, b long, {schema}")

        def compare(pairs: DataFrame) -> DataFrame:
            return both(pairs, _compared(s), "na int, nb int, common int")

        def spread(pairs: DataFrame) -> DataFrame:
            return both(pairs, _spread(s), "spread array<int>, bits array<long>")

        comp = linked_components(postings, compare, None, spread, s.percent, s.pairs_a_line * nodes.count(), scratch, s.pivot_rounds)
        linked = scratch.table(comp.join(classes.select("node", "k1", "k2", "first"), "node"), "linked")
        earliest = linked.groupBy("component").agg(F.min("first").alias("first"))
        root = root.join(linked.select("k1", "k2"), ["k1", "k2"], "left_anti").unionByName(linked.drop("first").join(earliest, "component").select("k1", "k2", "first"))
    places = signed.select("doc_id", "at", "k1", "k2").join(root, ["k1", "k2"])
    return places.where(F.struct("doc_id", "at") != F.col("first")).select("doc_id", "at")


def dedup_lines(docs: DataFrame, settings: Settings = LINES, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, text, n_lines, n_removed.

    Lines end at \\n. Lines of white space alone stay, and count in n_lines. A null text counts as empty. Rows that
    repeat a doc_id and its text are one document, and other texts of a doc_id are others; rows with a null doc_id are passed on whole. Other columns are left
    out, and an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    gone = repeated_lines(docs, settings, scratch).groupBy("doc_id").agg(F.collect_set("at").alias("gone"))
    gone = scratch.table(gone, "gone")
    for name in ("signed", "classes", "texts"):
        scratch.drop(name)
    docs = docs.select(F.when(F.col("doc_id").isNotNull(), _document()).alias("doc_id"), "text")
    found = docs.join(gone, "doc_id", "left")
    removed = F.map_from_arrays("gone", F.transform("gone", lambda i: F.lit(True)))
    found = found.withColumn("removed", removed)
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.try_element_at("removed", i), F.lit(False)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return found.select("doc_id.doc_id", text.alias("text"), n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))
