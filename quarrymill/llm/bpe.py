"""Byte-level BPE encoding and decoding by monoid tree reduction.

The elements are token sequences, and joining two of them gives the encoding of their concatenated bytes; the empty
sequence is neutral. A piece (one match of the pre-tokenizer's pattern) is halved down to short leaves, the leaves
are merged directly, all new ones of a batch together, and neighbours are joined up the tree.

Joining rests on one fact about rank-ordered BPE: a token sequence is the encoding of its bytes exactly if each two
adjacent tokens are the encoding of their own concatenation (they are *settled*). So if the two tokens at the border
are settled, the join is plain concatenation; else a window around the border is encoded anew, and grows on a side
until its outermost token and the token beyond it are settled. All adjacent pairs are settled then, so nothing outside
the window can change. Decoding is the homomorphism back: the bytes of the tokens, concatenated.

Pieces never join each other, so a document's sequence is the concatenation of its pieces' sequences.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrymill.llm.words import Recent, frugal, sliced, small_batches

#: Characters that the pattern's \s matches; a space after one of them isn't a place to cut a text.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: The pattern of which encode() knows that a match begins with a space or holds none. Fixed value.
SPACE_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """The tokens that two tokens make, by their ids: a sorted list of pairs. Leaves of equal length are merged together."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        x, y, rank = np.array(pairs or [(0, 0, 0)], np.int64).T
        order = np.argsort(x << 32 | y)
        self.keys, self.ranks = (x << 32 | y)[order], rank[order]
        self.never = np.int64(1) << 40
        if not pairs:
            self.ranks[:] = self.never
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.never)

    def leaves(self, leaves: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The ids of each leaf, by merging its pair of lowest rank, leftmost first, while it has one."""
        out: dict[bytes, tuple[int, ...]] = {}
        by_length: dict[int, list[bytes]] = {}
        for x in leaves:
            by_length.setdefault(len(x), []).append(x)
        for n, same in by_length.items():
            ids = self.byte[np.frombuffer(b"".join(same), np.uint8).reshape(len(same), n)]
            ranks, who = self.of(ids[:, :-1], ids[:, 1:]), np.arange(len(same))
            while len(who):
                at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(who), np.int64)
                low = ranks[np.arange(len(who)), at] if ranks.shape[1] else np.full(len(who), self.never)
                done = low >= self.never
                for k, row in zip(who[done].tolist(), ids[done].tolist()):
                    out[same[k]] = tuple(row)
                ids, ranks, who, at, low = ids[~done], ranks[~done], who[~done], at[~done], low[~done]
                if not len(who):
                    break
                row, width = np.arange(len(who)), ids.shape[1]
                ids[row, at] = low
                stay = np.ones(ids.shape, bool)
                stay[row, at + 1] = False
                ids = ids[stay].reshape(len(who), width - 1)
                ranks = ranks[stay[:, 1:]].reshape(len(who), width - 2)
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
                ranks[left, at[left] - 1] = self.of(ids[left, at[left] - 1], ids[left, at[left]])
                ranks[right, at[right]] = self.of(ids[right, at[right]], ids[right, at[right] + 1])
        return out


class Encoder:
    """Encodes pieces and texts with given ranks. Keeps some ``cache`` results of each kind, those in use of late."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = 16, cache: int = 100_000, merges: Merges | None = None):
        self.ranks, self.leaf, self.most = ranks, leaf, cache
        self.pattern = regex.compile(pattern)
        self.merges = merges or Merges(ranks)
        self.settled_pairs = Recent(lambda pair: self.merge(pair[0] + pair[1]) == [*pair], cache // 10)
        self.merged = Recent(self._merge_short, cache // 10)
        self.chunks: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of ``data``, by merging the adjacent pair of lowest rank, leftmost first, while there is one."""
        return self.merged[data] if len(data) <= 8 else self._merge_short(data) if len(data) <= 64 else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[bytes]:
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        # The rank of each part joined with the next; what can't be joined stands behind all ranks.
        never = len(self.ranks) + (1 << 40)
        joined = [rank(data[i : i + 2], never) for i in range(len(data) - 1)]
        while joined and (best := min(joined)) < never:
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(joined):
                joined[i] = rank(parts[i] + parts[i + 1], never)
        return parts

    def _merge_long(self, data: bytes) -> list[bytes]:
        """As merge(), with a heap of candidate pairs over a linked list."""
        n, rank = len(data), self.ranks.get
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if part[i] is None or after[i] >= n or len(part[i]) + len(part[after[i]]) != size:
                continue  # one of the two has been merged since
            j = after[i]
            part[i] += part[j]
            part[j], after[i] = None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(part[i] + part[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[after[i]])))
            if (h := before[i]) >= 0 and (r := rank(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return [p for p in part if p is not None]

    def settled(self, x: bytes, y: bytes) -> bool:
        return self.settled_pairs[x, y]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right or self.settled(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = self.merge(b"".join(left[-a:] + right[:b]))
            grow_left = a < len(left) and not self.settled(left[-a - 1], window[0])
            grow_right = b < len(right) and not self.settled(window[-1], right[b])
            if not grow_left and not grow_right:
                return left[:-a] + window + right[b:]
            # Short windows grow by a token; long ones by half, so that the work stays near-linear.
            a = min(len(left), a + 1 + a // 2) if grow_left else a
            b = min(len(right), b + 1 + b // 2) if grow_right else b

    def reduce(self, data: bytes) -> list[bytes]:
        if len(data) <= self.leaf:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def pieces(self, texts: list[str]) -> list[tuple[int, ...]]:
        """The ids of each text, all matches of the pattern in all texts together. A match that is a token is that token."""
        matches = list(map(self.pattern.findall, texts))
        ids: dict[str, tuple[int, ...]] = {}
        short, long = {}, {}
        for m in set(chain.from_iterable(matches)):
            data = m.encode()
            if (whole := self.ranks.get(data)) is not None:
                ids[m] = (whole,)
            else:
                (short if len(data) <= self.leaf else long)[m] = data
        merged = self.merges.leaves(list(short.values()))
        ids.update((m, merged[data]) for m, data in short.items())
        ids.update((m, tuple(map(self.ranks.__getitem__, self.reduce(data)))) for m, data in long.items())
        return [ids[own[0]] if len(own) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, own))) for own in matches]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts.

        The pattern takes one space at most before a word, so no match crosses a space that follows a non-space. Texts
        are cut there, and each chunk is encoded once for all of them; a text with other white space before a space,
        where that doesn't hold, is matched as a whole, as are all texts if the pattern isn't known to have this trait.
        """
        whole = [k for k, t in enumerate(texts) if self.pattern.pattern != SPACE_FIRST or any(s + " " in t for s in SPACES)]
        out = dict(zip(whole, (np.array(ids, np.int32) for ids in self.pieces([texts[k] for k in whole]))))
        cut = [k for k in range(len(texts)) if k not in out]
        # The chunks of all texts, as numbers of distinct ones; a text's first has no space before it.
        lists = pc.split_pattern(pa.array([texts[k] for k in cut], pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        names, ends = coded.dictionary.to_pylist(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        fresh = [c for c in names if c not in self.chunks]
        self.chunks.update(zip(fresh, self.pieces([" " + c for c in fresh])))
        of = list(map(self.chunks.__getitem__, names)) + self.pieces([t[: t.find(" ")] if " " in t else t for t in (texts[k] for k in cut)])
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        numbers[np.concatenate([[0], ends[:-1]]).astype(np.int64)] = len(names) + np.arange(len(cut))
        flat, sizes = np.fromiter(chain.from_iterable(of), np.int32), np.fromiter(map(len, of), np.int64, len(of))
        starts, own = np.cumsum(sizes) - sizes, sizes[numbers]
        upto = np.cumsum(own)
        ids = flat[np.repeat(starts[numbers] - (upto - own), own) + np.arange(upto[-1] if len(upto) else 0)]
        out.update(zip(cut, np.split(ids, upto[ends[:-1] - 1]) if cut else []))
        if len(self.chunks) > self.most:
            # What was there before this call and is in use is frequent.
            self.chunks = {c: self.chunks[c] for c in set(names).difference(fresh)}
        return [out[k] for k in range(len(texts))]


def decode(ids: np.ndarray, tokens: list[bytes], leaf: int = 1024) -> bytes:
    """The bytes of a token sequence, by halves: the homomorphism's image of a join is the concatenation of its halves'."""
    if len(ids) <= leaf:
        return b"".join(map(tokens.__getitem__, ids.tolist()))
    half = len(ids) // 2
    return decode(ids[:half], tokens, leaf) + decode(ids[half:], tokens, leaf)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: key, columns named in keep, ids array<int>, decoded binary.

    Encodes whole texts by the ranks in ``ranks_path``, without special tokens, and decodes the ids. A null text
    counts as empty and has no ids. The vocabulary, whose size the file fixes (some 50,000 entries, 3 MB with its merges), is
    broadcast. Rows are independent: no shuffle, and a lost task is run again by itself. Repeated rows, null keys and
    other columns change nothing.
    """
    small_batches(docs.sparkSession)
    ranks = load_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern, Merges(ranks)))
    rows = docs.select(key, *keep, docs[text].alias("__text"))
    schema = T.StructType([*(rows.schema[c] for c in (key, *keep)), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pattern, merges = shared.value
        encoder, tokens = Encoder(ranks, pattern, merges=merges), [b""] * (max(ranks.values(), default=0) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        for batch in sliced(batches, "__text", 2_500_000):
            ids = encoder.encode([t or "" for t in batch.column("__text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([decode(x, tokens) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "ids", "decoded"])

    return rows.mapInArrow(frugal(run), schema)
