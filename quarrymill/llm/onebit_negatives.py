"""Hard negatives by rotated one-bit codes with a certain interval for each score.

A vector of whole numbers is rotated at random, and of each coordinate only the sign is kept: its code. Beside the code
its alignment is stored, the length of the vector's part along the code, and the length of the rest. The inner product
with an anchor is the alignment times the anchor's product with the code, plus a product of two rests that by
Cauchy-Schwarz is at most the product of their lengths. The anchor's product with the code comes from bit planes of the
rotated anchor and counts of bits, with a bound for what the planes leave off. So each pair has an interval that
certainly holds its score; only pairs whose interval reaches what is asked for are scored, in whole numbers.

Rows and anchors are dealt out to tiles of bounded size, and each task compares one tile of rows with one of anchors,
so neither side is ever held whole. A tile gives each anchor's first few rows, and these are merged by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.words import frugal, small_batches
from quarrymill.session import Scratch, range_partitions


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 5
    #: A negative's score is at least ``low`` and at most ``high`` hundredths of the positive's.
    low: int = 80
    high: int = 100
    scale: int = 256
    rows_a_tile: int = 8192
    anchors_a_tile: int = 2048
    planes: int = 7
    seed: int = 7


#: Larger components count as this, so that a product of 32,768 dimensions fits a long.
LARGEST = 1 << 24
#: A task compares some so many pairs at once.
PAIRS_AT_ONCE = 1 << 20
CODED = "vec_id bigint, label int, dim int, v binary, code binary, along double, rest double"


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """An orthogonal matrix that depends on its size and the seed alone."""
    return np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))[0]


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words, padded with zeros."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def coded(v: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths along the code and lengths of the rest of rows of whole numbers."""
    o = v @ rotation(v.shape[1], seed)
    along = np.abs(o).sum(axis=1) / max(1.0, np.sqrt(v.shape[1]))
    return packed(o >= 0), along, np.sqrt(np.maximum(0.0, (v * v).sum(axis=1) - along * along))


def encode(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows (vec_id, label, embedding) that take part, as codes; of equal rows in a batch, no more than can be in a list."""
    small_batches(rows.sparkSession)
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where(fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", label)
    copies, scale, seed = max(settings.positives, settings.negatives), settings.scale, settings.seed

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            dims = np.diff(lists.offsets.to_numpy())
            starts, flat = lists.offsets.to_numpy()[:-1], lists.values.to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = np.clip(np.floor(scale * flat[starts[at][:, None] + np.arange(dim)]), -LARGEST, LARGEST)
                code, along, rest = coded(v, seed)
                one = pd.DataFrame({"vec_id": batch.column("vec_id").take(pa.array(at)).to_pandas(types_mapper=pd.ArrowDtype), "label": batch.column("label").take(pa.array(at)).to_numpy(zero_copy_only=False)})
                one["dim"] = np.int32(dim)
                one["v"], one["code"] = [x.tobytes() for x in v.astype(np.int32)], [x.tobytes() for x in code]
                one["along"], one["rest"] = along, rest
                one = one[one.groupby(["vec_id", "label", "v"], dropna=False).cumcount() < copies]
                yield pa.RecordBatch.from_pandas(one, pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("dim", pa.int32()), ("v", pa.binary()), ("code", pa.binary()), ("along", pa.float64()), ("rest", pa.float64())]), preserve_index=False)

    return rows.mapInArrow(run, CODED)


def matrix(column: pd.Series, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), width)


class Anchors:
    """A tile of anchors, ready to bound their products with codes."""

    def __init__(self, v: np.ndarray, planes: int, seed: int):
        self.v = v.astype(np.float64)
        q = self.v @ rotation(v.shape[1], seed) if v.shape[1] else self.v
        dim, levels = max(1, v.shape[1]), (1 << planes) - 1
        self.root = np.sqrt(dim)
        self.low = q.min(axis=1, initial=0.0)
        self.step = np.maximum((q.max(axis=1, initial=0.0) - self.low) / levels, 1e-12)
        k = np.rint((q - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.off = np.abs(q - self.low[:, None] - k * self.step[:, None]).sum(axis=1) / self.root
        self.planes = [packed((k >> j) & 1 == 1) for j in range(planes)]
        self.sums = k.sum(axis=1)
        self.square, self.dim = (self.v * self.v).sum(axis=1), v.shape[1]

    def bounds(self, code: np.ndarray, along: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores, anchors by rows."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        inside = np.zeros((len(self.v), len(code)), np.int64)
        for j, plane in enumerate(self.planes):
            for word in range(code.shape[1]):
                inside += np.bitwise_count(plane[:, word, None] & code[None, :, word]).astype(np.int64) << j
        # The sum over all coordinates of sign times (low + step * k), by the root of the dimension.
        x = (self.low[:, None] * (2 * ones - self.dim) + self.step[:, None] * (2 * inside - self.sums[:, None])) / self.root
        side = np.sqrt(np.maximum(0.0, self.square[:, None] - np.maximum(0.0, np.abs(x) - self.off[:, None]) ** 2)) * rest
        slack = along * self.off[:, None] + side + 1e-9 * (1.0 + np.sqrt(self.square)[:, None] * (along + rest))
        middle = along * x
        return np.ceil(middle - slack), np.floor(middle + slack)

    def scores(self, v: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of the wanted pairs (a mask, anchors by rows); the others are anything."""
        large = float(max(np.abs(self.v).max(initial=0), 1)) * float(max(np.abs(v).max(initial=0), 1)) * max(1, self.dim)
        if large < 1 << 53:
            if wanted.mean() > 0.05:  # so many that one product of matrices is less work than single pairs
                return (self.v @ v.T.astype(np.float64)).astype(np.int64)
            out = np.zeros(wanted.shape, np.int64)
            a, b = np.nonzero(wanted)
            for part in np.array_split(np.arange(len(a)), max(1, len(a) * max(1, self.dim) // (1 << 22))):
                out[a[part], b[part]] = np.einsum("ij,ij->i", self.v[a[part]], v[b[part]].astype(np.float64)).astype(np.int64)
            return out
        return self.v.astype(np.int64) @ v.T.astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, most: int) -> np.ndarray:
    """Places of the first rows that fit, by score, then id."""
    at = np.flatnonzero(fits)
    if len(at) > most:
        least = np.partition(scores[at], len(at) - most)[len(at) - most]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))[:most]]


def _compare(settings: Settings, signs: bool):
    """What a task makes of a tile of anchors and one of rows: positives, or negatives of the anchors' positives."""
    most = settings.negatives if signs else settings.positives

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            dim = int(anchors["dim"].iloc[0])
            tile = Anchors(matrix(anchors["v"], np.int32, dim), settings.planes, settings.seed)
            own, own_label = anchors["vec_id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)
            # Null ids come after all others and are never an anchor's.
            nulls = rows["vec_id"].isna().to_numpy()
            ids = rows["vec_id"].fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
            label, along, rest = rows["label"].to_numpy(np.int64), rows["along"].to_numpy(), rows["rest"].to_numpy()
            v, words = matrix(rows["v"], np.int32, dim), -(-dim // 64)
            code = matrix(rows["code"], np.uint64, words)
            lists = [np.asarray(x, np.int64) for x in anchors["scores"]] if signs else None
            step = max(1, PAIRS_AT_ONCE // len(anchors))
            for s in range(0, len(rows), step):
                part = slice(s, s + step)
                least, greatest = tile.bounds(code[part], along[part], rest[part])
                same = own_label[:, None] == label[None, part]
                if signs:
                    top = np.array([x.max(initial=0) for x in lists])[:, None]
                    low = np.array([x[x >= 0].min(initial=np.iinfo(np.int32).max) for x in lists])[:, None]
                    wanted = ~same & (100 * greatest >= settings.low * low.astype(np.float64)) & (100 * least <= settings.high * top.astype(np.float64))
                else:
                    candidates = same & (own[:, None] != ids[None, part])
                    sure = np.where(candidates, least, -np.inf)
                    floor = np.full((len(anchors), 1), -np.inf)
                    if sure.shape[1] > most:
                        floor = np.partition(sure, sure.shape[1] - most, axis=1)[:, -most][:, None]
                    wanted = candidates & (greatest >= floor)
                exact = tile.scores(v[part], wanted)
                for k in np.flatnonzero(wanted.any(axis=1)):
                    score, places = exact[k], [(0, wanted[k])]
                    if signs:
                        places = [(p, wanted[k] & (100 * score >= settings.low * x) & (100 * score <= settings.high * x)) for p, x in enumerate(lists[k])]
                    for place, fits in places:
                        at = _first(score, ids[part], fits, most)
                        out += [(anchors["a"].iloc[k], place, None if nulls[s + i] else ids[s + i], score[i]) for i in at]
        return pd.DataFrame(out, columns=["a", "place", "vec_id", "score"]).astype({"a": "int64", "place": "int32", "vec_id": "Int64", "score": "int64"})

    return run


def _tiles(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Both sides with their tiles: each row goes to all tiles of anchors, each anchor to all tiles of rows."""
    across = max(range_partitions(rows.sparkSession), -(-n_rows // settings.rows_a_tile))
    down = -(-n_anchors // settings.anchors_a_tile)
    spread = lambda *of: F.xxhash64(*of)
    rows = rows.withColumn("row_tile", F.pmod(spread("vec_id", "v"), F.lit(across))).withColumn("anchor_tile", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    anchors = anchors.withColumn("anchor_tile", F.pmod(spread("a"), F.lit(down)).cast("int")).withColumn("row_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    return rows, anchors


def hard_negatives(embeddings: DataFrame, settings: Settings = Settings(), every: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``embeddings`` (vec_id, embedding, label).

    Rows with a null label or vector, or a component that is null or not finite, take no part. Where vec_id is divisible
    by 7, label first becomes (label + 1) % 10. A component x becomes floor(scale * x) and at most 2^24 either way.
    Anchors are rows whose vec_id is divisible by ``every``; an anchor's row that is there again is one anchor. Its
    positives are the first rows of its label with another vec_id, its negatives for a positive the first rows of other
    labels whose score is within ``low`` to ``high`` hundredths of the positive's (so none, where that is negative);
    higher scores come first, then smaller ids, null ids last. Equal rows count each for itself, so a positive that is
    there twice is answered twice. Vectors are compared with those of their own length. An empty table, and one
    without anchors, gives an empty result; other columns are ignored.
    """
    scratch = scratch or Scratch(embeddings.sparkSession)
    rows = scratch.table(encode(embeddings.select("vec_id", "embedding", "label"), settings), "coded")
    anchors = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "v"])
    anchors = scratch.table(anchors.select(F.xxhash64("vec_id", "label", "v").alias("a"), "vec_id", "label", "dim", "v"), "anchors")
    n_rows, n_anchors = rows.count(), max(1, anchors.count())
    kind = "a bigint, place int, vec_id bigint, score bigint"
    keys = ["dim", "row_tile", "anchor_tile"]

    def merged(anchors: DataFrame, signs: bool) -> DataFrame:
        theirs, ours = _tiles(rows, anchors, n_rows, n_anchors, settings)
        found = ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(_compare(settings, signs), kind)
        order = Window.partitionBy("a", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        most = settings.negatives if signs else settings.positives
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    positives = scratch.table(merged(anchors, signs=False), "positives")
    lists = positives.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("of"))
    asked = scratch.table(anchors.join(lists, "a").withColumn("scores", F.col("of.positive_score")), "asked")
    negatives = merged(asked.drop("of"), signs=True)
    of = F.get("of", F.col("place"))
    return asked.select("a", F.col("vec_id").alias("anchor_id"), "of").join(negatives, "a").select(
        "anchor_id", of["positive_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), of["positive_score"].alias("positive_score"), F.col("score").alias("negative_score")
    )
