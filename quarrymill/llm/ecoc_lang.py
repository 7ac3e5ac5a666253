"""Language ID by error-correcting output codes.

Each language has a codeword of bits; each bit has a binary classifier over hashed byte n-grams of the lower-cased
text, which tells the languages with that bit from those without it. A text's margins are decoded to the language
whose codeword has the least loss, bits weighted by how well their classifier does on the rows it was fitted on; a
text whose two nearest codewords are about as near is flagged.

The classifiers are naive Bayes log-odds, so fitting takes n-gram counts by language alone. They are counted on a
bounded sample of labelled rows; what the driver gets is one packed vector of counts a language and partition of the
sample, and it unpacks one at a time.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.ftrl import fold
from quarrymill.llm.words import frugal

LETTER = regex.compile(r"\p{L}")
#: ASCII characters that aren't letters become spaces; bytes of other letters stay.
PLAIN = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


@dataclass(frozen=True)
class Settings:
    #: Byte n-grams of these lengths are features, hashed into 2**bits buckets.
    orders: tuple[int, ...] = (2, 3, 4)
    bits: int = 16
    #: About this many labelled rows are used for fitting, chosen by a hash of doc_id.
    sample_rows: int = 16_000
    #: Partitions that count them.
    sample_parts: int = 8
    #: A decision is ambiguous if the two best codewords' scores differ by less than this.
    ambiguous: float = 0.2


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    table: np.ndarray  # buckets x bits, log-odds
    bit_weights: np.ndarray


def buckets(text: str, s: Settings) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, a stretch of the text at a time."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(PLAIN).split()) + b" ", np.uint8).astype(np.uint32)
    for start in range(0, len(data), 1 << 16):
        part = data[start : start + (1 << 16) + max(s.orders) - 1]
        key = part.copy()
        for n in range(2, max(s.orders) + 1):
            key = (key[:-1] << np.uint32(8)) | part[n - 1 :]
            if n in s.orders:
                # Those that begin in the next stretch are that one's.
                yield ((key[: 1 << 16] ^ np.uint32(n * 0x01000193)) * np.uint32(2654435761)) >> np.uint32(32 - s.bits)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: the exhaustive code for a few languages, else the best-spread of seeded random codes."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        columns = [[1 if c >> i & 1 else -1 for i in range(n)] for c in range(1, 1 << (n - 1))]
        return np.array(columns, np.int8).T
    rng, width = np.random.default_rng(7), max(15, int(np.ceil(10 * np.log2(n))))
    tries = [rng.choice(np.array([-1, 1], np.int8), (n, width)) for _ in range(64)]
    # Two codewords agree in the more bits the larger their product is.
    alike = [t.astype(np.int32) @ t.T.astype(np.int32) - 2 * width * np.eye(n, dtype=np.int32) for t in tries]
    return tries[int(np.argmin([a.max() for a in alike]))]


def _count(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = sums.setdefault(lang, np.zeros(1 << s.bits, np.int32))
                for b in buckets(text or "", s):
                    np.add.at(own, b, 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], ["lang", "counts"])

    return run


def fit(docs: DataFrame, may_learn: Column, settings: Settings = Settings()) -> Model:
    """A model from the rows of ``docs`` (doc_id, text, lang) for which ``may_learn`` holds and lang isn't null."""
    known = docs.where(F.col("lang").isNotNull() & may_learn)
    sizes = known.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], codewords(0), np.zeros((0, 0), np.float32), np.zeros(0))
    # The same share of each language, but all of a language that would have few rows.
    share = settings.sample_rows / max(1, sum(r["count"] for r in sizes))
    least = settings.sample_rows / (4 * len(langs))
    rates = [x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, max(share, least / r["count"]))))]
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("lang")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(u < F.coalesce(F.try_element_at(F.create_map(*rates), F.col("lang")), F.lit(0.0))).select("doc_id", "lang", "text")
    sample = sample.repartition(settings.sample_parts, "doc_id").select("lang", "text")
    got = sample.mapInArrow(frugal(_count(settings)), "lang string, counts binary").toPandas()
    own = {lang: list(g) for lang, g in got.groupby("lang")["counts"]}

    def frequencies(lang: str) -> np.ndarray:
        counts = np.full(1 << settings.bits, 0.1)
        for c in own.get(lang, []):
            counts += np.frombuffer(zlib.decompress(c), np.int32)
        return counts / counts.sum()

    # One language at a time, since there may be very many.
    code = codewords(len(langs))
    with_bit, without = (np.zeros((1 << settings.bits, code.shape[1])) for _ in range(2))
    for lang, word in zip(langs, code):
        p = frequencies(lang)[:, None]
        with_bit[:, word > 0] += p
        without[:, word < 0] += p
    table = np.log((with_bit / np.maximum(1, (code > 0).sum(0))) / (without / np.maximum(1, (code < 0).sum(0))))
    # A bit's weight: how far apart its classifier holds the languages' own n-gram distributions.
    weights = np.clip(np.min([(frequencies(lang) @ table) * word for lang, word in zip(langs, code)], axis=0), 0.05, None)
    return Model(langs, code, table.astype(np.float32), weights / max(weights.sum(), 1e-9))


def decode(margins: np.ndarray, model: Model) -> np.ndarray:
    """Scores of the languages, which sum to 1, from a text's margins: each bit costs its weighted logistic loss."""
    if len(model.langs) == 1:
        return np.ones(1)
    loss = (model.bit_weights * np.logaddexp(0, -model.code * np.clip(margins, -30, 30))).sum(1)
    e = np.exp(loss.min() - loss)
    return e / e.sum()


def identify(docs: DataFrame, model: Model, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous, from the text alone.

    A text that is null or has no letter, and any text if no language was learned, is ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for part in parts:
            out = []
            for t in part:
                if not t or not model.langs or not LETTER.search(t):
                    out.append(("und", 0.0, True))
                    continue
                margins = np.zeros(model.code.shape[1])
                for b in buckets(t, settings):
                    margins += model.table[b].sum(0, dtype=np.float64)
                scores = decode(margins, model)
                best = int(np.argmax(scores))
                second = float(np.delete(scores, best).max()) if len(scores) > 1 else 0.0
                out.append((model.langs[best], float(scores[best]), bool(scores[best] - second < settings.ambiguous)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    found = F.pandas_udf(frugal(run), "lang_pred string, score double, ambiguous boolean")(F.col(text))
    return docs.withColumn("__found", found).select(*docs.columns, "__found.lang_pred", "__found.score", "__found.ambiguous")


def language_id(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score, ambiguous.

    Learns from documents whose fold of three isn't 1. Ties between codewords go to the language that sorts first;
    repeated rows get equal answers; a null doc_id isn't held out; other columns are ignored.
    """
    model = fit(docs.select("doc_id", "text", "lang"), fold(F.col("doc_id"), 3) != 1, settings)
    found = identify(docs.select("doc_id", "text"), model, settings)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
