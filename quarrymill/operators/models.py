"""Small models trained side by side: one group of rows (an arm and a seed) is one training run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.scalars import blended_target, logistic_score


def train_linear(rows: DataFrame, by: Sequence[str], features: str, target: str, key: str, steps: int = 200, batch: int = 256, rate: float = 0.05, most_rows: int = 20_000) -> DataFrame:
    """(by, rows, weights, loss): a linear model of each group by Adam on squared error, in batches in key order.

    A run sees about ``most_rows`` rows of its group at most, those that come first by a hash of the key, since a training
    run is one task; groups run in parallel.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    u = F.pmod(F.xxhash64(key, F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(n, list(by)).where(u < F.lit(float(most_rows)) / F.col("__n")).select(*by, F.xxhash64(key).alias("k"), features, target)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x = np.stack(pdf[features].to_numpy()).astype(float)
        x, y = np.hstack([x, np.ones((len(x), 1))]), pdf[target].to_numpy(float)
        w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for t in range(1, steps + 1):
            i = np.arange((t - 1) * batch, t * batch) % len(x)
            g = 2 * x[i].T @ (x[i] @ w - y[i]) / len(i)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return pd.DataFrame([[*pdf[list(by)].iloc[0], len(x), w.tolist(), float(np.mean((x @ w - y) ** 2))]], columns=[*by, "rows", "weights", "loss"])

    return sample.groupBy(*by).applyInPandas(run, f"{kinds}, rows long, weights array<double>, loss double")


def predict_linear(features: Column, weights: Column) -> Column:
    """The model's output; the last weight is the bias."""
    n = F.size(weights) - 1
    return F.aggregate(F.zip_with(features, F.slice(weights, F.lit(1), n), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x) + F.element_at(weights, -1)


def evaluate(rows: DataFrame, by: Sequence[str], predicted: str, actual: str, sign_from: float = 100.0) -> DataFrame:
    """(by, n, loss, mae, sign_agreement): signs are compared where |actual| is at least ``sign_from``; null if nowhere."""
    error = F.col(predicted) - F.col(actual)
    clear = F.abs(F.col(actual)) >= sign_from
    agree = F.avg(F.when(clear, (F.signum(predicted) == F.signum(actual)).cast("double")))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("loss"), F.avg(F.abs(error)).alias("mae"), agree.alias("sign_agreement"))


def batches(n: int, size: int, seed: int):
    """Places of rows in batches, without end: a shuffled order is walked without repeats, its last part batch left out, and then
    shuffled anew. A set smaller than a batch is one batch."""
    order, rng, size = np.arange(n), np.random.default_rng([seed, 2]), min(n, size)
    while n:
        rng.shuffle(order)
        yield from (order[k : k + size] for k in range(0, n - size + 1, size))


class Network:
    """One hidden layer of units clipped to [0, 1], a score, and training-only heads on the same units.

    Heads are of values (``heads``) and of buckets: ``families`` of one choice each among ``classes``. With a ``slope``
    the score is trained as an expected result, 1 / (1 + e^(-slope * score)), against targets of that kind; without one
    it is trained as it is. Weights of the score and of the heads are drawn from streams of their own, so that two runs
    of one seed, with and without heads, start alike and see the same batches.
    """

    SHARED = ("into", "shift", "out", "bias")

    def __init__(self, inputs: int, hidden: int, heads: int, seed: int, families: int = 0, classes: int = 0, slope: float | None = None):
        own, extra = (np.random.default_rng([seed, k]) for k in (0, 1))
        edge = hidden**-0.5
        self.families, self.classes, self.slope = families, classes, slope
        self.weights = {"into": own.normal(0, 0.1, (inputs, hidden)), "shift": np.zeros(hidden), "out": own.uniform(-edge, edge, hidden), "bias": own.uniform(-edge, edge, 1)}
        if heads:
            self.weights |= {"heads": extra.uniform(-edge, edge, (hidden, heads)), "head_bias": np.zeros(heads)}
        if families:
            self.weights |= {"choice": extra.uniform(-edge, edge, (hidden, families * classes)), "choice_bias": np.zeros(families * classes)}

    @classmethod
    def stored(cls, row: Mapping[str, object], slope: float | None = None) -> Network:
        """The network of a row of ``train_networks``, without its training-only heads."""
        into = np.asarray(row["into"], float)
        net = cls(into.shape[0], into.shape[1], 0, 0, slope=slope)
        net.weights = {k: np.asarray(row[k], float) for k in cls.SHARED}
        return net

    def units(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights["into"] + self.weights["shift"], 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.units(x) @ self.weights["out"] + self.weights["bias"][0]

    def expected(self, score: np.ndarray) -> np.ndarray:
        """What a score is held against its target as."""
        return score if self.slope is None else 1 / (1 + np.exp(-np.clip(self.slope * score, -60, 60)))

    def _chances(self, h: np.ndarray) -> np.ndarray:
        raw = (h @ self.weights["choice"] + self.weights["choice_bias"]).reshape(len(h), self.families, self.classes)
        raw = np.exp(raw - raw.max(axis=2, keepdims=True))
        return raw / raw.sum(axis=2, keepdims=True)

    def loss(self, x: np.ndarray, y: np.ndarray, aux: np.ndarray, weight: float, buckets: np.ndarray | None = None) -> float:
        h = self.units(x)
        total = np.mean((self.expected(self.score(x)) - y) ** 2)
        if "heads" in self.weights:
            total += weight * np.mean(np.square(h @ self.weights["heads"] + self.weights["head_bias"] - aux))
        if "choice" in self.weights and buckets is not None:
            total -= weight * np.mean(np.log(np.maximum(np.take_along_axis(self._chances(h), buckets[:, :, None], axis=2), 1e-12)))
        return float(total)

    def gradients(self, x: np.ndarray, y: np.ndarray, aux: np.ndarray, weight: float, buckets: np.ndarray | None = None) -> dict[str, np.ndarray]:
        w, h = self.weights, self.units(x)
        seen = self.expected(h @ w["out"] + w["bias"][0])
        score_gap = 2 * (seen - y) / len(y)
        if self.slope is not None:
            score_gap = score_gap * seen * (1 - seen) * self.slope
        back = np.outer(score_gap, w["out"])
        found = {"out": h.T @ score_gap, "bias": score_gap.sum(keepdims=True)}
        if "heads" in w:
            head_gap = 2 * weight * (h @ w["heads"] + w["head_bias"] - aux) / aux.size
            found |= {"heads": h.T @ head_gap, "head_bias": head_gap.sum(0)}
            back = back + head_gap @ w["heads"].T
        if "choice" in w and buckets is not None:
            gap = self._chances(h)
            np.put_along_axis(gap, buckets[:, :, None], np.take_along_axis(gap, buckets[:, :, None], axis=2) - 1, axis=2)
            gap = (weight * gap / buckets.size).reshape(len(h), -1)
            found |= {"choice": h.T @ gap, "choice_bias": gap.sum(0)}
            back = back + gap @ w["choice"].T
        back = back * ((h > 0) & (h < 1))
        return found | {"into": x.T @ back, "shift": back.sum(0)}

    def fit(self, x, y, aux, seed: int, updates: int, size: int, rate: float, weight: float, adam: bool, buckets: np.ndarray | None = None) -> None:
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for t, at in zip(range(1, updates + 1), batches(len(y), size, seed)):
            for k, g in self.gradients(x[at], y[at], aux[at], weight, None if buckets is None else buckets[at]).items():
                if adam:
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    g = first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                self.weights[k] -= rate * g


def _stacked(column: pd.Series, kind: type) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind)


def gradient_norms(rows: DataFrame, seeds: Sequence[int], features: str, target: str, key: str, aux: str, hidden: int, batch: int = 256, most_batches: int = 8, slope: float | None = None, buckets: str | None = None, classes: int = 0) -> DataFrame:
    """(seed, batch, rows, score_norm, aux_norm): lengths of the gradients at the shared weights into the hidden layer, at the start of each seed's run.

    A seed's batches are its first ones by a hash order of its own, ``batch`` rows each and the last one maybe fewer, so
    ``seeds * batch * most_batches`` rows are looked at, as the measure asks. The score's gradient is that of a network without
    heads; the auxiliary one is what heads of weight 1 add to it. Each batch is a group of its own. Rows without a
    target are left out; no rows give no norms.
    """
    known = rows.where(F.col(target).isNotNull())
    chosen = None
    for seed in seeds:
        first = known.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)).orderBy("__h", key).limit(batch * most_batches)
        first = first.withColumn("__k", F.row_number().over(Window.orderBy("__h", key)) - 1)
        first = first.select(F.lit(int(seed)).alias("seed"), F.floor(F.col("__k") / batch).cast("int").alias("batch"), "__k", F.col(features).alias("x"), F.col(target).cast("double").alias("y"), F.col(aux).alias("aux"), (F.col(buckets) if buckets else F.array().cast("array<int>")).alias("buckets"))
        chosen = first if chosen is None else chosen.unionByName(first)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__k")
        x, y, extra, choice = _stacked(pdf["x"], float), pdf["y"].to_numpy(float), _stacked(pdf["aux"], float), _stacked(pdf["buckets"], int)
        seed = int(pdf["seed"].iloc[0])
        net = Network(x.shape[1], hidden, extra.shape[1], seed, choice.shape[1], classes, slope)
        whole = net.gradients(x, y, extra, 1.0, choice if choice.shape[1] else None)["into"]
        net.weights = {k: net.weights[k] for k in Network.SHARED}
        alone = net.gradients(x, y, extra, 0.0)["into"]
        return pd.DataFrame([(seed, int(pdf["batch"].iloc[0]), len(y), float(np.linalg.norm(alone)), float(np.linalg.norm(whole - alone)))], columns=["seed", "batch", "rows", "score_norm", "aux_norm"])

    return chosen.groupBy("seed", "batch").applyInPandas(run, "seed int, batch int, rows long, score_norm double, aux_norm double")


def calibrated_weight(norms: DataFrame, share: float) -> DataFrame:
    """One row (ratio, weight, realised): the mean over seeds of the auxiliary gradients' mean length over the score's, and the weight at which it is ``share``.

    The weight has six digits, so that it can be written down and hashed. Without auxiliary gradients it is null.
    """
    by_seed = norms.groupBy("seed").agg(F.try_divide(F.avg("aux_norm"), F.avg("score_norm")).alias("ratio"))
    one = by_seed.agg(F.avg("ratio").alias("ratio"))
    weight = F.format_string("%.5e", F.try_divide(F.lit(float(share)), "ratio")).try_cast("double")
    return one.select("ratio", weight.alias("weight"), (F.col("ratio") * weight).alias("realised"))


def train_networks(
    rows: DataFrame, by: Sequence[str], seed: str, features: str, target: str, key: str, hidden: int, aux: str | None = None, aux_weight: float = 0.0,
    updates: int | None = None, epochs: int = 20, batch: int = 256, rate: float = 0.01, optimizer: str = "adam", most_rows: int = 20_000,
    slope: float | None = None, buckets: str | None = None, classes: int = 0,
) -> DataFrame:
    """(by, seed, rows, hidden, into, shift, out, bias, loss): a network with one hidden layer for each group and seed.

    ``updates`` fixes the number of batches; without it there are ``epochs`` walks over the rows. Rows without a target are
    left out; a group sees its first rows by a hash of the key, about ``most_rows``. Groups run in parallel, one a task.
    ``slope`` trains in the space of expected results, where ``target_space`` puts scores and results; ``buckets`` are
    arrays of whole numbers under ``classes``, one for each family of buckets. Heads aren't kept.
    """
    if optimizer not in ("adam", "sgd"):
        raise ValueError(f"no optimizer {optimizer}")
    groups = [*by, seed]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in groups)
    n = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    u = F.pmod(F.xxhash64(key, F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(F.col(target).isNotNull()).join(n, groups).where(u < F.lit(float(most_rows)) / F.col("__n"))
    sample = sample.select(*groups, F.xxhash64(key).alias("k"), F.col(features).alias("x"), F.col(target).cast("double").alias("y"), (F.col(aux) if aux else F.array().cast("array<double>")).alias("aux"), (F.col(buckets) if buckets else F.array().cast("array<int>")).alias("buckets"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x, y, extra, choice = _stacked(pdf["x"], float), pdf["y"].to_numpy(float), _stacked(pdf["aux"], float), _stacked(pdf["buckets"], int)
        own = int(pdf[seed].iloc[0])
        net = Network(x.shape[1], hidden, extra.shape[1], own, choice.shape[1], classes, slope)
        net.fit(x, y, extra, own, updates or epochs * max(1, len(y) // batch), batch, rate, aux_weight, optimizer == "adam", choice if choice.shape[1] else None)
        kept = [net.weights[k].tolist() for k in Network.SHARED]
        return pd.DataFrame([[*pdf[groups].iloc[0], len(y), hidden, *kept, float(np.mean((net.expected(net.score(x)) - y) ** 2))]], columns=[*groups, "rows", "hidden", *Network.SHARED, "loss"])

    return sample.groupBy(*groups).applyInPandas(run, f"{kinds}, rows long, hidden int, into array<array<double>>, shift array<double>, out array<double>, bias array<double>, loss double")


def target_space(score: Column, result: Column, scale: float, weight: float) -> Column:
    """A training target from 0 to 1: the expected result of a score, mixed with the game's by ``weight`` of the score, or alone where there is no result."""
    return blended_target(logistic_score(score, scale), result, 1 - weight)


def predict_network(features: Column, into: Column, shift: Column, out: Column, bias: Column) -> Column:
    """A network's score, from its stored weights; heads are never asked."""
    scaled = F.zip_with(features, into, lambda x, row: F.transform(row, lambda w: w * x.cast("double")))
    sums = F.aggregate(scaled, shift, lambda total, row: F.zip_with(total, row, lambda a, b: a + b))
    units = F.transform(sums, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return F.aggregate(F.zip_with(units, out, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + bias[0]


def auxiliary_weight(rows: DataFrame, by: Sequence[str], score_norm: str, aux_norm: str) -> DataFrame:
    """(by, weight): what auxiliary gradients are to be scaled by to be as long as the score's: the mean ratio of their norms."""
    ratio = F.try_divide(F.col(score_norm), F.col(aux_norm))
    return rows.groupBy(*by).agg(F.bround(F.avg(ratio), 6).alias("weight"))


def encoded(rows: DataFrame, target: str, missing: str = "drop") -> DataFrame:
    """Rows with a target; those without one are dropped, or with ``missing="raise"`` fail the query."""
    known = F.col(target).isNotNull()
    if missing == "raise":
        return rows.where(F.when(~known, F.raise_error(F.lit(f"a row has no {target}")).cast("boolean")).otherwise(True))
    return rows.where(known)
