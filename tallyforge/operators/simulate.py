"""Monte Carlo: uncertain inputs, outputs as Spark SQL expressions, samples spread over the cluster.

A block of iterations draws each input from a Philox stream keyed by seed, input name and block. So results do not
depend on partitions or lost executors, and adding an input moves no other.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 65_536
# The kinds of distribution with their parameters.
PARAMETERS = {
    "normal": ("mean", "sd"), "lognormal": ("log_mean", "log_sd"), "uniform": ("low", "high"), "triangular": ("low", "mode", "high"), "beta": ("alpha", "beta", "low", "high"),
    "exponential": ("rate",), "poisson": ("lambda",), "bernoulli": ("p",), "binomial": ("trials", "p"), "discrete": ("values", "weights"), "custom": ("points",),
}


@dataclass
class Input:
    """A named input; ``low`` and ``high`` bound it, by drawing again (up to 1000 times) or by clamping."""

    name: str
    kind: str
    params: dict
    low: float | None = None
    high: float | None = None
    clamp: bool = False

    def check(self) -> None:
        if self.kind not in PARAMETERS:
            raise ValueError(f"{self.name}: unknown distribution {self.kind}")
        if set(self.params) != set(PARAMETERS[self.kind]):
            raise ValueError(f"{self.name}: {self.kind} takes {', '.join(PARAMETERS[self.kind])}")
        p = self.params
        bad = {
            "normal": lambda: p["sd"] < 0, "lognormal": lambda: p["log_sd"] < 0 or p["log_mean"] + 8 * p["log_sd"] > 709, "uniform": lambda: p["low"] >= p["high"],
            "triangular": lambda: not p["low"] <= p["mode"] <= p["high"] or p["low"] == p["high"], "beta": lambda: min(p["alpha"], p["beta"]) <= 0 or p["low"] >= p["high"],
            "exponential": lambda: p["rate"] <= 0, "poisson": lambda: not 0 < p["lambda"] <= 1e9, "bernoulli": lambda: not 0 <= p["p"] <= 1,
            "binomial": lambda: p["trials"] < 0 or not 0 <= p["p"] <= 1, "discrete": lambda: len(p["values"]) != len(p["weights"]) or not 0 < len(p["values"]) <= 1000 or min(p["weights"]) < 0 or sum(p["weights"]) <= 0,
            "custom": lambda: len(p["points"]) < 2 or any(b[0] < a[0] or b[1] < a[1] for a, b in zip(p["points"], p["points"][1:])),
        }[self.kind]()
        if bad or (self.low is not None and self.high is not None and self.low > self.high):
            raise ValueError(f"{self.name}: parameters out of range")

    def draw(self, g: np.random.Generator, n: int) -> np.ndarray:
        p = self.params
        match self.kind:
            case "normal":
                return g.normal(p["mean"], p["sd"], n)
            case "lognormal":
                return g.lognormal(p["log_mean"], p["log_sd"], n)
            case "uniform":
                return g.uniform(p["low"], p["high"], n)
            case "triangular":
                return g.triangular(p["low"], p["mode"], p["high"], n)
            case "beta":
                return p["low"] + (p["high"] - p["low"]) * g.beta(p["alpha"], p["beta"], n)
            case "exponential":
                return g.exponential(1 / p["rate"], n)
            case "poisson":
                return g.poisson(p["lambda"], n).astype(float)
            case "bernoulli":
                return (g.random(n) < p["p"]).astype(float)
            case "binomial":
                return g.binomial(p["trials"], p["p"], n).astype(float)
            case "discrete":
                edges = np.cumsum(np.asarray(p["weights"], float) / sum(p["weights"]))
                return np.asarray(p["values"], float)[np.minimum(np.searchsorted(edges, g.random(n), side="right"), len(edges) - 1)]
            case "custom":
                q = np.asarray(p["points"], float)
                return np.interp(g.random(n), q[:, 0], q[:, 1])
        raise AssertionError(self.kind)

    def moments(self) -> tuple[float, float]:
        """Analytic mean and variance, before bounds."""
        p = self.params
        match self.kind:
            case "normal":
                return p["mean"], p["sd"] ** 2
            case "lognormal":
                m, v = p["log_mean"], p["log_sd"] ** 2
                return math.exp(m + v / 2), math.expm1(v) * math.exp(2 * m + v)
            case "uniform":
                return (p["low"] + p["high"]) / 2, (p["high"] - p["low"]) ** 2 / 12
            case "triangular":
                a, c, b = p["low"], p["mode"], p["high"]
                return (a + b + c) / 3, (a * a + b * b + c * c - a * b - a * c - b * c) / 18
            case "beta":
                a, b, w = p["alpha"], p["beta"], p["high"] - p["low"]
                return p["low"] + w * a / (a + b), w * w * a * b / ((a + b) ** 2 * (a + b + 1))
            case "exponential":
                return 1 / p["rate"], 1 / p["rate"] ** 2
            case "poisson":
                return p["lambda"], p["lambda"]
            case "bernoulli":
                return p["p"], p["p"] * (1 - p["p"])
            case "binomial":
                return p["trials"] * p["p"], p["trials"] * p["p"] * (1 - p["p"])
            case "discrete":
                w = np.asarray(p["weights"], float) / sum(p["weights"])
                v = np.asarray(p["values"], float)
                return float(w @ v), float(w @ v**2 - (w @ v) ** 2)
            case "custom":
                m = s = 0.0
                for (q0, x0), (q1, x1) in zip(p["points"], p["points"][1:]):
                    m += (q1 - q0) * (x0 + x1) / 2
                    s += (q1 - q0) * (x0 * x0 + x0 * x1 + x1 * x1) / 3
                return m, s - m * m
        raise AssertionError(self.kind)

    def bounded(self, g: np.random.Generator, n: int) -> tuple[np.ndarray, int]:
        """Draws within the bounds, and how many were drawn again or clamped."""
        x = self.draw(g, n)
        lo, hi = -math.inf if self.low is None else self.low, math.inf if self.high is None else self.high
        bad = (x < lo) | (x > hi)
        if self.clamp:
            return np.clip(x, lo, hi), int(bad.sum())
        again = 0
        for _ in range(1000):
            if not bad.any():
                return x, again
            again += int(bad.sum())
            x[bad] = self.draw(g, int(bad.sum()))
            bad = (x < lo) | (x > hi)
        raise ValueError(f"{self.name}: no draw within its bounds in 1000 tries")


@dataclass
class Spec:
    """Inputs, and outputs as (name, Spark SQL expression) that may use inputs and earlier outputs. At most 64 and 16."""

    inputs: list[Input]
    outputs: list[tuple[str, str]] = field(default_factory=list)

    def check(self) -> None:
        names = [i.name for i in self.inputs] + [o for o, _ in self.outputs]
        if len(self.inputs) > 64 or len(self.outputs) > 16 or len(set(names)) != len(names) or not all(n.isidentifier() for n in names):
            raise ValueError("names must be unique identifiers; at most 64 inputs and 16 outputs")
        for i in self.inputs:
            i.check()

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def samples(spark: SparkSession, spec: Spec, seed: int, n: int, partitions: int | None = None) -> DataFrame:
    """iteration, inputs and outputs, one row per iteration; redrawn counts draws outside bounds (in a block's first row)."""
    spec.check()
    if not 100 <= n:
        raise ValueError("at least 100 iterations")
    inputs, width = spec.inputs, BLOCK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for block in part["id"]:
                size = int(min(width, n - block * width))
                out = {"iteration": np.arange(size, dtype=np.int64) + block * width}
                again = 0
                for i in inputs:
                    key = hashlib.sha256(f"{seed}\x1f{i.name}\x1f{block}".encode()).digest()[:16]
                    out[i.name], k = i.bounded(np.random.Generator(np.random.Philox(key=int.from_bytes(key, "little"))), size)
                    again += k
                out["redrawn"] = np.array([again] + [0] * (size - 1), dtype=np.int64)
                yield pd.DataFrame(out)

    blocks = -(-n // width)
    ids = spark.range(0, blocks, 1, min(blocks, partitions or spark.sparkContext.defaultParallelism))
    df = ids.mapInPandas(run, "iteration bigint, " + ", ".join(f"`{i.name}` double" for i in inputs) + ", redrawn bigint")
    for name, expression in spec.outputs:
        df = df.withColumn(name, F.expr(expression).cast("double"))
    return df


def failures(df: DataFrame, outputs: list[str]) -> DataFrame:
    """First iteration at which an output is null, NaN or infinite, for each that ever is."""
    rows = df.select("iteration", F.inline(F.array(*[F.struct(F.lit(o).alias("output"), F.col(o).alias("value")) for o in outputs])))
    odd = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return rows.where(odd).groupBy("output").agg(F.min("iteration").alias("iteration"))


def long_form(df: DataFrame, outputs: list[str]) -> DataFrame:
    """iteration, inputs, output, value: what the statistics read."""
    keep = [c for c in df.columns if c not in outputs and c != "redrawn"]
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(o).alias("output"), F.col(o).alias("value")) for o in outputs])))
