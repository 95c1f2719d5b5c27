"""Training of the pair models, and simple regressions. Sums run in Spark; what the driver solves is as small as the features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .relational import numbered


def gradient_step(rows: DataFrame, features: list[str], label: str, weights: list[float], bias: float, positive: float = 1.0) -> DataFrame:
    """One row of mean gradients g0.. (features) and gb (bias) of the logistic loss, positive rows weighted."""
    z = F.lit(bias)
    for f, w in zip(features, weights):
        z = z + F.col(f) * F.lit(w)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    e = (p - F.col(label)) * F.when(F.col(label) > 0, F.lit(positive)).otherwise(F.lit(1.0))
    return rows.agg(*[F.avg(e * F.col(f)).alias(f"g{i}") for i, f in enumerate(features)], F.avg(e).alias("gb"))


def fit_logistic(rows: DataFrame, features: list[str], label: str, rate: float = 0.3, epochs: int = 400) -> dict:
    """Weights, bias, means and deviations by full-batch descent; each epoch is one aggregate over the cached rows."""
    from pyspark import StorageLevel

    stats = rows.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)], F.avg(label).alias("p")).first()
    mu = [stats[f"m{i}"] for i in range(len(features))]
    sd = [stats[f"s{i}"] or 1.0 for i in range(len(features))]
    z = rows.select(*[((F.col(f) - m) / s).alias(f"x{i}") for i, (f, m, s) in enumerate(zip(features, mu, sd))], F.col(label).cast("double").alias("y")).persist(StorageLevel.MEMORY_AND_DISK_2)
    positive = (1 - stats["p"]) / stats["p"] if stats["p"] else 1.0
    w, b, names = [0.0] * len(features), 0.0, [f"x{i}" for i in range(len(features))]
    for _ in range(epochs):
        g = gradient_step(z, names, "y", w, b, positive).first()
        w, b = [v - rate * g[f"g{i}"] for i, v in enumerate(w)], b - rate * g["gb"]
    z.unpersist()
    return {"w": w, "b": b, "mu": mu, "sd": sd}


def normal_equations(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """(i, j, value) of X'X with a leading 1, the target last."""
    x: list[Column] = [F.lit(1.0), *[F.col(f) for f in features], F.col(target)]
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    one = rows.agg(*[F.sum(x[i] * x[j]).alias(f"c{k}") for k, (i, j) in enumerate(cells)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{k}").alias("value")) for k, (i, j) in enumerate(cells)])).alias("c")).select("c.*")


def ridge(rows: DataFrame, features: list[str], target: str, penalty: float = 1.0) -> np.ndarray:
    """(bias, weights...) of ridge regression; the bias is not penalised."""
    n = len(features) + 2
    m = np.zeros((n, n))
    for i, j, v in normal_equations(rows, features, target).collect():
        m[i, j] = m[j, i] = v
    a = m[:-1, :-1] + penalty * np.diag([0.0] + [1.0] * len(features))
    return np.linalg.solve(a, m[:-1, -1])


def folds(rows: DataFrame, hashed: str, order: list[str], k: int = 5) -> DataFrame:
    """``rows`` with ``fold``: every k-th row in order of a hex hash."""
    return numbered(rows, hashed, order, "_number").withColumn("fold", F.pmod(F.col("_number") - 1, F.lit(k)).cast("int")).drop("_number")


def linear(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys..., intercept, slope, r2); slope 0 and r2 0 without variance in x, r2 0 without variance in y."""
    g = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.regr_r2(y, x).alias("r"), F.avg(y).alias("m"), F.var_pop(y).alias("vy"), F.var_pop(x).alias("vx"))
    flat = F.col("vx") == 0
    return g.select(*keys, F.when(flat, F.col("m")).otherwise(F.col("i")).alias("intercept"), F.when(flat, F.lit(0.0)).otherwise(F.col("s")).alias("slope"), F.when(flat | (F.col("vy") == 0), F.lit(0.0)).otherwise(F.col("r")).alias("r2"))


def through_origin(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys..., slope, r2) of y = slope x, r2 against zero."""
    g = rows.groupBy(*keys).agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(y) * F.col(y)).alias("yy"))
    safe = F.when((F.col("xx") != 0) & (F.col("yy") != 0), F.col("xx"))
    return g.select(*keys, F.coalesce(F.col("xy") / safe, F.lit(0.0)).alias("slope"), F.coalesce(F.col("xy") * F.col("xy") / (safe * F.when(F.col("yy") != 0, F.col("yy"))), F.lit(0.0)).alias("r2"))


def _gram(cells: list) -> np.ndarray:
    n = max(c["j"] for c in cells) + 1
    m = np.zeros((n, n))
    for c in cells:
        m[c["i"], c["j"]] = m[c["j"], c["i"]] = c["value"]
    return m


def _solved(gram: np.ndarray, use: list[int]) -> np.ndarray:
    """Coefficients (constant first) of the target on the features ``use`` (from 1), from X'X with the target last."""
    at = [0, *use]
    return np.linalg.lstsq(gram[np.ix_(at, at)], gram[at, -1], rcond=None)[0]


def ols_search(rows: DataFrame, features: list[str], target: str, most: int = 3) -> list[tuple[tuple[str, ...], float]]:
    """(features, R2) of every subset of up to ``most`` features, best first, smaller and earlier subsets first of equals.

    The rows are read once, for X'X; every subset is solved from it.
    """
    from itertools import combinations

    gram = _gram(normal_equations(rows, features, target).collect())  # as many cells as pairs of features
    yy, mean = gram[-1, -1], gram[0, -1] ** 2 / max(gram[0, 0], 1.0)
    out = []
    for size in range(1, most + 1):
        for use in combinations(range(1, len(features) + 1), size):
            at = [0, *use]
            fitted = float(_solved(gram, list(use)) @ gram[at, -1])
            out.append((tuple(features[k - 1] for k in use), float((fitted - mean) / (yy - mean)) if yy > mean else 0.0))
    return sorted(out, key=lambda x: (-round(x[1], 9), len(x[0])))


def forward_selection(rows: DataFrame, features: list[str], target: str, fold: str, most: int | None = None) -> list[tuple[str, float]]:
    """(feature, mean absolute error) in order of choice: each round adds the feature with the least cross-validated
    error, while it falls. ``fold`` numbers the folds from 0.

    X'X is one aggregate by fold; a fold's model is solved from the others' sum, and all candidates of a round are
    judged in one pass.
    """
    cells = [(i, j) for i in range(len(features) + 2) for j in range(i, len(features) + 2)]
    x = [F.lit(1.0), *[F.col(f) for f in features], F.col(target)]
    sums = {r[fold]: _gram([{"i": i, "j": j, "value": r[f"c{k}"]} for k, (i, j) in enumerate(cells)]) for r in rows.groupBy(fold).agg(*[F.sum(x[i] * x[j]).alias(f"c{k}") for k, (i, j) in enumerate(cells)]).collect()}
    whole = sum(sums.values())
    chosen: list[int] = []
    out: list[tuple[str, float]] = []
    while len(chosen) < (most or len(features)):
        trial = {}
        for k in range(1, len(features) + 1):
            if k not in chosen:
                use = [*chosen, k]
                error = F.lit(None).cast("double")
                for f, own in sums.items():
                    w = _solved(whole - own, use)
                    guess = F.lit(float(w[0]))
                    for c, j in zip(w[1:], use):
                        guess = guess + F.lit(float(c)) * x[j]
                    error = F.when(F.col(fold) == f, F.abs(F.col(target) - guess)).otherwise(error)
                trial[k] = F.avg(error).alias(f"e{k}")
        errors = rows.agg(*trial.values()).first()
        best = min(trial, key=lambda k: (errors[f"e{k}"], k))
        if out and errors[f"e{best}"] >= out[-1][1]:
            break
        chosen.append(best)
        out.append((features[best - 1], errors[f"e{best}"]))
    return out


def floored_log_fit(rows: DataFrame, x: str, y: str, floor: float) -> DataFrame:
    """``rows`` with ``fitted``: a + b ln(max(1, x)) by least squares, at least ``floor``."""
    line = linear(rows.select(F.ln(F.greatest(F.lit(1.0), F.col(x))).alias("_x"), F.col(y).alias("_y")), [], "_x", "_y").select("intercept", "slope")
    fitted = F.greatest(F.lit(floor), F.col("intercept") + F.col("slope") * F.ln(F.greatest(F.lit(1.0), F.col(x))))
    return rows.crossJoin(F.broadcast(line)).withColumn("fitted", fitted).drop("intercept", "slope")
