"""The two logistic models of flat documents, as numbers and as column expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Logistic:
    """A logistic model over standardised features."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    threshold: float | None = None
    top_terms: int | None = None

    def __post_init__(self) -> None:
        if not len(self.features) == len(self.weights) == len(self.means) == len(self.deviations):
            raise ValueError(f"a model of {len(self.features)} features needs as many weights, means and deviations")

    def score(self, x: Sequence[float]) -> float:
        """Probability of one row."""
        z = self.bias + sum(w * (v - m) / s for w, v, m, s in zip(self.weights, x, self.means, self.deviations) if s)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def column(self, *x: Column) -> Column:
        """Probability as a column of the features' columns, in order."""
        z = F.lit(self.bias)
        for w, v, m, s in zip(self.weights, x, self.means, self.deviations):
            if s:
                z = z + F.lit(w) * (v - F.lit(m)) / F.lit(s)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))

    def sql(self, *x: str) -> str:
        """The same as SQL."""
        z = " + ".join([repr(self.bias), *(f"({w!r}) * ({v} - ({m!r})) / {s!r}" for w, v, m, s in zip(self.weights, x, self.means, self.deviations) if s)])
        return f"1 / (1 + exp(-greatest(-30.0, least(30.0, {z}))))"

    @classmethod
    def from_json(cls, text: str) -> Logistic:
        """A model from its artifact; the error names the field that is missing or wrong."""
        try:
            data = json.loads(text)
        except ValueError as e:
            raise ValueError(f"model: not JSON: {e}") from e
        for name in ("featureNames", "w", "b", "mu", "sd"):
            if name not in data:
                raise ValueError(f"model: missing field {name}")
        return cls(tuple(data["featureNames"]), tuple(map(float, data["w"])), float(data["b"]), tuple(map(float, data["mu"])), tuple(map(float, data["sd"])), data.get("tau"), data.get("topTermCount"))


# The trained models' parameters.
AFFINITY = Logistic(
    features=("emb_cos", "tfidf_cos", "topterm_jaccard", "cite_jaccard", "position"),
    weights=(0.5626017000605562, 0.2335682420655066, 0.024632810693071265, 0.02798862489665663, 1.4330885170120002),
    bias=-1.0443562466764533,
    means=(0.24688228942538978, 0.07186618209060634, 0.02495293164846296, 0.020636126808092885, 0.6536917318815924),
    deviations=(0.17146439115071269, 0.09755578738949446, 0.06127984120025635, 0.11666023099655692, 0.23070482763053077),
)
TOP_TERMS = 15
MERGE_STOP = Logistic(
    features=(
        "sim", "margin", "min_size_frac", "total_size_frac", "adjacent", "mean_index_gap_frac", "cohesion", "clusters_remaining_frac",
        "cross_min", "cross_std", "emb_avglink", "tfidf_avglink", "cohesion_contrast",
    ),
    weights=(
        -0.09641074597156828, 0.1502554240113165, -0.024820013403635138, -0.5311695253039547, 0.43454857472711417, 0.02055894227330161, 0.13248469533955312,
        1.4871969047811173, 0.2920892987978486, -0.6126884701094879, 0.1261360459169976, 0.3835086104235394, -0.3718167973786198,
    ),
    bias=-1.3177627698693464,
    means=(
        0.6346021587712433, 0.08475359044142987, 0.16292678095819807, 0.43068762307909836, 0.9161096256684492, 0.223230640839616, 0.8418293059659234,
        0.7986369668001078, 0.5442142270696453, 0.07407969760330153, 0.4356921840308282, 0.19813512758982205, -0.20722714719468027,
    ),
    deviations=(
        0.24451101205331333, 0.09022531242895475, 0.10601139912750364, 0.2837106607114447, 0.27722333853062064, 0.1420576532502139, 0.1829299571229853,
        0.25797678571538074, 0.32560882106706335, 0.08548569852740295, 0.18319123293902035, 0.16795314485603155, 0.12858189582961624,
    ),
)
MERGE_STOP_THRESHOLD = 0.6
