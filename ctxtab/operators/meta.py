"""Driver-side metadata helpers (S11, C7, C11, E9, R10; S4 and Q6 live with
their sources and retrieval).  They decide which column expressions the
DataFrame operators emit and move no data themselves.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PipelineSpec:
    """What each ensemble member does (a dict of step settings) and the run-time knobs."""
    members: tuple[dict, ...]
    softmax_temperature: float = 0.9
    seed: int = 0

    def __post_init__(self):
        if len(self.members) == 0:
            raise ValueError("an ensemble needs at least one member")

    @classmethod
    def load(cls, source: list | str, **knobs) -> PipelineSpec:
        """Members given as dicts, or named by the path of a JSON file that lists them."""
        if not isinstance(source, str):
            return cls(tuple(source), **knobs)
        with open(source, encoding="utf-8") as f:
            return cls(tuple(json.load(f)), **knobs)

    def with_overrides(self, config: list | str | None = None, **knobs) -> PipelineSpec:
        """The same spec with other members, temperature or seed; what is None stays."""
        changes = {k: v for k, v in knobs.items() if v is not None}
        if config is not None:
            changes["members"] = PipelineSpec.load(config).members
        return replace(self, **changes)


def _rotated(columns: list[str], offset: int, seed: int) -> list[str]:
    k = -offset % max(len(columns), 1)
    return columns[k:] + columns[:k]


def _dealt(columns: list[str], offset: int, seed: int) -> list[str]:
    return random.Random(seed).sample(columns, len(columns))


ORDERINGS = {None: lambda columns, offset, seed: list(columns), "rotate": _rotated, "shuffle": _dealt}


def shuffle_features(columns: list[str], categorical: list[str], mode: str | None = "shuffle",
                     offset: int = 0, seed: int = 0) -> tuple[list[str], list[str]]:
    """Columns in a seeded, rolled or unchanged order, and which of them are
    categorical.  Apply with ``df.select(order)``."""
    if mode not in ORDERINGS:
        raise ValueError(f"feature order {mode!r} is none of {sorted(map(str, ORDERINGS))}")
    order = ORDERINGS[mode](columns, offset, seed)
    return order, [c for c in order if c in set(categorical)]


def check_features(train: DataFrame, test: DataFrame, features: list[str], label: str = "y") -> None:
    """C11: the test side must carry every train feature (schema-level check);
    the label column must exist on the train side.  Lengths of x and y agree by
    construction (they are columns of one row)."""
    missing = [c for c in features if c not in test.columns]
    if missing:
        raise ValueError(f"test data lacks train features: {missing}")
    if label not in train.columns:
        raise ValueError(f"train data has no label column {label!r}")


def passthrough(df: DataFrame) -> DataFrame:
    """The ``numeric`` / ``none`` encoding strategies leave columns as they are."""
    return df


# The transform tags with a meaning (any other tag is the identity)
KNOWN_TAGS = ("quantile_uniform_10", "quantile_uniform_5", "quantile_uniform_all_data", "quantile_norm_10",
              "quantile_norm_5", "quantile_norm_all_data", "power", "logNormal", "robust", "kdi_uni", "kdi_norm",
              "norm_and_kdi")


def resolve_tag(tag: str | None, strict: bool = False) -> str:
    """A missing or unknown worker tag means the identity transform
    (``strict`` raises instead); ``kdi_*_alpha_<a>`` tags are known."""
    if tag is None:
        return "identity"
    if tag in KNOWN_TAGS or tag.startswith(("kdi_uni_alpha_", "kdi_norm_alpha_")):
        return tag
    if strict:
        raise ValueError(f"unknown transform tag: {tag}")
    return "identity"
