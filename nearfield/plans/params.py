"""Parameters of an index, and the choice between exact and approximate search."""

from __future__ import annotations

import dataclasses
import json
import math

HEURISTICS = ("simple", "diverse", "first")
MOST_LEVEL = 31


@dataclasses.dataclass(frozen=True)
class IndexParams:
    """m: links of a node by layer (twice that in layer 0). heuristic: `simple` keeps the nearest candidates,
    `diverse` those nearer to the node than to any kept one, `first` the nearest only, or with keep_pruned the nearest.
    gamma over 1 or optimize_for_filtering widen layers for filtered search; mb: links that are kept whole then."""

    m: int = 10
    level_lambda: float | None = None
    heuristic: str = "simple"
    ef_construction: int = 200
    expand_best: bool = False
    keep_pruned: bool = False
    optimize_for_filtering: bool = False
    gamma: int = 1
    mb: int = 10
    metric: str = "cosine"
    seed: int = 0

    def __post_init__(self):
        if self.m < 2:
            raise ValueError("m must be 2 or more")
        if self.heuristic not in HEURISTICS:
            raise ValueError(f"heuristic must be one of {HEURISTICS}")
        if self.ef_construction < 1 or self.gamma < 1 or self.mb < 0:
            raise ValueError("ef_construction and gamma must be positive, mb not negative")
        if self.metric not in ("cosine", "cosine_units", "l2sq", "l1", "inner_product"):
            raise ValueError(f"no metric {self.metric}")

    @property
    def decay(self) -> float:
        return 1 / math.log(self.m) if self.level_lambda is None else self.level_lambda

    def degree(self, layer: int) -> int:
        return self.m * (2 if layer == 0 else 1) * (self.gamma if self.optimize_for_filtering else 1)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> IndexParams:
        return IndexParams(**json.loads(text))


def strategy(n_items: int, n_queries: int, selectivity: float = 1.0, exact_below: int = 100_000, least_selectivity: float = 0.05) -> str:
    """`exact` where a scan of what passes the filter is small, `filtered` search of the graphs under a filter, else `ann`."""
    if n_items * selectivity <= exact_below or selectivity < least_selectivity:
        return "exact"
    return "filtered" if selectivity < 1 else "ann"
