"""Parameters of a selection run."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class SelectionConfig:
    sensitive: str = "z"
    label: str = "y"
    dev_ratio: float = 0.2
    n_clusters: int = 8
    m_neighbors: int = 5
    k_shots: int = 5
    iterations: int = 10
    alpha: float = 0.5
    floor: float = 0.05
    metric_pred: str = "f1_score"
    metric_fair: str = "ratio_eo"
    max_dev_samples: int = 50
    max_test_samples: int = 100
    k_neighbors: int = 5
    search_rounds: int = 5
    batch_size: int = 10
    lloyd_rounds: int = 300
    lloyd_starts: int = 10
    seeding: str = "parallel"
    seed: int = 42

    def __post_init__(self):
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be in [0, 1]")
        if not 0 < self.dev_ratio < 1:
            raise ValueError("dev_ratio must be in (0, 1)")
        if min(self.n_clusters, self.m_neighbors, self.k_neighbors, self.batch_size) < 1:
            raise ValueError("sizes must be positive")

    def key(self) -> str:
        """A content key of the parameters, for whatever is stored between runs."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]
