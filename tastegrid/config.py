"""Settings of the operators, as immutable values."""

from __future__ import annotations

from dataclasses import dataclass

# The rating scale, the bucket count and the accepted behaviour events.
MIN_RATING = 0.5
MAX_RATING = 5.0
USER_BUCKETS = 64
EVENT_TYPES = ("click", "view", "rate", "skip")

# Scores are compared in steps of one billionth wherever they order rows.  A distributed average may differ in its last
# bits from one run to the next, because partial sums merge in any order; without this, ranks could change on a rerun.
ORDER_SCALE = 1e9


@dataclass(frozen=True)
class BlendConfig:
    """Weights of the hybrid score and of the re-ranking terms."""

    als_weight: float = 0.7
    content_weight: float = 0.3
    genre_boost: float = 0.12
    popularity_boost: float = 0.08
    recency_boost: float = 0.03
    diversity_penalty: float = 0.08
    candidate_top_k: int = 50
    # "candidates": oldest and newest year among the scored rows; "catalog": among all items.
    recency_extent: str = "candidates"


@dataclass(frozen=True)
class FallbackConfig:
    top_n: int = 10
    min_rating_count: int = 20


@dataclass(frozen=True)
class PrecomputeConfig:
    top_n: int = 50
    # Candidates per user beyond those needed, to make up for the ones that the user has already seen.
    over_fetch: int = 0
    buckets: int = USER_BUCKETS


@dataclass(frozen=True)
class SplitConfig:
    test_share: float = 0.2
    seed: int = 42


@dataclass(frozen=True)
class AlsConfig:
    rank: int = 20
    max_iter: int = 10
    reg_param: float = 0.1
    seed: int = 42
    nonnegative: bool = True
    implicit_prefs: bool = False
    cold_start: str = "drop"
    # Blocks of the factor matrices; None: two for five tasks that the session runs at once, five at least.
    blocks: int | None = None


@dataclass(frozen=True)
class GridConfig:
    ranks: tuple[int, ...] = (16, 32)
    reg_params: tuple[float, ...] = (0.05, 0.1)
    max_iters: tuple[int, ...] = (10, 15)


@dataclass(frozen=True)
class EvalConfig:
    k: int = 10
    relevant_threshold: float = 4.0
    # True also averages users with relevant items but without any recommendation (as zeros).
    include_missing: bool = False

    def __post_init__(self) -> None:
        if self.k <= 0:
            raise ValueError("k must be positive")


@dataclass(frozen=True)
class ServeConfig:
    default_top_n: int = 10
    allow_als_legacy: bool = False
    because_length: int = 5
    trending_min: int = 3
    trending_max: int = 10
