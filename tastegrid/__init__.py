"""Recommendation analytics as composable Spark DataFrame operators.

Every operator takes DataFrames plus a frozen config and returns a DataFrame; it starts no job, owns no session and
caches nothing.  The functions in ``tastegrid.plans`` compose operators; those whose name starts with ``run_`` are jobs
and write tables.
"""

from tastegrid.config import (
    AlsConfig,
    BlendConfig,
    EvalConfig,
    FallbackConfig,
    GridConfig,
    PrecomputeConfig,
    ServeConfig,
    SplitConfig,
)
from tastegrid.session import apply_session_settings

__all__ = [
    "AlsConfig",
    "BlendConfig",
    "EvalConfig",
    "FallbackConfig",
    "GridConfig",
    "PrecomputeConfig",
    "ServeConfig",
    "SplitConfig",
    "apply_session_settings",
]
