"""Thresholds of the quality rules (fixed values, each can be replaced by an argument)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AuditRules:
    # fixed values: gates of the channel audit
    triangle_tol: float = 0.10
    violation_share: float = 0.02
    volt_min: float = 1.0
    volt_max: float = 300.0
    min_points: int = 10
    min_unique: int = 10
    live_min: float = 0.05
    stuck_share: float = 0.5
    redundant_r2: float = 0.95
    strong_r2: float = 0.99
    reverse_normal: float = 0.05
    reverse_mixed: float = 0.80
    coherence_ratio: float = 5.0
    limit_factor: float = 1.5


@dataclass(frozen=True)
class ScopeRules:
    # fixed values: gates of the meter scope
    dominance: float = 0.80
    min_unique: int = 4
    amp_eps: float = 1e-9
    min_finite: int = 10
    max_sentinel_pct: float = 60.0
    min_useful_pct: float = 40.0
    min_coverage: float = 0.50
    corr: float = 0.999
    magnitude_tol: float = 0.05
    min_overlap: int = 200
    interleave_overlap: float = 0.05
    interleave_union: float = 0.80
    partial_coverage: float = 0.90


@dataclass(frozen=True)
class CleanRules:
    # fixed values: placeholders and outliers
    floor_min_count: int = 50
    floor_min_share: float = 0.005
    floor_dominance: int = 20
    bridge: int = 35
    context: int = 360
    min_context: int = 30
    min_run: int = 3
    z: float = 5.0
    amp_share: float = 0.025
    flat_ratio: float = 0.85
    outlier_run: int = 5
    envelope_k: float = 5.0
    forbidden_radius: int = 3
    hampel_half: int = 30
    hampel_min: int = 21
    hampel_z: float = 8.0
    min_jump: float = 0.03
    min_reference: int = 30


AUDIT = AuditRules()
SCOPE = ScopeRules()
CLEAN = CleanRules()
