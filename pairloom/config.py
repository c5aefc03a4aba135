"""Thresholds of the engine in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of selection, risk, sizing and simulation. Fixtures lower what needs long histories."""

    # universe
    least_rows: int = 300
    least_volume: float = 2.5e6
    least_close: float = 5.0
    least_universe: int = 30
    fallback_rows: int = 200
    fallback_top: int = 100
    # selection
    min_common: int = 420
    min_correlation: float = 0.25
    coint_p: float = 0.05
    half_life_low: float = 4.0
    half_life_high: float = 25.0
    min_score: float = 0.4
    factors: int = 5
    reselect_every: int = 90
    learned_rank: bool = False
    # signals
    entry_z: float = 1.8
    exit_z: float = 0.5
    adverse_z: float = 1.0
    # risk
    max_position: float = 0.10
    max_exposure: float = 0.30
    max_daily_trades: int = 8
    min_quality: float = 0.55
    min_strength: float = 0.5
    min_signal_z: float = 1.5
    max_volatility: float = 0.30
    min_volume: float = 1e6
    pause_loss: float = 0.03
    stop_drawdown: float = 0.15
    stop_day_loss: float = 0.05
    losses_to_rest: int = 3
    rest_days: int = 30
    max_cost: float = 0.01
    stop_days: int = 63
    stop_share: float = 0.20
    max_roughness: float = 0.55
    min_recent_correlation: float = 0.20
    wild_volatility: float = 0.08
    # sizing
    base_size: float = 0.04
    min_size: float = 0.03
    capital: float = 1e8


CONFIG = EngineConfig()
