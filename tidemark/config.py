"""Study parameters. Horizons and windows count sessions of the calendar in use.

Fixed values: the defaults of ``daily``, and its horizons, slope windows and trail weeks by holding period.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Config:
    """Defaults fit monthly sessions; ``daily`` gives the usual ones for trading days."""

    holding_months: int = 3
    n_bands: int = 5
    horizons: tuple[int, ...] = (3, 6, 12)
    slope_window: int = 6
    sma_filter: bool = True
    sma_window: int = 10
    min_history: int = 13
    min_count: int = 5
    large_sessions: bool = False  # sessions of more tickers than a task should hold
    winsor: float = 3.0
    max_share_price: float = 1500.0
    sector_neutral: bool = False
    n_names: int = 3
    capital: float = 100_000.0
    commission: float = 1.5
    spread_bps: float = 3.0
    rf_monthly: float = 0.002
    n_bootstrap: int = 1000
    seed: int = 12345

    @classmethod
    def daily(cls, holding_months: int = 3, **more) -> Config:
        by_holding = {1: ((21, 63, 126), 21), 3: ((63, 126, 252), 63), 6: ((126, 252), 126)}
        if holding_months not in by_holding:
            raise ValueError(f"holding_months must be one of {sorted(by_holding)}")
        horizons, slope = by_holding[holding_months]
        return cls(**{"holding_months": holding_months, "horizons": horizons, "slope_window": slope, "sma_window": 200, "min_history": 273, "min_count": 20, "n_names": 30} | more)

    @property
    def trail_weeks(self) -> int:
        """Weeks of a trail on the map, by the holding period."""
        return {1: 4, 3: 13, 6: 26}[self.holding_months]

    @property
    def n_tranches(self) -> int:
        return self.holding_months

    @property
    def advertised_slot(self) -> float:
        return self.capital / self.n_names

    @property
    def effective_slot(self) -> float:
        """What a tranche spends on a name at first."""
        return self.capital / self.n_tranches / self.n_names

    @property
    def round_trip_bps(self) -> float:
        return 2 * self.commission / self.advertised_slot * 1e4 + 2 * self.spread_bps

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def fingerprint(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:12]
