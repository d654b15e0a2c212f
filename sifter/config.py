"""Job parameters (the reference's settings, as a plain frozen dataclass)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DigestConfig:
    """Parameters of one digest run.  Defaults equal the reference's defaults."""

    relevance_topics: tuple[str, ...] = ("AI orchestration", "fragrance design", "arbitrage/DeFi")
    # Label predicate of the incremental scan (all must be present).
    required_labels: tuple[str, ...] = ("UPDATES", "UNREAD", "IMPORTANT")
    initial_lookback_days: int = 7
    lookback_days_override: int | None = None
    token_budget: int = 4000
    triage_score_threshold: float = 0.5
    max_per_sender: int = 3
    max_synthesis_items: int = 25
    # The reference's `run` command never applies the per-sender cap to the
    # kept set (only its log line does); the triage API always does.
    cap_per_sender_in_run: bool = False
    dry_run: bool = False

    def __post_init__(self) -> None:
        if self.token_budget < 2:
            # stride = int(budget * 0.75) must be positive or windows never advance
            raise ValueError("token_budget must be >= 2 (window stride would be 0)")
        if self.max_per_sender < 1 or self.max_synthesis_items < 1:
            raise ValueError("caps must be positive")

    @property
    def window_stride(self) -> int:
        return int(self.token_budget * 0.75)
