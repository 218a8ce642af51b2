"""Settings that change results. They are passed explicitly; nothing is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass


def clamp(value: float, low: float, high: float) -> float:
    return max(low, min(high, value))


def switched_on(text: str) -> bool:
    """Whether a switch given as text is on: all but a few words for off."""
    return text.strip().lower() not in ("0", "false", "no", "off")


@dataclass(frozen=True)
class Settings:
    """`today` is the date that same-day rules expect; it is a parameter so that reruns agree."""

    today: str = "2024-01-02"
    page_width: int = 2400
    page_height: int = 1784
    max_candidates: int = 8
    review_limit: int = 12
    issue_limit: int = 4
    accept_confidence: float = 0.65
    cache_ttl_s: float = 1800.0
    lease_s: float = 1800.0
    review_mode: str = "hybrid"
    #: Whether caches are read and written, and whether issues are ranked by rule alone after a failed cleaning.
    caches: bool = True
    skip_triage_on_error: bool = True
    #: The model that is asked when another fails; none if empty.
    fallback_model: str = ""

    @property
    def reviews(self) -> int:
        """Reviews of a form, 0 to 29; 0 stands for all."""
        return int(clamp(self.review_limit, 0, 29))

    @property
    def issues(self) -> int:
        """Issues shown for a form, 1 to 8."""
        return int(clamp(self.issue_limit, 1, 8))

    @property
    def confidence(self) -> float:
        return clamp(self.accept_confidence, 0.0, 1.0)

    @property
    def lease(self) -> float:
        return clamp(self.lease_s, 60.0, 86400.0)
