"""Decisions of the iterative loop, as plain functions of numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Bounds on iterations and seconds; a negative one is off."""

    iterations: int = -1
    without_improvement: int = -1
    after_blind: int = -1
    after_blind_without_improvement: int = -1
    seconds: float = -1
    seconds_without_improvement: float = -1
    seconds_after_blind: float = -1
    seconds_after_blind_without_improvement: float = -1


@dataclass(frozen=True)
class Blind:
    """When results are taken whatever their score; a negative bound is off."""

    on_worse_score: bool = False
    after_iterations: int = -1
    after_without_improvement: int = -1
    after_seconds: float = -1
    after_seconds_without_improvement: float = -1


def subset_cap(size: int, fraction: float, leaves: int) -> int:
    """The larger of an absolute size and a fraction of the leaves."""
    return max(size, math.ceil(fraction * leaves))


def mask_bound(bound: float, n_taxa: int) -> float:
    """A bound below 1 is a share of the rows, rounded down."""
    return float(int(n_taxa * bound)) if bound < 1 else bound


def auto_defaults(n_taxa: int) -> dict[str, float]:
    """Settings that follow from the number of sequences. Those of the original's rule."""
    large = n_taxa > 400
    return {
        "max_subproblem_size": 200 if large else math.ceil(n_taxa / 2),
        "max_subproblem_frac": 0.0 if large else 0.5,
        "mask_gappy_sites": max(n_taxa / 1000, 1),
        "iter_limit": 3,
        "blind_after_total_iter": 0,
    }


def stop_reason(limits: Limits, iteration: int, last_improved: int, blind_since: int | None, now: float = 0, improved_at: float = 0, blind_at: float | None = None) -> str | None:
    """Which limit ends the loop, or None. Numbers of iterations end it when reached, seconds when passed.

    Without improvement counts from the improvement, blind or not; only the seconds without
    improvement after blindness count from its beginning.
    """
    since = iteration - last_improved
    blind = blind_since is not None
    seconds_blind = now - blind_at if blind_at is not None else 0.0
    checks = [
        ("iterations", limits.iterations, iteration, True, True),
        ("without_improvement", limits.without_improvement, since, True, True),
        ("after_blind", limits.after_blind, iteration - (blind_since or 0), blind, True),
        ("seconds", limits.seconds, now, True, False),
        ("seconds_without_improvement", limits.seconds_without_improvement, now - improved_at, True, False),
        ("seconds_after_blind", limits.seconds_after_blind, seconds_blind, blind_at is not None, False),
        ("seconds_after_blind_without_improvement", limits.seconds_after_blind_without_improvement, seconds_blind, blind_at is not None, False),
        ("after_blind_without_improvement", limits.after_blind_without_improvement, since, blind, True),
    ]
    return next((name for name, most, value, applies, counted in checks if applies and most >= 0 and (value >= most if counted else value > most)), None)


def accept_blindly(rule: Blind, score: float, best: float | None, iteration: int, since_improved: int, now: float = 0, improved_at: float = 0, blind: bool = False, last_strategy: bool = True) -> bool:
    """Whether a result is taken whatever its score. Not before the last way of cutting has been tried; once blind, always."""
    if not last_strategy:
        return False
    return (
        blind
        or (rule.on_worse_score and best is not None and score <= best)
        or 0 <= rule.after_iterations <= iteration
        or 0 <= rule.after_without_improvement <= since_improved
        or 0 <= rule.after_seconds < now
        or 0 <= rule.after_seconds_without_improvement < now - improved_at
    )
