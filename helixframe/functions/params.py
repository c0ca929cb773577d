"""Parameters of the overlapper."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class OverlapParams:
    """k: word length (at most 31). lower, upper: reliable band of total occurrences, inclusive. xdrop: score drop that
    ends an extension. error_rate sets the slope of the score threshold, score_deviation is its slack, bin_width joins
    overlap estimates. window > 0 takes minimizers, syncmers takes closed syncmers (and overrides window), hopc
    compresses homopolymers. fixed_threshold >= 0 replaces the adaptive one. n_policy `drop` leaves words with other
    letters than ACGT out, `as_g` reads N as G. compat counts shared words as the folded count of bins does. forward_coords
    gives the span of h on its own strand, as PAF lines always do. band > 0 aligns in an adaptive band of so many cells
    instead of all that the drop leaves."""

    k: int = 17
    lower: int = 2
    upper: int = 8
    xdrop: int = 7
    error_rate: float = 0.15
    estimate_error: bool = False
    skip_alignment: bool = False
    score_deviation: float = 0.1
    bin_width: int = 500
    window: int = 0
    syncmers: bool = False
    smer: int = 5
    hopc: bool = False
    fixed_threshold: int = -1
    n_policy: str = "drop"
    compat: bool = False
    forward_coords: bool = False
    band: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.k <= 31:
            raise ValueError("k must be from 1 to 31")
        if self.syncmers and self.smer >= self.k:
            raise ValueError("syncmers need k over their inner word length")
        if not 0 <= self.score_deviation <= 1:
            raise ValueError("score_deviation must be in [0, 1]")
        if self.lower < 1 or self.upper < self.lower:
            raise ValueError("the reliable band is empty")
        if self.band < 0 or self.band == 1:
            raise ValueError("a band has two cells or more")
        if self.n_policy not in ("drop", "as_g"):
            raise ValueError("n_policy is drop or as_g")
