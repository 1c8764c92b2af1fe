"""Scoring, seeding and filter parameters, their derived defaults and their limits."""

from __future__ import annotations

from dataclasses import dataclass, replace


def parse_int(text: str) -> int:
    """An integer option: ``0x``, ``0d``, ``0b`` or a leading 0 (octal) choose the base.

    Multiplier suffixes are refused rather than read and ignored.
    """
    s = text.strip()
    sign = -1 if s.startswith("-") else 1
    s = s.lstrip("+-")
    for mark, base in (("0x", 16), ("0d", 10), ("0b", 2)):
        if s.lower().startswith(mark):
            return sign * int(s[2:], base)
    return sign * int(s, 8 if len(s) > 1 and s[0] == "0" else 10)


def default_gapless(m: int, x: int) -> int:
    """Threshold of the gapless filter that goes with match ``m`` and mismatch ``x``."""
    return int(15.0 * x / (m + x))


def default_xdrop(m: int, gi: int, ge: int) -> int:
    return 15 * (m + 2 * ge) + gi


def default_score(m: int) -> int:
    return 100 * m


@dataclass(frozen=True)
class Params:
    """``k`` k-mer length; ``repeat`` most hits of a seed; ``m x gi ge`` scores (penalties positive).

    ``xdrop``, ``gapless`` and ``score`` at 0 take their defaults. ``overlap`` is the half
    width of the band in which a seed counts as covered. ``depth`` is accepted and has no
    effect.
    """

    k: int = 14
    repeat: int = 30
    depth: int = 3
    m: int = 1
    x: int = 2
    gi: int = 2
    ge: int = 1
    xdrop: int = 0
    gapless: int = 0
    score: int = 0
    overlap: int = 48
    clip: str = "H"

    def __post_init__(self) -> None:
        if not 4 <= self.k <= 32:
            raise ValueError("k must be 4 to 32")
        if min(self.m, self.x) < 0 or min(self.gi, self.ge) < 0 or self.m == 0:
            raise ValueError("scores must not be negative, and a match must score")
        if self.gi:
            if self.m + 2 * (self.gi + self.ge) > 31 or self.ge > self.gi or self.gi + self.ge > 7:
                raise ValueError("affine gaps need m + 2 (gi + ge) <= 31, ge <= gi and gi + ge <= 7")
        elif self.m + 2 * self.ge > 255:
            raise ValueError("linear gaps need m + 2 ge <= 255")
        if self.xdrop > 127:
            raise ValueError("xdrop must be 127 at most")
        if self.clip not in ("H", "S"):
            raise ValueError("clip is H or S")

    def resolved(self) -> Params:
        """With the derived defaults filled in."""
        return replace(
            self,
            xdrop=self.xdrop or default_xdrop(self.m, self.gi, self.ge),
            gapless=self.gapless or default_gapless(self.m, self.x),
            score=self.score or default_score(self.m),
        )

    @property
    def affine(self) -> bool:
        return self.gi > 0


BWA = Params(k=14, repeat=500, m=1, x=4, gi=6, ge=1, xdrop=100, score=30, clip="S")
