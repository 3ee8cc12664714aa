"""Parameters of k-mer operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class KmerConfig:
    """K-mer length, window length, strand handling, store and alphabet of a run."""

    k: int = 31
    w: int = 31
    canonical: bool = False
    store: str = "exact"
    alphabet: str = "DNA"
    interval: int = 500_000

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k must be positive")
        if self.store not in ("exact", "bloom", "cms8", "cms4", "cqf", "hll"):
            raise ValueError(f"unknown store {self.store}")
