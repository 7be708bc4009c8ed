"""Parameters, with the checks on their ranges."""

from __future__ import annotations

from dataclasses import dataclass, field

from strandlake.operators.kernels import Scores


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class DiscoverParams:
    l: int | None = None  # noqa: E741
    scores: Scores = field(default_factory=Scores)
    max_occurrences: int = 10_000
    max_families: int = 100_000
    max_entropy: float = -0.70
    good_length: int = 30
    min_threshold: int = 2
    tandem: int = 500

    def __post_init__(self) -> None:
        _check(self.l is None or 4 <= self.l <= 31, "l is 4..31")
        _check(self.min_threshold >= 2, "min_threshold is at least 2")
        _check(self.max_families >= 1 and self.max_occurrences >= 2, "caps are positive")


@dataclass(frozen=True)
class RefineParams:
    max_divergence: float = 0.30
    gap: int = -5
    band: int = 12
    max_instances: int = 10_000
    max_seed_hits: int = 50_000
    max_dp_cells: int = 10_000_000
    rounds: int = 10
    recruit_short: bool = False

    def __post_init__(self) -> None:
        _check(0 <= self.max_divergence <= 1, "max_divergence is 0..1")
        _check(1 <= self.band <= 32, "band is 1..32")
        _check(self.max_instances >= 2, "max_instances is at least 2")
        _check(self.max_seed_hits >= self.max_instances, "max_seed_hits is at least max_instances")
        _check(self.max_dp_cells >= 1, "max_dp_cells is positive")


@dataclass(frozen=True)
class LibraryParams:
    mode: str = "exact"
    coalesce_factor: float = 20.0
    chunk: int = 20_000_000  # a discovery task holds some 70 bytes for each base of its chunk
    overlap: int = 10_000
    most_neighbours: int = 4_000_000_000  # neighbouring instances beyond which fragments are not assembled

    def __post_init__(self) -> None:
        _check(self.mode in ("none", "exact", "upper"), "mode is none, exact or upper")
        _check(self.coalesce_factor >= 0, "coalesce_factor is 0 or more")
        _check(self.chunk >= 1000, "chunk is at least 1000 bases")


@dataclass(frozen=True)
class RescueParams:
    """The second discovery pass: shorter seeds over what the first pass leaves uncovered (or everywhere)."""

    l_delta: int = 1
    max_families: int = 2000
    least_gap: int = 200
    flank: int = 10_000
    full: bool = False

    def __post_init__(self) -> None:
        _check(0 <= self.l_delta <= 8, "l_delta is 0..8")
        _check(self.max_families >= 1, "max_families is positive")
        _check(self.least_gap >= 1 and self.flank >= 0, "least_gap is positive, flank 0 or more")


@dataclass(frozen=True)
class SampleParams:
    """Discovery in a sample of whole windows of genomes beyond ``size`` bases."""

    size: int = 1_000_000_000
    window: int = 1_000_000
    seed: int = 42

    def __post_init__(self) -> None:
        _check(self.size >= self.window >= 1, "size is at least a window, which is positive")


@dataclass(frozen=True)
class Params:
    discover: DiscoverParams = field(default_factory=DiscoverParams)
    refine: RefineParams = field(default_factory=RefineParams)
    library: LibraryParams = field(default_factory=LibraryParams)
    rescue: RescueParams | None = None
    sample: SampleParams | None = None
