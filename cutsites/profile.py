"""Parameters of one analysis: everything that differs between data sets."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class HotspotRule:
    """Part of a contig (as fractions of its length) whose sites are excluded."""

    chr: str
    lo: float | None = None
    hi: float | None = None
    lo_incl: bool = False
    hi_incl: bool = False
    species: str | None = None


@dataclass(frozen=True)
class Tier:
    """Regions supported by ``n_min`` to ``n_max`` library methods (None: no upper bound)."""

    label: str
    n_min: int
    n_max: int | None = None


@dataclass(frozen=True)
class RatioWindow:
    """Neighbourhood of the site ratio: ``offset`` bases beyond the 2 bp shoulder."""

    offset: int
    upstream_only: bool

    @property
    def tag(self) -> str:
        return f"{'u' if self.upstream_only else 'ud'}_{self.offset}"


@dataclass(frozen=True)
class Profile:
    methods: tuple[str, ...]
    tiers: tuple[Tier, ...]
    method_names: dict[str, str] = field(default_factory=dict)
    species: str | None = None
    species_codes: dict[str, str] = field(default_factory=dict)
    rep_names: dict[str, str] = field(default_factory=dict)
    drop_excluded: bool = False
    chr_allow: tuple[str, ...] = ()
    chr_deny: tuple[str, ...] = ()
    control_type: str | None = None
    edge_margin: int | None = None
    site_base_extra: bool = True
    hotspots: tuple[HotspotRule, ...] = ()
    ratio_windows: tuple[RatioWindow, ...] = (RatioWindow(100, True),)
    method_gap: int = 5
    pair: tuple[str, str] = ("TA", "TC")
    pair_gap: int = 5
    final_gap: int = 0
    identity_limits: dict[int, int] = field(default_factory=lambda: {4: 4, 10: 8})
    method_divisor: int = 4
    known_sites: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        # Picks of one method lie more than method_gap apart; with a pair gap no
        # larger than that a single-method region holds exactly one pick.
        if self.pair_gap > self.method_gap:
            raise ValueError("pair_gap must not exceed method_gap")

    @property
    def flank(self) -> int:
        """Extra bases fetched upstream of the site base, relative to the oligo length."""
        return 0 if self.site_base_extra else -1


# Names, accessions and bounds of the analysed data sets.
_FOUR_METHODS = {
    "ligation_oligo1": "L1",
    "ligation_oligo2": "L2",
    "tailing_polyA": "TA",
    "tailing_polyC": "TC",
}
_THREE_METHODS = {"ligation": "L1", "tailing_polyA": "TA", "tailing_polyC": "TC"}
_FOUR_TIERS = (Tier("t0", 4), Tier("t1", 3, 3), Tier("t2", 2, 2))
_THREE_TIERS = (Tier("t0", 3), Tier("t1", 2, 2))

PROFILE_HUMAN = Profile(
    methods=("L1", "L2", "TA", "TC"),
    tiers=_FOUR_TIERS,
    method_names=_FOUR_METHODS,
    species="human",
    chr_allow=tuple(f"chr{n}" for n in [*range(1, 23), "X"]),
    hotspots=(
        HotspotRule("chr9", lo=0.875),
        HotspotRule("chr13", lo=0.625),
        HotspotRule("chr22", lo=0.375, hi=0.5, lo_incl=True, hi_incl=True),
    ),
    known_sites=(
        "human|chr9|36072740|+",
        "human|chr10|92204290|-",
        "human|chr10|114168181|-",
        "human|chr15|34743730|+",
    ),
)

PROFILE_MULTI = Profile(
    methods=("L1", "L2", "TA", "TC"),
    tiers=_FOUR_TIERS,
    method_names=_FOUR_METHODS,
    rep_names={"rep1": "r1", "rep2": "r2", "rep3": "r3"},
    drop_excluded=True,
    hotspots=(
        HotspotRule("NC_000077.7", hi=0.03, species="mouse"),
        HotspotRule("NC_000083.7", lo=0.42, hi=0.43, lo_incl=True, hi_incl=True, species="mouse"),
    ),
)

PROFILE_CONTROL = Profile(
    methods=("L1", "TA", "TC"),
    tiers=_THREE_TIERS,
    method_names=_THREE_METHODS,
    species_codes={"Arabidopsis": "Ar", "Aspergillus": "As", "Drosophila": "Dr", "Trichoderma": "Tr"},
    chr_deny=("chrPt", "chrMt"),
    control_type="endo",
    edge_margin=100,
    site_base_extra=False,
    hotspots=(
        HotspotRule("chrV", 0.44, 0.45, True, True, "Aspergillus"),
        HotspotRule("NW_022045663.1", 0.0, 1.0, True, True, "Drosophila"),
        HotspotRule("NW_022045732.1", 0.0, 1.0, True, True, "Drosophila"),
        HotspotRule("NW_022045744.1", 0.0, 1.0, True, True, "Drosophila"),
        HotspotRule("NW_022045746.1", 0.0, 1.0, True, True, "Drosophila"),
        HotspotRule("NW_022045852.1", 0.73, 0.74, True, True, "Drosophila"),
    ),
)
