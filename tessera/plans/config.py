"""Settings of a cohort fit: frozen, checked when made, resolved once from a profile and what overrides it."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class FitConfig:
    major_prior: float = 0.5
    dosage_penalty: float = 3.0
    partition_tolerance: float = 1e-3
    code_weight: float = 0.7
    explore: int = 8
    refine: int = 2
    kkt_tolerance: float = 4e-3
    unsupported: str = "mask"

    def __post_init__(self):
        if not 0 < self.major_prior < 1:
            raise ValueError("major_prior must lie between 0 and 1")
        for name in ("partition_tolerance", "kkt_tolerance"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        for name in ("dosage_penalty", "code_weight"):
            if not 0 <= getattr(self, name) < float("inf"):
                raise ValueError(f"{name} must be finite and not negative")
        if self.explore < 1 or self.refine < 0:
            raise ValueError("explore must be at least 1 and refine at least 0")
        if self.unsupported not in ("mask", "error"):
            raise ValueError("unsupported must be mask or error")


#: Search budgets and admission tolerances by profile.
PROFILES = {"strict": {"explore": 12, "refine": 12, "kkt_tolerance": 2.5e-4}, "balanced": {"explore": 8, "refine": 2, "kkt_tolerance": 4e-3}, "fast": {"explore": 6, "refine": 0, "kkt_tolerance": 5e-3}}


#: The names of the scores, and of the prior over paths.
SCORES = ("fixed-partition-dirichlet-score", "fixed-partition-bic")
PRIOR_MODE = "endpoint_excess_dosage_penalty_biological_alias_mass_v1"


def plain_name(value: str) -> str:
    """Lower case, without blanks around it, hyphens for underscores."""
    return value.strip().lower().replace("_", "-")


def score_name(value: str) -> str:
    name = plain_name(value)
    if name.startswith("clonal-"):
        raise ValueError(f"scores with a clonal anchor don't exist any more; use one of {SCORES}")
    if name not in SCORES:
        raise ValueError(f"score must be one of {SCORES}")
    return name


def prior_mode(dosage_penalty: float) -> str:
    """The name of the path prior with its penalty."""
    return f"{PRIOR_MODE}:alpha={float(dosage_penalty):.12g}"


def resolve(profile: str = "balanced", selection_score: str | None = None, **given) -> FitConfig:
    """A profile's settings with the given ones on top; names match whatever their case, blanks and hyphens. The plain BIC is
    the Dirichlet score without the weight of the partition's mass."""
    name = plain_name(profile)
    if name not in PROFILES:
        raise ValueError(f"profile must be one of {sorted(PROFILES)}")
    if selection_score and score_name(selection_score) == "fixed-partition-bic":
        given["code_weight"] = 0.0
    return replace(FitConfig(**PROFILES[name]), **{k: v for k, v in given.items() if v is not None})
