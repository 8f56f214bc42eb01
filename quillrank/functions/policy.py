"""What a deployment chooses: term lists, weights, gates and the reference date.

The engine has no list of its own; DEFAULT is an example policy for people who model rivers.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Policy:
    reference_date: str = "2026-05-27"
    target_titles: tuple[str, ...] = ("hydrologist", "flood modeller", "catchment engineer", "river engineer")
    off_target_titles: tuple[str, ...] = ("florist", "chauffeur", "optician", "goldsmith", "upholsterer")
    manager_titles: tuple[str, ...] = ("superintendent", "foreperson", "overseer")
    seniority: dict[str, float] = field(default_factory=lambda: {"principal": 0.95, "staff": 0.9, "lead": 0.8, "senior": 0.75, "junior": 0.3, "intern": 0.1, "associate": 0.4})
    core_skills: tuple[str, ...] = ("flood routing", "rainfall runoff", "groundwater", "river gauging", "water balance", "snowmelt")
    vector_stores: tuple[str, ...] = ("gauge archive", "borehole register", "raster catalogue")
    embedding_terms: tuple[str, ...] = ("unit hydrograph", "transfer function", "storage cascade")
    evaluation_terms: tuple[str, ...] = ("nash-sutcliffe", "hit rate", "skill score", "split sample")
    language_terms: tuple[str, ...] = ("river", "basin", "discharge", "drought", "infiltration", "evaporation", "aquifer", "flood")
    vision_terms: tuple[str, ...] = ("astronomy", "telescope", "acoustics", "seismics", "choreography")
    wrapper_terms: tuple[str, ...] = ("spreadsheet macro", "report template")
    classic_terms: tuple[str, ...] = ("finite volume", "kriging", "fortran", "gumbel")
    production_terms: tuple[str, ...] = ("operational", "commissioned", "forecast service", "telemetry")
    research_terms: tuple[str, ...] = ("fieldwork", "dissertation", "symposium")
    services_firms: tuple[str, ...] = ("temp agency", "contract bureau", "staff leasing")
    tier1_places: tuple[str, ...] = ("lisbon", "oporto")
    tier2_places: tuple[str, ...] = ("madrid", "turin", "lyon")
    tier3_places: tuple[str, ...] = ("ghent", "graz")
    home_country: str = "portugal"
    must_have: tuple[tuple[str, ...], ...] = (("flood routing", "hydraulics"), ("telemetry", "gauging"), ("groundwater", "borehole"), ("warning", "alarm plan"), ("peer review",))
    # fixed values: component weights, penalties, gates and bands of the scoring rubric
    weights: dict[str, float] = field(default_factory=lambda: {"role": 0.30, "semantic": 0.15, "skills": 0.23, "experience": 0.12, "production": 0.10, "company": 0.10})
    penalties: dict[str, float] = field(default_factory=lambda: {"services": 0.20, "vision": 0.25, "wrapper": 0.25, "research": 0.30, "no_code": 0.20, "chaser": 0.15})
    penalty_cap: float = 0.85
    blend: float = 0.6
    availability_band: tuple[float, float] = (0.75, 1.05)
    location_band: tuple[float, float] = (0.70, 1.04)
    off_target_gate: float = 0.15
    consistency_gate: float = 0.03
    query: str = "flood routing discharge telemetry warning skill score flood discharge"


DEFAULT = Policy()
