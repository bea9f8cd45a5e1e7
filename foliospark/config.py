"""Defaults, and how a user's settings are laid over them."""

from __future__ import annotations

from typing import Any

# Caps, thresholds, weights and category names that results depend on.
LIMITS = {
    "network_max_nodes": 80, "network_max_edges": 250, "sankey_max_links": 120, "bubble_max_points": 200, "heatmap_max_cells": 2500,
    "matrix_max_rows": 40, "matrix_max_cols": 40, "patents_page_size": 25, "patents_max_page_size": 200, "export_max_rows": 20000,
    "top_n_default": 10, "max_companies_compare": 12, "trajectory_max_companies": 10, "leadlag_max_companies": 20,
    "claim_density_max_points": 5000, "inventor_network_max_edges": 200, "entropy_top_companies": 6, "upset_max_elements": 12,
    "upset_max_combos": 25, "semantic_max_docs": 3000, "simnet_max_docs": 600, "simnet_max_edges": 400,
}
THRESHOLDS = {
    "min_combo_patents": 3, "min_class_patents": 3, "recent_years": 3, "fuzzy_match_cutoff": 0.75, "winsor_pct": 0.02,
    "min_years_leadlag": 5, "min_patents_leadlag": 10, "max_lag_years": 3, "leadlag_min_corr": 0.5, "inventor_match_confidence": 0.6,
    "low_confidence_class": 0.5, "emerging_min_growth": 0.3, "reemerging_decline_years": 3, "insight_small_sample": 10,
    "sim_topk_per_doc": 20, "semantic_sim_threshold": 0.8, "overlap_sim_threshold": 0.85, "emerging_cluster_recent_share": 0.5,
    "ps_group_distance": 0.45,
}
WEIGHTS: dict[str, Any] = {
    "emerging": {"growth": 1.0, "lift": 1.0, "new_entrants": 1.0, "diversity": 0.5},
    "opportunity": {"growth": 1.0, "new_entrants": 1.0, "combo_growth": 0.7, "keyword_growth": 0.5, "problem_recurrence": 0.5, "adjacency": 0.7, "barrier": 1.0},
    "influence": {"direct_citations": 1.0, "indirect_citations": 0.7, "cross_class": 0.8, "cross_company": 0.8, "family_expansion": 0.6, "legal_strength": 0.6},
    "dna_type_cutoff": 0.6,
}
LEGAL_STATUSES = ["Pending", "Granted-Active", "Granted-Expired", "Abandoned", "Withdrawn", "Rejected", "Lapsed", "Unknown"]
ACTIVE_STATUSES = ["Granted-Active", "Pending"]
GRANTED_STATUSES = ["Granted-Active", "Granted-Expired"]
# The first pattern that occurs in a lower-cased status decides.
LEGAL_PATTERNS = [
    ("존속기간만료", "Granted-Expired"), ("granted-expired", "Granted-Expired"), ("expired", "Granted-Expired"), ("만료", "Granted-Expired"),
    ("granted-active", "Granted-Active"), ("등록유지", "Granted-Active"), ("in force", "Granted-Active"), ("active", "Granted-Active"),
    ("유효", "Granted-Active"), ("존속", "Granted-Active"), ("소멸", "Lapsed"), ("lapsed", "Lapsed"), ("연차료불납", "Lapsed"),
    ("non-payment", "Lapsed"), ("포기", "Abandoned"), ("abandon", "Abandoned"), ("취하", "Withdrawn"), ("withdraw", "Withdrawn"),
    ("거절", "Rejected"), ("reject", "Rejected"), ("refus", "Rejected"), ("무효", "Rejected"), ("등록", "Granted-Active"),
    ("grant", "Granted-Active"), ("registered", "Granted-Active"), ("출원계속", "Pending"), ("심사중", "Pending"), ("pending", "Pending"),
    ("공개", "Pending"), ("published", "Pending"), ("examination", "Pending"), ("출원", "Pending"), ("filed", "Pending"),
]
ANALYSIS_UNITS = ["family", "publication", "application", "registration"]
MULTICLASS_MODES = ["duplicate", "fractional", "primary", "level_separate"]
COAPPLICANT_MODES = ["all", "first"]
PHASES = ["Emerging", "Growing", "Competitive", "Mature", "Declining", "Re-emerging"]
COUNTRY_PRIORITY = {"US": 0, "EP": 1, "KR": 2, "JP": 3, "CN": 4, "WO": 5}
UNCLASSIFIED = "미분류"

DEFAULTS: dict[str, Any] = {
    "analysis_unit": "family", "multiclass_mode": "duplicate", "coapplicant_mode": "all", "transition_mode": "cooccurrence", "trajectory_weighting": "share",
    "limits": {}, "thresholds": {}, "weights": {}, "own_company_names": [], "own_capability_keywords": [],
}


class Settings:
    """Defaults with ``given`` over them; nested dictionaries are merged key by key."""

    def __init__(self, given: dict[str, Any] | None = None) -> None:
        self.values = {k: (v | (given or {}).get(k, {}) if isinstance(v, dict) else (given or {}).get(k, v)) for k, v in DEFAULTS.items()}

    def __getitem__(self, key: str) -> Any:
        return self.values[key]

    def limit(self, key: str) -> int:
        return self._number("limits", LIMITS, key, int)

    def threshold(self, key: str) -> float:
        return self._number("thresholds", THRESHOLDS, key, float)

    def _number(self, group: str, defaults: dict, key: str, kind: type) -> Any:
        try:
            return kind(self.values[group][key])
        except (KeyError, TypeError, ValueError):
            return kind(defaults[key])

    def weights(self, group: str) -> dict[str, float]:
        given = self.values["weights"].get(group, {})
        out = {}
        for k, v in WEIGHTS[group].items():
            try:
                out[k] = float(given.get(k, v))
            except (TypeError, ValueError):
                out[k] = v
        return out
