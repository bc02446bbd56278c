"""Settings of a search, checked when they are made."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass
from math import isfinite

from .sources.files import canonical_json

#: Names of the strategies; fixed values.
STRATEGIES = (
    "current_positive_additive",
    "finite_activation_budget",
    "query_conditioned_transmission",
    "lateral_inhibition",
    "recurrent_competition",
    "local_neighbor_competition",
    "local_neighbor_query_competition",
    "local_neighbor_path_competition",
    "local_neighbor_query_path_competition",
    "anchored_local_competition",
    "anchored_local_query_competition",
)


#: Settings of feedback; `effective` leaves out those whose policy is off. Names are fixed values.
FEEDBACK = (
    "feedback_learning_rate",
    "sibling_feedback_normalization",
    "maximum_edge_weight",
    "relation_feedback_evidence_quorum",
    "confirmed_outcome_reinforcement",
    "confirmation_decay_ratio",
    "soft_start_feedback_reinforcement",
    "soft_start_feedback_ratio",
    "outcome_driven_feedback_deactivation",
)


@dataclass(frozen=True)
class EngineConfig:
    # Names and defaults of the settings: fixed values, as callers give them by name.
    sparse_weight: float = 0.55
    dense_weight: float = 0.45
    entry_weight: float = 0.55
    graph_weight: float = 0.45
    seed_count: int = 3
    max_hops: int = 2
    hop_decay: float = 0.70
    activation_half_life_seconds: float = 3600.0
    feedback_learning_rate: float = 0.20
    maximum_edge_weight: float = 2.0
    maximum_activation: float = 10.0
    activation_budget: float = 1.0
    inhibition_ratio: float = 0.0
    inhibition_top_k: int = 0
    query_transmission_floor: float = 0.4
    query_transmission_power: float = 1.0
    use_dense_retrieval: bool = True
    use_graph_propagation: bool = True
    graph_normalization: str = "max"
    final_fusion_strategy: str = "linear"
    rrf_k: int = 60
    activation_strategy: str = STRATEGIES[0]
    sibling_feedback_normalization: float = 0.0
    max_paths_per_node: int = 4
    max_propagation_expansions: int = 10_000
    recurrent_steps: int = 3
    recurrent_decay: float = 0.5
    convergence_tolerance: float = 1e-9
    max_active_paths_per_node: int = 4
    relation_feedback_evidence_quorum: int = 1
    confirmed_outcome_reinforcement: bool = False
    confirmation_decay_ratio: float | None = None
    soft_start_feedback_reinforcement: bool = False
    soft_start_feedback_ratio: float | None = None
    outcome_driven_feedback_deactivation: bool = False

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        for name, value in asdict(self).items():
            need(not isinstance(value, float) or isfinite(value), f"{name} must be finite")
        need(min(self.sparse_weight, self.dense_weight, self.entry_weight, self.graph_weight) >= 0, "weights must not be negative")
        need(self.sparse_weight + self.dense_weight > 0 and self.entry_weight + self.graph_weight > 0, "one weight of each pair must be positive")
        need(self.use_dense_retrieval or self.dense_weight == 0, "dense_weight must be 0 without dense retrieval")
        need(self.use_graph_propagation or self.graph_weight == 0, "graph_weight must be 0 without propagation")
        need(self.seed_count >= 1 and self.max_hops >= 0 and self.rrf_k >= 1 and self.inhibition_top_k >= 0, "counts out of range")
        need(0 <= self.hop_decay <= 1 and 0 <= self.inhibition_ratio < 1 and 0 <= self.query_transmission_floor <= 1, "ratios out of range")
        need(min(self.activation_half_life_seconds, self.feedback_learning_rate, self.activation_budget, self.query_transmission_power) > 0, "rates must be positive")
        need(self.graph_normalization in ("max", "none", "l1_mass"), "unknown normalisation")
        need(self.final_fusion_strategy in ("linear", "rrf"), "unknown fusion")
        need(self.activation_strategy in STRATEGIES, "unknown strategy")
        need(min(self.maximum_edge_weight, self.maximum_activation) > 0, "maxima must be positive")
        need(min(self.max_paths_per_node, self.max_propagation_expansions) >= 1, "limits must be positive")
        need(self.recurrent_steps >= 1 and self.max_active_paths_per_node >= 1, "recurrent settings out of range")
        need(0 <= self.recurrent_decay <= 1 and self.convergence_tolerance >= 0 and 0 <= self.sibling_feedback_normalization <= 1, "ratios out of range")
        need(type(self.relation_feedback_evidence_quorum) is int and self.relation_feedback_evidence_quorum >= 1, "the quorum must be a positive integer")
        soft, late = self.soft_start_feedback_reinforcement, self.confirmed_outcome_reinforcement
        need(not (soft and late), "soft start excludes reinforcement by outcomes alone")
        need(not soft or self.relation_feedback_evidence_quorum == 1, "soft start needs a quorum of 1")
        need(soft or not self.outcome_driven_feedback_deactivation, "deactivation needs soft start")
        for ratio, wanted in ((self.confirmation_decay_ratio, soft or late), (self.soft_start_feedback_ratio, soft)):
            need((ratio is not None) == wanted, "a ratio is needed with its policy and only then")
            need(ratio is None or 0 < ratio < 1, "ratios of policies lie between 0 and 1")

    @property
    def surface(self) -> str:
        """Which search the feedback belongs to."""
        outcomes = self.soft_start_feedback_reinforcement or self.confirmed_outcome_reinforcement
        return "relation" if outcomes or self.sibling_feedback_normalization > 0 else "combined"

    def effective(self) -> dict[str, dict[str, object]]:
        """The settings that count, those of retrieval and those of feedback; soft start and dormancy only if in use."""
        idle = set()
        if not self.soft_start_feedback_reinforcement and self.soft_start_feedback_ratio is None:
            idle |= {"soft_start_feedback_reinforcement", "soft_start_feedback_ratio"}
        if not self.outcome_driven_feedback_deactivation:
            idle.add("outcome_driven_feedback_deactivation")
        found: dict[str, dict[str, object]] = {"retrieval": {}, "feedback": {}}
        for name, value in sorted(asdict(self).items()):
            if name not in idle:
                found["feedback" if name in FEEDBACK else "retrieval"][name] = value
        return found

    def fingerprints(self) -> dict[str, str]:
        """Digests of the effective settings as canonical JSON: of retrieval, of feedback and of both."""
        both = self.effective()
        digest = lambda x: "sha256:" + hashlib.sha256(canonical_json(x)).hexdigest()
        return {"retrieval_config_fingerprint": digest(both["retrieval"]), "feedback_config_fingerprint": digest(both["feedback"]), "full_config_fingerprint": digest(both)}
