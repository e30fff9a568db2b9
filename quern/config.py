"""Settings of the engine, with overrides that are null unless set."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # The defaults of the retrieval engine.
    child_target_tokens: int = 220
    child_overlap_tokens: int = 48
    child_min_tokens: int = 32
    context_budget_tokens: int = 2400
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    dense_top_k: int = 30
    sparse_top_k: int = 30
    rrf_k: int = 60
    rrf_dense_weight: float = 0.65
    rrf_sparse_weight: float = 0.35
    rerank_enabled: bool = True
    rerank_top_n: int = 24
    final_top_k: int = 6
    mmr_enabled: bool = True
    mmr_lambda: float = 0.7
    max_children_per_section: int = 2
    grounding_threshold: float = 0.52
    ood_min_overlap: float = 0.06
    guard_rerank_floor: float = 0.0
    answerer: str = "extractive"
    llm_max_tokens: int = 768
    llm_temperature: float = 0.2
    eval_hit1_floor: float = 0.50
    eval_hit5_floor: float = 0.88
    eval_ndcg_floor: float = 0.72
    eval_adversarial_refusal_floor: float = 0.85
    eval_answered_floor: float = 0.98

    def override(self, **values) -> Settings:
        """Each value that is not None replaces the setting of its name."""
        return replace(self, **{k: v for k, v in values.items() if v is not None})

    @classmethod
    def from_env(cls, prefix: str = "QN_") -> Settings:
        kinds = {"int": int, "float": float, "str": str, "bool": lambda x: x.lower() in ("1", "true", "yes")}
        given = {f.name: kinds[f.type](os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return cls(**given)
