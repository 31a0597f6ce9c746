"""Settings with their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """S25. Defaults of every setting; ``from_env`` overrides them by environment variables of the same (upper-case) names."""

    app_name: str = "quern"
    device: str = "cpu"
    embedding_device: str = ""
    reranker_device: str = ""
    llm_keys: str = ""
    embedding_model: str = ""
    reranker_model: str = ""
    llm_model: str = ""
    embedding_dim: int = 1024
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    retrieval_top_k: int = 500
    rerank_top_k: int = 50
    final_top_k: int = 20
    score_threshold: float = 0.7
    max_tokens: int = 4096
    temperature: float = 0.1
    data_dir: str = "data"
    index_dir: str = "data/indexes"
    corpus_file: str = "corpus"
    agentic_max_iterations: int = 2
    agentic_top_k: int = 30
    rrf_k: int = 60
    hybrid_dense_weight: float = 0.8
    hybrid_sparse_weight: float = 0.2
    retrieve_only_top_k: int = 200
    retrieve_only_dense_weight: float = 0.7
    retrieve_only_sparse_weight: float = 0.3
    gap_buffer: int = 5
    gap_ratio: float = 0.9
    gap_min_k: int = 3
    gap_max_k: int = 200

    def __post_init__(self):
        """ValueError for a setting out of its range."""
        shares = ("score_threshold", "hybrid_dense_weight", "hybrid_sparse_weight", "retrieve_only_dense_weight", "retrieve_only_sparse_weight", "gap_ratio", "bm25_b")
        positive = ("embedding_dim", "retrieval_top_k", "rerank_top_k", "final_top_k", "max_tokens", "agentic_max_iterations", "agentic_top_k", "rrf_k", "retrieve_only_top_k", "gap_min_k", "gap_max_k")
        wrong = [n for n in shares if not 0 <= getattr(self, n) <= 1] + [n for n in positive if getattr(self, n) < 1]
        wrong += [n for n, ok in (("bm25_k1", self.bm25_k1 >= 0), ("temperature", 0 <= self.temperature <= 2), ("gap_buffer", self.gap_buffer >= 0), ("gap_max_k", self.gap_max_k >= self.gap_min_k)) if not ok]
        if wrong:
            raise ValueError(f"out of range: {', '.join(wrong)}")

    def device_of(self, part: str) -> str:
        """The device of ``embedding`` or ``reranker``: its own, else the common one."""
        return getattr(self, f"{part}_device") or self.device

    def keys(self) -> list[str]:
        """The keys of a language model's service, which callers take in turn."""
        return [k.strip() for k in self.llm_keys.split(",") if k.strip()]

    @classmethod
    def from_env(cls) -> Config:
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[f.type](os.environ[f.name.upper()]) for f in fields(cls) if f.name.upper() in os.environ})


DEFAULT = Config()
