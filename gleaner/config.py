"""Settings with their defaults and floors."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators.chunking import Sizes


@dataclass(frozen=True)
class Settings:
    child_target: int = 450
    child_min: int = 200
    child_max: int = 700
    parent_target: int = 1200
    parent_min: int = 900
    parent_max: int = 1600
    overlap_sentences: int = 2
    group_min: int = 2
    group_max: int = 4
    top_k: int = 3
    top_k_dense: int = 48
    top_k_sparse: int = 48
    fusion_top_k: int = 96
    rerank_top_k: int = 10
    ann_candidates: int = 12
    min_similarity: float = 0.30
    use_hybrid: bool = True
    use_lsh: bool = False
    use_reranker: bool = True
    compress_evidence: bool = True
    rerank_low: float = 0.34
    low_confidence: float = 0.46
    low_margin: float = 0.06
    low_gap: float = 0.04
    evidence_sentence_min: int = 15
    evidence_sentence_max: int = 40
    evidence_chunk_min: int = 6
    evidence_chunk_max: int = 10
    evidence_min_tokens: int = 1500
    evidence_max_tokens: int = 3000
    embedding_model: str = "hashing"
    api_key: str = ""

    def bounded(self) -> Settings:
        """Values below their floors are raised to them."""
        s = self
        at_least = lambda **floors: {k: max(v, getattr(s, k)) for k, v in floors.items()}
        s = replace(s, **at_least(child_target=220, child_min=120, parent_target=600, parent_min=350, overlap_sentences=1, group_min=2, group_max=2, top_k=1, top_k_dense=4, top_k_sparse=4, fusion_top_k=12, rerank_top_k=4, ann_candidates=3, evidence_sentence_min=8, evidence_sentence_max=10, evidence_chunk_min=1, evidence_chunk_max=1, evidence_min_tokens=300, evidence_max_tokens=600))
        s = replace(s, child_max=max(s.child_target, s.child_max), parent_max=max(s.parent_target, s.parent_max), top_k_dense=max(s.top_k, s.top_k_dense), min_similarity=min(0.99, max(0.0, s.min_similarity)))
        unit = {k: min(1.0, max(0.0, getattr(s, k))) for k in ("rerank_low", "low_confidence", "low_margin", "low_gap")}
        return replace(s, **unit, fusion_top_k=max(s.top_k_dense, s.fusion_top_k), rerank_top_k=max(s.top_k, s.rerank_top_k))

    @property
    def wanted(self) -> int:
        """F15"""
        return max(self.rerank_top_k, self.evidence_chunk_max)

    @property
    def sizes(self) -> Sizes:
        return Sizes(self.child_target, self.child_min, self.child_max, self.overlap_sentences, self.parent_target, self.parent_min, self.parent_max, self.group_min, self.group_max)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "GLEANER_", dotenv: str | None = None) -> Settings:
        """Values by upper-case name; what can't be read keeps its default.
        dotenv: a file of NAME=value lines for what the environment leaves open."""
        env, found = os.environ if env is None else env, {}
        if dotenv and os.path.exists(dotenv):
            with open(dotenv, encoding="utf-8") as file:
                lines = [line.strip().partition("=") for line in file if "=" in line and not line.lstrip().startswith("#")]
            env = {name.removeprefix("export ").strip(): value.strip().strip("\"'") for name, _, value in lines} | dict(env)
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            try:
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(f.default, bool) else type(f.default)(raw)
            except ValueError:
                continue
        return cls(**found).bounded()

    def table(self, spark: SparkSession) -> DataFrame:
        """H6: one row for each setting, keys masked"""
        rows = [(k, ("***" if v else "") if k == "api_key" else str(v)) for k, v in asdict(self).items()]
        return spark.createDataFrame(rows, "setting string, value string")
