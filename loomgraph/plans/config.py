"""Parameters of the engine with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    chunk_size: int = 512
    chunk_overlap: int = 50
    extract_confidence: float = 0.5
    triples_per_chunk: int = 10
    edge_confidence: float = 0.6
    link_similarity: float = 0.85
    clustering: str = "agglomerative"
    min_cluster_size: int = 2
    top_k: int = 5
    similarity: float = 0.7
    gap_nodes: int = 50
    gaps: int = 20
    contradiction_nodes: int = 50
    contradictions: int = 10
    inference_nodes: int = 30
    inferences: int = 20
    central_nodes: int = 10
    threads: int = 10
    recommendations: int = 5

    @classmethod
    def of(cls, values: dict | None) -> Config:
        """From a mapping; keys that are no parameter are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (values or {}).items() if k in known})

    @classmethod
    def load(cls, path: str) -> Config:
        """From a YAML file with these keys at the top or in sections."""
        import yaml

        with open(path) as f:
            data = yaml.safe_load(f) or {}
        flat: dict = {}
        for k, v in data.items():
            flat |= v if isinstance(v, dict) else {k: v}
        return cls.of(flat)
