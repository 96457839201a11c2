"""Defaults of retrieval and construction."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

#: Rank weights (graph, meaning, time) by a question's intent.
INTENT_WEIGHTS = {
    "explicit_temporal": (2.0, 0.5, 2.0),
    "implicit_temporal": (1.5, 1.0, 1.0),
    "ordering": (1.5, 0.5, 2.5),
    "atemporal": (0.5, 2.0, 0.1),
}
#: Rank of what a ranking lacks.
MISSING_RANK = 1_000_000


@dataclass(frozen=True)
class Config:
    ontology_top_k: int = 20
    passage_top_k: int = 20
    entity_passage_top_k: int = 10
    entity_sentence_top_k: int = 5
    prune_top_k: int = 10
    similarity_passage_top_k: int = 5
    answer_passages: int = 15
    damping: float = 0.85
    iterations: int = 100
    tolerance: float = 1e-6
    rrf_hybrid: int = 0
    rrf_passage: int = 10
    rrf_edge: int = 60
    edge_weight_alpha: float = 0.5
    sigma: float = 5.0
    boost_beta: float = 2.0
    overlap_limit: float = 0.5
    overlap_factor: float = 0.5
    snapshot_strictness: bool = True
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    chunk_words: int = 256
    chunk_overlap: int = 20
    default_query: tuple[str, str] = ("2025-01-01", "2025-12-31")
    default_year: float = 2025.0
    intent_weights: dict = field(default_factory=lambda: dict(INTENT_WEIGHTS))

    @classmethod
    def read(cls, path: str, section: str = "retrieval") -> Config:
        """Settings from a JSON file, or a YAML file of plain `key: value` lines; a section's values win over those of the root, unknown keys are left out."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            found = json.loads(text)
        except ValueError:
            found = plain_yaml(text)
        flat = {**found, **(found.get(section) or {})}
        names = {x.name: x for x in fields(cls)}
        out = {k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in names}
        if "intent_weights" in out:
            out["intent_weights"] = {**INTENT_WEIGHTS, **{k: tuple(v) for k, v in out["intent_weights"].items()}}
        return cls(**out)


def plain_yaml(text: str) -> dict:
    """Nested `key: value` lines, indented by spaces; values are JSON scalars or lists, else text. Comments begin with #."""
    root: dict = {}
    open_: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth = len(bare) - len(bare.lstrip(" "))
        key, _, value = bare.strip().partition(":")
        while open_[-1][0] >= depth:
            open_.pop()
        value = value.strip()
        if not value:
            open_[-1][1][key] = below = {}
            open_.append((depth, below))
            continue
        try:
            open_[-1][1][key] = json.loads({"True": "true", "False": "false", "null": "null"}.get(value, value))
        except ValueError:
            open_[-1][1][key] = value.strip("'\"")
    return root
