"""Evaluation profiles: thresholds and retrieval settings, as a driver-side value."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

SCORES = [
    "groundedness_score", "relevancy_score", "context_precision_score", "context_relevancy_score",
    "completeness_score", "correctness_score", "compliance_accuracy_score", "abstention_score",
]


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 10
    max_per_document: int | None = 4
    rerank_depth: int = 20
    diversity_min: int = 3
    keyword_enabled: bool = True
    dedup_threshold: float = 0.85
    diversity_threshold: float = 0.3
    represent_sub_queries: bool = True
    swap_multiplier: float = 1.1


@dataclass(frozen=True)
class Profile:
    id: str
    version: str = "1"
    domain: str = ""
    description: str = ""
    system_prompt: str = ""
    thresholds: dict[str, float] = field(default_factory=dict)
    critical: dict[str, float] = field(default_factory=dict)
    retrieval: Retrieval = Retrieval()
    max_tokens: int = 2048


#: Regulated finance: groundedness from 0.7, the others from 0.5; two metrics have a critical bound.
FINANCE = Profile(
    id="fsi_compliance_v1",
    domain="fsi",
    description="Answers from retrieved regulation",
    thresholds={s: 0.7 if s == "groundedness_score" else 0.5 for s in SCORES},
    critical={"groundedness_score": 0.5, "compliance_accuracy_score": 0.3},
    retrieval=Retrieval(top_k=8, max_per_document=4, rerank_depth=45, diversity_threshold=0.5, swap_multiplier=0.8),
    max_tokens=1024,
)


class ProfileMissing(Exception):
    """No profile of that id."""


class ProfileMalformed(ValueError):
    """The profile's file can't be read as one."""


def load_profile(folder: str, profile_id: str) -> Profile:
    """A profile from ``folder/<id>.yaml``; PyYAML is needed for files."""
    path = Path(folder) / f"{profile_id}.yaml"
    if not path.is_file():
        raise ProfileMissing(profile_id)
    import yaml

    try:
        d = yaml.safe_load(path.read_text())
        r, g = d.get("retrieval") or {}, d.get("generation") or {}
        max_tokens = int(g.get("max_tokens", 2048))
        if not 256 <= max_tokens <= 8192:
            raise ValueError("max_tokens lies outside 256 to 8192")
        settings = Retrieval(
            r.get("top_k", 10), r.get("max_chunks_per_document", 4), r.get("rerank_depth", 20), r.get("document_diversity_min", 3), r.get("keyword_search_enabled", True),
            r.get("dedup_threshold", 0.85), r.get("diversity_relevance_threshold", 0.3), r.get("ensure_sub_query_representation", True), r.get("sub_query_swap_score_multiplier", 1.1),
        )
        return Profile(d["id"], str(d.get("version", "1")), d.get("domain", ""), d.get("description", ""), d.get("system_prompt", ""), d.get("thresholds") or {}, d.get("critical_thresholds") or {}, settings, max_tokens)
    except (yaml.YAMLError, KeyError, TypeError, AttributeError, ValueError) as e:
        raise ProfileMalformed(f"{path}: {e}") from e


def list_profiles(folder: str) -> list[dict]:
    """id, version, domain, description and has_prompt of every file, by name; unreadable ones with blanks."""
    out = []
    for path in sorted(Path(folder).glob("*.yaml")):
        try:
            p = load_profile(folder, path.stem)
            out.append({"id": p.id, "version": p.version, "domain": p.domain, "description": p.description, "has_prompt": bool(p.system_prompt)})
        except ProfileMalformed:
            out.append({"id": path.stem, "version": "", "domain": "", "description": "", "has_prompt": False})
    return out
