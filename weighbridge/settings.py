"""Policy limits, judge questions and acceptance bars used by the operators.

Everything here is plan-time data: a value becomes a literal in a Spark
expression. Override a limit with ``Limits(evidence_min=0.6)``; nothing reads a
module-level constant behind the caller's back.
"""

from __future__ import annotations

from dataclasses import dataclass, fields


# Default thresholds of the decision policy.
@dataclass(frozen=True)
class Limits:
    needs_search_min: float = 0.50
    choice_floor: float = 0.50
    injection_max: float = 0.70
    boilerplate_max: float = 0.70
    relevant_min: float = 0.45
    contradicts_min: float = 0.70
    evidence_min: float = 0.55
    sufficient_min: float = 0.55
    conflicts_min: float = 0.70
    support_accept: float = 0.80
    memory_write_min: float = 0.80
    addresses_min: float = 0.50
    max_snippets: int = 30
    palace_top_k: int = 10
    palace_max_distance: float = 0.60
    max_pages: int = 5
    chunk_tokens: int = 300
    chunk_overlap: float = 0.15
    max_chunks_per_page: int = 8
    passage_max_chars: int = 1800
    min_chunk_tokens: int = 20
    top_evidence_k: int = 6
    max_evidence_tokens: int = 2500
    rrf_k: int = 60
    max_refine_rounds: int = 1
    baseline_pages: int = 8
    baseline_tokens: int = 12_000
    refined_query_chars: int = 200
    short_answer_chars: int = 4

    @classmethod
    def from_mapping(cls, values: dict) -> Limits:
        """Limits from the thresholds of a parsed settings file; an unknown key is an error."""
        unknown = values.keys() - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)


LIMITS = Limits()

# Wings of the passage store, the domain label of a recalled
# passage, and the abstain token a generator may answer with.
EVIDENCE = "evidence"
VERIFIED = "verified"
QUARANTINE = "quarantine"
MEMORY_DOMAIN = "palace"
ABSTAIN_TOKEN = "INSUFFICIENT_EVIDENCE"
CONFLICTS_NOTE = (
    "The EVIDENCE passages disagree with each other about the answer. "
    "Say that the sources disagree and give each version with its citation."
)

# Judge question ids per stage, with their type and options.
GATE_QUESTIONS = (
    "is_relevant",
    "contains_answer_evidence",
    "contradicts_query_premise",
    "contains_prompt_injection",
    "is_promotional_or_boilerplate",
)
QUESTION_TABLE = (
    ("s0", "needs_search", "noul", ("true", "false")),
    ("s0", "source", "choice", ("web", "palace", "both")),
    ("s0", "recency", "choice", ("any", "year", "month", "week", "day")),
    ("s0", "category", "choice", ("general", "news", "science", "it")),
    ("s1", "is_relevant", "noul", ("true", "false")),
    ("s1", "contains_answer_evidence", "noul", ("true", "false")),
    ("s1", "contradicts_query_premise", "noul", ("true", "false")),
    ("s1", "contains_prompt_injection", "noul", ("true", "false")),
    ("s1", "is_promotional_or_boilerplate", "noul", ("true", "false")),
    ("s2", "evidence_sufficient", "noul", ("true", "false")),
    ("s2", "evidence_conflicts", "noul", ("true", "false")),
    ("s4", "support", "choice", ("supported", "contradicted", "unsupported")),
    ("s4", "answer_addresses_query", "noul", ("true", "false")),
)

# The stage lookup as first published missed three ids and used
# three names that never occur; ``compat=True`` in the operators selects it.
COMPAT_STAGE_OF_QUESTION = {
    "is_relevant": "s1",
    "contains_answer_evidence": "s1",
    "contradicts_query_premise": "s1",
    "contains_prompt_injection": "s1",
    "is_promotional_or_boilerplate": "s1",
    "sufficient": "s2",
    "conflicts": "s2",
    "support": "s4",
    "addresses_query": "s4",
}
STAGE_OF_QUESTION = {qid: stage for stage, qid, _, _ in QUESTION_TABLE if stage != "s0"}

# Fixed values: (bar, metric, rule, threshold) a judged arm is held to.
ACCEPTANCE_BARS = (
    ("coverage", "coverage", "at least", 0.50),
    ("hallucination rate when attempting", "hallucination_rate", "at most", 0.10),
    ("truthfulness gain over arm B", "truthfulness_gain", "at least", 0.15),
    ("citation support rate on kept claims", "support_rate", "at least", 0.90),
)

# Price of a judge request and the resampling constants.
USD_PER_MILLION_INPUT_TOKENS = 0.042
RESAMPLES = 1000
RESAMPLE_SEED = 20260919
