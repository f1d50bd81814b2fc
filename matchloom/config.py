"""Settings of a match run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from matchloom import lexicon

DEFAULT_WEIGHTS = {"keyword": 0.20, "tfidf": 0.25, "semantic": 0.25, "skills": 0.30}
MISSING_WEIGHT = 0.25
DEFAULT_THRESHOLD = 70.0
DEFAULT_EXPERIENCE = (0, 20)
SCORE_PARTS = ("keyword", "tfidf", "semantic", "skills")


@dataclass(frozen=True)
class MatchConfig:
    """Weights, threshold and term rules.

    ``max_terms`` is the number of TF-IDF terms a pair may use; by default all of them.
    ``semantic`` off scores that part 0 and leaves the other weights as they are.
    Resumes of at most ``index_rows`` rows and ``index_entries`` terms, keywords and vector entries are sent to
    every task as an index that jobs are scored against where they are read; 0 rows turns that off.
    """

    weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    threshold: float = DEFAULT_THRESHOLD
    semantic: bool = True
    max_terms: int | None = None
    index_rows: int = 4096
    index_entries: int = 1 << 20
    stop_words: Sequence[str] = tuple(lexicon.STOP_WORDS)
    tfidf_stop_words: Sequence[str] = tuple(lexicon.STOP_WORDS)
    skill_tag_groups: Sequence[Sequence[str]] = lexicon.SKILL_TAG_GROUPS
    skill_substrings: Sequence[str] = lexicon.SKILL_SUBSTRINGS

    def __post_init__(self):
        if any(self.weight(part) < 0 for part in SCORE_PARTS):
            raise ValueError("weights must not be negative")

    def weight(self, part: str) -> float:
        return float(self.weights.get(part, MISSING_WEIGHT))

    @property
    def other_weight(self) -> float:
        """The most that the parts not read from shared terms can add."""
        return self.weight("skills") + (self.weight("semantic") if self.semantic else 0.0)
