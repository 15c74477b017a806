"""Similarity metrics; a larger score is always better."""

from __future__ import annotations

from enum import Enum

from .errors import ConfigError

_ALIASES = {"cosine": "cosine", "cos": "cosine", "dot": "dot", "ip": "dot", "inner": "dot", "l2": "l2", "euclidean": "l2"}


class Metric(Enum):
    COSINE = "cosine"
    DOT = "dot"
    L2 = "l2"

    @classmethod
    def parse(cls, name: str | Metric) -> Metric:
        if isinstance(name, cls):
            return name
        try:
            return cls(_ALIASES[str(name).strip().lower()])
        except KeyError:
            raise ConfigError(f"no metric is named {name!r}") from None

    @property
    def tag(self) -> int:
        return list(Metric).index(self)

    @classmethod
    def from_tag(cls, tag: int) -> Metric:
        if not 0 <= tag < len(cls):
            raise ConfigError(f"no metric has tag {tag}")
        return list(cls)[tag]

    @property
    def normalizes(self) -> bool:
        """Whether stored rows are brought to unit length, so that a dot product suffices."""
        return self is Metric.COSINE
