"""One place for the parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Defaults of candidate aggregation, report assembly, labelling and resampling."""

    candidates: int = 10
    top_k: int = 3
    agree_ngram: int = 5
    agree_at: float = 0.4
    prefix: int = 40
    longest_sentence: int = 80
    weight_measure: float = 5.0
    weight_place: float = 2.0
    most_places: int = 3
    weight_word: float = 0.1
    most_words: int = 50
    weight_agree: float = 3.0
    weight_pollution: float = 4.0
    similar_phrase: float = 0.6
    accept_phrase: int = 100
    threshold: float = 0.5
    resamples: int = 2000
    seed: int = 0
    image_tokens: int = 32
    region_tokens: int = 33
    buffer: int = 100
    bands: dict[str, tuple[float, float]] = field(default_factory=lambda: {"default": (0.7, 1.3), "low": (0.3, 0.7), "medium": (0.5, 1.0), "high": (1.0, 1.5)})


DEFAULT = Config()


def flat_values(text: str) -> dict[str, str]:
    """The ``key: value`` lines of a YAML text, at any depth; comments and quotes are dropped."""
    out = {}
    for line in text.splitlines():
        body = line.split("#", 1)[0].strip()
        key, colon, value = body.partition(":")
        if colon and value.strip():
            out[key.strip("- ")] = value.strip().strip("\"'")
    return out


def known(names: list[str], catalogue: dict) -> list[str]:
    """The asked names that the catalogue has, all of it if none is asked."""
    return [n for n in names if n in catalogue] if names else list(catalogue)
