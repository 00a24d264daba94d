"""Constants of the scoring, as frozen groups."""

from __future__ import annotations

from dataclasses import dataclass

# Weights, thresholds and tolerances that results depend on.


@dataclass(frozen=True)
class Matching:
    weight_dialogue: float = 0.55
    weight_title: float = 0.15
    weight_duration: float = 0.10
    weight_order: float = 0.20
    confident_margin: float = 0.15
    no_episode: float = 0.25
    skip_penalty: float = 0.10
    kept_candidates: int = 5
    identity_dialogue: float = 0.3
    identity_title: float = 0.5
    min_content_words: int = 8
    music_title_factor: float = 2.0
    order_agreement: float = 0.75


@dataclass(frozen=True)
class Dialogue:
    phrase_words: int = 6
    hit_floor: float = 0.6
    hit_full: float = 0.88
    typical_share: float = 0.5
    anchors: int = 12
    cosine_full: float = 0.45
    summary_cap: float = 0.8
    summary_floor: float = 0.1
    summary_span: float = 0.5
    summary_min_weight: float = 0.05
    summary_min_letters: int = 3


@dataclass(frozen=True)
class Title:
    floor: float = 0.7
    full: float = 0.95
    phonetic_discount: float = 0.95
    anchors: int = 400


@dataclass(frozen=True)
class Sampling:
    whole_s: float = 360.0
    window_s: float = 105.0
    positions: tuple[float, ...] = (0.15, 0.40, 0.65, 0.85)
    min_gap_s: float = 20.0
    whole_gap_s: float = 1.0


MATCHING, DIALOGUE, TITLE, SAMPLING = Matching(), Dialogue(), Title(), Sampling()
