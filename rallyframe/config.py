"""Settings of the operators, checked when made.

Fixed values: the defaults (thresholds, weights, court sizes) are those that the reference's results follow from."""

from __future__ import annotations

from dataclasses import dataclass


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class BounceConfig:
    minimum_time_delta: float = 0.001
    minimum_motion_pixels: float = 2.0
    minimum_direction_change_degrees: float = 20.0
    strong_direction_change_degrees: float = 45.0
    maximum_prediction_ratio: float = 0.5
    reversal_weight: float = 0.45
    direction_weight: float = 0.35
    quality_weight: float = 0.2
    score_threshold: float = 0.55
    minimum_frame_gap: int = 4

    def __post_init__(self):
        _check(self.minimum_time_delta > 0, "minimum_time_delta must be positive")
        _check(self.minimum_motion_pixels >= 0, "minimum_motion_pixels must not be negative")
        _check(0 <= self.minimum_direction_change_degrees <= 180, "minimum_direction_change_degrees must be 0 to 180")
        _check(0 <= self.maximum_prediction_ratio <= 1, "maximum_prediction_ratio must be 0 to 1")
        _check(0 <= self.score_threshold <= 1, "score_threshold must be 0 to 1")
        _check(self.minimum_frame_gap >= 0, "minimum_frame_gap must not be negative")


@dataclass(frozen=True)
class CourtConfig:
    """Court sizes in metres, and how calls near a line are made."""

    length: float = 23.77
    singles_width: float = 8.23
    doubles_width: float = 10.97
    service_line_from_net: float = 6.40
    net_to_baseline: float = 11.885
    alley_width: float = 1.37
    court_type: str = "singles"
    boundary_tolerance: float = 0.05
    minimum_bounce_score: float = 0.55

    def __post_init__(self):
        _check(self.court_type in ("singles", "doubles"), "court_type must be singles or doubles")
        _check(min(self.length, self.singles_width, self.doubles_width) > 0, "court sizes must be positive")
        _check(self.boundary_tolerance >= 0, "boundary_tolerance must not be negative")

    @property
    def width(self) -> float:
        return self.singles_width if self.court_type == "singles" else self.doubles_width


@dataclass(frozen=True)
class SpeedConfig:
    minimum_time_delta: float = 0.001
    minimum_distance_meters: float = 0.01
    smoothing_window: int = 5
    maximum_speed_kmh: float = 300.0
    ignore_predicted: bool = True

    def __post_init__(self):
        _check(self.minimum_time_delta > 0, "minimum_time_delta must be positive")
        _check(self.smoothing_window >= 1, "smoothing_window must be at least 1")
        _check(self.maximum_speed_kmh > 0, "maximum_speed_kmh must be positive")


PLAYER_SPEED = SpeedConfig(maximum_speed_kmh=40.0)


@dataclass(frozen=True)
class ShotConfig:
    maximum_gap_seconds: float = 1.25
    minimum_rally_points: int = 4
    minimum_shot_points: int = 2
    direction_change_degrees: float = 35.0
    minimum_motion_pixels: float = 4.0
    maximum_shot_seconds: float = 2.5

    def __post_init__(self):
        _check(self.maximum_gap_seconds > 0, "maximum_gap_seconds must be positive")
        _check(self.minimum_rally_points >= 2, "minimum_rally_points must be at least 2")
        _check(self.minimum_shot_points >= 2, "minimum_shot_points must be at least 2")
        _check(0 < self.direction_change_degrees <= 180, "direction_change_degrees must be above 0, up to 180")


@dataclass(frozen=True)
class ScoringConfig:
    games_to_win_set: int = 6
    minimum_game_difference: int = 2
    enable_tiebreak: bool = True
    tiebreak_trigger_games: int = 6
    tiebreak_points_to_win: int = 7
    tiebreak_minimum_difference: int = 2
    sets_to_win_match: int = 2

    def __post_init__(self):
        _check(self.games_to_win_set >= 1 and self.sets_to_win_match >= 1, "games and sets to win must be positive")
        _check(self.minimum_game_difference >= 1 and self.tiebreak_minimum_difference >= 1, "differences must be positive")


@dataclass(frozen=True)
class TrackerConfig:
    maximum_match_distance: float = 180.0
    maximum_missed_frames: int = 8
    position_alpha: float = 0.65
    velocity_alpha: float = 0.55
    minimum_time_delta: float = 0.001

    def __post_init__(self):
        _check(self.maximum_match_distance > 0, "maximum_match_distance must be positive")
        _check(0 < self.position_alpha <= 1 and 0 < self.velocity_alpha <= 1, "alphas must be above 0, up to 1")
        _check(self.maximum_missed_frames >= 0, "maximum_missed_frames must not be negative")


@dataclass(frozen=True)
class CandidateConfig:
    minimum_box_area: float = 2.0
    maximum_area_ratio: float = 0.01
    minimum_aspect_ratio: float = 0.35
    maximum_aspect_ratio: float = 2.8
    confidence_weight: float = 0.75
    color_weight: float = 0.25
    fallback_hue_low: int = 18
    fallback_hue_high: int = 48
    fallback_minimum_saturation: int = 55
    fallback_minimum_value: int = 90
    fallback_minimum_area: float = 3.0
    fallback_maximum_area: float = 700.0
    fallback_minimum_circularity: float = 0.15

    def __post_init__(self):
        _check(0 <= self.fallback_minimum_area < self.fallback_maximum_area, "the fallback's areas must rise")
        _check(0 < self.minimum_aspect_ratio < self.maximum_aspect_ratio, "aspect ratios must rise")
        _check(0 < self.maximum_area_ratio <= 1, "maximum_area_ratio must be above 0, up to 1")


@dataclass(frozen=True)
class AssociationConfig:
    """How boxes of persons become tracks: confidence that starts and continues a track, or only continues one; the least overlap in both
    stages; frames that a lost track is remembered for."""

    high_confidence: float = 0.25
    low_confidence: float = 0.1
    minimum_overlap: float = 0.2
    minimum_low_overlap: float = 0.5
    buffer_frames: int = 30

    def __post_init__(self):
        _check(0 <= self.low_confidence <= self.high_confidence <= 1, "confidences must rise")
        _check(0 < self.minimum_overlap <= 1 and 0 < self.minimum_low_overlap <= 1, "overlaps must be above 0, up to 1")
        _check(self.buffer_frames >= 1, "buffer_frames must be at least 1")


@dataclass(frozen=True)
class LineConfig:
    """Lines by voting: votes, pixels of length and of gaps; the picture's part and the colour that count."""

    votes: int = 55
    minimum_length: int = 70
    maximum_gap: int = 20
    white_threshold: int = 170
    maximum_white_saturation: int = 95
    roi_top_ratio: float = 0.20
    roi_bottom_ratio: float = 1.0

    def __post_init__(self):
        _check(self.votes >= 1 and self.minimum_length >= 1 and self.maximum_gap >= 1, "votes, length and gap must be positive")
        _check(0 <= self.roi_top_ratio < self.roi_bottom_ratio <= 1, "the region's ratios must rise")


@dataclass(frozen=True)
class PersonConfig:
    roi_top_ratio: float = 0.15
    roi_bottom_ratio: float = 1.0
    minimum_height_ratio: float = 0.03
    max_players: int = 2
    court_margin_meters: float = 15.0
    behind_baseline_meters: float = 10.0
    zone_minimum_height_ratio: float = 0.06
    zone_minimum_width_ratio: float = 0.02
    far_zone: tuple[float, float] = (0.10, 0.50)
    near_zone: tuple[float, float] = (0.50, 0.90)

    def __post_init__(self):
        _check(0 <= self.roi_top_ratio < self.roi_bottom_ratio <= 1, "the region's ratios must rise")
        _check(self.max_players >= 1, "max_players must be at least 1")
