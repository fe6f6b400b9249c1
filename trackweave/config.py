"""Thresholds of the tracking analytics; all operators take a Config and read nothing global.

Fixed values: classes, thresholds, sizes and weights must be these for results to be right."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Classes of detections
    player_classes: tuple[int, ...] = (3, 4, 5, 6, 7)
    referee_class: int = 8
    number_class: int = 2
    # Overlap suppression of detections and tracks
    same_role_iou: float = 0.65
    cross_role_iou: float = 0.80
    track_same_iou: float = 0.88
    track_young_iou: float = 0.85
    max_age_key: int = 60
    young_age: int = 5
    old_age: int = 8
    birth_gap: int = 3
    birth_dist: float = 40.0
    overlap_drop_iou: float = 0.85
    overlap_near_iou: float = 0.70
    overlap_near_dist: float = 45.0
    # Candidate matching
    active_iou: float = 0.30
    lost_iou: float = 0.20
    lost_dist: float = 160.0
    near_iou: float = 0.10
    near_dist: float = 140.0
    # Referee conflicts
    ref_iou: float = 0.45
    ref_fill: float = 0.55
    ref_conf_gain: float = 0.05
    # Detector tiers
    high_score: float = 0.5
    low_score: float = 0.1
    # Lifecycle and identity switches
    buffer: int = 120
    long_gap: int = 90
    switch_dist: float = 80.0
    switch_dt: int = 60
    switch_margin: float = 20.0
    source_life: int = 10
    jump_px: float = 90.0
    swap_margin: float = 70.0
    # Jersey numbers
    number_conf: float = 0.4
    number_size: int = 10
    ocr_conf: float = 0.3
    votes: int = 3
    owners: int = 2
    ocr_every: int = 3
    ocr_scale: float = 1.5
    # Boxes and projection
    expand_ratio: float = 0.20
    frame_w: int = 1280
    frame_h: int = 720
    foot_lift: int = 3
    court_w: int = 300
    court_h: int = 161
    inside_margin: float = 25.0
    relative_share: float = 0.85
    relative_min: int = 2
    conf_floor: float = 0.25
    # Tactical smoothing
    smooth_prev: float = 0.45
    max_step: float = 18.0
    gap: int = 12
    trail: int = 18
    # Keypoints and homography
    keypoint_every: int = 2
    border: int = 10
    edge_band: float = 0.30
    jump_reset_px: float = 150.0
    jump_reset_share: float = 0.5
    still_px: float = 6.0
    still_updates: int = 45
    carry_updates: int = 45
    ema_new: float = 0.6
    outlier_px: float = 50.0
    max_reproj: float = 60.0
    ransac_px: float = 5.0
    side_low: float = 0.43
    side_high: float = 0.57
    hysteresis: int = 6
    neighbours: int = 6
    neighbour_power: float = 1.35
    slope_dy: float = 18.0
    slope_min: float = 0.08
    slope_conf: float = 0.10
    slope_pairs: int = 1
    keypoint_conf: float = 0.05
    geometry_conf: float = 0.1
    center_band: float = 0.4
    side_min: int = 3
    side_margin: int = 2
    # Choice and acceptance of homographies
    stability: float = 0.35
    shift_weight: float = 0.05
    mode_penalty: float = 25.0
    side_penalty: float = 80.0
    update_min: int = 6
    cold_min: int = 6
    transition_min: int = 7
    strictness: float = 0.5
    good_reproj: float = 8.0
    recover_reproj: float = 14.0
    recover_streak: int = 2
    mean_shift: float = 35.0
    point_shift: float = 80.0
    # Masks
    mask_area: int = 80
    mask_inside: float = 0.35
    mask_fill: float = 0.45
    reuse_fill: float = 0.35
    dup_iou: float = 0.50
    dup_dist: float = 40.0
    block_iou: float = 0.08
    block_px: float = 55.0
    block_scale: float = 0.30
    reinit_missing: int = 6
    reinit_area: int = 4
    reinit_inside: int = 10
    reinit_ratio: float = 0.12
    reinit_cooldown: int = 20
    looks: int = 3
    # Pan prior and side transitions
    pan_min_points: int = 4
    pan_min_px: float = 2.0
    pan_max_mad: float = 18.0
    pan_gain: float = 1.0
    pan_min_conf: float = 0.35
    pan_keep: float = 0.55
    pan_decay: float = 0.75
    pan_max_age: int = 6
    pan_weight: float = 0.30
    pan_damping: float = 0.15
    transition_updates: int = 8
    # Association
    new_score: float = 0.7
    first_limit: float = 0.80
    second_limit: float = 0.5
    unconfirmed_limit: float = 0.7
    # Court activation and reports
    activate_points: int = 2
    activate_overlap: float = 0.12
    activate_area: int = 0
    stale_streak: int = 3
    islands_run: int = 5
    islands_total: int = 10


DEFAULT = Config()
