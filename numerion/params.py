"""Thresholds of the reading pipeline, grouped by stage; plain literals in expressions, never session state."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Reading:
    """All knobs of segmentation and reading order."""

    # Defaults that decide results.
    max_side: int = 1600
    blur_ksize: int = 5
    use_otsu: bool = False
    adaptive_block: int = 0
    adaptive_c: float = 10.0
    remove_lines: bool = True
    line_contrast: float = 25.0
    close_ksize: int = 3
    min_height_px: int = 8
    min_area_px: int = 40
    border_frac: float = 0.9
    max_aspect: float = 4.0
    min_rel_height: float = 0.35
    merge_x_overlap: float = 0.25
    merge_y_gap: float = 0.6
    merge_max_height: float = 1.35
    merge_max_aspect: float = 1.5
    split_enabled: bool = True
    split_aspect: float = 1.5
    split_neck_aspect: float = 1.25
    split_neck_ink: float = 0.35
    line_overlap: float = 0.5
    target_stroke: float = 0.12
    soft_crops: bool = True
    fit_size: int = 20
    out_size: int = 28
    # When a run is a ruled line, and how strokes across one are mended.
    line_min_digit: int = 20
    line_digit_lengths: float = 2.5
    line_digit_thickness: float = 0.2
    line_page_length: int = 4
    line_page_thickness: int = 25
    line_least: tuple[int, int] = (15, 6)
    line_least_alone: tuple[int, int] = (30, 6)
    line_full_row: float = 0.6
    line_band: int = 2
    line_bridge: int = 9
    # The window of the local threshold.
    window_least: int = 31
    window_part: int = 8
    window_min_digit: int = 8
    window_digits: float = 2.5
    # How far strokes are from their target to be changed, and to which part of a digit at most.
    stroke_thin: float = 0.5
    stroke_fat: float = 2.0
    stroke_fat_target: float = 1.5
    stroke_grow_part: int = 6
    stroke_shrink_part: int = 10
    stroke_left: float = 0.3
    # Paper pixels that give a level of their own, and the share of ink that counts as the core.
    soft_paper: int = 20
    soft_core: float = 0.9

    @classmethod
    def of(cls, options: dict) -> Reading:
        """From an options table (strings are cast to the field's type); unknown names are an error."""
        base = cls()
        kinds = {k: type(v) for k, v in asdict(base).items()}
        cast = {k: (str(v).lower() in ("1", "true", "yes") if kinds[k] is bool and not isinstance(v, bool) else kinds[k](v)) for k, v in options.items()}
        return replace(base, **cast)

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Sheet:
    """Knobs of finding a sheet of paper."""

    # Defaults that decide results.
    max_side: int = 640
    min_area_frac: float = 0.04
    max_saturation: int = 90
    min_value: int = 0
    close_frac: float = 0.02
    approx_eps: float = 0.03
    edge_margin: int = 6
    fills_frame_frac: float = 0.9

    def to_dict(self) -> dict:
        return asdict(self)
