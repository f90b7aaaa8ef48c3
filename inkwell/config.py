"""Constants of the engine. Results depend on each of them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # binarisation
    luma_r: float = 0.299
    luma_g: float = 0.587
    luma_b: float = 0.114
    binarize_threshold: int = 160
    alpha_min: int = 16
    # page index
    render_scale: float = 3.0
    index_max_mb: float = 250.0
    index_reserved_share: float = 0.25
    index_min_mb: float = 50.0
    release_hidden_after_min: float = 30.0
    dt_cache_pages: int = 6
    # templates
    # size limits
    max_index_pixels: float = 40e6
    max_snip_pixels: float = 8e6
    max_page_components: int = 100_000
    # segmentation
    min_cc_pixels: int = 4
    cluster_gap_px: int = 2
    # candidate gate
    scale_min: float = 0.12
    scale_max: float = 1.60
    scale_asymmetry_max: float = 0.28
    density_tolerance: float = 0.50
    max_anchors: int = 3
    anchor_min_ink_ratio: float = 0.35
    min_scaled_height_px: float = 6.0
    # scoring
    jitter_px: int = 1
    scale_refine: float = 0.035
    dt_max: int = 6
    tolerance_ratio: float = 0.10
    tolerance_min_px: float = 2.0
    reference_height_pt: float = 0.0
    weight_shape: str = "linear"
    attached_ink: bool = True
    script_max_gap: float = 0.40
    script_min_height: float = 0.25
    script_max_height: float = 1.15
    script_min_offset: float = 0.20
    script_min_overlap: float = 0.10
    punct_max_aspect: float = 0.55
    punct_head_fraction: float = 0.35
    punct_head_min_width: float = 0.75
    punct_head_solidity: float = 0.85
    punct_tail_max_width: float = 0.67
    accent_max_height: float = 0.4
    accent_max_width: float = 1.5
    accent_min_overlap: float = 0.5
    accent_max_gap: float = 0.25
    rule_max_thickness_px: int = 3
    rule_min_width: float = 0.7
    rescale_ink_fraction: float = 0.4
    score_combine: str = "harmonic"
    similarity_threshold: float = 0.90
    dedupe_iou: float = 0.5
    # index lookup
    index_max_pages: int = 40
    index_heading_scan_pages: int = 60
    index_heading_band: float = 0.25
    index_heading_max_chars: int = 40
    index_front_scan_pages: int = 40
    index_front_max_pages: int = 8
    index_top_line_tolerance: float = 0.01
    index_fallback_pages: int = 20
    index_fallback_min_lines: int = 3
    index_fallback_min_share: float = 0.3
    index_outline_max_entries: int = 10_000
    index_line_tolerance: float = 0.35
    index_max_gap: float = 0.04
    index_max_refs: int = 5
    rotated_text_min_chars: int = 40
    rotated_text_min_share: float = 0.1
    page_number_margin: float = 0.08
    offset_sample_pages: int = 9
    offset_search_radius: int = 4
    # results
    result_list_max: int = 300
    search_floor: float = 0.5
    snip_min_drag_px: float = 4.0
    scroll_headroom: float = 0.12
    label_pad: float = 0.08


CONFIG = Config()

# Patterns of index and notation titles.
INDEX_TITLE = r"(?i)^\s*(?:(?:chapter|appendix)\s+\w{1,3}[.:]?\s+|\d{1,3}(?:\.\d+)?[.:]?\s+|[a-z][.:]\s+)?(?:(?:subject|author|name|general|notation|symbol)\s+)?(?:index\b(?!\s+theor)|list of (?:symbols|notations?)\b|(?:table of )?notations?\b|symbols\b|glossary\b)"
NOTATION_TITLE = r"(?i)^\s*(?:(?:chapter|appendix)\s+\w{1,3}[.:]?\s+|\d{1,3}(?:\.\d+)?[.:]?\s+|[a-z][.:]\s+)?(?:list of (?:symbols|notations?)|(?:index|table) of (?:symbols|notations?)|notations?|symbols|glossary)\b"
