"""Settings of the engine: one frozen value, captured as literals when a plan is built, never read on executors."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    text_threshold: int = 40
    render_dpi: int = 200
    denoise_strength: int = 10
    ocr_language: str = "en"
    review_confidence: float = 0.8
    min_text_length: int = 6
    formula_placeholder: str = "[FORMULA]"
    crop_padding: int = 8
    formula_confidence: float = 0.55
    min_token_length: int = 4
    fuzzy_threshold: int = 88
    max_edit_distance: int = 2
    suspicious_ratio: float = 0.72
    #: Gap above the first text block, as a share of the page height, that starts an article.
    top_gap_ratio: float = 0.10

    @classmethod
    def from_env(cls, prefix: str = "FOLIARY_") -> EngineConfig:
        """Defaults overridden by environment variables of the driver."""
        found = {f.name: os.environ.get(prefix + f.name.upper()) for f in fields(cls)}
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[str(f.type)](found[f.name]) for f in fields(cls) if found[f.name] is not None})


DEFAULT = EngineConfig()

#: Closed sets of the data model.
PROCESSING_MODES = ["full", "no_preprocessing", "text_only"]
BLOCK_TYPES = ["text", "title", "formula", "table", "image", "header", "footer", "page_number"]
ROUTES = ["text_pipeline", "formula_pipeline", "table_pipeline", "image_pipeline"]
TEXT_ROUTE_TYPES = ["text", "title", "header", "footer", "page_number"]
TEXTUAL_TYPES = ["text", "title", "header", "footer"]
