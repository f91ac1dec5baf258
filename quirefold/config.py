"""Sorter settings, their checks, presets and overlays."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from enum import IntEnum


class ReadingOrder(IntEnum):
    HORIZONTAL_LTR_TTB = 0
    HORIZONTAL_RTL_TTB = 1
    VERTICAL_TTB_RTL = 2
    VERTICAL_TTB_LTR = 3

    @property
    def horizontal(self) -> bool:
        return self in (ReadingOrder.HORIZONTAL_LTR_TTB, ReadingOrder.HORIZONTAL_RTL_TTB)

    @property
    def vertical(self) -> bool:
        return not self.horizontal

    @property
    def left_to_right(self) -> bool:
        return self in (ReadingOrder.HORIZONTAL_LTR_TTB, ReadingOrder.VERTICAL_TTB_LTR)

    @property
    def right_to_left(self) -> bool:
        return not self.left_to_right

    @property
    def top_to_bottom(self) -> bool:
        return True


class ConfigError(ValueError):
    """A setting outside its range; ``field`` names it."""

    def __init__(self, field: str, message: str):
        super().__init__(f"{field}: {message}")
        self.field = field


@dataclass(frozen=True)
class SorterConfig:
    max_permutations: int = 500_000
    precurse_length: int = 8
    min_words_for_early_passes: int = 16
    max_passes: int = 8
    max_word_distance: float = 0.5
    split_hyphenated: bool = True
    permutations_per_pass: int = 10_000
    reading_order: ReadingOrder = ReadingOrder.HORIZONTAL_LTR_TTB
    column_jump_penalty: float = 25.0
    rotation: bool = True
    wrap_bridging: bool = False
    enable_holes: bool = False
    max_hole_fraction: float = 0.2
    hole_path_penalty: float = 1.0
    enable_anchoring: bool = False
    anchor_tie_epsilon: float = 0.5
    enable_reconciliation: bool = False
    recon_spatial_window: float = 0.15
    recon_min_exact_anchors: int = 2
    repair_lines: bool = True
    detect_vertical: bool = True

    def validate(self) -> SorterConfig:
        positive = ("max_permutations", "permutations_per_pass", "max_word_distance")
        natural = ("precurse_length", "min_words_for_early_passes", "max_passes", "column_jump_penalty", "hole_path_penalty", "anchor_tie_epsilon", "recon_spatial_window", "recon_min_exact_anchors")
        for name in positive:
            if getattr(self, name) <= 0:
                raise ConfigError(name, "must be positive")
        for name in natural:
            if getattr(self, name) < 0:
                raise ConfigError(name, "must not be negative")
        if not 0 <= self.max_hole_fraction <= 1:
            raise ConfigError("max_hole_fraction", "must lie in 0 to 1")
        return self


def _preset(*values, **more) -> SorterConfig:
    names = ("max_permutations", "precurse_length", "min_words_for_early_passes", "max_passes", "max_word_distance", "split_hyphenated", "permutations_per_pass", "reading_order", "column_jump_penalty")
    return SorterConfig(**dict(zip(names, values)), **more)


_LTR, _RTL, _V = ReadingOrder.HORIZONTAL_LTR_TTB, ReadingOrder.HORIZONTAL_RTL_TTB, ReadingOrder.VERTICAL_TTB_RTL
#: Permutations, lookahead, words, passes, distance, hyphens, permutations a pass, order, penalty.
PRESETS = {
    "default": SorterConfig(),
    "fast": _preset(100_000, 5, 8, 5, 0.5, False, 10_000, _LTR, 25.0),
    "accurate": _preset(5_000_000, 10, 12, 12, 0.6, True, 50_000, _LTR, 25.0),
    "cjk": _preset(2_000_000, 10, 5, 10, 0.4, False, 30_000, _V, 30.0),
    "large_document": _preset(500_000, 8, 12, 10, 0.5, True, 15_000, _LTR, 25.0),
    "noisy_ocr": _preset(2_000_000, 10, 10, 10, 0.6, True, 30_000, _LTR, 25.0),
    "multi_column": _preset(1_500_000, 8, 8, 10, 0.4, True, 25_000, _LTR, 30.0),
    "rtl": _preset(1_000_000, 8, 10, 8, 0.5, False, 20_000, _RTL, 25.0),
}


def for_language(language: str) -> SorterConfig:
    """The settings for a language name; names are case-sensitive, and unknown ones get the general settings."""
    if language in ("chinese", "japanese"):
        return replace(PRESETS["cjk"], reading_order=_LTR, enable_holes=True, repair_lines=False)
    if language == "arabic":
        return replace(PRESETS["rtl"], enable_anchoring=True, wrap_bridging=True, repair_lines=False)
    return replace(SorterConfig(), wrap_bridging=True, enable_holes=True, enable_anchoring=True, enable_reconciliation=True, recon_min_exact_anchors=1)


def overlay(config: SorterConfig, spec: str) -> SorterConfig:
    """``config`` changed by ``field=value,...``; values are read by the type of the field."""
    kinds = {f.name: type(getattr(config, f.name)) for f in fields(config)}
    changes = {}
    for pair in filter(None, (p.strip() for p in spec.split(","))):
        name, found, value = pair.partition("=")
        if not found or name not in kinds:
            raise ConfigError(name, "unknown field or no value")
        kind = kinds[name]
        try:
            if kind is bool:
                changes[name] = {"true": True, "1": True, "false": False, "0": False}[value.lower()]
            else:
                changes[name] = kind(int(value) if issubclass(kind, int) else value)
        except (KeyError, ValueError) as e:
            raise ConfigError(name, f"cannot read {value!r}") from e
    return replace(config, **changes)
