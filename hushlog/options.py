"""Job options: one immutable object, turned into plan literals by the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

# The legal range of each numeric option.
RANGES = {
    "error_threshold": (1, 100),
    "warn_threshold": (1, 100),
    "info_threshold": (1, 100),
    "debug_threshold": (1, 100),
    "coordinates_ms": (10, 60_000),
    "chunk_ms": (10, 60_000),
    "general_ms": (100, 60_000),
    "show_count_after": (1, 10_000),
    "similarity_threshold": (50, 100),
    "max_depth": (0, 200),
}

# Option names as they appear in a settings file, section by section.
SETTING_NAMES = {
    "enabled": "enabled",
    "debug_mode": "debug_mode",
    "thresholds.error": "error_threshold",
    "thresholds.warn": "warn_threshold",
    "thresholds.info": "info_threshold",
    "thresholds.debug": "debug_threshold",
    "time_windows.coordinates_ms": "coordinates_ms",
    "time_windows.chunk_ms": "chunk_ms",
    "time_windows.general_ms": "general_ms",
    "show_count_after": "show_count_after",
    "similarity.fuzzy_matching": "fuzzy",
    "similarity.threshold": "similarity_threshold",
    "normalization.coordinates": "normalize_coordinates",
    "normalization.uuids": "normalize_uuids",
    "normalization.memory_addresses": "normalize_addresses",
    "normalization.timings": "normalize_timings",
    "filters.whitelist": "allow_loggers",
    "filters.blacklist": "deny_loggers",
    "system_streams.enabled": "console_enabled",
    "system_streams.detect_multiline": "detect_multiline",
    "stacktraces.clean": "clean_traces",
    "stacktraces.remove_common_frames": "drop_framework_frames",
    "stacktraces.max_depth": "max_depth",
    "output.show_suppression_message": "show_notices",
}

# Settings that are accepted but change nothing here.
UNUSED_SETTINGS = ("max_buffer_size", "system_streams.multiline_timeout_ms")


@dataclass(frozen=True)
class Options:
    """All settings of a suppression job, with their default values."""

    enabled: bool = True
    debug_mode: bool = False
    # repeats let through per burst
    error_threshold: int = 5
    warn_threshold: int = 10
    info_threshold: int = 20
    debug_threshold: int = 3
    # gap that ends a burst, per message class
    coordinates_ms: int = 100
    chunk_ms: int = 500
    general_ms: int = 2000
    show_count_after: int = 100
    fuzzy: bool = True
    similarity_threshold: int = 85
    long_text: str = "exact"
    normalize_coordinates: bool = True
    normalize_uuids: bool = True
    normalize_addresses: bool = True
    normalize_timings: bool = True
    allow_loggers: tuple[str, ...] = ()
    deny_loggers: tuple[str, ...] = ()
    console_enabled: bool = True
    detect_multiline: bool = True
    clean_traces: bool = True
    drop_framework_frames: bool = False
    max_depth: int = 0
    show_notices: bool = True
    # report on the count rule alone when False
    report_by_time: bool = True
    notice_logger: str = "hushlog.notices"
    # a (key, moment) with more rows than this is split further before rows are ranked
    hot_rows: int = 1_000_000
    # longest run of consecutive positions that one task orders at a time
    block_rows: int = 65_536

    def __post_init__(self) -> None:
        object.__setattr__(self, "allow_loggers", tuple(self.allow_loggers))
        object.__setattr__(self, "deny_loggers", tuple(self.deny_loggers))
        if self.long_text not in ("length_only", "exact"):
            raise ValueError("long_text must be 'length_only' or 'exact'")
        if self.hot_rows < 1 or self.block_rows < 1:
            raise ValueError("hot_rows and block_rows must be positive")
        for name in (*RANGES, "hot_rows", "block_rows"):
            if isinstance(getattr(self, name), bool) or not isinstance(getattr(self, name), int):
                raise TypeError(f"{name} must be an int")

    def validate(self) -> "Options":
        """Check the documented ranges; loading alone does not enforce them."""
        for name, (low, high) in RANGES.items():
            value = getattr(self, name)
            if not low <= value <= high:
                raise ValueError(f"{name}={value} is outside {low}..{high}")
        return self

    def with_(self, **changes: Any) -> "Options":
        return replace(self, **changes)

    @classmethod
    def from_settings(cls, settings: dict[str, Any]) -> "Options":
        """Build options from dotted or nested setting names; unknown names are an error."""
        flat: dict[str, Any] = {}

        def walk(prefix: str, node: dict[str, Any]) -> None:
            for name, value in node.items():
                path = f"{prefix}{name}"
                if isinstance(value, dict):
                    walk(f"{path}.", value)
                else:
                    flat[path] = value

        walk("", settings)
        for name in UNUSED_SETTINGS:
            flat.pop(name, None)
        unknown = sorted(set(flat) - set(SETTING_NAMES))
        if unknown:
            raise KeyError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{SETTING_NAMES[name]: value for name, value in flat.items()})

    @property
    def passes_all(self) -> bool:
        return not self.enabled or self.debug_mode

    @property
    def grain_ms(self) -> int:
        """Width of a moment: no longer than any gap, so no burst ends inside one."""
        return max(1, min(self.coordinates_ms, self.chunk_ms, self.general_ms))

    @property
    def idle_ms(self) -> int:
        """A key idle for longer than this is forgotten."""
        return 10 * self.general_ms

    @property
    def report_every_ms(self) -> int:
        return 5 * self.general_ms
