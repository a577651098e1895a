"""Template expression: volatile tokens of a message become wildcards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushlog.options import Options

# Private-use characters that fence a recognised token while a message is rewritten.
_OPEN, _STAR, _CLOSE = "\ue001", "\ue002", "\ue003"

# What counts as a volatile token, tried in this order at each position of the
# message, with its wildcard and the option that switches it on.  A token that matches is consumed
# whole, so a later pattern never sees part of it; plain numbers are consumed but kept.
# Named groups catch the one piece of text that tells the tokens apart afterwards.
_HEX = "[0-9a-fA-F]"
_WORD = "[A-Za-z0-9_.]"
_FLOAT = "-?[0-9]++(?:\\.[0-9]++)?+"
_INT = "-?[0-9]++"
TOKENS = (
    (
        f"(?<!{_HEX}){_HEX}{{8}}(?<dash>-){_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}(?!{_HEX})",
        f"{_STAR}-",
        "*UUID*",
        "normalize_uuids",
    ),
    (f"(?<at>@){_HEX}{{6,16}}+", f"@{_STAR}", "@*", "normalize_addresses"),
    (
        f"(?<!{_WORD})(?<round>\\(){_FLOAT}, *{_FLOAT}, *{_FLOAT}\\)",
        f"({_STAR}",
        "(*, *, *)",
        "normalize_coordinates",
    ),
    (
        f"(?<square>\\[){_INT}, *{_INT}\\]",
        f"[{_STAR}",
        "[*, *]",
        "normalize_coordinates",
    ),
    (f"{_FLOAT}(?<ms>ms)", f"{_STAR}ms", "*ms", "normalize_timings"),
    (f"{_FLOAT}(?<tick> tick)", f"{_STAR} tick", "* tick", "normalize_timings"),
    (
        f"(?<!{_WORD})-?[0-9]++(?<dot>\\.)[0-9]++(?!{_WORD})(?:, *{_FLOAT}(?:, *{_FLOAT})?+)?+",
        f"{_STAR}.",
        "*",
        "normalize_coordinates",
    ),
    (f"(?<number>{_FLOAT})", _STAR, "", None),
)
_BEFORE_STAR = ("at", "round", "square")
_AFTER_STAR = ("dash", "ms", "tick", "dot")

# Messages without any of these are their own template.
_MAY_HOLD_TOKENS = f"[0-9@]|{_HEX}{{8}}-{_HEX}{{4}}-"
# Messages without any of these hold plain numbers at most, which stay as they are.
_MAY_CHANGE = f"[0-9](?:ms| tick|\\.[0-9])|@{_HEX}{{6}}|[(\\[]-?[0-9]|{_HEX}-{_HEX}{{4}}-"
# Every token starts with one of these; spares the scan most positions.
_TOKEN_START = f"(?=[-0-9@(\\[]|{_HEX}{{8}}-)"


def template(message: Column, opts: Options) -> Column:
    """Message with its volatile tokens replaced; null becomes the empty string.

    One scan fences every token and keeps only the text that names its kind; plain string
    replacement then turns each kind into its wildcard.  Fence characters already present in a
    message that holds tokens are dropped.
    """
    text = F.coalesce(message, F.lit(""))
    active = [token for token in TOKENS if token[3] is None or getattr(opts, token[3])]
    if len(active) == 1:
        return text
    scan = _TOKEN_START + "(?:" + "|".join(token[0] for token in active) + ")"

    def kept(names: tuple[str, ...]) -> str:
        return "".join(f"${{{name}}}" for name in names if f"(?<{name}>" in scan)

    fenced = kept(("number",)) + _OPEN + kept(_BEFORE_STAR) + _STAR + kept(_AFTER_STAR) + _CLOSE
    fences = _OPEN + _STAR + _CLOSE
    has_fence = text.contains(_OPEN) | text.contains(_STAR) | text.contains(_CLOSE)
    clean = F.when(has_fence, F.translate(text, fences, "")).otherwise(text)
    result = F.regexp_replace(clean, scan, fenced)
    for _, kind, wildcard, _ in active:
        result = F.replace(result, F.lit(_OPEN + kind + _CLOSE), F.lit(wildcard))
    # plain numbers alone matter only where fence characters are to go
    scanned = F.when(has_fence, text.rlike(_MAY_HOLD_TOKENS)).otherwise(text.rlike(_MAY_CHANGE))
    return F.when(scanned, result).otherwise(text)


def label(logger: Column, level: Column, template_text: Column) -> Column:
    """Printable key: ``[level/logger] template``; nulls print as ``null``."""
    return F.format_string("[%s/%s] %s", level, logger, template_text)
