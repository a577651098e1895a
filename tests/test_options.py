import dataclasses

import pytest

from hushlog import Options


def test_defaults():
    opts = Options()
    assert (opts.error_threshold, opts.warn_threshold, opts.info_threshold, opts.debug_threshold) == (5, 10, 20, 3)
    assert (opts.coordinates_ms, opts.chunk_ms, opts.general_ms) == (100, 500, 2000)
    assert (opts.show_count_after, opts.similarity_threshold, opts.max_depth) == (100, 85, 0)
    assert opts.fuzzy and opts.clean_traces and opts.show_notices and not opts.drop_framework_frames
    assert opts.allow_loggers == opts.deny_loggers == ()
    assert (opts.grain_ms, opts.idle_ms, opts.report_every_ms) == (100, 20_000, 10_000)


def test_settings_nested_or_dotted():
    opts = Options.from_settings(
        {"thresholds": {"error": 7}, "max_buffer_size": 9, "filters.blacklist": ["a"], "similarity": {"fuzzy_matching": False}}
    )
    assert (opts.error_threshold, opts.deny_loggers, opts.fuzzy) == (7, ("a",), False)
    assert opts.warn_threshold == 10
    with pytest.raises(KeyError):
        Options.from_settings({"thresholds": {"fatal": 1}})


def test_immutable_and_checked():
    opts = Options(deny_loggers=["x"])
    with pytest.raises(dataclasses.FrozenInstanceError):
        opts.enabled = False
    assert opts.deny_loggers == ("x",)
    assert opts.validate() is opts
    for bad in ({"general_ms": 50}, {"similarity_threshold": 49}, {"max_depth": 201}):
        with pytest.raises(ValueError):
            Options(**bad).validate()
    with pytest.raises(ValueError):
        Options(long_text="maybe")
    with pytest.raises(TypeError):
        Options(hot_rows=1.5)
