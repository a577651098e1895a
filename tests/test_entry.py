import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")

# The rest is compared at the larger scale by oracle_check.py.
QUICK = [
    "suppression_by_template",
    "structured_events",
    "numeric_level_events",
    "text_lines",
    "assembled_messages",
    "all_sources",
    "routed_events",
    "event_templates",
    "chat_top_templates",
    "window_classes",
    "event_bursts",
    "count_reports",
    "console_notices",
    "shortened_traces",
    "hot_methods",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, registry.queries()[name], registry.oracle_sql()[name]) is None


def test_registry(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.entry(spark).columns == ["level", "template", "processed", "suppressed"]
