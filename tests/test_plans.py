"""Shape of the physical plans: no pairwise joins, no shuffle of the log where none is needed."""

import pytest

from themelift.operators.gram_match import gram_topk
from themelift.operators.hard_match import hard_match
from themelift.plans import fixtures
from themelift.plans.pipeline import match_themes
from themelift.sizing import stage
from themelift.sources.query_log import with_match_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    log = stage(with_match_text(fixtures.part_log(spark, SF)))
    return stage(fixtures.part_keywords(spark, SF)), log


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pairwise_join(spark, tables):
    for limit in (1 << 30, 0):
        text = plan(hard_match(*tables, limit=limit)) + plan(gram_topk(*tables, min_sim=0.8, limit=limit))
        assert "NestedLoop" not in text and "Cartesian" not in text
    text = plan(match_themes(*tables))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_log_is_not_shuffled_while_keywords_fit(spark, tables):
    """The branch that carries the log's ids reaches the hits through broadcast joins only."""
    lines = plan(hard_match(*tables)).splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "match_text" in line and "id#" in line)
    above, depth = [], len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    for line in reversed(lines[:scan]):
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            above.append(line)
            depth = indent
    assert any("BroadcastHashJoin" in line for line in above)
    assert not any("Exchange" in line for line in above)


def test_rank_is_cut_before_the_shuffle(spark, tables):
    assert plan(gram_topk(*tables, min_sim=0.8)).count("WindowGroupLimit") >= 2
