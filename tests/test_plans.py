"""What the physical plans must and must not hold."""

import pytest

from cohortlake import plans

QUERIES = plans.QUERIES
SETTLED = [n for n in sorted(QUERIES) if not n.endswith("_stream")]
# these settle rows in a pinned table before their last plan
PINNED = {"result_pages", "register_users", "eligible_pool_size"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SETTLED)
def test_no_pair_joins_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in text
    if name not in PINNED:
        assert "Exchange SinglePartition" not in text or "Window" not in text.split("Exchange SinglePartition")[0]


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["trials_filtered"](spark, sf_dir))
    assert "EqualTo(o_orderstatus,O)" in text or "o_orderstatus" in text.split("PushedFilters")[1]


def test_scans_read_only_the_columns_they_need(spark, sf_dir):
    text = plan(QUERIES["phase_distribution"](spark, sf_dir))
    read = [part.split("\n")[0] for part in text.split("ReadSchema: ")[1:]]
    assert any("o_orderpriority" in r for r in read)
    assert not any("o_totalprice" in r or "c_acctbal" in r for r in read)


def test_user_windows_share_one_shuffle(spark, sf_dir):
    """Language, carried id and both request scans use one sort per user."""
    from cohortlake.operators.chat import route
    from cohortlake.sources.adapters import view

    text = plan(route(view(spark, sf_dir, "chat_v"), view(spark, sf_dir, "results_v")))
    head = text.split("Scan parquet")[0]
    assert head.count("Window ") >= 2
    between_windows = head[head.index("Window "):head.rindex("Window ")]
    assert "Exchange hashpartitioning(user_id" not in between_windows
