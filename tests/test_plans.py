"""Physical plans: pruned scans, one pass, no single-task window on a big table."""

import re

import pytest
from pyspark.sql import functions as F

from evenhand.catalog import governance, load
from evenhand.catalog.registry import QUERIES, SQL, event_frame, line_frame
from evenhand.operators import metrics as M
from evenhand.operators import splits as S
from evenhand.operators.cells import confusion_cells
from evenhand.operators.units import entity_weighted_cells

SF = "/root/testdata/sf0.001"
load()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_suite_reads_every_table_once(spark):
    text = plan(governance.priority_suites(spark, SF))
    assert len(re.findall(r"FileScan parquet", text)) == 3
    lineitem = next(line for line in text.splitlines() if "l_returnflag" in line and "FileScan" in line)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", lineitem).group(1)
    assert "l_extendedprice" not in schema and "l_tax" not in schema


def test_cells_combine_before_the_shuffle(spark):
    text = plan(confusion_cells(line_frame(spark, SF)))
    assert "partial_count" in text and "partial_sum" in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_filter_reaches_the_scan(spark):
    text = plan(QUERIES["parquet_scan"](spark, SF))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(o_totalprice,250000", text)
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", text)


def test_group_split_labels_without_moving_rows(spark):
    e = event_frame(spark, SF)
    text = plan(S.group_split(e, "entity_id"))
    assert "Exchange" not in text and "Join" not in text
    assert "Exchange" not in plan(S.temporal_split(e, "ts", "row_id"))


def test_entity_weights_fold_before_the_window(spark):
    text = plan(entity_weighted_cells(event_frame(spark, SF)))
    window_at = text.index("Window [")
    assert "HashAggregate" in text[window_at:]  # the window sits on aggregated rows


@pytest.mark.parametrize("name", ["disparity_summary", "evaluation_suites", "bootstrap_ci", "group_split", "pct_rank"])
def test_results_do_not_depend_on_shuffle_width(spark, name):
    def rows(width):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(width))
        try:
            df = QUERIES[name](spark, SF)
            return sorted(repr(r) for r in df.select(*sorted(df.columns)).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)

    assert rows(1) == rows(17)


def test_every_sql_has_a_query(spark):
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 150


def test_disparities_of_many_runs_in_one_aggregation(spark):
    e = event_frame(spark, SF).withColumn("run", F.col("event_type"))
    wide = M.disparity_wide(confusion_cells(e, ("run", "grp")), M.Gates(1), by=("run",))
    assert plan(wide).count("FileScan") == 1 and wide.count() == 5


def test_long_suites_decide_as_nested_ones(spark):
    from evenhand.catalog import governance
    from evenhand.plans import policy as P
    from evenhand.plans.evaluate import AuditConfig, evaluate, evaluate_long

    e = event_frame(spark, SF).withColumn("run", F.col("event_type"))
    rules = [governance.FLOORS, P.Policy(), P.Policy("Named", critical_subgroups=("q1", "nobody"), require_subgroup_support=True)]
    for gates in (M.Gates(1), M.Gates(2500, 5, 5)):
        cfg = AuditConfig(by=("run",), gates=gates, with_auc=False)
        nested = {(r["run"], r["policy"]["name"]): r for r in P.decide(evaluate(e, cfg), rules).collect()}
        suites, groups = evaluate_long(e, cfg)
        decided, evidence = P.decide_long(suites, groups, rules)
        rows = {(r["run"], r["policy"]["name"]): r for r in decided.collect()}
        assert set(rows) == set(nested)
        for k, r in rows.items():
            for c in ("decision", "violation_count", "abstention_count", "is_fair", "is_useful", "dp_value", "worst_groups", "evidence_state"):
                assert r[c] == nested[k][c], (k, c)
            assert set(r["reason_codes"]) == set(nested[k]["reason_codes"])
        want = sorted((k, c["subgroup"], c["reason_code"]) for k, r in nested.items() for c in r["checks"] if c["subgroup"] is not None)
        assert sorted(((r["run"], r["policy_name"]), r["subgroup"], r["reason_code"]) for r in evidence.collect()) == want


def test_a_million_intersection_labels(spark):
    """No list of groups anywhere: suites, decisions, evidence and redaction of a run with a million labels."""
    from evenhand.operators import ranking
    from evenhand.plans import policy as P
    from evenhand.plans.evaluate import AuditConfig, evaluate_long

    df = spark.range(4_000_000).selectExpr(
        "concat('a', id % 1000, '_x_b', id DIV 1000 % 1000) AS grp", "CAST(id >= 2000000 AS INT) AS y_true", "CAST(id >= 2000000 OR id % 1000000 < 10 AS INT) AS y_pred")
    suites, groups = evaluate_long(df, AuditConfig(gates=M.Gates(1), with_auc=False))
    decided, evidence = P.decide_long(suites, groups, [P.Policy(min_subgroup_specificity=0.5)])
    r = decided.first()
    assert (r["groups"], r["violation_count"] >= 10, len(r["worst_groups"])) == (1_000_000, True, 3) and "subgroups" not in decided.columns
    assert evidence.count() == 10 and {x["reason_code"] for x in evidence.collect()} == {"SUBGROUP_SPECIFICITY_BELOW_MINIMUM"}
    shown = ranking.redacted_subgroups(groups.select("grp", "n"), 2, max_groups=5, mask_labels=True)
    assert [x["grp"] for x in shown.orderBy("disclosure_rank").collect()] == [f"REDACTED_GROUP_00{i}" for i in range(1, 6)]
    every = ranking.redacted_subgroups(groups.select("grp", "n"), 2)
    assert every.agg(F.min("disclosure_rank"), F.max("disclosure_rank"), F.count_distinct("disclosure_rank")).first()[:] == (1, 1_000_000, 1_000_000)
