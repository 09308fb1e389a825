"""What plans must not have, and what their scans read."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["nuc_counts", "kmer_count_topk", "minimizer_window", "pairwise_jaccard", "bottomk_jaccard", "tax_lca_sets", "lca_map", "classify", "pattern_adjacency", "tax_dist", "screen"]


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_joins_and_narrow_scans(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan), plan
    assert "BatchEvalPython" not in plan
    for schema in re.findall(r"documents\.parquet.*?ReadSchema: struct<(.*?)>", plan):
        assert "n_chars" not in schema


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["tax_used"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = re.search(r"PushedFilters: \[([^\]]*)\][^\n]*s_acctbal", plan) or re.search(r"s_acctbal[^\n]*PushedFilters: \[([^\]]*)\]", plan)
    assert scan and "GreaterThan(s_acctbal" in scan[1]


def test_a_database_is_one_shuffle_by_kmer(spark):
    from strandloom.functions.specs import Seed
    from strandloom.operators import kmers as K

    rows = K.spans(spark.createDataFrame([(1, "ACGTACGT")], "ord long, seq string"), Seed(4), "ord")
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
