"""Plan-shape assertions: the physical plans keep the shapes the design relies on."""

import re

import pytest

import __spark_entry__ as E
from shelfspark.operators import profile as P
from shelfspark.operators.text import sentiment_scores
from shelfspark.plans.frames import enriched
from shelfspark.sources.tables import read_table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("section", ["missing_values", "null_counts"])
def test_section_is_one_aggregate_without_row_growth(spark, sf_small, section):
    p = plan(getattr(P, section)(enriched(spark, sf_small)))
    assert p.count("Scan parquet") == 3           # order lines, parts, texts: each once
    assert len(re.findall(r"Exchange SinglePartition", p)) == 1  # one global aggregate
    assert "Generate" not in p[p.index("HashAggregate(keys=[], functions=[partial"):]


def test_correlations_are_one_pass(spark, sf_small):
    p = plan(P.correlation_matrix(enriched(spark, sf_small)))
    assert p.count("Scan parquet") == 3 and p.count("MapInArrow") == 1 and "Generate" not in p


@pytest.mark.parametrize("name", ["price_stats", "rating_stats", "text_length_stats", "describe_numeric", "stock_risk",
                                  "median_impute", "dataset_summary"])
def test_quantiles_use_no_value_map(spark, sf_small, name):
    assert "percentile(" not in plan(E.queries()[name](spark, sf_small))


def test_sentiment_moves_no_text(spark, sf_small):
    p = plan(sentiment_scores(read_table(spark, sf_small, "documents"), "doc_id", "text"))
    assert "Exchange" not in p and "Join" not in p


def test_bundle_pairs_joins_pairs_once(spark, sf_small):
    p = plan(E.queries()["pair_self_join"](spark, sf_small))
    assert len(re.findall(r"SortMergeJoin \[u#\d+[^\n]*b1#", p)) == 1


NO_PAIRS = sorted(n for n in E.queries() if not re.match(r"op\d+_|pipeline", n))


@pytest.mark.parametrize("name", [n for n in NO_PAIRS if not n.startswith(("stream_", "score_stream", "sink_",
                                                                            "src_vector", "shap", "sort_contrib",
                                                                            "explanation", "retrain"))])
def test_no_cartesian_or_unpartitioned_window(spark, sf_small, name):
    p = plan(E.queries()[name](spark, sf_small))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    # a window without partitioning must never sit directly on a scan of raw rows
    for m in re.finditer(r"Window \[[^\n]*\], \[\]", p):
        tail = p[m.end(): m.end() + 400]
        assert "Scan parquet" not in tail.split("Exchange")[0]
