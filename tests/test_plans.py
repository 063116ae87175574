"""Plan shape: exchanges, broadcasts, partial top-k, pushed filters."""

import re

from vigil.plans import catalog

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_exchanges(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")   # else the filters' text is cut
    p = plan(catalog.QUERIES["channel_health"](spark, SF_SMALL))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    hashed = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
    # facts agg, site agg, one by client for all windows; days come from a sequence
    assert len(hashed) == 3, hashed
    scans = re.findall(r"FileScan parquet[^\n]*", p)
    assert len(scans) == 2 and all("GreaterThanOrEqual(ts" in s and "LessThan(ts" in s for s in scans)
    assert sum(h.startswith("client") and "d_date_id" not in h and "," in h for h in hashed) == 1
    assert "BroadcastExchange" in p
    assert "SinglePartition" not in p
    assert "In(event_type, [click,purchase,view])" in p


def test_top_products_limits_before_the_shuffle(spark):
    p = plan(catalog.QUERIES["daily_top_products"](spark, SF_SMALL))
    # a plan prints parents first: the partial limit sits below the exchange on (client, date)
    below = p[p.index("Exchange hashpartitioning(client"):]
    limit = re.search(r"WindowGroupLimit \[client[^\n]*Partial", below)
    assert limit and re.search(r"WindowGroupLimit \[client[^\n]*Final", p[:p.index(below)])


def test_what_if_needs_no_sort(spark):
    p = plan(catalog.QUERIES["threshold_what_if"](spark, SF_SMALL))
    assert "Window" not in p and "Sort " not in p


def test_small_dimensions_broadcast(spark):
    p = plan(catalog.QUERIES["importance"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p
    p = plan(catalog.QUERIES["threshold_what_if"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p


def test_column_pruning_reaches_scan(spark):
    p = plan(catalog.QUERIES["bid_dates"](spark, SF_SMALL))
    scan = re.search(r"ReadSchema: (struct<[^>]*>)", p) or re.search(r"FileScan parquet [^\[]*\[([^\]]*)\]", p)
    assert scan and "l_extendedprice" not in scan.group(1)


def test_gradient_groups_emit_partial_sums(spark):
    p = plan(catalog.QUERIES["batch_gradient"](spark, SF_SMALL))
    # above the groups of bounded size only (param, i, j) sums are shuffled, added up before and after
    above = p[:p.index("FlatMapCoGroupsInPandas")]
    assert above.count("HashAggregate(keys=[param") == 2 and above.count("Exchange") == 1
    assert "Literal" not in p and len(p) < 20_000   # no weight stands in the plan


def test_skipgram_joins_only_edge_tokens(spark):
    p = plan(catalog.QUERIES["skipgram_pairs"](spark, SF_SMALL))
    # in-document contexts come from a document's row of ids: no window, and the only join is on stream positions
    assert "Window" not in p and len(re.findall(r"\w+Join ", p)) == 1 and re.search(r"Join \[t#", p), p


def test_rank_percentile_has_no_window_over_a_client_day(spark):
    p = plan(catalog.QUERIES["bid_rank_percentile"](spark, SF_SMALL))
    # the only windows run over one total per (partition, client, date)
    assert p.count("Window ") <= 1 and "percentile_approx" not in p


def test_comparison_filters_before_it_aggregates(spark):
    p = plan(catalog.QUERIES["compare_importance"](spark, SF_SMALL))
    # a plan prints parents first: below the aggregation stands the selection
    assert "nation_9" in p[p.index("min_by"):]
