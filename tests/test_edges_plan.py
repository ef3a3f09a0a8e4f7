from gleanery.sources import estate


def test_links_are_dealt_by_columns_not_by_subqueries(spark):
    """The ring's length stands in a join's key: it is a joined row, since a subquery there stands within exchanges and sorts too."""
    plan = estate.load(spark, "/root/testdata/sf0.001").edges._jdf.queryExecution().executedPlan().toString()
    assert "ubquery" not in plan and "ring" in plan


def test_links_between_unlike_urls_pair_no_pages_but_by_keys(spark):
    """A condition on both ends of a link, as frontier_bfs has one, makes no product of all pages with all."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = estate.load(spark, "/root/testdata/sf0.001").edges.where("from_url <> to_url")
        plan = links._jdf.queryExecution().executedPlan().toString()
        nested = [line for line in plan.splitlines() if "CartesianProduct" in line or "NestedLoopJoin" in line]
        assert all("Cross" in line and "url" not in line for line in nested) and "CartesianProduct" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_links_are_the_same_where_a_join_turns_to_a_broadcast_while_it_runs(spark):
    """Which side of the ring is sent to all tasks is decided by sizes that are found while the query runs. Where that side's key held a
    subquery, it was asked for before it had been answered: `requirement failed: Subquery has not finished`."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    found = set()
    try:
        spark.conf.set(names[0], "-1")
        # below all sides' sizes, between those of a quarter of the pages and of all, and above
        for most in (-1, 2_000, 4_000, 8_000, 12_000, 16_000, 1_000_000):
            spark.conf.set(names[1], str(most))
            links = estate.load(spark, "/root/testdata/sf0.01").edges
            found.add(links.selectExpr("count(*)", "sum(xxhash64(run, seq, from_url, to_url, link_text) % 1000003)").first())
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert len(found) == 1 and found.pop()[0] > 0
