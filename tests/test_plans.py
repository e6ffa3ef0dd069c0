"""Physical plan checks: pushdown, pruning, bounded top-k, no cartesian."""

from chatlake.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_anywhere(spark):
    skip = {"stream_ingest", "stream_mentions", "store_mixed", "search_text", "stream_first_seen", "stream_activity", "ingest_messages",
            "reembed_all", "update_primer", "schema_tables"}   # these read back written tables
    for name, fn in catalog.QUERIES.items():
        if name in skip:
            continue
        p = plan(fn(spark, SF))
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_user_history_pushdown_and_pruning(spark):
    p = plan(catalog.QUERIES["user_history_channel"](spark, SF))
    assert "PushedFilters" in p and "EqualTo(event_type,click)" in p
    assert "embedding" not in p     # vectors are never read for text queries


def test_topk_plans(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["recent_chats_desc"](spark, SF))
    p = plan(catalog.QUERIES["recent_chats_all"](spark, SF))
    assert "WindowGroupLimit" in p   # per-channel limit applied before the shuffle


def test_search_filters_reach_scan(spark):
    p = plan(catalog.QUERIES["vector_search"](spark, SF))
    assert "TakeOrderedAndProject" in p
    assert "PushedFilters" in p and "Not(EqualTo(user_id" not in p


def test_context_lookup_prunes_id_blocks(spark):
    """On the stored layout (partitioned by id block) the context join
    reads only the blocks holding hits: dynamic partition pruning."""
    import datetime as dt
    from pyspark.sql import functions as F
    from chatlake.operators import ingest as ing
    from chatlake.operators import search as srch
    from chatlake.operators import store as st
    from chatlake.session import run_dir
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), f"u{i % 3}", "c", f"m{i}",
             [1.0, float(i % 5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, sender string, channel string, "
                                     "message string, vector array<float>")
    path = run_dir(spark, "t_blocks")
    st.add(df.drop("vector").withColumnRenamed("id", "source_id"), path, "import", block=50)
    store = spark.read.parquet(path)
    assert "id_block" in store.columns
    hits = store.where(F.col("id") == 7).select(F.lit(1).alias("hit_rank"), "id", "channel")
    old = ing.ID_BLOCK
    try:
        srch.ID_BLOCK = 50
        ctx = srch.search_context(store, hits)
        assert sorted(r.id for r in ctx.collect()) == [5, 6, 7, 8, 9]
        ctx.collect()
        final = ctx._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in final.lower() or "DynamicPruning" in final
    finally:
        srch.ID_BLOCK = old
