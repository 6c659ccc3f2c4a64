"""Listings of posts, signal history, universe selections, relaxed unions, batches and audits, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions.indicators import full
from barloom.operators import columns, history, lake, learning, listing, loading, predictions, universe
from barloom.plans.feature_queries import W, _frame
from barloom.plans.market_queries import WITH, rounded
from barloom.plans.registry import register
from barloom.sources.bars import bars, table


def listings(spark, sf_dir):
    """Every event as a listing of up to three posts; some are cut off, some have none, some posts lack fields."""
    k = F.sequence(F.lit(1), F.lit(3))
    post = lambda i: F.struct(
        F.lit("t3").alias("kind"),
        F.struct(
            F.when((F.col("event_id") + i) % 7 > 0, F.concat(F.lit(" Post "), i.cast("string"), F.lit(" of "), F.col("event_type"), F.lit(" "))).alias("title"),
            F.when(i == 2, F.concat(F.lit("Text "), F.col("event_id").cast("string"))).alias("selftext"),
            F.when(i < 3, F.concat(F.lit("/r/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit("/"), i.cast("string"))).alias("permalink"),
            (F.unix_date(F.col("ts").cast("date")) * 86400 + i * 60).cast("double").alias("created_utc"),
            F.when(i != 2, F.col("event_id") % 100).alias("score"), (F.col("event_id") % 4 / 4.0).alias("upvote_ratio"),
            F.when(i == 1, F.lit("news")).alias("link_flair_text"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
        ).alias("data"),
    )
    children = F.transform(F.slice(k, 1, (F.col("event_id") % 4).cast("int")), post)
    json = F.to_json(F.struct(F.lit("Listing").alias("kind"), F.struct(children.alias("children")).alias("data")))
    cut = F.when(F.col("event_id") % 11 == 0, F.substring(json, 1, 30)).otherwise(json)
    return table(spark, sf_dir, "events").select("event_id", "user_id", cut.alias("json"))


@register(
    "listing_posts",
    """WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS d, unnest(range(1, event_id % 4 + 1)) AS i FROM events WHERE event_id % 11 > 0),
    p AS (SELECT *, CASE WHEN i < 3 THEN 'https://posts.example/r/' || user_id || '/' || event_id || '/' || i ELSE '' END AS url,
      CASE WHEN (event_id + i) % 7 > 0 THEN 'Post ' || i || ' of ' || event_type ELSE '' END AS title FROM e)
    SELECT event_id, CAST(i - 1 AS INTEGER) AS place, 'r/' || user_id AS source_name, url AS source_url, title,
      CASE WHEN i = 2 THEN title || chr(10) || chr(10) || 'Text ' || event_id ELSE title END AS body, 'u' || user_id AS author,
      strftime(CAST(d AS TIMESTAMP) + to_minutes(i), '%Y-%m-%d %H:%M:%S') AS published,
      '{"score":' || (CASE WHEN i <> 2 THEN event_id % 100 ELSE 0 END) || ',"upvote_ratio":' || CAST(event_id % 4 / 4.0 AS VARCHAR) || ',"num_comments":0'
        || CASE WHEN i < 3 THEN ',"permalink":"/r/' || user_id || '/' || event_id || '/' || i || '"' ELSE '' END
        || CASE WHEN i = 1 THEN ',"flair":"news"' ELSE '' END || ',"source":"r/' || user_id || '"}' AS source_metadata
    FROM p WHERE d >= DATE '2024-01-05'""",
)
def listing_posts(spark, sf_dir):
    """The posts of all listings as articles."""
    found = listing.posts(listings(spark, sf_dir), "json", "event_id", "user_id")
    name = F.concat(F.lit("r/"), F.col("user_id").cast("string"))
    out = listing.articles(found, name, "https://posts.example", F.lit("2024-01-05").cast("date"), "event_id")
    published = F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published")
    return out.select("event_id", "place", "source_name", "source_url", "title", "body", "author", published, "source_metadata")


@register(
    "signal_history",
    f"""{WITH}, m AS (SELECT ticker, date, close, volume, CASE WHEN count(close) {_frame(20)} >= 20 THEN avg(close) {_frame(20)} END AS ma FROM bars),
    s AS (SELECT ticker, date, close / ma - 1 AS d, volume FROM m WHERE abs((close - ma) / ma) >= 0.5),
    x AS (SELECT ticker, date, 'sma_distance' AS signal_type, CASE WHEN year(date) >= 1999 THEN 'HOLD' WHEN d > 0 THEN 'BUY' ELSE 'SELL' END AS action,
      CASE WHEN year(date) >= 1999 THEN 1 WHEN d > 0 THEN 70 ELSE 60 END AS confidence,
      CASE WHEN year(date) < 1999 THEN round(d, 4) END AS distance, CASE WHEN year(date) >= 1999 THEN CAST(volume AS DOUBLE) END AS revised FROM s)
    SELECT *, strftime(date, '%Y-%m') AS month FROM x""",
)
def signal_history(spark, sf_dir):
    """Signals saved, those from 1999 on saved again with other metadata, all read back with both kinds of metadata."""
    store = history.table(spark, f"{lake.scratch(spark)}/signals/{uuid.uuid4().hex}")
    b = bars(spark, sf_dir)
    made = predictions.DistanceGenerator(20, 0.5).signals(b).withColumn("distance", F.round("distance", 4))
    history.save(store, made)
    late = made.where("year(date) >= 1999").join(b.select("ticker", "date", "volume"), ["ticker", "date"])
    history.save(store, late.select("ticker", "date", "signal_type", F.lit("HOLD").alias("action"), F.lit(1.0).alias("confidence"), F.col("volume").cast("long").alias("revised")))
    out = history.load(store, distance="double", revised="double").withColumn("month", F.date_format("date", "yyyy-MM"))
    return out.drop("reasoning")


def tickers(spark, sf_dir):
    """Parts as a universe of tickers."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.concat(F.lit("M"), (F.col("p_partkey") % 5).cast("string")).alias("market"),
        F.col("p_brand").alias("exchange"), F.col("p_type").alias("sector"), F.concat(F.split("p_name", " "), F.array(F.concat(F.lit(" Size"), F.col("p_size").cast("string")))).alias("tags"),
        (F.col("p_size") % 9 > 0).alias("active"), F.col("p_size").cast("int").alias("priority"),
    )


_UNIVERSE = """u AS (SELECT 'P' || p_partkey AS symbol, 'M' || p_partkey % 5 AS market, p_brand AS exchange, p_type AS sector,
  list_transform(list_append(string_split(p_name, ' '), ' Size' || p_size), lambda x: lower(trim(x))) AS tags, p_size % 9 > 0 AS active, CAST(p_size AS INTEGER) AS priority FROM part)"""
_PICKS = {
    "any": ({"tags_any": ["RED", " blue"]}, "active AND list_has_any(tags, ['red', 'blue'])"),
    "all": ({"tags_all": ["red", "size11"]}, "active AND list_has_all(tags, ['red', 'size11'])"),
    "sector": ({"sector": "economy", "active_only": False}, "lower(sector) = 'economy'"),
    "exchange": ({"exchange": "BRAND#2"}, "active AND lower(exchange) = 'brand#2'"),
    "priority": ({"least_priority": 40, "market": "m3"}, "active AND priority >= 40 AND lower(market) = 'm3'"),
}


@register(
    "universe_filters",
    f"WITH {_UNIVERSE} "
    + " UNION ALL ".join(f"SELECT '{n}' AS pick, market, symbol FROM u WHERE {where}" for n, (_, where) in _PICKS.items())
    + """ UNION ALL SELECT 'group', market, symbol FROM u WHERE active AND ((market = 'M1' AND priority = 7) OR priority = 8)
    UNION ALL SELECT 'index', market, symbol FROM u WHERE list_has_all(tags, ['red', 'size11'])""",
)
def universe_filters(spark, sf_dir):
    """Each selection, by arrays and by the inverted table, with the name of the pick."""
    u = tickers(spark, sf_dir)
    named = lambda f, n: f.select(F.lit(n).alias("pick"), "market", "symbol")
    parts = [named(universe.select(u, **asked), n) for n, (asked, _) in _PICKS.items()]
    group = u.where("priority = 7 and market = 'M1'").select("market", "symbol").union(u.where("priority = 8").select(F.lit(None).cast("string"), "symbol"))
    parts += [named(universe.select(u, members=group), "group"), named(universe.by_index(universe.tag_index(u), ["red", "size11"], match_all=True), "index")]
    return loading.concatenated(parts)


@register(
    "universe_statistics",
    f"""WITH {_UNIVERSE} SELECT market, count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS inactive,
    array_to_string(list_sort(list(DISTINCT exchange)), ',') AS exchanges, array_to_string(list_sort(list(DISTINCT sector)), ',') AS sectors FROM u GROUP BY market""",
)
def universe_statistics(spark, sf_dir):
    out = universe.statistics(tickers(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("exchanges", "sectors")})


@register(
    "tag_parts",
    """SELECT DISTINCT ON (p_partkey, part) CAST(p_partkey AS BIGINT) AS k, part FROM (SELECT p_partkey, unnest([p_brand, trim(p_type), 'x' || p_size % 3]) AS part FROM part)""",
)
def tag_parts(spark, sf_dir):
    """Tags with signs between their parts, as parts."""
    listed = F.array(F.concat_ws(" | ", "p_brand", "p_type"), F.concat(F.lit("|x"), (F.col("p_size") % 3).cast("string"), F.lit("|")), F.col("p_type"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.explode(universe.tags_of(listed)).alias("part"))


@register(
    "relaxed_union",
    """SELECT CAST(l_orderkey AS DOUBLE) AS k, CAST(l_shipdate AS TIMESTAMP) AS at, l_returnflag AS note, NULL AS extra FROM lineitem WHERE l_linenumber = 1
    UNION ALL SELECT o_totalprice, CAST(o_orderdate AS TIMESTAMP), CAST(o_custkey AS VARCHAR), o_orderstatus FROM orders""",
)
def relaxed_union(spark, sf_dir):
    """Lines and orders in one frame: whole and broken numbers, dates and times, texts and numbers, a column that one side lacks."""
    a = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").cast("date").alias("at"), F.col("l_returnflag").alias("note"))
    b = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_custkey").alias("note"), F.col("o_orderstatus").alias("extra"))
    return loading.concatenated([a, b])


@register(
    "article_batches",
    """WITH b AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 15 AS batch FROM documents)
    SELECT source, CAST(batch AS INTEGER) AS batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM b GROUP BY ALL""",
)
def article_batches(spark, sf_dir):
    dealt = universe.batches(table(spark, sf_dir, "documents").select("source", "doc_id"), 15, "source", "doc_id")
    return dealt.groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@register(
    "social_balance",
    """SELECT user_id, count(*) FILTER (value > 50) AS positive, count(*) FILTER (value < 10) AS negative,
    round(coalesce((count(*) FILTER (value > 50) - count(*) FILTER (value < 10)) / nullif(count(*) FILTER (value > 50) + count(*) FILTER (value < 10), 0), 0), 5) AS score
    FROM events GROUP BY user_id""",
)
def social_balance(spark, sf_dir):
    sides = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("positive"), F.count_if(F.col("value") < 10).alias("negative"))
    return rounded(sides.withColumn("score", columns.balance("positive", "negative")), "score", digits=5)


@register(
    "bronze_day",
    f"""{WITH} SELECT ticker, date, volume FROM bars WHERE date = DATE '1998-03-02'""",
)
def bronze_day(spark, sf_dir):
    """One day of a table that is kept by day."""
    store = lake.LakeTable(spark, f"{lake.scratch(spark)}/bronze/{uuid.uuid4().hex}", ["ticker", "date"], "date")
    store.overwrite(bars(spark, sf_dir).where("year(date) = 1998 and month(date) = 3").select("ticker", "date", "volume"))
    return loading.of_day(store.read(), "1998-03-02")


@register(
    "training_audit",
    f"""{WITH}, r AS (SELECT *, close / lag(close) {W} - 1 AS r FROM bars), v AS (SELECT *, CASE WHEN count(r) {_frame(20)} >= 20 THEN stddev_samp(r) {_frame(20)} END AS vol FROM r),
    m AS (SELECT *, CASE WHEN count(close) {_frame(20)} >= 20 THEN avg(close) {_frame(20)} END AS ma FROM v)
    SELECT ticker, date, CASE WHEN close >= ma THEN 'BUY' ELSE 'SELL' END AS candidate_action, 'sma' AS candidate_source, round(abs((close - ma) / ma * 100), 5) AS candidate_score,
      round(1.5 * greatest(coalesce(vol, 0), 0.005), 5) AS upper_barrier_return, round(greatest(coalesce(vol, 0), 0.005), 5) AS lower_barrier_return, 10 AS vertical_barrier_days
    FROM m WHERE abs((close - ma) / ma * 100) >= 50""",
)
def training_audit(spark, sf_dir):
    """What a model of candidates was trained on, as written beside it."""
    b = bars(spark, sf_dir)
    ret = F.col("close") / F.lag("close").over(learning.by_ticker(b)) - 1
    rows = b.withColumn("_r", ret).withColumn("vol", full(b, F.stddev_samp, "_r", 20)).drop("_r")
    labelled = learning.triple_barrier(rows, "vol").drop("vol")
    found = learning.candidates(b, {"sma": (20, 50.0, -50.0)})
    path = f"{lake.scratch(spark)}/audit/{uuid.uuid4().hex}"
    learning.write_audit(found.join(labelled, ["ticker", "date"]), path, 10)
    out = spark.read.parquet(path).drop("meta_label", "barrier_outcome")
    return rounded(out, "candidate_score", "upper_barrier_return", "lower_barrier_return", digits=5)
