"""Sessions, transcripts, identifiers, gated writes and histories, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.operators import calendar, columns, lake, loading, validation, writing
from barloom.plans.market_queries import WITH, rounded
from barloom.plans.registry import register
from barloom.sources.bars import bars, table

FIRST, LAST = "1995-01-01", "2001-12-31"
_SESSIONS = f"""ses AS (SELECT r_name AS market, CAST(d AS DATE) AS date, isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN ('01-01', '12-25') AS is_session
  FROM region, (SELECT unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 DAY)) AS d))"""


def _calendar(spark, sf_dir):
    markets = table(spark, sf_dir, "region").select(F.col("r_name").alias("market"))
    first, last = F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")
    years = markets.select("market", F.explode(F.sequence(F.year(first), F.year(last))).alias("y"))
    off = F.explode(F.array(F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(25))))
    return calendar.sessions(markets, first, last, years.select("market", off.alias("date")))


_OWN = """own AS (SELECT market, CAST(d AS DATE) AS date, isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN ('01-01', '12-25') AS is_session
  FROM (SELECT market, unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS d FROM bars GROUP BY market))"""


def _own_calendar(b):
    """The calendar of each market from its first bar to a week after its last one."""
    spans = b.groupBy("market").agg(F.min("date").alias("a"), F.date_add(F.max("date"), 7).alias("b"))
    years = spans.select("market", F.explode(F.sequence(F.year("a"), F.year("b"))).alias("y"))
    off = F.explode(F.array(F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(25))))
    return calendar.sessions(spans, F.col("a"), F.col("b"), years.select("market", off.alias("date")))


@register(
    "session_calendar",
    f"""{WITH}, {_OWN} SELECT o.market, o.date, is_session, count(b.ticker) AS n_bars FROM own o LEFT JOIN bars b ON b.market = o.market AND b.date = o.date
    GROUP BY o.market, o.date, is_session""",
)
def session_calendar(spark, sf_dir):
    """Each market's days with the bars that fell on them."""
    b = bars(spark, sf_dir)
    counts = b.groupBy("market", "date").agg(F.count("*").alias("n_bars"))
    return _own_calendar(b).join(counts, ["market", "date"], "left").withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))


@register(
    "next_sessions",
    f"""{WITH}, {_OWN}, n AS (SELECT a.market, a.date, min(b.date) AS next_session FROM own a LEFT JOIN own b
      ON a.market = b.market AND b.is_session AND b.date > a.date AND b.date <= a.date + 7 GROUP BY a.market, a.date)
    SELECT ticker, date, next_session FROM bars JOIN n USING (market, date)""",
)
def next_sessions(spark, sf_dir):
    """Every bar with the session on which its signal could be traded."""
    b = bars(spark, sf_dir)
    return b.join(calendar.next_session(_own_calendar(b)), ["market", "date"]).select("ticker", "date", "next_session")


@register(
    "session_counts",
    f"""{WITH}, {_OWN}, t AS (SELECT market, ticker, min(date) AS a, max(date) AS z FROM bars GROUP BY market, ticker),
    c AS (SELECT market, date, sum(is_session::INT) OVER (PARTITION BY market ORDER BY date) AS k FROM own)
    SELECT t.ticker, CAST(z.k - a.k + (SELECT is_session::INT FROM own o WHERE o.market = t.market AND o.date = t.a) AS BIGINT) AS sessions,
      (SELECT count(*) FROM bars b JOIN own o USING (market, date) WHERE b.ticker = t.ticker AND o.is_session) AS traded
    FROM t JOIN c a ON a.market = t.market AND a.date = t.a JOIN c z ON z.market = t.market AND z.date = t.z""",
)
def session_counts(spark, sf_dir):
    """Sessions between each ticker's first and last bar, and those with a bar."""
    b = bars(spark, sf_dir)
    c = _own_calendar(b)
    numbered = c.withColumn("_k", F.sum(F.col("is_session").cast("int")).over(columns.Window.partitionBy("market").orderBy("date")))  # a row a day
    days = b.join(numbered, ["market", "date"])
    first, last = (f(F.struct("_k", "is_session"), "date") for f in (F.min_by, F.max_by))
    out = days.groupBy("ticker").agg(first.alias("a"), last.alias("z"), F.count_if("is_session").alias("traded"))
    sessions = F.col("z._k") - F.col("a._k") + F.col("a.is_session").cast("int")
    return out.select("ticker", sessions.cast("long").alias("sessions"), "traded")


@register(
    "session_age",
    f"""{WITH}, {_SESSIONS}, l AS (SELECT market, max(date) AS latest_date FROM bars GROUP BY market)
    SELECT s.market, latest_date, max(date) FILTER (is_session) AS last_session,
      count(*) FILTER (is_session AND (latest_date IS NULL OR date > latest_date)) AS sessions_behind
    FROM ses s LEFT JOIN l ON s.market = l.market WHERE date <= DATE '2001-12-31' GROUP BY s.market, latest_date""",
)
def session_age(spark, sf_dir):
    return calendar.session_age(bars(spark, sf_dir), _calendar(spark, sf_dir), "2001-12-31")


@register(
    "missing_sessions",
    f"""{WITH}, {_SESSIONS}, t AS (SELECT DISTINCT market, ticker FROM bars)
    SELECT t.market, t.ticker, s.date FROM t JOIN ses s ON t.market = s.market AND s.is_session
    LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = s.date WHERE b.ticker IS NULL""",
)
def missing_sessions(spark, sf_dir):
    return calendar.missing_sessions(bars(spark, sf_dir), _calendar(spark, sf_dir))


@register(
    "market_dates",
    """SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS us,
      CAST(timezone('Asia/Shanghai', timezone('UTC', ts)) AS DATE) AS cn, CAST(ts AS DATE) AS other FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events)""",
)
def market_dates(spark, sf_dir):
    """The date of each event at two exchanges, and in UTC for an unknown one."""
    ts = F.col("ts").cast("timestamp_ntz")
    at = lambda m: calendar.market_today(ts, F.lit(m)).alias(m)
    return table(spark, sf_dir, "events").select("event_id", at("us"), at("cn"), at("other"))


_UUID = """CASE WHEN h IS NOT NULL THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) END"""


@register(
    "transcripts",
    f"""WITH t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, string_agg(role, ',' ORDER BY f) AS participants FROM (SELECT conv_id, role, min(turn) AS f FROM conversations
      WHERE role <> '' GROUP BY conv_id, role) GROUP BY conv_id),
    h AS (SELECT conv_id, body, sha1(unhex('{columns.URL_SPACE}') || encode('transcript_' || CAST(conv_id AS VARCHAR))) AS h FROM t WHERE trim(body) <> '')
    SELECT h.conv_id, {_UUID} AS article_id, length(body) AS n_chars, md5(body) AS body_md5, participants FROM h LEFT JOIN p ON h.conv_id = p.conv_id""",
)
def transcripts(spark, sf_dir):
    out = columns.transcripts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return out.select(
        "conv_id", "article_id", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("body_md5"),
        F.array_join("participants", ",").alias("participants"),
    )


@register(
    "frame_hash",
    """SELECT substr(sha256(CAST(sum(CAST(('0x' || substr(md5(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), coalesce(c_mktsegment, chr(0)),
      CAST(c_nationkey AS VARCHAR))), 1, 15)) AS BIGINT)) AS VARCHAR)), 1, 12) AS hash FROM customer""",
)
def frame_hash(spark, sf_dir):
    return columns.frame_hash(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))


@register(
    "gated_upsert",
    f"""{WITH} SELECT ticker, date, round(CASE WHEN year(date) >= 1998 THEN 2 ELSE 1 END * close, 6) AS close, volume FROM bars""",
)
def gated_upsert(spark, sf_dir):
    """Bars written, newer ones doubled and merged; a batch that breaks a rule and one without closes are refused."""
    b = bars(spark, sf_dir).select("market", "ticker", "date", "close", "volume", F.year("date").alias("year"))
    keys = ["market", *writing.keys_of("bronze/us"), "year"]  # a ticker is one series of each market that has it
    t = lake.LakeTable(spark, f"{lake.scratch(spark)}/gated/{uuid.uuid4().hex}", keys, "year")
    rules = {n: r for n, r in validation.PRICE_RULES.items() if n in ("close_positive", "volume_not_negative")}
    for rows in (
        b, b.where("year >= 1998").withColumn("close", F.col("close") * 2), b.withColumn("close", -F.col("close")),
        b.withColumn("close", F.lit(None).cast("double")),
    ):
        writing.gated_upsert(t, rows, ["ticker", "date", "close"], rules, ["market", "ticker", "date"])
    return rounded(t.read().drop("year", "market"), "close")


@register(
    "update_history",
    """SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey AS BIGINT) AS k, o_orderstatus AS status FROM orders
    ORDER BY 1 DESC, 2 LIMIT 20""",
)
def update_history(spark, sf_dir):
    entries = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderstatus").alias("status")
    )
    return loading.newest(entries, "date", "k")


@register("synthetic_bars")
def synthetic_bars(spark, sf_dir):
    """A year of random bars of each ticker, with the drift, spread and volume of its own bars."""
    return loading.walk_on(loading.walks_of(bars(spark, sf_dir)), 365)


@register(
    "signal_metadata",
    f"""{WITH} SELECT ticker, date, 'BUY' AS action, CASE WHEN volume > 30 THEN 'volume=' || CAST(CAST(volume AS BIGINT) AS VARCHAR) || ';' ELSE '' END || 'market=' || market
      AS metadata FROM bars""",
)
def signal_metadata(spark, sf_dir):
    """Signals with everything but their keys in one map, so that generators may add what they like."""
    volume = F.when(F.col("volume") > 30, F.col("volume").cast("long"))
    signals = bars(spark, sf_dir).select("ticker", "date", F.lit("BUY").alias("action"), volume.alias("volume"), "market")
    out = writing.with_metadata(signals, ["ticker", "date", "action"])
    entries = F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e.key, e.value))
    return out.withColumn("metadata", F.array_join(entries, ";"))
