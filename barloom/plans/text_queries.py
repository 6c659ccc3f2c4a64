"""Text, JSON and array operators, and the weekly window, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import texts
from barloom.plans.market_queries import rounded
from barloom.plans.registry import register
from barloom.sources.bars import table


@register(
    "html_strip",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages""",
)
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.strip_html("html").alias("body"))


@register(
    "json_path",
    """SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total_k,
    count(*) - count(json_extract_string(props, '$.none')) AS without FROM events GROUP BY event_type""",
)
def json_path(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(k).alias("total_k"), F.count_if(F.get_json_object("props", "$.none").isNull()).alias("without")
    )


@register(
    "explode_tickers",
    """WITH x AS (SELECT doc_id, list_filter(['A', 'B', 'C'], lambda t: contains(coalesce(text, ''), 'th' || lower(t)) ) AS ts FROM documents)
    SELECT doc_id, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE ts END) AS ticker FROM x""",
)
def explode_tickers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(f"th{t.lower()}")), t) for t in "ABC"]))
    return texts.explode_outer(docs.select("doc_id", found.alias("tickers")), "tickers", "ticker")


@register(
    "lexicon_sentiment",
    """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS w FROM documents),
    s AS (SELECT doc_id, count(*) FILTER (w IN ('good', 'great', 'best', 'the')) AS p,
      count(*) FILTER (w IN ('trash', 'worthless', 'disgusting', 'bad')) AS n FROM w GROUP BY doc_id)
    SELECT doc_id, p AS positive, n AS negative, round(coalesce((p - n) / nullif(p + n, 0), 0), 6) AS compound,
      CASE WHEN coalesce((p - n) / nullif(p + n, 0), 0) >= 0.05 THEN 'positive'
           WHEN coalesce((p - n) / nullif(p + n, 0), 0) <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM s""",
)
def lexicon_sentiment(spark, sf_dir):
    lexicon = {w: 1 for w in ("good", "great", "best", "the")} | {w: -1 for w in ("trash", "worthless", "disgusting", "bad")}
    return rounded(texts.lexicon_sentiment(table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon).drop("text"), "compound")


@register(
    "conversation_turns",
    """SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles,
    len(list_distinct(list(role))) AS n_roles, sum(length(text)) AS chars FROM conversations GROUP BY conv_id""",
)
def conversation_turns(spark, sf_dir):
    return texts.thread(table(spark, sf_dir, "conversations"))


@register(
    "incremental_silver",
    """SELECT doc_id, lang, source FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND (source IN ('src1', 'src2', 'src3') OR source IS NULL)""",
)
def incremental_silver(spark, sf_dir):
    docs, done = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return texts.unprocessed(docs, done, "doc_id").where(F.col("source").isNull() | F.col("source").isin("src1", "src2", "src3")).select("doc_id", "lang", "source")


@register(
    "section_split",
    r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '<p>([^<]*)', 1)) AS s FROM pages)
    SELECT page_id, count(*) AS n_sections, max(length(trim(s))) AS longest FROM s WHERE length(trim(s)) > 50 GROUP BY page_id""",
)
def section_split(spark, sf_dir):
    parts = F.regexp_extract_all("html", F.lit(r"<p>([^<]*)"), F.lit(1))
    kept = table(spark, sf_dir, "pages").select("page_id", F.explode(parts).alias("s")).where(F.length(F.trim("s")) > 50)
    return kept.groupBy("page_id").agg(F.count("*").alias("n_sections"), F.max(F.length(F.trim("s"))).cast("long").alias("longest"))


@register(
    "weekly_window",
    """SELECT CAST(ts AS DATE) - CAST((CAST(ts AS DATE) - DATE '1970-01-01') % 7 AS INTEGER) AS week, event_type, count(*) AS n,
    round(sum(value), 6) AS total FROM events GROUP BY 1, 2""",
)
def weekly_window(spark, sf_dir):
    from barloom.streaming.events import weekly

    return rounded(weekly(table(spark, sf_dir, "events")), "total")
