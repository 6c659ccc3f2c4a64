"""Sections of pages and the silver table of extracted sections, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import sections
from barloom.plans.registry import register, twin
from barloom.sources.bars import table

#: What stands for headings in the driver's pages: a script's call at the top, four words in the prose, the mark in the footer.
HEADINGS = {"opening": r"track\([0-9]+\);", "prose": r" (?:with|dans|para|und) ", "closing": "©", "absent": "item 1a risk factors"}


def _start(pattern: str) -> str:
    found, rest = f"regexp_extract_all(t, '{pattern}')", f"regexp_split_to_array(t, '{pattern}')"
    return f"CASE WHEN len({found}) > 0 THEN length(t) - length({rest}[-1]) - length({found}[-1]) END"


@register(
    "filing_sections",
    rf"""WITH p AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
      '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t\r\n\f\x{{a0}}]+', ' ', 'g')) AS t FROM pages),
    b AS ({" UNION ALL ".join(f"SELECT page_id, t, '{name}' AS section, {n} AS k, {_start(p)} AS pos FROM p" for n, (name, p) in enumerate(HEADINGS.items()))}),
    s AS (SELECT page_id, section, pos, trim(substr(t, pos + 1, coalesce(lead(pos) OVER (PARTITION BY page_id ORDER BY pos, k), length(t)) - pos)) AS body
      FROM b WHERE pos IS NOT NULL)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS place, section, CAST(pos AS INTEGER) AS start, body
    FROM s WHERE length(body) > 50""",
)
def filing_sections(spark, sf_dir):
    """Every page's text between the last matches of its headings."""
    return sections.filing_sections(table(spark, sf_dir, "pages"), "page_id", "html", HEADINGS)


def section_articles(spark, sf_dir):
    """Each section as an article of its own."""
    s = filing_sections(spark, sf_dir)
    ticker = F.concat(F.lit("S"), F.lpad((F.col("page_id") % 100).cast("string"), 4, "0"))
    return s.select(
        F.concat_ws("-", F.col("page_id").cast("string"), "section").alias("article_id"), ticker.alias("ticker"), "section",
        F.concat(F.lit("Filing "), F.col("page_id").cast("string")).alias("title"),
        F.when(F.col("page_id") % 2 == 0, "10-K").otherwise("10-Q").alias("filing_type"),
        F.when(F.col("page_id") % 3 > 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("page_id").cast("int"))).alias("date"),
        F.lit("2024-06-30 12:00:00").cast("timestamp").alias("published_at"), F.lit("2024-07-01").cast("date").alias("fetched_at"), "body", "page_id",
    )


@register(
    "section_silver",
    f"""WITH a AS (SELECT *, page_id || '-' || section AS article_id, 'S' || lpad(CAST(page_id % 100 AS VARCHAR), 4, '0') AS tk FROM {twin("filing_sections")}),
    e AS (SELECT *, section <> 'closing' AS given FROM a)
    SELECT article_id, tk AS ticker, CASE WHEN page_id % 2 = 0 THEN '10-K' ELSE '10-Q' END AS filing_type, section AS section_type,
      CASE WHEN page_id % 3 > 0 THEN DATE '2024-01-01' + CAST(page_id AS INTEGER) ELSE DATE '2024-06-30' END AS filing_date,
      CASE WHEN page_id % 3 > 0 THEN DATE '2024-01-01' + CAST(page_id AS INTEGER) ELSE DATE '2024-06-30' END AS date,
      CASE WHEN given THEN round(length(body) % 201 / 100.0 - 1, 6) ELSE 0 END AS risk_sentiment,
      CASE WHEN given THEN '["' || replace(replace(split_part(body, ' ', 2), '"', '_'), chr(92), '_') || '"]' ELSE '[]' END AS key_risks,
      CASE WHEN given THEN 'raised' ELSE 'none' END AS guidance_direction, '[]' AS forward_statements,
      CASE WHEN given THEN 0.5 ELSE 0.0 END AS management_tone, CASE WHEN given THEN 'new' ELSE 'repeated' END AS new_vs_repeated,
      CASE WHEN given THEN substr(body, 1, 20) ELSE 'Filing ' || page_id END AS summary, DATE '2024-07-01' AS fetched_at FROM e""",
)
def section_silver(spark, sf_dir):
    """Extractions of all sections but the closing ones, fallbacks for these, joined with their articles."""
    a = section_articles(spark, sf_dir)
    none = F.array().cast("array<string>")
    word = F.regexp_replace(F.split_part("body", F.lit(" "), F.lit(2)), '["\\\\]', "_")
    found = a.where("section <> 'closing'").select(
        "article_id", F.lit("").alias("ticker"), F.col("section").alias("section_type"), F.round(F.length("body") % 201 / 100.0 - 1, 6).alias("risk_sentiment"),
        F.array(word).alias("key_risks"), F.lit("raised").alias("guidance_direction"), none.alias("forward_statements"),
        F.lit(0.5).alias("management_tone"), F.lit("new").alias("new_vs_repeated"), F.substring("body", 1, 20).alias("summary"),
    )
    return sections.to_silver(sections.with_fallback(a, found), a)
