"""Filings cut into sections by their headings, and extracted sections joined with the articles that they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import texts

#: Headings of annual and quarterly reports.
HEADINGS: dict[str, str] = {
    "risk_factors": r"(?i)\bitem\s*1a\.?\s*risk\s*factors\b",
    "mda": r"(?i)\bitem\s*7\.?\s*management[']?s?\s*discussion\s*and\s*analysis\b",
}
LEAST_CHARS = 50


def last_match(text: Column, pattern: str) -> Column:
    """Where the last match starts, in characters from 0; null without any. Text after the last match is what splitting
    leaves last, so the place follows from lengths and no match is searched for twice in a row's code."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = F.element_at(F.split(text, pattern, -1), -1)
    return F.when(F.size(found) > 0, F.length(text) - F.length(rest) - F.length(F.element_at(found, -1)))


def sections(frame: DataFrame, key: str, text: str, headings: dict[str, str] = HEADINGS, least: int = LEAST_CHARS) -> DataFrame:
    """(``key``, place, section, start, body): from each heading's last match to the next such match or the end, in order of the
    text; equal starts in order of ``headings``. The earlier matches of a heading, as in a table of contents, start nothing;
    headings that do not occur give no section, a text without any gives no row. Bodies of ``least`` characters or fewer are left
    out and still end the section before them; ``place`` counts from 0 over those that stay."""
    starts = F.array(*[F.when(F.col(f"_at{n}").isNotNull(), F.struct(F.col(f"_at{n}").alias("at"), F.lit(n).alias("n"), F.lit(name).alias("name"))) for n, name in enumerate(headings)])
    rows = frame.select(key, F.col(text).alias("_t"))
    rows = rows.withColumns({f"_at{n}": last_match(F.col("_t"), p) for n, p in enumerate(headings.values())})
    rows = rows.withColumn("_starts", F.array_sort(F.array_compact(starts)))

    def cut(b: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_starts", i + 1)["at"], F.length("_t"))
        body = F.trim(F.substring(F.col("_t"), b["at"] + 1, end - b["at"]))
        return F.struct(b["name"].alias("section"), b["at"].alias("start"), body.alias("body"))

    kept = F.filter(F.transform("_starts", cut), lambda s: F.length(s.body) > least)
    return rows.select(key, F.posexplode(kept).alias("place", "_s")).select(key, "place", "_s.section", "_s.start", "_s.body")


def filing_sections(pages: DataFrame, key: str, html: str, headings: dict[str, str] = HEADINGS, least: int = LEAST_CHARS) -> DataFrame:
    """``sections`` of the readable text of pages."""
    return sections(pages.select(key, texts.readable(F.col(html)).alias("_html")), key, "_html", headings, least)


# Extractions ------------------------------------------------------------------------------------------------------

SECTION_EXTRACTION = """article_id string, ticker string, section_type string, risk_sentiment double, key_risks array<string>,
guidance_direction string, forward_statements array<string>, management_tone double, new_vs_repeated string, summary string"""


def with_fallback(articles: DataFrame, extractions: DataFrame) -> DataFrame:
    """An extraction for every section (article_id, ticker, section, title, ...): the given one, or, where there is none, one that
    says nothing: no risk, no guidance, repeated, the title's first 200 characters as summary."""
    names = [f.name for f in articles.sparkSession.createDataFrame([], SECTION_EXTRACTION).schema.fields]
    none = F.array().cast("array<string>")
    defaults = {
        "ticker": F.coalesce("_ticker", F.lit("")), "section_type": F.coalesce("_section", F.lit("unknown")), "risk_sentiment": F.lit(0.0),
        "key_risks": none, "guidance_direction": F.lit("none"), "forward_statements": none, "management_tone": F.lit(0.0),
        "new_vs_repeated": F.lit("repeated"), "summary": F.substring(F.coalesce("_title", F.lit("")), 1, 200),
    }
    asked = articles.select("article_id", F.col("ticker").alias("_ticker"), F.col("section").alias("_section"), F.col("title").alias("_title"))
    given = extractions.select(*names).withColumn("_given", F.lit(True))
    joined = asked.join(given, "article_id", "left")
    return joined.select("article_id", *[F.when(F.col("_given"), F.col(n)).otherwise(d).alias(n) for n, d in defaults.items()])


def to_silver(extractions: DataFrame, articles: DataFrame) -> DataFrame:
    """Extractions with what their article (article_id, ticker, filing_type, date, published_at, fetched_at) knows: its ticker where
    none was extracted, its date or day of publication, lists as JSON. Extractions of unknown articles stay."""
    day = F.coalesce(F.to_date("_a.date"), F.to_date("_a.published_at"))
    known = articles.select("article_id", F.struct(*[c for c in articles.columns if c != "article_id"]).alias("_a"))
    joined = extractions.join(known, "article_id", "left")
    own = F.when(F.col("ticker") != "", F.col("ticker"))
    return joined.select(
        "article_id", F.coalesce(own, "_a.ticker", F.lit("")).alias("ticker"), F.coalesce("_a.filing_type", F.lit("")).alias("filing_type"),
        "section_type", day.alias("filing_date"), day.alias("date"), F.col("risk_sentiment").cast("double").alias("risk_sentiment"),
        F.to_json("key_risks").alias("key_risks"), "guidance_direction", F.to_json("forward_statements").alias("forward_statements"),
        F.col("management_tone").cast("double").alias("management_tone"), "new_vs_repeated", "summary", F.col("_a.fetched_at").alias("fetched_at"),
    )
