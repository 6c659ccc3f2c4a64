"""Listings of semi-structured posts, read as variants, and what is kept of them as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.columns import name_uuid

# Where a listing has its posts, and what a post's metadata are.
CHILDREN = "$.data.children"
METADATA = {"score": "long", "upvote_ratio": "double", "num_comments": "long", "permalink": "string", "flair": "string"}
PLACES = {"flair": "link_flair_text"}


def field(post: Column, name: str, kind: str) -> Column:
    """A field of a post as ``kind``; null where it is absent or no such value."""
    return F.try_variant_get(post, f"$.data.{name}", kind)


def posts(listings: DataFrame, json: str, *keep: str) -> DataFrame:
    """(``keep``, place, post): a row for each post of each listing, in the listing's order from 0. Texts that are no JSON, listings without
    posts and posts that are not in a list give no row."""
    listing = F.try_parse_json(F.col(json))
    children = F.try_variant_get(listing, CHILDREN, "array<variant>")
    return listings.select(*keep, F.posexplode(children).alias("place", "post"))


def articles(found: DataFrame, source: Column, base: str, since: Column, *keep: str) -> DataFrame:
    """Posts since a day as articles: identifier by address or else by time, title and body without the blanks around them, the body only where
    there is one, counts 0 where absent, what else is known as JSON. A post without a time counts as of now."""
    post = F.col("post")
    text = lambda n: F.trim(F.coalesce(field(post, n, "string"), F.lit("")))
    seconds = field(post, "created_utc", "double")
    link = text("permalink")
    url = F.when(link != "", F.concat(F.lit(base), link)).otherwise("")
    published = F.when(seconds > 0, F.timestamp_seconds(F.floor(seconds))).otherwise(F.current_timestamp())
    rows = found.select(
        *keep, "place", text("title").alias("title"), text("selftext").alias("_self"), text("author").alias("author"), url.alias("source_url"),
        published.alias("published_at"), F.coalesce(F.floor(seconds), F.lit(0)).cast("string").alias("_at"), source.alias("source_name"),
        *[F.coalesce(field(post, PLACES.get(n, n), k), F.lit(0).cast(k) if k != "string" else F.lit(None).cast(k)).alias(f"_m_{n}") for n, k in METADATA.items()],
    ).where(F.to_date("published_at") >= since)
    metadata = F.to_json(F.struct(*[F.col(f"_m_{n}").alias(n) for n in METADATA], F.col("source_name").alias("source")), {"ignoreNullFields": "true"})
    named = F.when(F.col("source_url") != "", F.col("source_url")).otherwise(F.col("_at"))
    body = F.when(F.col("_self") != "", F.concat("title", F.lit("\n\n"), "_self")).otherwise(F.col("title"))
    return rows.select(
        *keep, "place", name_uuid(named).alias("article_id"), F.lit("reddit").alias("source_type"), "source_name", "source_url", "title", body.alias("body"),
        "author", "published_at", metadata.alias("source_metadata"),
    )
