"""Column work of the sources: consensus, ratios, zipped arrays, dates, symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rating buckets in their order, and what each counts.
RATINGS = {"strong_buy": 2, "buy": 1, "hold": 0, "sell": -1, "strong_sell": -2}


def consensus(counts: DataFrame) -> DataFrame:
    """Adds consensus_score, the mean weight, and consensus_label, the first of the largest buckets; 0 and hold without
    ratings."""
    total = reduce(lambda a, b: a + b, [F.col(n) for n in RATINGS])
    weighted = reduce(lambda a, b: a + b, [F.col(n) * w for n, w in RATINGS.items()])
    largest = F.greatest(*RATINGS)
    label = F.coalesce(*[F.when(F.col(n) == largest, n) for n in RATINGS])
    return counts.withColumns(
        {
            "consensus_score": F.when(total == 0, 0.0).otherwise(weighted / total),
            "consensus_label": F.when(total == 0, "hold").otherwise(label),
        }
    )


def zipped_rows(frame: DataFrame, arrays: list[str], *keep: str) -> DataFrame:
    """One row for each place of arrays that run side by side."""
    return frame.select(*keep, F.explode(F.arrays_zip(*arrays)).alias("_z")).select(*keep, *[F.col(f"_z.{a}").alias(a) for a in arrays])


def ratio(a: Column | str, b: Column | str) -> Column:
    """Null where either side is missing or the divisor is 0."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


# What each ratio of a company's statement divides.
STATEMENT_RATIOS = {
    "eps": ("net_income", "shares"), "roe": ("net_income", "stockholders_equity"), "roa": ("net_income", "total_assets"),
    "debt_to_equity": ("total_debt", "stockholders_equity"), "net_margin": ("net_income", "revenue"), "operating_margin": ("operating_income", "revenue"),
}


def with_ratios(statements: DataFrame) -> DataFrame:
    """All ratios of statements; null where a side is missing, or not in the frame at all, or the divisor is 0."""
    of = lambda c: F.col(c) if c in statements.columns else F.lit(None).cast("double")
    return statements.withColumns({n: ratio(of(a), of(b)) for n, (a, b) in STATEMENT_RATIOS.items()})


def average_rank(x: Column | str, *by: str, descending: bool = True) -> Column:
    """The rank of ``x`` within ``by``; equal values share the mean of their places, nulls have none."""
    x = F.col(x) if isinstance(x, str) else x
    w = Window.partitionBy(*by)
    place = F.rank().over(w.orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last()))
    alike = F.count("*").over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), place + (alike - 1) / 2)


def balance(positive: Column | str, negative: Column | str) -> Column:
    """(positive - negative) / (positive + negative), 0 where both are; a missing side counts as 0."""
    p, n = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0)) for x in (positive, negative))
    return F.when(p + n == 0, 0.0).otherwise((p - n) / (p + n))


def item_text(title: Column, summary: Column, content: Column) -> Column:
    """The fullest text of a feed's item: its content, else its summary, else its title; blank ones do not count."""
    there = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(there(content), there(summary), there(title), F.lit(""))


#: Formats of feeds: ISO with and without time, RFC 822, US dates.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd MMM yyyy HH:mm:ss", "MM/dd/yyyy", "yyyyMMdd")


def any_timestamp(text: Column) -> Column:
    """The first format that fits; a weekday before and a zone or fraction after are left out; null where none does."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*|(?<=:\d\d)(\.\d+)?\s*(Z|GMT|UTC|[+-]\d\d:?\d\d)?$", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in DATE_FORMATS])


def yahoo_symbol(code: Column) -> Column:
    """A mainland code with its exchange's suffix; codes that have one stay."""
    return (
        F.when(code.rlike(r"\.(SS|SZ|BJ)$"), code)
        .when(code.rlike("^[023]"), F.concat(code, F.lit(".SZ")))
        .when(code.rlike("^[48]"), F.concat(code, F.lit(".BJ")))
        .otherwise(F.concat(code, F.lit(".SS")))
    )


def one_line(text: Column) -> Column:
    """Runs of line breaks and blanks as one blank."""
    return F.trim(F.regexp_replace(text, r"[\r\n\t ]+", " "))


#: Fixed value: the name space of addresses.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name: Column, space: str = URL_SPACE) -> Column:
    """The version 5 identifier of a name: SHA-1 of name space and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def transcripts(sections: DataFrame, key: str, order: str, speaker: str, text: str) -> DataFrame:
    """One row a transcript: its sections' texts in order with a blank line between, speakers in order of first words, and an
    identifier. Sections without a text add none; transcripts without any are left out."""
    parts = F.sort_array(F.collect_list(F.struct(order, speaker, text)))
    rows = sections.where(F.col(key).isNotNull()).groupBy(key).agg(parts.alias("_s"))
    rows = rows.withColumn("body", F.concat_ws("\n\n", F.col(f"_s.{text}"))).where(F.trim("body") != "")
    named = F.filter(F.array_distinct(F.col(f"_s.{speaker}")), lambda x: x.isNotNull() & (x != ""))
    identifier = name_uuid(F.concat(F.lit("transcript_"), F.col(key).cast("string")))
    return rows.select(key, identifier.alias("article_id"), "body", named.alias("participants"))


def frame_hash(frame: DataFrame, digits: int = 12) -> DataFrame:
    """One row, ``hash``: the rows' digests added up and hashed, the same in any order of rows; repeated rows count."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(frame.columns)])
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).cast("string")
    return frame.agg(F.substring(F.sha2(total, 256), 1, digits).alias("hash"))
