"""Text and JSON operators of the silver layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_html(html: str | Column) -> Column:
    """Tags out, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[ \t\r\n]+", " "))


# Named characters of pages; the ampersand comes last, so that nothing is read twice.
ENTITIES: dict[str, str] = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
    "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "para": "¶", "deg": "°", "plusmn": "±", "times": "×", "amp": "&",
}


def _numbered(text: Column) -> Column:
    """Characters given by their decimal or hexadecimal number; numbers that are no character stay as they are."""
    found = F.regexp_extract_all(text, F.lit(r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(1))
    parts = F.split(text, r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", -1)

    def char(ref: Column) -> Column:
        hexed = F.lower(ref).startswith("x")
        code = F.when(hexed, F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(ref).cast("long")
        sound = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.concat(F.lit("&#"), ref, F.lit(";")))

    tail = F.zip_with(F.transform(found, char), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(F.contains(text, F.lit("&#")), F.concat(F.get(parts, 0), F.array_join(tail, ""))).otherwise(text)


def unescape(text: str | Column) -> Column:
    """Named and numbered characters of pages as themselves; unknown names stay."""
    out = _numbered(F.col(text) if isinstance(text, str) else text)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def readable(html: Column) -> Column:
    """Tags out, characters unescaped, white space collapsed."""
    bare = unescape(F.regexp_replace(html, "<[^>]+>", " "))
    return F.trim(F.regexp_replace(bare, "[ \\t\\r\\n\\f\\u00a0]+", " "))


def explode_outer(frame: DataFrame, column: str, name: str) -> DataFrame:
    """A row for each element, one with null where the array is null or empty."""
    return frame.withColumn(name, F.explode_outer(column)).drop(column)


def lexicon_sentiment(frame: DataFrame, lexicon: dict[str, int], text: str = "text") -> DataFrame:
    """positive, negative, compound in -1..1 and label; texts without a lexicon word are neutral."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+")
    of = lambda side: [w for w, s in lexicon.items() if s * side > 0]
    counted = frame.withColumn("_w", words)
    count = lambda side: F.size(F.filter("_w", lambda w: w.isin(of(side)))).cast("long")
    counted = counted.withColumns({"positive": count(1), "negative": count(-1)}).drop("_w")
    p, n = F.col("positive"), F.col("negative")
    out = counted.withColumn("compound", F.coalesce(F.try_divide(p - n, p + n), F.lit(0.0)))
    label = F.when(F.col("compound") >= 0.05, "positive").when(F.col("compound") <= -0.05, "negative").otherwise("neutral")
    return out.withColumn("label", label)


def thread(turns: DataFrame) -> DataFrame:
    """Each conversation's turns in order: how many, the roles, distinct roles and characters. A conversation is bounded."""
    order = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(order, lambda x: x.role), ">").alias("roles"),
        F.countDistinct("role").alias("n_roles"),
        F.sum(F.length("text")).alias("chars"),
    )


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the processed ones."""
    return rows.join(done.select(key), key, "left_anti")


def tolerant_json(text: str, schema: str) -> Column:
    """A struct, null fields where the text is not JSON."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


SECRET = "(?i)(key|token|secret|password)"


def redact(properties: str | Column, pattern: str = SECRET) -> Column:
    """Map values whose key looks like a secret, replaced."""
    return F.transform_values(properties, lambda k, v: F.when(k.rlike(pattern), "***").otherwise(v))


def redact_json(text: str | Column, words: str = "key|token|secret|password") -> Column:
    """JSON text with the values of keys that look like a secret replaced, at any depth: texts, numbers, truth values and nulls; the
    members of a secret's object or list are named by their own keys."""
    text = F.col(text) if isinstance(text, str) else text
    name = f'("(?:[^"\\\\]|\\\\.)*(?i:{words})(?:[^"\\\\]|\\\\.)*"\\s*:\\s*)'
    value = '(?:"(?:[^"\\\\]|\\\\.)*"|-?[0-9][-+.0-9eE]*|true|false|null)'
    return F.regexp_replace(text, name + value, '$1"***"')
