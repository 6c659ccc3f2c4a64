"""Licence statements by a positional rare-token index, all in DataFrame functions.

The index is a table of postings: every content word of each licence template, where it stands and its inverse document
frequency over all files. A file is first looked up by the rarest words of each template, taken so far that no template
can be met without one of them. Of the templates found, all words vote for the place at which the statement would start;
votes within ``SLACK`` words of each other add up, so that words may be put in or left out. Where the votes reach the
threshold, one of the template's mandatory key phrases must stand near them, and its label is added; where a label names a
version, one of its version phrases must, else the template's plain label is added. Base phrases are counted at every place
and always label. The plan of the first pass names the index's words and phrases once; after it, the index is tables.

Null and empty texts have no words; repeated rows are scanned one by one; very long texts are scanned whole, their hits in
many rows; templates that reach the same votes all label; other columns of the input are ignored, whatever their names; an
empty table gives no row.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

WORD_CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The share of a template's weight that must agree.
THRESHOLD = 0.6
#: Words that may be put in or left out between words of a statement, and between it and its key phrase.
SLACK, NEAR = 4, 20
#: Rows of the index that are sent to every task; a larger one is joined by a shuffle.
BROADCAST_POSTINGS = 200_000
_WEIGHT = 1_000_000

BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: one of these must stand in the file
    key_phrases: tuple[str, ...]
    #: one of these too, where the label names a version; else the file gets the plain label
    version_phrases: tuple[str, ...] = ()
    plain: str | None = None


# Statements by which public licences are declared, in their usual words.
TEMPLATES = (
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0",
        ("apache license",),
        tuple(f"apache license {v}" for v in ("version 2 0", "v 2 0", "v2 0", "2 0")),
        "apache",
    ),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files",
        ("permission is hereby granted",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met",
        ("redistribution and use",),
    ),
    Template(
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license",),
        (
            *(f"gnu general public license {v}" for v in ("version 3", "v 3", "v3", "3")),
            "version 3 of the gnu general public license",
        ),
        "gpl",
    ),
    Template(
        "gpl",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
        " free software foundation",
        ("gnu general public license",),
    ),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template(
        "cc-by",
        "licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution",),
    ),
    Template(
        "mpl-2.0",
        "subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
        tuple(f"mozilla public license {v}" for v in ("version 2 0", "v 2 0", "v2 0", "2 0")),
        "mpl",
    ),
    Template("reserved", "copyright all rights reserved", ("all rights reserved",)),
)

# Words too common to point at a licence.
COMMON = {
    "a", "all", "and", "any", "are", "as", "by", "can", "following", "in", "is", "it", "met", "of", "or", "person",
    "that", "the", "this", "to", "under", "use", "with", "without", "work", "you", "0", "2", "3", "4", "v",
}


def index_words(templates: tuple[Template, ...]) -> list[str]:
    """Content words of all templates: the bounded vocabulary of the index."""
    return sorted({w for t in templates for w in t.text.split()} - COMMON)


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase, from 0; the array is walked only where it holds the phrase's longest word."""
    parts = phrase.split()
    starts = F.filter(
        F.sequence(F.lit(0), F.size(words) - len(parts)),
        lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(parts)]),
    )
    there = F.array_contains(words, max(parts, key=len)) & (F.size(words) >= len(parts))
    return F.when(there, starts).otherwise(F.array().cast("array<int>"))


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def find_words(
    files: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``row`` (a number for each file), ``key``, n_words, starts (each base phrase's), hits (w, i of index words) and phrases
    (p, i of key and version phrases)."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = files.select(
        F.col(key).alias("key"), F.filter(F.split(lowered, WORD_CUT), lambda w: w != "").alias("words")
    )
    index = index_words(templates)
    phrases = sorted({p for t in templates for p in t.key_phrases + t.version_phrases})
    firsts, lengths = sorted({p.split()[0] for p in phrases}), sorted({len(p.split()) for p in phrases})
    at = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    marked = words.select(
        "key",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.struct(*[_places(F.col("words"), p).alias(f"p{n}") for n, (p, _) in enumerate(BASE)]).alias("starts"),
        F.arrays_overlap("words", F.array(*map(F.lit, index))).alias("some"),
    )

    def said(x: Column) -> Column:
        runs = [F.struct(F.concat_ws(" ", F.slice("words", x.i + 1, n)).alias("p"), x.i.alias("i")) for n in lengths]
        return F.filter(F.array(*runs), lambda y: y.p.isin(phrases))

    none_hit, none_phrase = (F.array().cast(f"array<struct<{x}:string,i:int>>") for x in "wp")
    starting = F.filter(at, lambda x: x.w.isin(firsts))
    return marked.select(
        F.monotonically_increasing_id().alias("row"),
        "key",
        "n_words",
        "starts",
        F.when(F.col("some"), F.filter(at, lambda x: x.w.isin(index))).otherwise(none_hit).alias("hits"),
        F.when(F.col("some"), F.flatten(F.transform(starting, said))).otherwise(none_phrase).alias("phrases"),
    )


def inverse_frequencies(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """log((1 + files) / (1 + files with the word)) in millionths, at least one, of every index word, over all files."""
    words = found.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").count()
    seen = {r.w: r["count"] for r in words.collect()}  # no more rows than the index has words
    n = found.count()
    return {w: max(1, round(_WEIGHT * math.log((1 + n) / (1 + seen.get(w, 0))))) for w in index_words(templates)}


@dataclass(frozen=True)
class Index:
    """Tables of the templates: where words stand, which are rare, and which phrases each asks for."""

    postings: DataFrame
    anchors: DataFrame
    phrases: DataFrame
    templates: DataFrame
    longest: int


def build_index(spark: SparkSession, templates: tuple[Template, ...], idf: dict[str, int]) -> Index:
    postings, anchors, phrases, rows = [], [], [], []
    for t, template in enumerate(templates):
        places = [(w, p) for p, w in enumerate(template.text.split()) if w not in COMMON]
        total = sum(idf[w] for w, _ in places)
        postings += [(w, t, p, idf[w]) for w, p in places]
        rest = total
        for w in sorted({w for w, _ in places}, key=lambda w: (-idf[w], w)):
            anchors.append((w, t))  # without these words no file reaches the threshold
            rest -= idf[w] * sum(x == w for x, _ in places)
            if rest < THRESHOLD * total:
                break
        phrases += [(p, t, False) for p in template.key_phrases] + [(p, t, True) for p in template.version_phrases]
        rows.append((t, template.label, template.plain or template.label, bool(template.version_phrases), total))
    small = len(postings) <= BROADCAST_POSTINGS
    return Index(
        _table(spark, postings, "w string, t int, p int, v long", small),
        _table(spark, anchors, "w string, t int", small),
        _table(spark, phrases, "p string, t int, version boolean", small),
        _table(spark, rows, "t int, label string, plain string, versioned boolean, total long", small),
        max((len(x.text.split()) for x in templates), default=1),
    )


def _table(spark: SparkSession, rows: list[tuple], schema: str, small: bool) -> DataFrame:
    """A table of a few rows, written out so that plans hold its place and not its rows."""
    names = [x.split()[0] for x in schema.split(", ")]
    said = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    kind = "array<struct<" + ",".join(x.replace(" ", ":") for x in schema.split(", ")) + ">>"
    made = spark.range(1).select(F.inline(F.from_json(F.lit(said), kind)))
    made = store.materialize(made, "licence-index")
    return F.broadcast(made) if small else made


def statements(found: DataFrame, index: Index) -> DataFrame:
    """(row, t, at, first, last, votes): the votes for template ``t`` about each place, and the words that gave them."""
    rare = found.select("row", F.explode(F.array_distinct("hits.w")).alias("w")).join(index.anchors, "w")
    wanted = rare.groupBy("row").agg(F.collect_set("t").alias("wanted"))
    hits = found.select("row", "hits").join(wanted, "row").select("row", "wanted", F.explode("hits").alias("h"))
    votes = hits.select("row", "wanted", F.col("h.w").alias("w"), F.col("h.i").alias("i")).join(index.postings, "w")
    votes = votes.where(F.array_contains("wanted", F.col("t")))
    near = F.floor((F.col("i") - F.col("p")) / SLACK)
    votes = votes.select("row", "t", "p", "i", "v", F.explode(F.array(near - 1, near)).alias("at"))
    each = votes.groupBy("row", "t", "at", "p").agg(F.min("i").alias("i"), F.max("v").alias("v"))
    return each.groupBy("row", "t", "at").agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.sum("v").alias("votes")
    )


def verified(found: DataFrame, met: DataFrame, index: Index) -> DataFrame:
    """(row, label) of the statements in ``met`` that have a key phrase near them; both are dealt by place, so a file of many
    statements never compares each with every phrase."""
    wide = NEAR + index.longest
    low, high = F.col("first") - NEAR, F.col("last") + NEAR
    met = met.withColumn("part", F.explode(F.sequence(F.floor(low / wide), F.floor(high / wide))))
    phrases = found.select("row", F.explode("phrases").alias("x")).select("row", F.col("x.p").alias("p"), F.col("x.i").alias("i"))
    phrases = phrases.join(index.phrases, "p").withColumn("part", F.floor(F.col("i") / wide))
    both = met.join(phrases, ["row", "t", "part"]).where(F.col("i").between(low, high))
    said = both.groupBy("row", "t", "at").agg(
        F.bool_or(~F.col("version")).alias("key"), F.bool_or("version").alias("version")
    )
    named = said.where("key").join(index.templates, "t")
    label = F.when(F.col("versioned") & ~F.col("version"), F.col("plain")).otherwise(F.col("label"))
    return named.select("row", label.alias("label")).distinct()


def scan(
    files: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a template's weight
    that agrees; 1 with a base phrase)."""
    found = store.materialize(find_words(files, templates, key, text), "licence-words")
    index = build_index(files.sparkSession, templates, inverse_frequencies(found, templates))
    some = found.where(F.size("hits") > 0)
    shares = statements(some, index).join(index.templates.select("t", "total"), "t")
    shares = store.materialize(shares.withColumn("share", F.col("votes") / F.col("total")), "licence-votes")
    labels = verified(some, shares.where(F.col("share") >= THRESHOLD), index)
    labels = labels.groupBy("row").agg(F.collect_set("label").alias("more"))
    best = shares.groupBy("row").agg(F.max("share").alias("share"))
    base = F.array_compact(
        F.array(*[F.when(F.size(f"starts.p{n}") > 0, label) for n, (_, label) in enumerate(BASE)])
    )
    places = F.concat(*[F.col(f"starts.p{n}") for n in range(len(BASE))])
    judged = found.select("row", "key", "n_words", places.alias("places"), base.alias("base"))
    judged = judged.join(best, "row", "left").join(labels, "row", "left")
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    share = F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)))
    return judged.select(
        F.col("key").alias(key),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(share).alias("score"),
    )
