"""Quality rules as a short-circuit cascade, all in DataFrame functions.

Every rule is a column that is true where a document fails. ``order_rules`` counts on a random sample what each rule
rejects and how many bytes it has to pass over, and orders by rejections per byte; ``cascade`` then tests the rules in that
order and stops at the first that rejects. The order never changes a verdict.

``keep_good`` puts the base rules into the cascade too, so that the search for repeated windows, by far the dearest, is made
only for documents that all cheaper rules pass. ``judge`` gives every feature of every document, so it has them all.

Null and empty texts have no words and fail a base rule; repeated rows are judged one by one; very long texts are judged
whole; rules that reject as much per byte keep the order in which they are listed; other columns of the input stay as they
are, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Rows expected in a sample. Each partition keeps its own; only counts leave it.
SAMPLE_ROWS = 400
SEED = 20


@dataclass(frozen=True)
class Rule:
    """``fails`` maps (text, features) to a boolean column; ``passes``: how often it walks over the text's bytes."""

    name: str
    fails: Callable[[Column, Column], Column]
    passes: float = 0


# Passes are those of the functions used: a search or replacement is one, the windows' hashes take one for each of their
# words, and sorting them about as many again.
BASE_RULES = (
    Rule("few_words", lambda text, q: q.n_words < 10),
    Rule("repeated_windows", lambda text, q: 100 * q.n_repeat_words > 20 * q.n_words, 2 * WINDOW),
)

RULES = (
    Rule("symbols", lambda text, q: 100 * q.n_symbols > 10 * q.n_words),
    Rule("duplicate_lines", lambda text, q: 100 * q.n_dup_lines > 40 * q.n_lines),
    Rule("word_length", lambda text, q: (q.word_chars < 3 * q.n_words) | (q.word_chars > 12 * q.n_words)),
    Rule("capitals", lambda text, q: 100 * F.regexp_count(text, F.lit(r"\p{Lu}")) > 50 * q.word_chars, 1),
    Rule("letters", lambda text, q: 100 * F.length(F.regexp_replace(text, r"\P{L}+", "")) < 50 * q.word_chars, 2),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeat_words(words: Column, hashes: Column, n: Column) -> Column:
    """Words that lie in a window of five words found twice or more. Hashes tell whether a text has such a window at
    all; where one may have, sorted windows themselves decide."""
    starts = F.sequence(F.lit(0), n - WINDOW)
    keys = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    exact = F.sort_array(
        F.transform(
            starts,
            lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]).alias("w"), i.alias("i")),
        )
    )

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k).w == x.w, F.lit(False))
        at = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x.i))
        return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    some = _let(keys, lambda g: F.size(F.array_distinct(g)) < F.size(g))
    return F.when((n >= WINDOW) & some, _let(_let(exact, twice), covered)).otherwise(0).cast("long")


class _Lazy:
    """Features of which the repeated windows are a column of their own, evaluated where a rule asks for it."""

    def __init__(self, q: Column, repeats: Column):
        self._q, self.n_repeat_words = q, repeats

    def __getattr__(self, name: str) -> Column:
        return self._q[name]


def with_features(docs: DataFrame, windows: bool = True) -> DataFrame:
    """``row`` (the input's columns), ``text`` (null as empty), ``q``, the features, and ``part``; without ``windows`` their
    words and hashes in place of the feature.

    ``part`` is not deterministic: a filter that uses it stays above the features, where the optimizer would else copy
    them into the filter, and whole arrays into functions of each element.
    """
    texts = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    words = texts.select("row", "text", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"))
    counted = words.select(
        "row",
        "text",
        "words",
        F.size("words").alias("n"),
        *([F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")] if windows else []),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    features = [
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ]
    if windows:
        features.append(_repeat_words(F.col("words"), F.col("hashes"), F.col("n")).alias("n_repeat_words"))
    more = [] if windows else ["words"]
    return counted.select("row", "text", *more, F.struct(*features).alias("q"), F.spark_partition_id().alias("part"))


def _features_of(featured: DataFrame) -> Column | _Lazy:
    if "words" not in featured.columns:
        return F.col("q")
    words = F.col("words")
    repeats = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _repeat_words(words, h, F.size(words)))
    return _Lazy(F.col("q"), repeats)


def base_failed(q: Column) -> Column:
    out = F.lit(False)
    for rule in BASE_RULES:
        out = out | rule.fails(F.col("text"), q)
    return out


def order_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, sample_rows: int = SAMPLE_ROWS
) -> list[tuple[Rule, float, float]]:
    """(rule, bytes a document, share rejected), best rejection per byte first, from about ``sample_rows`` random
    documents, counted where they lie."""
    n = docs.count()
    share = min(1.0, sample_rows / max(1, n))
    sample = with_features(docs.select("text").sample(fraction=share, seed=SEED) if share < 1 else docs.select("text"))
    bad = [F.count_if(F.coalesce(r.fails(F.col("text"), F.col("q")), F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)]
    seen = sample.agg(F.count("*").alias("n"), F.avg(F.octet_length("text")).alias("size"), *bad).first()
    found = [(r, 8.0 + r.passes * (seen["size"] or 0.0), seen[f"r{i}"] / max(1, seen["n"])) for i, r in enumerate(rules)]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def cascade(featured: DataFrame, rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null for documents that pass all."""
    first, q = None, _features_of(featured)
    for rule in rules:
        fails = rule.fails(F.col("text"), q)
        first = F.when(fails, rule.name) if first is None else first.when(fails, rule.name)
    return first if first is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``row``, ``q``, ``base_failed``, ``rejected_by`` and ``kept``; the cascade runs on what passes the base rules."""
    ordered = [rule for rule, _, _ in order_rules(docs, rules, sample_rows=sample_rows)]
    featured = with_features(docs)
    failed = base_failed(F.col("q"))
    rejected = F.when(failed, "base").otherwise(cascade(featured, ordered))
    kept = rejected.isNull() & (F.col("part") >= 0)
    return featured.select(
        "row", "q", failed.alias("base_failed"), rejected.alias("rejected_by"), kept.alias("kept")
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their own columns; base rules are ordered with the others."""
    ordered = [rule for rule, _, _ in order_rules(docs, BASE_RULES + rules, sample_rows=sample_rows)]
    featured = with_features(docs, windows=False)
    kept = cascade(featured, ordered).isNull() & (F.col("part") >= 0)
    return featured.select("row", kept.alias("kept")).where("kept").select("row.*")
