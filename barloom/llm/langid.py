"""Language by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams (one to three letters, words padded with a space) in rank order. A
document goes to the language whose profile its own most frequent n-grams disagree with least: the out-of-place distance
sums the differences of ranks, and the profile size where an n-gram is missing. Counts cover whole texts of all training
documents. Equal counts rank by n-gram, equal distances by language.

Texts that are null, empty or without a letter, and all texts where nothing could be learned, are ``und`` with score 0. A
null ``doc_id`` is held out. Rows that repeat count each time. Very long texts are counted whole. ``keep_known`` gives the
input's other columns back, whatever their names. An empty table gives no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROFILE = 300
SLICE = 200
UNKNOWN = "und"
#: A document's score under this is no language that was learned.
LEAST_SCORE = 0.25

_SPACE = 32
_letters: np.ndarray | None = None

Profiles = dict[str, tuple[np.ndarray, np.ndarray]]


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None) -> np.ndarray:
    """Every n-gram of a text as one number: 21 bits a character. Empty without a letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4")
    letter = _letter_table()[code]
    if not letter.any():
        return np.empty(0, np.int64)
    code = np.concatenate(([_SPACE], np.where(letter, code, _SPACE), [_SPACE])).astype(np.int64)
    code = code[np.concatenate(([True], (code[1:] != _SPACE) | (code[:-1] != _SPACE)))]
    two = code[:-1] << 21 | code[1:]
    three = two[:-1] << 21 | code[2:]
    return np.concatenate((code[code != _SPACE], two, three[code[1:-1] != _SPACE]))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, best first; ``codes`` ascend, so equal counts stay in code order."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def distance(top: np.ndarray, profile: tuple[np.ndarray, np.ndarray], size: int = PROFILE) -> int:
    """Out-of-place distance of ranked codes to a profile of sorted codes and their ranks."""
    codes, ranks = profile
    at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
    off = np.abs(ranks[at] - np.arange(len(top)))
    return int(np.where(codes[at] == top, off, size).sum())


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by checksum of the id as text; never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of all languages in ``lang``. The driver sees ``size`` rows a language, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = defaultdict(list)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found[lang].append(grams(text))
                for lang, arrays in found.items():
                    codes, counts = np.unique(np.concatenate(arrays), return_counts=True)
                    if lang in totals:
                        old, n = totals[lang]
                        merged, where = np.unique(np.concatenate((old, codes)), return_inverse=True)
                        counts = np.bincount(where, np.concatenate((n, counts)), len(merged)).astype(np.int64)
                        codes = merged
                    totals[lang] = codes, counts
        for lang, (codes, counts) in totals.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(codes), pa.string()), "gram": codes, "n": counts.astype(np.int64)}
            )

    known = docs.where(F.col("lang").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    counts = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(64)))
    some = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    some = some.where(F.col("r") <= size).select("lang", "gram", "n")
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    found = defaultdict(list)
    for row in best.where(F.col("r") <= size).select("lang", "gram", "r").collect():
        found[row.lang].append((row.gram, row.r - 1))
    profiles = {}
    for lang, rows in sorted(found.items()):
        table = np.array(sorted(rows), np.int64)
        profiles[lang] = table[:, 0].copy(), table[:, 1].copy()
    return profiles


def guess(text: str | None, profiles: Profiles, size: int = PROFILE) -> tuple[str, float]:
    """Language, and one less the distance's share of the largest possible."""
    codes = grams(text)
    if not len(codes) or not profiles:
        return UNKNOWN, 0.0
    top = ranked(*np.unique(codes, return_counts=True), size)
    best, lang = min((distance(top, p, size), lang) for lang, p in profiles.items())
    return lang, 1 - best / (size * len(top))


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` as a struct ``row``, with ``lang_pred`` and ``score`` of the column ``text``."""
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    kind = packed.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [guess(t, profiles) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                    ["row", "lang_pred", "score"],
                )

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), profiles)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score"
    )


def keep_known(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents in a language that was learned from the others, with their own columns."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs, profiles).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return found.select("row.*")
