"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from barloom.llm import resample
from barloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, part int, pos long, score long, start long, eligible boolean"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets_of(text, longest, n):
    words = words_of(text)
    runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return [zlib.crc32(r.encode()) % n for r in runs]


def brute(docs, target, longest=1, n=10_000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) in order of rank."""
    rows = [(d, buckets_of(t, longest, n), len(words_of(t))) for d, t in docs]
    s, t = Counter(b for _, bs, _ in rows for b in bs), Counter(b for x in target for b in buckets_of(x, longest, n))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + n) / ((s[b] + 1) * (big_t + n))))
    out = []
    for d, bs, size in rows:
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, bs))
        out.append([d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, size])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


ODD = [
    None, "", " .-\n", "one", "Ünï ÀÉ z", "A B a b", "a b c　d \x85e", "İ ı ſ K", "x1y2 3-4_5", "long words " * 30_000,
    *(f"the common word and number {i} " * 5 for i in range(40)),
]


@pytest.mark.parametrize("longest,n", [(1, 10_000), (2, 97)])
def test_odd_documents(spark, longest, n):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "nobody's words " * 20), (7, "again " * 30), (7, "again " * 30)]
    target = ["the number", None, "Common 7 words", ""]
    rows = spark.createDataFrame([(*d, 1, 2, 3, 4, True) for d in docs], DOCS).repartition(3)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(rows, goal, longest=longest, buckets=n, percent=50)
    assert found(got) == brute(docs, target, longest, n, percent=50)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i % 30, "same words all over " * 6) for i in range(60)]  # each id twice: equal scores side by side
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = resample.resample(rows, rows.selectExpr("doc_id item_id", "text"), percent=50).collect()
    drawn = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank)
    assert [r[0] for r in drawn] == list(range(1, 31))
    assert [r[2] for r in drawn] == sorted((r.score for r in got), reverse=True)[:30]
    assert Counter(r[1] for r in drawn).most_common()[-1][1] == 2


def test_no_documents_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    goal = none.selectExpr("doc_id item_id", "text")
    assert resample.resample(none, goal).collect() == []
    docs = spark.createDataFrame([(1, "a b c " * 9), (2, "d " * 40)], "doc_id long, text string")
    assert found(resample.resample(docs, goal, percent=50)) == brute([(1, "a b c " * 9), (2, "d " * 40)], [], percent=50)


def test_blocks_hold_the_counts(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_WORDS", 50)
    docs = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i))) for i in range(60)]
    matrix = resample.count_matrix(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), buckets=31).collect()
    assert sum(len(b.doc_ids) for b in matrix) == 60
    cells = Counter()
    for b in matrix:
        ends, at, n = np.frombuffer(b.indptr, "<i8"), np.frombuffer(b.indices, "<u4"), np.frombuffer(b.counts, "<u4")
        assert ends[0] == 0 and ends[-1] == len(at) == len(n) and len(ends) == len(b.doc_ids) + 1
        for k, d in enumerate(b.doc_ids):
            assert (np.diff(at[ends[k] : ends[k + 1]].astype(int)) > 0).all()
            cells.update({(d, int(c)): int(x) for c, x in zip(at[ends[k] : ends[k + 1]], n[ends[k] : ends[k + 1]], strict=True)})
    assert cells == Counter((d, b) for d, t in docs for b in buckets_of(t, 1, 31))


def test_drawn_documents_look_like_the_target(spark):
    docs = [(i, ("red green blue " if i % 3 else "one two three ") * 10) for i in range(300)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    goal = spark.createDataFrame([(1, "one two three " * 50)], "item_id long, text string")
    drawn = [r.doc_id for r in resample.resample(rows, goal).collect() if r.rank]
    assert len(drawn) == 30 and all(d % 3 == 0 for d in drawn)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = found(QUERIES["op11_importance_resample"](spark, SF))
    assert got == brute(docs, target)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert sorted(con.sql(ORACLE_SQL["op11_importance_resample"]).fetchall(), key=str) == got
