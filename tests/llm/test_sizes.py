"""Rule tables and vocabularies beyond the sizes that fit into a plan or into two bytes."""

import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_texts import model_bytes

from barloom.llm import piece_fst, url_alias


def fits(pattern, host, path):
    name, _, rest = pattern.partition("/")
    return (host == name or host.endswith(f".{name}")) and path.startswith(f"/{rest}")


@pytest.mark.parametrize("few", [200, 0])
def test_rules_as_a_table_decide_as_rules_in_the_plan(spark, monkeypatch, few):
    monkeypatch.setattr(url_alias, "FEW_RULES", few)
    rng = random.Random(3)
    names = ["com", "a.com", "b.a.com", "org", "x.org", "", "co.", "é.net"]
    starts = ["", "a", "a/", "a/b", "ab", "/", "%é", "a?"]
    patterns = sorted({f"{rng.choice(names)}/{rng.choice(starts)}" for _ in range(40)} | {"com", "org"})
    rules = [url_alias.UrlRule(p, rng.choice(["allow", "block"])) for p in patterns]
    urls = [f"http://{h}{p}" for h in ["com", "a.com", "z.b.a.com", "acom", "x.org", "co.", "y.é.net", "", "other.io"] for p in ["", "/", "/a", "/a/b", "/abc", "//", "/%é/x", "/a?/b"]]
    pages = spark.createDataFrame([*enumerate(urls), (900, None), (901, "nothing"), (5, urls[5])], "page_id int, url string").withColumn("html", F.lit(None).cast("string"))
    got = url_alias.filter_urls(pages, rules).collect()
    assert len(got) == len(urls) + 3
    for r in got:
        found = sorted((-len(x.pattern), x.pattern, x.verdict) for x in rules if fits(x.pattern, r.host, r.path))
        want = found[0][1:] if found else (None, "allow")
        assert (r.rule, r.verdict) == want, (r.host, r.path)


def test_a_million_rules(spark):
    hosts = F.concat(F.lit("h"), (F.col("id") % 250_000).cast("string"), F.lit(".example.com/p"), F.floor(F.col("id") / 250_000).cast("string"))
    table = spark.range(1_000_000).select(hosts.alias("pattern"), F.when(F.col("id") % 3 == 0, "block").otherwise("allow").alias("verdict"))
    table = table.union(spark.createDataFrame([("com/", "block"), ("com/", "allow"), ("example.com/zz", "block")], table.schema))
    asked = [(i, f"http://www.h{i}.example.com/p{i % 4}/x") for i in range(0, 250_000, 5000)] + [(-1, "http://q.com/"), (-2, "http://www.example.com/zzz"), (-3, "http://h1.example.com/p9")]
    pages = spark.createDataFrame(asked, "page_id int, url string").withColumn("html", F.lit(""))
    got = {r.page_id: (r.rule, r.verdict) for r in url_alias.filter_urls(pages, table).collect()}
    for i in range(0, 250_000, 5000):
        n = i + 250_000 * (i % 4)
        assert got[i] == (f"h{i}.example.com/p{i % 4}", "block" if n % 3 == 0 else "allow")
    assert got[-1] == ("com/", "allow") and got[-2] == ("example.com/zz", "block") and got[-3] == ("com/", "allow")


def test_aliases_follow_a_table_of_rules(spark, monkeypatch):
    monkeypatch.setattr(url_alias, "FEW_RULES", 0)
    pages = spark.createDataFrame([(1, "http://a.io/", '<link rel="canonical" href="http://bad.com/">'), (2, "http://b.io/", ""), (3, "http://bad.com/x", "")], "page_id int, url string, html string")
    got = {r.page_id: r.verdict for r in url_alias.filter_urls(pages, [url_alias.UrlRule("bad.com/", "block")]).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}
    assert url_alias.filter_urls(pages.limit(0), [url_alias.UrlRule("bad.com/", "block")]).collect() == []
    plan = url_alias.filter_urls(pages, [url_alias.UrlRule("bad.com/", "block")])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_more_pieces_than_two_bytes_tell_apart():
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3.0, 1)]
    pieces += [(a + b, -(7 + (i * 300 + k) % 64 / 8), 1) for i, a in enumerate(letters) for k, b in enumerate(letters)][:70_000]
    pieces += [(c, -20.0, 1) for c in letters]
    raw = model_bytes(pieces, 1, b"\x18\x01\x20\x01")
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=raw), piece_fst.Transducer(raw)
    assert machine.dtype.itemsize == 4
    seen = set()
    for _ in range(300):
        text = "".join(rng.choices([*letters[-80:], " ", "q"], k=rng.randrange(1, 30)))
        ids = np.frombuffer(machine.encode(text), machine.dtype)
        assert ids.tolist() == library.encode(text), text
        assert machine.decode(ids) == library.decode(ids.tolist())
        seen.update(ids.tolist())
    assert max(seen) > 1 << 16
