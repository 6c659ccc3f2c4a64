"""Merkle manifests against a tree built in plain Python."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import merkle
from barloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, part int, idx long, size long, `key` long, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    texts = [None if v is None else str(v) for v in row]
    return h(*("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def climb(nodes, fan):
    """The root of ``nodes``, and for each the levels of (left, right) siblings."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        for k, i in enumerate(at):
            run, p = runs[i // fan], i % fan
            paths[k].append(("".join(run[:p]), "".join(run[p + 1 :])))
            at[k] = i // fan
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def brute(rows, fan=3):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    group = lambda s: (s is not None, (s or "").encode())
    leaves = sorted(((group(r[1]), r[0] is not None, r[0] or 0, leaf_of(r), r[0]) for r in rows))
    groups = sorted({x[0] for x in leaves})
    trees = {g: climb([x[3] for x in leaves if x[0] == g], fan) for g in groups}
    root, above = climb([trees[g][0] for g in groups], fan)
    out, seen = [], dict.fromkeys(groups, 0)
    for g, _, _, leaf, doc_id in leaves:
        out.append((doc_id, leaf, trees[g][0], root, trees[g][1][seen[g]] + above[groups.index(g)]))
        seen[g] += 1
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.key, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in frame.collect()), key=str)


def odd_rows():
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", rng.choice(["en", None]), i, f"text {i}\n") for i in range(400)]
    rows += [(9, None, None, None, None), (9, None, None, None, ""), (None, "hot", "", 0, "x"), (None, None, "en", -1, "ü\n€")]
    rows += [(3, "Ä", "en", 1, "long " * 50_000), (3, "a", "en", 1, "-"), (3, "z\U0001f600", "en", 1, "one"), (3, "z￿", "en", 1, "two")]
    return rows + [(77, "s1", "en", 1, "repeated")] * 3


@pytest.mark.parametrize("fan,levels", [(3, 6), (3, 1), (2, 2)])
def test_blocks_of_any_height_give_one_tree(spark, fan, levels):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, "p") for r in rows], DOCS).repartition(4)
    got = merkle.proofs(*merkle.build(docs, fan=fan, block_levels=levels), fan=fan, block_levels=levels)
    assert found(got) == brute(rows, fan)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_one_group_of_any_size(spark, n):
    rows = [(i, "s", "en", 1, str(i)) for i in range(n)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, "p") for r in rows], DOCS)
    got = merkle.proofs(*merkle.build(docs, block_levels=2), block_levels=2)
    assert found(got) == brute(rows)


def test_no_rows(spark):
    assert merkle.proofs(*merkle.build(spark.createDataFrame([], DOCS))).collect() == []


def test_changed_rows_do_not_verify(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, "p") for r in rows], DOCS)
    got = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    made = merkle.proofs(*merkle.build(docs, received={"text": got}, block_levels=2), block_levels=2)
    made = made.select("key", "root", "leaf", "received", merkle.fold(F.col("received"), F.col("path")).alias("folded"))
    for r in made.collect():
        changed = r.key is not None and r.key % 2 == 0
        assert (r.folded != r.root) == (r.leaf != r.received) == changed, r.key


def test_query(spark):
    docs = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {}
    for doc_id, leaf, subroot, root, path in brute(docs):
        want[doc_id] = leaf, subroot, root, h(*(x for p in path for x in p)), path
    got = QUERIES["op12_merkle_manifest"](spark, SF).collect()
    texts = {r[0]: r for r in docs}
    import zlib

    for r in got:
        leaf, subroot, root, proof, path = want[r.doc_id]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, subroot, root, proof)
        row = list(texts[r.doc_id])
        if zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            row[4] = row[4].replace("\n", "")
        folded = leaf_of(row)
        for left, right in path:
            folded = h(left, folded, right)
        assert r.folded_root == folded and r.verified == (folded == root)
    assert len(got) == len(docs) and {r.verified for r in got} == {True, False}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    columns = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert sorted(con.sql(f"select {columns} from ({ORACLE_SQL['op12_merkle_manifest']})").fetchall()) == sorted(map(tuple, got))
