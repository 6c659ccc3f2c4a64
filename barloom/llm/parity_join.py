"""Exact Jaccard links on word n-grams by a parity-sketch join.

Every n-gram toggles one bit of a document's sketch, so two sketches differ in no more bits than the n-gram sets differ
in members. Documents of one size band that may reach the similarity differ in at most ``d`` n-grams; their sketches are
cut into ``d + 1 + spare`` blocks, so at least ``spare + 1`` blocks are equal. Documents that share a block are candidates
and are verified on their whole texts.

Copies never become all pairs. Equal texts are one class. Classes that share a block are first compared with one of them
only, the one that shares most blocks with others, which is nearest to the text that near copies come from; connected
components of the links found join most, and then only pairs across components remain. Links are counted over all pairs:
documents that link stand with one hub, and what each differs in from it tells what they differ in from each other.

Whole texts are dealt by ``doc_id`` once; every later join on an id moves ids to the texts, not texts to the ids.

Texts without words are empty and linked with nothing; so are rows with a null ``doc_id``, whose component is null. Rows
that share a ``doc_id`` are one document. Very long texts are compared whole. Of hubs that share as many blocks the
smallest id is taken; ties change no result. Other columns of the input are ignored, whatever their names (``keep_one``
gives them back). An empty table gives no row.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .components import components

BAND_RATIO = 1.35
#: Bits of a sketch block; few would let unlike blocks of one or two n-grams be equal.
BITS_PER_BLOCK = 1 << 30
#: Blocks beyond those that empty ones may take, and the documents from which a shared block is hot.
SPARE = 2
HOT = 12
#: Documents of one hub that are compared with as many others at once, and with the hub in one run of rows.
TILE = 128
RUN = 512
MEMO_WORDS = 300_000

_U = np.uint64
_BAND = 1 << 24
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


_memo: dict[bytes, int] = {}


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct n-grams of lower-cased words as sorted 64-bit hashes; all words as one n-gram where they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, _U)
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    for w in set(words).difference(_memo):
        _memo[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.fromiter(map(_memo.__getitem__, words), _U, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, _U)
    for k in range(width):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(out)


@dataclass(frozen=True)
class Space:
    """One size band: sets of ``low`` to ``high`` members, and those up to ``reach`` that may link with them."""

    number: int
    low: int
    high: int
    reach: int
    blocks: int
    spare: int


class Bands:
    """Size bands for links of at least ``percent``; made as far as sizes ask for."""

    def __init__(self, percent: int, ratio: float = BAND_RATIO):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.percent, self.ratio, self.made = percent, ratio, []

    def _make(self) -> None:
        low = self.made[-1].high + 1 if self.made else 1
        high = max(low, int(low * self.ratio) - 1)
        differ = high * (100 - self.percent) // self.percent
        empty = (differ + 1) * math.exp(-low / (differ + 1))
        spare = math.ceil(empty + 3 * math.sqrt(empty)) + SPARE + differ // 20 if differ else 0
        reach = high * 100 // self.percent
        self.made.append(Space(len(self.made), low, high, reach, differ + 1 + spare, spare))

    def of(self, size: int) -> list[Space]:
        """The bands in which a set of ``size`` members is sought."""
        while not self.made or self.made[-1].high < size:
            self._make()
        found = []
        for space in reversed(self.made):
            if space.low <= size <= space.reach:
                found.append(space)
            elif space.reach < size:
                break
        return found


def block_keys(members: np.ndarray, space: Space) -> tuple[np.ndarray, int]:
    """A key for every block of the parity sketch, and how many of them the set can do without.

    Linked sets share more blocks than the band has to spare. Blocks without a member are left out, unless there are more
    than that: two sets of which one has no more share another block.
    """
    k = _U(space.blocks)
    block = ((members >> _U(32)) * k) >> _U(32)
    bit = _mix((block * _U(BITS_PER_BLOCK) + (members & _U(BITS_PER_BLOCK - 1))) ^ _mix(np.array([space.number + 1], _U)))
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    words = np.zeros(space.blocks, _U)
    words[block[starts].astype(np.int64)] = np.bitwise_xor.reduceat(bit, starts)
    place = np.arange(space.blocks, dtype=_U) + _U((space.number << 32) + 1)
    keys = _mix(words ^ _mix(place))
    filled = np.zeros(space.blocks, bool)
    filled[block[starts].astype(np.int64)] = True
    slack = space.spare - (space.blocks - len(starts))
    return (keys[filled], slack) if slack >= 0 else (keys, -1)


def _rows(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, rep, n): a row for each block of each text, and one with ``n``, the size of its set, whose key is the text's
    ``number``. For blocks ``n`` is negative and holds the band and the blocks that the set can do without."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keys, reps, marks, counts = [], [], [], []
                for rep, text, number in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    members = shingles(text, width)
                    if not len(members):
                        continue
                    keys.append(np.array([number], _U))
                    marks.append(np.array([len(members)]))
                    for space in bands.of(len(members)):
                        found, slack = block_keys(members, space)
                        keys.append(found)
                        marks.append(np.full(len(found), -(space.number * _BAND + slack + 2)))
                    reps.append(rep)
                    counts.append(sum(map(len, keys)) - sum(counts))
                if not reps:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.repeat(np.array(reps, np.int64), counts)),
                        pa.array(np.concatenate(marks).astype(np.int64)),
                    ],
                    ["key", "rep", "n"],
                )

    return texts.select("rep", "text", "number").mapInArrow(emit, "key long, rep long, n long")


def _shared(rows: DataFrame) -> DataFrame:
    """Of ``rows``: those with ``n``, and those whose key another document has.

    Rows are dealt and sorted by key and stream through; no key's documents are ever held together.
    """

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more = None, False  # the last row, and whether its key has others
        for batch in batches:
            sized = batch.filter(pa.compute.greater(batch.column(2), 0))
            if sized.num_rows:
                yield sized
            plain = batch.filter(pa.compute.less(batch.column(2), 0))
            if not plain.num_rows:
                continue
            keys, reps, marks = (c.to_numpy() for c in plain.columns)
            if held is not None:
                keys, reps, marks = (np.concatenate(([h], x)) for h, x in zip(held, (keys, reps, marks), strict=True))
            same = keys[1:] == keys[:-1]
            many = np.concatenate(([more], same))
            many[:-1] |= same
            held, more = (keys[-1], reps[-1], marks[-1]), bool(many[-1])
            many[-1] = False  # comes with the next batch
            if many.any():
                yield found(keys[many], reps[many], marks[many])
        if more:
            yield found(*(np.array([h]) for h in held))

    def found(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "rep", "n"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key").sortWithinPartitions("key", "rep")
    return dealt.mapInArrow(group, "key long, rep long, n long")


def _needed(rows: DataFrame) -> DataFrame:
    """(key, rep) without the hot blocks of documents that can do without all theirs.

    A block is hot for both documents that share it. Where one of them has no more hot and empty blocks than its band has
    to spare, the two share another block, which neither leaves out; else both keep theirs.
    """
    rows = rows.distinct()
    hot = rows.groupBy("key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > HOT).select("key")
    marked = rows.join(store.materialize(hot.withColumn("hot", F.lit(1)), "join-hot"), "key", "left")
    marked = store.materialize(marked.withColumn("hot", F.coalesce("hot", F.lit(0))), "join-marked")
    few = marked.where("hot = 1").groupBy("rep", "n").agg(F.count("*").alias("h"))
    slack = F.pmod(-F.col("n"), F.lit(_BAND)) - 2
    few = store.materialize(few.where(F.col("h") <= slack).select("rep", "n", F.lit(1).alias("hot")), "join-few")
    return marked.join(few, ["rep", "n", "hot"], "left_anti").select("key", "rep")


def _stars(rows: DataFrame) -> DataFrame:
    """(hub, rep): each document of a key with the key's document that shares most blocks with others.

    Written between joins, so that a hot key's rows can be split.
    """
    sizes = store.materialize(rows.groupBy("key").agg(F.count("*").alias("others")), "join-sizes")
    shares = rows.join(sizes, "key").groupBy("rep").agg(F.sum("others").alias("shares"))
    shares = store.materialize(shares, "join-shares")
    best = F.max_by("rep", F.struct("shares", -F.col("rep")))
    centers = store.materialize(rows.join(shares, "rep").groupBy("key").agg(best.alias("hub")), "join-hubs")
    return rows.join(centers, "key").where("rep <> hub").select("hub", "rep").distinct()


def _differences(stars: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Every star pair on whole texts: whether it links, the sizes, and the first n-grams of the symmetric difference.

    The difference is in an order that all documents of a hub share: first what the hub lacks, then what only it has. A
    hub's ``hub_key`` is its text's, as rows of one id may have several. A hub's text goes once to each run of its
    documents; those follow it in order and are compared as they come.
    """
    runs = stars.groupBy("hub").agg(F.ceil(F.count("*") / RUN).cast("int").alias("n_runs"))
    runs = store.materialize(runs, "join-runs")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    hubs = runs.select("hub", F.explode(F.sequence(F.lit(0), F.col("n_runs") - 1)).alias("run"))
    hubs = hubs.join(texts, hubs.hub == texts.id).select("hub", "run", F.lit(None).cast("long").alias("rep"), "text")
    reps = stars.join(runs, "hub").select("hub", F.pmod(F.xxhash64("rep"), "n_runs").cast("int").alias("run"), "rep")
    reps = reps.join(texts, reps.rep == texts.id).select("hub", "run", "rep", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_hub, centers = None, []  # (key, n-grams) of each text of the hub
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found = []
                for hub, run, rep, text in zip(*(x.to_pylist() for x in batch.slice(at, 200).columns), strict=True):
                    if at_hub != (hub, run):
                        at_hub, centers = (hub, run), []
                    members = shingles(text, width)
                    if rep is None:
                        key = xxhash.xxh3_64_intdigest(hub.to_bytes(8, "little", signed=True) + (text or "").encode())
                        if len(members) and all(key != k for k, _ in centers):
                            centers.append((key, members))
                        continue
                    for key, c in centers:
                        where = np.minimum(np.searchsorted(c, members), len(c) - 1)
                        both = c[where] == members
                        shared = int(both.sum())
                        joint = len(c) + len(members) - shared
                        lost = np.ones(len(c), bool)
                        lost[where[both]] = False
                        order = np.concatenate((members[~both], c[lost]))
                        order = order[: len(members) * (100 - percent) // percent + 1].view(np.int64)
                        linked = 100 * shared >= percent * joint
                        found.append((hub, rep, linked, len(members), joint - shared, order, key - (1 << 63), len(c)))
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                    kinds += (pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(x), k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)],
                        ["hub", "rep", "linked", "size", "differ", "first", "hub_key", "hub_size"],
                    )

    n = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = hubs.unionByName(reps).repartition(n, "hub", "run").sortWithinPartitions("hub", "run", F.col("rep").asc_nulls_first())
    kinds = "hub long, rep long, linked boolean, size long, differ long, first array<long>, hub_key long, hub_size long"
    return dealt.mapInArrow(compare, kinds)


def _across(diffs: DataFrame, homes: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents of one hub, not both linked with it, with different homes, that may link all the same.
    ``homes`` (rep, home); a document that is not there is its own home.

    With the hub's difference sets X and Y, theirs is X xor Y. To link it must be no more than ``most``, so X and Y share
    at least ``o = (|X| + |Y| - most) / 2`` members, which is positive unless both link with the hub. Then the first member
    they share stands among the first ``|X| - o + 1`` of X and ``|Y| - o + 1`` of Y. For the smaller set that is no more
    than ``most / 2 + 1``, so only so many of it are looked up. Texts of one frame with own names share what the hub has
    in the names' places, but behind their own names, which alone are more; so they meet nowhere.
    """
    diffs = diffs.join(homes, "rep", "left").withColumn("home", F.coalesce("home", "rep"))
    wide = diffs.groupBy("hub_key").agg(
        F.max("size").alias("widest"), F.min("home").alias("h1"), F.max("home").alias("h2"), F.bool_and("linked").alias("all")
    )
    open_hubs = store.materialize(wide.where("h1 < h2 and not all").select("hub_key", "widest"), "join-open")
    partner = F.least("widest", F.floor(F.col("size") * 100 / percent))
    reach = F.floor((F.col("size") + partner) * (100 - percent) / (100 + percent))
    info = diffs.join(open_hubs, "hub_key").select("hub_key", "rep", "size", "differ", "linked", "home", "first", reach.alias("reach"))
    info = store.materialize(info, "join-open-rows")
    rows = info.select("hub_key", "rep", "home", F.floor(F.col("reach") / 2).alias("half"), "linked", "reach", F.posexplode("first").alias("i", "e"))
    rows = rows.where(F.col("i") <= F.col("reach"))
    meet = rows.select(F.xxhash64("hub_key", "e").alias("meet"), "hub_key", "rep", "home", "linked", (F.col("i") <= F.col("half")).alias("low"), "i")
    keys = meet.groupBy("meet").agg(
        F.min("home").alias("h1"), F.max("home").alias("h2"), F.bool_or("low").alias("some"), F.bool_and("linked").alias("all")
    )
    keys = store.materialize(keys.where("h1 < h2 and some and not all").select("meet"), "join-meeting")
    met = store.materialize(meet.drop("home", "linked").join(keys, "meet"), "join-met")
    met = met.join(info.select("hub_key", "rep", "size", "differ", "linked", "home"), ["hub_key", "rep"])
    met = store.materialize(met, "join-met-rows")
    side = lambda n, df: df.select("hub_key", "meet", *[F.col(x).alias(f"{x}{n}") for x in ("rep", "size", "differ", "home", "linked", "i")])
    most = F.floor((F.col("size1") + F.col("size2")) * (100 - percent) / (100 + percent))
    o = F.ceil((F.col("differ1") + F.col("differ2") - most) / 2)
    near = (
        (F.struct("differ1", "rep1") < F.struct("differ2", "rep2"))
        & (F.col("home1") != F.col("home2"))
        & ~(F.col("linked1") & F.col("linked2"))
        & (100 * F.least("size1", "size2") >= percent * F.greatest("size1", "size2"))
        & (F.col("i1") <= F.col("differ1") - o)
        & (F.col("i2") <= F.col("differ2") - o)
    )
    pairs = side(1, met.where("low")).join(side(2, met), ["hub_key", "meet"]).where(near)
    return pairs.select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).where("a < b").distinct()


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose whole texts in ``docs`` (doc_id, text) link, with their shared and joint n-grams."""
    a = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[str, np.ndarray] = OrderedDict()

        def members(text: str | None) -> np.ndarray:
            if text in kept:
                kept.move_to_end(text)
            else:
                kept[text] = shingles(text, width)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[text]

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found = []
                for x, y, tx, ty in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    u, v = members(tx), members(ty)
                    least, most = sorted((len(u), len(v)))
                    if not least or 100 * least < percent * most:
                        continue
                    both = np.concatenate((u, v))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        found.append((x, y, shared, len(both) - shared))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b", "shared", "joint"]
                    )

    texts = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return texts.mapInArrow(compare, "a long, b long, shared long, joint long")


def _overlap(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """How many members each list of ``a`` shares with each of ``b``."""
    sides = []
    for x in (a, b):
        sides.append((np.repeat(np.arange(len(x)), x.value_lengths().to_numpy()), x.flatten().to_numpy()))
    out = np.zeros((len(a), len(b)), np.int64)
    both = np.intersect1d(sides[0][1], sides[1][1])
    for at in range(0, len(both), 4096):
        part = both[at : at + 4096]
        marks = []
        for x, (row, value) in zip((a, b), sides, strict=True):
            where = np.minimum(np.searchsorted(part, value), len(part) - 1)
            there = part[where] == value
            mark = np.zeros((len(x), len(part)), np.float32)
            mark[row[there], where[there]] = 1
            marks.append(mark)
        out += (marks[0] @ marks[1].T).astype(np.int64)
    return out


def _compare_tiles(a: pa.StructArray, b: pa.StructArray, same: bool, percent: int) -> Iterator[tuple]:
    """(a, b, n) of two tiles of a hub: n links of ``a`` where ``b`` is null, else one link."""
    (rep1, size1, differ1, odd1), (rep2, size2, differ2, odd2) = (
        [x.field(n).to_numpy(zero_copy_only=False) for n in ("rep", "size", "differ", "odd")] for x in (a, b)
    )
    sizes, differs = size1[:, None] + size2, differ1[:, None] + differ2
    most = sizes * (100 - percent) // (100 + percent)
    linked = (rep1[:, None] < rep2) if same else np.ones((len(rep1), len(rep2)), bool)
    linked &= abs(differ1[:, None] - differ2) <= most
    if not linked.any():
        return
    odd = odd1[:, None] | odd2
    linked &= odd | (_overlap(a.field("earlier"), b.field("earlier")) == 0)
    unlike = differs - 2 * _overlap(a.field("first"), b.field("first"))
    linked &= 100 * (sizes - unlike) >= percent * (sizes + unlike)
    counted = linked & ~odd
    for reps, ns in ((rep1, counted.sum(1)), (rep2, counted.sum(0))):
        for i in np.flatnonzero(ns):
            yield int(reps[i]), None, int(ns[i])
    for i, j in np.argwhere(linked & odd):
        yield (*sorted((int(rep1[i]), int(rep2[j]))), 1)


def _stands(diffs: DataFrame) -> DataFrame:
    """Every document with each hub that it links with, the hub itself too, which differs in nothing."""
    own = diffs.select(
        "hub_key", F.col("hub").alias("rep"), F.col("hub_size").alias("size"), F.lit(0).cast("long").alias("differ"),
        F.array().cast("array<bigint>").alias("first"),
    ).dropDuplicates(["hub_key"])
    return diffs.where("linked").select("hub_key", "rep", "size", "differ", "first").unionByName(own)


def _degrees(diffs: DataFrame, hubs: DataFrame, more: DataFrame, hashed: DataFrame, percent: int) -> DataFrame:
    """(rep, n_links): with how many others each document links, over all pairs. ``hubs``: (rep, hubs) of ``_stands``.

    Two documents that link either both link with some hub, or ``more`` (a, b) has them. A hub's documents are cut into
    tiles and compared tile by tile: sets that link with the hub are whole, and two differ in X xor Y. A pair is counted
    with the first hub that both link with. Ids with several texts give pairs, made distinct at the end.
    """
    odd = hashed.where("doc_id is not null").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    odd = store.materialize(odd.select(F.col("doc_id").alias("rep"), F.lit(True).alias("odd")), "join-odd")
    rows = _stands(diffs)
    counts = rows.groupBy("hub_key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n_tiles"))
    counts = store.materialize(counts, "join-tile-counts")
    rows = rows.join(counts, "hub_key").join(hubs, "rep").join(odd, "rep", "left").select(
        "hub_key", "n_tiles", F.pmod(F.xxhash64("rep"), "n_tiles").cast("int").alias("tile"),
        F.struct(
            "rep", "size", "differ", "first", F.coalesce("odd", F.lit(False)).alias("odd"),
            F.filter("hubs", lambda h: h < F.col("hub_key")).alias("earlier"),
        ).alias("member"),
    )
    tiles = rows.groupBy("hub_key", "n_tiles", "tile").agg(F.collect_list("member").alias("one"))
    tiles = store.materialize(tiles, "join-tiles")
    big = tiles.where("n_tiles > 1 and tile < n_tiles - 1")
    big = big.select("hub_key", "one", F.explode(F.sequence(F.col("tile") + 1, F.col("n_tiles") - 1)).alias("tile"))
    others = tiles.where("n_tiles > 1").select("hub_key", "tile", F.col("one").alias("other"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                one, same = batch.column(0)[i].values, batch.num_columns == 1
                found += _compare_tiles(one, one if same else batch.column(1)[i].values, same, percent)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b", "n"]
                )

    kinds = "a long, b long, n long"
    n = int(diffs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crossed = big.join(others, ["hub_key", "tile"]).select("one", "other").repartition(n)
    found = tiles.select("one").mapInArrow(compare, kinds).union(crossed.mapInArrow(compare, kinds))
    found = store.materialize(found, "join-found")
    links = more.union(found.where("b is not null").select("a", "b"))
    ends = links.distinct().select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).cast("long").alias("n"))
    ends = ends.union(found.where("b is null").select("a", "n"))
    return ends.groupBy("rep").agg(F.sum("n").alias("n_links"))


def _link(docs: DataFrame, width: int, percent: int, counted: bool) -> DataFrame:
    """doc_id, n_shingles, component_id and, where ``counted``, n_links."""
    digest = F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("h")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest)
    known = store.bucketed(texts.where("doc_id is not null"), "doc_id", "join-texts")
    ids = known.select("doc_id", "h")
    classes = store.materialize(ids.groupBy("h").agg(F.min("doc_id").alias("rep")), "join-classes")
    first = classes.select("rep").distinct()
    number = F.conv(F.substring("h", 1, 15), 16, 10).cast("long").alias("number")
    reps = known.join(first, known.doc_id == first.rep).select("rep", "text", number)
    shared = store.materialize(_shared(_rows(reps, width, percent)), "join-shared")
    sizes = shared.where("n > 0").groupBy("rep", F.col("key").alias("number")).agg(F.max("n").alias("n_shingles"))
    rows = store.materialize(_needed(shared.where("n < 0")), "join-rows")
    stars = store.materialize(_stars(rows), "join-stars")
    diffs = store.materialize(_differences(stars, known, width, percent), "join-differences")
    links = diffs.where("linked").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    if counted:
        hubs = _stands(diffs).groupBy("rep").agg(F.collect_set("hub_key").alias("hubs"))
        hubs = store.materialize(hubs, "join-rep-hubs")
        homes = hubs.select("rep", F.array_min("hubs").alias("home"))
    else:
        joined = store.materialize(components(links, "a", "b"), "join-components")
        homes = joined.select(F.col("node").alias("rep"), F.col("component").alias("home"))
    across = store.materialize(_across(diffs, homes, percent), "join-across")
    more = store.materialize(verify(across, known, width, percent).select("a", "b"), "join-more")
    if counted or not more.isEmpty():
        joined = store.materialize(components(links.union(more), "a", "b"), "join-components")

    info = classes.withColumn("number", number).join(sizes, ["rep", "number"], "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    if counted:
        sides = [hubs.select(F.col("rep").alias(x), F.col("hubs").alias(f"hubs_{x}")) for x in ("a", "b")]
        alone = more.join(sides[0], "a", "left").join(sides[1], "b", "left")
        alone = alone.where(~F.coalesce(F.arrays_overlap("hubs_a", "hubs_b"), F.lit(False))).select("a", "b")
        info = info.join(_degrees(diffs, hubs, alone, ids, percent), "rep", "left")
    info = store.materialize(info, "join-info")
    n = F.coalesce("n_shingles", F.lit(0))
    hashed = ids.union(texts.where("doc_id is null").select("doc_id", "h"))
    return hashed.join(info, "h", "left").select(
        "doc_id",
        n.cast("long").alias("n_shingles"),
        F.when(n == 0, F.col("doc_id"))
        .when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
        .alias("component_id"),
        *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if counted else []),
    )


def link(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other texts that its text links with)."""
    return _link(docs, width, percent, True)


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the smallest id, with its own columns; null ids all stay."""
    found = _link(docs.select("doc_id", "text"), width, percent, False)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(store.materialize(first, "join-first"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
