"""Jaccard self-join of documents on word n-grams, by rare-first prefix filtering.

1. One pass counts shingles into a sketch, over all documents, and gives each
   document its set's size, a 128-bit fingerprint and the parities of its counts in
   slices of the hash space, about one to two slices a shingle. Documents with equal
   sets are one class, named by its least id.
2. A second pass orders each set rare first, by (sketch count, hash): any order
   that all sets share is exact, and the sketch only decides how rare the
   prefix's shingles are. Its 2**SKETCH_BITS counters don't saturate; what stands in
   more documents than the square root of a counter's load is told from the rest at
   any size. The first n - ceil(t n) + 1 shingles are emitted; a window over each
   shingle drops those that one class alone has. Shingles that the sketch finds
   frequent are dealt by (shingle, salt).
3. In a shingle's posting list, neighbours by set size, and each member with the
   one whose shingles are shared most, are verified: their links give first
   components. A list of more than LIST_PART entries is dealt into parts, whose
   leaders are paired with the list's leader. The lists are then joined with
   themselves for pairs of classes of different components only, under the length
   filter and the positional filter of a first common shingle, a list of more than
   JOIN_PART entries by pairs of parts; each pair is kept once and
   must pass the suffix filter (each slice of different parity holds at least one
   shingle that the two do not share). What is left is verified once by the
   sets' intersection. A group of near copies is
   thus joined by its leader and neighbours, not by all its pairs, and no link
   between components is lost.

Verified links pass through components(). Sets are recounted from the texts
for the documents of candidate pairs only, found by a Bloom filter sized by their
number (ids that pass it by chance are dropped in the join, which costs disk, not
results); beyond MAX_BLOOM_IDS documents they are found by a join of the ids.

Edge cases: a null text or one without words has an empty set and links with
nothing; with fewer words than n the whole sequence is one shingle; rows of one
id are one document that has every one of its sets, listed once with the largest
size; a null id is listed but takes no part; ids must be whole numbers or their
text, else the cast raises; an empty table gives an empty one; other columns are
ignored; texts are shingled whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import Workspace, components, lean, mix64, shingle_sets, small_batches

SKETCH_BITS, SKETCH_ROW = 22, 1 << 16
#: Parts of one block of the sketch that a task adds up at most before the last step.
SKETCH_PARTS = 256
#: Steps of the counters' logarithm to base 2.
RANK_STEPS = 1024
MIN_SLICES, MAX_SLICES = 64, 1 << 15
#: Bits of the Bloom filter: 16 for each id, at least and at most so many.
LEAST_BLOOM_BITS, MAX_BLOOM_IDS = 20, 1 << 24
#: Entries of a posting list that are sorted together, and joined with others, at most.
LIST_PART, JOIN_PART = 1024, 8192
#: Pairs of one document that are verified together at most.
HUB_PART = 64
#: Fingerprints that a task remembers, so as to emit copies once; it forgets them all when it has so many.
MAX_SEEN = 500_000

_SUM_A, _SUM_B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix64(own ^ _SUM_A).sum(dtype=np.uint64), mix64(own ^ _SUM_B).sum(dtype=np.uint64)
    return int(np.array(a, np.uint64).view(np.int64)), int(np.array(b, np.uint64).view(np.int64))


def _parities(own: np.ndarray) -> np.ndarray:
    """Parities of a set's counts in as many slices as the next power of two, 64 to a long."""
    m = min(max(1 << max(len(own) - 1, 0).bit_length(), MIN_SLICES), MAX_SLICES)
    odd = np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _pack(counts: np.ndarray) -> bytes:
    """Counts as their low bytes and, compressed, what is above."""
    return (counts & 255).astype(np.uint8).tobytes() + zlib.compress((counts >> 8).astype("<i8").tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    low = np.frombuffer(packed, np.uint8, SKETCH_ROW).astype(np.int64)
    return low + (np.frombuffer(zlib.decompress(packed[SKETCH_ROW:]), "<i8") << 8)


def _summaries(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (doc_id, size, f1, f2, slices) and, with `counts`, rows of each task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        shift = np.uint64(64 - SKETCH_BITS)
        names = ["doc_id", "size", "f1", "f2", "slices", "block", "counts"]
        for batch in batches:
            sizes, f1, f2, slices = [], [], [], []
            for own in shingle_sets(batch.column("text").to_pylist(), n):
                sizes.append(len(own))
                a, b = _fingerprint(own)
                f1.append(a)
                f2.append(b)
                slices.append(_parities(own))
                np.add.at(sketch, (own >> shift).astype(np.int64), 1)
            k = len(sizes)
            flat = pa.array(np.concatenate(slices) if slices else np.zeros(0, np.int64))
            ends = pa.array(np.cumsum([0] + [len(x) for x in slices]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names
            )
        rows = [i for i in range(0, 1 << SKETCH_BITS, SKETCH_ROW) if sketch[i : i + SKETCH_ROW].any()]
        r = len(rows)
        if r:
            packed = pa.array([_pack(sketch[i : i + SKETCH_ROW]) for i in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(r, pa.int64()), *[pa.nulls(r, pa.int64())] * 3, pa.nulls(r, pa.list_(pa.int64())), pa.array([i // SKETCH_ROW for i in rows], pa.int32()), packed], names=names)

    return docs.mapInArrow(lean(run), "doc_id long, size long, f1 long, f2 long, slices array<long>, block int, counts binary")


def _sketch(parts: DataFrame) -> np.ndarray:
    """The tasks' sketches added up, as logarithms in RANK_STEPS: 2**SKETCH_BITS numbers of two bytes, whatever the input's size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = _unpack(counts)
                total[block] = total[block] + own if block in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_pack(t) for t in total.values()], pa.binary())], names=["block", "counts"])

    groups = -(-parts.count() // (SKETCH_PARTS * ((1 << SKETCH_BITS) // SKETCH_ROW)))
    if groups > 1:
        parts = parts.repartition("block", F.pmod(F.xxhash64("counts"), F.lit(groups))).mapInArrow(lean(add), "block int, counts binary")
    rows = parts.repartition("block").mapInArrow(lean(add), "block int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint16)
    for r in rows:
        out[r["block"] * SKETCH_ROW : (r["block"] + 1) * SKETCH_ROW] = np.round(RANK_STEPS * np.log2(1.0 + _unpack(bytes(r["counts"]))))
    return out


def _salts(ranks: np.ndarray) -> np.ndarray:
    """For each rank the parts that a shingle of it is dealt into: one in LIST_PART of what it counts above a middling counter, none where that gives one."""
    usual = float(np.median(ranks[ranks > 0])) if ranks.any() else 0.0
    counts = np.exp2(np.arange(1 << 16) / RANK_STEPS) - np.exp2(usual / RANK_STEPS)
    parts = np.minimum(np.ceil(counts / LIST_PART), 1 << 20).astype(np.int64)
    return np.where(parts > 1, parts, 0)


def _prefixes(docs: DataFrame, n: int, percent: int, sketch) -> DataFrame:
    """(token, salt, f1, spot) of each document's prefix; salt is 0 for all but frequent shingles, spot holds the set's size above 2**32 and the token's place below.

    f1 alone stands for the class here: should two classes ever share it, both are candidates and verification tells them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, salts = sketch.value
        shift = np.uint64(64 - SKETCH_BITS)
        seen: set[int] = set()
        cols: list[list[np.ndarray]] = [[], [], [], []]
        held = 0

        def flush() -> pa.RecordBatch:
            made = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int32 if i == 1 else np.int64)) for i, c in enumerate(cols)]
            for c in cols:
                c.clear()
            return pa.RecordBatch.from_arrays(made, names=["token", "salt", "f1", "spot"])

        for batch in batches:
            for own in shingle_sets(batch.column("text").to_pylist(), n):
                size = len(own)
                if not size:
                    continue
                name = _fingerprint(own)
                if name in seen:  # copies that a task meets emit once
                    continue
                if len(seen) >= MAX_SEEN:
                    seen.clear()
                seen.add(name)
                keep = size - -(-percent * size // 100) + 1
                rank = ranks[(own >> shift).astype(np.int64)]
                first = np.lexsort((own, rank))[:keep]
                parts = salts[rank[first]]
                salt = np.where(parts > 0, 1 + name[0] % np.maximum(parts, 1), 0).astype(np.int32)
                for c, v in zip(cols, (_signed(own[first]), salt, np.full(keep, name[0]), (size << 32) + np.arange(keep, dtype=np.int64)), strict=True):
                    c.append(v)
                held += keep
                if held > 200_000:
                    yield flush()
                    held = 0
        yield flush()

    return docs.select("text").mapInArrow(lean(run), "token long, salt int, f1 long, spot long")


def _bloom_slot(node: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(1 << bits))


def _bloom(nodes: DataFrame, bits: int):
    """A bit for each hashed id of `nodes`, 2**bits in all, gathered as blocks of 64 longs: two bytes an id."""
    slot = _bloom_slot(F.col("node"), bits)
    words = nodes.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    blocks = words.groupBy(F.shiftright("w", 6).alias("block")).agg(F.collect_list((F.col("w") % 64).cast("int")).alias("at"), F.collect_list("b").alias("bits")).collect()
    table = np.zeros((1 << bits) // 64, np.int64)
    for r in blocks:
        table[r["block"] * 64 + np.array(r["at"], np.int64)] = r["bits"]
    return nodes.sparkSession.sparkContext.broadcast(table)


def _sets(docs: DataFrame, n: int, nodes: DataFrame) -> DataFrame:
    """(node, f1, shingles): the sets of the documents `nodes` (distinct ids), and of some others where a Bloom filter finds them."""
    many = nodes.count()
    named = docs.where("doc_id is not null")
    bits = max(LEAST_BLOOM_BITS, (16 * many).bit_length())
    table = None
    if many <= MAX_BLOOM_IDS:
        table = _bloom(nodes, bits)
        named = named.select("doc_id", "text", _bloom_slot(F.col("doc_id"), bits).alias("slot"))
    else:
        named = named.select("doc_id", "text").join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            if table is not None:
                slot = some.column("slot").to_numpy(zero_copy_only=False)
                some = some.take(pa.array(np.flatnonzero((table.value[slot >> 6] >> (slot & 63)) & 1)))
            if not some.num_rows:
                continue
            sets = list(shingle_sets(some.column("text").to_pylist(), n))
            ends = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(sets))))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([_fingerprint(x)[0] for x in sets], pa.int64()), shingles], names=["node", "f1", "shingles"])

    return named.mapInArrow(lean(run), "node long, f1 long, shingles array<long>")


def _enough(overlap: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    """100 x overlap >= percent x union."""
    return F.lit(100) * overlap >= F.lit(percent) * (size_a + size_b - overlap)


def _first_place(size_a: Column, place_a: Column, size_b: Column, place_b: Column, percent: int) -> Column:
    """The length and positional filters as they hold at a pair's first common shingle: what stands there and behind is all that can be shared. A pair that fails there fails at every later one."""
    return _enough(F.least(size_a - place_a, size_b - place_b), size_a, size_b, percent)


def _folded(slices: Column, length: Column) -> Column:
    """Parities in half as many slices, where there are more than `length` longs."""
    half = (F.size(slices) / 2).cast("int")
    return F.when(F.size(slices) > length, F.zip_with(F.slice(slices, 1, half), F.slice(slices, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(slices)


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The suffix filter: (a, fa, b, fb) of the pairs whose slices allow enough common shingles. Sets too unequal to be brought to one number of slices pass."""
    a = nodes.select(F.col("node").alias("a"), F.col("f1").alias("fa"), F.col("slices").alias("sa"), F.col("size").alias("na"))
    b = nodes.select(F.col("node").alias("b"), F.col("f1").alias("fb"), F.col("slices").alias("sb"), F.col("size").alias("nb"))
    joined = pairs.join(a, "a").join(b, "b")
    differ = F.zip_with(_folded(F.col("sa"), F.size("sb")), _folded(F.col("sb"), F.size("sa")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    least = F.aggregate(differ, F.lit(0), lambda s, x: s + x)
    most = F.floor((F.col("na") + F.col("nb") - least) / 2)
    return joined.where(F.coalesce(_enough(most, F.col("na"), F.col("nb"), percent), F.lit(True))).select("a", "fa", "b", "fb")


def _with_sets(work: Workspace, name: str, pairs: DataFrame, sets: DataFrame, side: str, other: str) -> DataFrame:
    """`pairs` with the shingles of their document in column `side`. A document of many pairs is dealt into parts by the other one, its set copied to each."""
    hubs = pairs.groupBy(F.col(side).alias("hub")).agg(F.ceil(F.count("*") / HUB_PART).cast("int").alias("parts")).where("parts > 1")
    hubs = work.keep(hubs, f"{name}-hubs-{side}")  # a row for HUB_PART pairs at most
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("parts"))).cast("int")
    left = pairs.join(hubs, F.col(side) == F.col("hub"), "left").withColumn("part", part).drop("hub", "parts")
    own = sets.select(F.col("node").alias(side), F.col("f1").alias(f"f{side}"), F.col("shingles").alias(f"set_{side}"))
    own = own.join(hubs, F.col(side) == F.col("hub"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("hub", "parts")
    return left.join(own, [side, f"f{side}", "part"]).drop("part")


def _verified(work: Workspace, name: str, docs: DataFrame, n: int, percent: int, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked."""
    ends = work.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-ends")
    sets = work.keep(_sets(docs, n, ends), f"{name}-sets").dropDuplicates(["node", "f1"])
    joined = _with_sets(work, name, _with_sets(work, name, pairs, sets, "b", "a"), sets, "a", "b")
    overlap = F.size(F.array_intersect("set_a", "set_b"))
    links = work.keep(joined.where(_enough(overlap, F.size("set_a"), F.size("set_b"), percent)).select(F.col("a").alias("src"), F.col("b").alias("dst")), f"{name}-links")
    work.drop(f"{name}-sets", f"{name}-ends", f"{name}-hubs-a", f"{name}-hubs-b")
    return links


def _self_joined(a: DataFrame, b: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Pairs (x, y) of entries of one list in different components, the smaller set first, that the length and positional filters let pass."""
    a, b = a.alias("a"), b.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    joined = a.join(
        b,
        same
        & (F.col("a.component") != F.col("b.component"))
        & ((F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.node") < F.col("b.node"))))
        & _first_place(F.col("a.size"), F.col("a.place"), F.col("b.size"), F.col("b.place"), percent),
    )
    return joined.select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    docs = small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    first = work.keep(_summaries(docs, n), "summaries")
    summaries = first.where("block is null").select("doc_id", "size", "f1", "f2", "slices")
    ranks = _sketch(first.where("block is not null").select("block", "counts"))
    sketch = spark.sparkContext.broadcast((ranks, _salts(ranks)))
    full = summaries.where("doc_id is not null and size > 0")
    nodes = work.keep(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("slices").alias("slices")), "nodes")

    tokens = _prefixes(docs.where("doc_id is not null"), n, percent, sketch)
    by_token = Window.partitionBy("token", "salt")
    # copies of a prefix from other tasks stand beside each other; a salted list is shared whatever its part says
    shared = tokens.withColumn("before", F.lag("f1").over(by_token.orderBy("f1"))).withColumn("least", F.min("f1").over(by_token)).withColumn("most", F.max("f1").over(by_token))
    shared = shared.where((F.col("before").isNull() | (F.col("before") != F.col("f1"))) & ((F.col("least") != F.col("most")) | (F.col("salt") > 0))).select("token", "f1", "spot")
    shared = work.keep(shared, "shared")
    # one shuffle by class: its id and the part of its shingles that others share
    postings = shared.join(nodes.select("f1", "node"), "f1")
    postings = postings.select("f1", "token", "node", F.shiftright("spot", 32).cast("int").alias("size"), F.col("spot").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"))
    share = F.count("*").over(Window.partitionBy("f1", "node")) / F.col("size")
    postings = work.keep(postings.select("token", "node", "size", "place", share.cast("float").alias("share")), "postings")
    # long lists, counted with partial sums: a row for LIST_PART postings at most
    long = work.keep(postings.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > LIST_PART).withColumnRenamed("token", "t"), "long")
    postings = postings.join(long, F.col("token") == F.col("t"), "left").drop("t")
    cut = lambda size: F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / size))).cast("int")
    postings = work.keep(postings.withColumn("part", cut(LIST_PART)), "listed")
    work.drop("shared", "postings")

    # in each part of a list neighbours by size, and the member most of whose shingles are shared with the others
    by_part = Window.partitionBy("token", "part")
    lead = F.struct("share", "node", "size", "place")
    before = F.lag(F.struct("node", "size", "place")).over(by_part.orderBy("size", "node"))
    leader = F.max(lead).over(by_part)
    partners = F.array(before, F.struct(leader["node"].alias("node"), leader["size"].alias("size"), leader["place"].alias("place")))
    near = postings.withColumn("partners", partners).select("node", "size", "place", F.explode("partners").alias("p")).where(F.col("p").isNotNull())
    # the parts' leaders with their list's
    leaders = work.keep(postings.where("n is not null").groupBy("token", "part").agg(F.max(lead).alias("l")), "leaders")
    first_of = leaders.groupBy(F.col("token").alias("t")).agg(F.max("l").alias("p"))
    heads = leaders.join(first_of, F.col("token") == F.col("t")).select("l.node", "l.size", "l.place", F.struct("p.node", "p.size", "p.place").alias("p"))
    near = near.unionByName(heads).where((F.col("p.node") != F.col("node")) & _first_place(F.col("size"), F.col("place"), F.col("p.size"), F.col("p.place"), percent))
    near = work.keep(near.select(F.least("p.node", "node").alias("a"), F.greatest("p.node", "node").alias("b")).distinct(), "near")
    links = _verified(work, "near", docs, n, percent, work.keep(_possible(near, nodes, percent), "near-possible"))
    groups = components(work, links, "near-groups")

    # the rest: pairs of classes that no link joins yet, in lists that hold several components
    owned = work.keep(postings.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")).select("token", "n", "part", "node", "size", "place", "component"), "owned")
    inside = owned.where("n is null").withColumn("least", F.min("component").over(by_part)).withColumn("most", F.max("component").over(by_part)).where("least <> most")
    pairs = _self_joined(inside, inside, ["token"], percent)
    several = owned.where("n is not null").groupBy(F.col("token").alias("t")).agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("t")
    dealt = owned.where("n is not null").join(several, F.col("token") == F.col("t"), "left_semi").withColumn("own", cut(JOIN_PART))
    others = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / JOIN_PART).cast("int") - 1))
    dealt = work.keep(dealt, "dealt")
    pairs = pairs.unionByName(_self_joined(dealt.withColumn("i", F.col("own")).withColumn("j", others), dealt.withColumn("j", F.col("own")).withColumn("i", others), ["token", "i", "j"], percent))
    once = work.keep(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(near, ["a", "b"], "left_anti"), "rest")
    more = _verified(work, "rest", docs, n, percent, work.keep(_possible(once, nodes, percent), "rest-possible"))
    # one id with several sets joins them
    own = full.join(nodes.select("f1", "f2", "node"), ["f1", "f2"]).select("doc_id", "node", "size")
    own = work.keep(own.distinct(), "own")
    several = own.groupBy("doc_id").agg(F.min("node").alias("dst"), F.max("node").alias("src")).where("src <> dst").select("src", "dst")
    groups = components(work, links.unionByName(more).unionByName(several), "groups")
    work.drop("nodes", "listed", "long", "leaders", "near", "near-possible", "near-links", "owned", "dealt", "rest", "rest-possible", "rest-links")
    grouped = own.join(groups, "node", "left").groupBy("doc_id").agg(F.max("size").alias("n_shingles"), F.min(F.coalesce("component", "node")).alias("component_id"))
    empty = summaries.where("doc_id is null or size = 0").select("doc_id", "size").distinct().join(grouped.select("doc_id"), "doc_id", "left_anti")
    return grouped.unionByName(empty.select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document has the least id of its group. Rows of one id stay together; a null id stays."""
    groups = similar_groups(docs, n, percent, id_col, text_col)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
