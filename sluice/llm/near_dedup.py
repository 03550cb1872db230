"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Equal texts are one node from the start, so copies cost nothing further. Nodes that share a band of three
samples are candidates: each with the bucket's least and greatest node (a star, not all pairs), then, where
the star leaves a bucket in several components, with drawn nodes, and at last every node with all of its bucket
that are still in other components. Links are verified by the weighted Jaccard similarity of the whole texts, or
the plain one; classes are the components.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from sluice.llm.common import Scratch, python_ready, text_of, written
from sluice.llm.shingles import Weights, mix, parts, shingles, weighted_jaccard

BANDS, SAMPLES = 8, 3
SIMILARITY = 0.8
#: Nodes of a bucket of which all pairs are made at most. In larger ones two drawn nodes meet all others, which only
#: joins what is easily joined: the rest is compared in blocks, every pair.
FEW = 12
#: Nodes of a block, and their weight (about as many words at most twice over), on average at most: two blocks are in memory at once.
BLOCK, BLOCK_WEIGHT = 512, 500_000.0
#: Parts that each bucket of several components is dealt to, and nodes of a crowded one that one task leads to the drawn
#: nodes, on average at most.
DEALT, SALT = 32, 128
_SLICES = 64
_COUNTS = pa.schema([("slice", pa.int32()), ("salt", pa.int32()), ("documents", pa.int64()), ("counts", pa.binary())])
_SIGNATURES = pa.schema([("doc_id", pa.int64()), ("node", pa.string()), ("bands", pa.list_(pa.int64())), ("weight", pa.float64())])
_LINKS = pa.schema([("a", pa.string()), ("b", pa.string()), ("similarity", pa.float64()), ("plain", pa.float64())])


def sample(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Sample k of each weighted set (counts > 0), one after the other: a 64-bit value that two sets share
    with the probability of their weighted Jaccard similarity (Ioffe's improved sampling)."""
    u = mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    v = mix(u + np.uint64(0xD1B54A32D192ED03))
    low = np.uint64(0xFFFFFFFF)
    unit = np.float32(2.0**-32)
    r = -np.log(((u >> np.uint64(32)).astype(np.float32) + 1) * unit * (((u & low).astype(np.float32) + 1) * unit))
    c = -np.log(((v >> np.uint64(40)).astype(np.float32) + 1) * np.float32(2.0**-24) * (((v >> np.uint64(16) & np.uint64(0xFFFFFF)).astype(np.float32) + 1) * np.float32(2.0**-24)))
    beta = (v & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
    r, c = np.maximum(r, np.float32(1e-6)), np.maximum(c, np.float32(1e-30))
    t = np.floor(np.log(weights) / r + beta)
    a = np.log(c) - r * (t - beta) - r
    starts = np.cumsum(counts) - counts
    least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), counts))
    owner = np.searchsorted(starts, least, side="right") - 1
    best = least[np.unique(owner, return_index=True)[1]]
    return mix(hashes[best] ^ mix(t[best].astype(np.int64).view(np.uint64) + np.uint64(k)))


def bands(hashes: np.ndarray, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of band values for each weighted set; empty ones must not be among them."""
    out = np.empty((len(counts), BANDS), np.uint64)
    for b in range(BANDS):
        value = np.zeros(len(counts), np.uint64)
        for s in range(SAMPLES):
            value = mix(value * np.uint64(31) + sample(hashes, w, counts, b * SAMPLES + s))
        out[:, b] = value
    return out.view(np.int64)


def frequencies(docs: DataFrame) -> Weights:
    """The sketch of document frequencies over all rows. Its size is fixed; partial sketches are summed slice by slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros(Weights.ROWS * Weights.WIDTH, np.int64), 0
        for batch in batches:
            for _, run in parts(batch["text"].to_pylist()):
                hashes, _, _ = shingles(run)
                for row, cell in enumerate(Weights.cells(hashes)):
                    total[row * Weights.WIDTH : (row + 1) * Weights.WIDTH] += np.bincount(cell, minlength=Weights.WIDTH)
                documents += len(run)
        if documents:
            salt = int.from_bytes(uuid.uuid4().bytes[:1], "little")
            rows = [(k, salt, documents if k == 0 else 0, part.tobytes()) for k, part in enumerate(np.split(total, _SLICES))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTS)], schema=_COUNTS)

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.int64) for b in rows["counts"])
        return pa.table([[rows["slice"][0].as_py()], [0], [sum(rows["documents"].to_pylist())], [total.tobytes()]], schema=_COUNTS)

    schema = from_arrow_schema(_COUNTS)
    partial = docs.select(text_of().alias("text")).mapInArrow(count, schema)
    rows = partial.groupBy("slice", "salt").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema).collect()
    counts = np.zeros((_SLICES, Weights.ROWS * Weights.WIDTH // _SLICES), np.int64)
    for r in rows:
        counts[r["slice"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    return Weights(counts.ravel(), sum(r["documents"] for r in rows))


def signatures(docs: DataFrame, weights) -> DataFrame:
    """doc_id, node (a hash of the whole text), band values (none for a text without words) and total weight. weights: a broadcast."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = []
            totals: list[float] = []
            for _, run in parts(batch["text"].to_pylist()):
                hashes, times, counts = shingles(run)
                w, some = weights.value.of(hashes, times), counts > 0
                rows = iter(bands(hashes, w, counts[some]).tolist() if some.any() else ())
                found += [next(rows) if x else [] for x in some]
                sums, ends = np.concatenate([[0.0], np.cumsum(w, dtype=np.float64)]), np.cumsum(counts)
                totals += (sums[ends] - sums[ends - counts]).tolist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["node"], pa.array(found, _SIGNATURES.field("bands").type), pa.array(totals)], schema=_SIGNATURES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_of().cast("binary")).alias("node"), text_of().alias("text"))
    return rows.mapInArrow(sign, from_arrow_schema(_SIGNATURES))


def texts_of(docs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """node and text, one row for each of nodes (node, id), written: every round of verification reads it."""
    rows = docs.select(F.md5(text_of().cast("binary")).alias("node"), _id(F.col("doc_id").cast("long")).alias("id"), text_of().alias("text"))
    return scratch.written(rows.join(nodes, ["node", "id"]).dropDuplicates(["node", "id"]).select("node", "text"), "near-texts")


def verified(texts: DataFrame, pairs: DataFrame, weights, similarity: float) -> DataFrame:
    """Pairs (a, b) with their weighted similarity and the plain one of their sets of shingles, those that reach the
    threshold in either: in a large group of near copies common shingles weigh less than what is changed, which
    mustn't part texts whose shingles are alike. Whole texts are compared."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = {k: batch[k].to_pylist() for k in ("a", "b")}
            held: dict[str, tuple] = {}
            out: list[tuple] = []
            bodies = {k: batch[f"text_{k}"] for k in ("a", "b")}
            for i in range(batch.num_rows):
                pair = []
                for k in ("a", "b"):
                    name = names[k][i]
                    if name not in held:
                        if len(held) > 256:
                            held.clear()
                        hashes, times, _ = shingles([bodies[k][i].as_py().encode()])
                        held[name] = (hashes, weights.value.of(hashes, times))
                    pair.append(held[name])
                value = weighted_jaccard(*pair)
                plain = weighted_jaccard(*((h, np.ones(len(h), np.float32)) for h, _ in pair))
                if max(value, plain) >= similarity:
                    out.append((names["a"][i], names["b"][i], value, plain))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 4, _LINKS)], schema=_LINKS)

    return both.mapInArrow(check, from_arrow_schema(_LINKS))


def _id(column):
    return F.coalesce(column, F.lit(-(1 << 63)).cast("long"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the least node of its component), for the nodes of links (a, b).

    Each round gives every node the least root among itself, its neighbours and its root's root; a round
    writes its table, so lost executors cost no more than that round.
    """
    edges = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
    edges = scratch.written(edges, "edges")
    roots = scratch.written(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "roots")
    while True:
        around = edges.join(roots.select(F.col("node").alias("other"), F.col("root").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = roots.join(around, "node", "left").join(jump, "root", "left")
        after = scratch.written(step.select("node", "root", F.least("root", "near", "far").alias("new")), "roots")
        roots = after.select("node", F.col("new").alias("root"))
        if after.where("root != new").isEmpty():
            return roots


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node (a hash of the text), root (the least node of its class) and class_id (the least doc_id there)
    for every row of docs (doc_id, text).

    A null text is empty, texts without words are in the class of the texts equal to them, a null doc_id
    keeps its row and counts as the least of all where a class must choose, repeated rows are in one class,
    other columns aren't read, an empty table gives no rows. Texts are read three times and shuffled only
    for nodes that are candidates.
    """
    spark: SparkSession = docs.sparkSession
    python_ready(spark)
    scratch = Scratch(spark)
    weights = spark.sparkContext.broadcast(frequencies(docs))  # two rows of 2^18 cells, whatever the size of docs
    signed = scratch.written(signatures(docs, weights), "signatures")
    nodes = scratch.written(signed.groupBy("node").agg(F.min(_id(F.col("doc_id"))).alias("id"), F.first("bands").alias("bands"), F.first("weight").alias("weight")), "nodes")
    members = nodes.select("node", "weight", F.posexplode("bands").alias("band", "value"))
    ends = members.groupBy("band", "value").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    met = scratch.written(members.join(ends, ["band", "value"]), "buckets")
    texts = texts_of(docs, nodes.select("node", "id").join(met.select("node").distinct(), "node"), scratch)
    pairs = scratch.written(_ordered(met.select("node", F.explode(F.array("low", "high")).alias("y")).withColumnRenamed("node", "x")), "pairs")
    roots = components(scratch.written(verified(texts, pairs, weights, similarity), "links"), scratch)
    more = _between(met, roots, similarity, scratch).join(pairs, ["a", "b"], "left_anti")
    roots = _joined(roots, scratch.written(verified(texts, more, weights, similarity), "links"), scratch)
    roots = _joined(roots, scratch.written(_rest(met, roots, texts, weights, similarity, scratch), "links"), scratch)
    named = nodes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("class_id"))
    final = named.join(least, "root").select("node", "root", F.when(F.col("class_id") > -(1 << 63), F.col("class_id")).alias("class_id"))
    out = written(signed.select("doc_id", "node").join(final, "node"), "near-classes")
    scratch.clear()
    return out


def _joined(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """roots after links between their components: only the components' graph is searched again."""
    one, two = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in ("a", "b"))
    ends = links.select("a", "b").join(one, "a", "left").join(two, "b", "left")
    ends = ends.select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y"))
    found = components(_ordered(ends), scratch).select(F.col("node").alias("root"), F.col("root").alias("new"))
    moved = roots.join(found, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    added = found.select(F.col("root").alias("node"), F.col("new").alias("root")).join(roots, "node", "left_anti")
    return scratch.written(moved.unionByName(added), "roots")


def _between(met: DataFrame, roots: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs of nodes that share a bucket but no component.

    Weights of sets with a link differ by a factor of s / (2 - s) at most (s the threshold, weights of a
    shingle between 1/2 and 1), so a bucket falls into windows of two neighbouring classes of weight. One of
    FEW nodes at most gives all their pairs. In a larger one the nodes of the least and greatest hash meet all
    others, and those that share a second band meet in the narrower buckets of both bands, by the same rule. Only
    lists of FEW are gathered; a large bucket is dealt to SALT nodes at a time, each with both drawn ones.
    """
    own = _windows(met, roots, similarity, scratch).select("bucket", "node", "root", "band", "n")
    many = own.where(F.col("n") > FEW).select("node", "root", "bucket", "band")
    two = many.join(met.select("node", F.col("band").alias("band2"), F.col("value").alias("value2")), "node").where("band < band2")
    two = _mixed(two.select(F.xxhash64("bucket", "band2", "value2").alias("bucket"), "node", "root", "band"))
    rows = own.unionByName(two).select("bucket", "node", "root", "n")
    lists = rows.where(F.col("n") <= FEW).groupBy("bucket").agg(F.collect_list(F.struct("node", "root")).alias("nodes"))
    each = lists.select(F.explode("nodes").alias("p"), "nodes").select("p.*", F.explode("nodes").alias("q")).where("node < q.node and root != q.root")
    crowd = rows.where(F.col("n") > FEW)
    drawn = F.struct(F.xxhash64("node", F.lit("drawn")).alias("hash"), "node", "root", "n")
    leaders = crowd.groupBy("bucket").agg(F.array(F.min(drawn), F.max(drawn)).alias("leaders"))
    leaders = leaders.select("bucket", "leaders", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("leaders")[0]["n"] / SALT))).alias("salt"))
    salt = F.pmod(F.xxhash64("node", F.lit("salt")), F.floor(F.col("n") / SALT) + 1)
    led = crowd.withColumn("salt", salt).join(leaders, ["bucket", "salt"]).select("node", "root", F.explode("leaders").alias("q")).where("root != q.root")
    return _ordered(each.unionByName(led.select("node", "root", F.struct("q.node", "q.root").alias("q"))).select(F.col("node").alias("x"), F.col("q.node").alias("y")))


def _windows(met: DataFrame, roots: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Nodes by bucket and window of weight, where more than one component is; home: in the upper class of the window's two."""
    class_ = F.floor(F.log("weight") / float(np.log((2 - similarity) / similarity)))
    own = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("window", class_).withColumn("home", F.lit(True))
    own = own.unionByName(own.withColumn("window", F.col("window") + 1).withColumn("home", F.lit(False))).withColumn("bucket", F.xxhash64("band", "value", "window"))
    return scratch.written(_mixed(own.select("bucket", "node", "root", "band", "weight", "home")), "windows")


def _rest(met: DataFrame, roots: DataFrame, texts: DataFrame, weights, similarity: float, scratch: Scratch) -> DataFrame:
    """Links that join what is still apart: every pair of nodes that share a crowded bucket but no component is compared.

    A bucket's largest component and its other nodes are dealt to blocks by a hash of the node; each block of
    others meets each block of both, a pair of blocks in one task. The nodes of the largest component don't meet
    each other, so a bucket of one component and a few others costs no more than its size for each block of others.
    """
    own = _windows(met, roots, similarity, scratch).where(F.col("n") > FEW)
    sizes = own.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.bool_or("home").alias("home"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root", "w")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.bool_or("home").alias("home")).where("home")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_WEIGHT), F.lit(1)).cast("int")
    sizes = sizes.select("bucket", F.col("most.root").alias("largest"), blocks(F.col("most.n"), F.col("most.w")).alias("of_largest"), blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("of_others"))
    dealt = _by_bucket(own.select("bucket", "node", "root", "home"), sizes).withColumn("large", F.col("root") == F.col("largest"))
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.when(F.col("large"), F.col("of_largest")).otherwise(F.col("of_others"))).cast("int")
    dealt = dealt.withColumn("block", block)
    place = lambda large, i, j: F.struct(large.alias("large"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    met_large = F.transform(upto("of_largest"), lambda j: place(F.lit(True), F.col("block"), j))
    met_other = F.transform(upto("of_others"), lambda j: place(F.lit(False), F.least(j, "block"), F.greatest(j, "block")))
    met_by = F.transform(upto("of_others"), lambda i: place(F.lit(True), i, F.col("block")))
    at = F.explode(F.when(F.col("large"), met_by).otherwise(F.concat(met_large, met_other)))
    pieces = dealt.select("bucket", "node", "root", "home", F.when(F.col("large"), -1).otherwise(F.col("block")).alias("part"), at.alias("at"))
    pieces = pieces.select("bucket", "at.large", "at.i", "at.j", "node", "root", "home", "part")

    def compare(group: pa.Table) -> pa.Table:
        large, i = group["large"][0].as_py(), group["i"][0].as_py()
        part = group["part"].to_numpy()
        seeks = part == i
        sought = part == -1 if large else part == group["j"][0].as_py()
        out = _links(group["node"].to_pylist(), group["root"].to_pylist(), group["text"].to_pylist(), group["home"].to_numpy(), seeks, sought, weights.value, similarity)
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 4, _LINKS)], schema=_LINKS)

    return pieces.join(texts, "node").groupBy("bucket", "large", "i", "j").applyInArrow(compare, from_arrow_schema(_LINKS))


def _links(names: list[str], roots: list[str], texts: list[str], home: np.ndarray, seeks: np.ndarray, sought: np.ndarray, weights: Weights, similarity: float) -> list[tuple]:
    """Links (a, b, similarity, plain) between nodes of which one seeks, one is sought and one is home, as many as
    join all components that any such link joins. Sums over an index of the shingles tell which pairs to verify."""
    found = []
    for _, run in parts(texts):
        hashes, times, counts = shingles(run)
        found.append((hashes, weights.of(hashes, times), counts))
    hashes, w, counts = (np.concatenate(c) for c in zip(*found))
    ends = np.cumsum(counts)
    starts = ends - counts
    sums = np.concatenate([[0.0], np.cumsum(w, dtype=np.float64)])
    totals = sums[ends] - sums[starts]
    owner = np.repeat(np.arange(len(names)), counts)
    kept = np.flatnonzero(sought[owner])
    kept = kept[np.argsort(hashes[kept], kind="stable")]
    index, owners, index_w = hashes[kept], owner[kept], w[kept]
    component = np.unique(roots, return_inverse=True)[1].tolist()
    group = list(range(max(component) + 1))

    def top(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    out = []
    for x in np.flatnonzero(seeks).tolist():
        own, own_w = hashes[starts[x] : ends[x]], w[starts[x] : ends[x]]
        low = np.searchsorted(index, own)
        many = np.searchsorted(index, own, side="right") - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(owners[at], minlength=len(names))
        shared = np.bincount(owners[at], np.minimum(index_w[at], np.repeat(own_w, many)), len(names))
        near = (shared >= (similarity - 1e-4) * (totals + totals[x] - shared)) | (common >= (similarity - 1e-4) * (counts + counts[x] - common))
        near &= sought & (home | home[x]) & (common > 0)
        for y in np.flatnonzero(near).tolist():
            one, two = top(component[x]), top(component[y])
            if one != two:
                pair = [(hashes[starts[k] : ends[k]], w[starts[k] : ends[k]]) for k in (x, y)]
                value, plain = weighted_jaccard(*pair), weighted_jaccard(*((h, np.ones(len(h), np.float32)) for h, _ in pair))
                if max(value, plain) >= similarity:
                    group[max(one, two)] = min(one, two)
                    out.append((*sorted((names[x], names[y])), value, plain))
    return out


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of buckets with more than one component, and how many nodes each has."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    return _by_bucket(rows, sizes.where("low != high").select("bucket", "n"))


def _by_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows with what buckets has of each bucket. A bucket's rows are dealt out by a hash of the node, its own row goes along."""
    each = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("dealt")), F.lit(DEALT)).cast("int")).join(each, ["bucket", "salt"]).drop("salt")


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class: that of the least doc_id, a null one before all, of equal ones the least node."""
    found = classes(docs, similarity).withColumn("id", _id(F.col("doc_id")))
    keep = found.groupBy("root").agg(F.min(F.struct("id", "node")).alias("kept")).select(F.col("kept.node").alias("_node"), F.col("kept.id").alias("_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.md5(text_of().cast("binary")).alias("_node"), _id(F.col("doc_id").cast("long")).alias("_id"))
    return rows.join(keep, ["_node", "_id"]).dropDuplicates(["_node", "_id"]).select("_row.*")
