"""Vector best-fit packing of tokenized documents into sequences, by length classes.

Pieces of equal length are interchangeable, so bins are built over the histogram of lengths, whose size is
bounded by the capacity however many documents there are. A bin takes the longest piece left and then,
again and again, the class whose demand (tokens, one document, attention cost length^2) fits the residual
in every dimension and scores best: by least norm of what is left, or by greatest dot-product of demand and
residual, both in shares of the capacity and weighted. The finished bin is repeated as often as all its
classes allow, so each pattern uses up a class or nearly so: there are few thousand patterns at most.
A piece's rank within its class then gives pattern, copy and place without moving any ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from sluice.llm.common import leading, python_ready, text_of, written
from sluice.llm.token_ids import END_ID, encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


@dataclass(frozen=True)
class Capacity:
    """Of a sequence. attention bounds the sum of the pieces' squared lengths; 0 is tokens^2, which no set of pieces
    within the tokens exceeds. A piece that alone exceeds a smaller bound has a sequence of its own."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 0
    score: str = "norm"  # or "dot"
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention or self.tokens**2], dtype=np.float64)


def patterns(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, list[tuple[int, int]]]]:
    """(copies, [(length, how many in each copy), ...]) of all bins for the histogram {length: count}.

    ValueError if a piece alone exceeds the tokens; one that alone exceeds the attention is a bin alone.
    Deterministic: ties go to the longer piece.
    """
    full, weights = capacity.vector(), np.asarray(capacity.weights)
    lengths = np.array(sorted((n for n, c in histogram.items() if c > 0), reverse=True), dtype=np.int64)
    if not len(lengths):
        return []
    left = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    demand = np.stack([lengths, np.ones_like(lengths), lengths**2], axis=1) / full
    if (demand[:, :2] > 1).any():
        raise ValueError("a piece exceeds the capacity")
    out = []
    while len(lengths):
        used = np.zeros_like(left)
        used[0], residual, order = 1, 1 - demand[0], [0]
        while True:
            fits = ((demand <= residual + 1e-12).all(axis=1)) & (used < left)
            at = np.flatnonzero(fits)
            if not len(at):
                break
            if capacity.score == "dot":
                best = at[np.argmax((demand[at] * residual) @ weights)]
            else:
                best = at[np.argmin(((residual - demand[at]) ** 2) @ weights)]
            # The same class fills the bin as long as it would be chosen again, one at a time.
            used[best] += 1
            residual = residual - demand[best]
            order.append(int(best))
        chosen = np.flatnonzero(used)
        copies = int((left[chosen] // used[chosen]).min())
        out.append((copies, [(int(lengths[i]), int(used[i])) for i in chosen]))
        left = left - copies * used
        keep = left > 0
        lengths, left, demand = lengths[keep], left[keep], demand[keep]
    return out


def pieces(docs: DataFrame, tokenizer: str, tokens: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. Documents longer than tokens are cut so that all
    pieces but the first have that length."""
    python_ready(docs.sparkSession)
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for key, ids in zip(batch["doc_id"].to_pylist(), tok.encode(batch["text"].to_pylist())):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % tokens + 1
                for k, start in enumerate((0, *range(first, n, tokens))):
                    size = tokens if k else first
                    rows.append((key, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
            columns = list(zip(*rows)) or [()] * len(PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(cut, from_arrow_schema(PIECES))


def pack(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity()) -> DataFrame:
    """The pieces of docs (doc_id, text), each with sequence_id and offset, gapless from 0.

    A null text is empty (one id, the end), rows of one doc_id are packed each, a null doc_id stays null,
    other columns aren't read, an empty table gives no rows. Texts are read once; what is shuffled are
    pieces of some 40 bytes. Only the histogram of lengths (at most as many rows as the capacity has
    tokens) goes to the driver, and only the patterns are broadcast.
    """
    if capacity.tokens < 1 or capacity.documents < 1 or capacity.attention < 0:
        raise ValueError("capacities are positive")
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity.tokens).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length: dict[int, list[tuple]] = {}
    sequence = 0
    taken: dict[int, int] = {}
    for copies, bin_ in patterns(histogram, capacity):
        offset = 0
        for length, each in bin_:
            by_length.setdefault(length, []).append((taken.get(length, 0), sequence, each, offset))
            taken[length] = taken.get(length, 0) + copies * each
            offset += length * each
        sequence += copies
    places = spark.createDataFrame(list(by_length.items()), "length long, slots array<struct<slot_from:long,first_sequence:long,each:long,slot_offset:long>>")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part", "length").orderBy("row")) - 1
    ranked = cut.withColumn("rank", rank).join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    most = max((len(s) for s in by_length.values()), default=1)
    slot = F.get("slots", leading(F.col("slots"), most, lambda s: s["slot_from"] <= F.col("rank")) - 1)
    placed = ranked.join(F.broadcast(places), "length").withColumn("slot", slot).withColumn("rank", F.col("rank") - F.col("slot.slot_from"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.first_sequence") + F.floor(F.col("rank") / F.col("slot.each"))).alias("sequence_id"),
        (F.col("slot.slot_offset") + F.col("rank") % F.col("slot.each") * F.col("length")).alias("offset"),
    )
