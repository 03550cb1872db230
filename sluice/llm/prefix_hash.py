"""Document fingerprints by prefix polynomial hashes.

With prefix arrays of a polynomial hash modulo 2^31 - 1 (two bases), the hash of any span takes two
lookups: that gives equality of spans, the longest common extension by binary search, the hash of a text
of which a part was replaced without reading the rest again, and the hashes of all windows. A fingerprint
is the code point count, the hash of the whole text and, for likeness, the least window hash in each of
128 classes (one-permutation sketch), 8 bits each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from sluice.llm.common import leading, python_ready, text_of

PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)
WINDOW, BINS = 8, 128
#: Keys sampled for each range of doc_ids.
SAMPLED = 60
_EMPTY = np.uint32(0xFFFFFFFF)
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix_edited", pa.int64()), ("common_prefix_next", pa.int64())])


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for unsigned 64-bit x < 2^62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


class _Powers:
    """Powers of a base and of its inverse, as long as the longest text so far."""

    def __init__(self, base: int):
        self.up, self.down = self._start(base), self._start(pow(base, -1, PRIME))

    @staticmethod
    def _start(base: int) -> np.ndarray:
        return np.array([1, base], dtype=np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            for name in ("up", "down"):
                a = getattr(self, name)
                step = _mod(a[-1:] * a[1:2])
                setattr(self, name, np.concatenate([a, _mod(a * step)]))


_POWERS = [_Powers(b) for b in BASES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


class PrefixHash:
    """Prefix arrays of a sequence of code points (any unsigned integers below 2^31 - 1)."""

    def __init__(self, codes: np.ndarray, after: PrefixHash | None = None, keep: int = 0):
        """after, keep: the sequence is the first keep elements of after, then codes."""
        n = keep + len(codes)
        self.n, self.prefix = n, []
        for k, powers in enumerate(_POWERS):
            powers.reach(n + 1)
            sums = np.cumsum(_mod(codes * powers.up[keep:n]), dtype=np.uint64)
            if after is None:
                self.prefix.append(np.concatenate([np.zeros(1, np.uint64), _mod(sums)]))
            else:
                head = after.prefix[k][: keep + 1]
                self.prefix.append(np.concatenate([head, _mod(sums + head[-1])]))

    def whole(self) -> tuple[int, int]:
        return int(self.prefix[0][-1]), int(self.prefix[1][-1])

    def span(self, start: int, length: int, base: int = 0) -> int:
        """The hash of one span."""
        h = self.prefix[base]
        return (int(h[start + length]) - int(h[start])) * int(_POWERS[base].down[start]) % PRIME

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return all(self.span(i, length, k) == other.span(j, length, k) for k in range(len(BASES)))

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """How far the sequences agree from i and j on."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low


def _sketch(h: PrefixHash, start: int, end: int) -> np.ndarray:
    """Least mixed window hash of each class over the windows that start in [start, end)."""
    out = np.full(BINS, _EMPTY, np.uint32)
    if end > start:
        if end - start == h.prefix[0].size - WINDOW:
            values = _mod(_mod(h.prefix[0][WINDOW:] + np.uint64(PRIME) - h.prefix[0][:-WINDOW]) * _POWERS[0].down[: end - start])
        else:
            values = _mod(_mod(h.prefix[0][start + WINDOW : end + WINDOW] + np.uint64(PRIME) - h.prefix[0][start:end]) * _POWERS[0].down[start:end])
        x = values * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum.at(out, (x >> np.uint64(57)).astype(np.intp), (x >> np.uint64(20)).astype(np.uint32))
    return out


def _short(h: PrefixHash) -> np.ndarray:
    """A text shorter than a window is its own only window."""
    out = np.full(BINS, _EMPTY, np.uint32)
    if h.n:
        out[h.whole()[0] % BINS] = h.whole()[1] & 0xFFFFFF00
    return out


def _string(h: PrefixHash, sketch: np.ndarray) -> str:
    a, b = h.whole()
    digits = np.where(sketch == _EMPTY, 0, sketch >> 8 & 0xFF).astype(np.uint8).tobytes().hex()
    used = np.packbits(sketch != _EMPTY).tobytes().hex()
    return f"{h.n:x}-{a:08x}{b:08x}-{used}-{digits}"


def likeness(a: str, b: str) -> float:
    """0 to 1: estimated Jaccard similarity of the texts' windows; 1 for equal fingerprints, also of empty texts."""
    if a == b:
        return 1.0
    (_, _, used_a, digits_a), (_, _, used_b, digits_b) = a.split("-"), b.split("-")
    ua, ub = (np.unpackbits(np.frombuffer(bytes.fromhex(u), np.uint8)).astype(bool) for u in (used_a, used_b))
    da, db = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (digits_a, digits_b))
    either = int((ua | ub).sum())
    if not either:
        return 0.0
    same = int((ua & ub & (da == db)).sum()) / either
    return min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def fingerprint(text: str) -> str:
    return _Text(text).print


class _Text:
    """A text's prefix hash and fingerprint, with the sketch of the windows that an edit of its last quarter leaves."""

    def __init__(self, text: str):
        self.text, self.h = text, PrefixHash(code_points(text))
        last = self.h.n - WINDOW + 1
        self.keep = self.h.n - self.h.n // 4
        self.inside = max(0, min(last, self.keep - WINDOW + 1))
        self.shared = _sketch(self.h, 0, self.inside)
        self.print = _string(self.h, _short(self.h) if last < 1 else np.minimum(self.shared, _sketch(self.h, self.inside, last)))

    def edited(self, following: str) -> tuple[str, str, PrefixHash]:
        """The text with its last quarter replaced by the beginning of following, its fingerprint and prefix hash."""
        put = following[: self.h.n - self.keep]
        h = PrefixHash(code_points(put), self.h, self.keep)
        sketch = _short(h) if h.n < WINDOW else np.minimum(self.shared, _sketch(h, self.inside, h.n - WINDOW + 1))
        return self.text[: self.keep] + put, _string(h, sketch), h


def _row(own: _Text, after: _Text) -> tuple:
    text, print_, h = own.edited(after.text)
    return (
        own.h.n, hashlib.sha256(text.encode()).hexdigest(), own.print, print_, likeness(own.print, print_), likeness(own.print, after.print),
        own.h.common_extension(0, h, 0), own.h.common_extension(0, after.h, 0),
    )


def _cuts(rows: DataFrame, key: list[str], parts: int) -> list[dict]:
    """Keys that cut rows into about `parts` ranges of about as many rows, from a sample of SAMPLED a range, a million at most; they tell
    where rows are handled, not what comes out."""
    n = rows.count()
    found = sorted(tuple(r) for r in rows.select(*key).sample(min(1.0, min(SAMPLED * parts, 1_000_000) / max(n, 1)), 11).collect())
    return [dict(zip(key, k)) for k in sorted({found[len(found) * i // parts] for i in range(1, parts)} if found else ())]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs (doc_id, text), of each text edited with the beginning of the next, and their likeness.

    The next document is that of the next doc_id (rows of one doc_id by a hash of the text, then the text), after the
    last the first; a null doc_id comes first, a null text is empty, an empty text has likeness 1 only to an empty one,
    other columns aren't read, an empty table gives no rows. The texts are shuffled once, to ranges of doc_id, hash
    and number of the row, so that rows of one doc_id, or alike, may be in many ranges; the first document of each range
    goes to the range before it too, so no window spans all rows.
    """
    spark = docs.sparkSession
    python_ready(spark)
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.monotonically_increasing_id().alias("nth"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(lowest).cast("long"))).withColumn("tie", F.xxhash64("text"))
    key = ["ord", "tie", "nth"]
    cuts = _cuts(rows, key, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = F.from_json(F.lit(json.dumps(cuts)), "array<struct<ord:bigint,tie:bigint,nth:bigint>>")
    rows = rows.withColumn("range", leading(bounds, len(cuts), lambda cut: cut <= F.struct(*key)))
    heads = rows.groupBy("range").agg(F.min(F.struct(*key)).alias("head"))
    order = Window.orderBy("range")  # over the ranges
    first = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head.ord", "head.tie", F.coalesce(F.lag("range").over(order), F.max("range").over(first)).alias("also"))
    heads = heads.groupBy("ord", "tie").agg(F.collect_list("also").alias("also"))
    met = rows.join(F.broadcast(heads), ["ord", "tie"])  # as many heads at most as there are ranges
    copies = met.groupBy("ord", "tie").agg(F.min("text").alias("text"), F.first("also").alias("also"))
    copies = copies.select(F.lit(None).cast("long").alias("doc_id"), "text", "ord", "tie", F.explode("also").alias("range"), F.lit(True).alias("copy"))
    both = rows.select("doc_id", "text", "ord", "tie", "range", F.lit(False).alias("copy")).unionByName(copies)
    both = both.repartitionById(len(cuts) + 1, "range").sortWithinPartitions("copy", "ord", "tie", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        done = False
        for batch in batches:
            rows: list[tuple] = []
            for key, text, copy in zip(*(batch[k].to_pylist() for k in ("doc_id", "text", "copy"))):
                if not done:
                    after = held[1] if held and held[1].text == text else _Text(text)
                    if held:
                        rows.append((held[0], *_row(held[1], after)))
                    held, done = (key, after), bool(copy)
            columns = list(zip(*rows)) or [()] * len(FINGERPRINTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FINGERPRINTS)], schema=FINGERPRINTS)

    return both.select("doc_id", "text", "copy").mapInArrow(compare, from_arrow_schema(FINGERPRINTS))
