"""Audio features of media columns: polyphase resampling, log-mel filterbanks, energy segments.

Samples are 8-bit PCM in a WAV container, a binary column of a table. Features are computed from what that table
gives back: tensors of a fixed shape (frames x bands), one for each window of time, and kept as a column of Arrow
fixed-shape tensors with the windows' time spans beside them.
"""

from __future__ import annotations

import functools
import hashlib
import io
import math
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from sluice.llm.common import python_ready, text_of, written

RATE, TARGET_RATE = 16_000, 6_000
BLOCK = 576
FRAME, HOP, BANDS, FRAMES = 256, 128, 24, 16
TAPS = 24
FLOOR = -10.0
#: Decades of energy over the quietest tenth of the frames at which a segment begins, and those at which it ends.
RISE, FALL = 0.30, 0.12

MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
TENSOR = pa.fixed_shape_tensor(pa.float16(), [FRAMES, BANDS])
#: What the Arrow stream of a row's features holds: a tensor for each window, and when it begins and ends.
WINDOWS = pa.schema([("tensor", TENSOR), ("start", pa.float64()), ("end", pa.float64())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.int64()), ("windows", pa.binary()), ("segments", pa.list_(pa.list_(pa.float64())))])
DIGEST = pa.schema([*list(FEATURES)[:7], ("feature", pa.string())])


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def store(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def load(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


@functools.cache
def _phases(up: int, down: int) -> np.ndarray:
    """Windowed-sinc low-pass at the lower of both rates, a row of taps for each phase."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cut = min(1 / up, 1 / down)
    h = np.sinc(t * cut) * np.hamming(n)
    h *= up / h.sum()
    return h.reshape(TAPS, up).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase: each output takes only the taps of its phase; no zeros are inserted."""
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return x
    taps = _phases(up, down)
    n = -(-len(x) * up // down)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, (TAPS // 2, TAPS)), TAPS)
    out = np.empty(n, np.float32)
    for k in range(min(up, n)):  # outputs k, k + up, ... have one phase, their windows stand down apart
        phase, first = k * down % up, k * down // up
        out[k::up] = windows[first::down][: len(out[k::up])] @ taps[phase]
    return out


@functools.cache
def _mel(rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, as a matrix of frequency bins by bands."""
    to = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames of half overlap: log10 of the band energies, and of the whole energy. Short input is padded."""
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.pad(x, (0, max(0, (n - 1) * HOP + FRAME - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    frames = (frames - frames.mean(axis=1, keepdims=True)) * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
    return np.log10(power @ _mel(rate) + 1e-10), np.log10((frames**2).sum(axis=1) + 1e-10)


def segments(energy: np.ndarray, rise: float = RISE, fall: float = FALL) -> list[tuple[int, int]]:
    """Frames [start, end) from where the energy passes the upper threshold to where it falls under the lower."""
    quiet = float(np.quantile(energy, 0.1)) if len(energy) else 0.0
    above, under = energy >= quiet + rise, energy < quiet + fall
    state = np.where(above, 1, np.where(under, -1, 0))
    marks = np.flatnonzero(state)
    if not len(marks):
        return []
    last = state[marks[np.maximum.accumulate(np.searchsorted(marks, np.arange(len(state)), side="right") - 1).clip(0)]]
    on = np.concatenate([[0], (last == 1) & (np.arange(len(state)) >= marks[0]), [0]]).astype(np.int8)
    step = np.diff(on)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def features(samples: bytes, rate: int) -> tuple[np.ndarray, int, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors (windows x FRAMES x BANDS, the last filled up with the floor), how many frames they hold, the windows'
    spans and the segments, in seconds."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x, rate, TARGET_RATE), TARGET_RATE)
    n = -(-len(mel) // FRAMES)
    tensors = np.full((n * FRAMES, BANDS), FLOOR, np.float16)
    tensors[: len(mel)] = mel
    hop = HOP / TARGET_RATE
    spans = [(i * FRAMES * hop, (min(len(mel), (i + 1) * FRAMES) - 1) * hop + FRAME / TARGET_RATE) for i in range(n)]
    return tensors.reshape(n, FRAMES, BANDS), len(mel), spans, [(a * hop, (b - 1) * hop + FRAME / TARGET_RATE) for a, b in segments(energy)]


def windows_bytes(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow IPC stream of WINDOWS, a row for each tensor."""
    array = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))
    out = io.BytesIO()
    with pa.ipc.new_stream(out, WINDOWS) as w:
        w.write_batch(pa.RecordBatch.from_arrays([array, pa.array([a for a, _ in spans]), pa.array([b for _, b in spans])], schema=WINDOWS))
    return out.getvalue()


def windows_of(data: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The tensors and their spans."""
    batch = pa.ipc.open_stream(data).read_next_batch()
    return batch["tensor"].to_numpy_ndarray(), list(zip(batch["start"].to_pylist(), batch["end"].to_pylist()))


def digest(tensors: np.ndarray, frames: int, spans: list[tuple[float, float]], parts: list[list[float]]) -> str:
    """Mean band energies in hundredths; number and length in milliseconds of the segments; shape and end of the tensors,
    and a checksum of them in hundredths."""
    flat = tensors.reshape(-1, BANDS).astype(np.float32)
    mean = np.rint(100 * flat[:frames].mean(axis=0)).astype(int)
    check = zlib.crc32(np.rint(100 * flat).astype("<i2").tobytes())
    active = sum(round(1000 * (b - a)) for a, b in parts)
    return f"mel:{','.join(map(str, mean))};segments:{len(parts)};active_ms:{active};tensors:{len(tensors)}x{FRAMES}x{BANDS};end_ms:{round(1000 * spans[-1][1])};crc:{check:08x}"


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (WAV) for each row of docs, written to the shared folder and read again.

    A null text is empty (one block of fill bytes), a null doc_id stays, equal texts give equal values, other columns
    aren't read, an empty table gives no rows. A batch of texts is held at a time; nothing is shuffled.
    """

    def stored(batch: pa.RecordBatch):
        for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            yield key, len(text.encode()), store(payload(text))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return written(_by_batch(rows, stored, MEDIA), "media")


def media_features(media: DataFrame) -> DataFrame:
    """For each row of a media table what its bytes hold, and their features: windows (an Arrow stream of WINDOWS), the
    number of frames and the segments; written to the shared folder and read again."""

    def computed(batch: pa.RecordBatch):
        for key, n, wav in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].to_pylist()):
            samples, rate = load(wav)
            tensors, frames, spans, parts = features(samples, rate)
            stored = len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(wav), hashlib.sha256(wav).hexdigest()
            yield key, n, *stored, frames, windows_bytes(tensors, spans), [list(p) for p in parts]

    return written(_by_batch(media, computed, FEATURES), "media-features")


def media_digest(docs: DataFrame) -> DataFrame:
    """What was stored for each row of docs, from the media table read back, and a digest of its features, from the table
    of tensors read back."""

    def digested(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            tensors, spans = windows_of(r["windows"])
            yield *(r[f.name] for f in list(DIGEST)[:-1]), digest(tensors, r["frames"], spans, r["segments"])

    return _by_batch(media_features(media_table(docs)), digested, DIGEST)


def _by_batch(rows: DataFrame, values, schema: pa.Schema) -> DataFrame:
    """values(batch) gives the rows of a few rows of a batch."""
    python_ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                columns = list(zip(*values(batch.slice(at, 64))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, from_arrow_schema(schema))
