"""Media columns: lossless 8-bit audio, and features of it as fixed-shape Arrow tensors with time spans.

The stored form is a WAV file of one 8-bit channel. Features come from the stored bytes: polyphase resampling by 2/3,
overlapped log-mel filterbanks, and segments found by hysteresis on the frames' energy; each segment is a tensor of MELS
bands by SLICES time slices, with its first and last millisecond.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, UP, DOWN, TAPS = 12_000, 2, 3, 24
FRAME, HOP, MELS, SLICES, ALIGN = 256, 128, 16, 4, 64
#: Samples at the new rate that are worked on at a time.
BLOCK_FRAMES = 2048


def to_wav(payload: bytes) -> bytes:
    """RIFF file: 8-bit unsigned samples, one channel."""
    pad = len(payload) % 2
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad


def from_wav(media: bytes) -> bytes:
    """The samples of a file that ``to_wav`` made; other files are an error."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt ":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and struct.unpack_from("<HH", media, at + 8) + struct.unpack_from("<H", media, at + 22) != (1, 1, 8):
            raise ValueError("not one channel of 8-bit samples")
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of ALIGN, and their number without."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw)), len(raw)


@cache
def _phases() -> list[np.ndarray]:
    """The low-pass filter of the resampler, one part for each output phase."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(TAPS * UP) * UP / DOWN
    return [(h[p::UP] / h[p::UP].sum()).astype(np.float32) for p in range(UP)]


@cache
def _mel() -> np.ndarray:
    """FFT bins x MELS triangles, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    top = RATE * UP / DOWN / 2
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(top), MELS + 2) / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase: output n is phase (n * DOWN) % UP of the filter over the input that ends at n * DOWN // UP."""
    n = len(x) * UP // DOWN
    out = np.empty(n, np.float32)
    back = np.concatenate((np.zeros(TAPS - 1, np.float32), x))
    spans = np.lib.stride_tricks.sliding_window_view(back, TAPS)
    for first in range(UP):
        start, taps = first * DOWN // UP, _phases()[first * DOWN % UP][::-1]
        count = len(range(first, n, UP))
        out[first::UP] = spans[start::DOWN][:count] @ taps
    return out


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames x MELS, frames overlap by half; at least one frame, blocks bound the memory."""
    x = np.concatenate((x, np.zeros(max(0, FRAME - len(x)) + (-(len(x) - FRAME)) % HOP if len(x) > FRAME else FRAME - len(x), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    parts = []
    for i in range(0, len(frames), BLOCK_FRAMES):
        power = np.abs(np.fft.rfft(frames[i : i + BLOCK_FRAMES] * window, axis=1)) ** 2
        parts.append(np.log(power.astype(np.float32) @ _mel() + np.float32(1e-6)))
    return np.concatenate(parts)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames [a, b) that rise over the high mark and last until they fall under the low one.

    Marks are a quarter and a half of the way from the quietest to the loudest frame; sound of one loudness is one segment."""
    low, high = energy.min(), energy.max()
    if high - low < 1e-3:
        return [(0, len(energy))]
    on, off = low + (high - low) * 0.5, low + (high - low) * 0.25
    # Each frame's state is that of the last frame before it that was over the high or under the low mark.
    known = np.where(energy >= on, 1, np.where(energy < off, 0, -1))
    last = np.maximum.accumulate(np.where(known >= 0, np.arange(len(known)), -1))
    state = np.where(last >= 0, known[np.maximum(last, 0)], 0)
    change = np.flatnonzero(np.diff(np.concatenate(([0], state, [0]))))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def features(samples: bytes) -> list[tuple[np.ndarray, float, float]]:
    """(tensor of MELS x SLICES, start in ms, end in ms) of each segment."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x))
    ms, out = 1000 * HOP / (RATE * UP / DOWN), []
    for a, b in segments(mel.mean(axis=1)):
        cuts = [a + (b - a) * i // SLICES for i in range(SLICES + 1)]
        slices = [mel[min(c, b - 1) : max(d, min(c, b - 1) + 1)].mean(axis=0) for c, d in zip(cuts, cuts[1:], strict=False)]
        out.append((np.stack(slices, axis=1), a * ms, b * ms))
    return out


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (MELS, SLICES), dim_names=("mel", "time"))


@cache
def segment_schema() -> pa.Schema:
    return pa.schema([("tensor", tensor_type()), ("start_ms", pa.float64()), ("end_ms", pa.float64())])


def as_segments(found: list[tuple[np.ndarray, float, float]]) -> pa.RecordBatch:
    """Segments as one batch: a fixed-shape tensor array, and the first and last millisecond of each."""
    flat = pa.array(np.concatenate([t.ravel() for t, _, _ in found]) if found else np.empty(0, np.float32), pa.float32())
    tensors = pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(flat, MELS * SLICES))
    return pa.RecordBatch.from_arrays([tensors, pa.array([a for _, a, _ in found], pa.float64()), pa.array([b for _, _, b in found], pa.float64())], schema=segment_schema())


def to_bytes(segments_: pa.RecordBatch) -> bytes:
    """An Arrow IPC stream, which a binary column can hold."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, segments_.schema) as out:
        out.write_batch(segments_)
    return sink.getvalue().to_pybytes()


def from_bytes(stored: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(stored) as stream:
        return stream.read_next_batch()


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, media (WAV) of every row.

    Edge cases: a null or empty text is stored by zeros alone; a very long one is one file. Null ids and repeated rows stay; an empty
    table gives no rows; other columns are not read."""

    @F.pandas_udf("media binary, n_bytes long")
    def store(texts):
        both = [padded(t) for t in texts]
        return pd.DataFrame({"media": [to_wav(p) for p, _ in both], "n_bytes": [n for _, n in both]})

    return docs.select(F.col(id_col), store(F.col(text_col)).alias("stored")).select(id_col, "stored.n_bytes", "stored.media")


RESULT = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "segments": pa.binary()}


def audio_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col``, n_bytes (if there), payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, segments of every row.

    ``segments`` are the bytes of an Arrow stream (``from_bytes``): fixed-shape tensors of MELS x SLICES with their time spans. All is
    computed from the stored bytes, each row for itself, so equal media have equal values.

    Edge cases: a null medium gives nulls; bytes of another format are an error. Null ids and repeated rows stay; an empty
    table gives no rows; other columns are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column("media"):
                if not value.is_valid:
                    rows.append((None,) * len(RESULT))
                    continue
                stored = value.as_py()
                samples = from_wav(stored)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ALIGN:]), len(stored), hashlib.sha256(stored).hexdigest(), to_bytes(as_segments(features(samples)))))
            carried = [n for n in batch.schema.names if n != "media"]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(RESULT.values())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), *made], [*carried, *RESULT])

    rest = [c for c in media.columns if c in (id_col, "n_bytes")]
    kinds = dict(media.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"{c} {({pa.int64(): 'long', pa.string(): 'string', pa.binary(): 'binary'})[k]}" for c, k in RESULT.items()])
    return media.select(*rest, F.col(media_col).alias("media")).mapInArrow(read, schema)


def digest(segments_: Column) -> Column:
    """Readable digest of stored segments: their number and milliseconds, span and level of the first, and a hash of all values
    rounded to three places. Null for null."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([None if stored is None else describe(from_bytes(stored)) for stored in column], dtype="object")

    return of(segments_)


def describe(found: pa.RecordBatch) -> str:
    tensors = found.column("tensor").to_numpy_ndarray()
    spans = np.stack([found.column(c).to_numpy() for c in ("start_ms", "end_ms")], axis=1)
    values = np.round(tensors.astype(np.float64), 3) + 0.0  # no negative zero
    whole = hashlib.md5(values.astype("<f8").tobytes() + np.round(spans, 1).astype("<f8").tobytes()).hexdigest()
    first = f"{spans[0, 0]:.1f}:{spans[0, 1]:.1f}:{values[0].mean():.2f}" if len(spans) else ""
    return f"segments={len(spans)};ms={(spans[:, 1] - spans[:, 0]).sum():.1f};first={first};{whole}"
