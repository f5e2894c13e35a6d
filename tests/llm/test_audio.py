import cmath
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import audio


def test_round_trip_and_digests(docs, empty):
    stored = audio.store_audio(docs)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    out = audio.audio_features(stored).withColumn("feature", audio.digest(F.col("segments"))).collect()
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is not None:
            payload, n = audio.padded(texts[r.doc_id])
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert len(payload) % 64 == 0 and payload[:n] == (texts[r.doc_id] or "").encode() and not any(payload[n:])
            found = audio.from_bytes(bytes(r.segments))
            assert len(found) and found.column("tensor").type.shape == [audio.MELS, audio.SLICES]
            assert all(s["start_ms"] < s["end_ms"] for s in found.select(["start_ms", "end_ms"]).to_pylist())
    assert len({r.feature for r in out if r.payload_sha256 == out[0].payload_sha256}) == 1
    assert audio.audio_features(audio.store_audio(empty)).count() == 0


def test_wav_errors():
    assert audio.from_wav(audio.to_wav(b"abc")) == b"abc"
    for bad, why in ((b"", "not a WAV"), (b"RIFF1234WAVEfmt ", "no samples"), (audio.to_wav(b"ab").replace(b"\x08\x00data", b"\x10\x00data"), "8-bit")):
        with pytest.raises(ValueError, match=why):
            audio.from_wav(bad)


def test_resampling_equals_the_plain_sum():
    x = np.random.default_rng(1).normal(size=200).astype(np.float32)
    got = audio.resample(x)
    for n in range(len(got)):
        taps, last = audio._phases()[n * audio.DOWN % audio.UP], n * audio.DOWN // audio.UP
        want = sum(taps[j] * x[last - j] for j in range(audio.TAPS) if 0 <= last - j < len(x))
        assert got[n] == pytest.approx(want, abs=1e-4)


def test_hysteresis():
    energy = np.array([0, 0, 10, 6, 4, 6, 1, 0, 9, 9, 0], float)
    assert audio.segments(energy) == [(2, 6), (8, 10)]
    assert audio.segments(np.ones(5)) == [(0, 5)]


def test_stored_segments_are_tensors_of_a_fixed_shape(spark, tmp_path):
    rng = np.random.default_rng(2)
    media = spark.createDataFrame([(i, bytearray(audio.to_wav(rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes()))) for i, n in enumerate((1, 9, 400))] + [(9, None)], "doc_id long, media binary")
    audio.audio_features(media).write.parquet(f"{tmp_path}/f")
    back = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/f").collect()}
    for r in media.collect():
        if r.media is None:
            assert back[r.doc_id].segments is None and back[r.doc_id].payload_sha256 is None
            continue
        want, got = audio.features(audio.from_wav(bytes(r.media))), audio.from_bytes(bytes(back[r.doc_id].segments))
        assert got.schema.field("tensor").type == audio.tensor_type()
        tensors = got.column("tensor").to_numpy_ndarray()
        assert tensors.shape == (len(want), audio.MELS, audio.SLICES)
        for i, (tensor, start, end) in enumerate(want):
            assert np.array_equal(tensors[i], tensor) and (got["start_ms"][i].as_py(), got["end_ms"][i].as_py()) == (start, end)


def test_log_mel_equals_plain_sums():
    x = np.random.default_rng(3).normal(size=700).astype(np.float32)
    got = audio.log_mel(x)
    padded = np.concatenate((x, np.zeros(-(len(x) - audio.FRAME) % audio.HOP)))
    top, n = audio.RATE * audio.UP / audio.DOWN / 2, audio.FRAME
    to_mel, to_hz = lambda f: 2595 * math.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    marks = [to_hz(to_mel(40) + (to_mel(top) - to_mel(40)) * i / (audio.MELS + 1)) for i in range(audio.MELS + 2)]
    assert len(got) == (len(padded) - n) // audio.HOP + 1
    for i in (0, 1, len(got) - 1):
        frame = [padded[i * audio.HOP + t] * (0.5 - 0.5 * math.cos(2 * math.pi * t / (n - 1))) for t in range(n)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * t / n) for t, v in enumerate(frame))) ** 2 for k in range(n // 2 + 1)]
        for band in (0, 7, audio.MELS - 1):
            low, mid, high = marks[band : band + 3]
            level = 0.0
            for k, p in enumerate(power):
                f = top * k / (n // 2)
                level += p * max(0, min((f - low) / (mid - low), (high - f) / (high - mid)))
            assert got[i, band] == pytest.approx(math.log(level + 1e-6), abs=1e-2)
    assert len(audio.log_mel(np.zeros(3, np.float32))) == 1
