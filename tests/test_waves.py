"""Wave files in chunks against whole files; what can't be read is a row."""

import wave
from collections import defaultdict

import numpy as np

from turnwise.sources import waves as V


def put(path, x, rate, width, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        full = np.repeat(x[:, None], channels, 1).ravel()
        if width == 1:
            raw = (np.rint(full * 127) + 128).astype(np.uint8).tobytes()
        elif width == 3:
            raw = b"".join(int(v).to_bytes(3, "little", signed=True) for v in np.rint(full * (2**23 - 1)))
        else:
            raw = np.rint(full * (2 ** (8 * width - 1) - 1)).astype(f"<i{width}").tobytes()
        w.writeframes(raw)


def read(spark, folder, **options):
    parts = defaultdict(list)
    for r in V.audio_chunks(spark, str(folder), **options).collect():
        parts[r.call_id].append(r)
    return {c: np.concatenate([p.samples for p in sorted(ps, key=lambda p: p.first)]) for c, ps in parts.items() if ps[0].problem is None}


def test_chunks_make_the_whole(spark, tmp_path):
    rates = {"a": (16000, 2, 1), "b": (44100, 2, 2), "c": (8000, 1, 1), "d": (48000, 3, 2), "e": (22050, 4, 1)}
    tone = {}
    for name, (rate, width, channels) in rates.items():
        t = np.arange(int(rate * 1.5)) / rate
        tone[name] = 0.6 * np.sin(2 * np.pi * 300 * t) + 0.2 * np.sin(2 * np.pi * 1100 * t)
        put(tmp_path / f"{name}.wav", tone[name], rate, width, channels)
    whole = read(spark, tmp_path)
    cut = read(spark, tmp_path, partBytes=5001, chunkFrames=777)
    assert set(whole) == set(rates)
    for name in rates:
        assert len(whole[name]) == 24000 and np.array_equal(whole[name], cut[name])
        t = np.arange(24000) / 16000
        ideal = 0.6 * np.sin(2 * np.pi * 300 * t) + 0.2 * np.sin(2 * np.pi * 1100 * t)
        assert np.abs(whole[name] - ideal)[100:-100].max() < (0.02 if rates[name][1] == 1 else 0.005)


def test_bad_files_are_rows(spark, tmp_path):
    put(tmp_path / "good.wav", np.full(100, 0.5), 16000, 2)
    put(tmp_path / "silent.wav", np.zeros(100), 16000, 2)
    put(tmp_path / "none.wav", np.zeros(0), 16000, 2)
    (tmp_path / "short.wav").write_bytes((tmp_path / "good.wav").read_bytes()[:-20])
    (tmp_path / "text.wav").write_text("no wave file at all")
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "other.txt").write_text("left out")
    (tmp_path / "untold.wav").write_bytes((tmp_path / "good.wav").read_bytes()[:36])
    got = {r.call_id: r.problem for r in V.audio_problems(V.audio_chunks(spark, str(tmp_path))).collect()}
    assert got == {
        "silent": "The audio track is completely silent.", "none": "No audio frames could be decoded from this file.", "short": "The file is cut short.", "text": "Could not open the file: it is no wave file.",
        "empty": "Could not open the file: it is no wave file.", "untold": "This file has no audio track.",
    }


def test_media_beside(spark):
    files = spark.createDataFrame([(p,) for p in ("/x/a.MP4", "/x/a.wav", "/x/b.json", "/x/b.m4a", "/x/c.json", "/x.y/d")], "path string")
    assert {(r.stem, r.path) for r in V.media_beside(files, ["wav", "m4a", "mp4"]).collect()} == {("/x/a", "/x/a.wav"), ("/x/b", "/x/b.m4a")}
