"""Segment and wave files."""

import json
import wave

from turnwise.sources import files


def test_segment_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"start": 0.0, "end": 1.5, "speaker": "A", "text": "hi", "extra": 1}, {"start": 2.0, "end": 3.0, "speaker": "B", "text": None, "words": [{"word": "x", "start": 2.0}]}]))
    (tmp_path / "b.json").write_text('{"not": "a list"}')
    rows = sorted((r.call_id, r.seg_idx, r.speaker, r.end_s) for r in files.segment_files(spark, str(tmp_path / "*.json")).where("speaker is not null").collect())
    assert rows == [("a", 0, "A", 1.5), ("a", 1, "B", 3.0)]
    meta = files.call_meta(files.segment_files(spark, str(tmp_path / "a.json"))).first()
    assert (meta.media_seconds, meta.speakers, meta.segments) == (3.0, 2, 2)
    files.write_csv(files.flat(files.segment_files(spark, str(tmp_path / "a.json"))), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_wave_files(spark, tmp_path):
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(100)
        w.writeframes(b"\x00\x40\x00\xc0" * 150)
    (tmp_path / "bad.wav").write_bytes(b"not sound")
    rows = files.wave_files(spark, str(tmp_path), piece_seconds=1.0).orderBy("piece").collect()
    assert [(r.call_id, r.piece, r.rate, len(r.samples), set(r.samples)) for r in rows] == [("x", 0, 100, 100, {0.0}), ("x", 1, 100, 50, {0.0})]
