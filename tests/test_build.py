"""A whole build with a provider that hears tones: a low one is the reference voice, a high one is someone else."""

import math
import wave

import numpy as np
import pytest

from voxmill import build
from voxmill.sources import dataset

RATE = 8000


def write(path, parts):
    """Parts are ``(hertz, seconds)``; 0 Hz is silence."""
    a = np.concatenate([[6000 * math.sin(2 * math.pi * hz * i / RATE) for i in range(int(s * RATE))] for hz, s in parts])
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(np.rint(a).astype("<i2").tobytes())


def provider():
    # a local class travels to the workers by value
    class Tones:
        def _pitches(self, path):
            with wave.open(path, "rb") as w:
                rate, a = w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(float)
            step = rate // 4
            out = []
            for i in range(0, len(a) - step + 1, step):
                b = a[i : i + step]
                out.append((i / rate, (i + step) / rate, 0 if np.abs(b).max() < 50 else int(np.abs(np.fft.rfft(b)).argmax() * rate / step)))
            return out

        def diarize(self, path):
            merged = []
            for s, e, hz in self._pitches(path):
                if merged and merged[-1][2] == hz:
                    merged[-1][1] = e
                else:
                    merged.append([s, e, hz])
            return [(s, e, f"SPEAKER_{hz:04d}") for s, e, hz in merged if hz]

        def encode(self, path):
            hz = [h for *_, h in self._pitches(path) if h]
            low = sum(h < 400 for h in hz) / max(1, len(hz))
            return [low, 1 - low, 0.0]

        def separate(self, path):
            return path

        def transcribe(self, path, language):
            return [" said ", f"in {language}"]

    return Tones()


@pytest.fixture
def folders(tmp_path):
    for d in ("rec", "ref"):
        (tmp_path / d).mkdir()
    write(tmp_path / "ref" / "me.wav", [(220, 3)])
    write(tmp_path / "rec" / "a.wav", [(220, 4), (0, 2), (880, 3), (0, 1), (220, 3), (0, 1), (220, 0.5)])
    write(tmp_path / "rec" / "b.wav", [(880, 5)])
    (tmp_path / "rec" / "c.wav").write_bytes(b"broken")
    return tmp_path


def test_build_then_continue(spark, folders):
    run = lambda **k: build.build_dataset(spark, str(folders / "rec"), str(folders / "ref"), str(folders / "out"), provider(), "balanced", language="en", **k)
    first = run()
    assert (first["source_files"], first["skipped_files"], first["failed_files"], first["accepted_clips"]) == (3, 0, 1, 2)
    assert abs(first["accepted_seconds"] - 7) < 0.01
    log = {r.file: r for r in build._log(spark, build.Project(str(folders / "out"))).collect()}
    assert sorted(log) == ["audio/000001.wav", "audio/000002.wav"] and {(r.start, r.end, r.text, r.source) for r in log.values()} == {(0.0, 4.0, "said in en", "a.wav"), (10.0, 13.0, "said in en", "a.wav")}
    assert all((folders / "out" / f).exists() for f in log)
    state = {r.path[-5:]: (r.status, r.clips) for r in dataset.read_state(spark, str(folders / "out" / "state.json")).collect()}
    assert state == {"a.wav": ("done", 2), "b.wav": ("done", 0), "c.wav": ("failed", None)}
    assert build.statistics(str(folders / "out"))["dataset_total"]["clips"] == 2 and "2 clips, 00:00:07" in (folders / "out" / "dataset_report.txt").read_text()

    # nothing is done twice; a clip that is gone is made again
    again = run()
    assert (again["skipped_files"], again["failed_files"], again["accepted_clips"]) == (2, 1, 0)
    (folders / "out" / "audio" / "000002.wav").unlink()
    healed = run()
    assert (healed["skipped_files"], healed["accepted_clips"]) == (0, 1)
    assert sorted(r.file for r in build._log(spark, build.Project(str(folders / "out"))).collect()) == ["audio/000001.wav", "audio/000002.wav"]
    build.export_logs(spark, str(folders / "out"))
    assert dataset.read_metadata(spark, str(folders / "out" / "metadata")).count() == 2

    with pytest.raises(ValueError):
        build.build_dataset(spark, str(folders / "rec"), str(folders / "ref"), str(folders / "out"), provider(), "fast")
    (folders / "none").mkdir()
    with pytest.raises(ValueError):
        build.build_dataset(spark, str(folders / "none"), str(folders / "ref"), str(folders / "out2"), provider())
