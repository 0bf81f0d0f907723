"""Files of a dataset, recordings, models and the stream of commits."""

import hashlib
import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill import models
from voxmill.presets import ALGORITHM_VERSION
from voxmill.sources import dataset, media
from voxmill.sources import wave as pcm
from voxmill.streaming import commits

NUMBERS = (1.0, 3.0625, 2.0, 0.8, -20.0, -3.0, 0.0, 0.1)


@pytest.fixture
def clips(spark):
    rows = [("audio/000001.wav", "привет мир", "a.m4a", *NUMBERS), ("audio/000002.wav", "", "b.m4a", *NUMBERS), ("audio/000003.wav", 'say "no"', "c.m4a", *NUMBERS)]
    return spark.createDataFrame(rows, "file string, text string, source string, start double, end double, duration double, speaker_similarity double, rms_dbfs double, peak_dbfs double, clipping_ratio double, silence_ratio double").coalesce(1)


def content(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))


def test_logs_written_and_read_back(spark, clips, tmp_path):
    want = [tuple(r) for r in clips.collect()]
    for name, write, read in (("m", dataset.write_metadata, dataset.read_metadata), ("e", dataset.write_extended, dataset.read_extended), ("j", dataset.write_jsonl, dataset.read_jsonl)):
        write(clips, str(tmp_path / name))
        back = sorted(tuple(r) for r in read(spark, str(tmp_path / name)).collect())
        width = 2 if name == "m" else 11
        assert [b[1] if name != "m" else b[1] for b in back] == [w[1] for w in want] and all(len(b) >= width for b in back)
    assert content(tmp_path / "m") == 'audio/000001.wav|привет мир\r\naudio/000002.wav|\r\naudio/000003.wav|"say ""no"""\r\n'.encode()
    assert b"1.000|3.062|2.000|0.80000|-20.000|-3.000|0.0000000|0.1000000\r\n" in content(tmp_path / "e")
    assert json.loads(content(tmp_path / "j").splitlines()[0])["text"] == "привет мир"


def test_broken_logs(spark, tmp_path):
    (tmp_path / "m.csv").write_text("\nonly.wav\na.wav|x\n")
    assert sorted(tuple(r) for r in dataset.read_metadata(spark, str(tmp_path / "m.csv")).collect()) == [("a.wav", "x"), ("only.wav", "")]
    (tmp_path / "e.csv").write_text("file|text|source|start|end|duration|speaker_similarity|rms_dbfs|peak_dbfs|clipping_ratio|silence_ratio\na.wav|t|s|x|2|1|1|1|1|1|1\n")
    row = dataset.read_extended(spark, str(tmp_path / "e.csv")).first()
    assert row.start is None and row.end == 2.0
    (tmp_path / "x.jsonl").write_text('{"file":"a.wav","text":""}\nnot json\n\n{"file":"b.wav","text":"t"}\n')
    lines = dataset.read_jsonl(spark, str(tmp_path / "x.jsonl"))
    assert sorted((r.file or "", r.broken) for r in lines.collect()) == [("", True), ("a.wav", False), ("b.wav", False)]
    up = spark.createDataFrame([("a.wav", "new")], "file string, text string")
    out = {r.value for r in dataset.patched_jsonl(lines, up).collect()}
    assert "not json" in out and {json.loads(x).get("text") for x in out if x != "not json"} == {"new", "t"}


def test_state_settings_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "state.json")
    assert dataset.read_state(spark, path).count() == 0
    (tmp_path / "state.json").write_text("{broken")
    assert dataset.read_state(spark, path).count() == 0
    s = spark.createDataFrame([("f", "/a", "done", 2, 3.5, None)], "fingerprint string, path string, status string, clips bigint, seconds double, error string")
    dataset.write_state(s, path)
    assert [tuple(r) for r in dataset.read_state(spark, path).collect()] == [("f", "/a", "done", 2, 3.5, None)]
    settings = str(tmp_path / "settings.json")
    dataset.write_settings(settings, {"quality": "fast", "output_sample_rate": 48000, "hf_token": "secret"}, ALGORITHM_VERSION)
    assert "secret" not in open(settings).read()
    dataset.check_project(settings, True, "fast", 48000, ALGORITHM_VERSION)
    for args in (("maximum", 48000, ALGORITHM_VERSION), ("fast", 44100, ALGORITHM_VERSION), ("fast", 48000, ALGORITHM_VERSION + 1)):
        with pytest.raises(ValueError):
            dataset.check_project(settings, True, *args)
        dataset.check_project(settings, False, *args)
    root = str(tmp_path / "snap")
    assert dataset.current_snapshot(root) is None
    first = dataset.replace_snapshot(root, lambda f: s.write.parquet(f))
    with pytest.raises(ZeroDivisionError):
        dataset.replace_snapshot(root, lambda f: 1 / 0)
    assert dataset.current_snapshot(root) == first
    assert spark.read.parquet(dataset.replace_snapshot(root, lambda f: s.write.parquet(f))).count() == 1


def tone(path, seconds=2.0, rate=16000, width=2, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        n = int(seconds * rate)
        w.writeframes(np.repeat(np.array([int(6000 * math.sin(i / 11)) for i in range(n)], "<i2"), channels).tobytes() if width == 2 else bytes(n * channels * width))


def test_waves(spark, tmp_path):
    tone(tmp_path / "a.wav")
    tone(tmp_path / "b.WAV", 0.5, channels=2)
    tone(tmp_path / "c.wav", 0.1, width=1)
    tone(tmp_path / "d.wav", 0.0)
    (tmp_path / "e.mp3").write_bytes(b"x")
    pcm.register(spark)
    rows = spark.read.format("pcm16").option("block", 10_000).load(str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path[-5:], []).append(r)
    assert [len(by[k]) for k in ("a.wav", "b.WAV", "c.wav", "d.wav")] == [4, 1, 1, 1]
    assert sum(len(r.samples) for r in by["a.wav"]) == 32000 and len(by["b.WAV"][0].samples) == 16000 and by["c.wav"][0].samples is None and by["d.wav"][0].samples == []
    found = media.discover(spark, str(tmp_path))
    assert [r.path[-5:] for r in found.collect()] == ["a.wav", "b.WAV", "c.wav", "d.wav", "e.mp3"]
    assert {r.path[-5:]: r.seconds for r in pcm.durations(found).collect()} == {"a.wav": 2.0, "b.WAV": 0.5, "c.wav": 0.1, "d.wav": 0.0, "e.mp3": None}
    assert pcm.waveform(by["b.WAV"][0].samples, 2).shape == (2, 8000)
    with pytest.raises(ValueError):
        pcm.waveform([], 1)
    cuts = spark.createDataFrame([(str(tmp_path / "a.wav"), str(tmp_path / "out" / "1.wav"), 0.5, 1.5), (str(tmp_path / "b.WAV"), str(tmp_path / "out" / "2.wav"), 0.1, 0.1)], "source string, target string, start double, end double")
    assert sorted(r.seconds for r in pcm.cut_all(cuts).collect()) == [0.01, 1.0]
    assert pcm.cut(str(tmp_path / "a.wav"), str(tmp_path / "out" / "3.wav"), 0.0, 1.0, 48000) == 1.0
    parts = spark.createDataFrame([("r", 1, [3, 4]), ("r", 0, [1, 2])], "id string, i int, samples array<int>")
    assert pcm.joined(parts, ["id"], "i").first().samples == [1, 2, 3, 4]


def test_fingerprint_survives_a_new_name(spark, tmp_path):
    for size in (10, 3 << 20):
        data = b"x" * size + b"tail"
        (tmp_path / "a.wav").write_bytes(data)
        first = media.fingerprint(str(tmp_path / "a.wav"))
        (tmp_path / "a.wav").rename(tmp_path / "b.mkv")
        assert media.fingerprint(str(tmp_path / "b.mkv")) == first
        ends = data[: 1 << 20] + (data[-(1 << 20) :] if len(data) > 1 << 20 else b"")
        assert first == hashlib.sha1(str(len(data)).encode() + ends).hexdigest()
    assert media.fingerprints(media.discover(spark, str(tmp_path))).first().fingerprint == first


def test_models_by_a_fake_provider(spark):
    class Fake:
        def diarize(self, path):
            return [(2.0, 3.0, "B"), (0.0, 1.0, "A")]

        def encode(self, path):
            return [3.0, 4.0]

        def separate(self, path):
            return path + ".vocals"

        def transcribe(self, path, language):
            return [" hello ", "", f"{language} world"]

    chunks = spark.createDataFrame([("s", 0, "/x")], "source_id string, chunk_idx int, path string")
    assert [(r.start, r.speaker) for r in models.diarized(chunks, Fake()).collect()] == [(0.0, "A"), (2.0, "B")]
    assert [round(x, 3) for x in models.encoded(chunks, Fake()).first().embedding] == [0.6, 0.8]
    assert models.separated(chunks, Fake()).first().vocals == "/x.vocals"
    files = spark.createDataFrame([("a", "/x")], "file string, path string")
    assert models.transcribed(files, Fake(), "en").first().text == "hello en world"
    with pytest.raises(RuntimeError):
        models.NoModels().diarize("/x")

    class Full(Fake):
        def encode(self, path):
            raise RuntimeError("CUDA out of memory. Tried to allocate" if path == "/big" else "file not found")

    assert models.Fallback(Full(), Fake()).encode("/big") == [3.0, 4.0] and models.Fallback(Full(), Fake()).separate("/x") == "/x.vocals"
    with pytest.raises(RuntimeError, match="file not found"):
        models.Fallback(Full(), Fake()).encode("/x")


def test_doctor_names_what_is_there():
    from voxmill import doctor

    found = doctor.capabilities()
    assert found["pyspark"] and set(doctor.MODULES) <= set(found)
    assert "python" in doctor.report()


def test_a_restarted_stream_commits_each_clip_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    cols = "source string, start double, end double, text string, n int"
    put = lambda rows, i: spark.createDataFrame(rows, cols).coalesce(1).write.parquet(str(source / f"b{i}"))
    put([("a", 0.0, 1.0, "x", 1), ("a", 0.0, 1.0, "y", 2), ("b", 0.0, 1.0, "z", 3)], 1)
    stream = lambda: spark.readStream.schema(cols).option("recursiveFileLookup", "true").parquet(str(source))
    commits.commit_stream(stream(), out, str(tmp_path / "cp"), ["n"]).awaitTermination()
    put([("a", 0.0002, 1.0, "again", 4), ("c", 0.0, 1.0, "w", 5)], 2)
    commits.commit_stream(stream(), out, str(tmp_path / "cp"), ["n"]).awaitTermination()
    # a checkpoint that is lost: everything comes again, nothing is committed twice
    got = sorted(tuple(r) for r in commits.committed(spark, out).select("file", "source", "text").collect())
    assert got == [("audio/000001.wav", "a", "x"), ("audio/000002.wav", "b", "z"), ("audio/000003.wav", "c", "w")]
    assert commits.committed(spark, str(tmp_path / "nothing")) is None
