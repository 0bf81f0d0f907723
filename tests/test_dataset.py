"""Values of the blueprint's fixtures, boundaries and odd tables for the operators of a dataset build."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions import text as T
from voxmill.operators import candidates as clips
from voxmill.operators import commit, quality, repair, segments, vectors
from voxmill.ordered import numbered
from voxmill.plans import chunks
from voxmill.presets import PRESETS, preset, preset_table

SIM = "chunk_idx int, speaker string, similarity double"


def verdicts(spark, rows, threshold=0.34, margin=0.06):
    return {r.chunk_idx: (r.speaker, r.verdict) for r in segments.target_speakers(spark.createDataFrame(rows, SIM), ["chunk_idx"], threshold, margin).collect()}


def test_target_speaker_needs_threshold_and_margin(spark):
    rows = [(1, "01", 0.769), (1, "00", 0.637), (2, "00", 0.610), (2, "01", 0.590), (3, "00", 0.780), (4, "00", 0.2), (5, "a", 0.34), (6, "a", 0.75), (6, "b", 0.5), (7, "a", None)]
    got = verdicts(spark, rows)
    assert got == {1: ("01", "target"), 2: ("00", "ambiguous"), 3: ("00", "target"), 4: ("00", "below"), 5: ("a", "target"), 6: ("a", "target")}
    assert verdicts(spark, [(1, "a", 0.75), (1, "b", 0.5)], margin=0.25) == {1: ("a", "target")}
    assert verdicts(spark, []) == {}


SEG = "chunk_idx int, id int, start double, end double"


def test_overlap_counts_stacked_foreigners_and_gaps_are_blocked_beyond_the_limit(spark):
    own = spark.createDataFrame([(0, 1, 0.0, 2.0), (0, 2, 2.2, 4.0), (1, 3, 0.0, 1.0)], SEG)
    foreign = spark.createDataFrame([(0, 8, 0.5, 1.0), (0, 9, 0.5, 1.0), (0, 10, 2.02, 2.18)], SEG)
    assert {r.id: r.overlap for r in segments.foreign_overlap(own, foreign, ["chunk_idx"], "id").collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert [(r.id, r.blocked) for r in segments.foreign_gaps(own, foreign, ["chunk_idx"], "id").collect()] == [(2, True)]
    edge = spark.createDataFrame([(0, 10, 2.0, 2.03125)], SEG)
    wide = spark.createDataFrame([(0, 1, 0.0, 2.0), (0, 2, 4.0, 5.0)], SEG)
    assert [r.blocked for r in segments.foreign_gaps(wide, edge, ["chunk_idx"], "id", 0.03125).collect()] == [False]
    none = foreign.where("false")
    assert segments.foreign_overlap(own, none, ["chunk_idx"], "id").agg(F.sum("overlap")).first()[0] == 0.0
    assert segments.foreign_overlap(none, foreign, ["chunk_idx"], "id").count() == segments.foreign_gaps(none, none, ["chunk_idx"], "id").count() == 0


def test_split_as_the_loop_does(spark):
    def loop(s, e, least, most):
        out = []
        while e - s > most:
            out.append((s, s + most))
            s += most
        return out + ([(s, e)] if e - s >= least else [])

    rows = [(i, 0.0, d / 8) for i, d in enumerate([1, 7, 8, 79, 80, 81, 87, 88, 160, 161, 168, 800])]
    df = spark.createDataFrame(rows, "id int, start double, end double")
    got = sorted((r.id, r.start, r.end) for r in clips.split(df, 1.0, 10.0).collect())
    assert got == sorted((i, *x) for i, s, e in rows for x in loop(s, e, 1.0, 10.0))


def test_merge_equals_a_plain_spec_on_random_segments(spark):
    rng = random.Random(7)
    rows = [(c, s / 8, (s + rng.randint(1, 40)) / 8, rng.choice("ABC"), 0.5) for c in range(6) for s in sorted(rng.sample(range(2000), 60))]
    df = spark.createDataFrame(rows, "chunk_idx int, start double, end double, speaker string, similarity double")
    got = sorted((r.chunk_idx, r.start, r.end) for r in clips.merged_segments(df, ["A"], 2.0, 4.0, 10.0).collect())
    want = []
    for c in range(6):
        own = sorted(r[1:3] for r in rows if r[0] == c and r[3] == "A")
        other = [r[1:3] for r in rows if r[0] == c and r[3] != "A"]
        own = [(s, e) for s, e in own if sum(max(0.0, min(e, b) - max(s, a)) for a, b in other) <= 2.0]
        cur = None
        for s, e in own:
            if cur and s - cur[1] <= 4.0 and e - cur[0] <= 10.0 and not (s > cur[1] and any(min(s, b) - max(cur[1], a) > 0.03 for a, b in other)):
                cur = (cur[0], max(cur[1], e))
            else:
                want += [(c, *cur)] if cur else []
                cur = (s, e)
        want += [(c, *cur)] if cur else []
    assert got == sorted(want) and want


def test_profile_takes_sixty_seconds(spark):
    rows = [("x", float(i), i + 0.9) for i in range(61)] + [("x", 100.0, 130.0), ("y", 0.0, 0.2), ("z", 0.0, 0.5), ("w", 0.0, 61.0), (None, 0.0, 1.0), ("w", None, 3.0), ("w", float("nan"), 3.0)]
    got = segments.profile_take(spark.createDataFrame(rows, "speaker string, start double, end double"), ["speaker"])
    sums = {r.speaker: round(r.t, 6) for r in got.groupBy("speaker").agg(F.sum("take").alias("t")).collect()}
    assert sums == {"x": 60.0, "w": 60.0, None: 1.0}


def test_statistics_of_tones_and_full_scale(spark):
    tone = [int(6000 * math.sin(2 * math.pi * 220 * i / 16000)) for i in range(32000)]
    df = spark.createDataFrame([(1, tone, 16000), (2, [-32768, 32767] * 16000, 16000), (3, [], 16000), (4, None, 16000)], "id int, samples array<int>, rate int")
    got = {r.id: r for r in quality.clip_stats(df).withColumn("reason", quality.verdict(1, 10, -45, 0.01, 0.9)).collect()}
    assert got[1].reason == "" and 1.9 < got[1].duration < 2.1
    assert got[2].peak_dbfs > -0.1 and got[2].rms_dbfs > -0.1 and got[2].clipping_ratio == 1.0
    assert [got[i].reason for i in (3, 4)] == ["empty"] * 2 and tuple(got[3])[3:8] == (0.0, -120.0, -120.0, 1.0, 1.0)


def test_verdict_order_and_limits(spark):
    cols = "duration double, rms_dbfs double, peak_dbfs double, clipping_ratio double, silence_ratio double"
    rows = [(0.5, -90.0, 0.0, 1.0, 1.0), (10.75, -90.0, 0.0, 1.0, 1.0), (10.5, -90.0, 0.0, 1.0, 1.0), (5.0, -40.0, 0.0, 1.0, 1.0), (5.0, -40.0, 0.0, 0.5, 1.0), (1.0, -40.0, 0.0, 0.5, 0.5)]
    got = [r[0] for r in spark.createDataFrame(rows, cols).select(quality.verdict(1.0, 10.0, -40.0, 0.5, 0.5)).collect()]
    assert got == ["too_short", "too_long", "too_quiet", "clipping", "too_much_silence", ""]
    second = spark.createDataFrame([("", 0.43), ("", 0.44), ("clipping", 0.1)], "r string, s double")
    for name, want in (("maximum", ["speaker_low_confidence", "", "clipping"]), ("fast", ["", "", "clipping"])):
        assert [r[0] for r in second.select(quality.second_verification(F.col("r"), F.col("s"), PRESETS[name])).collect()] == want


def test_chunk_and_guard_plans(spark):
    d = spark.createDataFrame([(1, 6867.0), (2, 0.0), (3, -1.0), (4, None), (5, float("nan")), (6, 900.0), (7, 900.005), (8, 900.5)], "id int, duration double")
    got = [r for r in chunks.guard_plan(d, 900, 2).orderBy("id", "index").collect()]
    one = [r for r in got if r.id == 1]
    assert len(one) == 8 and sum(r.core_duration for r in one) == 6867 and (one[0].core_start, one[0].input_start, one[0].core_duration) == (0, 0, 900)
    assert (one[1].input_start, one[1].input_duration, one[1].trim_start) == (898, 904, 2)
    assert [(r.id, r["index"]) for r in got if r.id > 1] == [(6, 0), (7, 0), (8, 0), (8, 1)]
    assert [(r.id, r.chunk_idx) for r in chunks.chunk_plan(d.where("id > 5"), 900).orderBy("id", "chunk_idx").collect()] == [(6, 0), (7, 0), (8, 0), (8, 1)]
    assert chunks.chunk_plan(d.where("false"), 300).count() == 0


def test_device_limits(spark):
    d = spark.createDataFrame([("cuda", 6.0, 600), ("cpu", 24.0, 600), ("cuda", 8.0, 1800), ("cuda", 24.0, 1800), ("cuda", None, 600), (None, 24.0, 600)], "device string, vram double, base int")
    got = d.select(chunks.window_cap(F.col("base"), F.col("device"), F.col("vram")), chunks.model_segment(F.col("device"), F.lit("htdemucs_ft"), F.col("vram"))).collect()
    assert [tuple(r) for r in got] == [(300, 6), (300, None), (600, 7), (1800, None), (300, 6), (300, None)]


def test_vectors(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [0.0, 5.0]), ("b", [0.0, 0.0]), ("c", None)], "k string, v array<float>")
    got = {r.k: (r.n, [round(x, 6) for x in r.centroid]) for r in vectors.centroids(df, "v", 2, ["k"]).collect()}
    c = np.array([0.6, 0.8]) + np.array([0, 1.0])
    assert got == {"a": (2, [round(x, 6) for x in c / np.linalg.norm(c)]), "b": (1, [0.0, 0.0])}
    assert round(df.where("k = 'a'").select(vectors.cosine(F.col("v"), F.array(F.lit(0.0), F.lit(2.0)))).first()[0], 6) == 0.8
    bad = spark.createDataFrame([([0.25, 0.75],), ([],), ([float("nan")],), ([float("inf")],), (None,)], "c array<double>")
    assert [r[0] for r in bad.select(vectors.usable_centroid(F.col("c"))).collect()] == [True, False, False, False, False]


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_text_functions(spark):
    L = F.lit  # noqa: N806
    ms = spark.createDataFrame([(0.0005,), (0.0015,), (0.0025,), (1.2345,)], "x double")
    assert [r[0] for r in ms.select(T.ms_key(F.col("x"))).collect()] == [round(x * 1000) for x in (0.0005, 0.0015, 0.0025, 1.2345)]
    text = " a|b  c\x85\x1cd \n"
    assert one(spark, T.sanitize(L(text))) == " ".join(text.replace("|", " ").split())
    assert [one(spark, T.safe_name(L(x))) for x in ("_a b/ü-1_", "///", "")] == ["a_b_ü-1", "item", "item"]
    assert [one(spark, T.clock(L(x))) for x in (-3.0, 0.5, 1.5, 3599.5, 360_000.0)] == ["00:00:00", "00:00:00", "00:00:02", "01:00:00", "100:00:00"]
    for x, n in ((1.0005, 3), (0.0625, 3), (-0.0, 3), (2.5, 0), (float("nan"), 3)):
        assert one(spark, T.fixed(L(x), n)) == f"{x:.{n}f}"
    assert one(spark, T.fixed(L(None).cast("double"), 3)) is None
    assert [one(spark, T.language_or_null(L(x))) for x in ("\tauto", " en ", "", "AUTO", "de")] == [None, "en", None, None, "de"]
    assert [one(spark, T.truthy(L(x))) for x in ("1", "TRUE", "yes", " 1", "0", "")] == [True, True, True, False, False, False]
    assert one(spark, T.truthy(L(None).cast("string"))) is False
    assert one(spark, T.join_segments(F.array(L(" a "), L("  "), L(None), L("b  c")))) == "a b c"
    assert [one(spark, T.is_memory_error(L(x))) for x in ("CUDA out of memory. Tried", "file not found", None)] == [True, False, False]
    long = "/p/" + "x" * 1_200_000
    assert len(one(spark, T.relative_path(L(long), "/p"))) == 1_200_000 and one(spark, T.relative_path(L("/q/a"), "/p")) is None
    for t in ("", " ", "a", " \u2003a b\x85\n", "\x1c\x1fa", "a" + " " * 300_000 + "b"):
        assert one(spark, T.trim_space(L(t))) == t.strip() and one(spark, T.is_blank(L(t))) == (not t.strip())
    assert one(spark, T.concat_quoted(L("/a/it's"))) == "file '/a/it'\\''s'"


CLIP = "source string, start double, end double, text string, duration double, n int"


def test_commit_once_and_again(spark):
    staged = spark.createDataFrame([("stream.m4a", 1.0, 3.0, "a|b", 2.0, 1), ("stream.m4a", 1.0004, 3.0, "later", 2.0, 2), ("other.m4a", 0.0, 1.0, "", 1.0, 3), (None, 0.0, 1.0, "", 1.0, 4), ("x", None, 1.0, "", 1.0, 5)], CLIP)
    none = spark.createDataFrame([], "file string, text string, source string, start double, end double")
    listing = spark.createDataFrame([("audio/000001.wav",), ("audio/000017.wav",), ("audio/x.wav",)], "path string")
    new, usable = commit.commit(staged, none, listing, ["n"])
    rows = sorted(tuple(r) for r in new.select("file", "text", "source").collect())
    assert rows == [("audio/000018.wav", "a b", "stream.m4a"), ("audio/000019.wav", "", "other.m4a")] and usable.count() == 2
    listed = listing.unionByName(new.select(F.col("file").alias("path")))
    again, usable = commit.commit(staged, new, listed, ["n"])
    assert again.count() == 0 and sorted(r.file for r in usable.collect()) == [r[0] for r in rows]
    lost, usable = commit.commit(staged, new, listing, ["n"])
    assert lost.count() == 0 and usable.count() == 0
    assert commit.next_number(listing.where("false")).first()[0] == 1
    assert one(spark, commit.clip_file(F.lit(12_345_678))) == "audio/12345678.wav"


def test_numbers_over_ranges_are_dense(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.hash("id").alias("h"), "id").repartition(7)
    got = [tuple(r) for r in numbered(df, ["k", "h", "id"], "n", 10).orderBy("n").select("k", "h", "id", "n").collect()]
    assert [r[3] for r in got] == list(range(10, 5010)) and [r[:3] for r in got] == sorted(r[:3] for r in got)
    assert numbered(df.where("false"), ["k"], "n").count() == 0


def test_repair_and_patch(spark):
    rows = spark.createDataFrame([(1, "audio/1.wav", "x"), (2, " .\\AUDIO/1.wav", "y"), (3, "audio/2.wav", "z"), (4, "", "e"), (5, None, "n")], "row_id int, file string, text string")
    listing = spark.createDataFrame([("audio/1.wav",), (None,), ("audio/9.wav",)], "path string")
    assert [r.row_id for r in repair.kept(rows, listing).orderBy("row_id").collect()] == [1, 2]
    assert [r.row_id for r in repair.dropped(rows, listing).orderBy("row_id").collect()] == [3, 4, 5]
    assert tuple(repair.repair_counts([rows, rows], listing).first()) == (1, 2)
    assert tuple(repair.repair_counts([rows.where("false")], listing).first()) == (0, 0)
    up = spark.createDataFrame([("audio/1.wav", "привет | мир"), (None, "lost"), ("audio/2.wav", None)], "file string, text string")
    got = {r.row_id: r.text for r in repair.patched(rows, up).collect()}
    assert got == {1: "привет мир", 2: "привет мир", 3: "", 4: "e", 5: "n"}
    assert {r.text for r in repair.patched(rows, up.where("false")).collect()} == {"x", "y", "z", "e", "n"}
    assert [r.row_id for r in repair.pending_transcripts(rows.withColumn("text", F.when(F.col("row_id") < 3, " "))).orderBy("row_id").collect()] == [1, 2, 3, 4, 5]


def test_totals_and_state(spark):
    t = spark.createDataFrame([("1.5",), ("x",), (None,), ("nan",), ("2",)], "duration string")
    assert tuple(repair.totals(t).first()) == (5, 3.5) and tuple(repair.totals(t.where("false")).first()) == (0, 0.0)
    cols = "fingerprint string, path string, status string, updated_at int"
    s = spark.createDataFrame([("a", "p", "failed", 1), ("a", "p", "done", 2), ("b", "p", "done", 1), ("b", "q", "failed", 2), (None, "p", "done", 1)], cols)
    found = spark.createDataFrame([("a",), ("b",), ("c",)], "fingerprint string")
    assert sorted(r[0] for r in repair.pending_sources(found, s).collect()) == ["b", "c"]
    assert repair.any_done(s).first()[0] is True and repair.any_done(s.where("false")).first()[0] is False
    up = spark.createDataFrame([("b", "q", "done", 3)], cols)
    assert {r.fingerprint: r.status for r in repair.upserted(s, up).collect()} == {"a": "done", "b": "done"}
    counts = lambda n: spark.createDataFrame([(1, n)], "kept int, removed int")
    assert repair.needs_reset(counts(1), s, True, True) and not repair.needs_reset(counts(0), s, True, True)
    assert repair.needs_reset(counts(0), s, False, False) and not repair.needs_reset(counts(1), s.where("false"), True, True)


def test_presets(spark):
    assert [p.diarization_window for p in PRESETS.values()] == [300, 600, 600] and preset("Быстро").name == "fast" and preset().name == "maximum"
    assert preset_table(spark).count() == 3
    with pytest.raises(KeyError):
        preset("none")
