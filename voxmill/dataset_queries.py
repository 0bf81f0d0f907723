"""Queries of a dataset build: plans, segments, quality, commits, repair and state, and their SQL.

The tables hold no audio: events stand for segments, days for chunks and embeddings for speaker vectors and samples; the metadata, the
listing and the state of recordings are tables of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions import text as T
from voxmill.operators import candidates as clips
from voxmill.operators import commit, quality, repair, segments, vectors
from voxmill.plans import chunks
from voxmill.presets import MEDIA_SUFFIXES, PRESETS, preset_table

OVERLAP, GAP, LEAST, MOST = 20.0, 600.0, 20.0, 120.0
WINDOW = 300.0
SPACES = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
SINCE = "2025-07-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | Column) -> Column:
    return F.round(F.col(f"`{c}`") if isinstance(c, str) else c, 6)


# ---- segments of the events table


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, chunk_idx, start, end, speaker, similarity``: events as segments, days as chunks."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    chunk = F.call_function("div", us, F.lit(86_400_000_000))
    start = us / 1e6 - chunk * 86_400
    return table(spark, sf_dir, "events").select(
        "event_id", chunk.alias("chunk_idx"), start.alias("start"), (start + F.col("value")).alias("end"), F.concat(F.lit("S"), F.col("user_id") % 4).alias("speaker"), F.round(0.5 + F.col("event_id") % 50 / 100, 2).alias("similarity")
    )


_SEG = """seg AS (SELECT event_id, epoch_us(ts) // 86400000000 AS chunk_idx, epoch_us(ts) / 1e6 - (epoch_us(ts) // 86400000000) * 86400 AS s,
  epoch_us(ts) / 1e6 - (epoch_us(ts) // 86400000000) * 86400 + value AS e, 'S' || (user_id % 4) AS speaker, round(0.5 + (event_id % 50) / 100.0, 2)::DOUBLE AS sim FROM events),
tgt AS (SELECT * FROM seg WHERE speaker = 'S0'), fgn AS (SELECT * FROM seg WHERE speaker <> 'S0'),
ov AS (SELECT t.event_id, t.chunk_idx, t.s, t.e, t.sim, coalesce((SELECT sum(greatest(0, least(t.e, f.e) - greatest(t.s, f.s))) FROM fgn f WHERE f.chunk_idx = t.chunk_idx AND f.s < t.e AND f.e > t.s), 0) AS overlap FROM tgt t)"""

_MERGE = f"""WITH RECURSIVE {_SEG},
it AS (SELECT *, row_number() OVER (PARTITION BY chunk_idx ORDER BY s, e, sim) AS rn FROM ov WHERE overlap <= {OVERLAP}),
fl AS (SELECT chunk_idx, list({{'s': s, 'e': e}}) AS f FROM fgn GROUP BY 1),
it2 AS (SELECT it.*, coalesce(fl.f, []) AS f FROM it LEFT JOIN fl USING (chunk_idx)),
w AS (SELECT chunk_idx, rn, s AS cs, e AS ce, sim, 1 AS isl FROM it2 WHERE rn = 1
  UNION ALL SELECT n.chunk_idx, n.rn,
    CASE WHEN n.s - w.ce <= {GAP} AND n.e - w.cs <= {MOST} AND NOT (n.s > w.ce AND len(list_filter(n.f, lambda o: least(n.s, o.e) - greatest(w.ce, o.s) > 0.03)) > 0) THEN w.cs ELSE n.s END,
    CASE WHEN n.s - w.ce <= {GAP} AND n.e - w.cs <= {MOST} AND NOT (n.s > w.ce AND len(list_filter(n.f, lambda o: least(n.s, o.e) - greatest(w.ce, o.s) > 0.03)) > 0) THEN greatest(w.ce, n.e) ELSE n.e END,
    CASE WHEN n.s - w.ce <= {GAP} AND n.e - w.cs <= {MOST} AND NOT (n.s > w.ce AND len(list_filter(n.f, lambda o: least(n.s, o.e) - greatest(w.ce, o.s) > 0.03)) > 0) THEN least(w.sim, n.sim) ELSE n.sim END,
    CASE WHEN n.s - w.ce <= {GAP} AND n.e - w.cs <= {MOST} AND NOT (n.s > w.ce AND len(list_filter(n.f, lambda o: least(n.s, o.e) - greatest(w.ce, o.s) > 0.03)) > 0) THEN w.isl ELSE w.isl + 1 END
  FROM w JOIN it2 n ON n.chunk_idx = w.chunk_idx AND n.rn = w.rn + 1),
m AS (SELECT chunk_idx, arg_max(cs, rn) AS cs, arg_max(ce, rn) AS ce, arg_max(sim, rn) AS sim FROM w GROUP BY chunk_idx, isl)"""
_SLICES = f"""sl AS (SELECT m.*, i, greatest(0, ceil((ce - cs) / {MOST})::BIGINT - 1) AS nfull FROM m, range(0, 100) t(i) WHERE i <= greatest(0, ceil((ce - cs) / {MOST})::BIGINT - 1)),
cut AS (SELECT chunk_idx, cs + i * {MOST} AS s, CASE WHEN i < nfull THEN cs + i * {MOST} + {MOST} ELSE ce END AS e, sim, i < nfull AS whole FROM sl)"""


def foreign_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_segments(spark, sf_dir)
    found = segments.foreign_overlap(s.where("speaker = 'S0'"), s.where("speaker <> 'S0'"), ["chunk_idx"], "event_id")
    return found.select("event_id", "chunk_idx", r6("overlap").alias("overlap"))


def gap_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_segments(spark, sf_dir)
    return segments.foreign_gaps(s.where("speaker = 'S0'"), s.where("speaker <> 'S0'"), ["chunk_idx"], "event_id").select("event_id", "chunk_idx", r6("gap_start").alias("gap_start"), r6("gap_end").alias("gap_end"), "blocked")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.merged_segments(event_segments(spark, sf_dir), ["S0"], OVERLAP, GAP, MOST)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("chunk_idx", *[r6(c).alias(c) for c in ("start", "end", "similarity")])


def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_merged(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(clips.clip_candidates(event_segments(spark, sf_dir), ["S0"], OVERLAP, GAP, LEAST, MOST))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of the events table, split by itself."""
    return clips.split(event_segments(spark, sf_dir), LEAST, MOST).select("event_id", r6("start").alias("start"), r6("end").alias("end"))


# ---- diarized segments


def _speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "diarized_segments")
    return d.withColumn("speaker", F.upper(T.trim_space(F.col("speaker")))).where("speaker <> ''")


def duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "diarized_segments").select("segment_id", r6(segments.duration(F.col("start"), F.col("end"))).alias("duration"))


_SPEECH = f"""sp AS (SELECT segment_id, source_id, chunk_idx, upper(regexp_replace(speaker, '^{SPACES}+|{SPACES}+$', '', 'g')) AS speaker, start AS s, "end" AS e,
  CASE WHEN NOT isnan(start) AND NOT isnan("end") THEN greatest(0, "end" - start) END AS d FROM diarized_segments), spk AS (SELECT * FROM sp WHERE speaker <> '')"""


def profile_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _speech(spark, sf_dir).dropDuplicates(["source_id", "chunk_idx", "speaker", "start", "end"])
    taken = segments.profile_take(one, ["source_id", "chunk_idx", "speaker"])
    return taken.select("source_id", "chunk_idx", "speaker", r6("start").alias("start"), r6("end").alias("end"), r6("take").alias("take"))


def speaker_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _speech(spark, sf_dir).where(segments.duration(F.col("start"), F.col("end")).isNotNull())
    g = segments.speech_by_speaker(known, ["source_id", "chunk_idx", "speaker"])
    return g.select("source_id", "chunk_idx", "speaker", "segments", *[r6(c).alias(c) for c in ("seconds", "first", "last")])


def absolute_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "diarized_segments").where("start IS NOT NULL AND NOT isnan(start) AND `end` IS NOT NULL AND NOT isnan(`end`)")
    return segments.at_source_time(s, F.col("chunk_idx") * WINDOW).select("segment_id", r6("start").alias("start"), r6("end").alias("end"))


# ---- vectors


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.centroids(_embeddings(spark, sf_dir).where("label = 0"), "embedding", 64)


def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors.centroids(_embeddings(spark, sf_dir), "embedding", 64, ["label"])
    return c.select("label", "n", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 5))


def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similarity_to(_embeddings(spark, sf_dir), "embedding", _reference(spark, sf_dir)).select("vec_id", F.round("similarity", 5).alias("similarity"))


def _speaker_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = vectors.similarity_to(_embeddings(spark, sf_dir), "embedding", _reference(spark, sf_dir))
    return sim.groupBy((F.col("vec_id") % 20).alias("chunk_idx"), F.col("label").alias("speaker")).agg(F.avg("similarity").alias("similarity"))


def top1_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = segments.target_speakers(_speaker_similarity(spark, sf_dir), ["chunk_idx"], 0.10, 0.06)
    return t.select("chunk_idx", "speaker", F.round("similarity", 5).alias("similarity"), F.round("runner_up", 5).alias("runner_up"), "verdict")


def best_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.best_speaker(_speaker_similarity(spark, sf_dir), ["chunk_idx"])


def target_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as segments of their chunk: those of the target speaker, with the speaker's similarity."""
    t = segments.target_speakers(_speaker_similarity(spark, sf_dir), ["chunk_idx"], 0.10, 0.06)
    own = _embeddings(spark, sf_dir).select("vec_id", (F.col("vec_id") % 20).alias("chunk_idx"), F.col("label").alias("speaker"))
    return segments.of_targets(own, t, ["chunk_idx"]).select("vec_id", "chunk_idx", "speaker", F.round("similarity", 5).alias("similarity"))


_VEC = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
nv AS (SELECT vec_id, label, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS x FROM v),
el AS (SELECT vec_id, label, unnest(x) AS y, generate_subscripts(x, 1) - 1 AS pos FROM nv),
mean AS (SELECT label, pos, avg(y) AS y, count(*) AS n FROM el GROUP BY 1, 2),
cen AS (SELECT label, pos, y / sqrt(sum(y * y) OVER (PARTITION BY label)) AS y, n FROM mean),
sim AS (SELECT el.vec_id, el.label, sum(el.y * cen.y) AS similarity FROM el JOIN cen ON cen.label = 0 AND cen.pos = el.pos GROUP BY 1, 2),
grp AS (SELECT vec_id % 20 AS chunk_idx, label AS speaker, avg(similarity) AS similarity FROM sim GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY chunk_idx ORDER BY similarity DESC, speaker) AS rn, lead(similarity) OVER (PARTITION BY chunk_idx ORDER BY similarity DESC, speaker) AS runner_up FROM grp),
top AS (SELECT chunk_idx, speaker, similarity, runner_up, CASE WHEN similarity < 0.10 THEN 'below' WHEN similarity - runner_up < 0.06 THEN 'ambiguous' ELSE 'target' END AS verdict FROM rk WHERE rn = 1)"""


# ---- quality


def _pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = F.transform("embedding", lambda x: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(x.cast("double") * 100000))).cast("int"))
    return _embeddings(spark, sf_dir).select("vec_id", F.slice(loud, F.lit(1), (8 + F.col("vec_id") % 57).cast("int")).alias("samples"), F.lit(16).alias("rate"))


_STATS = ("duration", "rms_dbfs", "peak_dbfs", "clipping_ratio", "silence_ratio")


def clip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clip_stats(_pcm(spark, sf_dir)).select("vec_id", *[r6(c).alias(c) for c in _STATS])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clip_stats(_pcm(spark, sf_dir)).withColumn("reason", quality.verdict(1.2, 3.0, -8.8, 0.006, 0.02))


def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("vec_id", "reason")


def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reject_summary(_judged(spark, sf_dir)).withColumn("seconds", r6("seconds"))


def clip_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip log judged by the balanced preset; rows whose numbers are null or NaN have none to judge by and are left out."""
    m = table(spark, sf_dir, "metadata_extended")
    known = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in _STATS)
    return m.where(known).select("row_id", quality.preset_verdict(PRESETS["balanced"]).alias("reason"))


def second_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "metadata_extended")
    known = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in (*_STATS, "speaker_similarity"))
    p = PRESETS["maximum"]
    return m.where(known).select("row_id", quality.second_verification(quality.preset_verdict(p), F.col("speaker_similarity"), p).alias("reason"))


def _case(p) -> str:
    return f"""CASE WHEN duration = 0 AND rms_dbfs = -120 THEN 'empty' WHEN duration < {p.min_clip} THEN 'too_short' WHEN duration > {p.max_clip} + 0.5 THEN 'too_long' WHEN rms_dbfs < {p.min_rms_dbfs} THEN 'too_quiet'
        WHEN clipping_ratio > {p.max_clipping_ratio} THEN 'clipping' WHEN silence_ratio > {p.max_silence_ratio} THEN 'too_much_silence' ELSE '' END"""


_PCM = """pcm AS (SELECT vec_id, list_slice(list_transform(embedding, lambda x: greatest(-32768, least(32767, round_even(x::DOUBLE * 100000, 0)))::INT), 1, 8 + vec_id % 57) AS a FROM embeddings),
st AS (SELECT vec_id, len(a) / 16.0 AS duration, 20 * log10(greatest(sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x)) / len(a)), 1) / 32768) AS rms_dbfs,
  20 * log10(greatest(list_max(list_transform(a, lambda x: abs(x))), 1) / 32768) AS peak_dbfs, len(list_filter(a, lambda x: abs(x) >= 32603)) / len(a) AS clipping_ratio, len(list_filter(a, lambda x: abs(x) <= 103)) / len(a) AS silence_ratio FROM pcm),
ju AS (SELECT *, CASE WHEN duration < 1.2 THEN 'too_short' WHEN duration > 3.5 THEN 'too_long' WHEN rms_dbfs < -8.8 THEN 'too_quiet' WHEN clipping_ratio > 0.006 THEN 'clipping' WHEN silence_ratio > 0.02 THEN 'too_much_silence' ELSE '' END AS reason FROM st)"""


# ---- plans


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("duration"))
    return chunks.chunk_plan(o, WINDOW).select("o_orderkey", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), r6("chunk_start").alias("chunk_start"), r6("chunk_end").alias("chunk_end"))


def guard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("duration"))
    names = ("core_start", "core_duration", "input_start", "input_duration", "trim_start")
    return chunks.guard_plan(o, 900.0, 2.0).select("o_orderkey", F.col("index").cast("bigint").alias("index"), *[r6(c).alias(c) for c in names])


def outer_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("o_orderkey") % 2 == 0, "htdemucs_ft").otherwise("htdemucs")
    return table(spark, sf_dir, "orders").select("o_orderkey", chunks.outer_job(model, F.col("o_totalprice") / 100).alias("seconds"))


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    vram = F.when(F.col("l_quantity") % 7 != 0, F.col("l_quantity") / 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", "cuda").otherwise("cpu").alias("device"), vram.alias("vram"), F.when(F.col("l_returnflag") == "N", "htdemucs").otherwise("mdx").alias("model"))


def window_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _devices(spark, sf_dir).withColumn("base", F.lit(300) * (1 + F.col("l_linenumber") % 3))
    return d.select("l_orderkey", "l_linenumber", chunks.window_cap(F.col("base"), F.col("device"), F.col("vram")).cast("bigint").alias("seconds"))


def model_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _devices(spark, sf_dir).select("l_orderkey", "l_linenumber", chunks.model_segment(F.col("device"), F.col("model"), F.col("vram")).cast("bigint").alias("seconds"))


def cache_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "metadata_extended").where("start IS NOT NULL AND `end` IS NOT NULL AND duration IS NOT NULL AND NOT isnan(start) AND NOT isnan(`end`) AND NOT isnan(duration)")
    wanted = F.col("end") - F.col("start")
    return m.select("row_id", *[chunks.still_valid(F.col("duration"), wanted, k).alias(k) for k in ("merged", "core", "final")])


def chunks_without_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the recordings in the state table that have no diarized segment."""
    s = repair.latest_state(table(spark, sf_dir, "source_state")).select(F.col("fingerprint").alias("source_id"), F.col("seconds").alias("duration"))
    plan = chunks.chunk_plan(s, WINDOW).select("source_id", "chunk_idx")
    return chunks.chunks_without_cache(plan, table(spark, sf_dir, "diarized_segments"), ["source_id", "chunk_idx"])


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preset_table(spark).select("name", "speaker_threshold", "speaker_margin", "min_clip", "max_clip", "merge_gap", "max_overlap", "diarization_window")


_DEV = "dev AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'cuda' ELSE 'cpu' END AS device, CASE WHEN l_quantity % 7 <> 0 THEN l_quantity / 4 END AS vram, CASE WHEN l_returnflag = 'N' THEN 'htdemucs' ELSE 'mdx' END AS model FROM lineitem)"
_LATEST = """latest AS (SELECT fingerprint, s.* FROM (SELECT fingerprint, max({'u': updated_at, 'st': status, 'p': path, 'sec': seconds, 'c': clips}) AS s FROM source_state WHERE fingerprint IS NOT NULL GROUP BY 1))"""


# ---- text


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "metadata_extended")


def ms_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _log(spark, sf_dir).where("NOT isnan(start) AND NOT isnan(`end`)")
    return m.select("row_id", T.ms_key(F.col("start")).alias("start_ms"), T.ms_key(F.col("end")).alias("end_ms"))


def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("row_id", T.sanitize(F.col("text")).alias("text"))


def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("row_id", T.safe_name(F.col("source")).alias("name"))


def hms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).where("duration IS NOT NULL AND NOT isnan(duration)").select("row_id", T.clock(F.col("duration") * 100).alias("clock"))


def fixed_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _log(spark, sf_dir).where("start IS NOT NULL AND NOT isnan(start) AND speaker_similarity IS NOT NULL AND NOT isnan(speaker_similarity) AND silence_ratio IS NOT NULL AND NOT isnan(silence_ratio)")
    return m.select("row_id", T.fixed(F.col("start"), 3).alias("start"), T.fixed(F.col("speaker_similarity"), 5).alias("similarity"), T.fixed(F.col("silence_ratio"), 7).alias("silence"))


def sig_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audio_files").select("file_id", T.signature(F.col("path"), F.col("size_bytes")).alias("signature"), T.signature(F.col("path"), F.col("size_bytes"), sep="\n", length=20).alias("centroid_key"))


def rejected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _log(spark, sf_dir).where("source IS NOT NULL AND NOT isnan(start) AND NOT isnan(`end`)")
    return m.select("row_id", quality.rejected_path(F.sha1("source"), F.col("source"), F.col("start"), F.col("end"), F.lit("too_short")).alias("path"))


def asr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).where("text IS NOT NULL").select("row_id", T.join_segments(F.split("text", r"[.!?]")).alias("text"))


def language_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("row_id", T.language_or_null(F.col("lang")).alias("lang"))


def truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get(F.array(*[F.lit(x) for x in ("1", "TRUE", "Yes", "0", " 1", "no", "on", "")]), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.truthy(value).alias("value"))


def memory_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, ": CUDA out of memory.").when(F.col("event_id") % 3 == 1, ": Failed to allocate 2 GiB").otherwise(": file not found"))
    return table(spark, sf_dir, "events").select("event_id", T.is_memory_error(message).alias("value"))


def relative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_state").select("fingerprint", "path", T.relative_path(F.col("path"), "/data/streams").alias("relative"))


def concat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).where("text IS NOT NULL").select("row_id", T.concat_quoted(F.col("text")).alias("line"))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON line of each event, read back."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("file"), F.col("user_id").alias("n"))).alias("line"))
    return e.select("event_id", F.get_json_object("line", "$.file").alias("file"), F.from_json("line", "file string, n bigint")["n"].alias("n"))


def discover_ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxmill.sources.media import is_media

    return table(spark, sf_dir, "source_state").where(is_media(F.col("path"))).select("path").distinct().orderBy(F.lower("path"), "path")


# ---- commits


def _log_order() -> list[str]:
    return ["loaded_at", "row_id"]


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit.first_of_each(commit.with_key(_log(spark, sf_dir)), _log_order()).select("source", "start_ms", "end_ms", "row_id")


def new_vs_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = commit.with_key(_log(spark, sf_dir))
    new = commit.first_of_each(m.where(F.col("loaded_at") >= SINCE), _log_order())
    judged = commit.new_or_known(new, m.where(F.col("loaded_at") < SINCE).where("file IS NOT NULL"))
    return judged.select("row_id", F.col("known_file").isNull().alias("is_new"), "known_file")


def next_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit.next_number(table(spark, sf_dir, "audio_files"))


def clip_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = commit.first_of_each(commit.with_key(_log(spark, sf_dir)), _log_order())
    start = next_index(spark, sf_dir).first()[0]
    return commit.numbered_clips(one.drop("file"), ["source", "start_ms", "end_ms"], start).select("row_id", "file")


_NEXT = rf"""(SELECT coalesce(max(TRY_CAST(nullif(regexp_extract(lower(regexp_replace(regexp_replace(regexp_replace(path, '^{SPACES}+|{SPACES}+$', '', 'g'), '[\\/]+', '/', 'g'), '^(\./)+', '')), '^audio/([0-9]{{1,18}})\.wav$', 1), '') AS BIGINT)), 0) + 1 FROM audio_files)"""
_KEYED = f"""keyed AS (SELECT *, regexp_replace(source, '^{SPACES}+|{SPACES}+$', '', 'g') AS src, round_even(start * 1000, 0)::BIGINT AS start_ms, round_even("end" * 1000, 0)::BIGINT AS end_ms
  FROM metadata_extended WHERE NOT isnan(start) AND NOT isnan("end") AND regexp_replace(source, '^{SPACES}+|{SPACES}+$', '', 'g') <> '')"""


# ---- repair, totals, state


def repair_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.kept(table(spark, sf_dir, "metadata"), _live_files(spark, sf_dir)).select("row_id")


def repair_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.dropped(table(spark, sf_dir, "metadata"), _live_files(spark, sf_dir)).select("row_id")


def _live_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audio_files").where("deleted_at IS NULL")


def repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_counts([table(spark, sf_dir, t) for t in ("metadata", "metadata_extended")], _live_files(spark, sf_dir))


def patch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = _log(spark, sf_dir).where("text IS NOT NULL")
    return repair.patched(table(spark, sf_dir, "metadata"), updates, order=("loaded_at", "row_id")).select("row_id", "text")


def pending_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.pending_transcripts(_log(spark, sf_dir)).select("row_id")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.totals(_log(spark, sf_dir)).withColumn("seconds", F.round("seconds", 3))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run since SINCE: what was done before is skipped, what isn't done has failed; clips that the maximum preset rejects are the rejected."""
    s = repair.latest_state(table(spark, sf_dir, "source_state"))
    outcome = F.when(F.col("status") != "done", "failed").when(F.col("updated_at") < SINCE, "skipped").otherwise("done")
    m = _log(spark, sf_dir)
    known = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in _STATS)
    rejected = m.where(known).where(quality.preset_verdict(PRESETS["maximum"]) != "")
    found = repair.run_summary(s.withColumn("outcome", outcome), m.where(F.col("loaded_at") < SINCE), m, rejected)
    return found.select(*[F.round(c, 3).alias(c) if c.endswith("seconds") else F.col(c) for c in found.columns])


def pending_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "source_state")
    return repair.pending_sources(s.select("fingerprint").where("fingerprint IS NOT NULL").distinct(), s)


def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "source_state")
    return repair.upserted(s.where(F.col("updated_at") < SINCE), s.where(F.col("updated_at") >= SINCE)).select("fingerprint", "status", "path", "updated_at")


def any_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.any_done(table(spark, sf_dir, "source_state"))


_LIVE = rf"live AS (SELECT DISTINCT {{0}} AS k FROM audio_files WHERE deleted_at IS NULL)"
_PATH = lambda c: rf"nullif(regexp_replace(regexp_replace(lower(regexp_replace({c}, '^{SPACES}+|{SPACES}+$', '', 'g')), '[\\/]+', '/', 'g'), '^(\./)+', ''), '')"
_L = _LIVE.replace("{0}", _PATH("path"))
_SAN = lambda c: rf"trim(regexp_replace(replace(coalesce({c}, ''), '|', ' '), '{SPACES}+', ' ', 'g'))"

QUERIES = (
    foreign_overlap, gap_foreign, merge, split, candidates, duration, profile_take, speaker_groups, absolute_time, centroid, cosine, top1_margin, best_speaker, target_segments, clip_stats, quality_verdict, reject_summary,
    clip_verdicts, second_verification, chunk_plan, guard_plan, outer_job, window_cap, model_segment, cache_valid, chunks_without_cache, presets, ms_key, sanitize, safe_name, hms, fixed_decimals, sig_sha1, rejected_paths,
    asr_join, language_setting, truthy, memory_error, relative_path, concat_list, json_fields, discover_ext_filter, dedup_first, new_vs_existing, next_index, clip_number, repair_keep, repair_drop, repair_counts, patch_text,
    pending_transcripts, totals, run_summary, pending_sources, state_upsert, any_done,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def nan_safe(sql: dict[str, str]) -> dict[str, str]:
    """The same SQL without isnan: DuckDB may decide that by a column's statistics, in which NaN has no part."""
    return {name: re.sub(r'isnan\(("?\w+"?)\)', r"(\1::VARCHAR = 'nan')", text) for name, text in sql.items()}


def oracle_sql() -> dict[str, str]:
    return nan_safe(_sql())


def _sql() -> dict[str, str]:
    known = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in _STATS)
    suffixes = ", ".join(f"'{s}'" for s in MEDIA_SUFFIXES)
    mx, ba = PRESETS["maximum"], PRESETS["balanced"]
    rows = ", ".join(f"('{p.name}', {p.speaker_threshold}::DOUBLE, {p.speaker_margin}::DOUBLE, {p.min_clip}::DOUBLE, {p.max_clip}::DOUBLE, {p.merge_gap}::DOUBLE, {p.max_overlap}::DOUBLE, {p.diarization_window}::INT)" for p in PRESETS.values())
    sec = "CASE WHEN duration IS NULL OR isnan(duration) THEN 0 ELSE duration END"
    return {
        "foreign_overlap": f"WITH {_SEG} SELECT event_id, chunk_idx, round(overlap, 6) AS overlap FROM ov",
        "gap_foreign": f"""WITH {_SEG}, g AS (SELECT event_id, chunk_idx, s AS gap_end, max(e) OVER (PARTITION BY chunk_idx ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM tgt)
            SELECT event_id, chunk_idx, round(gap_start, 6) AS gap_start, round(gap_end, 6) AS gap_end, EXISTS (SELECT 1 FROM fgn f WHERE f.chunk_idx = g.chunk_idx AND least(g.gap_end, f.e) - greatest(g.gap_start, f.s) > 0.03) AS blocked FROM g WHERE gap_end > gap_start""",
        "merge": f'{_MERGE} SELECT chunk_idx, round(cs, 6) AS start, round(ce, 6) AS "end", round(sim, 6) AS similarity FROM m',
        "candidates": f'{_MERGE}, {_SLICES} SELECT chunk_idx, round(s, 6) AS start, round(e, 6) AS "end", round(sim, 6) AS similarity FROM cut WHERE whole OR e - s >= {LEAST}',
        "split": f"""WITH {_SEG}, m AS (SELECT event_id, s AS cs, e AS ce, event_id AS chunk_idx, sim FROM seg), {_SLICES}
            SELECT chunk_idx AS event_id, round(s, 6) AS start, round(e, 6) AS "end" FROM cut WHERE whole OR e - s >= {LEAST}""",
        "duration": f"WITH {_SPEECH} SELECT segment_id, round(d, 6) AS duration FROM sp",
        "profile_take": f"""WITH {_SPEECH}, one AS (SELECT DISTINCT source_id, chunk_idx, speaker, s, e, d FROM spk WHERE d >= 0.25),
            p AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY source_id, chunk_idx, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM one),
            t AS (SELECT *, least(d, 60 - prior) AS take FROM p WHERE prior < 60), a AS (SELECT *, sum(take) OVER (PARTITION BY source_id, chunk_idx, speaker) AS total FROM t)
            SELECT source_id, chunk_idx, speaker, round(s, 6) AS start, round(e, 6) AS "end", round(take, 6) AS take FROM a WHERE total >= 1""",
        "speaker_groups": f"WITH {_SPEECH} SELECT source_id, chunk_idx, speaker, count(*) AS segments, round(sum(d), 6) AS seconds, round(min(s), 6) AS first, round(max(e), 6) AS last FROM spk WHERE d IS NOT NULL GROUP BY ALL",
        "absolute_time": 'SELECT segment_id, round(start + chunk_idx * 300.0::DOUBLE, 6) AS start, round("end" + chunk_idx * 300.0::DOUBLE, 6) AS "end" FROM diarized_segments WHERE NOT isnan(start) AND NOT isnan("end")',
        "centroid": f"WITH {_VEC} SELECT label, n, pos::INT AS pos, round(y, 5) AS value FROM cen",
        "cosine": f"WITH {_VEC} SELECT vec_id, round(similarity, 5) AS similarity FROM sim",
        "top1_margin": f"WITH {_VEC} SELECT chunk_idx, speaker, round(similarity, 5) AS similarity, round(runner_up, 5) AS runner_up, verdict FROM top",
        "best_speaker": f"WITH {_VEC} SELECT chunk_idx, speaker FROM top",
        "target_segments": f"WITH {_VEC} SELECT e.vec_id, t.chunk_idx, t.speaker, round(t.similarity, 5) AS similarity FROM embeddings e JOIN top t ON e.vec_id % 20 = t.chunk_idx AND e.label = t.speaker WHERE t.verdict = 'target'",
        "clip_stats": f"WITH {_PCM} SELECT vec_id, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in _STATS)} FROM st",
        "quality_verdict": f"WITH {_PCM} SELECT vec_id, reason FROM ju",
        "reject_summary": f"WITH {_PCM} SELECT reason, count(*) AS clips, round(sum(duration)::DOUBLE, 6) AS seconds FROM ju WHERE reason <> '' GROUP BY 1",
        "clip_verdicts": f"SELECT row_id, {_case(ba)} AS reason FROM metadata_extended WHERE {known}",
        "second_verification": f"""SELECT row_id, CASE WHEN {_case(mx)} = '' AND speaker_similarity < {mx.segment_threshold} THEN 'speaker_low_confidence' ELSE {_case(mx)} END AS reason
            FROM metadata_extended WHERE {known} AND speaker_similarity IS NOT NULL AND NOT isnan(speaker_similarity)""",
        "chunk_plan": """WITH o AS (SELECT o_orderkey, o_totalprice / 100 AS d FROM orders), p AS (SELECT o_orderkey, d, i FROM o, range(0, 100) t(i) WHERE i < greatest(1, ceil(d / 300)))
            SELECT o_orderkey, i AS chunk_idx, round(i * 300.0::DOUBLE, 6) AS chunk_start, round(least(d, (i + 1) * 300), 6) AS chunk_end FROM p WHERE least(d, (i + 1) * 300) - i * 300 > 0.05""",
        "guard_plan": """WITH o AS (SELECT o_orderkey, o_totalprice / 100 AS d FROM orders), p AS (SELECT o_orderkey, d, i, i * 900.0::DOUBLE AS a, least(d, (i + 1) * 900.0::DOUBLE) AS b FROM o, range(0, 100) t(i) WHERE d > 0 AND i < ceil(d / 900))
            SELECT o_orderkey, i AS "index", round(a, 6) AS core_start, round(b - a, 6) AS core_duration, round(greatest(0, a - 2), 6) AS input_start, round(least(d, b + 2) - greatest(0, a - 2), 6) AS input_duration, round(a - greatest(0, a - 2), 6) AS trim_start FROM p WHERE b - a > 0.01""",
        "outer_job": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_totalprice / 100 > 600.5 THEN 600::DOUBLE END ELSE CASE WHEN o_totalprice / 100 > 900.5 THEN 900::DOUBLE END END AS seconds FROM orders",
        "window_cap": f"""WITH {_DEV} SELECT l_orderkey, l_linenumber, CASE WHEN device <> 'cuda' OR vram IS NULL OR vram <= 6.5 THEN least(300 * (1 + l_linenumber % 3), 300) WHEN vram <= 10 THEN least(300 * (1 + l_linenumber % 3), 600) ELSE 300 * (1 + l_linenumber % 3) END::BIGINT AS seconds FROM dev""",
        "model_segment": f"""WITH {_DEV} SELECT l_orderkey, l_linenumber, (CASE WHEN device <> 'cuda' THEN NULL WHEN model = 'htdemucs' THEN CASE WHEN vram IS NULL OR vram <= 6.5 THEN 6 WHEN vram <= 10 THEN 7 END
            ELSE CASE WHEN vram IS NULL THEN 8 WHEN vram <= 4.5 THEN 6 WHEN vram <= 6.5 THEN 8 WHEN vram <= 8.5 THEN 12 END END)::BIGINT AS seconds FROM dev""",
        "cache_valid": """SELECT row_id, coalesce(abs(duration - ("end" - start)) <= 1, false) AS merged, coalesce(abs(duration - ("end" - start)) <= 0.75, false) AS core, coalesce(abs(duration - ("end" - start)) <= 1, false) AS final
            FROM metadata_extended WHERE NOT isnan(start) AND NOT isnan("end") AND NOT isnan(duration)""",
        "chunks_without_cache": f"""WITH {_LATEST}, p AS (SELECT fingerprint AS source_id, i::INT AS chunk_idx, sec FROM latest, range(0, 10000) t(i) WHERE sec IS NOT NULL AND NOT isnan(sec) AND i < greatest(1, ceil(sec / 300)) AND least(sec, (i + 1) * 300) - i * 300 > 0.05)
            SELECT source_id, chunk_idx FROM p WHERE NOT EXISTS (SELECT 1 FROM diarized_segments d WHERE d.source_id = p.source_id AND d.chunk_idx = p.chunk_idx)""",
        "presets": f"SELECT * FROM (VALUES {rows}) t(name, speaker_threshold, speaker_margin, min_clip, max_clip, merge_gap, max_overlap, diarization_window)",
        "ms_key": 'SELECT row_id, round_even(start * 1000, 0)::BIGINT AS start_ms, round_even("end" * 1000, 0)::BIGINT AS end_ms FROM metadata_extended WHERE NOT isnan(start) AND NOT isnan("end")',
        "sanitize": f"SELECT row_id, {_SAN('text')} AS text FROM metadata_extended",
        "safe_name": r"SELECT row_id, coalesce(nullif(regexp_replace(regexp_replace(source, '[^\p{L}\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'item') AS name FROM metadata_extended",
        "hms": "WITH s AS (SELECT row_id, greatest(0, round_even(duration * 100, 0)::BIGINT) AS s FROM metadata_extended WHERE duration IS NOT NULL AND NOT isnan(duration)) SELECT row_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock FROM s",
        "fixed_decimals": "SELECT row_id, printf('%.3f', start) AS start, printf('%.5f', speaker_similarity) AS similarity, printf('%.7f', silence_ratio) AS silence FROM metadata_extended WHERE NOT isnan(start) AND NOT isnan(speaker_similarity) AND NOT isnan(silence_ratio)",
        "sig_sha1": "SELECT file_id, sha1(concat_ws('|', path, size_bytes::VARCHAR))[1:16] AS signature, sha1(concat_ws(chr(10), path, size_bytes::VARCHAR))[1:20] AS centroid_key FROM audio_files",
        "rejected_paths": r"""SELECT row_id, 'rejected/too_short/' || coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(source, '(.)\.[^./]*$', '\1'), '[^\p{L}\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'item')[1:50] || '_' ||
            sha1(concat_ws('|', sha1(source), printf('%.3f', start), printf('%.3f', "end"), 'too_short'))[1:12] || '.wav' AS path FROM metadata_extended WHERE source IS NOT NULL AND NOT isnan(start) AND NOT isnan("end")""",
        "asr_join": f"""SELECT row_id, trim(regexp_replace(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: regexp_replace(x, '^{SPACES}+|{SPACES}+$', '', 'g')), lambda x: x <> ''), ' '), '{SPACES}+', ' ', 'g')) AS text
            FROM metadata_extended WHERE text IS NOT NULL""",
        "language_setting": f"SELECT row_id, CASE WHEN lower(regexp_replace(lang, '^{SPACES}+|{SPACES}+$', '', 'g')) IN ('', 'auto') THEN NULL ELSE regexp_replace(lang, '^{SPACES}+|{SPACES}+$', '', 'g') END AS lang FROM metadata_extended",
        "truthy": "SELECT event_id, event_id % 8 < 3 AS value FROM events",
        "memory_error": "SELECT event_id, event_id % 3 < 2 AS value FROM events",
        "relative_path": "SELECT fingerprint, path, CASE WHEN starts_with(replace(path, chr(92), '/'), '/data/streams/') THEN replace(path, chr(92), '/')[15:] END AS relative FROM source_state",
        "concat_list": "SELECT row_id, 'file ''' || replace(text, '''', '''' || chr(92) || '''''') || '''' AS line FROM metadata_extended WHERE text IS NOT NULL",
        "json_fields": "SELECT event_id, event_type AS file, user_id AS n FROM events",
        "discover_ext_filter": rf"SELECT DISTINCT path FROM source_state WHERE lower(regexp_extract(path, '(\.[^./\\]+)$', 1)) IN ({suffixes})",
        "dedup_first": f"WITH {_KEYED} SELECT src AS source, start_ms, end_ms, arg_min(row_id, {{'l': loaded_at, 'r': row_id}}) AS row_id FROM keyed GROUP BY 1, 2, 3",
        "new_vs_existing": f"""WITH {_KEYED}, n AS (SELECT src, start_ms, end_ms, arg_min(row_id, {{'l': loaded_at, 'r': row_id}}) AS row_id FROM keyed WHERE loaded_at >= '{SINCE}' GROUP BY 1, 2, 3),
            o AS (SELECT src, start_ms, end_ms, max(file) AS f FROM keyed WHERE loaded_at < '{SINCE}' AND file IS NOT NULL GROUP BY 1, 2, 3)
            SELECT row_id, f IS NULL AS is_new, f AS known_file FROM n LEFT JOIN o USING (src, start_ms, end_ms)""",
        "next_index": f"SELECT {_NEXT} AS next_index",
        "clip_number": f"""WITH {_KEYED}, d AS (SELECT src, start_ms, end_ms, arg_min(row_id, {{'l': loaded_at, 'r': row_id}}) AS row_id FROM keyed GROUP BY 1, 2, 3)
            SELECT row_id, printf('audio/%06d.wav', row_number() OVER (ORDER BY src, start_ms, end_ms) - 1 + {_NEXT}) AS file FROM d""",
        "repair_keep": f"WITH {_L} SELECT row_id FROM metadata WHERE {_PATH('file')} IN (SELECT k FROM live WHERE k IS NOT NULL)",
        "repair_drop": f"WITH {_L} SELECT row_id FROM metadata WHERE coalesce({_PATH('file')} NOT IN (SELECT k FROM live WHERE k IS NOT NULL), true)",
        "repair_counts": f"""WITH {_L}, r AS (SELECT DISTINCT coalesce({_PATH('file')}, '') AS k FROM (SELECT file FROM metadata UNION ALL SELECT file FROM metadata_extended))
            SELECT count(*) FILTER (k IN (SELECT k FROM live WHERE k IS NOT NULL)) AS kept, count(*) FILTER (k NOT IN (SELECT k FROM live WHERE k IS NOT NULL)) AS removed FROM r""",
        "patch_text": f"""WITH u AS (SELECT {_PATH('file')} AS k, arg_max(text, {{'l': loaded_at, 'r': row_id}}) AS t FROM metadata_extended WHERE text IS NOT NULL AND {_PATH('file')} IS NOT NULL GROUP BY 1)
            SELECT row_id, CASE WHEN u.k IS NOT NULL THEN {_SAN('u.t')} ELSE m.text END AS text FROM metadata m LEFT JOIN u ON {_PATH('m.file')} = u.k""",
        "pending_transcripts": f"SELECT row_id FROM metadata_extended WHERE coalesce(regexp_replace(text, '^{SPACES}+|{SPACES}+$', '', 'g') = '', true)",
        "totals": f"SELECT count(*) AS clips, round(sum({sec}), 3) AS seconds FROM metadata_extended",
        "run_summary": f"""WITH {_LATEST}, o AS (SELECT *, CASE WHEN st <> 'done' THEN 'failed' WHEN u < '{SINCE}' THEN 'skipped' ELSE 'done' END AS outcome FROM latest),
            rej AS (SELECT duration FROM metadata_extended WHERE {known} AND {_case(mx)} <> '')
            SELECT (SELECT count(*) FROM o) AS source_files, (SELECT count(*) FROM o WHERE outcome = 'skipped') AS skipped_files, (SELECT count(*) FROM o WHERE outcome = 'failed') AS failed_files,
            (SELECT round(coalesce(sum(CASE WHEN sec IS NULL OR isnan(sec) THEN 0 ELSE sec END), 0), 3) FROM o WHERE outcome = 'done') AS source_seconds,
            (SELECT count(*) FROM metadata_extended) - (SELECT count(*) FROM metadata_extended WHERE loaded_at < '{SINCE}') AS accepted_clips,
            (SELECT round((SELECT sum({sec}) FROM metadata_extended) - (SELECT sum({sec}) FROM metadata_extended WHERE loaded_at < '{SINCE}'), 3)) AS accepted_seconds,
            (SELECT count(*) FROM rej) AS rejected_clips, (SELECT round(sum(duration), 3) FROM rej) AS rejected_seconds""",
        "pending_sources": f"WITH {_LATEST} SELECT fingerprint FROM latest WHERE st <> 'done' OR st IS NULL",
        "state_upsert": f"WITH {_LATEST} SELECT fingerprint, st AS status, p AS path, u AS updated_at FROM latest",
        "any_done": "SELECT coalesce(bool_or(status = 'done'), false) AS any_done FROM source_state",
    }
