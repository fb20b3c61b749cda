"""Driver queries over the transcript operators, and their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import audio, segments, settings, text, vectors
from ..operators import alignment, chunks, interval, likeness, matching, nearest, progress, speakers
from ..sources import readers, writers
from .timeline import CHUNK_SECONDS, LATER, LOST, OVERLAP_SECONDS, PACE, WINDOW_SECONDS, heard_again, pairs, spread, table, timeline, windows
from .timeline import chunks as timeline_chunks

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# SQL parts -----------------------------------------------------------------

#: Letters of the tables' languages beyond ASCII, each to a sign that normalised text can't hold: DuckDB's edit distance counts bytes.
_WIDE = "àâäáãåæçèéêëìíîïñòóôöõøùúûüýÿßœ"
_NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[\s\v\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _strip(x: str) -> str:
    space = r"[\s\v\x1c-\x1f\x85\p{Z}]+"
    return f"regexp_replace({x}, '^{space}|{space}$', '', 'g')"


def _lev(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, '{_WIDE}', '{_NARROW}'), translate({b}, '{_WIDE}', '{_NARROW}'))"


def _sim(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - {_lev(a, b)}::DOUBLE / greatest(length({a}), length({b}))) END"


_SEG = f"""seg AS (
  SELECT conv_id AS recording_id, turn AS seg_idx, before / {PACE}::DOUBLE AS "start", (before + length(text)) / {PACE}::DOUBLE AS "end", text,
         CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' END AS speaker
  FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM conversations))"""
_AGAIN = f"""again AS (
  SELECT recording_id, seg_idx, "start" + {LATER}::DOUBLE AS "start", "end" + {LATER}::DOUBLE AS "end", substr(text, 1, greatest(0, length(text) - {LOST})) AS text, speaker FROM seg)"""
_PAIR = f"""{_SEG}, {_AGAIN}, pair AS (
  SELECT a.recording_id, a.seg_idx AS a_seg_idx, a."start" AS a_start, a."end" AS a_end, a.text AS a_text, a.speaker AS a_speaker, {_norm('a.text')} AS a_norm,
         b.seg_idx AS b_seg_idx, b."start" AS b_start, b."end" AS b_end, b.text AS b_text, b.speaker AS b_speaker, {_norm('b.text')} AS b_norm
  FROM seg a JOIN again b ON a.recording_id = b.recording_id AND b.seg_idx IN (a.seg_idx, a.seg_idx + 1))"""
_RATIO = "greatest(0.0::DOUBLE, least(a_end, b_end) - greatest(a_start, b_start)) / greatest(0.001::DOUBLE, a_end - a_start, b_end - b_start)"
_SCORED = f"""{_PAIR}, part AS (SELECT *, {_sim('a_norm', 'b_norm')} AS text_score, {_RATIO} AS time_score FROM pair),
scored AS (SELECT *, CASE WHEN text_score < 0.45 AND time_score < 0.45 THEN 0.0::DOUBLE WHEN a_speaker <> b_speaker THEN 0.0::DOUBLE
  ELSE least(1.0::DOUBLE, text_score * 0.7::DOUBLE + time_score * 0.3::DOUBLE + CASE WHEN a_speaker = b_speaker THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) END AS score FROM part)"""


def _prefix_sim(a: str, b: str) -> str:
    return f"CASE WHEN length({b}) > 0 AND length({a}) > length({b}) THEN {_sim(f'trim(substr({a}, 1, length({b})))', b)} >= 0.85 ELSE false END"


# text ------------------------------------------------------------------------


@query(f"""SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS part, md5({_norm('text')}) AS norm_md5, length({_norm('text')})::BIGINT AS n FROM documents
UNION ALL SELECT 'turn', conv_id, turn, md5({_norm('text')}), length({_norm('text')})::BIGINT FROM conversations""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = text.normalized(F.col("text"))
    shape = [F.md5(norm).alias("norm_md5"), F.length(norm).cast("long").alias("n")]
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), *shape)
    return docs.unionByName(table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), *shape))


_ADJACENT = f"""n AS (SELECT conv_id AS recording_id, turn AS seg_idx, {_norm('text')} AS norm, lag({_norm('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"""


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = text.normalized(F.col("text"))
    rows = spread(table(spark, sf_dir, "conversations"), "conv_id").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("seg_idx"), norm.alias("norm"))
    return rows.withColumn("before", F.lag("norm").over(Window.partitionBy("recording_id").orderBy("seg_idx"))).where("before IS NOT NULL")


@query(f"""WITH {_ADJACENT} SELECT recording_id, seg_idx, {_lev('before', 'norm')}::BIGINT AS distance FROM n WHERE before IS NOT NULL""")
def lev_adjacent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjacent(spark, sf_dir).select("recording_id", "seg_idx", text.edit_distance(F.col("before"), F.col("norm")).cast("long").alias("distance"))


@query(f"""WITH {_ADJACENT} SELECT recording_id, seg_idx, round({_sim('before', 'norm')}, 6) AS similarity FROM n WHERE before IS NOT NULL""")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjacent(spark, sf_dir).select("recording_id", "seg_idx", F.round(text.similarity_of_normalized(F.col("before"), F.col("norm")), 6).alias("similarity"))


# timeline and pairs ----------------------------------------------------------


@query(f"""WITH {_SEG} SELECT recording_id, seg_idx, round("start", 6) AS "start", round("end", 6) AS "end", text, speaker FROM seg""")
def timeline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("start", "end")})


def _times(p: str) -> list:
    return [F.col(f"{p}_start"), F.col(f"{p}_end")]


@query(f"""WITH {_PAIR} SELECT recording_id, a_seg_idx, b_seg_idx, round({_RATIO}, 6) AS ratio FROM pair""")
def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("recording_id", "a_seg_idx", "b_seg_idx", F.round(segments.overlap_ratio(*_times("a"), *_times("b")), 6).alias("ratio"))


@query(f"""WITH {_SCORED} SELECT recording_id, a_seg_idx, b_seg_idx, round(score, 6) AS score FROM scored""")
def alignment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda p: F.element_at(segments.prepared(F.array(F.struct(*(F.col(f"{p}_{c}").alias(c) for c in ("start", "end", "text", "speaker"))))), 1).alias(p)
    rows = pairs(spark, sf_dir).select("recording_id", "a_seg_idx", "b_seg_idx", one("a"), one("b"))
    return rows.select("recording_id", "a_seg_idx", "b_seg_idx", F.round(segments.score(F.col("a"), F.col("b")), 6).alias("score"))


@query(f"""WITH {_PAIR} SELECT recording_id, a_seg_idx, b_seg_idx, {_prefix_sim('a_norm', 'b_norm')} AS a_more, {_prefix_sim('b_norm', 'a_norm')} AS b_more FROM pair""")
def more_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumns({"a": text.normalized(F.col("a_text")), "b": text.normalized(F.col("b_text"))})
    return rows.select("recording_id", "a_seg_idx", "b_seg_idx", text.more_complete_of_normalized(F.col("a"), F.col("b")).alias("a_more"), text.more_complete_of_normalized(F.col("b"), F.col("a")).alias("b_more"))


@query(f"""WITH {_PAIR} SELECT recording_id, a_seg_idx, b_seg_idx,
  round(greatest(0.0::DOUBLE, (floor(a_start / 60) + 1) * 60 - (a_start + a_end) / 2), 6) AS previous, round(greatest(0.0::DOUBLE, (b_start + b_end) / 2 - floor(a_start / 60) * 60), 6) AS current FROM pair""")
def edge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.floor(F.col("a_start") / 60) * F.lit(60.0)
    before = segments.edge_confidence(*_times("a"), low, low + 60.0, True)
    after = segments.edge_confidence(*_times("b"), low, low + 60.0, False)
    return pairs(spark, sf_dir).select("recording_id", "a_seg_idx", "b_seg_idx", F.round(before, 6).alias("previous"), F.round(after, 6).alias("current"))


@query(f"""WITH {_SEG}, turns AS (SELECT recording_id, seg_idx AS turn_idx, "start" + 2.5 AS "start", "end" + 2.5 AS "end", 'TURN_' || seg_idx AS speaker FROM seg),
best AS (SELECT s.recording_id, s.seg_idx, t.speaker, row_number() OVER (PARTITION BY s.recording_id, s.seg_idx ORDER BY least(s."end", t."end") - greatest(s."start", t."start") DESC, t.turn_idx) AS n
  FROM seg s JOIN turns t ON s.recording_id = t.recording_id AND s."start" < t."end" AND t."start" < s."end")
SELECT s.recording_id, s.seg_idx, b.speaker FROM seg s LEFT JOIN best b ON s.recording_id = b.recording_id AND s.seg_idx = b.seg_idx AND b.n = 1""")
def interval_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = timeline(spark, sf_dir)
    turns = first.select("recording_id", F.col("seg_idx").alias("turn_idx"), (F.col("start") + 2.5).alias("start"), (F.col("end") + 2.5).alias("end"), F.concat(F.lit("TURN_"), F.col("seg_idx").cast("string")).alias("speaker"))
    return interval.named_by_overlap(first.drop("speaker"), turns).select("recording_id", "seg_idx", "speaker")


#: In this query every third segment is heard again with a third of its text.
_PARTLY = """part_ AS (SELECT recording_id, seg_idx, "start", "end", CASE WHEN seg_idx % 3 = 0 THEN substr(text, 1, length(text) // 3) ELSE text END AS text, speaker FROM again)"""


@query(f"""WITH {_SEG}, {_AGAIN}, {_PARTLY},
p AS (SELECT recording_id, seg_idx, "start", "end", speaker, {_norm('text')} AS norm FROM seg), c AS (SELECT recording_id, seg_idx, "start", "end", speaker, {_norm('text')} AS norm FROM part_),
near AS (SELECT c.recording_id, c.seg_idx, p.speaker AS a_speaker, c.speaker AS b_speaker, p.norm AS a_norm, c.norm AS b_norm, p."start" AS a_start, p."end" AS a_end, c."start" AS b_start, c."end" AS b_end
  FROM c JOIN p ON c.recording_id = p.recording_id AND p."start" < c."end" AND c."start" < p."end"),
part AS (SELECT *, {_sim('a_norm', 'b_norm')} AS text_score, {_RATIO} AS time_score FROM near),
twice AS (SELECT DISTINCT recording_id, seg_idx FROM part WHERE NOT coalesce(a_speaker <> b_speaker, false)
  AND least(1.0::DOUBLE, text_score * 0.7::DOUBLE + time_score * 0.3::DOUBLE + CASE WHEN a_speaker = b_speaker THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) >= 0.82::DOUBLE)
SELECT recording_id, seg_idx FROM part_ ANTI JOIN twice USING (recording_id, seg_idx)""")
def unmatched_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is heard again and isn't like an overlapping earlier segment: a fuzzy anti-join."""
    first = timeline(spark, sf_dir)
    third = F.substring("text", F.lit(1), F.floor(F.length("text") / 3).cast("int"))
    again = heard_again(first).withColumn("text", F.when(F.col("seg_idx") % 3 == 0, third).otherwise(F.col("text")))
    return matching.unmatched(again, first).select("recording_id", "seg_idx")


# alignment, merging, emission ------------------------------------------------

_SCORE = """CASE WHEN t < 0.45 AND o < 0.45 THEN 0.0::DOUBLE WHEN a_speaker <> b_speaker THEN 0.0::DOUBLE
  ELSE least(1.0::DOUBLE, t * 0.7::DOUBLE + o * 0.3::DOUBLE + CASE WHEN a_speaker = b_speaker THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) END"""
#: From rows_ (side 0 or 1, recording_id, win, ord, start, end, text, speaker, norm): places, scores, the table of the alignment and its way back.
_MATCHED = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY recording_id, win, side ORDER BY ord) - 1 AS ix FROM rows_),
cells AS (SELECT a.recording_id, a.win, a.ix AS i, b.ix AS j, a.speaker AS a_speaker, b.speaker AS b_speaker, a.norm AS a_norm, b.norm AS b_norm, a."start" AS a_start, a."end" AS a_end, b."start" AS b_start, b."end" AS b_end
  FROM numbered a JOIN numbered b ON a.recording_id = b.recording_id AND a.win = b.win AND a.side = 0 AND b.side = 1),
parts AS (SELECT *, {_sim('a_norm', 'b_norm')} AS t, {_RATIO} AS o FROM cells),
points AS (SELECT recording_id, win, i, j, {_SCORE} AS score FROM parts),
matrix AS (SELECT recording_id, win, max(i) + 1 AS n, max(j) + 1 AS m, list(score ORDER BY i, j) AS s FROM points GROUP BY recording_id, win),
filled AS (SELECT recording_id, win, n, m, s, 0::BIGINT AS k, []::DOUBLE[] AS v FROM matrix UNION ALL
  SELECT recording_id, win, n, m, s, k + 1, list_append(v, CASE WHEN k // (m + 1) = 0 OR k % (m + 1) = 0 THEN 0.0::DOUBLE ELSE
    CASE WHEN s[(k // (m + 1) - 1) * m + k % (m + 1)] > 0 AND v[k - m - 1] + s[(k // (m + 1) - 1) * m + k % (m + 1)] >= greatest(v[k - m], v[k]) THEN v[k - m - 1] + s[(k // (m + 1) - 1) * m + k % (m + 1)] ELSE greatest(v[k - m], v[k]) END END)
  FROM filled WHERE k < (n + 1) * (m + 1)),
trace AS (SELECT recording_id, win, n, m, s, v, n AS i, m AS j, false AS hit FROM filled WHERE k = (n + 1) * (m + 1) UNION ALL
  SELECT recording_id, win, n, m, s, v, CASE d WHEN 2 THEN i - 1 WHEN 1 THEN i ELSE i - 1 END, CASE d WHEN 0 THEN j ELSE j - 1 END, d = 2 FROM (
    SELECT *, CASE WHEN s[(i - 1) * m + j] > 0 AND v[(i - 1) * (m + 1) + j] + s[(i - 1) * m + j] >= greatest(v[(i - 1) * (m + 1) + j + 1], v[i * (m + 1) + j]) THEN 2
      WHEN v[i * (m + 1) + j] > v[(i - 1) * (m + 1) + j + 1] THEN 1 ELSE 0 END AS d FROM trace WHERE i > 0 AND j > 0)),
hits AS (SELECT recording_id, win, i, j FROM trace WHERE hit),
sides AS (SELECT recording_id, win, count(*) FILTER (side = 0) AS np, count(*) FILTER (side = 1) AS nc FROM numbered GROUP BY recording_id, win),
pairs_ AS (SELECT h.recording_id, h.win, h.i, h.j, p, c FROM hits h JOIN numbered p ON p.recording_id = h.recording_id AND p.win = h.win AND p.side = 0 AND p.ix = h.i
  JOIN numbered c ON c.recording_id = h.recording_id AND c.win = h.win AND c.side = 1 AND c.ix = h.j),
alone AS (SELECT n.recording_id, n.win, n.ix AS i, n."start", n."end", n.text, n.speaker FROM numbered n JOIN sides USING (recording_id, win) WHERE np = 0 OR nc = 0)"""
_WINDOWS = f"""{_SEG}, {_AGAIN},
rows_ AS (SELECT 0 AS side, *, seg_idx AS ord, floor("start" / {WINDOW_SECONDS})::BIGINT AS win, {_norm('text')} AS norm FROM seg UNION ALL SELECT 1, *, seg_idx, floor("start" / {WINDOW_SECONDS})::BIGINT, {_norm('text')} FROM again),
{_MATCHED}"""


def _resolved(middle: str) -> str:
    """CTEs up to ``resolved``: recording_id, win, i, start, end, text, speaker; ``middle`` of a window is an expression of win."""
    return f"""pool AS (SELECT recording_id, win, 0 AS k, i AS o, CASE WHEN (p."start" + p."end") / 2 < {middle} OR (p.norm = c.norm AND (p."start" + p."end") / 2 <= {middle}) THEN p ELSE c END AS r FROM pairs_
  UNION ALL SELECT n.recording_id, n.win, 1 + n.side, n.ix, n FROM numbered n LEFT JOIN hits h ON n.recording_id = h.recording_id AND n.win = h.win AND ((n.side = 0 AND n.ix = h.i) OR (n.side = 1 AND n.ix = h.j)) WHERE h.i IS NULL),
lined AS (SELECT recording_id, win, r."start" AS b_start, r."end" AS b_end, r.text AS text, r.speaker AS b_speaker, r.norm AS b_norm, row_number() OVER (PARTITION BY recording_id, win ORDER BY r."start", r."end", k, o) AS n FROM pool JOIN sides USING (recording_id, win) WHERE np > 0 AND nc > 0),
folded AS (SELECT *, true AS kept, b_start AS a_start, b_end AS a_end, b_speaker AS a_speaker, b_norm AS a_norm FROM lined WHERE n = 1 UNION ALL
  SELECT recording_id, win, b_start, b_end, text, b_speaker, b_norm, n, kept, CASE WHEN kept THEN b_start ELSE a_start END, CASE WHEN kept THEN b_end ELSE a_end END, CASE WHEN kept THEN b_speaker ELSE a_speaker END, CASE WHEN kept THEN b_norm ELSE a_norm END FROM (
    SELECT *, {_SCORE} < 0.9::DOUBLE AS kept FROM (SELECT l.*, f.a_start, f.a_end, f.a_speaker, f.a_norm, {_sim('f.a_norm', 'l.b_norm')} AS t, {_RATIO.replace('a_', 'f.a_').replace('b_', 'l.b_')} AS o
      FROM folded f JOIN lined l ON l.recording_id = f.recording_id AND l.win = f.win AND l.n = f.n + 1))),
resolved AS (SELECT recording_id, win, row_number() OVER (PARTITION BY recording_id, win ORDER BY n) - 1 AS i, b_start AS "start", b_end AS "end", text, b_speaker AS speaker FROM folded WHERE kept UNION ALL SELECT * FROM alone)"""


@query(f"""WITH RECURSIVE {_WINDOWS} SELECT recording_id, win AS "window", i::INT AS prev_idx, j::INT AS curr_idx, round(s[i * m + j + 1], 6) AS score FROM trace WHERE hit""")
def align_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir).select("recording_id", "window", F.explode(alignment.aligned(F.col("previous"), F.col("current"))).alias("m"))
    return rows.select("recording_id", "window", "m.prev_idx", "m.curr_idx", F.round("m.score", 6).alias("score"))


def _listed(rows: DataFrame, found) -> DataFrame:
    out = rows.select("recording_id", "window", F.posexplode(found).alias("i", "s"))
    return out.select("recording_id", "window", F.col("i").cast("long").alias("i"), F.round("s.start", 6).alias("start"), F.round("s.end", 6).alias("end"), "s.text", "s.speaker")


_LISTED = """recording_id, win AS "window", i::BIGINT AS i, round("start", 6) AS "start", round("end", 6) AS "end", text, speaker"""


@query(f"""WITH RECURSIVE {_WINDOWS},
decided AS (SELECT recording_id, win, i, j, score >= 0.55::DOUBLE AND ({_prefix_sim('c.norm', 'p.norm')} OR (NOT {_prefix_sim('p.norm', 'c.norm')}
  AND greatest(0.0::DOUBLE, (c."start" + c."end") / 2 - win * {WINDOW_SECONDS}::DOUBLE) > greatest(0.0::DOUBLE, (win + 1) * {WINDOW_SECONDS}::DOUBLE - (p."start" + p."end") / 2))) AS newer FROM pairs_ JOIN points USING (recording_id, win, i, j)),
repeats AS (SELECT DISTINCT x.recording_id, x.win, x.j FROM points x ANTI JOIN (SELECT * FROM decided WHERE newer) d ON x.recording_id = d.recording_id AND x.win = d.win AND x.i = d.i WHERE x.score >= 0.82::DOUBLE),
gone AS (SELECT recording_id, win, 0 AS side, i AS ix FROM decided WHERE newer UNION SELECT recording_id, win, 1, j FROM decided WHERE NOT newer UNION SELECT recording_id, win, 1, j FROM repeats),
left_ AS (SELECT n.* FROM numbered n JOIN sides USING (recording_id, win) ANTI JOIN gone USING (recording_id, win, side, ix) WHERE np > 0 AND nc > 0),
all_ AS (SELECT recording_id, win, row_number() OVER (PARTITION BY recording_id, win ORDER BY "start", "end", side, ix) - 1 AS i, "start", "end", text, speaker FROM left_ UNION ALL SELECT * FROM alone)
SELECT {_LISTED} FROM all_""")
def merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(windows(spark, sf_dir), alignment.merged(F.col("previous"), F.col("current"), F.col("overlap_start"), F.col("overlap_end")))


@query(f"""WITH RECURSIVE {_WINDOWS}, {_resolved(f'(win + 0.5::DOUBLE) * {WINDOW_SECONDS}')} SELECT {_LISTED} FROM resolved""")
def resolve_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(windows(spark, sf_dir), alignment.resolved(F.col("previous"), F.col("current"), F.col("overlap_start"), F.col("overlap_end")))


_STEP = CHUNK_SECONDS - OVERLAP_SECONDS


@query(f"""WITH RECURSIVE {_SEG}, {_AGAIN}, sides_ AS (SELECT *, 0 AS odd FROM seg UNION ALL SELECT *, 1 FROM again),
touched AS (SELECT *, greatest(0, ceil(("end" - {CHUNK_SECONDS}) / {_STEP}))::INT AS low, floor("start" / {_STEP})::INT AS begins FROM sides_),
dealt AS (SELECT *, unnest(range(least(low, begins), greatest(low, begins) + 1)) AS k FROM touched),
inside AS (SELECT recording_id, k, "start", "end", text, speaker, {_norm('text')} AS norm, row_number() OVER (PARTITION BY recording_id, k ORDER BY "start", "end", text, speaker) AS ord, (k + 1) * {_STEP} AS edge FROM dealt WHERE k % 2 = odd),
chunks AS (SELECT *, lag(k) OVER (PARTITION BY recording_id ORDER BY k) AS before, max(k) OVER (PARTITION BY recording_id) AS top FROM (SELECT DISTINCT recording_id, k FROM inside)),
rows_ AS (SELECT 0 AS side, c.recording_id, c.k AS win, i.ord, i."start", i."end", i.text, i.speaker, i.norm FROM chunks c JOIN inside i ON i.recording_id = c.recording_id AND i.k = c.before WHERE i."end" > i.edge
  UNION ALL SELECT 1, recording_id, k, ord, "start", "end", text, speaker, norm FROM inside WHERE "start" < edge),
{_MATCHED}, {_resolved(f'(win + 0.5::DOUBLE) * {_STEP}')},
had AS (SELECT DISTINCT recording_id, win AS k, true AS had FROM rows_ WHERE side = 0),
each_ AS (SELECT i.*, coalesce(h.had, false) AS had, i.k = c.top AS is_last FROM inside i JOIN chunks c USING (recording_id, k) LEFT JOIN had h USING (recording_id, k)),
sent AS (SELECT recording_id, win AS k, 0 AS part, i, 'resolved-overlap' AS reason, "start", "end", text, speaker FROM resolved SEMI JOIN had ON resolved.recording_id = had.recording_id AND resolved.win = had.k
  UNION ALL SELECT recording_id, k, 1, ord, 'initial-non-overlap', "start", "end", text, speaker FROM each_ WHERE NOT had AND "end" <= edge
  UNION ALL SELECT recording_id, k, 2, ord, 'last-trailing', "start", "end", text, speaker FROM each_ WHERE NOT had AND is_last AND "end" > edge
  UNION ALL SELECT recording_id, k, 3, ord, 'last-body', "start", "end", text, speaker FROM each_ WHERE had AND is_last AND "start" >= edge
  UNION ALL SELECT recording_id, k, 4, ord, 'mid-body', "start", "end", text, speaker FROM each_ WHERE had AND NOT is_last AND "start" >= edge AND "end" <= edge)
SELECT recording_id, (k + 1)::INT AS chunk_index, reason, row_number() OVER (PARTITION BY recording_id, k ORDER BY part, i) - 1 AS emit_idx, round("start", 6) AS "start", round("end", 6) AS "end", text, speaker FROM sent""")
def emitter_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.emitted(timeline_chunks(spark, sf_dir), OVERLAP_SECONDS)
    return rows.select("recording_id", "chunk_index", "reason", "emit_idx", F.round("seg.start", 6).alias("start"), F.round("seg.end", 6).alias("end"), "seg.text", "seg.speaker")


# outputs -----------------------------------------------------------------------


@query(f"""WITH {_SEG}, t AS (SELECT recording_id, seg_idx, trunc("start" * 16000)::BIGINT AS a, trunc("end" * 16000)::BIGINT AS b, list_filter(regexp_split_to_array({_strip('text')}, '[\\s\\v\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda w: w <> '') AS tokens FROM seg),
w AS (SELECT *, len(tokens) AS n, greatest(1, greatest(1, b - a) // len(tokens)) AS step, unnest(range(len(tokens))) AS i FROM t WHERE len(tokens) > 0)
SELECT recording_id, seg_idx, i::BIGINT AS word_idx, a + i * step AS start_ts, CASE WHEN i = n - 1 THEN b ELSE a + (i + 1) * step END AS end_ts,
  CASE WHEN i = 0 THEN tokens[i + 1] ELSE ' ' || tokens[i + 1] END AS word, 1.0::DOUBLE AS probability, 'en' AS lang FROM w""")
def word_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval.words(timeline(spark, sf_dir))


_PUBLIC = "CASE speaker WHEN 'SPEAKER_00' THEN '0' WHEN 'SPEAKER_01' THEN '1' END"


@query(f"""WITH {_SEG}, m AS (SELECT *, floor("start" / 60)::BIGINT AS minute, lag(floor("start" / 60)::BIGINT) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS before FROM seg)
SELECT recording_id, seg_idx, concat_ws(chr(10), CASE WHEN before IS NULL OR before <> minute THEN '[' || CASE WHEN minute < 100 THEN lpad(minute::VARCHAR, 2, '0') ELSE minute::VARCHAR END || ':00]' END,
  CASE WHEN {_strip('text')} <> '' THEN '[' || coalesce({_PUBLIC}, 'SPEAKER') || '] ' || {_strip('text')} END) AS lines FROM m""")
def minute_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.text_lines(timeline(spark, sf_dir), F.lit(False), "recording_id", "seg_idx")


@query(f"""WITH {_SEG}, m AS (SELECT *, floor("start" / 60)::BIGINT AS minute, lag(floor("start" / 60)::BIGINT) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS before FROM seg),
l AS (SELECT recording_id, seg_idx, concat_ws(chr(10), CASE WHEN before IS NULL OR before <> minute THEN '[' || CASE WHEN minute < 100 THEN lpad(minute::VARCHAR, 2, '0') ELSE minute::VARCHAR END || ':00]' END,
  CASE WHEN {_strip('text')} <> '' THEN '[' || coalesce({_PUBLIC}, 'SPEAKER') || '] ' || {_strip('text')} END) AS lines FROM m)
SELECT recording_id, {_strip("string_agg(lines, chr(10) ORDER BY seg_idx) FILTER (lines <> '')")} AS document FROM l GROUP BY recording_id""")
def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.text_documents(timeline(spark, sf_dir), F.lit(False), "recording_id", "seg_idx")


@query(f"""WITH {_SEG} SELECT recording_id, seg_idx, {_PUBLIC} AS speaker, round("start", 6) AS "start", round("end", 6) AS "end", {_strip('text')} AS text FROM seg""")
def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON lines read back, as number formats differ between engines."""
    lines = writers.jsonl_lines(timeline(spark, sf_dir), F.lit(False), "recording_id", "seg_idx")
    back = F.from_json("line", "speaker string, start double, end double, text string").alias("x")
    return lines.select("recording_id", "seg_idx", back).select("recording_id", "seg_idx", "x.speaker", F.round("x.start", 6).alias("start"), F.round("x.end", 6).alias("end"), "x.text")


@query(f"""WITH {_SEG}, d AS (SELECT recording_id, {_strip("string_agg(text, '' ORDER BY seg_idx)")} AS document, count(*)::BIGINT AS n FROM seg GROUP BY recording_id)
SELECT recording_id, md5(document) AS document_md5, n, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) - 1 AS i, round("start", 6) AS "start", round("end", 6) AS "end", text, {_PUBLIC} AS speaker, 'turn ' || seg_idx AS note
FROM seg JOIN d USING (recording_id)""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents read back, a row for each segment; a further column of the segments comes with them."""
    rows = timeline(spark, sf_dir).withColumn("note", F.concat(F.lit("turn "), F.col("seg_idx").cast("string")))
    found = writers.json_documents(rows, F.lit(False), "recording_id", "seg_idx")
    back = F.from_json("document", "text string, segments array<struct<start:double,end:double,text:string,speaker:string,note:string>>")
    each = found.select("recording_id", back.alias("x")).select("recording_id", F.md5("x.text").alias("document_md5"), F.size("x.segments").cast("long").alias("n"), F.posexplode("x.segments").alias("i", "s"))
    return each.select("recording_id", "document_md5", "n", F.col("i").cast("long").alias("i"), F.round("s.start", 6).alias("start"), F.round("s.end", 6).alias("end"), "s.text", "s.speaker", "s.note")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN (user_id::VARCHAR) WHEN 1 THEN (user_id::VARCHAR) WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN (user_id::VARCHAR) ELSE NULL END AS public,
  CASE event_id % 6 WHEN 0 THEN (user_id::VARCHAR) ELSE NULL END AS annotated, CASE event_id % 6 WHEN 2 THEN NULL WHEN 5 THEN NULL WHEN 0 THEN 'speaker_' || lpad(user_id::VARCHAR, 8, '0') WHEN 1 THEN user_id::VARCHAR WHEN 3 THEN 'chunk2:' || user_id WHEN 4 THEN user_id::VARCHAR END AS local FROM events""")
def public_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    kind = F.col("event_id") % 6
    label = (
        F.when(kind == 0, F.concat(F.lit("speaker_"), F.lpad(user, 8, "0"))).when(kind == 1, user).when(kind == 2, F.lit("UNKNOWN"))
        .when(kind == 3, F.concat(F.lit("chunk2:"), user)).when(kind == 4, F.concat(F.lit(" "), user, F.lit(" "))).otherwise(F.lit("[Noise]"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", label.alias("label"))
    return rows.select("event_id", segments.public_speaker(F.col("label")).alias("public"), segments.public_segment_speaker(F.col("label"), F.lit(True)).alias("annotated"), segments.local_label(F.col("label")).alias("local"))


@query(f"""WITH {_SEG}, f AS (SELECT *, max("end") OVER (PARTITION BY recording_id) AS finish FROM seg)
SELECT recording_id, seg_idx, 'transcribing' AS phase, round("end", 2) AS current, round(finish, 2) AS finish, 'seconds' AS units, round("end" / finish * 100, 1) AS percent, {_PUBLIC} AS speaker, {_strip('text')} AS text, round("start", 2) AS "start", round("end", 2) AS "end" FROM f""")
def status_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir).withColumn("finish", F.max("end").over(Window.partitionBy("recording_id")))
    status = segments.status_payload(F.col("start"), F.col("end"), F.col("text"), F.col("speaker"), F.lit(False), F.col("finish"))
    return rows.select("recording_id", "seg_idx", status.alias("x")).select("recording_id", "seg_idx", "x.phase", "x.progress.*", "x.utterance.*")


# events ----------------------------------------------------------------------

_CLOCK = "epoch(ts)"


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, value, {_CLOCK}::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_id, user_id, n, true AS kept, value AS v, t FROM e WHERE n = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.n, NOT (e.value - f.v < 25 AND e.t - f.t < 86400), CASE WHEN e.value - f.v < 25 AND e.t - f.t < 86400 THEN f.v ELSE e.value END, CASE WHEN e.value - f.v < 25 AND e.t - f.t < 86400 THEN f.t ELSE e.t END
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT event_id, user_id FROM f WHERE kept""")
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs and values as progress: within a day, only what is 25 further passes."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return progress.throttled(rows, "user_id", ["ts", "event_id"], "value", "seconds", 25.0, 86_400.0).select("event_id", "user_id")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*)::BIGINT AS n_events FROM events GROUP BY user_id""")
def job_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH e AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM events)
SELECT event_id, user_id, event_type FROM e WHERE ended = 0""")
def terminal_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = progress.until_end(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")
    return rows.select("event_id", "user_id", "event_type")


#: Event types as job states.
_AS_STATE = {"signup": "claimed", "view": "running", "click": "awaiting_result", "purchase": "completed", "error": "failed"}


@query("""WITH s AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'claimed' WHEN 'view' THEN 'running' WHEN 'click' THEN 'awaiting_result' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS state FROM events),
b AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
SELECT event_id, CASE WHEN before IS NULL THEN state = 'claimed' WHEN before = 'claimed' THEN state IN ('awaiting_payload', 'running', 'failed', 'canceled')
  WHEN before = 'running' THEN state IN ('running', 'awaiting_result', 'completed', 'failed', 'canceled') WHEN before = 'awaiting_result' THEN state IN ('completed', 'failed', 'canceled') ELSE false END AS valid FROM b""")
def job_state_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.create_map(*(F.lit(x) for pair in _AS_STATE.items() for x in pair))
    rows = table(spark, sf_dir, "events").withColumn("state", F.try_element_at(states, F.col("event_type")))
    return progress.checked(rows, "user_id", ["ts", "event_id"], "state").select("event_id", "valid")


@query("""SELECT event_id, event_type AS event, (props::JSON ->> 'k')::BIGINT AS k, NULL::VARCHAR AS raw FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, 'message', NULL, 'no json: ' || props FROM events WHERE event_id % 3 = 0""")
def sse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as event-stream blocks, read back; every third has no type and no JSON."""
    bad = F.col("event_id") % 3 == 0
    block = F.when(bad, F.concat(F.lit(": a comment\ndata: no json: "), F.col("props"))).otherwise(F.concat(F.lit("event: "), F.col("event_type"), F.lit("\ndata: "), F.col("props")))
    rows = readers.server_sent_events(table(spark, sf_dir, "events").select("event_id", block.alias("value")))
    return rows.select("event_id", "event", readers.event_payload(F.col("data"), "k long").alias("x")).select("event_id", "event", F.col("x.payload.k").alias("k"), F.col("x.raw").alias("raw"))


@query("""SELECT event_type AS route, count(*)::BIGINT AS n, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type""")
def props_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event type's handler counts of the events that are routed to it."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    count = lambda kind: lambda df: df.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")).select(F.lit(kind).alias("route"), "n", "k").where("n > 0")
    found = readers.routed(rows, {kind: count(kind) for kind in _AS_STATE})
    return functools.reduce(DataFrame.unionByName, found.values())


@query("""SELECT DISTINCT user_id, event_type, round(value, 2) AS "start", round(value + 1, 2) AS "end" FROM events""")
def dedupe_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").alias("start"), (F.col("value") + 1).alias("end"))
    return progress.observed_once(rows, "user_id", "start", "end", "event_type")


@query("""SELECT event_id, '{"user":' || user_id || ',"Token":"***","nested":{"api_key":"***","list":[{"client_key":"***"},"' || event_type || '"]}}' AS config FROM events""")
def secret_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.format_string('{"user":%d,"Token":"t%d","nested":{"api_key":[1,2],"list":[{"client_key":null},"%s"]}}', "user_id", "event_id", "event_type")
    return table(spark, sf_dir, "events").select("event_id", settings.redacted(made).alias("config"))


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'https://host/api/transfer/' || page_id ELSE 'https://host/files/' || page_id || '.mp3' END AS resolved,
  CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN '.wav' ELSE '.bin' END WHEN page_id % 3 = 1 THEN '.flac' ELSE '.mp3' END AS suffix FROM pages""")
def transfer_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    kind = F.col("page_id") % 3
    reference = F.when(kind == 0, F.col("url")).when(kind == 1, number).otherwise(F.concat(F.lit("/files/"), number, F.lit(".mp3")))
    content = F.when(kind == 1, F.lit(" Audio/FLAC ")).when(F.col("page_id") % 2 == 0, F.lit("audio/x-wav"))
    name = F.when(kind == 0, F.lit("noname")).otherwise(reference)
    return table(spark, sf_dir, "pages").select("page_id", readers.transfer_url("https://host/", reference).alias("resolved"), settings.suffix(name, content).alias("suffix"))


# vectors and audio -------------------------------------------------------------

_DOT = "list_dot_product(a::DOUBLE[], b::DOUBLE[])"


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a, lag(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b)), 6) AS cosine FROM v WHERE b IS NOT NULL""")
def cosine_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the one before it."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("place"), "embedding")
    found = vectors_before(rows).where("before IS NOT NULL")
    return found.select(F.col("place").alias("vec_id"), F.round(vectors.cosine(F.col("embedding"), F.col("before")), 6).alias("cosine"))


def vectors_before(rows: DataFrame, levels: int = 2) -> DataFrame:
    """Adds ``before`` to rows (place, embedding): the embedding of the place before, whatever the gaps.

    Within buckets of places it's a lag; a bucket's first one has the last of
    the bucket before, which is found in the same way among buckets.  So each
    row is exchanged once, and no task orders more than a bucket's rows.
    """
    if not levels:
        return rows.withColumn("before", F.lag("embedding").over(Window.orderBy("place")))
    inside = rows.withColumn("bucket", F.floor(F.col("place") / 1024)).withColumn("before", F.lag("embedding").over(Window.partitionBy("bucket").orderBy("place")))
    last = inside.groupBy("bucket").agg(F.max_by("embedding", "place").alias("embedding")).select(F.col("bucket").alias("place"), "embedding")
    earlier = vectors_before(last, levels - 1).select(F.col("place").alias("bucket"), F.col("before").alias("earlier"))
    return inside.join(earlier, "bucket").withColumn("before", F.coalesce("before", "earlier")).drop("earlier", "bucket")


_MEANS = """c AS (SELECT label, list(v ORDER BY i) AS b FROM (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i) GROUP BY label)"""
_LIKE = _MEANS + """, like_ AS (SELECT e.vec_id, c.label, list_dot_product(e.a, c.b) / sqrt(list_dot_product(e.a, e.a)) / sqrt(list_dot_product(c.b, c.b)) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings) e, c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS n FROM like_)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector beside the centroids of the labels, best first."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest.ranked_centroids(rows.select("vec_id", "embedding"), "embedding", nearest.means(rows, "label", "embedding"), "label").select("vec_id", "best")


@query(f"""WITH {_LIKE} SELECT vec_id, label, round(cosine, 6) AS cosine FROM ranked WHERE n = 1""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("vec_id", F.col("best")[0]["group"].alias("label"), F.round(-F.col("best")[0]["far"], 6).alias("cosine"))


@query(f"""WITH {_LIKE} SELECT vec_id, round(max(cosine) FILTER (n = 1) - max(cosine) FILTER (n = 2), 6) AS margin FROM ranked GROUP BY vec_id""")
def top2_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("vec_id", F.round(F.col("best")[1]["far"] - F.col("best")[0]["far"], 6).alias("margin"))


@query(f"""WITH {_MEANS}, p AS (SELECT a.label AS speaker_id, b.label AS other, list_dot_product(a.b, b.b) / sqrt(list_dot_product(a.b, a.b)) / sqrt(list_dot_product(b.b, b.b)) AS score FROM c a JOIN c b ON a.label <> b.label AND a.label % 2 = b.label % 2),
r AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY score DESC, other) AS n, coalesce(lead(score) OVER (PARTITION BY speaker_id ORDER BY score DESC, other), -1) AS second FROM p)
SELECT (speaker_id % 2)::INT AS recording_id, speaker_id, other, round(score, 6) AS score, round(score - greatest(second, -1), 6) AS margin FROM r WHERE n = 1""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as speakers, even and odd ones in different recordings."""
    known = nearest.means(table(spark, sf_dir, "embeddings"), "label", "embedding").select((F.col("label") % 2).alias("recording_id"), F.col("label").alias("speaker_id"), "centroid", F.lit(10.0).alias("total_seconds"))
    return nearest.merge_candidates(known, 8.0).withColumns({c: F.round(c, 6) for c in ("score", "margin")})


@query("""WITH v AS (SELECT vec_id, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) WHERE list_dot_product(x, x) > 0),
p AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.u, b.u), 9) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other))::INT AS rank, other, round(cosine, 6) AS cosine FROM p QUALIFY rank <= 2""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two vectors most like each one."""
    found = likeness.most_alike(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.select(F.col("id").alias("vec_id"), "rank", "other", F.round("cosine", 6).alias("cosine"))


@query("""WITH RECURSIVE e AS (SELECT label, embedding::DOUBLE[] AS x, 1 + vec_id % 4 AS d, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
u AS (SELECT label, n, d::DOUBLE AS d, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS x FROM e),
f AS (SELECT label, n, x AS c, d AS total FROM u WHERE n = 1 UNION ALL SELECT label, n, list_transform(y, lambda v: v / sqrt(list_dot_product(y, y))), total FROM (
  SELECT u.label, u.n, list_transform(list_zip(f.c, u.x), lambda p: (p[1] * f.total + p[2] * u.d) / (f.total + u.d)) AS y, f.total + u.d AS total FROM f JOIN u ON f.label = u.label AND u.n = f.n + 1))
SELECT label, total AS total_seconds, n::INT AS embedding_count, unnest(range(len(c)))::INT AS i, round(unnest(c), 6) AS value FROM f WHERE n = (SELECT max(n) FROM u WHERE u.label = f.label)""")
def centroid_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of a label from its vectors in order, 1 to 4 seconds each, component by component."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", (F.col("vec_id") % 4 + 1).cast("double").alias("seconds"))
    found = speakers.folded(rows, "label", "vec_id", "embedding", "seconds")
    return found.select("label", "total_seconds", "embedding_count", F.posexplode("centroid").alias("i", "value")).withColumn("value", F.round("value", 6))


_UNIT = "list_transform({x}, lambda y: y / sqrt(list_dot_product({x}, {x})))"
#: Per recording and utterance: profiles p (number, centroid, seconds), labels a, numbers given; a label's number is replaced when its profile is merged.
_RESOLVER = f"""WITH RECURSIVE u AS (SELECT vec_id // 64 AS rec, vec_id AS seq, ((vec_id % 64) // 8 + 1)::INT AS chunk, label::VARCHAR AS local, 2.0::DOUBLE + vec_id % 4 AS s, {_UNIT.format(x='embedding::DOUBLE[]')} AS v,
  row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) AS k FROM embeddings),
f AS (SELECT DISTINCT rec, 0::BIGINT AS k, []::STRUCT(n BIGINT, c DOUBLE[], s DOUBLE)[] AS p, []::STRUCT(chunk INT, local VARCHAR, n BIGINT)[] AS a, 0::BIGINT AS numbers, NULL::BIGINT AS seq, NULL::INT AS chunk, NULL::VARCHAR AS local, NULL::VARCHAR AS emitted FROM u UNION ALL
  SELECT rec, k, CASE WHEN stays IS NULL THEN p ELSE list_append(list_filter(p, lambda x: x.n <> stays AND x.n <> goes), {{'n': stays, 'c': {_UNIT.format(x='mean')}, 's': ps.s + pg.s}}) END,
    CASE WHEN stays IS NULL THEN a ELSE list_transform(a, lambda x: {{'chunk': x.chunk, 'local': x.local, 'n': CASE WHEN x.n = goes THEN stays ELSE x.n END}}) END, numbers, seq, chunk, local, emitted FROM (
    SELECT *, CASE WHEN ps IS NULL THEN own.c ELSE list_transform(list_zip(ps.c, pg.c), lambda z: z[1] * ps.s + z[2] * pg.s) END AS mean FROM (
      SELECT *, list_filter(p, lambda x: x.n = stays)[1] AS ps, list_filter(p, lambda x: x.n = goes)[1] AS pg FROM (
        SELECT *, CASE WHEN same THEN least(own.n, near[1].n) END AS stays, CASE WHEN same THEN greatest(own.n, near[1].n) END AS goes FROM (
          SELECT *, coalesce(own.s >= 4 AND -near[1].d >= 0.5 AND -near[1].d - coalesce(-near[2].d, -1) >= 0.02, false) AS same FROM (
            SELECT * EXCLUDE (p), list_append(p, own) AS p, list_sort(list_transform(list_filter(p, lambda x: x.s >= 4), lambda x: {{'d': -list_dot_product(x.c, own.c), 'n': x.n}})) AS near FROM (
              SELECT * EXCLUDE (p, a), list_filter(p, lambda x: x.n <> number) AS p, CASE WHEN cur IS NULL THEN list_append(a, {{'chunk': chunk, 'local': local, 'n': number}}) ELSE a END AS a,
                {{'n': number, 'c': {_UNIT.format(x='mixed')}, 's': coalesce(old.s, 0) + s}} AS own FROM (
                SELECT *, CASE WHEN old IS NULL THEN v ELSE list_transform(list_zip(old.c, v), lambda z: z[1] * old.s + z[2] * s) END AS mixed FROM (
                  SELECT *, list_filter(p, lambda x: x.n = number)[1] AS old FROM (
                    SELECT * EXCLUDE (numbers), coalesce(given, CASE WHEN like_ THEN ready[1].n ELSE numbers END) AS number, numbers + CASE WHEN given IS NULL AND NOT like_ THEN 1 ELSE 0 END AS numbers FROM (
                      SELECT *, coalesce(-ready[1].d >= 0.2, false) AS like_, CASE WHEN given IS NULL THEN 'chunk' || chunk || ':' || local ELSE 'SPEAKER_' || lpad(given::VARCHAR, 2, '0') END AS emitted FROM (
                        SELECT * EXCLUDE (numbers), coalesce(cur, CASE WHEN chunk = 1 THEN numbers END) AS given, numbers + CASE WHEN cur IS NULL AND chunk = 1 THEN 1 ELSE 0 END AS numbers,
                          list_sort(list_transform(list_filter(p, lambda x: x.s >= 2), lambda x: {{'d': -list_dot_product(x.c, v), 'n': x.n}})) AS ready FROM (
                          SELECT f.rec, u.k, f.p, f.a, f.numbers, u.seq, u.chunk, u.local, u.s, u.v, list_filter(f.a, lambda x: x.chunk = u.chunk AND x.local = u.local)[1].n AS cur FROM f JOIN u ON f.rec = u.rec AND u.k = f.k + 1))))))))))))),
last AS (SELECT rec, unnest(a) AS a FROM f QUALIFY k = max(k) OVER (PARTITION BY rec))
SELECT f.rec AS recording_id, f.seq, f.chunk AS chunk_index, f.local AS local_speaker, f.emitted AS emitted_speaker, 'SPEAKER_' || lpad(l.a.n::VARCHAR, 2, '0') AS speaker
FROM f JOIN last l ON f.rec = l.rec AND f.chunk = l.a.chunk AND f.local = l.a.local WHERE f.k > 0"""


@query(_RESOLVER)
def speaker_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as utterances of 2 to 5 seconds, a recording for every 64 of them, in chunks of 8 with local labels."""
    n = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 64").alias("recording_id"), n.alias("seq"), (F.expr("vec_id % 64 div 8") + 1).cast("int").alias("chunk_index"), F.col("label").cast("string").alias("speaker"),
        (n * 6.0).alias("start"), (n * 6.0 + 2 + n % 4).alias("end"), F.lit("words").alias("text"), F.col("embedding").alias("vector"),
    )
    return speakers.resolved_speakers(rows, speakers.Settings(seed_seconds=2.0, similarity_threshold=0.2, merge_seed_seconds=4.0, merge_similarity_threshold=0.5, merge_margin=0.02))


@query("""SELECT vec_id, round(list_sum(m), 6) AS total, len(m)::BIGINT AS n, round(m[1], 6) AS first FROM (SELECT vec_id, list_transform(range(len(embedding) // 2), lambda i: (embedding[2 * i + 1]::DOUBLE + embedding[2 * i + 2]::DOUBLE) / 2) AS m FROM embeddings)""")
def pcm_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as two interleaved channels."""
    mixed = audio.mono(F.array("embedding"), F.lit(2), F.lit(False))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", mixed.alias("m"))
    return rows.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.size("m").cast("long").alias("n"), F.round(F.col("m")[0], 6).alias("first"))


@query("""SELECT vec_id, len(s)::BIGINT AS n, round(s[1]::DOUBLE, 6) AS first FROM (SELECT vec_id, embedding[trunc((vec_id % 7) * 0.45 * 10)::BIGINT + 1 : least(64, trunc(((vec_id % 7) * 0.45 + 1.3) * 10)::BIGINT)] AS s FROM embeddings)""")
def pcm_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as audio at 10 samples a second."""
    start = F.col("vec_id") % 7 * F.lit(0.45)
    cut = audio.slice_seconds(F.col("embedding"), F.lit(10), start, start + 1.3)
    return table(spark, sf_dir, "embeddings").select("vec_id", cut.alias("s")).select("vec_id", F.size("s").cast("long").alias("n"), F.round(F.col("s")[0].cast("double"), 6).alias("first"))
