"""Queries by name, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenfold.functions import throws as T
from tenfold.functions.arrays import longest_uniform
from tenfold.operators import calibrate, fusion, geometry, matching, report, scoring
from tenfold.sources import derived
from tenfold.sources.derived import KEYS, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


GAMES = """
e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn,
        event_id % 11 AS r1, CAST(round(value * 100) AS BIGINT) % 1000 AS z FROM events),
e2 AS (SELECT *, CASE WHEN r1 < 10 THEN z % (11 - r1) END AS r2, CAST(rn % 10 + 1 AS INT) AS frame FROM e),
g AS (SELECT user_id, CAST(rn // 10 AS INT) AS game, frame,
  CASE WHEN event_id % 23 = 0 THEN '?' ELSE '' END
  || CASE WHEN r1 = 10 THEN 'X' ELSE (CASE WHEN r1 = 0 THEN '-' ELSE CAST(r1 AS VARCHAR) END) || CASE WHEN r1 > 0 AND event_type = 'signup' THEN 'o' ELSE '' END END
  || CASE WHEN r1 = 10 THEN '' WHEN r1 + r2 = 10 THEN '/' WHEN r2 = 0 THEN '-' ELSE CAST(r2 AS VARCHAR) END
  || CASE WHEN frame < 10 THEN ''
          WHEN r1 = 10 THEN CASE WHEN z % 11 = 10 THEN 'XX' WHEN z % 11 = 0 THEN '--' ELSE CAST(z % 11 AS VARCHAR) || '-' END
          WHEN r1 + r2 = 10 THEN CASE WHEN z % 10 = 0 THEN '-' ELSE CAST(z % 10 AS VARCHAR) END ELSE '' END AS text,
  CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS printed_off FROM e2)"""

_PIN = "CASE WHEN t[{i}] = 'X' THEN 10 WHEN t[{i}] = '-' THEN 0 WHEN regexp_matches(t[{i}], '^[0-9]o?$') THEN CAST(left(t[{i}], 1) AS INT) END"


def _step(i: int) -> str:
    """One mark of the fold: rolls r, pins standing s, readable k."""
    pin = f"CASE WHEN t[{i}] = '/' THEN CASE WHEN len(r) > 0 THEN s END ELSE {_PIN.format(i=i)} END"
    return f"""
a{i} AS (SELECT *, {pin} AS p{i} FROM s{i - 1}),
b{i} AS (SELECT *, CASE WHEN t[{i}] = '/' OR (p{i} = 10 AND s = 10) THEN 0 ELSE s - p{i} END AS l{i} FROM a{i}),
s{i} AS (SELECT * EXCLUDE (r, s, k, p{i}, l{i}),
  CASE WHEN len(t) < {i} OR p{i} IS NULL THEN r ELSE list_append(r, p{i}) END AS r,
  CASE WHEN len(t) < {i} THEN s WHEN l{i} = 0 THEN 10 ELSE coalesce(l{i}, s) END AS s,
  CASE WHEN len(t) < {i} THEN k ELSE k AND p{i} IS NOT NULL AND coalesce(l{i}, 0) >= 0 END AS k FROM b{i})"""


PARSED = (
    GAMES
    + """,
s0 AS (SELECT *, regexp_extract_all(text, '([0-9]o|.)', 1) AS t, CAST([] AS INT[]) AS r, 10 AS s, true AS k FROM g),"""
    + ",".join(_step(i) for i in range(1, 5))
    + """,
p AS (SELECT user_id, game, frame, text, printed_off, t AS tokens, k AS readable, CASE WHEN k THEN r ELSE CAST([] AS INT[]) END AS rolls,
        len(list_filter(t, lambda x: x LIKE '%o')) > 0 AS split FROM s4),
q AS (SELECT *, len(rolls) > 0 AS played, coalesce(CASE WHEN len(rolls) = 0 THEN false WHEN frame < 10 THEN rolls[1] = 10 OR len(rolls) >= 2
        WHEN rolls[1] = 10 OR rolls[1] + rolls[2] = 10 THEN len(rolls) >= 3 ELSE len(rolls) >= 2 END, false) AS complete FROM p)"""
)

SCORED = (
    PARSED
    + """,
h AS (SELECT *, flatten(list(rolls) OVER (PARTITION BY user_id, game ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ahead FROM q),
j AS (SELECT *, CASE WHEN NOT played THEN NULL
  WHEN frame = 10 THEN CASE WHEN complete THEN list_sum(rolls) END
  WHEN rolls[1] = 10 THEN 10 + ahead[2] + ahead[3] WHEN rolls[1] + rolls[2] = 10 THEN 10 + ahead[3] ELSE rolls[1] + rolls[2] END AS points FROM h),
c AS (SELECT *, bool_and(points IS NOT NULL) OVER w AS settled, sum(points) OVER w AS running FROM j WINDOW w AS (PARTITION BY user_id, game ORDER BY frame)),
f AS (SELECT user_id, game, frame, text, printed_off, rolls, readable, split, played, complete,
  CAST(CASE WHEN settled THEN points END AS INT) AS frame_score, CAST(CASE WHEN settled THEN running END AS INT) AS cumulative FROM c)"""
)

TOTALS = (
    SCORED
    + """,
u AS (SELECT user_id, game, max_by(cumulative, frame) FILTER (cumulative IS NOT NULL) AS total,
  min_by(CASE WHEN rolls[1] = 10 OR coalesce(rolls[1] + rolls[2] = 10, false) THEN 0 ELSE list_sum(rolls) END, frame) FILTER (cumulative IS NULL AND played) AS more FROM f GROUP BY user_id, game),
v AS (SELECT user_id, game, total, CAST(CASE WHEN total IS NOT NULL OR coalesce(total, 0) + coalesce(more, 0) <> 0 THEN coalesce(total, 0) + coalesce(more, 0) END AS INT) AS provisional_total FROM u)"""
)

CHECKED = (
    SCORED
    + """,
x AS (SELECT *, cumulative + printed_off AS printed_raw, cumulative IS NOT NULL AS checked, coalesce(printed_off <> 0 AND cumulative IS NOT NULL, false) AS mismatched FROM f)"""
)


def _throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.throws(table(spark, sf_dir, "events"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.parse(_throws(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_parsed(spark, sf_dir), KEYS)


def _checked(spark: SparkSession, sf_dir: str, repair: bool = True) -> DataFrame:
    return scoring.cross_check(_scored(spark, sf_dir).withColumn("printed", F.col("cumulative") + F.col("printed_off")), repair)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id >= 7 AND (event_id - 7) % 5 = 0 ORDER BY event_id LIMIT 500")
def sample_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systematic sample: every fifth event from the seventh on, 500 at most."""
    from tenfold.sources.frames import sampled

    return sampled(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", every=5, start=7, limit=500)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenfold.sources.frames import one

    return one(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", 42)


@query("SELECT '/events' AS path, CAST(max(event_id) + 1 AS INT) AS n_frames, 25.0::DOUBLE AS fps, round((max(event_id) + 1) / 25.0::DOUBLE, 2) AS duration_s FROM events")
def probe_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenfold.sources.frames import probed

    return probed(table(spark, sf_dir, "events"), "event_id", "/events", 25.0)


SEGMENTS = [("board", 30), ("pins", 10), ("board_late", 20), ("inset_late", 15), ("board_late", 25)]


@query("""SELECT event_id, event_id % 110 AS frame_index, CASE WHEN event_id % 110 < 30 THEN 'board' WHEN event_id % 110 < 40 THEN 'pins' WHEN event_id % 110 < 60 THEN 'board_late'
  WHEN event_id % 110 < 75 THEN 'inset_late' WHEN event_id % 110 < 100 THEN 'board_late' ELSE 'past_end' END AS kind FROM events""")
def segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join of frames with segments laid end to end."""
    from tenfold.sources.frames import in_segments

    frames = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 110).alias("frame_index"))
    return in_segments(frames, SEGMENTS).select("event_id", "frame_index", "kind")


@query(f"WITH {PARSED} SELECT user_id, game, frame, text, array_to_string(tokens, ' ') AS tokens, len(tokens)::INT AS n_tokens, split FROM q")
def tokenize_throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir)
    return p.select("user_id", "game", "frame", "text", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens"), "split")


@query(f"WITH {GAMES} SELECT user_id, game, frame, regexp_replace(text, '([0-9])o', '(\\1)', 'g') AS shown FROM g")
def pretty_throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _throws(spark, sf_dir).select("user_id", "game", "frame", T.shown(F.col("text")).alias("shown"))


@query("SELECT event_id, CASE WHEN regexp_full_match(trim(s), '[0-9]+') THEN trim(s)::INT END AS number FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || user_id || ' ' WHEN 1 THEN '-' || user_id WHEN 2 THEN '' ELSE user_id || 'x' END AS s FROM events)")
def parse_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, m = F.col("user_id").cast("string"), F.col("event_id") % 4
    s = F.when(m == 0, F.concat(F.lit(" "), u, F.lit(" "))).when(m == 1, F.concat(F.lit("-"), u)).when(m == 2, "").otherwise(F.concat(u, F.lit("x")))
    return table(spark, sf_dir, "events").select("event_id", T.whole_number(s).alias("number"))


@query(f"WITH {PARSED} SELECT user_id, game, frame, array_to_string(rolls, ',') AS rolls, readable, split, played, complete FROM q")
def parse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select(*KEYS, "frame", F.array_join(F.col("rolls").cast("array<string>"), ",").alias("rolls"), "readable", "split", "played", "complete")


@query(f"WITH {SCORED} SELECT user_id, game, frame, frame_score, cumulative FROM f")
def score_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(*KEYS, "frame", "frame_score", "cumulative")


@query(f"WITH {TOTALS} SELECT * FROM v")
def pending_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled and shown total of every game."""
    return scoring.totals(_scored(spark, sf_dir), KEYS)


@query(f"WITH {CHECKED} SELECT user_id, game, CAST(count(*) FILTER (checked) AS BIGINT) AS checked, CAST(count(*) FILTER (mismatched) AS BIGINT) AS mismatched, coalesce((count(*) FILTER (checked) - count(*) FILTER (mismatched))::DOUBLE / nullif(count(*) FILTER (checked), 0), 1.0) AS agreement FROM x GROUP BY user_id, game")
def rule_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed against computed totals of each game."""
    c = _checked(spark, sf_dir).groupBy(*KEYS).agg(F.count_if("checked").alias("checked"), F.count_if("mismatched").alias("mismatched"))
    return c.withColumn("agreement", T.agreement(F.col("checked"), F.col("mismatched")))


@query(f"WITH {CHECKED} SELECT user_id, game, frame, printed_raw::INT AS printed_raw, CASE WHEN mismatched THEN cumulative ELSE printed_raw END::INT AS printed, mismatched AS repaired FROM x")
def repair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select(*KEYS, "frame", F.col("printed_raw").cast("int"), F.col("printed").cast("int"), "repaired")


@query(
    f"""WITH {TOTALS}, k AS (SELECT user_id, count(DISTINCT game) AS games, CAST(count(*) FILTER (NOT readable) AS BIGINT) AS unreadable, CAST(count(*) FILTER (split) AS BIGINT) AS splits,
  CAST(count(*) FILTER (len(rolls) > 0 AND rolls[1] = 10) AS BIGINT) AS strikes FROM f GROUP BY user_id), b AS (SELECT user_id, max(provisional_total) AS best, avg(total) AS mean_total FROM v GROUP BY user_id)
  SELECT k.*, best, mean_total FROM k JOIN b USING (user_id)"""
)
def game_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    k = scored.groupBy("user_id").agg(
        F.count_distinct("game").alias("games"), F.count_if(~F.col("readable")).alias("unreadable"), F.count_if("split").alias("splits"), F.count_if(F.get("rolls", F.lit(0)) == 10).alias("strikes")
    )
    best = scoring.totals(scored, KEYS).groupBy("user_id").agg(F.max("provisional_total").alias("best"), F.avg("total").alias("mean_total"))
    return k.join(best, "user_id")


@query(
    f"""WITH {TOTALS}, r AS (SELECT user_id, game, max(frame) AS last_frame, array_to_string(list(frame ORDER BY frame) FILTER (printed_off <> 0 AND cumulative IS NOT NULL), ',') AS mismatched_frames,
  count(*) FILTER (cumulative IS NOT NULL) AS checked FROM f GROUP BY user_id, game)
  SELECT user_id, game, CAST(last_frame AS INT) AS last_frame, coalesce(mismatched_frames, '') AS mismatched_frames, CAST(checked AS BIGINT) AS checked, total, provisional_total, provisional_total + user_id % 2 = provisional_total AS total_agrees FROM r JOIN v USING (user_id, game)"""
)
def player_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite: nested frames, totals, mismatches and the row total's check."""
    p = _players(spark, sf_dir)
    last = F.array_max(F.transform("frames", lambda f: f["frame"]))
    return p.select(*KEYS, last.alias("last_frame"), F.array_join(F.col("mismatched_frames").cast("array<string>"), ",").alias("mismatched_frames"), "checked", "total", "provisional_total", "total_agrees")


def _players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with printed totals that are off where printed_off says, and row totals off by user_id % 2."""
    scored = _scored(spark, sf_dir).withColumn("printed", F.col("cumulative") + F.col("printed_off"))
    return scoring.agreed(scoring.player_rows(scored, KEYS).withColumn("printed_total", F.col("provisional_total") + F.col("user_id") % 2))


@query(f"""WITH {GAMES}, c AS (SELECT DISTINCT user_id // 4 AS board, game FROM g), s AS (SELECT c.*, p.id::INT AS player, f.id::INT AS frame FROM c, range(4) p(id), range(1, 11) f(id))
SELECT s.board, s.game, player, s.frame, coalesce(text, '') AS throws, '' AS score FROM s LEFT JOIN g ON g.user_id // 4 = s.board AND g.user_id % 4 = player AND g.game = s.game AND g.frame = s.frame""")
def scaffold_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings on the grids of all cells: a board for each game of four users."""
    g = _throws(spark, sf_dir).withColumn("board", F.floor(F.col("user_id") / 4).cast("long"))
    readings = g.select("board", "game", F.format_string("p%d.f%d.throws", F.col("user_id") % 4, "frame").alias("key"), "text")
    return scoring.scaffold(readings, board=["board", "game"])


OBSERVED = """o AS (SELECT user_id AS key, floor(epoch(ts) / 3600)::BIGINT AS frame_index, event_type AS text, (event_id % 100) / 100.0::DOUBLE AS confidence, event_id AS pos FROM events)"""


def _vote_sql(tail: int) -> str:
    return f"""WITH {OBSERVED}, n AS (SELECT coalesce(min(frame_index), 0) AS cutoff FROM (SELECT DISTINCT frame_index FROM o ORDER BY frame_index DESC LIMIT {tail})),
t AS (SELECT o.*, frame_index >= cutoff AS recent, bool_or(frame_index >= cutoff) OVER (PARTITION BY key) AS any_recent FROM o, n),
w AS (SELECT key, text, sum(0.1 + confidence) AS w, avg(confidence) AS confidence, min(pos) AS a, max(pos) AS z FROM t WHERE recent OR NOT any_recent GROUP BY key, text),
s AS (SELECT *, w / sum(w) OVER (PARTITION BY key) AS share, count(*) OVER (PARTITION BY key) AS texts, row_number() OVER (PARTITION BY key ORDER BY w DESC, a) AS heavy, row_number() OVER (PARTITION BY key ORDER BY z DESC) AS late FROM w),
u AS (SELECT key, max(share) FILTER (heavy = 1) < 0.3 AND max(texts) > 1 AS unclear FROM s GROUP BY key),
c AS (SELECT key, count(*) AS n FROM o GROUP BY key), fs AS (SELECT key, text, min_by(frame_index, pos) AS first_seen FROM o GROUP BY key, text)
SELECT s.key, s.text, round(confidence, 6) AS confidence, round(share, 6) AS share, n AS n_observations, first_seen FROM s JOIN u USING (key) JOIN c USING (key) JOIN fs USING (key, text)
WHERE CASE WHEN unclear THEN late = 1 ELSE heavy = 1 END"""


def _vote(spark: SparkSession, sf_dir: str, tail: int) -> DataFrame:
    o = derived.observations(table(spark, sf_dir, "events"))
    v = fusion.vote(o, fusion.tail_cutoff(o, tail))
    return v.withColumn("confidence", F.round("confidence", 6)).withColumn("share", F.round("share", 6))


@query(_vote_sql(48))
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vote(spark, sf_dir, 48)


@query(_vote_sql(3))
def weighted_vote_short_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few cells have a reading in so short a tail; the others vote with all."""
    return _vote(spark, sf_dir, 3)


@query(f"WITH {OBSERVED} SELECT min(frame_index) AS cutoff FROM (SELECT DISTINCT frame_index FROM o ORDER BY frame_index DESC LIMIT 12)")
def tail_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.tail_cutoff(derived.observations(table(spark, sf_dir, "events")))


@query(
    f"""WITH {OBSERVED}, a AS (SELECT *, CASE WHEN text = lag(text) OVER w THEN 0 ELSE 1 END AS change FROM o WINDOW w AS (PARTITION BY key ORDER BY pos)),
b AS (SELECT *, sum(change) OVER (PARTITION BY key ORDER BY pos) AS run FROM a),
c AS (SELECT *, row_number() OVER w AS n, first_value(frame_index) OVER w AS onset FROM b WINDOW w AS (PARTITION BY key, run ORDER BY pos)),
d AS (SELECT *, lag(text, 1, '') OVER (PARTITION BY key ORDER BY pos) AS old FROM c WHERE n = 2)
SELECT key, frame_index, onset, old, text AS "new" FROM d WHERE old <> text"""
)
def value_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.transitions(derived.observations(table(spark, sf_dir, "events")))


@query(
    f"""WITH {OBSERVED}, a AS (SELECT *, CASE WHEN text = lag(text) OVER w THEN 0 ELSE 1 END AS change FROM o WINDOW w AS (PARTITION BY key ORDER BY pos)),
b AS (SELECT *, sum(change) OVER (PARTITION BY key ORDER BY pos) AS run FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY pos) AS n FROM b),
d AS (SELECT *, lag(text, 1, '') OVER (PARTITION BY key ORDER BY pos) AS old FROM c WHERE n = 2)
SELECT key::VARCHAR AS key, frame_index, old, text AS "new" FROM d WHERE old <> text"""
)
def streaming_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes from a stream over the events files."""
    from tenfold.sources.shared import folder
    from tenfold.streaming import changes

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return changes.run(changes.transitions(derived.observations(events)), folder(spark, "stream"))


@query("""WITH a AS (SELECT user_id, event_id, value > 50 AS hot, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
b AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM a WHERE hot)
SELECT user_id, min(pos) AS start, max(pos) + 1 AS "end" FROM b GROUP BY user_id, island""")
def run_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 50).alias("hot"))
    e = e.withColumn("pos", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))
    return fusion.runs(e, ["user_id"], "pos", "hot")


@query(f"WITH {OBSERVED} SELECT key, text, min(frame_index) AS first_seen FROM o GROUP BY key, text")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.first_seen(derived.observations(table(spark, sf_dir, "events")))


@query(f"WITH {OBSERVED} SELECT DISTINCT frame_index FROM o")
def noted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.noted(derived.observations(table(spark, sf_dir, "events")))


@query("""WITH f AS (SELECT count(*) AS frames_total, count(*) FILTER (event_type <> 'error') AS frames_with_board, count(*) FILTER (event_type = 'click') AS frames_occluded, max(event_id) FILTER (event_type <> 'error') AS last_board_frame FROM events),
r AS (SELECT avg(c) FILTER (t <> '') AS m, avg(c) FILTER (t <> '' AND k NOT LIKE 'title.%') AS cc FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'title.lane' ELSE 'p0' END AS k, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS t, (event_id % 100) / 100.0::DOUBLE AS c FROM events)),
k AS (SELECT count(*) FILTER (event_id % 3 = 0) AS n, count(*) FILTER (event_id % 15 = 0) AS bad FROM events)
SELECT f.*, round(frames_with_board::DOUBLE / frames_total, 6) AS detection_rate, round(m, 6) AS mean_glyph_confidence, round(cc, 6) AS cell_confidence, n AS frames_checked, round((n - bad)::DOUBLE / n, 6) AS rules_agreement FROM f, r, k""")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    counts = fusion.counters(e.select(i.alias("frame_index"), (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "click").alias("occluded")))
    readings = e.select(F.when(i % 9 == 0, "title.lane").otherwise("p0").alias("key"), F.when(i % 4 == 0, "").otherwise(F.col("event_type")).alias("text"), (i % 100 / 100.0).alias("confidence"))
    q = fusion.quality(counts, readings, e.select((i % 3 == 0).alias("checked"), (i % 15 == 0).alias("mismatched")))
    return q.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in q.dtypes))


@query("""WITH b AS (SELECT vec_id AS tid, label::VARCHAR AS label, embedding AS v FROM embeddings WHERE vec_id < 30), q AS (SELECT vec_id AS glyph_id, embedding AS v FROM embeddings WHERE vec_id >= 30),
d AS (SELECT glyph_id, label, tid, list_sum(list_transform(list_zip(q.v, b.v), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / len(q.v) AS d FROM q, b),
l AS (SELECT glyph_id, label, min(d) AS d, min_by(tid, (d, tid)) AS tid FROM d GROUP BY glyph_id, label),
r AS (SELECT *, coalesce(lead(d) OVER w, 1.0) AS o, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY glyph_id ORDER BY d, tid))
SELECT glyph_id, label, round(greatest(0, least(1, (o - d) / (o + d + 1e-6))), 6) AS confidence, round(d, 6) AS distance FROM r WHERE n = 1""")
def knn_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest template and margin of every vector."""
    n = matching.nearest(*derived.glyphs(table(spark, sf_dir, "embeddings")), farthest=None)
    return n.withColumn("confidence", F.round("confidence", 6)).withColumn("distance", F.round("distance", 6))


@query("""WITH p AS (SELECT user_id, (event_id * 13) % 200 AS cx, event_id, upper(left(event_type, 1)) AS label, (event_id % 100) / 100.0::DOUBLE AS c FROM events),
q AS (SELECT user_id, cx, event_id, CASE WHEN c < 0.35 THEN '?' ELSE label END AS l, CASE WHEN c < 0.35 THEN 0 ELSE c END AS c FROM p)
SELECT user_id, string_agg(l, '' ORDER BY cx, event_id) AS text, round(avg(c), 6) AS confidence FROM q GROUP BY user_id""")
def cell_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.cells(_letters(spark, sf_dir), ["user_id"]).withColumn("confidence", F.round("confidence", 6))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("user_id", (i * 13 % 200).alias("cx"), i.alias("ix"), F.upper(F.substring("event_type", 1, 1)).alias("label"), (i % 100 / 100.0).alias("confidence"))


@query("""WITH p AS (SELECT user_id, (event_id * 13) % 200 AS cx, event_id, upper(left(event_type, 1)) AS l FROM events WHERE event_id % 100 >= 35)
SELECT user_id, coalesce(string_agg(l, '' ORDER BY cx, event_id) FILTER (cx < 25), '') AS lane, coalesce(string_agg(l, '' ORDER BY cx, event_id) FILTER (cx >= 25), '') AS bowler FROM p GROUP BY user_id""")
def title_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.titles(_letters(spark, sf_dir), ["user_id"], 200)


BOXES = """b AS (SELECT event_id, (event_id // 40)::INT AS f, event_id * 37 % 1300 AS x, event_id * 53 % 480 AS y, 60 + event_id % 80 AS w, 20 + event_id % 40 AS h FROM events),
o AS (SELECT (event_id // 40)::INT AS f, event_id * 29 % 1000 AS x, event_id * 31 % 300 AS y, 150 + event_id % 300 AS w, 80 + event_id % 150 AS h FROM events WHERE event_id % 40 IN (3, 17, 29))"""


@query(f"""WITH {BOXES} SELECT event_id, f AS frame_index FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.f = b.f AND
  greatest(0, least(b.x + b.w, o.x + o.w) - greatest(b.x, o.x)) * greatest(0, least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y)) / (b.w * b.h)::DOUBLE > 0.35)""")
def occlusion_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that no occluder of their frame covers."""
    return geometry.visible(*derived.boxes(table(spark, sf_dir, "events")), on=["frame_index"]).select("event_id", "frame_index")


@query("SELECT o_custkey, regr_slope(o_totalprice, o_orderkey) AS slope, regr_intercept(o_totalprice, o_orderkey) AS intercept FROM orders GROUP BY o_custkey".replace("regr_slope(o_totalprice, o_orderkey)", "round(regr_slope(o_totalprice, o_orderkey), 4)").replace("regr_intercept(o_totalprice, o_orderkey)", "round(regr_intercept(o_totalprice, o_orderkey), 2)"))
def anchor_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = geometry.fitted_line(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")
    return fit.select("o_custkey", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("SELECT o_custkey, median(gap)::DOUBLE AS median_gap FROM (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders) WHERE gap IS NOT NULL GROUP BY o_custkey")
def median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.median_gap(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")


@query("""WITH c AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS x FROM orders GROUP BY o_custkey),
i AS (SELECT o_custkey, x, unnest(range(1, len(x) + 1)) AS i FROM c), k AS (SELECT *, unnest(range(3, len(x) - i + 2)) AS k FROM i),
s AS (SELECT *, list_transform(range(i + 1, i + k), lambda j: x[j] - x[j - 1]) AS g FROM k), m AS (SELECT *, list_median(g) AS m FROM s),
e AS (SELECT * FROM m WHERE m > 0 AND len(list_filter(g, lambda v: abs(v - m) > 0.25 * m)) = 0), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC, i) AS n FROM e)
SELECT c.o_custkey, coalesce(array_to_string(r.x[r.i:r.i + r.k - 1], ','), '') AS run FROM c LEFT JOIN r ON c.o_custkey = r.o_custkey AND n = 1""")
def uniform_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest evenly spaced run among each customer's order keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [",".join(map(str, longest_uniform(x))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.string())], names=["o_custkey", "run"])

    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("x"))
    return c.mapInArrow(rows, c.select("o_custkey", F.lit("").alias("run")).schema)


@query("""WITH c AS (SELECT p.id AS p, f.id AS f FROM range(4) p(id), range(1, 11) f(id)), n AS (SELECT n_nationkey AS board, n_nationkey % 7 AS dx FROM nation),
a AS (SELECT board, 'p' || p || '.f' || f || '.throws' AS key, 'throws' AS role, p AS player, f AS frame, f * 100 + dx AS x, p * 120 + 40 AS y, 100 AS w, 60 AS h FROM c, n
 UNION ALL SELECT board, 'p' || p || '.f' || f || '.score', 'score', p, f, f * 100 + dx, p * 120 + 100, 100, 60 FROM c, n
 UNION ALL SELECT board, 'p' || p.id || '.initial', 'initial', p.id, NULL, dx, p.id * 120 + 40, 100, 60 FROM range(4) p(id), n
 UNION ALL SELECT board, 'p' || p.id || '.total', 'total', p.id, NULL, 1100 + dx, p.id * 120 + 100, 100, 60 FROM range(4) p(id), n)
SELECT board::INT AS board, key, role, player::INT AS player, frame::INT AS frame, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h FROM a""")
def board_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 88 cells of a board for each nation's edges."""
    n = table(spark, sf_dir, "nation")
    dx = F.col("n_nationkey") % 7
    edges = n.select(F.col("n_nationkey").alias("board"), F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: i * 100 + dx).alias("col_edges"), F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: i * 60 + 40).alias("row_edges"))
    return geometry.board_cells(edges).select("board", "key", "role", "player", "frame", "box.x", "box.y", "box.w", "box.h")


@query(None)
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clusters of all vectors in order of vec_id; order decides the result, so no SQL is given."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("role"))
    return calibrate.clusters(e, radius=0.13, least=4).select("cluster_id", "count", "roles")


@query(None)
def reduced_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centroids of each label's largest clusters."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "label", F.col("embedding").alias("vec"))
    return calibrate.reduced(e, radius=0.13)


@query("SELECT label, vec_id, rank::INT AS rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_sum(embedding::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 8")
def topk_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", size.alias("s"))
    return calibrate.top_per_label(e, "label", [F.desc("s"), "vec_id"], 8).select("label", "vec_id", "rank")


@query("SELECT vec_id AS cluster_id, CASE WHEN label < 6 THEN chr(65 + label) ELSE '' END AS label FROM embeddings")
def label_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with the labels typed for some of them."""
    typed = spark.createDataFrame([(i, chr(65 + i)) for i in range(6)], "code int, label string")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cluster_id"), F.col("label").alias("code"))
    labels = e.join(F.broadcast(typed), "code").select("cluster_id", "label")
    return calibrate.carried_labels(e.select("cluster_id"), labels)


@query("SELECT DISTINCT label FROM embeddings")
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label").distinct().orderBy("label")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {GAMES}, t AS (SELECT user_id, game, frame, text AS want, CASE WHEN frame % 4 = 0 THEN replace(text, '-', '') WHEN frame % 7 = 0 THEN NULL ELSE text END AS got FROM g)
SELECT want || ' -> ' || coalesce(got, '') AS error, count(*) AS n FROM t WHERE want <> coalesce(got, '') GROUP BY 1 ORDER BY n DESC, error LIMIT 12""")
def error_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent misreadings."""
    return report.errors(*_read_and_true(spark, sf_dir))


@query(f"""WITH {GAMES}, t AS (SELECT text AS want, CASE WHEN frame % 4 = 0 THEN replace(text, '-', '') WHEN frame % 7 = 0 THEN NULL ELSE text END AS got FROM g)
SELECT count(*) FILTER (want = coalesce(got, '')) AS "right", count(*) AS total, (count(*) FILTER (want = coalesce(got, '')))::DOUBLE / count(*) AS accuracy FROM t""")
def cell_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.accuracy(*_read_and_true(spark, sf_dir))


def _read_and_true(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    truth = _throws(spark, sf_dir).withColumn("key", F.concat_ws(".", "user_id", "game", "frame"))
    read = truth.filter("frame % 4 = 0 OR frame % 7 <> 0").select("key", F.when(F.col("frame") % 4 == 0, F.regexp_replace("text", "-", "")).otherwise(F.col("text")).alias("text"))
    return read, truth.select("key", "text")


_CSV = ", ".join(f"coalesce(max(text) FILTER (frame = {i}), '') AS f{i}_throws, coalesce(max(cumulative) FILTER (frame = {i})::VARCHAR, '') AS f{i}_total" for i in range(1, 11))


@query(f"""WITH {TOTALS}, w AS (SELECT user_id, game, {_CSV} FROM f GROUP BY user_id, game)
SELECT user_id::VARCHAR || '.' || game AS player, w.* EXCLUDE (user_id, game), coalesce(provisional_total::VARCHAR, '') AS total_shown, coalesce((provisional_total + user_id % 2)::VARCHAR, '') AS total_printed,
  CASE WHEN provisional_total IS NULL THEN '' WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS totals_agree FROM w JOIN v USING (user_id, game)""")
def csv_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat report: 24 columns a player."""
    return report.flat(_labelled_players(spark, sf_dir), "label")


def _labelled_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _players(spark, sf_dir).withColumn("label", F.concat_ws(".", "user_id", "game"))


_BODY = f"""WITH {TOTALS}, w AS (SELECT user_id, game, list({{'frame': frame, 'throws': text, 'rolls': rolls, 'split': split, 'complete': complete, 'frame_score': frame_score, 'running_total': cumulative, 'printed_total': cumulative}} ORDER BY frame) AS frames,
  coalesce(list(frame ORDER BY frame) FILTER (printed_off <> 0 AND cumulative IS NOT NULL), []) AS wrong, count(*) FILTER (cumulative IS NOT NULL) AS checked FROM f GROUP BY user_id, game)
SELECT user_id::VARCHAR || '.' || game AS initial, to_json({{'initial': user_id::VARCHAR || '.' || game, 'frames': frames, 'total_settled': total, 'total_shown': provisional_total, 'total_printed': provisional_total + user_id % 2,
  'total_agrees': provisional_total + user_id % 2 = provisional_total, 'mismatched_frames': wrong, 'repaired_frames': wrong, 'frame_agreement': round(coalesce((checked - len(wrong))::DOUBLE / nullif(checked, 0), 1.0), 4)}})::VARCHAR AS json FROM w JOIN v USING (user_id, game)"""


@query(_BODY)
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report of each player."""
    return report.nested(_labelled_players(spark, sf_dir), "label")


def _centre(text: str) -> str:
    return f"(repeat(' ', (7 - length({text})) // 2 + (7 - length({text})) % 2) || {text} || repeat(' ', (7 - length({text})) // 2))"


@query(f"""WITH {TOTALS}, m AS (SELECT *, regexp_replace(text, '([0-9])o', '(\\1)', 'g') AS marks, coalesce(cumulative::VARCHAR, '') AS n FROM f),
w AS (SELECT user_id, game, string_agg({_centre("marks")}, '|' ORDER BY frame) AS one, string_agg({_centre("n")}, '|' ORDER BY frame) AS two FROM m GROUP BY user_id, game),
lines AS (SELECT *, user_id::VARCHAR || '.' || game AS player, coalesce(provisional_total::VARCHAR, '') AS shown FROM w JOIN v USING (user_id, game))
SELECT player, ' ' || rpad(player, 3, ' ') || ' |' || one || '|' || {_centre("shown")} AS throws_line, '     |' || two || '|       ' AS totals_line FROM lines""")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two text lines of each player."""
    return report.text_rows(_labelled_players(spark, sf_dir), "label")
