"""Queries on filtered angles, telemetry lines that do not parse, the tables behind plots, and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import protocol
from ..operators import gates, phases, plots, resample
from .telemetry import _A, _B, _BOUNDS, _LABELS, _WALK, DAY, SLOW, TEL, _painted, landing_input, query, r6, telemetry

_STEP = lambda x, c: f"{_B[0]!r} * {x} + {_B[1]!r} * f.x1{c} + {_B[2]!r} * f.x2{c} - ({_A[0]!r}) * f.y1{c} - ({_A[1]!r}) * f.y2{c}"


@query(
    "lowpass_heading",
    f"""WITH RECURSIVE {TEL}, h AS (SELECT user_id, idx, event_id, sin(radians(k * 3.6)) AS s, cos(radians(k * 3.6)) AS c FROM tel),
f AS (SELECT user_id, idx, event_id, s AS x1s, 0::DOUBLE AS x2s, {_B[0]!r} * s AS y1s, 0::DOUBLE AS y2s, c AS x1c, 0::DOUBLE AS x2c, {_B[0]!r} * c AS y1c, 0::DOUBLE AS y2c FROM h WHERE idx = 0
  UNION ALL SELECT h.user_id, h.idx, h.event_id, h.s, f.x1s, {_STEP("h.s", "s")}, f.y1s, h.c, f.x1c, {_STEP("h.c", "c")}, f.y1c FROM f JOIN h ON h.user_id = f.user_id AND h.idx = f.idx + 1)
SELECT user_id, event_id, round(sqrt(y1s * y1s + y1c * y1c), 4) AS length, CASE WHEN sqrt(y1s * y1s + y1c * y1c) > 0.01 THEN round(sin(atan2(y1s, y1c)), 4) + 0.0 END AS sine, CASE WHEN sqrt(y1s * y1s + y1c * y1c) > 0.01 THEN round(cos(atan2(y1s, y1c)), 4) + 0.0 END AS cosine FROM f""",
)
def lowpass_heading(spark, d):
    """A heading filtered as a unit vector; where the filtered vector is almost gone its direction means nothing and is left out."""
    e = telemetry(spark, d).withColumn("heading", F.col("k") * F.lit(3.6))
    e = e.withColumns({"s": F.sin(F.radians("heading")), "c": F.cos(F.radians("heading"))})
    f = resample.lowpass_many(_at_60_hz(e), ["user_id"], ["at", "event_id"], ["heading", "s", "c"], 4.0, angles=["heading"])
    length = F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c"))
    told = lambda x: F.when(length > 0.01, r6(x, 4) + F.lit(0.0))
    return f.select("user_id", "event_id", r6(length, 4).alias("length"), told(F.sin(F.radians("heading"))).alias("sine"), told(F.cos(F.radians("heading"))).alias("cosine"))


def _at_60_hz(e):
    """Rows of ``telemetry`` with even times: their places in sixtieths of a second."""
    from ..operators.runs import numbered

    return numbered(e, ["user_id"], "t", "event_id").withColumn("at", F.col("idx") / F.lit(60.0))


#: The fields of the lines made of ``events``; flag must be a whole number.
FIELDS, WHOLE = ["level", "k", "flag"], {"flag"}
_LINES = f"""{TEL}, l AS (SELECT user_id, event_id, CASE WHEN k % 31 = 0 THEN NULL ELSE value::VARCHAR || ',' || CASE WHEN k % 19 = 0 THEN 'x' WHEN k % 23 = 0 THEN '' ELSE k::VARCHAR END || ',' || CASE WHEN k % 13 = 0 THEN '0.5' ELSE (k % 2)::VARCHAR END || CASE WHEN k % 17 = 0 THEN ',0' ELSE '' END END AS line, k FROM tel),
why AS (SELECT *, CASE WHEN line IS NULL THEN 'no_line' WHEN length(line) - length(replace(line, ',', '')) <> 2 THEN 'field_count' WHEN try_cast(trim(split_part(line, ',', 2)) AS DOUBLE) IS NULL THEN 'not_a_number:k'
  WHEN NOT regexp_full_match(trim(split_part(line, ',', 3)), '[+-]?[0-9]+') THEN 'not_whole:flag' END AS reason FROM l)"""


def lines(spark, d):
    """Telemetry lines of ``events``: some missing, some with a field too many, one that is no number, or one that is not whole."""
    k = F.col("k")
    second = F.when(k % 19 == 0, "x").when(k % 23 == 0, "").otherwise(k.cast("string"))
    third = F.when(k % 13 == 0, "0.5").otherwise((k % 2).cast("string"))
    line = F.concat(F.col("value").cast("string"), F.lit(","), second, F.lit(","), third, F.when(k % 17 == 0, ",0").otherwise(""))
    return telemetry(spark, d).select("user_id", "event_id", F.when(k % 31 != 0, line).alias("value"))


@query("telemetry_rejects", f"WITH {_LINES} SELECT user_id, event_id, reason FROM why WHERE reason IS NOT NULL")
def telemetry_rejects(spark, d):
    return protocol.rejected(lines(spark, d), fields=FIELDS, whole=WHOLE).select("user_id", "event_id", "reason")


@query(
    "telemetry_error_counts",
    f"""WITH {_LINES} SELECT user_id, count(*) FILTER (reason IS NULL) AS n_received, count(reason) AS n_decode_errors, {", ".join(f"count(*) FILTER (starts_with(reason, '{r}')) AS {r}" for r in ("no_line", "field_count", "not_a_number", "not_whole"))} FROM why GROUP BY user_id""",
)
def telemetry_error_counts(spark, d):
    return protocol.error_counts(protocol.routed(lines(spark, d), fields=FIELDS, whole=WHOLE), ["user_id"])


@query(
    "signal_decimation",
    f"""WITH {TEL}, s AS (SELECT user_id, min(t) AS t0, (max(t) - min(t)) / 12.0::DOUBLE AS w FROM tel GROUP BY user_id), v AS (SELECT user_id, t, 'value' AS column_name, value AS v FROM tel UNION ALL SELECT user_id, t, 'k', k FROM tel),
b AS (SELECT v.*, CASE WHEN w = 0 THEN 0 ELSE least(11, floor((t - t0) / w)) END::INTEGER AS bucket FROM v JOIN s USING (user_id))
SELECT user_id, column_name, bucket, round(min(t), 6) AS t_start, round(max(t), 6) AS t_end, min(v) AS low, max(v) AS high, count(*) AS n FROM b GROUP BY ALL""",
)
def signal_decimation(spark, d):
    got = plots.decimated(telemetry(spark, d), ["user_id"], "t", ["value", "k"], 12)
    return got.withColumns({"t_start": r6("t_start"), "t_end": r6("t_end")})


@query(
    "phase_spans",
    f"""WITH {TEL}, {_BOUNDS}, c AS (SELECT *, coalesce(phase IS DISTINCT FROM lag(phase) OVER w OR row_number() OVER w = 1, true)::INTEGER AS new FROM painted WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS span FROM c)
SELECT user_id, span::BIGINT AS span, phase, round(min(t), 6) AS t_start, round(max(t), 6) AS t_end, count(*) AS n FROM g GROUP BY user_id, span, phase""",
)
def phase_spans(spark, d):
    got = plots.phase_spans(_painted(spark, d), ["user_id"], ["t", "event_id"], "phase")
    return got.withColumns({"span": F.col("span").cast("long"), "t_start": r6("t_start"), "t_end": r6("t_end")})


# ---- gates ------------------------------------------------------------------------------------------

_GATES = f"""dirty AS (SELECT lab.user_id, lab.idx, floor(lab.t / {DAY}) AS day, CASE WHEN lab.idx % 50 = 7 THEN 'CONTACT_CANDIDATE' ELSE phase END AS phase, main, l AND r AS mains, td, CASE WHEN lab.user_id % 5 = 0 THEN td - 1 ELSE ro END AS ro, e.done, dt
  FROM lab JOIN fl USING (user_id, event_id) JOIN dt ON dt.user_id = lab.user_id LEFT JOIN td ON td.user_id = lab.user_id LEFT JOIN ro ON ro.user_id = lab.user_id LEFT JOIN e ON e.user_id = lab.user_id),
ahead AS (SELECT *, coalesce(min(idx) FILTER (NOT mains) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(idx) OVER (PARTITION BY user_id) + 1) - idx AS held, day - lag(day) OVER (PARTITION BY user_id ORDER BY idx) AS apart FROM dirty)"""


@query(
    "gate_counts",
    f"""{_WALK}, {_LABELS}, {_GATES}
SELECT user_id, 'rising' AS rule, count(*) AS n FROM ahead WHERE apart <= 0 GROUP BY user_id
UNION ALL SELECT user_id, 'order', count(*) FROM ahead WHERE ro < td OR done < ro GROUP BY user_id
UNION ALL SELECT user_id, 'nose', count(*) FROM ahead WHERE phase = 'CONTACT_CANDIDATE' AND NOT main GROUP BY user_id
UNION ALL SELECT user_id, 'touchdown', count(*) FROM ahead WHERE idx = td AND held < greatest(1, ceil(round_even({2 * SLOW["touchdown_s"]}::DOUBLE / dt, 6))) GROUP BY user_id
UNION ALL SELECT user_id, 'bounce', count(*) FROM ahead WHERE phase = 'BOUNCE' AND (ro IS NULL OR ro < idx) GROUP BY user_id""",
)
def gate_counts(spark, d):
    """Broken rules of each user: days instead of times, touchdowns twice as long, and landing rows with planted faults of order and of wheels."""
    rows = phases.landing_rows(landing_input(spark, d), ["user_id"], cfg=SLOW).withColumn("day", F.floor(F.col("t") / DAY))
    rows = rows.withColumns({"phase": F.when(F.col("idx") % 50 == 7, "CONTACT_CANDIDATE").otherwise(F.col("phase")), "rollout_idx": F.when(F.col("user_id") % 5 == 0, F.col("touchdown_idx") - 1).otherwise(F.col("rollout_idx"))})
    rules = gates.recording_rules("day") | gates.landing_rules({**SLOW, "touchdown_s": 2 * SLOW["touchdown_s"]})
    return gates.counts(rows, ["user_id"], ["idx"], rules)
