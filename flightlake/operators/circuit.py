"""From the recording of a circuit to its episodes: windows around the longest airborne gap, a landing in each, the approach between.

Everything is told by windows over the recording's key, or over the key and its window, in the order of idx, so one
exchange by the key serves the whole chain and the episodes' aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schema import AIRBORNE_GAP, FINAL_APPROACH, LANDING, MANEUVERING
from .phases import _on, circuit_rows


def _first_run(flag: str, least_s: float, w, whole) -> list[tuple[str, Column]]:
    """Steps that add _at: where the first run of rows with ``flag`` begins that lasts."""
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    on = F.col(flag)
    return [
        ("_opens", F.when(on & ~F.coalesce(F.lag(flag).over(w), F.lit(False)), F.struct("idx", "t"))),
        ("_from", F.last("_opens", ignorenulls=True).over(so_far)),
        ("_closed", on & ~F.coalesce(F.lead(flag).over(w), F.lit(False)) & (F.col("t") - F.col("_from.t") >= least_s)),
        ("_at", F.min(F.when(F.col("_closed"), F.col("_from.idx"))).over(whole)),
    ]


def airborne_windows(df: DataFrame, keys: list[str], cfg: dict = AIRBORNE_GAP) -> DataFrame:
    """Adds gap_start_idx, gap_end_idx and window to rows (keys, idx, t, agl, left, right).

    The gap is the longest run of rows without a main wheel's contact above the height, if it lasts; the earliest of equal ones.  Its
    first row ends window 1, its last row begins window 2; rows between have none.  Without a gap all rows are window 1.
    """
    w, whole = Window.partitionBy(*keys).orderBy("idx"), Window.partitionBy(*keys)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_air", ~(_on("left") | _on("right")) & F.coalesce(F.col("agl") > cfg["agl_ft"], F.lit(False)))
    d = d.withColumn("_from", F.last(F.when(F.col("_air") & ~F.coalesce(F.lag("_air").over(w), F.lit(False)), F.struct("idx", "t")), ignorenulls=True).over(so_far))
    lasted = F.col("t") - F.col("_from.t")
    run = F.when(F.col("_air") & ~F.coalesce(F.lead("_air").over(w), F.lit(False)) & (lasted >= cfg["least_s"]), F.struct(lasted.alias("s"), (-F.col("_from.idx")).alias("start"), F.col("idx").alias("end")))
    d = d.withColumn("_gap", F.max(run).over(whole))
    d = d.withColumns({"gap_start_idx": -F.col("_gap.start"), "gap_end_idx": F.col("_gap.end")})
    window = F.when(F.col("_gap").isNull() | (F.col("idx") <= F.col("gap_start_idx")), 1).when(F.col("idx") >= F.col("gap_end_idx"), 2)
    return d.withColumn("window", window).drop("_air", "_from", "_gap")


def nearest_runway(heading: Column, runways: dict[str, G.Runway]) -> Column:
    """The id of the runway with the least heading error; the first by id of equal ones."""
    near = F.array_min(F.array(*[F.struct(F.abs(G.heading_error(heading, r.heading_deg)).alias("error"), F.lit(i).alias("id")) for i, r in sorted(runways.items())]))
    return F.when(heading.isNotNull(), near["id"])


def circuit_episodes(
    df: DataFrame, keys: list[str], runways: dict[str, G.Runway] = G.RUNWAYS, gap: dict = AIRBORNE_GAP, landing: dict = LANDING, preparing: dict = MANEUVERING, established: dict = FINAL_APPROACH
) -> DataFrame:
    """One row per window of every recording, as an episode.

    df: keys, idx (without gaps from 0), t, agl, gs, thr, left, right, nose, lat_deg, lon_deg, heading_deg, vertical_speed_fps, flaps.
    A window's runway is the one nearest in heading at its touchdown.  The first window's episode begins with the recording and ends with
    the landing; the second's begins where its approach is prepared, searched from the first landing's end to the second touchdown, or
    at the gap's end if that is earlier or nothing is found.  A recording without a gap is one episode from its first to its last row.
    A window without a touchdown is an episode that is not eligible, over the window's rows.
    """
    by_window = [*keys, "window"]
    w, whole, mine = Window.partitionBy(*keys).orderBy("idx"), Window.partitionBy(*keys), Window.partitionBy(*by_window)
    d = circuit_rows(airborne_windows(df, keys, gap), by_window, landing)
    at_touchdown = F.when(F.col("idx") == F.col("touchdown_idx"), nearest_runway(F.col("heading_deg"), runways))
    d = d.withColumn("_runway", F.max(at_touchdown).over(mine))
    of = lambda n, c: F.max(F.when(F.col("window") == n, F.col(c))).over(whole)
    d = d.withColumns({"_low": F.coalesce(of(1, "complete_idx"), F.lit(0)), "_high": of(2, "touchdown_idx"), "runway_id": of(2, "_runway"), "_candidate": of(2, "candidate_idx")})
    c = G.of_runway(runways)
    along, cross = G.along_cross(F.col("lat_deg"), F.col("lon_deg"), c)
    error = F.abs(G.heading_error(F.col("heading_deg"), c["heading"]))
    d = d.withColumn("_flaps", F.max(F.when(F.col("idx") == F.col("_low"), F.col("flaps"))).over(whole))
    between = F.col("idx").between(F.col("_low"), F.col("_high"))
    prepares = (error <= preparing["heading_deg"]) & ((F.col("vertical_speed_fps") < preparing["sink_fps"]) | (F.col("flaps") > F.col("_flaps") + preparing["flaps_more"]))
    aligned = (error <= established["heading_deg"]) & (F.abs(cross) <= established["cross_m"]) & (along <= established["along_m"]) & (F.col("vertical_speed_fps") * G.FPM_PER_FPS <= established["sink_fpm"])
    for name, ok, least in (("_am", prepares, preparing["least_s"]), ("_fa", aligned, established["least_s"])):
        d = d.withColumn("_ok", F.coalesce(between & ok, F.lit(False)))
        for step, column in _first_run("_ok", least, w, whole):
            d = d.withColumn(step, column)
        d = d.withColumn(name, F.col("_at")).drop("_ok", "_opens", "_from", "_closed", "_at")
    am = F.coalesce("_am", "gap_end_idx")
    fa = F.coalesce("_fa", am)
    low = F.col("idx").between(fa, F.col("_high")) & (F.col("agl") <= c["flare"])
    d = d.withColumn("_flare", F.coalesce(F.min(F.when(low, F.col("idx"))).over(whole), "_candidate"))

    gapped, second, landed = F.col("gap_end_idx").isNotNull(), F.col("window") == 2, F.col("touchdown_idx").isNotNull()
    only = ["candidate_idx", "touchdown_idx", "tier", "rollout_idx", "complete_idx", "complete_reason"]
    first, last = F.min("idx").over(mine), F.max("idx").over(mine)
    start = F.when(second & landed, F.least(am, F.col("gap_end_idx"))).otherwise(first)
    end = F.when(gapped & landed, F.col("complete_idx")).otherwise(last)
    d = d.withColumns({"_start": start, "_end": end, "_am2": am, "_fa2": fa})
    here = lambda i: F.max(F.when(F.col("idx") == F.col(i), F.col("t"))).over(whole)
    # the times of both windows' ends are taken over all rows: an approach begins on rows of no window
    for n in (1, 2):
        d = d.withColumns({f"_s{n}": of(n, "_start"), f"_e{n}": of(n, "_end")})
        d = d.withColumns({f"_ts{n}": here(f"_s{n}"), f"_te{n}": here(f"_e{n}")})
    per = d.where("window IS NOT NULL").groupBy(*by_window).agg(
        *[F.max(x).alias(x) for x in (*only, "gap_start_idx", "gap_end_idx", "_runway", "_am", "_fa", "_am2", "_fa2", "_flare", "_s1", "_s2", "_e1", "_e2", "_ts1", "_ts2", "_te1", "_te2")]
    )
    pick = lambda x: F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1"))
    approach = second & landed
    how = lambda x, other: F.when(approach, F.when(F.col(x).isNotNull(), "auto_detected").otherwise(f"not_detected_automatically_defaulted_to_{other}_REVIEW_NEEDED"))
    return per.select(
        *keys, "window", F.when(gapped, F.format_string("%s__landing-%02d", F.concat_ws("/", *keys), "window")).otherwise(F.concat_ws("/", *keys)).alias("episode_id"),
        landed.alias("eligible"), F.when(landed, "").otherwise("no_touchdown_found_in_window").alias("exclusion_reason"), F.col("_runway").alias("runway_id"),
        pick("_s").alias("raw_row_start"), pick("_e").alias("raw_row_end"), (pick("_e") - pick("_s") + 1).alias("n_samples_raw"), (pick("_te") - pick("_ts")).alias("duration_s_raw"),
        F.when(approach, F.col("_am2")).otherwise(pick("_s")).alias("full_approach_start_idx"), F.when(approach, F.col("_fa2")).otherwise(pick("_s")).alias("baseline_core_start_idx"),
        F.when(approach, F.col("_flare")).alias("flare_idx"), how("_am", "end_of_airborne_gap").alias("approach_maneuvering_detection"), how("_fa", "approach_maneuvering_start").alias("final_approach_established_detection"),
        (~approach & landed).alias("has_known_initialization_transient"), (approach & (F.col("_am").isNull() | F.col("_fa").isNull())).alias("manual_review_needed"), "gap_start_idx", "gap_end_idx", *only,
    )
