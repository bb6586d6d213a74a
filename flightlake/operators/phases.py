"""Flight phases: painting by boundaries, and the landing state machine from runs of contact.

Touchdown is the first run of both main wheels that is long enough, rollout the first run of any
wheel from there on that is.  The end of the rollout depends on runs that exclude one another: slow rows,
and rows without contact.  Which of the two a row belongs to is told by the last row that can be
only one of them, so these are islands too.  All windows share one partitioning and one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import steps
from ..schema import CORE_PHASES, FULL_APPROACH_PHASES, LANDING, RECOVERY_PHASES
from .runs import mark_runs


def paint(time: Column, overlay: Column, flare: Column, transient_end: Column, maneuvering: Column, established: Column) -> Column:
    """The phase of a row: what would be painted last comes first; a null boundary paints nothing."""
    return (
        F.when(overlay.isNotNull(), overlay)
        .when(time >= flare, "FLARE")
        .when(time < transient_end, "INITIALIZATION_TRANSIENT")
        .when(time < maneuvering, "PRE_APPROACH_CIRCUIT")
        .when((time >= maneuvering) & (time < established), "APPROACH_MANEUVERING")
        .otherwise("FINAL_APPROACH_ESTABLISHED")
    )


def variant_masks(phase: Column, time: Column, transient_end: Column) -> dict[str, Column]:
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "initialization_transient": one(time < transient_end),
        "baseline_core": one(phase.isin(*CORE_PHASES)),
        "full_approach": one(phase.isin(*FULL_APPROACH_PHASES)),
        "recovery_ablation": one(phase.isin(*RECOVERY_PHASES)),
    }


def _on(c: str) -> Column:
    return F.coalesce(F.col(c) == 1, F.lit(False))


def landing_rows(df: DataFrame, keys: list[str], post_rollout_gap: str = "flare", cfg: dict = LANDING) -> DataFrame:
    """Adds the landing phase and the indexes it rests on to rows at or after the flare.

    df: keys, idx (without gaps), t, agl, gs, thr, left, right, nose (0/1 or null), already cut to the window; further
    columns are kept.  Adds candidate_idx, touchdown_idx, rollout_idx, complete_idx, complete_reason and phase (null: still in the flare).
    post_rollout_gap: rows between the rollout's first run and its end that belong to neither stay null
    with "flare" (as the published tables have them) and are ROLLOUT with "rollout".
    """
    w, whole = Window.partitionBy(*keys).orderBy("idx"), Window.partitionBy(*keys)
    so_far, i = w.rowsBetween(Window.unboundedPreceding, 0), F.col("idx")
    begins = lambda flag: F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    ends = lambda flag: F.col(flag) & ~F.coalesce(F.lead(flag).over(w), F.lit(False))
    first_of = lambda ok, x: F.min(F.when(ok, x)).over(whole)

    d = df.withColumns({"_main": _on("left") | _on("right"), "_both": _on("left") & _on("right"), "_any": _on("left") | _on("right") | _on("nose")})
    d = d.withColumns({"_step": F.col("t") - F.lag("t").over(w), "_bf": begins("_both"), "_af": begins("_any"), "_be": ends("_both"), "_ae": ends("_any")})
    d = d.withColumns({"_bs": F.last(F.when(F.col("_bf"), i), ignorenulls=True).over(so_far), "_as": F.last(F.when(F.col("_af"), i), ignorenulls=True).over(so_far)})
    d = d.withColumns({"_dt": F.coalesce(F.percentile("_step", F.lit(0.5)).over(whole), F.lit(0.1)), "candidate_idx": first_of(F.col("_main"), i)})
    long_both = F.col("_be") & (i - F.col("_bs") + 1 >= steps(cfg["touchdown_s"], F.col("_dt")))
    d = d.withColumn("touchdown_idx", first_of(long_both, F.col("_bs")))
    # contact from the touchdown on; a run that began before it is cut there
    cut = F.greatest("_as", "touchdown_idx")
    long_any = F.col("_ae") & (i >= F.col("touchdown_idx")) & (i - cut + 1 >= steps(cfg["rollout_s"], F.col("_dt")))
    d = d.withColumn("_ro", first_of(long_any, F.struct(cut.alias("start"), i.alias("end")))).withColumn("rollout_idx", F.col("_ro.start"))
    d = _rollout_end(d, w, whole, cfg)
    gap = F.lit("ROLLOUT") if post_rollout_gap == "rollout" else F.lit(None).cast("string")
    phase = (
        F.when(i >= F.col("complete_idx"), "COMPLETE")
        .when((i >= F.col("rollout_idx")) & (i <= F.col("_ro.end")), "ROLLOUT")
        .when(i >= F.col("rollout_idx"), gap)
        .when((i >= F.col("touchdown_idx")) & F.col("_any"), "TOUCHDOWN_CONFIRMED")
        .when(i >= F.col("touchdown_idx"), "BOUNCE")
        .when(F.col("_main"), "CONTACT_CANDIDATE")
    )
    return d.withColumn("phase", phase).drop("_step", "_bf", "_af", "_be", "_ae", "_bs", "_as", "_ro")


def _rollout_end(d: DataFrame, w, whole, cfg: dict, by_time: bool = False) -> DataFrame:
    """Adds complete_idx and complete_reason to rows of episodes with a rollout; runs last by their number of samples, or ``by_time``.

    From the rollout's start a run opens on a slow row or, failing that, on one without contact, and goes on while its own
    condition holds.  The first slow run that lasts ends the rollout at its start; so does one without contact that climbs with
    more speed or throttle.
    """
    slow, air = F.coalesce(F.col("gs") < cfg["complete_kt"], F.lit(False)), ~F.col("_any")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(slow & ~air, "slow").when(air & ~slow, "air").when(~slow & ~air, "none")
    d = d.withColumn("_k", F.when(F.col("idx") >= F.col("rollout_idx"), kind))
    # a row that could be of either run goes on with the run before it, and opens a slow one if there is none
    last = F.last("_k", ignorenulls=True).over(so_far)
    d = d.withColumn("_m", F.when(F.col("idx") >= F.col("rollout_idx"), F.when(last == "air", F.when(air, "air")).when(slow, "slow")))
    d = d.withColumns({"_opens": F.col("_m").isNotNull() & ~F.col("_m").eqNullSafe(F.lag("_m").over(w)), "_closes": F.col("_m").isNotNull() & ~F.col("_m").eqNullSafe(F.lead("_m").over(w))})
    d = d.withColumn("_s", F.last(F.when(F.col("_opens"), F.struct("idx", "t", "gs", "agl")), ignorenulls=True).over(so_far))
    n = F.col("idx") - F.col("_s.idx") + 1
    lasts = lambda s: F.col("t") - F.col("_s.t") >= s if by_time else n >= steps(s, F.col("_dt"))
    lifted = lasts(cfg["liftoff_s"]) & (F.col("agl") > F.col("_s.agl")) & ((F.col("gs") > F.col("_s.gs") + cfg["liftoff_gain_kt"]) | (F.col("thr") >= cfg["liftoff_throttle"]))
    reason = F.when((F.col("_m") == "slow") & lasts(cfg["complete_s"]), "groundspeed_below_threshold").when((F.col("_m") == "air") & lifted, "liftoff_after_rollout_touch_and_go")
    found = F.min(F.when(F.col("_closes") & reason.isNotNull(), F.struct(F.col("_s.idx").alias("idx"), reason.alias("reason")))).over(whole)
    d = d.withColumns({"_e": found, "_z": F.max("idx").over(whole)})
    rolled = F.col("rollout_idx").isNotNull()
    return d.withColumns({"complete_idx": F.when(rolled, F.coalesce("_e.idx", "_z")), "complete_reason": F.when(rolled, F.coalesce("_e.reason", F.lit("end_of_recording_window")))}).drop("_k", "_m", "_opens", "_closes", "_s", "_e", "_z")


def boundaries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per episode: times of the landing's boundaries, from ``landing_rows``."""
    at = lambda c: F.max(F.when(F.col("idx") == F.col(c), F.col("t")))
    return rows.groupBy(*keys).agg(
        F.min("t").alias("t_start_s"), F.max("t").alias("t_end_s"), F.coalesce(F.bool_or(F.col("touchdown_idx").isNotNull()), F.lit(False)).alias("touchdown_confirmed"),
        at("candidate_idx").alias("contact_candidate_s"), at("touchdown_idx").alias("touchdown_confirmed_s"), at("rollout_idx").alias("rollout_s"),
        at("complete_idx").alias("complete_s"), F.max("complete_reason").alias("complete_reason"),
    )


def contact_records(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Contacts that never confirmed and bounces: (keys, kind, start_s, end_s, duration_s, max_agl_ft_during_gap).

    The greatest height is that of the airborne gap: the one after an unconfirmed contact, the bounce itself.
    """
    before = F.coalesce(F.col("idx") < F.col("touchdown_idx"), F.lit(True))
    d = mark_runs(rows, keys, ["idx"], F.col("_main"), "_mr")
    # rows of a gap carry the number of the contact before it
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_cr", F.last("_mr", ignorenulls=True).over(w))
    touched = F.max(F.when(F.col("idx") == F.col("touchdown_idx"), F.lit(1))).over(Window.partitionBy(*keys, "_mr"))
    d = d.withColumn("_held", touched)
    mine = F.col("_mr").isNotNull()
    loose = d.where(before & F.col("_cr").isNotNull()).groupBy(*keys, "_cr").agg(
        F.min(F.when(mine, F.col("t"))).alias("start_s"), F.max(F.when(mine, F.col("t"))).alias("end_s"),
        (F.count_if(mine) * F.first("_dt")).alias("duration_s"), F.max(F.when(~mine, F.col("agl"))).alias("max_agl_ft_during_gap"),
        F.max(F.when(mine, F.col("_held"))).alias("_held"),
    )
    loose = loose.where("_held IS NULL").select(*keys, F.lit("unconfirmed_intermittent_contact").alias("kind"), "start_s", "end_s", "duration_s", "max_agl_ft_during_gap")
    b = mark_runs(rows, keys, ["idx"], F.col("phase") == "BOUNCE", "_b").where("_b IS NOT NULL").groupBy(*keys, "_b").agg(
        F.min("t").alias("start_s"), F.max("t").alias("end_s"), (F.count("*") * F.first("_dt")).alias("duration_s"), F.max("agl").alias("max_agl_ft_during_gap")
    )
    return loose.unionByName(b.select(*keys, F.lit("bounce").alias("kind"), "start_s", "end_s", "duration_s", "max_agl_ft_during_gap"))


def review_flags(rows: DataFrame, records: DataFrame, keys: list[str], cfg: dict = LANDING, flare: DataFrame | None = None) -> DataFrame:
    """(keys, flag) for people to look at: long loose contacts (one flag each), no contact, no touchdown, no rollout, no flare.

    flare: (keys, found) tells whether the height of the flare was reached.
    """
    loose = records.where((F.col("kind") == "unconfirmed_intermittent_contact") & (F.col("duration_s") >= cfg["long_candidate_s"]))
    long = loose.select(
        *keys,
        F.format_string(f"long_unconfirmed_CONTACT_CANDIDATE_interval: t=[%.2f,%.2f]s duration=%.2fs (>= diagnostic threshold {cfg['long_candidate_s']}s)", "start_s", "end_s", "duration_s").alias("flag"),
    )
    per = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("candidate_idx", "touchdown_idx", "rollout_idx")])
    flag = (
        F.when(F.col("candidate_idx").isNull(), "no_main_gear_contact_found_in_window")
        .when(F.col("touchdown_idx").isNull(), "touchdown_never_confirmed")
        .when(F.col("rollout_idx").isNull(), "window_ended_before_rollout_confirmed_after_touchdown")
    )
    out = long.unionByName(per.select(*keys, flag.alias("flag")).where("flag IS NOT NULL"))
    if flare is not None:
        out = out.unionByName(flare.where("NOT found").select(*keys, F.lit("flare_not_detected_via_agl_threshold_REVIEW_NEEDED").alias("flag")))
    return out


def transitions(rows: DataFrame, keys: list[str], cfg: dict = LANDING, values: tuple[str, ...] = ()) -> DataFrame:
    """(keys, previous_state, new_state, idx, t, values..., reason) for every change of state, at the row where it shows.

    A loose contact and a bounce end on their own last row, back in the flare.  values: columns of that row to carry along,
    such as height, speeds, wheels and compressions.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    p = F.coalesce("phase", F.lit("FLARE"))
    d = rows.withColumn("_p", p).withColumns({"_before": F.lag(p).over(w), "_after": F.lead(p).over(w)})
    i, new = F.col("idx"), lambda n, a, b, why, ok: F.when(ok, F.struct(F.lit(n).alias("place"), F.lit(a).alias("previous_state"), F.lit(b).alias("new_state"), why.alias("reason")))
    changed = ~F.col("_p").eqNullSafe(F.col("_before"))
    first = F.when(i == F.col("candidate_idx"), "first_main_gear_contact").otherwise("renewed_main_gear_contact_after_unconfirmed_loss")
    cand = (F.col("_p") == "CONTACT_CANDIDATE") & changed
    straight = (i == F.col("touchdown_idx")) & ~F.coalesce(F.col("_before") == "CONTACT_CANDIDATE", F.lit(False))
    lost = (F.col("_p") == "CONTACT_CANDIDATE") & F.coalesce(F.col("_after") == "FLARE", F.lit(True))
    lasted = lambda what, s: F.format_string(f"{what}_in_contact_for_%d_consecutive_samples(>={cfg[s]}s_at_dt=%.4fs)", steps(cfg[s], F.col("_dt")), F.col("_dt"))
    found = F.array_compact(
        F.array(
            new(0, "FLARE", "CONTACT_CANDIDATE", first, cand | straight),
            new(1, "CONTACT_CANDIDATE", "FLARE", F.lit("contact_lost_before_touchdown_confirmation_unconfirmed_intermittent_contact"), lost),
            new(2, "CONTACT_CANDIDATE", "TOUCHDOWN_CONFIRMED", lasted("both_main_gear", "touchdown_s"), i == F.col("touchdown_idx")),
            new(3, "TOUCHDOWN_CONFIRMED", "BOUNCE", F.lit("confirmed_main_gear_contact_lost"), (F.col("_p") == "BOUNCE") & changed),
            new(4, "BOUNCE", "FLARE", F.lit("bounce_recoverable_return_to_flare"), (F.col("_p") == "BOUNCE") & F.coalesce(F.col("_after") != "BOUNCE", F.lit(True))),
            new(5, "TOUCHDOWN_CONFIRMED", "ROLLOUT", lasted("any_gear", "rollout_s"), i == F.col("rollout_idx")),
            new(6, "ROLLOUT", "COMPLETE", F.col("complete_reason"), i == F.col("complete_idx")),
        )
    )
    return d.select(*keys, "idx", "t", *values, F.explode(found).alias("x")).select(*keys, "x.previous_state", "x.new_state", "idx", "t", *values, "x.reason")


def circuit_rows(df: DataFrame, keys: list[str], cfg: dict = LANDING) -> DataFrame:
    """The older segmenter, by times, on rows (keys, idx, t, agl, gs, thr, left, right, nose, ...) of one window per key.

    Adds candidate_idx, touchdown_idx, tier, rollout_idx, complete_idx and complete_reason, and what ``circuit_events`` needs.
    Touchdown is the first run that lasts of both main wheels, else of one of them, else of any wheel (as long
    as a rollout); the rollout is the first lasting run of any wheel from there, else the touchdown.  Runs that began before the
    first contact of a main wheel, or for the rollout before the touchdown, are cut there.  Without a touchdown there is no end.
    """
    w, whole = Window.partitionBy(*keys).orderBy("idx"), Window.partitionBy(*keys)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    flags = {"both": _on("left") & _on("right"), "main": _on("left") | _on("right"), "any": _on("left") | _on("right") | _on("nose")}
    here = F.struct("idx", "t")
    d = df.withColumns({f"_{k}": c for k, c in flags.items()})
    edge = lambda k, other: F.col(f"_{k}") & ~F.coalesce(other(f"_{k}").over(w), F.lit(False))
    d = d.withColumns({f"_{k}1": edge(k, F.lag) for k in flags} | {f"_{k}2": edge(k, F.lead) for k in flags})
    d = d.withColumns({f"_{k}s": F.last(F.when(F.col(f"_{k}1"), here), ignorenulls=True).over(so_far) for k in flags} | {"_c": F.min(F.when(F.col("_main"), here)).over(whole)})
    d = d.withColumns({f"_t{n}": F.min(F.when(_lasting(k, cfg[least], "_c"), F.greatest(f"_{k}s", "_c"))).over(whole) for n, (k, least) in enumerate(TIERS)})
    d = d.withColumns({"_td": F.coalesce("_t0", "_t1", "_t2"), "tier": F.when(F.col("_t0").isNotNull(), TIER_NAMES[0]).when(F.col("_t1").isNotNull(), TIER_NAMES[1]).when(F.col("_t2").isNotNull(), TIER_NAMES[2])})
    d = d.withColumn("_r", F.coalesce(F.min(F.when(_lasting("any", cfg["rollout_s"], "_td"), F.greatest("_anys", "_td"))).over(whole), "_td"))
    d = d.withColumns({"candidate_idx": F.col("_c.idx"), "touchdown_idx": F.col("_td.idx"), "rollout_idx": F.col("_r.idx")})
    short = [F.when(F.col(f"_{k}2") & (F.col("idx") >= F.col("_c.idx")) & ~_lasting(k, cfg[least], "_c") & F.coalesce(F.col("idx") < F.col(f"_t{n}.idx"), F.lit(True)) & F.coalesce(*[F.col(f"_t{m}") for m in range(n)], F.lit(None)).isNull(), TIER_NAMES[n]) for n, (k, least) in enumerate(TIERS)]
    d = d.withColumn("_bounced", F.array_compact(F.array(*short)))
    d = _rollout_end(d, w, whole, cfg, by_time=True)
    return d.drop(*[f"_{k}{x}" for k in flags for x in "12s"], "_c", "_td", "_r", "_t0", "_t1", "_t2", "_both", "_main", "_any")


#: The flags of the tiers with the time that a run of each must last, and the published names of the tiers.
TIERS = (("both", "touchdown_s"), ("main", "touchdown_s"), ("any", "rollout_s"))
TIER_NAMES = ("tier1_both_main_gear", "tier2_either_main_gear", "tier3_rollout_proxy_bouncy_landing")


def _lasting(k: str, least: float, cut: str) -> Column:
    """Whether a run that ends on this row, cut at ``cut``, lasts."""
    return F.coalesce(F.col(f"_{k}2") & (F.col("idx") >= F.col(f"{cut}.idx")) & (F.col("t") - F.greatest(f"_{k}s", cut)["t"] >= least), F.lit(False))


def circuit_landing(df: DataFrame, keys: list[str], cfg: dict = LANDING) -> DataFrame:
    """(keys, candidate_idx, touchdown_idx, tier, rollout_idx, complete_idx, complete_reason) of every key with a main wheel's contact."""
    got = circuit_rows(df, keys, cfg).where("candidate_idx IS NOT NULL")
    return got.groupBy(*keys).agg(*[F.min(c).alias(c) for c in ("candidate_idx", "touchdown_idx", "tier", "rollout_idx", "complete_idx", "complete_reason")])


def circuit_events(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event, idx, t, tier) of ``circuit_rows``: the boundaries, and a BOUNCE at the end of every run too short for the tier searched.

    A tier is searched up to the run that confirms it; the next one only if none does, so a contact may bounce in several.
    """
    at = lambda c, name: F.when(F.col("idx") == F.col(c), F.struct(F.lit(name).alias("event"), F.lit(None).cast("string").alias("tier")))
    marks = F.array_compact(F.array(at("candidate_idx", "CONTACT_CANDIDATE"), at("touchdown_idx", "TOUCHDOWN_CONFIRMED"), at("rollout_idx", "ROLLOUT"), at("complete_idx", "COMPLETE")))
    bounces = F.transform("_bounced", lambda x: F.struct(F.lit("BOUNCE").alias("event"), x.alias("tier")))
    return rows.select(*keys, "idx", "t", F.explode(F.concat(marks, bounces)).alias("x")).select(*keys, "x.event", "idx", "t", "x.tier")
