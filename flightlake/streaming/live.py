"""The streaming twin: decoded telemetry, latest sample per trigger, and the flight manager as keyed state.

The manager confirms a contact when its Nth sample arrives, never earlier; the batch form in
``operators.phases`` dates it back to the first.  Rows of one run are handled in the order of their
time within a micro-batch; a row that is older than the last one handled is dropped and counted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import RUNWAYS, Runway, constants
from ..functions.protocol import encode
from ..operators.carry import carried
from ..operators.safety import ENVELOPE, SATURATED_CYCLES, STALE_S, TRIM, outside
from ..schema import LANDING

# Most per cycle of each command and the output before the first (None: the first is the target), and the rollout's law.
PER_CYCLE = {"aileron": (0.2, 0.0), "rudder": (0.2, 0.0), "elevator": (0.2, 0.0), "throttle": (0.1, None)}
ROLLOUT = {"rudder_gain": 0.03, "rudder_most": 0.6, "brake_s": 4.0, "brake_most": 0.7, "stop_kt": 2.0, "stopped_s": 3.0}
RANGES = {"aileron": (-1.0, 1.0), "rudder": (-1.0, 1.0), "elevator": (-1.0, 1.0), "throttle": (0.0, 1.0)}
GLIDESLOPE_FLOOR_M = 50.0
GROUND = ("ROLLOUT", "COMPLETE")

#: phase, what ends it, the next phase, counters that are set then (to a number, or to another counter or signal), the reason.
#: Ends are signals of a sample, "no" before one for its absence, or (counter, its need).
TABLE = [
    ("FINAL_APPROACH_ESTABLISHED", "low", "FLARE", {}, "flare_height_reached"),
    ("FLARE", "main", "CONTACT_CANDIDATE", {"both": "both"}, "first_main_gear_contact"),
    ("CONTACT_CANDIDATE", ("both", "touchdown"), "TOUCHDOWN_CONFIRMED", {"any": "both"}, "both_main_gear_contact"),
    ("CONTACT_CANDIDATE", "no main", "FLARE", {"unconfirmed": "+1"}, "contact_lost_before_confirmation_unconfirmed_intermittent_contact"),
    ("TOUCHDOWN_CONFIRMED", ("any", "rollout"), "ROLLOUT", {"slow": 0}, "any_gear_contact"),
    ("TOUCHDOWN_CONFIRMED", "no contact", "BOUNCE", {"any": 0, "both": 0, "bounces": "+1"}, "confirmed_main_gear_contact_lost"),
    ("BOUNCE", "main", "CONTACT_CANDIDATE", {"both": "both"}, "renewed_main_gear_contact_after_bounce"),
    ("ROLLOUT", ("slow", "complete"), "COMPLETE", {}, "groundspeed_below_threshold"),
]
#: The signal whose samples in a row a phase counts, and the counter.
COUNTED = {"CONTACT_CANDIDATE": ("both", "both"), "TOUCHDOWN_CONFIRMED": ("contact", "any"), "ROLLOUT": ("slow", "slow")}
#: Phases that the same sample may go on from.
INSTANT = {"FINAL_APPROACH_ESTABLISHED"}


class Manager:
    """Phase of one run, sample by sample: a walk through TABLE; its state is a small dictionary that can be stored as JSON."""

    def __init__(self, dt: float, flare_agl_ft: float = 20.0, cfg: dict = LANDING, state: dict | None = None):
        self.flare, self.cfg, self.reason = flare_agl_ft, cfg, ""
        self.need = {k: max(1, math.ceil(round(cfg[f"{k}_s"] / dt, 6))) for k in ("touchdown", "rollout", "complete")}
        self.s = state or {"phase": "FINAL_APPROACH_ESTABLISHED", "both": 0, "any": 0, "slow": 0, "bounces": 0, "unconfirmed": 0}

    def step(self, agl: float, nose: bool, left: bool, right: bool, gs: float) -> str:
        s, self.reason = self.s, ""
        signals = {"low": agl <= self.flare, "main": left or right, "both": left and right, "contact": left or right or nose, "slow": gs < self.cfg["complete_kt"]}
        if s["phase"] in COUNTED:
            signal, counter = COUNTED[s["phase"]]
            s[counter] = s[counter] + 1 if signals[signal] else 0
        go_on = True
        while go_on:
            go_on = False
            for phase, end, then, counters, reason in TABLE:
                met = s[end[0]] >= self.need[end[1]] if isinstance(end, tuple) else not signals[end[3:]] if end.startswith("no ") else signals[end]
                if phase == s["phase"] and met:
                    new = {k: s[k] + 1 if v == "+1" else v if v == 0 else int(signals[v]) if k == v else s[v] for k, v in counters.items()}
                    go_on = phase in INSTANT
                    s.update(new, phase=then)
                    self.reason = reason
                    break
        return s["phase"]


def geometry(row: dict, r: Runway) -> dict:
    """The runway features of one sample."""
    c = constants(r)
    north, east = (row["lat_deg"] - c["lat"]) * c["per_lat"], (row["lon_deg"] - c["lon"]) * c["per_lon"]
    along, height = east * c["sin"] + north * c["cos"], row["alt_msl_ft"] - c["elevation"]
    return {
        "along_track_m": along,
        "cross_track_m": east * c["cos"] - north * c["sin"],
        "heading_error_deg": (row["heading_deg"] - c["heading"] + 180) % 360 - 180,
        "glideslope_error_deg": math.degrees(math.atan2(height * 0.3048, -along)) - c["glideslope"],
    }


def abort_reason(row: dict, saturated: dict[str, int], neural: bool = True) -> str:
    """What ends a run: of saturation, envelope and crash the last one counts; inside the envelope the first limit.

    The envelope holds only while the networks fly: slowing down on the ground is no fault.
    """
    reason = ""
    for channel, n in saturated.items():
        if n >= SATURATED_CYCLES:
            reason = f"{channel}_saturated"
    if neural:
        reason = next((name for name, column, kind, limit in ENVELOPE if outside(row[column], kind, limit)), reason)
    return "flightgear_reported_crashed" if row.get("crashed") else reason


def rollout_commands(elapsed: float, heading_error: float, gs: float) -> dict[str, float]:
    """Commands on the ground: idle, towards the centre line, brakes rising over the ramp and full once stopped."""
    rudder = max(-ROLLOUT["rudder_most"], min(ROLLOUT["rudder_most"], ROLLOUT["rudder_gain"] * heading_error))
    share = 1.0 if gs <= ROLLOUT["stop_kt"] else min(1.0, max(0.0, elapsed / ROLLOUT["brake_s"]))
    return {"aileron": 0.0, "elevator": 0.0, "rudder": rudder, "throttle": 0.0, "brake": ROLLOUT["brake_most"] * share}


#: Telemetry that every sample must have as finite numbers, and predictions, absent where no network ran.
NEEDED = [
    "sim_time", "lat_deg", "lon_deg", "alt_msl_ft", "alt_agl_ft", "heading_deg", "roll_deg", "pitch_deg", "airspeed_kt", "groundspeed_kt",
    "gear_wow_nose", "gear_wow_left", "gear_wow_right",
]
PREDICTED = {"aileron": "aileron_pred", "rudder": "rudder_pred", "elevator": "elevator_effective_pred", "throttle": "throttle_pred"}
FLAGS = ["crashed", "frozen"]
NOTHING = {"along_track_m": None, "cross_track_m": None, "heading_error_deg": None, "glideslope_error_deg": None}


class Replay:
    """All of one run's state: manager, held glideslope, saturation counters, readiness, rate limits, rollout, completion."""

    def __init__(self, state: dict | None, dt: float, runway: Runway):
        fresh = {"last_t": None, "manager": None, "glide": None, "saturated": {}, "ready": 0, "ready_t": None, "rollout_t": None, "sent": {c: first for c, (_, first) in PER_CYCLE.items()}, "stopped_t": None, "late": 0, "abort": "", "finished": False}
        self.s = state or fresh
        self.runway = runway
        self.manager = Manager(dt, runway.flare_agl_ft, state=self.s["manager"])

    def ready(self, row: dict) -> bool:
        """Five sane samples in a row with rising time; a repeated or insane one starts the count again."""
        s = self.s
        sane = row["sim_time"] > 0 and -90 <= row["lat_deg"] <= 90 and -180 <= row["lon_deg"] <= 180 and not row.get("frozen")
        if sane and (s["ready_t"] is None or row["sim_time"] > s["ready_t"]):
            s["ready"], s["ready_t"] = s["ready"] + 1, row["sim_time"]
        else:
            s["ready"] = 0
        return s["ready"] >= 5

    def commands(self, row: dict, phase: str, heading_error: float) -> tuple[dict, str]:
        """The commands of this cycle, and what is wrong with the networks' outputs."""
        s = self.s
        wanted = {c: row.get(p) for c, p in PREDICTED.items()}
        wrong = next((f"{net}_model_output_non_finite" for net, channels in (("lateral", ("aileron", "rudder")), ("longitudinal", ("elevator", "throttle"))) if any(wanted[c] is not None and not math.isfinite(wanted[c]) for c in channels)), "")
        if wrong:
            return {"aileron": None, "rudder": None, "elevator": None, "throttle": None, "brake": None}, wrong
        if wanted["elevator"] is not None:
            wanted["elevator"] = max(-1.0, min(1.0, wanted["elevator"] - TRIM))
        target = {}
        for c, (low, high) in RANGES.items():
            v = wanted[c]
            s["saturated"][c] = s["saturated"].get(c, 0) + 1 if v is not None and not low <= v <= high else 0
            target[c] = max(low, min(high, v)) if v is not None else 0.0
        if phase in GROUND:
            s["rollout_t"] = row["sim_time"] if s["rollout_t"] is None else s["rollout_t"]
            return rollout_commands(row["sim_time"] - s["rollout_t"], heading_error, row["groundspeed_kt"]), ""
        for c, (most, _) in PER_CYCLE.items():
            last = s["sent"][c]
            s["sent"][c] = target[c] if last is None else last + max(-most, min(most, target[c] - last))
        return {**s["sent"], "brake": 0.0}, ""

    def finished(self, row: dict, phase: str) -> bool:
        """Whether the run is complete: stopped for longer than ``stopped_s``."""
        s = self.s
        if phase != "COMPLETE" or row["groundspeed_kt"] >= ROLLOUT["stop_kt"]:
            s["stopped_t"] = None
        elif s["stopped_t"] is None:
            s["stopped_t"] = row["sim_time"]
        elif row["sim_time"] - s["stopped_t"] > ROLLOUT["stopped_s"]:
            s["finished"] = True
        return s["finished"]

    def handle(self, row: dict) -> dict | None:
        """The cycle of one sample; null for a sample that is no newer than the last."""
        s = self.s
        t = row["sim_time"]
        whole = all(row.get(c) is not None and math.isfinite(row[c]) for c in NEEDED)
        if not whole:  # nothing else is known of a broken sample, and no state moves on it
            s["abort"] = s["abort"] or "telemetry_contains_nan_or_inf"
            nothing = {c: None for c in (*RANGES, "brake")}
            return {"sim_time": t if t is not None and math.isfinite(t) else None, "phase": self.manager.s["phase"], "reason": "", **NOTHING, "ready": False, **nothing, "finished": s["finished"], "abort_reason": s["abort"], "late": s["late"]}
        ready = self.ready(row)
        if s["last_t"] is not None and t <= s["last_t"]:
            s["late"] += 1
            return None
        stale = s["last_t"] is not None and t - s["last_t"] > STALE_S
        s["last_t"] = t
        g = geometry(row, self.runway)
        if -g["along_track_m"] >= GLIDESLOPE_FLOOR_M:
            s["glide"] = g["glideslope_error_deg"]
        elif s["glide"] is not None:
            g["glideslope_error_deg"] = s["glide"]
        phase = self.manager.step(row["alt_agl_ft"], row["gear_wow_nose"] == 1, row["gear_wow_left"] == 1, row["gear_wow_right"] == 1, row["groundspeed_kt"])
        s["manager"] = self.manager.s
        commands, wrong = self.commands(row, phase, g["heading_error_deg"])
        reason = "telemetry_stale" if stale else wrong or abort_reason({**row, **g}, s["saturated"], phase not in GROUND)
        s["abort"] = s["abort"] or reason
        return {"sim_time": t, "phase": phase, "reason": self.manager.reason, **g, "ready": ready, **commands, "finished": self.finished(row, phase), "abort_reason": s["abort"], "late": s["late"]}


CYCLE = (
    "sim_time double, phase string, reason string, along_track_m double, cross_track_m double, heading_error_deg double, glideslope_error_deg double, ready boolean,"
    " aileron double, rudder double, elevator double, throttle double, brake double, finished boolean, abort_reason string, late long"
)
OUTPUT = f"run_id string, {CYCLE}"
_NAMES = [c.split()[0] for c in CYCLE.split(", ")]


def _cycles(r: Replay, pdf):
    """The rows that a replay makes of a frame, by columns; absent columns count as absent values."""
    import pandas as pd

    have = [c for c in (*NEEDED, *PREDICTED.values(), *FLAGS) if c in pdf.columns]
    columns = [pdf[c].astype("float64").tolist() for c in have]
    predicted = [i for i, c in enumerate(have) if c in PREDICTED.values() and pdf[c].isna().any()]
    for i in predicted:
        columns[i] = [None if absent else v for v, absent in zip(columns[i], pdf[have[i]].map(lambda x: x is None).tolist())]
    out = [x for values in zip(*columns) if (x := r.handle(dict(zip(have, values))))]
    return pd.DataFrame({"run_id": [pdf["run_id"].iloc[0]] * len(out), **{n: [x[n] for x in out] for n in _NAMES}})


def replay_batch(samples: DataFrame, dt: float = 0.1, runway: Runway = RUNWAYS["02"]) -> DataFrame:
    """The manager over stored samples (run_id and telemetry fields), its state carried along each run's rows."""

    def start():
        r = Replay(None, dt, runway)
        return lambda pdf: _cycles(r, pdf)

    used = [c for c in ("run_id", *NEEDED, *PREDICTED.values(), *FLAGS) if c in samples.columns]
    return carried(samples.select(*used), ["run_id"], ["sim_time", *[c for c in used if c not in ("run_id", "sim_time")]], start, OUTPUT)


def replay_stream(samples: DataFrame, dt: float = 0.1, runway: Runway = RUNWAYS["02"], idle_ms: int = 600_000, stale_ms: int | None = None) -> DataFrame:
    """The same over a stream, keyed by run_id; a run's state leaves ``idle_ms`` after its last sample.  Needs the RocksDB state store.

    stale_ms: for live streams, the processing time without a sample after which a run is ended as stale, with a row of its own.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("run", "json string")

        def _wake(self, at: int) -> None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            r = Replay(json.loads(self.state.get()[0]) if self.state.exists() else None, dt, runway)
            batch = pd.concat(list(rows)).sort_values("sim_time", kind="stable", na_position="first")
            out = _cycles(r, batch)
            self.state.update((json.dumps(r.s),))
            self._wake(timerValues.getCurrentProcessingTimeInMs() + (stale_ms or idle_ms))
            yield out

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            s = json.loads(self.state.get()[0]) if self.state.exists() else None
            if s is None or not stale_ms or s["abort"] or s["finished"]:
                self.state.clear()
                yield pd.DataFrame(columns=["run_id", *_NAMES])
                return
            s["abort"] = "telemetry_stale"
            self.state.update((json.dumps(s),))
            self._wake(timerValues.getCurrentProcessingTimeInMs() + idle_ms)
            row = {n: None for n in _NAMES} | {"sim_time": s["last_t"], "phase": (s["manager"] or {}).get("phase"), "reason": "", "ready": False, "finished": False, "abort_reason": s["abort"], "late": s["late"]}
            yield pd.DataFrame([{"run_id": key[0], **row}])

        def close(self) -> None:
            pass

    return samples.groupBy("run_id").transformWithStateInPandas(Processor(), OUTPUT, "Append", "ProcessingTime")


def touchdown_snapshot(cycles: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """(run_id, sim_time, cross_track_m, heading_error_deg, columns...): each run's first cycle with a confirmed touchdown, with values of its sample."""
    first = cycles.where("phase = 'TOUCHDOWN_CONFIRMED'").groupBy("run_id").agg(F.min_by(F.struct("sim_time", "cross_track_m", "heading_error_deg"), "sim_time").alias("x")).select("run_id", "x.*")
    values = samples.select("run_id", "sim_time", F.struct(*columns).alias("v")).join(first.select("run_id", "sim_time"), ["run_id", "sim_time"], "left_semi")
    return first.join(values.groupBy("run_id").agg(F.min("v").alias("v")), "run_id").select("run_id", "sim_time", "cross_track_m", "heading_error_deg", *[f"v.{c}" for c in columns])


def transition_log(cycles: DataFrame) -> DataFrame:
    """(run_id, sim_time, new_state, reason) of every change of phase."""
    return cycles.where("reason <> ''").select("run_id", "sim_time", F.col("phase").alias("new_state"), "reason")


def run_summary(cycles: DataFrame) -> DataFrame:
    """One row per run: cycles, times, last phase, and how it ended: completed, aborted with a reason, or still open."""
    last = F.max_by(F.struct("phase", "abort_reason", "finished"), "sim_time")
    got = cycles.groupBy("run_id").agg(F.count("*").alias("n_cycles"), F.min("sim_time").alias("t_start_s"), F.max("sim_time").alias("t_end_s"), last.alias("x"), F.max("abort_reason").alias("why"))
    outcome = F.when(F.col("why") != "", "aborted").when(F.col("x.finished"), "completed").otherwise("open")
    return got.select("run_id", "n_cycles", "t_start_s", "t_end_s", F.col("x.phase").alias("final_phase"), outcome.alias("outcome"), F.col("why").alias("abort_reason"))


def command_lines(cycles: DataFrame, trim: float = TRIM) -> DataFrame:
    """(run_id, sim_time, value): each cycle's commands as a protocol line; a cycle without commands gives none.

    A stream of them is written by ``writeStream`` to whatever sink the controls read, as text or through ``foreach``.
    """
    values = {**{c: F.col(c) for c in ("aileron", "rudder", "elevator", "throttle")}, "elevator_trim": F.lit(trim), "brake_left": F.col("brake"), "brake_right": F.col("brake")}
    return cycles.where("aileron IS NOT NULL").select("run_id", "sim_time", encode(values).alias("value"))


def latest_per_trigger(samples: DataFrame, sink) -> object:
    """A writer that hands ``sink`` the newest sample of each run in every micro-batch, as a reader sees that drops its backlog."""

    def newest(batch: DataFrame, number: int) -> None:
        sink(batch.groupBy("run_id").agg(F.max_by(F.struct(*batch.columns), "sim_time").alias("x")).select("x.*"), number)

    return samples.writeStream.foreachBatch(newest)


def cycle_log(samples: DataFrame, path: str, checkpoint: str):
    """One JSON line per handled sample."""
    return samples.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def events_per_window(samples: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per window and run with a watermark: rows later than ``late`` are dropped."""
    return samples.withWatermark(time, late).groupBy(F.window(time, width), "run_id").agg(F.count("*").alias("n"))
