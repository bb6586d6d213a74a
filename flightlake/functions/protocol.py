"""Telemetry and command lines: decoding, encoding and the description file of the fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a telemetry line, in order, and the simulator's properties; those in WHOLE are whole numbers.
TELEMETRY_NODES = {
    "sim_time": "/sim/time/elapsed-sec",
    "lat_deg": "/position/latitude-deg",
    "lon_deg": "/position/longitude-deg",
    "alt_msl_ft": "/position/altitude-ft",
    "alt_agl_ft": "/position/altitude-agl-ft",
    "heading_deg": "/orientation/heading-deg",
    "roll_deg": "/orientation/roll-deg",
    "pitch_deg": "/orientation/pitch-deg",
    "alpha_deg": "/orientation/alpha-deg",
    "sideslip_rad": "/orientation/side-slip-rad",
    "roll_rate_degps": "/orientation/roll-rate-degps",
    "pitch_rate_degps": "/orientation/pitch-rate-degps",
    "yaw_rate_degps": "/orientation/yaw-rate-degps",
    "airspeed_kt": "/velocities/airspeed-kt",
    "vertical_speed_fps": "/velocities/vertical-speed-fps",
    "vbody_fps": "/velocities/vBody-fps",
    "groundspeed_kt": "/velocities/groundspeed-kt",
    "aileron_pos": "/controls/flight/aileron",
    "elevator_pos": "/controls/flight/elevator",
    "rudder_pos": "/controls/flight/rudder",
    "elevator_trim_pos": "/controls/flight/elevator-trim",
    "flaps_pos": "/controls/flight/flaps",
    "throttle_pos": "/controls/engines/engine[0]/throttle",
    "gear_wow_nose": "/gear/gear[0]/wow",
    "gear_wow_left": "/gear/gear[1]/wow",
    "gear_wow_right": "/gear/gear[2]/wow",
    "gear_compression_nose": "/gear/gear[0]/compression-norm",
    "gear_compression_left": "/gear/gear[1]/compression-norm",
    "gear_compression_right": "/gear/gear[2]/compression-norm",
    "wind_speed_kt": "/environment/wind-speed-kt",
    "wind_from_heading_deg": "/environment/wind-from-heading-deg",
    "crashed": "/fdm/jsbsim/crash",
    "frozen": "/sim/freeze/master",
}
TELEMETRY = list(TELEMETRY_NODES)
WHOLE = {"gear_wow_nose", "gear_wow_left", "gear_wow_right", "crashed", "frozen"}
# The fields of a command line, in order, and the simulator's properties.
COMMAND_NODES = {
    "aileron": "/controls/flight/aileron",
    "elevator": "/controls/flight/elevator",
    "rudder": "/controls/flight/rudder",
    "elevator_trim": "/controls/flight/elevator-trim",
    "throttle": "/controls/engines/engine[0]/throttle",
    "brake_left": "/controls/gear/brake-left",
    "brake_right": "/controls/gear/brake-right",
}
COMMANDS = list(COMMAND_NODES)


def routed(df: DataFrame, line: str = "value", fields: list[str] = TELEMETRY, whole: set[str] = WHOLE) -> DataFrame:
    """Every line with ``reason`` and ``fields``: one of the two is null.

    reason: "no_line" for a null, "field_count" for another number of fields, else "not_a_number:<field>" or, where only a whole number
    will do, "not_whole:<field>", for the first field that does not parse.  fields: the typed values as a struct.  A line is
    split and cast once.
    """
    parts = F.transform(F.split(F.trim(F.col(line)), ","), lambda x: F.trim(x))
    # generated from an array of one, so that no later step repeats the split
    d = df.withColumn("_parts", F.explode(F.array(parts)))
    values = [F.get("_parts", i).try_cast("int" if f in whole else "double").alias(f) for i, f in enumerate(fields)]
    d = d.withColumn("_values", F.explode(F.array(F.struct(*values))))
    broken = F.coalesce(*[F.when(F.col("_values")[f].isNull(), F.lit(f"{'not_whole' if f in whole else 'not_a_number'}:{f}")) for f in fields], F.lit(None))
    reason = F.when(F.col("_parts").isNull(), "no_line").when(F.size("_parts") != len(fields), "field_count").otherwise(broken)
    d = d.withColumn("reason", reason)
    return d.withColumn("fields", F.when(F.col("reason").isNull(), F.col("_values"))).drop("_parts", "_values")


def decode(df: DataFrame, line: str = "value", fields: list[str] = TELEMETRY, whole: set[str] = WHOLE) -> DataFrame:
    """The typed fields of every well-formed line; the others give no row, but are found by ``rejected``."""
    rest = [c for c in df.columns if c != line]
    return routed(df, line, fields, whole).where("fields IS NOT NULL").select(*rest, "fields.*")


def rejected(df: DataFrame, line: str = "value", fields: list[str] = TELEMETRY, whole: set[str] = WHOLE) -> DataFrame:
    """The lines that ``decode`` leaves out, with their reason."""
    return routed(df, line, fields, whole).where("reason IS NOT NULL").drop("fields")


def error_counts(routed_lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_received, n_decode_errors, by_reason): counts of ``routed`` lines; on a stream these are running counts of each key."""
    bad = F.col("reason").isNotNull()
    per = [F.count_if(F.coalesce(F.col("reason").startswith(r), F.lit(False))).alias(r) for r in ("no_line", "field_count", "not_a_number", "not_whole")]
    return routed_lines.groupBy(*keys).agg(F.count_if(~bad).alias("n_received"), F.count_if(bad).alias("n_decode_errors"), *per)


def encode(values: dict[str, Column], fields: list[str] = COMMANDS) -> Column:
    """One line in the order of the fields; a missing field or null is 0."""
    return F.concat_ws(",", *(F.format_string("%.6f", F.coalesce(values.get(f, F.lit(None)).cast("double"), F.lit(0.0))) for f in fields))


def description_xml(name: str, fields: list[str], whole: set[str] = frozenset(), node: dict[str, str] | None = None) -> str:
    """The generic-protocol description of a comma-separated line."""
    import xml.etree.ElementTree as E

    root = E.Element("PropertyList")
    part = E.SubElement(E.SubElement(root, "generic"), name)
    E.SubElement(part, "line_separator").text = "newline"
    E.SubElement(part, "var_separator").text = ","
    for f in fields:
        chunk = E.SubElement(part, "chunk")
        E.SubElement(chunk, "name").text = f
        E.SubElement(chunk, "type").text = "int" if f in whole else "double"
        E.SubElement(chunk, "format").text = "%d" if f in whole else "%.6f"
        E.SubElement(chunk, "node").text = (node or {}).get(f, f)
    return E.tostring(root, encoding="unicode")
