"""Recordings as files: encoding and dialect detection, scans, hash manifests, and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import nan_to_null
from ..functions.text import is_familiarisation
from ..schema import column_name

HEAD = 1 << 20


def dialect_of(header: Column) -> Column:
    """struct(delimiter, decimal): ``;`` and decimal comma if the header has more ``;`` than ``,``."""
    count = lambda ch: F.length(header) - F.length(F.replace(header, F.lit(ch), F.lit("")))
    wide = count(";") > count(",")
    return F.struct(F.when(wide, ";").otherwise(",").alias("delimiter"), F.when(wide, ",").otherwise(".").alias("decimal"))


def encoding_of(content: Column) -> Column:
    """utf-8 if the first MiB decodes (a character cut by the bound does not count), else latin-1."""
    head = F.substring(content, 1, HEAD)
    cut = F.when(F.octet_length(content) > HEAD, F.expr("array(0, 1, 2, 3)")).otherwise(F.expr("array(0)"))
    good = F.exists(cut, lambda k: F.is_valid_utf8(F.substring(head, F.lit(1), F.octet_length(head) - k).cast("string")))
    return F.when(good, "utf-8").otherwise("latin-1")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: sha256, size, lines below the header, header columns, dialect, encoding, and whether it trains.

    Files are read whole by one task each, as recordings of one flight are; the bytes do not leave it.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    enc = encoding_of(F.col("content"))
    text = F.when(enc == "utf-8", F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    got = files.select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"), "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"),
        enc.alias("encoding"), F.split(text, "\r?\n").alias("_lines"),
    )
    head = F.get("_lines", F.lit(0))
    got = got.withColumn("_d", dialect_of(head))
    excluded = is_familiarisation(F.col("source_file"))
    return got.select(
        "source_file", "path", "sha256", "size_bytes", "encoding", "_d.delimiter", "_d.decimal", head.alias("header"),
        (F.size(F.filter("_lines", lambda x: x != "")) - 1).cast("long").alias("n_rows_incl_header_minus1"),
        F.size(F.split(head, F.when(F.col("_d.delimiter") == ";", ";").otherwise(","))).cast("long").alias("n_cols_header"),
        (~excluded).alias("eligible_for_training"),
        F.when(excluded, "pilot_familiarization").otherwise("").alias("exclusion_reason"),
    )


def changed_copies(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Files whose copy is missing or has other bytes."""
    c = copy.select("source_file", F.col("sha256").alias("sha256_raw_copy"))
    return source.join(c, "source_file", "left").where("sha256_raw_copy IS NULL OR sha256 <> sha256_raw_copy").select("source_file", "sha256", "sha256_raw_copy")


def ingest(spark: SparkSession, source: str, raw: str) -> tuple[DataFrame, str]:
    """(inventory, action): of the loose files under ``source``, or of the already kept copies under ``raw`` if there are none.

    Loose files are held against their copies: one whose copy has other bytes is an error, one without a copy is "not_copied_yet".
    """
    loose, kept = inventory(spark, source), inventory(spark, raw)
    if not loose.limit(1).count():
        if not kept.limit(1).count():
            raise ValueError(f"no recordings in {source} or {raw}")
        return kept, "source_missing_raw_dir_already_canonical"
    changed = changed_copies(loose, kept).where("sha256_raw_copy IS NOT NULL").limit(1).collect()
    if changed:
        raise ValueError(f"the copy of {changed[0].source_file} has other bytes")
    copies = kept.select("source_file", F.lit("already_present_verified").alias("copy_action"))
    return loose.join(copies, "source_file", "left").fillna("not_copied_yet", ["copy_action"]), "source"


def scan(spark: SparkSession, files: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All recordings of an inventory as one frame: source_file, input_pos, and the columns as doubles (NaN is null).

    Files are read in groups of equal dialect, encoding and header, each group by one CSV scan; a decimal
    comma is replaced before the cast.  Columns that a file lacks are null.  A file is one task's and is not split, so input_pos
    keeps the order of its lines.
    """
    kinds = files.where(F.length("header") > 0).groupBy("delimiter", "decimal", "encoding", "header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    frames = []
    for r in kinds.orderBy("header", "encoding").collect():  # one row for each header, with the names of its files
        names = [column_name(h.strip().strip('"')) for h in r.header.split(r.delimiter)]
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.csv(r.paths, sep=r.delimiter, header=True, schema=text, encoding="UTF-8" if r.encoding == "utf-8" else "ISO-8859-1", enforceSchema=True, multiLine=True)
        df = df.withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn("input_pos", F.monotonically_increasing_id())
        keep = [n for n in names if columns is None or n in columns]
        plain = lambda n: F.replace(F.col(n), F.lit(","), F.lit(".")) if r.decimal == "," else F.col(n)  # noqa: E731, B023
        frames.append(df.select("source_file", "input_pos", *[nan_to_null(plain(n).try_cast("double")).alias(n) for n in keep]))
    if not frames:
        return spark.createDataFrame([], "source_file string, input_pos long")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Columns of the manifests that stages hand on; ids of runways are text ("02" is no number).
MANIFESTS = {
    "episodes": "episode_id string, session_id string, source_file string, scenario_id string, runway_id string, raw_row_start long, raw_row_end long, eligible_for_training boolean",
    "boundaries": "episode_id string, touchdown_confirmed boolean, contact_candidate_s double, touchdown_confirmed_s double, rollout_s double, complete_s double, complete_reason string, flare_s double",
    "folds": "fold_id int, val_session string, session_id string, role string",
}


def read_manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A manifest under its explicit schema: nothing is guessed from the values; a malformed row is an error."""
    return spark.read.csv(path, header=True, schema=MANIFESTS[kind], enforceSchema=False, mode="FAILFAST")


def overrides_yaml(segments: DataFrame, key: str) -> str:
    """Segments of recordings as a YAML document for people to review; one short entry per row."""
    import yaml

    rows = {str(r[key]): {c: v for c, v in r.asDict(recursive=True).items() if c != key} for r in segments.orderBy(key).collect()}
    return yaml.safe_dump(rows, sort_keys=False)


def write_episodes(df: DataFrame, path: str, key: str = "episode_id") -> None:
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def read_configs(text: str, kind: str) -> dict:
    """A small YAML or JSON document of settings."""
    import json

    if kind == "json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def scaler_json(scalers: DataFrame) -> DataFrame:
    """(fold_id, json): one document per fold, with sorted variables."""
    entry = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("variable", v))))
    got = scalers.groupBy("fold_id").agg(entry("mean").alias("mean"), entry("std").alias("std"), F.sort_array(F.collect_list(F.when(F.col("degenerate"), F.col("variable")))).alias("degenerate_std_variables"))
    doc = F.struct(F.lit(1).alias("schema_version"), "mean", "std", F.lit(-5.0).alias("clip_min"), F.lit(5.0).alias("clip_max"), "degenerate_std_variables")
    return got.select("fold_id", F.to_json(doc).alias("json"))


def qa_report(inventory_rows: DataFrame, profile: DataFrame, timing: DataFrame) -> str:
    """A Markdown summary; what is collected has one row per file or per column."""
    files = timing.orderBy("source_file").collect()
    roles = profile.groupBy("role").count().orderBy("role").collect()
    constant = profile.where("is_constant OR is_near_constant").count()
    out = ["# Quality report", "", f"- files: {len(files)}", f"- columns: {profile.count()}", f"- constant or nearly constant: {constant}", ""]
    out += ["| file | rows | rate | gaps | longest gap |", "|---|---|---|---|---|"]
    out += [f"| {r.source_file} | {r.n_rows} | {r.effective_freq_hz_median:.2f} | {r.n_gaps_gt_3x_median_dt} | {r.max_gap_s:.3f} |" for r in files]
    out += ["", "| role | columns |", "|---|---|", *[f"| {r.role} | {r['count']} |" for r in roles]]
    out += ["", f"Not used for training: {', '.join(r.source_file for r in inventory_rows.where('NOT eligible_for_training').collect()) or 'none'}"]
    return "\n".join(out) + "\n"
