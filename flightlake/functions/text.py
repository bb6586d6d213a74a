"""File names, scenarios and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scenario by normalised file name.
SCENARIOS = {
    "circuitocompleto": "circuit",
    "turbulencia05": "turbulence_05",
    "turbulencia08": "turbulence_08",
    "voo2com16nos": "wind_16kt",
    "voo2comrajada": "gust",
    "voo3com16nos": "wind_16kt",
    "voocom16nos": "wind_16kt",
    "voocom8nos": "wind_8kt",
    "voocomrajadavindodadireita": "gust_direction_variant",
    "voocomrajada": "gust",
    "voocondicoesnormais": "normal",
    "vooiniciotest": "unknown",
    "voonormal2": "normal",
    "voonormal3": "normal",
    "voo2com8nos": "wind_8kt",
}
FAMILIARISATION = "vooinicioteste"


def normalised_name(path: Column) -> Column:
    """Lower-case file stem without ``_``, ``-`` and blanks."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.regexp_replace(F.lower(stem), r"[_\- ]", "")


def scenario_of(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in SCENARIOS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, normalised_name(path)), F.lit("unknown"))


def is_familiarisation(path: Column) -> Column:
    return normalised_name(path) == FAMILIARISATION


def fold_name(fold: Column, session: Column) -> Column:
    return F.format_string("fold_%02d_%s", fold, session)
