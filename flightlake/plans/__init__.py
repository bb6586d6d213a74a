"""Whole plans: importing this package registers every query of its modules."""

from . import circuit, signals, telemetry, whole  # noqa: F401
