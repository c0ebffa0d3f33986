"""The key dimension from a YAML file.

The entries become rows; a table of rules says what a row may hold, and all that is broken is
reported together.  The dimension itself is a DataFrame, and its accessors are filters.
"""

from __future__ import annotations

from datetime import date
from pathlib import Path
from typing import NamedTuple

import yaml
from pyspark.sql import DataFrame, SparkSession

#: Names that the configuration file fixes.
SCHEMA = "ticker string, name string, sleeve string, issuer string, foreign_session boolean, outlier_band_bps double, role string"
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]
ROLES = ["primary", "control"]


class ConfigError(ValueError):
    """The configuration must not be used; says why."""


def is_day(value) -> bool:
    try:
        return isinstance(value, date) or bool(date.fromisoformat(str(value)))
    except ValueError:
        return False


#: What an entry must fulfil, by what is wrong otherwise; a rule is asked only if those before it hold.
ENTRY_RULES = [
    ("is not a mapping", lambda e: isinstance(e, dict)),
    ("lacks fields or has unknown ones", lambda e: set(e) == set(FIELDS)),
    ("has an unknown role", lambda e: e["role"] in ROLES),
    ("has a foreign_session that is neither true nor false", lambda e: isinstance(e["foreign_session"], bool)),
    ("has an outlier_band_bps that is not a positive number", lambda e: type(e["outlier_band_bps"]) in (int, float) and e["outlier_band_bps"] > 0),
]
#: The same for the file.
FILE_RULES = [
    ("is not a mapping", lambda f: isinstance(f, dict)),
    ("lacks sample or funds", lambda f: {"sample", "funds"} <= set(f)),
    ("has no start", lambda f: isinstance(f["sample"], dict) and f["sample"].get("start")),
    ("has bounds that are no ISO dates", lambda f: all(is_day(f["sample"][k]) for k in ("start", "end") if f["sample"].get(k))),
    ("ends before it starts", lambda f: not f["sample"].get("end") or str(f["sample"]["end"]) > str(f["sample"]["start"])),
    ("has no list of funds", lambda f: isinstance(f["funds"], list) and f["funds"]),
]


def broken(rules: list, value) -> str | None:
    return next((wrong for wrong, holds in rules if not holds(value)), None)


class Universe(NamedTuple):
    """The sample's bounds and the checked entries by ticker."""

    start: date
    end: date
    rows: dict

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row a key; a dimension, bounded by the configuration file."""
        return spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in self.rows.values()], SCHEMA)

    def primary(self, spark: SparkSession) -> DataFrame:
        return self.frame(spark).where("role = 'primary'")


def load_universe(path) -> Universe:
    """Reads and checks the file; an open end is today."""
    path = Path(path)
    if not path.exists():
        raise ConfigError(f"{path}: no such file")
    raw = yaml.safe_load(path.read_text())
    if wrong := broken(FILE_RULES, raw):
        raise ConfigError(f"{path} {wrong}")
    problems = [f"fund {i} {wrong}" for i, e in enumerate(raw["funds"]) if (wrong := broken(ENTRY_RULES, e))]
    names = [e.get("ticker") for e in raw["funds"] if isinstance(e, dict)]
    problems += [f"ticker {t} occurs twice" for t in dict.fromkeys(names) if names.count(t) > 1]
    if problems:
        raise ConfigError("; ".join(problems))
    bound = lambda k: date.fromisoformat(str(raw["sample"][k])) if raw["sample"].get(k) else date.today()
    return Universe(bound("start"), bound("end"), {e["ticker"]: {**e, "outlier_band_bps": float(e["outlier_band_bps"])} for e in raw["funds"]})
