"""The versions of a text: where each comes from, how it is marked up, and what it should hold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import UNITS, Units
from . import provisions


@dataclass(frozen=True)
class Source:
    """pages gives (doc, html) of one version, read where the session reads; expected is the number of provisions of each kind."""

    version: str
    pages: Callable[[SparkSession], DataFrame]
    markup: provisions.Markup
    expected: dict[str, int] = field(default_factory=dict)


class UnknownVersion(LookupError):
    """A version that no source is registered for."""


def chosen(sources: list[Source], versions: tuple[str, ...] | None = None) -> list[Source]:
    """The sources of the versions asked for, or all; UnknownVersion names one that there is none of."""
    known = {s.version: s for s in sources}
    if len(known) != len(sources):
        raise ValueError("a version is registered twice")
    missing = [v for v in versions or () if v not in known]
    if missing:
        raise UnknownVersion(f"no source of {missing[0]}; known are {', '.join(known)}")
    return sources if versions is None else [known[v] for v in versions]


def load(spark: SparkSession, sources: list[Source], versions: tuple[str, ...] | None = None, units: Units = UNITS) -> DataFrame:
    """Provisions of the versions with `version`, each parsed by its own markup."""
    out = None
    for s in chosen(sources, versions):
        rows = provisions.parse(s.pages(spark), s.markup, units).withColumn("version", F.lit(s.version))
        out = rows if out is None else out.unionByName(rows)
    return out


def expected(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """version, kind, expected of all sources, for provisions.disagreements."""
    rows = [(s.version, kind, n) for s in sources for kind, n in sorted(s.expected.items())]
    return spark.createDataFrame(rows, "version string, kind string, expected int")
