"""How a body of law names its parts: written unit names and the prefixes of their ids, given by the caller."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Units:
    """(written name, id prefix) of each kind; the roman kind is numbered in roman numerals and has a written plural."""

    article: tuple[str, str] = ("Article", "art")
    recital: tuple[str, str] = ("Recital", "rct")
    roman: tuple[str, str] = ("Schedule", "sch")
    romans: str = "Schedules"
    chapter: tuple[str, str] = ("Chapter", "chp")

    def roman_pattern(self) -> str:
        return f"(?:{self.romans}|{self.roman[0]})"


UNITS = Units()
