"""A deterministic embedding function for checks: counts of the letters a to z."""

from __future__ import annotations

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_profile(texts: list[str]) -> list[list[float]]:
    return [[float(text.count(letter)) for letter in LETTERS] for text in texts]


def letter_profile_sql(text: str) -> str:
    counts = [f"CAST(length({text}) - length(replace({text}, '{x}', '')) AS FLOAT)" for x in LETTERS]
    return f"[{', '.join(counts)}]"
