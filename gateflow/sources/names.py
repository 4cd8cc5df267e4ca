"""Column names as ASCII snake case."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

# Signs that are spelled out (fixed values).
SPELLED = {"%": "_percent_", "#": "_number_"}
# Letters without a base letter of their own (fixed values).
LETTERS = str.maketrans(
    {
        "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ø": "o",
        "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th",
        "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T",
    }
)


def clean_name(name: str) -> str:
    for sign, word in SPELLED.items():
        name = name.replace(sign, word)
    name = re.sub("['\"]", "", name)
    name = unicodedata.normalize("NFKD", name.translate(LETTERS))
    name = "".join(c for c in name if not unicodedata.combining(c))
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()
    return name if re.match("[a-z]", name) else f"x{name}"


def clean_names(names: list[str]) -> list[str]:
    """Cleaned names, each different; the second of two equal ones gets ``_2``.

    A numbered name that is taken counts on until it is free.
    """
    uses: Counter[str] = Counter()
    result: dict[str, None] = {}
    for name in map(clean_name, names):
        unique = name
        uses[name] += 1
        while unique in result or (uses[name] > 1 and unique == name):
            uses[name] = max(uses[name], 2) + (unique != name)
            unique = f"{name}_{uses[name]}"
        result[unique] = None
    return list(result)


def number_headers(names: list[str | None]) -> list[str]:
    """Spreadsheet headers made unique: blank or repeated ones get ``...n``."""
    names = [(name or "").strip() for name in names]
    uses = Counter(names)
    return [
        name if name and uses[name] == 1 else f"{name}...{position}"
        for position, name in enumerate(names, 1)
    ]
