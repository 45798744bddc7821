"""Column-name rules, worked out on the driver from the schema only."""

from __future__ import annotations

import re


def snake(name: str) -> str:
    """Lower snake case: case changes and other characters become underscores."""
    text = re.sub(r"%", "_percent_", name)
    text = re.sub(r"#", "_number_", text)
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()
    if not text:
        return "x"
    return f"x{text}" if text[0].isdigit() else text


def snake_names(names: list[str], prefixes: list[tuple[str, str]] | None = None) -> list[str]:
    """Snake-case every name, splitting known run-together words first.

    ``prefixes`` are (text, replacement) pairs applied in order to every
    occurrence. A name that comes up again gets the suffix ``_2``, ``_3`` and so on.
    """
    result: list[str] = []
    seen: dict[str, int] = {}
    for name in names:
        for text, replacement in prefixes or []:
            name = name.replace(text, replacement)
        clean = snake(name)
        seen[clean] = seen.get(clean, 0) + 1
        result.append(clean if seen[clean] == 1 else f"{clean}_{seen[clean]}")
    return result


def level_suffix(level: str) -> str:
    """A category level as it appears in a dummy column's name."""
    text = re.sub(r"[^0-9A-Za-z._]", ".", level)
    return f"X{text}" if re.match(r"^(\d|\.\d|_)", text) else text
