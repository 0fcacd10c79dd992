"""Settings of a TOML file; values of the wrong type give the default, a broken file gives all defaults."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.filters import denied

# fixed values: default and largest number of summaries at a time, seconds for one
CONCURRENCY, MOST_CONCURRENT, TIMEOUT = 4, 32, 90


@dataclass(frozen=True)
class Settings:
    concurrency: int = CONCURRENCY
    timeout: int = TIMEOUT
    deny: dict[str, tuple[str, ...]] = field(default_factory=dict)
    output: str = ""
    shortcuts: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)

    def allowed(self, provider: Column, path: Column) -> Column:
        """Sessions outside the folders denied to their provider; a null path is allowed."""
        out = F.lit(True)
        for name, roots in self.deny.items():
            out = out & ~((provider == name) & denied(path, list(roots)))
        return out


def _positive(value: Any, default: int, most: int | None = None) -> int:
    if isinstance(value, str) and value.strip().isdigit():
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        return default
    return value if most is None else min(value, most)


def _strings(value: Any) -> tuple[str, ...] | None:
    return tuple(value) if isinstance(value, list) and all(isinstance(x, str) for x in value) else None


def read_settings(text: str) -> Settings:
    """``[collect]``, ``[export]``, ``[agent.<name>]`` and ``[shortcut.<name>]`` tables."""
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return Settings()
    table = lambda holder, name: holder[name] if isinstance(holder.get(name), dict) else {}
    agents, shortcuts = table(given, "agent"), table(given, "shortcut")
    presets = {name: (_strings(table(shortcuts, name).get("params")), _strings(table(shortcuts, name).get("args"))) for name in shortcuts}
    output = table(given, "export").get("output", "")
    return Settings(
        _positive(table(given, "collect").get("summary_concurrency"), CONCURRENCY, MOST_CONCURRENT),
        _positive(table(given, "collect").get("summary_timeout_seconds"), TIMEOUT),
        {name: roots for name in agents if (roots := _strings(table(agents, name).get("deny")))},
        output.strip() if isinstance(output, str) else "",
        {name: (params, args) for name, (params, args) in presets.items() if params is not None and args},
    )


# fixed values: ways to write a date, and what a date gives besides
DATES = ("%Y%m%d", "%Y-%m-%d")
OF_DATE = {"date": "%Y%m%d", "year": "%Y", "month": "%m", "year_month": "%Y-%m"}


def expand(arguments: list[str], settings: Settings) -> list[str]:
    """``arguments`` with ``--shortcut name value...`` replaced by the preset's arguments.

    Values end at the next option.  ``{param}`` in a preset stands for its
    value, ``{{`` and ``}}`` for braces; a parameter called ``date`` gives
    ``year``, ``month`` and ``year_month`` too.  Raises ValueError where the
    name, the number of values, a date or a template is wrong.
    """
    if "--shortcut" not in arguments:
        return arguments
    at = arguments.index("--shortcut")
    name = arguments[at + 1].strip() if at + 1 < len(arguments) else ""
    if name not in settings.shortcuts:
        raise ValueError(f"no such shortcut: {name or '(empty)'}")
    end = next((i for i in range(at + 2, len(arguments)) if arguments[i].startswith("-")), len(arguments))
    params, templates = settings.shortcuts[name]
    values = arguments[at + 2 : end]
    if len(values) != len(params):
        raise ValueError(f"shortcut {name} takes {len(params)} values, not {len(values)}")
    known = dict(zip(params, values, strict=True))
    if "date" in known:
        known |= _date_parts(known["date"])
    return arguments[:at] + [_fill(x, known) for x in templates] + arguments[end:]


def _date_parts(text: str) -> dict[str, str]:
    for form in DATES:
        try:
            day = datetime.strptime(text, form)
        except ValueError:
            continue
        return {name: day.strftime(shown) for name, shown in OF_DATE.items()}
    raise ValueError(f"not a date: {text}")


def _fill(template: str, known: dict[str, str]) -> str:
    def value(found: re.Match) -> str:
        whole, name = found.group(0), found.group(1)
        if whole in ("{{", "}}"):
            return whole[0]
        if name is None:
            raise ValueError(f"bad template: {template}")
        if name not in known:
            raise ValueError(f"no such parameter: {name}")
        return known[name]

    text = re.sub(r"\{\{|\}\}|\{(\w+)\}|[{}]", value, template)
    return str(Path(text).expanduser()) if text.startswith("~") else text
