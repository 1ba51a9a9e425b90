"""Workaround registers: a markdown table of standing workarounds with owners and expiry dates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date
from pathlib import Path

#: The table's section, columns and rules.
SECTION = "## Standing"
COLUMNS = ("Workaround", "Hosts", "Tracking", "Owner", "Added", "Expires")
TRACKING = re.compile(r"[a-z0-9][a-z0-9-]*#[a-z0-9]{4}")
MAX_DAYS = 30


@dataclass(frozen=True)
class Standing:
    workaround: str
    hosts: str
    tracking: str
    owner: str
    added: date
    expires: date


@dataclass(frozen=True)
class Check:
    registers: int
    standing: int
    expired: list[tuple[str, Standing]]
    problems: list[tuple[str, str]]

    @property
    def alerts(self) -> int:
        return len(self.expired) + len(self.problems)


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def _day(text: str) -> date:
    if not re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        raise ValueError(f"not a date: {text}")
    return date.fromisoformat(text)


def parse(text: str) -> list[Standing]:
    """The rows of a register; the first thing wrong raises."""
    lines = text.splitlines()
    if SECTION not in [x.strip() for x in lines]:
        raise ValueError(f"no section {SECTION}")
    at = [x.strip() for x in lines].index(SECTION) + 1
    table = []
    for line in lines[at:]:
        if line.startswith("## "):
            break
        if line.strip().startswith("|"):
            table.append(line)
        elif table:
            break
    if len(table) < 2 or tuple(_cells(table[0])) != COLUMNS:
        raise ValueError("the table's columns must be " + ", ".join(COLUMNS))
    if not all(re.fullmatch(r":?-+:?", c) for c in _cells(table[1])):
        raise ValueError("no separator row under the column names")
    rows = []
    for line in table[2:]:
        cells = _cells(line)
        if len(cells) != len(COLUMNS):
            raise ValueError(f"a row with {len(cells)} cells")
        row = Standing(*cells[:4], _day(cells[4]), _day(cells[5]))
        if not TRACKING.fullmatch(row.tracking):
            raise ValueError(f"not a tracking reference: {row.tracking}")
        if row.expires < row.added or (row.expires - row.added).days > MAX_DAYS:
            raise ValueError(f"{row.tracking} must expire within {MAX_DAYS} days of being added")
        rows.append(row)
    return rows


def check(paths: list[str], day: date) -> Check:
    """Rows past their expiry, and registers that could not be read."""
    standing, expired, problems = 0, [], []
    for p in paths:
        try:
            rows = parse(Path(p).expanduser().read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            problems.append((p, str(e)))
            continue
        standing += len(rows)
        expired += [(p, r) for r in rows if r.expires < day]
    return Check(len(paths), standing, expired, problems)
