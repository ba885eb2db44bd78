"""What a suite is made of: checks, threshold tiers, column rules, defaults.

Everything here is small driver-side description; nothing touches a DataFrame.
Mistakes raise ``ValueError`` when the object is built, before any job runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any

from plumbline.functions.text import debug_list, plain_number, quote
from plumbline.plans.calendar import parse_calendar
from plumbline.functions.time import interval_secs

# Names the rules accept and the defaults a check falls back to.
COLUMN_TYPES = ("int", "float", "string", "bool", "timestamp")
OUTLIER_METHODS = ("iqr", "zscore")
DISTRIBUTIONS = ("normal",)
DEFAULT_EVERY_SECS = 60
SAMPLE_ROWS = 10

PASS, WARN, FAIL, ERROR = "PASS", "WARN", "FAIL", "ERROR"
FAILING = (FAIL, ERROR)


@dataclass(frozen=True)
class Tier:
    """A threshold: fires when the SQL condition ``when`` is true for the result."""

    when: str
    sustained: str | None = None
    sample: int | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.when, str) or not self.when.strip():
            raise ValueError("tier: `when` must be a SQL condition")
        if self.sustained is not None and interval_secs(self.sustained) is None:
            raise ValueError(f"tier: bad `sustained` interval {quote(str(self.sustained))}")
        if self.sample is not None and (isinstance(self.sample, bool) or not isinstance(self.sample, int) or self.sample < 0):
            raise ValueError(f"tier: `sample` must be a non-negative whole number, got {self.sample!r}")


@dataclass(frozen=True)
class ColumnRule:
    """Facts that must hold for one column of a check's result."""

    name: str
    type: str | None = None
    not_null: bool | None = None
    null_rate: float | None = None
    allowed: Sequence[str] | None = None
    matches: str | None = None
    range: tuple[float, float] | None = None
    unique: bool | None = None
    outliers: str | None = None
    distribution: str | None = None

    def __post_init__(self) -> None:
        where = f"validate column {quote(str(self.name))}"
        if not isinstance(self.name, str) or not self.name:
            raise ValueError("validate column needs a name")
        _one_of(where, "type", self.type, COLUMN_TYPES)
        _one_of(where, "outliers method", self.outliers, OUTLIER_METHODS)
        _one_of(where, "distribution", self.distribution, DISTRIBUTIONS)
        for key in ("not_null", "unique"):
            if getattr(self, key) is not None and not isinstance(getattr(self, key), bool):
                raise ValueError(f"{where}: `{key}` is true or false, not {getattr(self, key)!r}")
        if self.null_rate is not None:
            if not _is_number(self.null_rate):
                raise ValueError(f"{where}: `null_rate` needs a number, not {self.null_rate!r}")
            if not 0 <= self.null_rate <= 1:
                raise ValueError(f"{where}: `null_rate` is a share from 0 to 1, not {self.null_rate!r}")
        if self.allowed is not None:
            if isinstance(self.allowed, str) or not isinstance(self.allowed, Sequence):
                raise ValueError(f"{where}: `allowed` needs a list, not {self.allowed!r}")
            for item in self.allowed:
                if not isinstance(item, str):
                    raise ValueError(f"{where}: `allowed` holds only text, not {item!r}")
            object.__setattr__(self, "allowed", tuple(self.allowed))
        if self.matches is not None:
            if not isinstance(self.matches, str):
                raise ValueError(f"{where}: `matches` needs text, not {self.matches!r}")
            _check_pattern(where, self.matches)
        if self.range is not None:
            object.__setattr__(self, "range", _read_range(where, self.range))

    @classmethod
    def from_dict(cls, name: str, attributes: Mapping[str, Any]) -> ColumnRule:
        known = {f.name for f in fields(cls)} - {"name"}
        for key in attributes:
            if key not in known:
                raise ValueError(f"validate column {quote(name)} has no rule `{key}`")
        return cls(name, **attributes)


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _one_of(where: str, what: str, value: Any, known: Sequence[str]) -> None:
    if value is None:
        return
    if not isinstance(value, str):
        raise ValueError(f"{where}: {what} needs text, not {value!r}")
    if value not in known:
        raise ValueError(f"{where}: no such {what}: {quote(value)}; there are {debug_list(known)}")


def _read_range(where: str, value: Any) -> tuple[float, float]:
    if isinstance(value, Mapping):
        for key in ("min", "max"):
            if key not in value:
                raise ValueError(f"{where}: `range` lacks `{key}`")
        value = (value["min"], value["max"])
    if not isinstance(value, Sequence) or isinstance(value, str) or len(value) != 2:
        raise ValueError(f"{where}: `range` takes a pair or `min` and `max`, not {value!r}")
    low, high = value
    for key, bound in (("min", low), ("max", high)):
        if not _is_number(bound):
            raise ValueError(f"{where}: `range.{key}` needs a number, not {bound!r}")
    if low > high:
        raise ValueError(f"{where}: `range` is empty: {plain_number(low)} lies above {plain_number(high)}")
    return float(low), float(high)


#: What stands in a pattern that is neither a literal nor plain syntax, outside character classes.
_GROUP = re.compile(r"\(\?(?:P<[A-Za-z_]\w*>|<[A-Za-z_]\w*>|[imsxU]*(?:-[imsxU]+)?[:)])")


def _check_pattern(where: str, pattern: str) -> None:
    """Reject patterns that are malformed or outside the dialect: no lookaround, backreferences or conditions."""

    def refuse(why: str) -> None:
        raise ValueError(f"{where}: `matches` regex {quote(pattern)} cannot be used: {why}")

    i, in_class, depth = 0, 0, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            if re.match(r"\\[1-9kgG]", pattern[i:]):
                refuse("no lookaround, backreferences or conditions")
            i += 2
            continue
        if char == "[" and not pattern.startswith("[:", i):
            in_class += 1
        elif char == "]" and in_class:
            in_class -= 1
        elif char == "(" and not in_class:
            if pattern.startswith("(?", i) and not _GROUP.match(pattern, i):
                refuse("no lookaround, backreferences or conditions")
            depth += not re.match(r"\(\?[imsxU-]+\)", pattern[i:])
            i += 1
            if pattern.startswith("?", i):  # the group's head is no repetition
                i = _GROUP.match(pattern, i - 1).end()
                if pattern[i - 1] == ")":
                    continue
            continue
        elif char == ")" and not in_class:
            depth -= 1
            if depth < 0:
                refuse("unopened group")
        i += 1
    if depth or in_class:
        refuse("unclosed group or class")
    # Repetitions and escapes: spelling aside, the two dialects agree on what is malformed.
    probe = re.sub(r"\\[pP](?:\{[^}]*\}|[A-Za-z])", "x", pattern)
    probe = re.sub(r"\[:\^?[a-z]+:\]", "x", probe).replace(r"\z", r"\Z").replace("(?<", "(?P<")
    probe = re.sub(r"\(\?[imsxU-]*\)", "(?:)", re.sub(r"\(\?[imsxU-]+:", "(?:", probe))
    try:
        re.compile(probe)
    except re.error as err:
        raise ValueError(f"{where}: `matches` regex {quote(pattern)} cannot be used: {err}") from err


def _as_tier(tier: Tier | str | None) -> Tier | None:
    return Tier(tier) if isinstance(tier, str) else tier


@dataclass(frozen=True)
class Check:
    """A query plus an assertion over its rows.

    ``query`` is Spark SQL text, or a function of the session returning a
    DataFrame. ``order_by`` fixes which row is "first" (default: all columns,
    left to right). ``materialise`` writes the result once before the rules
    read it; use it when the query is costly and rules need several passes.
    """

    name: str
    query: str | Callable[..., Any]
    on: str | None = None
    every: str | None = None
    timeout: str | None = None
    warn: Tier | str | None = None
    fail: Tier | str | None = None
    validate: Sequence[ColumnRule] | None = None
    on_fail: str | None = None
    for_each: Sequence[str] = ()
    each_value: str | None = None
    order_by: Sequence[str] | None = None
    materialise: bool = False

    def __post_init__(self) -> None:
        where = f"check {quote(str(self.name))}"
        if not isinstance(self.name, str) or not self.name:
            raise ValueError("check needs a name")
        if not (isinstance(self.query, str) or callable(self.query)):
            raise ValueError(f"{where}: the query is neither SQL text nor a function: {self.query!r}")
        object.__setattr__(self, "warn", _as_tier(self.warn))
        object.__setattr__(self, "fail", _as_tier(self.fail))
        if self.validate is not None:
            if self.warn is not None or self.fail is not None:
                raise ValueError(f"{where} has column rules and tiers; a check takes one kind only")
            object.__setattr__(self, "validate", tuple(self.validate))
        if isinstance(self.for_each, str):
            raise ValueError(f"{where}: `for_each` needs a list of texts, not {self.for_each!r}")
        for item in self.for_each:
            if not isinstance(item, str):
                raise ValueError(f"{where}: `for_each` holds only text, not {item!r}")
        object.__setattr__(self, "for_each", tuple(self.for_each))
        for key in ("every", "timeout"):
            text = getattr(self, key)
            if text is not None and interval_secs(text) is None:
                if key == "every" and len(text.split()) == 5:
                    parse_calendar(text)
                    continue
                raise ValueError(f"{where}: `{key}` cannot be read as an interval: {quote(str(text))}")

    @property
    def sql(self) -> str | None:
        """The query text with the current ``for_each`` item filled in."""
        if not isinstance(self.query, str):
            return None
        if self.each_value is None:
            return self.query
        return self.query.replace("${each.value}", self.each_value)

    @property
    def timeout_secs(self) -> int | None:
        """The check's own deadline; without one it may take as long as its data need."""
        return interval_secs(self.timeout) if self.timeout else None

    @property
    def every_secs(self) -> int | None:
        """The interval between runs; none for a check that runs by the calendar."""
        return interval_secs(self.every) if self.every else DEFAULT_EVERY_SECS

    @property
    def calendar(self) -> str | None:
        """``every`` where it names moments (minute, hour, day, month, weekday) instead of an interval."""
        return self.every if self.every and interval_secs(self.every) is None else None

    @property
    def sustained_secs(self) -> int | None:
        """Only the fail tier's ``sustained`` gates alerts."""
        return interval_secs(self.fail.sustained) if self.fail and self.fail.sustained else None

    @property
    def tiers(self) -> tuple[str, ...]:
        return tuple(name for name in ("warn", "fail") if getattr(self, name) is not None)

    def expanded(self) -> list[Check]:
        """One check per ``for_each`` item; the check itself when there is none."""
        if not self.for_each:
            return [self]
        return [replace(self, name=f"{self.name}[{item}]", for_each=(), each_value=item) for item in self.for_each]


@dataclass(frozen=True)
class Defaults:
    on: str | None = None
    every: str | None = None
    timeout: str | None = None
    on_fail: str | None = None

    def applied_to(self, check: Check) -> Check:
        merged = {f.name: getattr(check, f.name) or getattr(self, f.name) for f in fields(self)}
        return replace(check, **merged)


@dataclass(frozen=True)
class Suite:
    """Connections (see :mod:`plumbline.sources`), checks and shared defaults."""

    connections: Sequence[Any]
    checks: Sequence[Check]
    defaults: Defaults = field(default_factory=Defaults)

    def __post_init__(self) -> None:
        if not self.connections:
            raise ValueError("a suite needs at least one connection")
        names = [c.name for c in self.resolved()]
        repeated = sorted({n for n in names if names.count(n) > 1})
        if repeated:
            raise ValueError(f"check names must be unique, repeated: {debug_list(repeated)}")

    def resolved(self) -> list[Check]:
        """Checks in order, with defaults merged and ``for_each`` expanded."""
        first = self.connections[0].name
        out = []
        for check in self.checks:
            merged = self.defaults.applied_to(check)
            out += replace(merged, on=merged.on or first).expanded()
        return out
