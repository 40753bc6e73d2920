"""Tables whose columns go by several names, brought to one schema.

What a table calls a column is settled on the driver from its column names alone; what comes out is a projection, so pruning and
pushdown reach the scan."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The names by which annotated and predicted tables call their columns, the preferred ones first.
ALIASES = {
    "job_id": ["job_id", "id", "posting_id"],
    "variant": ["variant", "method", "prompt_variant", "extractor"],
    "required_skills": ["required_skills", "gold_required_skills", "required_skills_gold", "skills_required", "required"],
    "preferred_skills": ["preferred_skills", "gold_preferred_skills", "preferred_skills_gold", "skills_preferred", "preferred", "nice_to_have_skills"],
    "work_arrangement": ["work_arrangement", "gold_work_arrangement", "work_type", "location_type", "remote_status", "workplace_type"],
    "years_experience_min": ["years_experience_min", "gold_years_experience_min", "minimum_years_experience", "min_years_experience", "years_min", "years"],
}


class Unresolved(KeyError):
    """A column that a table doesn't have, or has under several names."""


def overrides_of(text: str | None) -> dict[str, str]:
    """Overrides from a JSON object of names."""
    found = json.loads(text) if text else {}
    if not isinstance(found, dict):
        raise ValueError("overrides must be a JSON object")
    return {str(k): str(v) for k, v in found.items()}


def resolve(columns: list[str], wanted: list[str], optional: tuple[str, ...] = (), overrides: Mapping[str, str] | None = None, aliases: Mapping[str, list[str]] = ALIASES) -> dict[str, str | None]:
    """The table's own name of each wanted column: an override, or the first of its names that is there; None for
    an optional one that isn't. Raises for a required one that isn't there, an override that names no column or no
    wanted one, a name that the table has twice, and a column that two wanted ones would share."""
    overrides = dict(overrides or {})
    if unknown := sorted(set(overrides) - set(aliases)):
        raise Unresolved(f"overrides of unknown columns {unknown}; there are {sorted(aliases)}")
    out: dict[str, str | None] = {}
    for name in wanted:
        if name in overrides and overrides[name] not in columns:
            raise Unresolved(f"the override {name}={overrides[name]!r} is no column of {columns}")
        own = overrides.get(name) or next((a for a in aliases[name] if a in columns), None)
        if own is None and name not in optional:
            raise Unresolved(f"no column for {name!r}: none of {aliases[name]} in {columns}")
        if own is not None and columns.count(own) > 1:
            raise Unresolved(f"{own!r} occurs {columns.count(own)} times")
        out[name] = own
    used = [c for c in out.values() if c is not None]
    if twice := sorted({c for c in used if used.count(c) > 1}):
        raise Unresolved(f"{twice} would stand for several columns: {out}")
    return out


def standardised(df: DataFrame, method: str | None = None, needs_arrangement: bool = True, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """``job_id, method, required_skills, preferred_skills, work_arrangement, years_experience_min`` from whatever the table
    calls them. Without a column for the method, its name must be given; a table without arrangements has nulls there if none are needed."""
    optional = (("variant",) if method else ()) + (() if needs_arrangement else ("work_arrangement",))
    named = resolve(df.columns, list(ALIASES), optional, overrides)
    source = lambda name: F.col(f"`{named[name]}`") if named[name] else F.lit(None).cast("string")
    said = source("variant").cast("string") if named["variant"] else F.lit(method)
    return df.select(source("job_id").alias("job_id"), said.alias("method"), *(source(c).alias(c) for c in ("required_skills", "preferred_skills", "work_arrangement", "years_experience_min")))
