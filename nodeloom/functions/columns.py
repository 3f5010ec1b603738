"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles, severities, and multipliers of the four scores by role.
ROLES = ("Coordinator", "Broker", "Enabler", "Peripheral")
SEVERITY = {"Low": 1, "Medium": 2, "High": 3, "Severe": 4}
MULTIPLIERS = {
    "v0": (3.0, 2.0, 1.3, 0.5),
    "v1": (4.0, 2.5, 1.5, 0.3),
    "v2": (5.0, 3.0, 1.8, 0.4),
    "v3": (3.0, 2.0, 1.3, 0.5),
}


def col_or(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """The column if ``df`` has it, else a constant; null counts as the constant."""
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)


def to_number(column: Column) -> Column:
    """A number, 0 where there is none."""
    return F.coalesce(column.try_cast("double"), F.lit(0.0))


def by_role(variant: str, role: Column) -> Column:
    """The multiplier of ``role``, 1 for others."""
    out = F.lit(1.0)
    for name, m in zip(ROLES, MULTIPLIERS[variant], strict=True):
        out = F.when(role == name, m).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    """1 to 4; an unknown name is an error, null stays null."""
    known = F.lit(None).cast("int")
    for name, rank in SEVERITY.items():
        known = F.when(severity == name, rank).otherwise(known)
    return F.when(severity.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(known, F.raise_error(F.concat(F.lit("unknown severity "), severity)).cast("int")))


def dice(seed: int | str, *keys: str) -> Column:
    """A text by which rows can be ordered at random and reproducibly; the same in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def parse_ids(text: Column) -> Column:
    """Ids of a ``;``-joined list: tokens of digits only, in order, repeats kept."""
    tokens = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda t: F.trim(t))
    return F.transform(F.filter(tokens, lambda t: t.rlike("^[0-9]+$")), lambda t: t.cast("bigint"))
