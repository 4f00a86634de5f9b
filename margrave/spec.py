"""Table specifications: the roles of columns and what is publicly known of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

ROLES = ("numerical", "ordinal", "mixed", "categorical")


@dataclass(frozen=True)
class ColumnSpec:
    """One column: its role, decimals, public bounds (numbers) or levels (categories), and whether it can be missing.

    An ordinal column holds integers 0 .. n-1.  A mixed one is a non-negative number with a point mass at zero.
    """

    name: str
    role: str
    decimals: int = 0
    low: float | None = None
    high: float | None = None
    levels: tuple[str, ...] = ()
    may_be_missing: bool = False

    def __post_init__(self) -> None:
        if self.role not in ROLES:
            raise ValueError(f"{self.name}: role {self.role!r} is none of {', '.join(ROLES)}")
        if self.role == "mixed" and self.low is not None and self.low < 0:
            raise ValueError(f"{self.name}: a mixed column can't be negative")


@dataclass(frozen=True)
class TableSpec:
    """A table's columns, in order, the label column and what its values map to."""

    columns: tuple[ColumnSpec, ...]
    label: str | None = None
    label_map: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def checked(self, df: DataFrame) -> DataFrame:
        """df's columns of this specification; a missing one is an error."""
        if lacking := [n for n in self.names if n not in df.columns]:
            raise ValueError(f"columns not in the table: {', '.join(lacking)}")
        return df.select(*self.names)


def inferred_roles(df: DataFrame) -> dict[str, str]:
    """Roles by type: numbers are numerical, texts and booleans categorical; any other type is an error."""
    roles = {}
    for name, kind in df.dtypes:
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            roles[name] = "numerical"
        elif kind in ("string", "boolean"):
            roles[name] = "categorical"
        else:
            raise ValueError(f"{name}: no role for type {kind}")
    return roles
