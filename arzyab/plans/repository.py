"""Read access to published tables: an allow-list, typed filters, sorting and paging."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 1000


class UnknownDataset(KeyError):
    """A name outside the allow-list."""


class BadRequest(ValueError):
    """A column that the table lacks, or a page that can't be."""


@dataclass
class Repository:
    """tables: name -> DataFrame; keys: name -> columns that make a page's order unique."""

    tables: dict[str, DataFrame]
    keys: dict[str, list[str]] = field(default_factory=dict)

    def inventory(self) -> list[dict]:
        return [{"name": n, "columns": t.columns} for n, t in sorted(self.tables.items())]

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise UnknownDataset(name)
        return self.tables[name]

    def query(self, name: str, filters: dict | None = None, in_filters: dict[str, list] | None = None, sort_by: str | None = None, descending: bool = False, limit: int = 100, offset: int = 0) -> tuple[int, DataFrame]:
        """(number of matching rows, the page). NULLs sort last either way; ties follow the table's key. limit is held to MOST_ROWS, an
        equality filter with None asks for NULL, and an empty list matches nothing."""
        df = self._table(name)
        asked = [*(filters or {}), *(in_filters or {}), *([sort_by] if sort_by else [])]
        unknown = sorted(set(asked) - set(df.columns))
        if unknown:
            raise BadRequest(f"{name} has no column {', '.join(unknown)}")
        if limit < 1 or offset < 0:
            raise BadRequest("limit must be positive and offset not negative")
        conditions = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in (filters or {}).items()]
        conditions += [F.col(c).isin(*v) if v else F.lit(False) for c, v in (in_filters or {}).items()]
        rows = df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df
        order = [F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)] if sort_by else []
        order += [F.asc_nulls_last(k) for k in self.keys.get(name, []) if k != sort_by]
        page = (rows.orderBy(*order) if order else rows).offset(offset).limit(min(limit, MOST_ROWS))
        return rows.count(), page
