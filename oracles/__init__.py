"""Independent DuckDB statements for the registered queries."""

from __future__ import annotations


def all_oracles() -> dict[str, str]:
    from oracles.changes import CHANGES, STEPS
    from oracles.reports import REPORTS
    from oracles.tables import with_tables
    from oracles.upkeep import PURGE, QUALITY, RECONCILE

    plain = {**REPORTS, **RECONCILE, **CHANGES}
    # steps of a delete and of a batch may have the same name
    known = {name: with_tables(sql, {**PURGE, **STEPS}) for name, sql in plain.items()}
    return known | {name: with_tables(sql, PURGE) for name, sql in QUALITY.items()}
