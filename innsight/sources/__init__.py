"""Where tables come from and where changes go."""

from innsight.sources.fixture import fixture_hotel
from innsight.sources.generator import generate
from innsight.sources.store import (
    CommitConflict,
    append,
    commit,
    insert_if_absent,
    read_hotel,
    read_table,
    upsert,
    write_hotel,
)

__all__ = [
    "CommitConflict",
    "append",
    "commit",
    "fixture_hotel",
    "generate",
    "insert_if_absent",
    "read_hotel",
    "read_table",
    "upsert",
    "write_hotel",
]
