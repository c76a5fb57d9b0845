from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from innsight.session import local_session

    session = local_session("8", "innsight-tests", partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seed_root(spark, tmp_path_factory):
    """The generated hotel of scale 1, stored as parquet."""
    from innsight.sources.generator import generate
    from innsight.sources.store import write_hotel

    root = str(tmp_path_factory.mktemp("hotel"))
    write_hotel(generate(spark), root)
    return root


@pytest.fixture(scope="session")
def seed(spark, seed_root):
    from innsight.sources.store import read_hotel

    return read_hotel(spark, seed_root)
