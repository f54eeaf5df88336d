import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tabloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


@pytest.fixture(scope="session")
def column(spark):
    """A one-column DataFrame of the given values, with a running id."""
    def make(values, kind="string"):
        return spark.createDataFrame(list(enumerate(values)), f"id long, v {kind}")
    return make


@pytest.fixture(scope="session")
def values():
    """The values of a column in id order."""
    def read(df, name="v"):
        return [r[name] for r in df.orderBy("id").select(f"`{name}`").collect()]
    return read
