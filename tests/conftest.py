import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

TESTDATA = Path(os.environ.get("COMMLENS_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from commlens.session import local_session

    session = local_session(
        8,
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return str(TESTDATA / "sf0.01")


@pytest.fixture(scope="session")
def tiny():
    return str(TESTDATA / "sf0.001")


@pytest.fixture(scope="session")
def cases(spark, small):
    """The mapped communications at sf0.01, cached for the whole run."""
    from commlens.sources.feeds import communications

    return communications(spark, small).cache()


@pytest.fixture(scope="session")
def forest(cases):
    """A quick forest for scoring tests."""
    from commlens.operators import training
    from commlens.settings import Settings

    return training.train(cases, settings=Settings(trees=20, depth=5), folds=False).forest
