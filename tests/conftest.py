from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

KEYS = ["dataset", "episode_index"]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from seqseg import build_session

    session = build_session(
        "tests",
        "local[8]",
        4,
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("settled")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def frames(spark):
    """Build a frame table from {episode: values}."""

    def build(episodes: dict[int, list], column: str = "label", kind: str = "bigint"):
        rows = [("d", e, i, v) for e, values in episodes.items() for i, v in enumerate(values)]
        return spark.createDataFrame(
            rows, f"dataset string, episode_index bigint, frame_index bigint, {column} {kind}"
        )

    return build


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
