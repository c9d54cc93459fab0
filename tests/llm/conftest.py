from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def checkpoint_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def documents(spark):
    def make(rows, partitions=3):
        full = [(i, t, *rest) if rest else (i, t, "en", "s", None) for i, t, *rest in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make
