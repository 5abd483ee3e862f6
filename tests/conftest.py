import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import local_session

    s = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def canonical(rows, columns):
    """Rows as sorted tuples of text, whatever library they come from."""
    def text(v):
        if v is None or str(v) in ("nan", "<NA>", "NaT", "None"):
            return None
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted((tuple(text(v) for v in r) for r in rows[columns].itertuples(index=False, name=None)), key=str)
