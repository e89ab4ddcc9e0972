import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from maskwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(cores=8, memory="6g", **{"spark.checkpoint.dir": f"file://{shared}"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def found(spark):
    """Spans of texts: found(texts, **options) -> {text: [(type, rule, start, end, value)]}."""
    from maskwright.operators import detectors as dt

    def run(texts, all_candidates=False, **options):
        texts = list(texts)
        df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8, "id")
        out = dt.candidates(df, **options) if all_candidates else dt.detect(df, **options)
        column = "candidates" if all_candidates else "spans"
        rows = out.select("id", column).collect()
        return {
            texts[r.id]: [(s.pii_type, s.rule, s.start, s.end, s.value) for s in r[1]] for r in rows
        }

    return run
