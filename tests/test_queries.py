"""Every query of the library beside its SQL, on the smallest tables; and what the results must be where SQL can't say it."""
import sys
from pathlib import Path

import pytest

from recollect import plans

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))
sys.path.insert(0, str(ROOT))
import compare  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    assert compare.compare(spark, con, SF, name) is None


def test_entry(spark):
    assert compare.entry.entry(spark).count() > 0
    assert set(compare.entry.oracle_sql()) <= set(compare.entry.queries())


def test_every_event_has_its_offset(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    users = {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    got = plans.QUERIES["partition_events"](spark, "/root/testdata/sf0.01").groupBy("user_id").agg({"offset_": "max", "event_id": "count"}).collect()
    assert {r.user_id: r["count(event_id)"] for r in got} == users and len(users) > 50 and users == {r.user_id: r["max(offset_)"] for r in got}


def test_strict_semantic_step_goes_by_cosine_above_095(spark):
    import numpy as np

    d = "/root/testdata/sf0.001"
    v = sorted((str(r.vec_id), np.array(r.embedding, float)) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect())
    docs = {str(r.doc_id): r.doc_id % 101 for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()}
    v = [(k, e / np.linalg.norm(e)) for k, e in v if k in docs]
    s = np.stack([e for _, e in v])
    s = s @ s.T
    gone = {v[i][0] if docs[v[j][0]] > docs[v[i][0]] else v[j][0] for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] > 0.95}
    assert {r.key for r in plans.QUERIES["dedup_semantic"](spark, d).collect()} == docs.keys() - gone
