"""Every query against its SQL on the smallest tables, and those without SQL for whole, unique results."""

import subprocess
import sys
from pathlib import Path

import pytest

from millrace.queries import QUERIES, SQL
from tests.oracle import DATA, MISSING, assert_same, connect

pytestmark = pytest.mark.skipif(MISSING, reason="no tables")
ROOT = Path(__file__).parent.parent


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_whole(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_chunks_cover_their_passages(spark):
    from pyspark.sql import functions as F

    from millrace.functions.text import normalize_whitespace

    passages = spark.read.parquet(f"{DATA}/source_documents.parquet").dropDuplicates(["document_id"])
    with_text = passages.filter(F.coalesce(F.length(normalize_whitespace(F.col("text"))), F.lit(0)) > 0).count()
    chunks = QUERIES["chunk_pipeline"](spark, DATA)
    assert chunks.select("document_id").distinct().count() == with_text and chunks.count() == chunks.select("id").distinct().count()


def test_mmr_select_chooses_among_all_that_fusion_gives(spark):
    from millrace import queries as Q
    from millrace.operators.hybrid import diversify

    texts = dict(Q._chunks(spark, DATA).select("id", "text").collect())
    lists = {}
    for r in Q._fused(spark, DATA).orderBy("query_id", "rank").collect():
        lists.setdefault(r["query_id"], []).append(r)
    assert max(map(len, lists.values())) > 2 * Q.K
    want = set()
    for q, rows in lists.items():
        order = diversify([r["fused_score"] for r in rows], [texts[r["id"]] for r in rows], Q.K, 0.7) if len(rows) > Q.K else range(len(rows))
        want |= {(q, rows[i]["id"], n) for n, i in enumerate(order, 1)}
    assert {tuple(r) for r in QUERIES["mmr_select"](spark, DATA).collect()} == want


def test_speech_pieces_cover_long_texts(spark, tmp_path):
    text = "The wheel turns and the grain is ground. " * 200
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    chars = [r["chars"] for r in QUERIES["speech_pieces"](spark, str(tmp_path)).collect()]
    assert sum(chars) >= 0.95 * len(text)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_needs_the_llm_subpackage():
    code = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    for path in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "millrace.llm" not in path.read_text(), path
