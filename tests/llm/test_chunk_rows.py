"""Chunk deduplication of rows that are one document."""

from gridloom.llm import chunk_dedup

from .conftest import prose


def test_a_document_in_two_rows_keeps_its_text(spark):
    a, b = prose(2, 120), prose(3, 120)
    rows = [(6, a), (6, a), (None, b), (None, b), (7, a), (7, a)]
    want = [(6, 0), (6, 0), (None, 0), (None, 0), (7, len(a)), (7, len(a))]
    for parts in (1, 6):  # in one group of rows of a task, and apart
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = [(r["doc_id"], r["n_removed"]) for r in chunk_dedup.deduplicated(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_odd_rows_of_one_document_keep_their_text(odd_docs):
    got = [r["n_removed"] for r in chunk_dedup.deduplicated(odd_docs.coalesce(1)).where("doc_id = 6").collect()]
    assert got == [0, 0]
