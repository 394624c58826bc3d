"""Rows that share an id or all their content, and columns with names used inside."""

import pytest

from shelfspark.llm import exact_dedup, jaccard_join, secrets, warc
from shelfspark.session import work_path


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_kept_documents_of_one_id(docs):
    rows = docs([(5, "a b"), (5, "ab "), (6, "zz"), (6, "zz"), (7, "z z")])
    kept = exact_dedup.exact_dedup(rows).filter("kept")
    out = exact_dedup.kept_documents(rows)
    assert kept.count() == out.count() == 2
    assert {i for i, _ in texts(out)} == {5, 7} and out.columns == rows.columns


def test_one_of_each_keeps_what_the_operator_keeps(docs):
    rows = docs([(7, ""), (7, ""), (8, "hello"), (9, None), (9, " \n"), (8, "hello")])
    out = jaccard_join.one_of_each(rows)
    assert out.count() == jaccard_join.jaccard_join(rows).filter("keeps").count() == 5
    assert [t for _, t in texts(out.filter("doc_id = 8"))] == ["hello"]


def test_masks_keep_columns_with_inner_names(spark):
    rows = spark.createDataFrame([(1, "password: hunter2hunter2", "mine", 4)],
                                 "doc_id long, text string, _base string, _base_ long")
    got = secrets.mask_secrets(rows, secrets.train(rows, spark.createDataFrame(
        [], "doc_id long, quality int, toxic int")))
    assert got.columns == rows.columns
    row = got.first()
    assert (row["_base"], row["_base_"]) == ("mine", 4) and "hunter2" not in row["text"]


def test_record_ids_differ(spark):
    pages = spark.createDataFrame(
        [(5, "u", "aaa"), (5, "u", "bbb"), (6, "u", "aaa"), (6, "u", "aaa"), (5, "v", "aaa"), (None, "u", "bbb"),
         (None, None, None), (None, None, None)], "page_id long, url string, html string")
    folder = work_path(spark, "archives")
    manifest = warc.write_archives(pages, folder)
    rows = warc.read_archives(manifest, folder).collect()
    assert len({r["record_id"] for r in rows}) == len(rows) == 8
    assert sorted(bytes(r["payload"]) for r in rows if r["record_type"] == "response") == [b"", b"aaa", b"bbb"]


def test_commit_compares_digests(spark, tmp_path):
    import pyarrow as pa

    name = warc.file_name(0, 0)
    (tmp_path / name).write_bytes(b"other")
    row = {"shard": 0, "number": 0, "attempt": "_temporary/gone", "records": 1, "bytes": 5, "sha1": "0" * 40}
    with pytest.raises(FileNotFoundError):
        list(warc._commit(str(tmp_path))(iter([pa.RecordBatch.from_pylist([row])])))
    row["sha1"] = warc.sha1_of(warc.shared_files(str(tmp_path))[0], str(tmp_path / name))
    assert len(list(warc._commit(str(tmp_path))(iter([pa.RecordBatch.from_pylist([row])])))) == 1
