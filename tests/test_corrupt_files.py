import gzip

import pytest

from shelfspark.sources import listings as io


def packed(n):
    return gzip.compress(("site,title,price\n" + "".join(
        f"A,Tea {i} {i * 7919 % 10007},{i}\n" for i in range(n))).encode())


def test_a_truncated_file_never_comes_back_in_part(spark, tmp_path):
    whole = packed(50_000)
    (tmp_path / "a.csv.gz").write_bytes(packed(10))
    (tmp_path / "b.csv.gz").write_bytes(whole[:len(whole) // 2])
    (tmp_path / "c.csv").write_text("site,title,price\nC,Oil,1\n")
    rows, left_out = io.read_many_checked(spark, [str(tmp_path / "*.csv*"), str(tmp_path / "absent.csv")])
    assert rows.count() == 11 and rows.where("site = 'A'").count() == 10
    assert [(p.rsplit("/", 1)[-1], why) for p, why in left_out] == [
        ("b.csv.gz", "corrupt"), ("absent.csv", "not found")]
    folder, lost = io.read_many_checked(spark, [str(tmp_path)])
    assert folder.count() == 11 and [p.rsplit("/", 1)[-1] for p, _ in lost] == ["b.csv.gz"]
    for columns in (None, ["site", "title", "price"]):
        with pytest.raises(Exception, match="(?i)read"):
            io.read_listings(spark, str(tmp_path / "b.csv.gz"), columns).count()


def test_a_mislabelled_file_is_left_out_whole(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(packed(10))
    (tmp_path / "b.csv.gz").write_bytes(b"not packed")
    assert io.read_listings(spark, str(tmp_path)).count() == 10
    assert io.first_bytes(spark, str(tmp_path / "b.csv.gz"), 3) == b"not"


def test_session_setting_does_not_bring_partial_reads_back(spark, tmp_path):
    whole = packed(50_000)
    (tmp_path / "b.csv.gz").write_bytes(whole[:len(whole) // 2])
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        with pytest.raises(Exception, match="(?i)read"):
            io.read_listings(spark, str(tmp_path / "b.csv.gz")).count()
        with pytest.raises(io.MissingColumns):
            io.read_many(spark, [str(tmp_path / "b.csv.gz")])
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
