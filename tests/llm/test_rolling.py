import random

from shelfspark.llm import warc
from shelfspark.session import work_path


def test_default_ranges_roll_by_compressed_size(spark):
    r, scale = random.Random(1), 64
    rows = [(i, f"u{i}", " ".join(f"w{r.randrange(10**4)}" for _ in range(500))) for i in range(1200)]
    folder = work_path(spark, "warc")
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder,
                                   shard_bytes=warc.SHARD_BYTES // scale, file_bytes=warc.FILE_BYTES // scale)
    files = manifest.collect()
    rolled = [f for f in files if f["number"] > 0]
    assert len(rolled) >= len({f["shard"] for f in files})
    assert warc.read_archives(manifest, folder).count() == 1200
