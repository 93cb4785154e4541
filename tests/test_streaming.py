from strataspark.operators.probe import Signature
from strataspark.streaming.watch import watch


def test_new_files_are_probed_once(spark, tmp_path):
    sig = [Signature("archive.zip", "Archive", "PK\x03\x04", "Exact"), Signature("image.qcow", "Image", "QFI\xfb", "Exact")]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_bytes(b"QFI\xfb....")
    q = watch(spark, str(folder), sig).writeStream.format("memory").queryName("probed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        (folder / "b").write_bytes(b"PK\x03\x04..")
        (folder / "c").write_bytes(b"??")
        q.processAllAvailable()
        got = {r["logical_path"].rsplit("/", 1)[1]: r["format_id"] for r in spark.table("probed").collect()}
    finally:
        q.stop()
    assert got == {"a": "image.qcow", "b": "archive.zip", "c": None} and spark.table("probed").count() == 3
