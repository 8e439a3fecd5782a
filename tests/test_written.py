"""Tables that are written for a run only."""

from pathlib import Path

from scanloom.llm.shared import cut, numbered
from scanloom.written import PLAIN_FILES, shared_folder


def files(spark):
    return {p for p in Path(shared_folder(spark).removeprefix("file://")).rglob("*") if p.is_file()}


def test_no_checksum_files(spark):
    """Each would cost a chmod process beside its file's."""
    before = files(spark)
    rows = spark.range(0, 100, 1, 4)
    one, two = cut(rows), numbered(rows)
    made = files(spark) - before
    assert len([p for p in made if p.name.startswith("part-")]) >= 8
    assert not [p.name for p in made if p.name.endswith(".crc")]
    assert one.count() == two.count() == 100
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert not any(conf.get(name) for name in PLAIN_FILES)


def test_a_file_system_of_the_users_stays(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.file.impl", "org.apache.hadoop.fs.LocalFileSystem")
    try:
        assert cut(spark.range(10)).count() == numbered(spark.range(10)).count() == 10
        assert conf.get("fs.file.impl") == "org.apache.hadoop.fs.LocalFileSystem"
    finally:
        conf.unset("fs.file.impl")
