"""Paths of every kind, as Spark lists them and as pyarrow opens them."""

import pytest
from pyarrow import fs

from tessera.sources import files


@pytest.mark.parametrize("name", ["plain.txt", "a b.txt", "50%41.txt", "x[1]{2}?*.txt", "é/ü.txt", "colon:1.txt"])
def test_any_name(tmp_path, name):
    at = tmp_path / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(b"0123456789")
    for path in (str(at), f"file:{at}", f"file://{at}"):
        assert files.read(path) == b"0123456789" and files.read(path, 4) == b"0123" and files.is_file(path)
        assert not files.is_file(path + "x") and not files.is_file(str(tmp_path))


def test_other_systems(monkeypatch):
    asked = []
    monkeypatch.setattr(files, "_system", lambda scheme, authority: (asked.append((scheme, authority)), (fs.LocalFileSystem(), "bucket"))[1])
    assert files.place("s3a://bucket/a/b%20c")[1] == "bucket/a/b%20c" and asked == [("s3a", "bucket")]
    assert files.place("hdfs://host:8020/a/b")[1] == "bucket/a/b" and asked[-1] == ("hdfs", "host:8020")


def test_patterns_are_read_as_they_are():
    assert files.literal("/a/[b]{c}?*\\d") == "/a/\\[b\\]\\{c\\}\\?\\*\\\\d"
