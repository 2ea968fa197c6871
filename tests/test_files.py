"""A source tree read as a data source."""

import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.sources import files

TREE = {
    "a.ts": "x", ".env": "K=1", "__init__.py": "", "notes.md": "no", "Dockerfile": "FROM a", "pkg/_private.py": "p", "pkg/sub/deep/er/x.go": "g", "pkg/sub/é.java": "ü", "node_modules/m/i.js": "no", "pkg/dist/i.js": "no",
    "pkg/large.ts": "l" * (files.MAX_BYTES + 1), "pkg/full.ts": "l" * files.MAX_BYTES, "lib/package.json": "{}", "lib/data.json": "{}", "lib/openapi.json": "{}", "lib/db.SQL": "s",
}
KEPT = ["a.ts", ".env", "__init__.py", "Dockerfile", "pkg/_private.py", "pkg/sub/deep/er/x.go", "pkg/sub/é.java", "pkg/full.ts", "lib/package.json", "lib/openapi.json", "lib/db.SQL"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    (top / "pkg" / "bad.py").write_bytes(b"\xff\xfe")
    (top / "pkg" / "link").symlink_to(top)
    return str(top)


def test_all_files(spark, root):
    got = {r.path: (r.repo, r.content, r["size"], r.sha256) for r in files.source_files(spark, root, "web").collect()}
    assert got.pop("pkg/bad.py")[1] == "��"
    assert got == {p: ("web", TREE[p], len(TREE[p].encode()), hashlib.sha256(TREE[p].encode()).hexdigest()) for p in KEPT}
    assert files.source_files(spark, root).filter("repo is null").count() == len(KEPT) + 1 and files.source_files(spark, root + "/none").count() == 0


def test_filters_reach_the_listing(spark, root):
    every = files.source_files(spark, root)
    assert {r.path for r in every.filter(F.col("path").startswith("pkg/s")).collect()} == {"pkg/sub/deep/er/x.go", "pkg/sub/é.java"}
    assert [r.path for r in every.filter("path = 'lib/db.SQL'").collect()] == ["lib/db.SQL"] and every.filter(F.col("path").isin("a.ts", ".env", "notes.md")).count() == 2
    reader = files.TreeReader(root, None, 2)
    list(reader.pushFilters([files.StringStartsWith(("path",), "pkg/s"), files.EqualTo(("repo",), "x")]))
    assert [(p.path, p.below) for p in reader.partitions()] == [("", False), ("pkg", False), ("pkg/sub", True)]
    assert [(p.path, p.below) for p in files.TreeReader(root, None, 2).partitions()] == [("", False), ("lib", False), ("pkg", False), ("pkg/sub", True)]


def test_many_folders_are_dealt_to_few_tasks(spark, tmp_path):
    for k in range(3 * files.TASKS):
        (tmp_path / "lib" / f"s{k}").mkdir(parents=True)
        (tmp_path / "lib" / f"s{k}" / "a.ts").write_text(str(k))
    read = files.source_files(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= files.TASKS
    assert sorted((r.path, r.content) for r in read.collect()) == sorted((f"lib/s{k}/a.ts", str(k)) for k in range(3 * files.TASKS))
