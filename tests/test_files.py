"""Markdown listing through the data source, and members of tar archives."""

import io
import os
import tarfile

import pytest

from lodestone.sources import files, markdown as md, records


def put(root, name, text="text"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def names(spark, root, **kw):
    return sorted(r["relative_path"] for r in md.scan_markdown(spark, str(root), "c", **kw).collect())


def test_names_that_spark_does_not_list(spark, tmp_path):
    for name in ("_x.md", ".y.md", "a.MD", "_deep/b.md", ".git/c.md", "node_modules/d.md", "deep/e.txt"):
        put(tmp_path, name)
    os.symlink(tmp_path / "a.MD", tmp_path / "link.md")
    os.symlink(tmp_path / "_deep", tmp_path / "folder")
    assert names(spark, tmp_path) == ["_deep/b.md", "_x.md", "a.MD"]
    # With an exclude list only that list excludes.
    assert names(spark, tmp_path, exclude=["a.*"]) == [".git/c.md", ".y.md", "_deep/b.md", "_x.md", "node_modules/d.md"]
    assert names(spark, tmp_path, include=["_*/*"]) == ["_deep/b.md"]
    assert names(spark, tmp_path, include=[]) == []


def test_roots_must_be_folders(spark, tmp_path):
    put(tmp_path, "a.md")
    os.symlink(tmp_path, tmp_path / "again")
    for bad in ("a.md", "none", "again"):
        with pytest.raises(Exception, match="must be a folder"):
            md.scan_markdown(spark, str(tmp_path / bad), "c").collect()
    (tmp_path / "empty").mkdir()
    assert names(spark, tmp_path / "empty") == []


def test_many_files_are_read_by_many_tasks(spark, tmp_path):
    for folder in range(20):
        (tmp_path / f"f{folder}").mkdir()
        for i in range(500):
            (tmp_path / f"f{folder}" / f"n{i}.md").write_text(f"{folder} {i}")
    scanned = md.scan_markdown(spark, f"file://{tmp_path}", "c")
    assert scanned.rdd.getNumPartitions() == 20
    rows = scanned.select("relative_path", "raw").collect()
    assert len(rows) == 10_000 and all(r["raw"] == "{} {}".format(*(x.strip("fn.md") for x in r["relative_path"].split("/"))) for r in rows)


def test_groups_are_bounded():
    sizes = [0, 10, 30, 5, 5, 90, 1]
    listed = [(f"/{i}", str(i), n) for i, n in enumerate(sizes)]
    groups = [[f[2] for f in g.files] for g in files.grouped(listed, 40, 3)]
    assert groups == [[0, 10, 30], [5, 5], [90], [1]]
    assert files.grouped([]) == []


def make_tar(path, members, fmt=tarfile.PAX_FORMAT):
    with tarfile.open(path, "w", format=fmt) as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    members = [(f"d{i % 3}/{'long' * 30 if i % 7 == 0 else 'm'}{i}.json", (f'{{"i": {i}}}' * (i % 50)).encode()) for i in range(400)]
    make_tar(tmp_path / "a.tar", members)
    make_tar(tmp_path / "b.tar", [("x.json", b"\xff\x00"), ("empty", b"")], tarfile.GNU_FORMAT)
    found = records.read_tar(spark, str(tmp_path), stretch_bytes=20_000)
    got = {(r["archive"].rsplit("/", 1)[-1], r["member"]): bytes(r["content"]) for r in found.collect()}
    assert got == {("a.tar", n): c for n, c in members} | {("b.tar", "x.json"): b"\xff\x00", ("b.tar", "empty"): b""}
    assert records.read_tar(spark, str(tmp_path / "a.tar"), members="d1/*").count() == sum(n.startswith("d1/") for n, _ in members)
    tasks = {r[0] for r in records.tar_index(spark, str(tmp_path)).selectExpr("floor(start / 20000)").distinct().collect()}
    assert len(tasks) > 3


def test_a_broken_archive_is_an_error(spark, tmp_path):
    make_tar(tmp_path / "a.tar", [("x", b"1" * 5000)])
    raw = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "a.tar").write_bytes(raw[:3000])
    with pytest.raises(Exception):
        records.read_tar(spark, str(tmp_path)).collect()
