"""Many small files: written under given names by tasks, and found again by few tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspan.plans import registry
from quillspan.sources import readers, sinks


def rows(spark, n, content="x"):
    return spark.range(n).select(F.format_string("f%d/%d.%s", "id", "id", F.when(F.col("id") % 2 == 0, "flac").otherwise("mp3")).alias("path"), F.lit(content).alias("content"))


def test_named_files_have_the_names_given_and_replace_those_before(spark, tmp_path):
    root = f"file://{tmp_path}/files"
    assert sinks.named_files(rows(spark, 40), root) == 40
    assert sinks.named_files(rows(spark, 40, "other"), root) == 40
    found = {str(p.relative_to(tmp_path / "files")): p.read_text() for p in (tmp_path / "files").rglob("*") if p.is_file()}
    assert found == {r.path: "other" for r in rows(spark, 40).collect()}
    assert sinks.named_files(rows(spark, 0), root) == 0


def test_media_walk_writes_no_folder_for_each_file(spark, sf_dir, tmp_path):
    seen = []
    walked, readers.media_files = readers.media_files, lambda s, root, kinds: seen.append(root) or walked(s, root, kinds)
    try:
        registry.QUERIES["media_walk"](spark, sf_dir).collect()
    finally:
        readers.media_files = walked
    folders = {r.path.rpartition("/")[0] for r in walked(spark, seen[0], ["flac", "mp3"]).collect()}
    assert len(folders) == 1  # of fewer than a thousand pages


def tasks_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    return out, sum(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds)


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    root, before = f"file://{tmp_path}/files", spark.conf.get(readers.LISTING)
    sinks.named_files(rows(spark, 200), root)
    most = 4 * spark.sparkContext.defaultParallelism
    files, tasks = tasks_of(spark, "walk", lambda: readers.media_files(spark, root, ["flac"]))
    assert 0 < tasks <= most < 200
    assert files.count() == 100
    _, tasks = tasks_of(spark, "manifests", lambda: readers.manifests(spark, root, pattern="*.mp3"))
    assert 0 < tasks <= most
    assert spark.conf.get(readers.LISTING) == before


def test_a_listing_is_not_held_by_the_driver(spark, tmp_path):
    root = f"file://{tmp_path}/files"
    sinks.named_files(rows(spark, 400), root)
    files = readers.small_files(spark, root)
    assert len(files.inputFiles()) < 100  # not a file or a scan's part for each file that was found
    assert files.count() == 400 and readers.manifest_paths(spark, root, "*.mp3", files).count() == 200
    assert readers.folder_bytes(spark, root, files).first() == (400, 400)


def test_files_are_those_of_sparks_own_listing(spark, tmp_path):
    for name in ("a.txt", "p/b.txt", "p/q=1/r s/c%20.txt", "p/_x=1/d.json", "p/_y/e.txt", ".z/f.txt", "p/_g.txt", "p/_metadata", "h._COPYING_", "p/é[1].json"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(name)
    (tmp_path / "in" / "none").mkdir()
    for root in (f"file://{tmp_path}/in", f"{tmp_path}/in", f"{tmp_path}/in/*", f"{tmp_path}/in/p/q=1", f"{tmp_path}/in/a.txt"):
        for pattern in ("*", "*.txt", "[a-c]*", "*.{json,txt}", "?.txt"):
            own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
            assert sorted(readers.small_files(spark, root, pattern).collect()) == sorted(own.collect()), (root, pattern)
    with pytest.raises(FileNotFoundError):
        readers.small_files(spark, f"{tmp_path}/nothing")
