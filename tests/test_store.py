"""Versions, incremental updates and the event stream."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from helpers import DEVELOP, MASTER, TOPIC, World, random_world, refs_by_id
from lodeseek import schemas
from lodeseek.functions.keys import Buckets
from lodeseek.plans import indexing
from lodeseek.settings import Limits
from lodeseek.sources import adapters as src
from lodeseek.sources.store import DocumentStore
from lodeseek.streaming.updates import apply_events, run_updates
from test_plans import explain

LIMITS = Limits(indexing_enabled=True)


def check(store, world):
    assert refs_by_id(store.read("files")) == world.files()
    assert refs_by_id(store.read("commits")) == world.commits()


@pytest.fixture
def store(spark, tmp_path):
    return DocumentStore(spark, str(tmp_path / "store"))


def test_full_build_and_versions(spark, store):
    world = random_world(random.Random(1))
    assert indexing.full_build(store, world.sources(spark), Limits()) is None  # indexing is off
    assert store.versions() == []
    assert store.read("files").count() == 0
    assert indexing.full_build(store, world.sources(spark), LIMITS) == 1
    check(store, world)
    store.create_views("t")
    assert spark.table("t_files").count() == len(world.files())
    row = store.read("files").filter("path like '%.py'").first()
    assert row["extension"] == "py" and row["doc_id"].endswith("^:/" + row["path"])
    one = store.repository("files", "proj", "two")
    assert {r["repository"] for r in one.select("repository").collect()} == {"two"}
    assert one.count() == store.read("files").filter("repository = 'two'").count()
    with pytest.raises(AnalysisException):  # a second writer of the same version is refused
        store.publish(1, {"files": None})


@pytest.mark.parametrize("seed", [2, 3])
def test_update_equals_rebuild_and_repeats(spark, store, seed):
    rng = random.Random(seed)
    world = random_world(rng)
    indexing.full_build(store, world.sources(spark), LIMITS)
    for _ in range(2):
        other = random_world(rng)
        key = rng.choice(list(world.trees))
        world.trees[key], world.histories[key] = other.trees[key], other.histories[key]
        before = store.read("files", store.latest())
        expected_before = refs_by_id(before)
        indexing.update_all(store, world.sources(spark), LIMITS)
        check(store, world)
        assert refs_by_id(before) == expected_before  # an open reader keeps its version
        again = indexing.update_all(store, world.sources(spark), LIMITS)
        assert again == store.latest()
        check(store, world)


def test_unselected_refs_are_left_out(spark, store):
    world = random_world(random.Random(4))
    world.regex["proj", "one"] = "refs/heads/(topic"  # does not compile: selects nothing
    indexing.full_build(store, world.sources(spark), LIMITS)
    names = {r["repository"] for r in store.read("files").select("repository").distinct().collect()}
    assert "one" not in names and names
    assert store.read("checkpoints").filter(F.col("ref") == TOPIC).count() == 0


def events(spark, *rows):
    data = [(i, None, "proj", repo, ref, change) for i, (repo, ref, change) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.REF_EVENTS).withColumn(
        "ts", F.timestamp_seconds(F.col("event_id")))


def test_events(spark, store):
    world = random_world(random.Random(5))
    indexing.full_build(store, world.sources(spark), LIMITS)
    world.drop("proj", "one", DEVELOP)
    world.trees["proj", "two", MASTER] = {"new.txt": b"new text"}
    batch = events(spark, ("one", DEVELOP, "DELETE"), ("two", MASTER, "UPDATE"), ("two", MASTER, "UPDATE"),
                   ("two", "refs/tags/v1", "ADD"), ("three", TOPIC, "UPDATE"))
    for _ in range(2):  # a batch that runs twice ends in the same state
        apply_events(batch, store, world.sources(spark), LIMITS)
        check(store, world)
    for ref in (MASTER, DEVELOP, TOPIC):
        world.drop("proj", "three", ref)
    apply_events(events(spark, ("three", None, "REPO_DELETED")), store, world.sources(spark), LIMITS)
    check(store, world)
    assert store.read("checkpoints").filter("repository = 'three'").count() == 0


def test_stream_with_restart(spark, store, tmp_path):
    world = random_world(random.Random(6))
    indexing.full_build(store, world.sources(spark), LIMITS)
    folder = str(tmp_path / "events")

    def run():
        stream = spark.readStream.schema(schemas.REF_EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        query = run_updates(stream, store, lambda: world.sources(spark), LIMITS, str(tmp_path / "progress"))
        query.awaitTermination(120)
        assert query.exception() is None and not query.isActive

    world.trees["proj", "one", MASTER] = {"a.py": b"first"}
    events(spark, ("one", MASTER, "UPDATE")).coalesce(1).write.mode("append").parquet(folder)
    run()
    check(store, world)
    seen = store.latest()
    run()  # nothing new: no version is written
    assert store.latest() == seen
    world.drop("proj", "two", DEVELOP)
    events(spark, ("two", DEVELOP, "DELETE")).coalesce(1).write.mode("append").parquet(folder)
    run()
    check(store, world)
    assert store.latest() == seen + 1


def test_delta_functions_match_rebuild(spark):
    rng = random.Random(7)
    from lodeseek.operators import deltas
    from lodeseek.sources import snapshots

    old, new = random_world(rng), random_world(rng)
    a, b = old.sources(spark), new.sources(spark)
    before = snapshots.build_files(snapshots.documents_of_tree(a.tree), a.blobs, LIMITS)
    delta = deltas.tree_delta(a.tree, b.tree)
    every = (MASTER, DEVELOP, TOPIC)
    after = indexing.apply_delta(before, delta, b.blobs, LIMITS)
    assert refs_by_id(after) == new.files(selected=every)
    twice = indexing.apply_delta(after, delta, b.blobs, LIMITS)
    assert refs_by_id(twice) == new.files(selected=every)
    gained, lost = deltas.commit_delta(a.reach, b.reach)
    commits = snapshots.build_commits(snapshots.commits_of_reach(a.reach), a.log)
    assert refs_by_id(indexing.apply_commit_delta(commits, gained, lost, b.log)) == new.commits(every)


def test_size_and_binary_limits(spark, store):
    world = World()
    world.set("p", "r", MASTER, {"big": b"x" * 1025, "fits": b"x" * 1024, "bin": b"A\x00\xff", "latin": b"A\t\n\xe9"}, {"c"})
    limits = Limits(indexing_enabled=True, max_file_size=1024)
    indexing.full_build(store, world.sources(spark), limits)
    rows = {r["path"]: r for r in store.read("files").collect()}
    assert set(rows) == {"fits", "latin"}
    assert rows["latin"]["contents"] == "A\t\n�"
    assert refs_by_id(store.read("files")) == world.files(max_size=1024)


def test_bucket_numbers_are_kept_and_versions_expire(spark, tmp_path):
    world = random_world(random.Random(8))
    store = DocumentStore(spark, str(tmp_path / "s"), Buckets(4, 3))
    indexing.full_build(store, world.sources(spark), LIMITS)
    assert {r["bucket"] for r in store.read("files").select("bucket").distinct().collect()} <= set(range(12))
    with pytest.raises(ValueError, match="buckets"):
        DocumentStore(spark, store.root).read("files")
    world.trees["proj", "one", MASTER] = {"z.py": b"zz"}
    indexing.update_all(store, world.sources(spark), LIMITS)
    check(store, world)
    with pytest.raises(ValueError):
        store.expire(3)
    assert store.expire(2) == 1
    assert store.versions() == [2]
    check(store, world)


class Broken(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "publish", "stage"])
def test_a_crash_is_in_nobodys_way(spark, store, monkeypatch, step):
    world = random_world(random.Random(9))
    real = getattr(DocumentStore, step)

    def cut_off(self, *args):
        if step != "publish":
            real(self, *args)
        raise Broken

    for run in (indexing.full_build, indexing.update_all):
        before = store.latest()
        monkeypatch.setattr(DocumentStore, step, cut_off)
        with pytest.raises(Broken):
            run(store, world.sources(spark), LIMITS)
        monkeypatch.setattr(DocumentStore, step, real)
        assert store.latest() == before
        assert run(store, world.sources(spark), LIMITS) == before + 1
        check(store, world)
        world.trees["proj", "one", MASTER] = {"after.py": b"crash"}


def test_an_unfinished_manifest_is_passed_over(spark, store, tmp_path):
    (tmp_path / "store/versions/version=1/_temporary").mkdir(parents=True)
    world = random_world(random.Random(10))
    assert indexing.full_build(store, world.sources(spark), LIMITS) == 2
    assert store.versions() == [2]
    check(store, world)


def test_a_second_writer_is_refused(spark, store):
    world = random_world(random.Random(11))
    indexing.full_build(store, world.sources(spark), LIMITS)
    other = DocumentStore(spark, store.root)
    version = other.begin()
    indexing.full_build(store, world.sources(spark), LIMITS)
    with pytest.raises(AnalysisException):
        other.publish(version, {})
    with pytest.raises(RuntimeError):
        other.publish(version + 1, {})


def test_purge_of_everything_and_recreation(spark, store):
    world = World()
    world.set("proj", "one", MASTER, {"a.py": b"text"}, {"c"})
    indexing.full_build(store, world.sources(spark), LIMITS)
    # Deleted and made again before the batch ran: what the catalog lists now is indexed.
    world.set("proj", "one", MASTER, {"b.py": b"other"}, {"d"})
    apply_events(events(spark, ("one", None, "REPO_DELETED"), ("one", MASTER, "ADD")), store, world.sources(spark), LIMITS)
    check(store, world)
    assert store.read("files").count() == 1
    world.drop("proj", "one", MASTER)
    apply_events(events(spark, ("one", None, "REPO_DELETED")), store, world.sources(spark), LIMITS)
    assert store.latest() == 3
    assert store.read("files").count() == store.read("commits").count() == store.read("checkpoints").count() == 0
    world.set("proj", "one", MASTER, {"c.py": b"back"}, {"e"})
    indexing.update_all(store, world.sources(spark), LIMITS)
    check(store, world)


def test_reindex_of_a_repository(spark, store):
    world = random_world(random.Random(12))
    indexing.full_build(store, world.sources(spark), LIMITS)
    before = {r["doc_id"]: r["contents"] for r in store.read("files").collect()}
    assert indexing.reindex_repository(store, world.sources(spark), "proj", "two", LIMITS) == 2
    check(store, world)
    assert {r["doc_id"]: r["contents"] for r in store.read("files").collect()} == before


def test_branches_that_went_while_nobody_looked(spark, store):
    world = random_world(random.Random(13))
    indexing.full_build(store, world.sources(spark), LIMITS)
    world.drop("proj", "one", MASTER)
    indexing.update_all(store, world.sources(spark), LIMITS)
    check(store, world)


def test_no_change_writes_nothing_and_reads_no_blob(spark, store, monkeypatch):
    from lodeseek.sources import snapshots

    world = World()
    world.set("proj", "one", MASTER, {"a.py": b"text", "img.bin": b"A\x00", "empty": b""}, {"c"})
    indexing.full_build(store, world.sources(spark), LIMITS)
    assert store.read("tree").count() == 3
    asked = []
    real = snapshots.needed_blobs
    monkeypatch.setattr(snapshots, "needed_blobs", lambda b, missing, size: asked.extend(
        r["path"] for r in missing.collect()) or real(b, missing, size))
    every = world.sources(spark).branches.select("project", "repository", "ref")
    assert indexing.sync_refs(store, world.sources(spark), every, LIMITS) == 1
    assert store.versions() == [1] and asked == []
    world.trees["proj", "one", MASTER]["b.py"] = b"more"
    assert indexing.sync_refs(store, world.sources(spark), every, LIMITS) == 2
    check(store, world)
    assert asked == ["b.py"]


def test_a_new_branch_on_known_files_reads_no_blob(spark, store, monkeypatch):
    from lodeseek.sources import snapshots

    world = World()
    world.set("proj", "one", MASTER, {"a.py": b"text", "img.bin": b"A\x00"}, {"c"})
    indexing.full_build(store, world.sources(spark), LIMITS)
    world.set("proj", "one", DEVELOP, {"a.py": b"text"}, {"c"})
    monkeypatch.setattr(snapshots, "needed_blobs", lambda b, missing, size: b.limit(0) if missing.isEmpty() else 1 / 0)
    indexing.update_all(store, world.sources(spark), LIMITS)
    check(store, world)


def test_blobs_of_both_tips_are_read_from_what_differs(spark):
    folder = "/root/testdata/sf0.001"
    both = src._snapshot(spark, folder, src.OLD_TIP).unionByName(src._snapshot(spark, folder, src.NEW_TIP))
    found = src.blobs(spark, folder)
    wanted = {(r["b"], r["contents"]) for r in both.select(F.sha1("contents").alias("b"), "contents").distinct().collect()}
    rows = found.select("blob", F.decode("content", "UTF-8").alias("contents")).collect()
    assert {(r["blob"], r["contents"]) for r in rows} == wanted and len(rows) == len(wanted)
    assert "EqualTo(lang,de)" in explain(found)  # the new tip's unchanged contents are not read a second time
