import os
import random

import pytest
from pyspark.sql import functions as F

from simulate import run
from test_fold import COLUMNS, as_table, frame, random_changes, spec
from tidemark.operators.fold import FoldSpec
from tidemark.sources.tables import KeyedTable, for_dialect


def parts(changes, count, seed=0):
    changes = sorted(changes, key=lambda c: c["replay_id"])
    cuts = sorted(random.Random(seed).sample(range(1, len(changes)), count - 1))
    return [changes[lo:hi] for lo, hi in zip([0, *cuts], [*cuts, len(changes)])]


@pytest.mark.parametrize("soft, at_least, small", [
    (False, 150, 500), (True, 150, 500), (False, 150, 0), (True, 150, 0), (False, 10**9, 500)])
def test_batches_add_up_with_and_without_compaction(spark, tmp_path, soft, at_least, small):
    changes = random_changes(11)
    table = KeyedTable(spark, str(tmp_path), spec(soft), share=0.5, at_least=at_least, small=small)
    assert table.rows() is None and table.version() is None
    for version, part in enumerate(parts(changes, 4)):
        table.apply(frame(spark, part), version)
    assert table.version() == 3
    assert as_table(table.rows()) == run(changes, COLUMNS, soft)
    assert (table._newest()["base"] is not None) == (at_least < 10**9)


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    first, second = parts(random_changes(12), 2)
    table = KeyedTable(spark, str(tmp_path), spec(False))
    table.apply(frame(spark, first), 0)
    table.apply(frame(spark, second), 1)
    before = as_table(table.rows())
    table.apply(frame(spark, first), 0)
    table.apply(frame(spark, second), 1)
    assert as_table(table.rows()) == before and table.version() == 1


def test_a_batch_that_failed_before_its_manifest_is_redone(spark, tmp_path, monkeypatch):
    first, second = parts(random_changes(13), 2)
    table = KeyedTable(spark, str(tmp_path), spec(False), at_least=10)
    table.apply(frame(spark, first), 0)
    before = as_table(table.rows())

    def fail(manifest):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as patched:
        patched.setattr(table, "_commit", fail)
        with pytest.raises(RuntimeError):
            table.apply(frame(spark, second), 1)
    # readers still see the last complete version
    assert as_table(table.rows()) == before and table.version() == 0
    table.apply(frame(spark, second), 1)
    assert as_table(table.rows()) == run(first + second, COLUMNS)


def test_replayed_create_does_not_bring_a_deleted_key_back(spark, tmp_path):
    create = {"key": 1, "replay_id": 1, "change_type": "CREATE", "values": {"name": "a"}}
    delete = {"key": 1, "replay_id": 2, "change_type": "DELETE", "values": {}}
    table = KeyedTable(spark, str(tmp_path), spec(False), at_least=0)
    table.apply(frame(spark, [create, delete]), 0)
    table.apply(frame(spark, [create]), 1)
    assert table.rows().count() == 0
    assert [(r["key"], r["live"]) for r in table.tracked().collect()] == [(1, False)]
    table.forget_deleted(F.lit(10))
    table.forget_deleted(F.lit(10))
    assert table.tracked().count() == 0 and table.version() == 1
    # the next batch is not mistaken for one that was done already
    later = {**create, "replay_id": 11}
    table.apply(frame(spark, [later]), 2)
    assert table.rows().count() == 1 and table.version() == 2
    table.expire(keep=1)
    assert table.rows().count() == 1


def test_empty_batches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), spec(False), at_least=0)
    table.apply(frame(spark, []), 0)
    assert table.version() == 0 and table.rows() is None
    table.apply(frame(spark, random_changes(14, 30)), 1)
    rows = as_table(table.rows())
    table.apply(frame(spark, []), 2)
    assert as_table(table.rows()) == rows and table.version() == 2


def test_expire_keeps_what_readers_need(spark, tmp_path):
    changes = random_changes(15)
    table = KeyedTable(spark, str(tmp_path), spec(False), at_least=120)
    for version, part in enumerate(parts(changes, 5)):
        table.apply(frame(spark, part), version)
    table.expire(keep=1)
    assert as_table(table.rows()) == run(changes, COLUMNS)
    assert len(list((tmp_path / "manifest").glob("version=*/step=*"))) == 1
    listed = len([d for d in os.listdir(tmp_path / "changes") if d.startswith("version")])
    assert listed == len(table._newest()["changes"])


def test_column_mapped_later(spark, tmp_path):
    first = frame(spark, [
        {"key": 1, "replay_id": 1, "change_type": "CREATE", "values": {"name": "a"}}])
    narrow = FoldSpec(key=("key",), columns=("name",))
    KeyedTable(spark, str(tmp_path), narrow, at_least=0).apply(first, 0)
    second = frame(spark, [
        {"key": 1, "replay_id": 2, "change_type": "UPDATE", "values": {"amount": 5.0}},
        {"key": 2, "replay_id": 3, "change_type": "CREATE", "values": {"name": "b"}}])
    table = KeyedTable(spark, str(tmp_path), spec(False), at_least=10)
    table.apply(second, 1)
    assert as_table(table.rows()) == {1: {"name": "a", "amount": 5.0}, 2: {"name": "b", "amount": None}}


def test_dialect_without_booleans(spark):
    rows = spark.sql("SELECT true AS flag, timestamp'2024-01-15 10:30:45' AS at, 1 AS n")
    assert tuple(for_dialect(rows, "sqlite").first()) == (1, "2024-01-15 10:30:45", 1)
    assert for_dialect(rows, "postgres").schema == rows.schema


def change(replay_id, kind, key=1, **values):
    return {"key": key, "replay_id": replay_id, "change_type": kind, "values": values}


@pytest.mark.parametrize("at_least", [0, 10**9])
@pytest.mark.parametrize("soft", [False, True])
def test_late_changes_count_whenever_the_base_was_made(spark, tmp_path, soft, at_least):
    arrivals = [
        [change(1, "CREATE", name="a", amount=1.0), change(5, "UPDATE", 2, amount=9.0)],
        [change(7, "UPDATE", name="b"), change(3, "CREATE", 2, name="late"), change(9, "CREATE", 3, name="n")],
        [change(5, "UPDATE", amount=9.0), change(4, "DELETE", 3), change(2, "CREATE", 3, name="m")],
    ]
    table = KeyedTable(spark, str(tmp_path), spec(soft), at_least=at_least)
    for number, part in enumerate(arrivals):
        table.apply(frame(spark, part), number)
    every = sorted((c for part in arrivals for c in part), key=lambda c: c["replay_id"])
    got = as_table(table.rows())
    assert got == run(every, COLUMNS, soft)
    assert got[1]["amount"] == 9.0 and got[2]["amount"] == 9.0


@pytest.mark.parametrize("soft, at_least, seed", [(False, 0, 1), (True, 0, 2), (False, 40, 3), (True, 40, 4)])
def test_any_order_of_arrival_gives_the_same_rows(spark, tmp_path, soft, at_least, seed):
    changes = random_changes(20 + seed)
    shuffled = changes[:]
    random.Random(seed).shuffle(shuffled)
    size = -(-len(shuffled) // 4)
    table = KeyedTable(spark, str(tmp_path), spec(soft), share=0.1, at_least=at_least)
    for number in range(4):
        table.apply(frame(spark, shuffled[number * size:(number + 1) * size]), number)
    assert as_table(table.rows()) == run(changes, COLUMNS, soft)


def test_numbers_of_another_stream_are_not_taken_for_done(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), spec(False))
    for number in range(3):
        table.apply(frame(spark, [change(number + 1, "CREATE", number)]), number, stream="old")
    table.apply(frame(spark, [change(9, "CREATE", 9)]), 0, stream="new")
    table.apply(frame(spark, [change(10, "CREATE", 10)]), 0, stream="new")
    assert set(as_table(table.rows())) == {0, 1, 2, 9} and table.version() == 3


def test_files_stay_few_with_sparse_batch_numbers(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), spec(False), keep=2, folders=3)
    for number in range(12):
        table.apply(frame(spark, [change(number + 1, "CREATE", number)]), 2 * number + 1)
    assert len(as_table(table.rows())) == 12
    assert len(list((tmp_path / "manifest").glob("version=*/step=*"))) <= 4
    assert len(table._newest()["changes"]) <= 3
    assert len([d for d in os.listdir(tmp_path / "changes") if not d.startswith(".")]) <= 8
