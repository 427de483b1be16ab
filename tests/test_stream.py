import os

import pytest

from simulate import run
from test_fold import COLUMNS, as_table, frame, random_changes, spec
from test_tables import parts
from tidemark.plans.schema import parse_schema
from tidemark.sources import envelope
from tidemark.sources.tables import KeyedTable
from tidemark.streaming.pipeline import ChangeApplier, Configuration, start
from workload.encode import event, event_schema, optional

ENVELOPE = "event_id string, schema_id string, payload binary, replay_id bigint"


@pytest.mark.parametrize("soft", [False, True])
def test_stream_survives_a_failure_and_equals_the_batch(spark, tmp_path, soft):
    changes = random_changes(21, 200)
    table = KeyedTable(spark, str(tmp_path / "table"), spec(soft), at_least=80)
    failures = iter([False, True, False, False])

    def apply(batch, batch_id):
        table.apply(batch, batch_id)
        if next(failures):
            raise RuntimeError("the driver went away after the commit")

    for part in parts(changes, 3):
        rows = frame(spark, part)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for attempt in range(2):
            stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
            query = start(stream, apply, str(tmp_path / "checkpoint"))
            try:
                query.awaitTermination()
                break
            except Exception as error:
                assert attempt == 0 and "went away" in str(error)
    assert as_table(table.rows()) == run(changes, COLUMNS, soft)


OLD = event_schema("AccountChangeEvent", [optional("Phone", "string", "Data:Phone")])
NEW = event_schema("AccountChangeEvent", [
    optional("Name", "string", "Data:Text"), optional("Phone", "string", "Data:Phone")])
NOTE = event_schema("NoteChangeEvent", [optional("Text", "string", "Data:Text")])


class Settings:
    """Configuration tables that a test changes between batches."""

    def __init__(self):
        self.registry = [(1, "old", "AccountChangeEvent", OLD, 1), (3, "note", "NoteChangeEvent", NOTE, 1),
                         (4, "bad", "TaskChangeEvent", "{", 1)]
        self.bindings = [(1, 1, "AccountChangeEvent", "crm.account", "Active", False, None),
                         (2, 3, "NoteChangeEvent", "crm.note", "Active", False, None),
                         (3, 4, "TaskChangeEvent", "crm.task", "Active", False, None)]
        self.mappings = [(1, 1, "MappedSFKey", "id"), (2, 1, "Phone", "phone"), (3, 1, "Name", "name"),
                         (4, 2, "Text", "text"), (5, 3, "MappedSFKey", "id")]

    def __call__(self, spark):
        return Configuration(
            spark.createDataFrame(self.registry, "id bigint, schema_id string, record_name string, "
                                                 "schema_json string, date_created int"),
            spark.createDataFrame(self.bindings, "id bigint, avro_schema_id bigint, entity_name string, "
                                  "target_table string, state string, soft_delete_enabled boolean, "
                                  "soft_delete_column string"),
            spark.createDataFrame(self.mappings, "id bigint, binding_id bigint, source_field string, "
                                                 "target_column string"),
            spark.createDataFrame([(1, "A__chn", True)], "id int, full_name string, is_primary boolean"),
            spark.createDataFrame([(1, "AccountChangeEvent")], "channel_id int, selected_entity string"),
            {})


def envelopes(spark, rows):
    return spark.createDataFrame(
        [(f"e{i}", s, payload, i) for i, s, payload in rows], ENVELOPE)


def counted(applier, batch):
    rows = applier.outcomes().filter(f"batch = {batch}").collect()
    return {(r["binding_id"], r["change_type"], r["outcome"]): r["events"] for r in rows}


def test_pipeline_with_changing_configuration(spark, tmp_path):
    old, new = parse_schema(OLD), parse_schema(NEW)
    settings = Settings()
    applier = ChangeApplier(spark, str(tmp_path), settings, keep=1)
    applier.apply(envelopes(spark, [
        (1, "old", event(old, ["a"], "CREATE", values={"Phone": "1"})),
        (2, "old", event(old, ["b"], "CREATE", values={"Phone": "2"})),
        (3, "old", b"\0\0"),
        (4, "note", event(parse_schema(NOTE), ["n"], "CREATE", values={"Text": "t"})),
        (5, "bad", b"\0"),
        (6, "new", event(new, ["a"], "UPDATE", ["Name"], values={"Name": "early"})),
        (7, "old", event(old, ["b"], "UNDELETE")),
    ]), 0)
    assert counted(applier, 0) == {
        (1, "CREATE", "applied"): 2, (1, None, "bad payload"): 1, (2, None, "no key mapping"): 1,
        (3, None, "no schema"): 1, (None, None, "no schema"): 1, (1, "UNDELETE", "undelete skipped"): 1}
    # a revision arrives, and with it events that put the same field elsewhere
    settings.registry.append((2, "new", "AccountChangeEvent", NEW, 2))
    applier.apply(envelopes(spark, [
        (8, "new", event(new, ["a", "b"], "UPDATE", ["Name"], values={"Name": "x"})),
        (9, "old", event(old, ["b"], "UPDATE", ["Phone"], values={"Phone": "3"})),
        (10, "new", event(new, ["a"], "UPDATE", ["Phone"], values={"Phone": None})),
    ]), 1)
    from tidemark.streaming.pipeline import planned_bindings
    binding = planned_bindings(settings(spark), [1])[0][0]
    rows = {r["id"]: (r["phone"], r["name"]) for r in applier.table(binding).rows().collect()}
    assert rows == {"a": (None, "x"), "b": ("3", "x")}
    # switched off: its events are skipped from the next batch on
    settings.bindings[0] = (1, 2, "AccountChangeEvent", "crm.account", "Inactive", False, None)
    applier.apply(envelopes(spark, [(11, "new", event(new, ["a"], "DELETE"))]), 2)
    assert counted(applier, 2) == {(None, None, "inactive"): 1}
    assert applier.table(binding).rows().count() == 2
    failed = {(r["replay_id"], r["outcome"]) for r in applier.quarantine().collect()}
    assert failed == {(3, "bad payload"), (4, "no key mapping"), (5, "no schema"), (6, "no schema"),
                      (7, "undelete skipped"), (11, "inactive")}
    assert os.listdir(tmp_path / "batches" / "stream=none") == ["batch=2"]
    assert applier.table(binding).rows().count() == 2


def test_files_per_trigger_bound_a_batch(spark, tmp_path):
    rows = envelopes(spark, [(i, "s", b"") for i in range(6)])
    for i in range(3):
        rows.filter(f"replay_id div 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sizes = []
    stream = envelope.stream_envelopes(spark, str(tmp_path / "in"), files_per_trigger=1)
    start(stream, lambda batch, _: sizes.append(batch.count()), str(tmp_path / "cp")).awaitTermination()
    assert sizes == [2, 2, 2]


UPDATED = event_schema("NoteChangeEvent", [optional("Text", "string", "Data:Text"), optional("Title", "string", "Data:Text")])


def two_tables():
    """Notes and accounts bound, with nothing registered yet; texts come from a source."""
    settings = Settings()
    settings.bindings = [(1, None, "AccountChangeEvent", "crm.account", "Active", False, None),
                         (2, None, "NoteChangeEvent", "crm.note", "Active", True, "gone")]
    settings.mappings = [(1, 1, "MappedSFKey", "id"), (2, 1, "Phone", "phone"), (3, 1, "Name", "name"),
                         (4, 2, "MappedSFKey", "id"), (5, 2, "Text", "text"), (6, 2, "Title", "title")]
    texts = [("old", "AccountChangeEvent", OLD, 1), ("new", "AccountChangeEvent", NEW, 2),
             ("note", "NoteChangeEvent", NOTE, 1), ("note2", "NoteChangeEvent", UPDATED, 5)]
    settings.registry = []

    def read(spark):
        one = settings(spark)
        one.source = spark.createDataFrame(texts, "schema_id string, record_name string, schema_json string, date_created int")
        return one

    return read


def first_batch(spark):
    old, note = parse_schema(OLD), parse_schema(NOTE)
    return envelopes(spark, [
        (1, "old", event(old, ["a"], "CREATE", values={"Phone": "1"})),
        (2, "old", event(old, ["a"], "CREATE", values={"Phone": "2"})),
        (3, "old", event(old, ["x", "a"], "UPDATE", ["Phone"], values={"Phone": "3"})),
        (4, "note", event(note, ["n"], "UPDATE", ["Text"], values={"Text": "early"})),
        (5, "note", event(note, ["n"], "CREATE", values={"Text": "t"})),
        (6, "note", event(note, ["n"], "DELETE")),
        (9, "nobody", b"\0"),
    ])


def second_batch(spark):
    new, note = parse_schema(NEW), parse_schema(UPDATED)
    return envelopes(spark, [
        (2, "old", event(parse_schema(OLD), ["a"], "UPDATE", ["Phone"], values={"Phone": "late"})),
        (10, "new", event(new, ["a"], "UPDATE", ["Name"], values={"Name": "x"})),
        (11, "new", event(new, ["gone"], "DELETE")),
        (12, "note2", event(note, ["n"], "UNDELETE")),
        (13, "note2", event(note, ["n"], "UPDATE", ["Title"], values={"Title": "T"})),
    ])


def state_of(applier, spark, read):
    from tidemark.streaming.pipeline import planned_bindings
    settings = read(spark)
    settings.registry = applier.revisions.known(settings.registry)
    planned = planned_bindings(settings, [1, 2])[0]
    return [{tuple(r) for r in applier.table(b).rows().select(b.key_column, *sorted(b.columns)).collect()} for b in planned]


def test_outcomes_are_what_events_met_at_their_tables(spark, tmp_path):
    read = two_tables()
    applier = ChangeApplier(spark, str(tmp_path), read)
    applier.apply(first_batch(spark), 0)
    assert counted(applier, 0) == {
        (1, "CREATE", "applied"): 1, (1, "CREATE", "refused"): 1, (1, "UPDATE", "applied"): 1,
        (2, "UPDATE", "no row"): 1, (2, "CREATE", "applied"): 1, (2, "DELETE", "applied"): 1, (None, None, "no schema"): 1}
    applier.apply(second_batch(spark), 1)
    assert counted(applier, 1) == {
        (1, "UPDATE", "late"): 1, (1, "UPDATE", "applied"): 1, (1, "DELETE", "no row"): 1, (2, "UNDELETE", "applied"): 1,
        (2, "UPDATE", "applied"): 1}
    assert state_of(applier, spark, read) == [{("a", "x", "3")}, {("n", "t", "T")}]
    listed = {(r["replay_id"], r["outcome"]) for r in applier.quarantine().collect()}
    assert listed == {(2, "refused"), (4, "no row"), (9, "no schema"), (2, "late"), (11, "no row")}


def test_revisions_and_links_are_stored_once_however_often_a_batch_runs(spark, tmp_path, monkeypatch):
    read = two_tables()
    applier = ChangeApplier(spark, str(tmp_path), read, ask_table=False)
    commit = applier.log.commit

    def lost(manifests):
        raise RuntimeError("the driver went away before the commit")

    for number, batch in enumerate((first_batch(spark), second_batch(spark))):
        monkeypatch.setattr(applier.log, "commit", lost)
        with pytest.raises(RuntimeError):
            applier.apply(batch, number)
        monkeypatch.setattr(applier.log, "commit", commit)
        applier.apply(batch, number)
        applier.apply(batch, number)
    ids = applier.revisions.registered().collect()
    assert sorted(r["schema_id"] for r in ids) == ["new", "note", "note2", "old"]
    assert len({r["id"] for r in ids}) == 4
    links = spark.read.parquet(str(tmp_path / "links")).collect()
    named = {r["id"]: r["schema_id"] for r in ids}
    assert sorted((r["binding_id"], r["batch"], named[r["avro_schema_id"]]) for r in links) == [
        (1, 0, "old"), (1, 1, "new"), (2, 0, "note"), (2, 1, "note2")]
    settings = read(spark)
    current = applier.revisions.current(settings.bindings, settings.registry).collect()
    assert {(r["entity_name"], r["schema_id"]) for r in current} == {
        ("AccountChangeEvent", "new"), ("NoteChangeEvent", "note2")}
    assert state_of(applier, spark, read) == [{("a", "x", "3")}, {("n", "t", "T")}]


def test_all_bindings_are_written_by_one_job_and_committed_at_once(spark, tmp_path):
    read = two_tables()
    applier = ChangeApplier(spark, str(tmp_path), read, ask_table=False)
    applier.apply(first_batch(spark), 0)
    written = os.listdir(tmp_path / "changes" / "stream=none" / "batch=0")
    assert written == ["group=0"]
    parts = sorted(p for p in os.listdir(tmp_path / "changes" / "stream=none" / "batch=0" / "group=0") if "=" in p)
    assert parts == ["binding_id=1", "binding_id=2"]
    assert [p for p in os.listdir(tmp_path / "commits") if "=" in p] == ["commit=0"]
    assert {os.path.basename(at) for at in applier.log.newest()} == {"crm.account", "crm.note"}


def test_old_commits_and_their_files_go(spark, tmp_path):
    read = two_tables()
    applier = ChangeApplier(spark, str(tmp_path), read, keep=1, ask_table=False, at_least=0, share=0.0)
    old = parse_schema(OLD)
    for number in range(4):
        applier.apply(envelopes(spark, [(number, "old", event(old, [f"k{number}"], "CREATE", values={"Phone": "1"}))]), number)
    assert {r[0] for r in state_of(applier, spark, read)[0]} == {"k0", "k1", "k2", "k3"}
    assert [p for p in os.listdir(tmp_path / "commits") if "=" in p] == ["commit=3"]
    bases = [p for p in os.listdir(tmp_path / "tables" / "crm.account" / "base")]
    assert len(bases) == 1
