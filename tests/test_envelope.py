import base64
import json

import pytest

from tidemark.sources import envelope


def b64(data):
    return base64.b64encode(data).decode()


POSITION = (1544272).to_bytes(8, "big") + b"\0\0"
PAYLOAD = bytes(range(256))
EVENT = {"event": {"id": "e1", "schemaId": "S", "payload": b64(PAYLOAD),
                   "headers": [{"key": "k", "value": b64(b"v")}]}, "replayId": b64(POSITION)}
BYTES = {"Event": {"Id": "e1", "SchemaId": "S", "Payload": list(PAYLOAD),
                   "Headers": [{"Key": "k", "Value": list(b"v")}]}, "ReplayId": list(POSITION)}


def check(rows, count=1):
    got = rows.collect()
    assert len(got) == count
    for row in got:
        assert (row["event_id"], row["schema_id"], row["replay_id"]) == ("e1", "S", 1544272)
        assert bytes(row["payload"]) == PAYLOAD
        assert [(h["key"], bytes(h["value"])) for h in row["headers"]] == [("k", b"v")]


def test_file_shapes(spark, tmp_path):
    shapes = {
        "response": ({"events": [EVENT, EVENT], "latestReplayId": "", "pendingNumRequested": 1},
                     envelope.read_responses, 2),
        "array": ([EVENT, EVENT, EVENT], envelope.read_event_arrays, 3),
        "bytes": ([BYTES], envelope.read_byte_event_arrays, 1),
    }
    for name, (content, read, count) in shapes.items():
        (tmp_path / name).write_text(json.dumps(content, indent=2))
        check(read(spark, str(tmp_path / name)), count)


def test_text_rows(spark):
    lines = spark.createDataFrame([(json.dumps(EVENT),)], "value string")
    check(envelope.from_event_json(lines))
    lines = spark.createDataFrame([(json.dumps({"events": [EVENT]}),)], "value string")
    check(envelope.from_response_json(lines))
    lines = spark.createDataFrame([(json.dumps(BYTES),)], "value string")
    check(envelope.from_byte_event_json(lines))


def test_payload_text(spark, tmp_path):
    (tmp_path / "one.txt").write_text(b64(PAYLOAD) + "\n")
    row = envelope.read_payload_text(spark, str(tmp_path / "one.txt"), "S").first()
    assert bytes(row["payload"]) == PAYLOAD and row["schema_id"] == "S" and row["replay_id"] is None


def test_json_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(EVENT) + "\n" + json.dumps(EVENT) + "\n")
    stream = envelope.stream_event_json(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    check(spark.read.parquet(str(tmp_path / "out")), 2)


def test_start_positions(spark):
    events = spark.range(10).withColumnRenamed("id", "replay_id")
    assert envelope.starting_from(events, "EARLIEST").count() == 10
    assert envelope.starting_from(events, "CUSTOM", 6).count() == 3
    assert envelope.starting_from(events, "LATEST", 9).count() == 0
    with pytest.raises(ValueError):
        envelope.starting_from(events, "LATEST")
    with pytest.raises(ValueError):
        envelope.starting_from(events, "SOMETIME")
