"""Columns of encoded events are those of the encoder that goes row by row."""

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.plans.schema import parse_schema
from tidemark.sources import envelope
from workload import encode, payloads

ROWS = [
    (["C1", "C22"], "CREATE", [], "O", 1.5, 1_700_000_000_000, "st1", 0.25),
    (["C3"], "UPDATE", ["Status", "TotalPrice"], None, -2.0, -5, None, None),
    ([], "UPDATE", ["OrderDate", "Home.Street"], "é" * 200, 0.0, 1 << 62, "", None),
    (["x" * 3000, ""], "DELETE", [], "", None, None, "z", 3.0),
]


def test_columns_equal_the_encoder_by_row():
    for text in encode.REVISIONS.values():
        schema = parse_schema(text)
        ids, kinds, changed, status, price, ordered, street, latitude = (
            pa.array(c, t) for c, t in zip(zip(*ROWS, strict=True), [
                pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.string(), pa.float64(), pa.int64(),
                pa.string(), pa.float64()], strict=True))
        home = pa.StructArray.from_arrays([street, latitude], ["Street", "Latitude"], mask=street.is_null())
        values = pa.StructArray.from_arrays([status, price, ordered, home], ["Status", "TotalPrice", "OrderDate", "Home"])
        got = encode.event_column(schema, ids, kinds, changed, "Customer", values).to_pylist()
        assert got == [encode.event(schema, i, k, c, "Customer", values={
            "Status": s, "TotalPrice": p, "OrderDate": o, "Home": None if st is None else {"Street": st, "Latitude": la},
        }) for i, k, c, s, p, o, st, la in ROWS]


def test_all_bytes_as_numbers_and_back(spark):
    rows = spark.createDataFrame([(bytes(range(256)),), (b"",), (None,), (b"\n\x00\xff\x00",)], "v binary")
    got = rows.select("v", payloads.byte_list(F.col("v")).alias("n")).withColumn("back", envelope._bytes(F.col("n"))).collect()
    for r in got:
        assert r["n"] == (None if r["v"] is None else list(r["v"])) and r["back"] == r["v"]


def test_numbers_that_are_no_bytes_stay_as_they_were(spark):
    odd = spark.sql("SELECT array(300, -1, 7, 255, 256) AS n")
    was = F.unhex(F.array_join(F.transform("n", lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    assert odd.select(envelope._bytes(F.col("n")) == was).first()[0]


def test_envelopes_are_parsed_once(spark, sf_dir):
    plan = payloads.envelope_bytes(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any("Filter" in line and "from_json" in line for line in plan.splitlines())
