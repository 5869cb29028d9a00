"""Every query over empty tables, over rows of nulls alone, and over rows of empty strings: none may fail."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


@pytest.fixture(scope="module", params=["empty", "nulls", "blanks"])
def tables(request, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp(request.param)
    for f in os.listdir(sf):
        schema = pq.read_schema(f"{sf}/{f}").remove_metadata()
        n = 0 if request.param == "empty" else 3
        cols = []
        for field in schema:
            value = "" if request.param == "blanks" and pa.types.is_string(field.type) else None
            cols.append(pa.array([value] * n, field.type))
        pq.write_table(pa.Table.from_arrays(cols, schema=pa.schema([pa.field(x.name, x.type) for x in schema])), at / f)
    return request.param, str(at)


@pytest.mark.parametrize("name", [n for n in QUERIES if n[0] == "p" and n[1].isdigit()])
def test_data_problems(spark, tables, name):
    kind, at = tables
    rows = QUERIES[name](spark, at).collect()
    if kind == "empty":
        assert not rows or name.endswith(("shares", "check"))
    if name.endswith("_found"):
        assert not rows


@pytest.mark.parametrize("name", [n for n in QUERIES if not (n[0] == "p" and n[1].isdigit())])
def test_the_others(spark, tables, name):
    QUERIES[name](spark, tables[1]).collect()
