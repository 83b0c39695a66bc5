import datetime

import pytest

from tableflow.operators import contract
from tableflow.plans.validate import validate

FIELDS = [{"name": "id", "type": "LONG"}, {"name": "amount", "type": "DOUBLE"}, {"name": "day", "type": "DATE"}]


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_apply_schema(rows):
    df = rows([("2024-01-02", "7", "1.5", "x"), ("no", "7.5", "y", "x")], "day string, ID string, amount string, more string")
    out = contract.apply_schema(df, [*FIELDS, {"name": "gone", "type": "INT"}, {"name": "more", "type": "BLOB"}])
    assert out.dtypes == [
        ("id", "bigint"), ("amount", "double"), ("day", "date"), ("gone", "int"), ("more", "string")
    ]
    assert [tuple(r) for r in out.collect()] == [
        (7, 1.5, datetime.date(2024, 1, 2), None, "x"),
        (None, None, None, None, "x"),
    ]


def test_rejects_and_profile(rows):
    df = rows([("1", "x"), ("b", "2"), (None, None), ("c", "d")], "id string, amount string")
    fields = {"id": "LONG", "amount": "DOUBLE"}
    assert table(contract.rejects(df, fields)) == [
        ("1", "x", "amount", "x", "DOUBLE"),
        ("b", "2", "id", "b", "LONG"),
        ("c", "d", "amount", "d", "DOUBLE"),
        ("c", "d", "id", "c", "LONG"),
    ]
    assert table(contract.profile(df, fields)) == [("amount", "DOUBLE", 4, 3, 2), ("id", "LONG", 4, 3, 2)]


def test_order_output(rows):
    df = rows([(1, 2)], "a int, b int")
    assert contract.order_output(df, ["b", "a"]).columns == ["b", "a"]
    assert contract.order_output(df, []).columns == ["a", "b"]
    with pytest.raises(ValueError):
        contract.order_output(df, ["c"])


def spec(**changes):
    return {
        "pipeline": {"name": "p"},
        "datasource": {"type": "csv", "filePath": "x"},
        "inputSchema": {"fields": FIELDS},
        **changes,
    }


def test_sound_description(spark):
    steps = [
        {"type": "filter", "expression": "amount > 1 && id != null"},
        {"type": "project", "mappings": [{"from": "id", "to": "key"}, {"from": "amount", "to": "v"}]},
        {"type": "aggregate", "groupBy": ["key"], "aggregations": [{"field": "v", "function": "SUM", "alias": "s"}]},
        {"type": "rename", "mappings": [{"from": "s", "to": "total"}]},
    ]
    output = {"fields": [{"name": "key", "type": "LONG"}, {"name": "total", "type": "DOUBLE"}]}
    assert validate(spark, spec(transforms=steps, outputSchema=output)) == []


def test_all_issues_are_listed(spark):
    steps = [
        {"type": "project", "mappings": [{"from": "id", "to": "key"}]},
        {"type": "rename", "mappings": [{"from": "id", "to": "x"}]},
        {"type": "typeCast", "mappings": [{"field": "amount", "toType": "LONG"}]},
        {"type": "aggregate", "groupBy": ["zz"], "aggregations": [{"field": "yy", "function": "SUM"}]},
        {"type": "filter", "expression": "nowhere > 1"},
        {"type": "explode"},
    ]
    issues = validate(
        spark,
        spec(
            pipeline={"name": " "},
            datasource={"type": "mysql", "cursor": {"column": "seq"}},
            watermark={"column": "ts"},
            transforms=steps,
            outputSchema={"fields": [{"name": "total", "type": "DOUBLE"}]},
        ),
    )
    text = "\n".join(issues)
    for part in (
        "the pipeline has no name",
        "cursor: the input declares no field 'seq'",
        "watermark: the input declares no field 'ts'",
        "step 2 (rename): its input has no field 'id'",
        "step 3 (typeCast): its input has no field 'amount'",
        "step 4 (aggregate): its input has no field 'zz'",
        "step 4 (aggregate): its input has no field 'yy'",
        "step 5: ",
        "step 6: unknown step type 'explode'",
        "output: no step yields a field 'total'",
    ):
        assert part in text
    assert len(issues) == 10


def test_missing_parts(spark):
    assert validate(spark, {}) == [
        "the pipeline has no name", "no source is described", "the input has no declared fields"
    ]
