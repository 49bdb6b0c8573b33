import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vellumine import types as t

KINDS = ["Boolean", "Integer", "Float", "String", "Date", "DateTime", "Array(Integer)", "Array(Float)", "Array(String)", "Array(Array(Integer))"]


@given(st.sampled_from(KINDS), st.sampled_from(KINDS), st.sampled_from(KINDS))
def test_widening_is_a_join(a, b, c):
    assert t.widen(a, a) == a
    assert t.widen(a, b) == t.widen(b, a)
    assert t.widen(t.widen(a, b), c) == t.widen(a, t.widen(b, c))


@pytest.mark.parametrize(
    ("a", "b", "wide"),
    [("Integer", "Float", "Float"), ("Date", "DateTime", "String"), ("Boolean", "Integer", "String"), ("Array(Integer)", "Array(Float)", "Array(Float)"), ("Array(Integer)", "Integer", "String"), ("Date", "String", "String"), ("Array(Date)", "Array(String)", "Array(String)")],
)
def test_widening_pairs(a, b, wide):
    assert t.widen(a, b) == wide


@pytest.mark.parametrize(
    ("value", "kind"),
    [(True, "Boolean"), (1, "Integer"), (1.0, "Float"), ("2024-02-29", "Date"), ("2024-02-30", "String"), ("2024-1-1", "String"), ("2024-01-15T10:00:00Z", "DateTime"), ("2024-01-15T10:00:00.5+02:00", "DateTime"), ("2024-01-15T10:00:00", "String"), ("2024-01-15T25:00:00Z", "String"), ([], "Array(String)"), ([1, 2.5], "Array(Float)"), ([None], "Array(String)"), (None, "String"), ((1 << 64) - 1, "Integer"), ([{"a": 1}], "Array(Object)")],
)
def test_type_of(value, kind):
    assert t.type_of(value) == kind


@pytest.mark.parametrize("text", ["Object", "Array(Array(String))", "Array(Object)", "@Name", "Strin", ""])
def test_types_that_cannot_be_declared(text):
    with pytest.raises(t.FieldTypeError, match="column"):
        t.parse_type(text)


def test_stored_values():
    assert t.stored_value((1 << 63), "Integer") is None
    assert t.stored_value(3, "Float") == 3.0
    assert t.stored_value([1, "a"], "String") == '[1,"a"]'
    assert t.stored_value("x", "Date") is None
    assert t.stored_value("2024-01-15T10:00:00.1239+02:00", "DateTime") == dt.datetime(2024, 1, 15, 8, 0, 0, 123000, tzinfo=dt.timezone.utc)
    fields = {"a.b": "Integer", "a.c": "String", "d": "Boolean"}
    struct = t.storage_struct(fields)
    assert struct.simpleString() == "struct<a:struct<b:bigint,c:string>,d:boolean>"
    assert t.stored_row({"a": 5, "d": True}, struct, fields) == {"a": None, "d": True}
