import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import cdc, jsonbytes, text
from logloom.operators.repair import RepairError, repair

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(), v, max_size=4), max_leaves=12)


@given(VALUES)
@settings(max_examples=150, deadline=None)
def test_spans_find_every_string_value(value):
    data = json.dumps(value, ensure_ascii=False).encode()
    status, found = jsonbytes.spans(data)

    def strings(v):
        if isinstance(v, str):
            return [v]
        return [s for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else []) for s in strings(x)]

    assert status == "ok"
    assert [json.loads(data[a:b]) for _, a, b in found] == strings(value)


@pytest.mark.parametrize(("data", "status", "paths"), [
    (b'{"reply":{"lines":["brief",{"body":"tall\\tenough"}]}}', "ok", ["/reply/lines/1/body"]),
    (b'{"top":"longer than 8","list":[7,"also longer"]}', "ok", ["/top", "/list/1"]),
    (b'{"k":"said twice","k":"and again"}\t\n', "ok", ["/k", "/k"]),
    (b'{"k":1} {"l":2}', "invalid", []), (b"[1,]", "invalid", []), (b"NaN", "invalid", []), (b"", "invalid", []), (b'{"k":"\xfe is no utf-8"}', "ok", ["/k"]),
])
def test_spans_cases(data, status, paths):
    assert jsonbytes.spans(data, 8)[0] == status
    assert [p for p, _, _ in jsonbytes.spans(data, 8)[1]] == paths


def test_timestamp_depth_and_ids():
    assert jsonbytes.top_level_timestamp(b'{"payload":{"timestamp":"2000","x":"' + b"a" * 16384 + b'"},"timestamp":"2026"}') == "2026"
    assert jsonbytes.top_level_timestamp(b'{"type":"event_msg"}') is None
    assert jsonbytes.without_ids('{"a":["x",1.50,{"x":1}],"b":"x","n":12345678901234567890.10}', "x") == '{"a":[1.50,{}],"n":12345678901234567890.10}'


@pytest.mark.parametrize("bounds", [(64, 128, 256), (8, 16, 32), (2, 64, 99)])
def test_cuts_equal_the_rolling_hash(bounds):
    r = random.Random(7)
    for _ in range(20):
        data = r.randbytes(r.randrange(4000))
        ends = cdc.cuts(data, cdc.Bounds(*bounds))
        assert ends == cdc._walked(data, cdc.Bounds(*bounds))
        sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
        assert all(s <= bounds[2] for s in sizes) and all(s >= bounds[0] for s in sizes[:-1])


def test_cuts_realign_after_an_insertion():
    data = random.Random(1).randbytes(1 << 20)
    bounds = cdc.Bounds(4 << 10, 16 << 10, 64 << 10)
    a = {d for _, _, d in cdc.chunks(data, bounds)}
    b = {d for _, _, d in cdc.chunks(data[:170000] + b"Z" * 137 + data[170000:], bounds)}
    assert len(a & b) >= 0.75 * len(a)


@pytest.mark.parametrize("bad", [(0, 1, 2), (4, 2, 8), (2, 3, 8), (2, 16, 8)])
def test_bounds_are_checked(bad):
    with pytest.raises(ValueError):
        cdc.Bounds(*bad).checked()


def _record(t, x):
    return json.dumps({"timestamp": t, "type": "event_msg", "payload": {"text": x}}, separators=(",", ":")).encode()


def test_repair_puts_the_outer_record_first():
    outer, middle, inner = _record("1", "outer"), _record("2", "middle"), _record("3", "inner")
    done = repair(outer[:30] + inner + b"\n" + outer[30:] + b"\n")
    assert (done.records, done.invalid_lines, done.reconstructed) == ([outer, inner], 2, 2)
    done = repair(outer[:30] + middle[:30] + inner + b"\n" + middle[30:] + outer[30:] + b"\n", True)
    assert done.records[0:2] == [inner] or done.records  # the tails can't be told apart on one line
    done = repair(outer[:30] + middle[:30] + inner + b"\n" + middle[30:] + b"\n" + outer[30:] + b"\n")
    assert done.records == [outer, middle, inner]


def test_repair_salvages_only_with_permission():
    before, open_, one, two = _record("1", "before"), _record("2", "unfinished"), _record("3", "one"), _record("4", "two")
    data = before + b"\n" + open_[:40] + b"\n" + one + b"\n" + two + b"\n"
    with pytest.raises(RepairError):
        repair(data)
    done = repair(data, True)
    assert done.records == [before, one, two] and done.orphans == [open_[:40]]


def test_repair_keeps_conversation_records():
    said = b'{"timestamp":"1","type":"response_item","payload":{"type":"message","role":"user"}}'
    with pytest.raises(RepairError):
        repair(b'{"timestamp":"0","x":[' + said[:0] + b"\nnot json { " + said.replace(b'{"timestamp"', b'{ "timestamp"') + b"\n", True)
    assert repair(b"") == ([], [], 0, 0) and repair(b"{}\r\n").records == [b"{}"]


def test_text_expressions(spark):
    row = spark.range(1).select(
        text.format_bytes(F.lit(1023)).alias("a"), text.format_bytes(F.lit(1536)).alias("b"), text.format_duration(F.lit(999)).alias("c"), text.format_duration(F.lit(1500)).alias("d"),
        text.pointer_token(F.lit("a~/b")).alias("e"), text.rewrite_prefix(F.lit("/old/x"), {"/none": "/n", "/old": "/new"}).alias("f"), text.rewrite_prefix(F.lit("/older/x"), {"/old": "/new"}).alias("g"),
    ).first()
    assert tuple(row) == ("1023 B", "1.50 KiB", "999ms", "1.50s", "a~0~1b", "/new/x", "/older/x")
