"""Cut JSON closed at every place, and schemas against a plain checker."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quern.functions.json_checks import close, closed, violations


def made(r, depth=0):
    kind = r.randrange(9 if depth < 4 else 6)
    if kind < 2:
        return r.choice(["", "a", 'q"uo\\te', "é\n\t", "\\", "😀x", "}{][,:", "\u0001"])
    if kind < 4:
        return r.choice([0, -1, 12, 3.25, -0.5, 1e30, 10**20])
    if kind < 6:
        return r.choice([True, False, None])
    if kind < 7:
        return [made(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(["a", "b", 'c"', "dé", "e:"]) + str(i): made(r, depth + 1) for i in range(r.randrange(4))}


def begins(part, whole):
    """part is a prefix of whole's fields; only its last one may be cut."""
    if isinstance(part, dict) and isinstance(whole, dict):
        a, b = list(part.items()), list(whole.items())
        return len(a) <= len(b) and a[:-1] == b[: len(a[:-1])] and (not a or (a[-1][0] == b[len(a) - 1][0] and begins(a[-1][1], b[len(a) - 1][1])))
    if isinstance(part, list) and isinstance(whole, list):
        return len(part) <= len(whole) and part[:-1] == whole[: len(part[:-1])] and (not part or begins(part[-1], whole[len(part) - 1]))
    if isinstance(part, str) and isinstance(whole, str):
        return whole.startswith(part)
    if isinstance(part, (int, float)) and isinstance(whole, (int, float)) and not isinstance(part, bool):
        return True  # a cut number; its digits are compared below by text
    return part == whole


@pytest.mark.parametrize("ascii", [True, False])
def test_every_prefix(ascii):
    r = random.Random(ascii)
    for _ in range(250):
        whole = {"k": made(r), "l": made(r)} if r.random() < 0.8 else [made(r)]
        text = json.dumps(whole, ensure_ascii=ascii, indent=r.choice([None, 1]))
        assert close(text) == text
        for n in range(1, len(text)):
            got = close(text[:n])
            assert begins(json.loads(got), whole), (text[:n], got)
            got.encode()
            body = got.rstrip('"}]')
            assert text.startswith(body)


def test_what_goes_and_what_stays():
    cases = {
        '{"a": 1, "b": "two': '{"a": 1, "b": "two"}', '{"a": 1, "b":': '{"a": 1}', '{"a": 1, "b': '{"a": 1}', '{"a": 1,': '{"a": 1}', '{"a": tru': "{}",
        '{"a": [1, 2': '{"a": [1, 2]}', '{"a": [1, {"b": -': '{"a": [1, {}]}', '["x\\': '["x"]', '["x\\\\': '["x\\\\"]', '["\\ud83d': '[""]', '["\\u00e': '[""]', "[1.": "[1]", "[1e+": "[1]",
        '"abc': '"abc"', "": None, None: None, "  ": None, "{]": None, "hello": None, '{"a" 1': None, "[1 2": None, "[01, 2": None, "[truth": None, "[1] x": None, '{"a": 1}': '{"a": 1}', "[": "[]", " [1] ": " [1] ",
    }
    assert {k: close(k) for k in cases} == cases


def test_deep_and_long_texts():
    began = time.time()
    assert close("[" * 300_000) == "[" * 300_000 + "]" * 300_000
    assert close('["' + "x\\n" * 300_000) == '["' + "x\\n" * 300_000 + '"]'
    assert close('{"a": "' + "\\" * 600_001) == '{"a": "' + "\\" * 600_000 + '"}'
    assert close("[" + "1," * 300_000) == "[" + "1," * 299_999 + "1]"
    assert time.time() - began < 10


SCHEMA = {
    "type": "object",
    "required": ["id", "tags"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1, "maximum": 9},
        "kind": {"enum": ["x", "y", 3]},
        "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]"}},
        "by": {"anyOf": [{"type": "null"}, {"type": "object", "required": ["n"], "properties": {"n": {"type": ["number", "string"]}}}]},
        "v": {"const": 1},
        "o'k": {"type": "boolean"},
    },
}


def test_schema(spark):
    wanted = {
        '{"id": 1, "tags": ["ab"]}': [],
        '{"id": 2.0, "tags": ["ab", "abcd"], "kind": 3, "by": null, "v": 1, "o\'k": true}': [],
        '{"id": 2.5, "tags": ["ab"]}': ["$.id: not of type integer"],
        '{"id": true, "tags": {}}': ["$.id: not of type integer", "$.tags: not of type array"],
        '{"id": 0, "tags": []}': ["$.id: under 1", "$.tags: under 1 items"],
        '{"id": 10, "tags": ["ab", "", "Abcde", null]}': ["$.id: over 9", "$.tags[1]: under 2 characters", "$.tags[1]: does not match ^[a-z]", "$.tags[2]: over 4 characters", "$.tags[2]: does not match ^[a-z]", "$.tags[3]: not of type string", "$.tags: over 2 items"],
        '{"kind": "z", "by": {"n": []}, "v": 2, "o\'k": 1, "q": 1, "p": 2}': ["$: no field 'id'", "$: no field 'tags'", '$.kind: not one of ["x", "y", 3]', "$.by: matches nothing of anyOf", "$.v: not 1", "$.o'k: not of type boolean", "$: unexpected field 'p'", "$: unexpected field 'q'"],
        '{"id": 1, "tags": ["éé"], "by": {"n": 1.5}}': ["$.tags[0]: does not match ^[a-z]"],
        '{"id": 1, "tags": ["ab"], "by": {}}': ["$.by: matches nothing of anyOf"],
        '{"id": null, "tags": null}': ["$.id: not of type integer", "$.tags: not of type array"],
        "[]": ["$: not of type object"],
        "": ["$: no JSON"],
        '{"id": 1': ["$: no JSON"],
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in wanted], "j string")
    assert {r.j: r.v for r in df.select("j", violations(F.col("j"), SCHEMA).alias("v")).collect()} == wanted
    assert df.select(violations(F.col("j"), {})).where("false").count() == 0


def test_closed_column(spark):
    df = spark.createDataFrame([('{"a": [1, "x',), (None,), ("no",)], "j string")
    assert [r.c for r in df.select(closed("j").alias("c")).collect()] == ['{"a": [1, "x"]}', None, None]
