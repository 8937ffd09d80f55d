"""JSON that models write: checked against a schema, and closed where an output limit has cut it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KINDS = {
    "object": "^OBJECT<", "array": "^ARRAY<", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$",
    "number": r"^(BIGINT|DECIMAL\(.*\)|DOUBLE|FLOAT)$",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _is(v: Column, kind: str) -> Column:
    if kind == "integer":
        return _is(v, "number") & (F.schema_of_variant(v).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") | (_get(v, "double") == F.floor(_get(v, "double"))))
    return F.schema_of_variant(v).rlike(KINDS[kind])


def _one_of(v: Column, values: list) -> Column:
    return F.to_json(v).isin(*[F.to_json(F.parse_json(F.lit(json.dumps(x)))) for x in values])


def _problems(v: Column, schema: dict, path: Column) -> Column:
    def say(bad: Column, text: str) -> Column:
        return F.when(bad, F.array(F.concat(path, F.lit(f": {text}")))).otherwise(F.array().cast("array<string>"))

    def below(rule: dict, name: str) -> Callable[[Column], Column]:
        return lambda x: _problems(x, rule, F.concat(path, F.lit(f".{name}")))

    null = F.parse_json(F.lit("null"))
    always, found = [], []
    if "enum" in schema:
        always.append(say(~_one_of(v, schema["enum"]), f"not one of {json.dumps(schema['enum'], ensure_ascii=False)}"))
    if "const" in schema:
        always.append(say(~_one_of(v, [schema["const"]]), f"not {json.dumps(schema['const'], ensure_ascii=False)}"))
    if "anyOf" in schema:
        fits = [F.size(_problems(v, s, path)) == 0 for s in schema["anyOf"]]
        found.append(say(~F.array_contains(F.array(*fits), True), "matches nothing of anyOf"))

    if {"required", "properties", "additionalProperties"} & set(schema):
        properties = schema.get("properties", {})

        def fields(m: Column) -> Column:
            out = [say(~F.map_contains_key(m, name), f"no field '{name}'") for name in schema.get("required", [])]
            for name, rule in properties.items():
                out.append(F.when(F.map_contains_key(m, name), _let(F.coalesce(F.try_element_at(m, F.lit(name)), null), below(rule, name))).otherwise(F.array().cast("array<string>")))
            if schema.get("additionalProperties") is False:
                more = F.array_except(F.map_keys(m), F.array(*map(F.lit, properties)).cast("array<string>"))
                out.append(F.transform(F.array_sort(more), lambda k: F.concat(path, F.lit(": unexpected field '"), k, F.lit("'"))))
            return F.concat(*out) if out else F.array().cast("array<string>")

        found.append(F.when(_is(v, "object"), _let(_get(v, "map<string,variant>"), fields)))
    items = F.when(_is(v, "array"), _get(v, "array<variant>"))
    if "items" in schema:
        each = lambda x, i: _problems(F.coalesce(x, null), schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        found.append(F.flatten(F.transform(items, each)))
    text, number = F.when(_is(v, "string"), _get(v, "string")), F.when(_is(v, "number"), _get(v, "double"))
    limits = {
        "minItems": (F.size(items), False, "items"), "maxItems": (F.size(items), True, "items"),
        "minimum": (number, False, ""), "maximum": (number, True, ""),
        "minLength": (F.length(text), False, "characters"), "maxLength": (F.length(text), True, "characters"),
    }
    for name, (size, most, unit) in limits.items():
        if name in schema:
            bad = size > schema[name] if most else (size < schema[name]) & (size >= 0 if unit == "items" else F.lit(True))
            found.append(say(bad, f"{'over' if most else 'under'} {schema[name]} {unit}".strip()))
    if "pattern" in schema:
        found.append(say(~text.rlike(schema["pattern"]), f"does not match {schema['pattern']}"))

    nothing = F.array().cast("array<string>")
    rest = F.concat(*[F.coalesce(x, nothing) for x in found]) if found else nothing
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        right = _is(v, kinds[0])
        for kind in kinds[1:]:
            right = right | _is(v, kind)
        rest = F.when(right, rest).otherwise(F.array(F.concat(path, F.lit(f": not of type {' or '.join(kinds)}"))))
    return F.concat(*always, rest)


def violations(text: Column, schema: dict) -> Column:
    """array<string>: where JSON text breaks the schema, each as `$.path[i]: reason`; empty if it fits, null if text is null.

    The schema is compiled into one column expression over a variant; nothing leaves the JVM. Keywords: type, enum, const,
    anyOf, required, properties, additionalProperties (false), items, minItems, maxItems, minimum, maximum, minLength,
    maxLength (code points), pattern (found anywhere). A value of the wrong type gets no further reasons. Whole numbers are
    integers however they are written (1.0). What the parser refuses (broken, empty, repeated names, nesting beyond its
    limit) has the one violation `$: no JSON`.
    """
    checked = _let(F.try_parse_json(text), lambda v: F.when(v.isNull(), F.array(F.lit("$: no JSON"))).otherwise(_problems(v, schema, F.lit("$"))))
    return F.when(text.isNotNull(), checked)


TOKEN = re.compile(r'[ \t\r\n]*(?:(?P<string>"[^"\\]*+(?:\\.[^"\\]*+)*+")|(?P<cut>"[^"\\]*+(?:\\.[^"\\]*+)*+\\?\Z)|(?P<sign>[{}\[\],:])|(?P<scalar>[^ \t\r\n{}\[\],:"]+))', re.S)
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
PART_OF_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*(\\(?:u[0-9a-fA-F]{0,3})?|\\u[dD][89abAB][0-9a-fA-F]{2}(?:\\(?:u[0-9a-fA-F]{0,3})?)?)\Z")


def close(text: str | None) -> str | None:
    """JSON that is cut somewhere, closed: open strings, lists and objects end where the text ends.

    A name without value, a comma before nothing and a cut true, false or null go; a cut string or number keeps what is
    there, up to its last whole escape or digit. Whole JSON stays as it is. Null for null, for texts without a value, and
    for texts that no JSON begins with. One pass with a stack, so nesting and length don't matter.
    """
    if not text:
        return None
    stack, state, safe, at = [], "value", None, 0
    after = lambda: ("next" if stack else "end")
    while at < len(text):
        token = TOKEN.match(text, at)
        if token is None:
            if text[at:].strip(" \t\r\n"):
                return None
            break
        kind, word, at = token.lastgroup, token[token.lastgroup], token.end()
        if kind == "sign":
            if word in "{[" and state in ("value", "first value"):
                stack.append("}" if word == "{" else "]")
                state, safe = ("first name" if word == "{" else "first value"), (at, "")
            elif word in "}]" and stack and stack[-1] == word and state in ("next", "first name" if word == "}" else "first value"):
                stack.pop()
                state, safe = after(), (at, "")
            elif word == "," and state == "next":
                state = "name" if stack[-1] == "}" else "value"
            elif word == ":" and state == "colon":
                state = "value"
            else:
                return None
        elif state in ("name", "first name") and kind in ("string", "cut"):
            state = "colon"  # a cut name ends the text, and goes with what has no value
        elif state not in ("value", "first value"):
            return None
        elif kind == "cut":
            part = PART_OF_ESCAPE.search(text, token.start("cut"))
            state, safe = after(), (part.start(1) if part else at, '"')
        elif kind == "string" or word in ("true", "false", "null"):
            state, safe = after(), (at, "")
        else:
            number = NUMBER.match(word)
            whole, last = bool(number) and number.end() == len(word), at == len(text)
            begun = any(x.startswith(word) for x in ("true", "false", "null")) or re.fullmatch(r"-?(?:0|[1-9]\d*)?(?:(?<=\d)\.\d*)?(?:(?<=\d)[eE][+-]?\d*)?", word)
            if not whole and not (last and begun):
                return None
            if number:
                state, safe = after(), (token.start("scalar") + number.end(), "")
    if safe is None:
        return None
    if state == "end" and not safe[1] and not text[safe[0] :].strip(" \t\r\n"):
        return text
    return text[: safe[0]] + safe[1] + "".join(reversed(stack))


@F.pandas_udf(StringType())
def closed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """close() of a column."""
    for batch in texts:
        yield batch.map(close, na_action="ignore")
