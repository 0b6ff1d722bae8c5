"""Strict JSON: bounded reading, checking against a schema, and one text for one value."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields, is_dataclass


class JsonError(ValueError):
    """A text that is not the JSON asked for; the message says where."""


@dataclass(frozen=True)
class Bounds:
    """What a JSON text may hold."""

    text_bytes: int = 32 * 1024 * 1024
    nesting: int = 64
    items: int = 2_000_000


def _no_constant(word: str) -> None:
    raise JsonError(f"{word} is no JSON number")


def _once(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise JsonError("an object has a key twice")
    return out


def read(text: str | bytes, bounds: Bounds = Bounds()) -> object:
    """The value of a JSON text. No NaN or infinity, no repeated keys, and nothing beyond the bounds."""
    data = text.encode() if isinstance(text, str) else text
    if len(data) > bounds.text_bytes:
        raise JsonError(f"{len(data)} bytes, {bounds.text_bytes} are allowed")
    # depth is counted before parsing, outside of strings
    depth = deepest = 0
    for m in re.finditer(rb'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', data):
        depth += (m[0] in b"[{") - (m[0] in b"]}")
        deepest = max(deepest, depth)
    if deepest > bounds.nesting:
        raise JsonError(f"{deepest} levels, {bounds.nesting} are allowed")
    try:
        value = json.loads(data, parse_constant=_no_constant, object_pairs_hook=_once)
    except JsonError:
        raise
    except ValueError as e:
        raise JsonError(str(e)) from e
    n, stack = 0, [value]
    while stack:
        v = stack.pop()
        n += 1
        if n > bounds.items:
            raise JsonError(f"more than {bounds.items} values")
        stack.extend(v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())
    return value


def read_file(spark, path: str, bounds: Bounds = Bounds()) -> object:  # noqa: ANN001
    """The value of one JSON file; its size is checked before it is read."""
    row = spark.read.format("binaryFile").load(path).select("length").first()
    if row["length"] > bounds.text_bytes:
        raise JsonError(f"{row['length']} bytes, {bounds.text_bytes} are allowed")
    return read(bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]), bounds)


_TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "null": lambda v: v is None, "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def faults(value: object, schema: dict, at: str = "$") -> Iterator[str]:
    """What keeps a value from the schema: type, enum, const, bounds of numbers, texts, lists, required and further properties, items, anyOf."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        yield f"{at} is not of type {' or '.join(kinds)}"
        return
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        yield f"{at} is not one of the allowed values"
    if "anyOf" in schema and all(any(faults(value, s, at)) for s in schema["anyOf"]):
        yield f"{at} fits none of the alternatives"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        yield from (f"{at} lacks {k}" for k in schema.get("required", ()) if k not in value)
        for k, v in value.items():
            if k in known:
                yield from faults(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{at} has the unknown {k}"
            elif isinstance(schema.get("additionalProperties"), dict):
                yield from faults(v, schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            yield f"{at} has {len(value)} items"
        for i, v in enumerate(value if "items" in schema else ()):
            yield from faults(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            yield f"{at} has {len(value)} letters"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield f"{at} does not match {schema['pattern']}"
    if _TYPES["number"](value) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        yield f"{at} is out of bounds"


def validated(text: str, schema: dict | None) -> object:
    """The value of a text that fits the schema; None without a schema."""
    if schema is None:
        return None
    value = read(text)
    found = next(faults(value, schema), None)
    if found:
        raise JsonError(found)
    return value


def canonical(value: object) -> str:
    """One text for one value: sorted keys, no blanks; dataclasses as objects of their fields."""
    plain = asdict(value) if is_dataclass(value) and not isinstance(value, type) else value
    return json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def decoded(text: str, kind: type) -> object:
    """A dataclass from its canonical text; unknown and missing fields are errors."""
    value = read(text)
    names = {f.name for f in fields(kind)}
    if not isinstance(value, dict) or set(value) != names:
        raise JsonError(f"{kind.__name__} has the fields {sorted(names)}")
    return kind(**value)
