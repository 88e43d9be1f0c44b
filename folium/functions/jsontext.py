"""JSON text in and out without a limit of depth; numbers are kept as they are written."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring


class Number(str):
    """A number kept as it is written."""


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=Number)
_BLANK = re.compile(r"[ \t\r\n]*")
_PLAIN = re.compile(r"(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|NaN|-?Infinity)|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


def read_json(text: str):
    """The value of a JSON text; ValueError where it is none. Values nested too deeply for the stock reader are read with a stack."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _read_deep(text)


def _read_deep(text: str):
    def fail(at: int):
        raise ValueError(f"no JSON at {at}")

    skip = lambda at: _BLANK.match(text, at).end()
    opened: list[tuple] = []  # containers under way: (container, key of the one it goes into)
    at, key = skip(0), None
    while True:
        # a value begins here
        c = text[at : at + 1]
        value, closed = None, True
        if c in ("{", "["):
            value, closed = ({} if c == "{" else []), False
            at = skip(at + 1)
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at, closed = at + 1, True
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            m = _PLAIN.match(text, at) or fail(at)
            value, at = Number(m[0]) if m["number"] else _WORDS[m[0]], m.end()
        if not closed:
            opened.append((value, key))
        while closed:
            at = skip(at)
            if not opened:
                return value if at == len(text) else fail(at)
            into, outer = opened[-1]
            if isinstance(into, dict):
                into[key] = value
            else:
                into.append(value)
            c = text[at : at + 1]
            if c == ",":
                at, closed = skip(at + 1), False
            elif c == ("}" if isinstance(into, dict) else "]"):
                at, value, key = at + 1, into, outer
                opened.pop()
            else:
                fail(at)
        if isinstance(opened[-1][0], dict):
            if text[at : at + 1] != '"':
                fail(at)
            key, at = scanstring(text, at + 1, True)
            at = skip(at)
            if text[at : at + 1] != ":":
                fail(at)
            at = skip(at + 1)


def scalar_text(value) -> str | None:
    """A scalar as text: null stays null, numbers as written."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def json_text(value) -> str | None:
    """A value as text: scalars bare, others as JSON with sorted keys; with a stack, so depth has no limit."""
    if not isinstance(value, (dict, list)):
        return scalar_text(value)
    out: list[str] = []
    todo: list = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, dict):
            todo.append(("}",))
            for i, k in enumerate(sorted(x, reverse=True), 1):
                todo += [x[k], (json.dumps(k, ensure_ascii=False) + ":",), *([(",",)] if i < len(x) else [])]
            out.append("{")
        elif isinstance(x, list):
            todo.append(("]",))
            for i, y in enumerate(reversed(x), 1):
                todo += [y, *([(",",)] if i < len(x) else [])]
            out.append("[")
        elif x is None or isinstance(x, (bool, Number)):
            out.append("null" if x is None else scalar_text(x))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)
