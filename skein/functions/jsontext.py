"""JSON texts: minifying with the number format of ECMAScript, folding of arrays, base64 blobs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein.functions import fixed as K
from skein.functions.folds import text_udf

_DATA, _RAW = re.compile(K.DATA_BASE64), re.compile(K.RAW_BASE64)


def number(x: float) -> str:
    """The shortest text of a double, as ECMAScript writes it."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    sign, x = ("-", -x) if x < 0 else ("", x)
    digits, _, exponent = f"{x!r}".partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    all_digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    all_digits = all_digits.rstrip("0")
    n = len(all_digits)
    if n <= point <= 21:
        return sign + all_digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + all_digits[:point] + "." + all_digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + all_digits
    e = point - 1
    return sign + all_digits[0] + ("." + all_digits[1:] if n > 1 else "") + ("e+" if e > 0 else "e-") + str(abs(e))


def _object(pairs: list[tuple[str, object]]) -> dict[str, object]:
    """Members in ECMAScript order: array indices by value first, then by insertion; the last duplicate wins in place."""
    out: dict[str, object] = {}
    for k, v in pairs:
        out[k] = v
    index = {k for k in out if re.fullmatch(r"0|[1-9]\d{0,9}", k, re.A) and int(k) < 2**32 - 1}
    return {k: out[k] for k in [*sorted(index, key=int), *(k for k in out if k not in index)]} if index else out


def _dump(x: object) -> str:
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, float):
        return number(x)
    if isinstance(x, list):
        return "[" + ",".join(map(_dump, x)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in x.items()) + "}"


def _bad(x: str) -> float:
    raise ValueError(x)


def parse(text: str) -> object:
    """Strict JSON; all numbers become doubles."""
    return json.loads(text, parse_int=float, parse_float=float, parse_constant=_bad, object_pairs_hook=_object)


def minified(text: str, fold_arrays: bool = False) -> str | None:
    """The shortest equal JSON text; None if the text isn't JSON."""
    try:
        value = parse(text)
    except (ValueError, RecursionError):
        return None
    if fold_arrays and isinstance(value, list) and len(value) > K.ARRAY_MIN and all(isinstance(x, dict) for x in value):
        keys = sorted(value[0])
        if all(sorted(x) == keys for x in value):
            value = [*value[: K.ARRAY_SHOWN], f"{K.MARK} {len(value) - K.ARRAY_SHOWN} more items, same keys: {','.join(keys)}]"]
    return _dump(value)


def with_text(response: str | None, shape: str | None, text: str | None) -> str | None:
    """A JSON response with the text of its ``shape`` put in place of the old one; all other members stay as they are."""
    if response is None or shape is None or text is None:
        return None
    if shape == "plain":
        return text
    root = json.loads(response, object_pairs_hook=_object)
    if shape == "string":
        root = text
    elif shape == "blocks":
        next(b for b in root if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str))["text"] = text
    elif shape == "file":
        root["file"] |= {"content": text, "numLines": text.count("\n") + 1}
    elif shape == "grep":
        root |= {"content": text, "numLines": text.count("\n") + 1}
    else:
        root[shape] = text
    return json.dumps(root, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def write_back(response: pd.Series, shape: pd.Series, text: pd.Series) -> pd.Series:
    """Responses with new texts, by the shapes that ``located_text`` found; null where one is missing."""
    return pd.Series([with_text(*row) for row in zip(response, shape, text)], dtype=object)


@F.pandas_udf(StringType())
def with_names(response: pd.Series, names: pd.Series) -> pd.Series:
    """JSON file listings with other names; null where one is missing."""

    def put(r: str | None, own: object) -> str | None:
        if r is None or own is None:
            return None
        return json.dumps(json.loads(r, object_pairs_hook=_object) | {"filenames": list(own)}, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([put(r, n) for r, n in zip(response, names)], dtype=object)


def _short(m: re.Match[str]) -> str:
    return f"{m.group()[: K.BASE64_SHOWN]}{K.MARK} {len(m.group()) - K.BASE64_SHOWN} base64 chars omitted]"


def short_base64(text: str) -> str:
    """Data URLs and long padded base64 blobs cut to their first characters."""
    return _RAW.sub(lambda m: _short(m) if len(m.group()) % 4 == 0 else m.group(), _DATA.sub(_short, text))


def reduced(text: str, fold_arrays: bool = False) -> str:
    """A tool's JSON or text result, made shorter."""
    return short_base64(minified(text, fold_arrays) or text)


minify_json = text_udf(minified)
truncate_base64 = text_udf(short_base64)
reduce_json = text_udf(reduced)
reduce_json_arrays = text_udf(lambda x: reduced(x, True))
