"""Canonical forms of JSON texts, as Arrow-batched Pandas UDFs: one text for one value.

Numbers are read as they are written, so that no digit is lost before a form decides how to print them.
Nothing a text holds fails a job: what is no JSON, or is nested too deeply, has no form.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Characters that the forms write as escapes (fixed values), and what stands for half a surrogate pair.
ESCAPED, REPLACEMENT = "<>&\u2028\u2029", "\ufffd"
#: The scenario's fields in their fixed order; all but the first are arrays.
SCENARIO = ("ScenarioId", "Snippets", "TalkData", "SpecialEffectData", "AppearCharacters")


#: What a string of the forms can't hold as it is.
_ODD, _HALVES = re.compile(f"[{ESCAPED}\ud800-\udfff]"), re.compile("[\ud800-\udfff]")
#: Made once: json.dumps would make one for every string.
_QUOTED = json.JSONEncoder(ensure_ascii=False).encode


class Number(str):
    """A number as it is written."""


def _refuse(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse)


def parsed(text: str):
    """The value of one JSON text; of repeated keys the last counts. ValueError or RecursionError if it is none."""
    return _DECODER.decode(text)


def shortest(number: str) -> str:
    """A number as the shortest decimal of its 64-bit float: plain from 1e-6 to below 1e21, else with an exponent."""
    value = float(number)
    if value in (float("inf"), float("-inf")):
        raise ValueError("out of range")
    written = repr(value)
    if "e" not in written and abs(value) < 1e21:
        return written.rstrip("0").rstrip(".") if "." in written else written
    exact = Decimal(written)
    if value == 0 or 1e-6 <= abs(value) < 1e21:
        plain = format(exact, "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    sign, digits, _ = exact.normalize().as_tuple()
    text = "".join(map(str, digits))
    return f"{'-' if sign else ''}{text[0]}{'.' + text[1:] if text[1:] else ''}e{exact.adjusted():+d}"


def _string(text: str) -> str:
    if not _ODD.search(text):
        return _QUOTED(text)
    out = _QUOTED(_HALVES.sub(REPLACEMENT, text))
    for c in ESCAPED:
        out = out.replace(c, f"\\u{ord(c):04x}")
    return out


def encoded(value, number: Callable[[str], str] = str, ordered: bool = False) -> str:
    """Compact JSON; keys ascend, but for those of the value itself if it is ordered."""
    if isinstance(value, Number):
        return number(value)
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, dict):
        items = value.items() if ordered else sorted(value.items())
        return "{" + ",".join(f"{_string(k)}:{encoded(v, number)}" for k, v in items) + "}"
    if isinstance(value, list):
        return "[" + ",".join(encoded(v, number) for v in value) + "]"
    return json.dumps(value)


def canonical_json(text: str) -> str | None:
    """JSON with sorted keys, no spaces, numbers as written; null for what is no JSON."""
    try:
        return encoded(parsed(text))
    except (ValueError, RecursionError):
        return None


def scenario_form(text: str | None, scenario_id: str | None) -> tuple[str | None, str | None, str | None]:
    """(body, sha256, problem) of a scenario: its five fields in fixed order, other fields left out."""
    try:
        value = parsed(text or "")
        if not isinstance(value, dict):
            return None, None, "not_object"
        own = value.get(SCENARIO[0])
        if not isinstance(own, str) or isinstance(own, Number) or not own:
            return None, None, "id_missing"
        if own != scenario_id:
            return None, None, "id_mismatch"
        for name in SCENARIO[1:]:
            if not isinstance(value.get(name), list):
                return None, None, f"not_array:{name}"
        body = encoded({name: value[name] for name in SCENARIO}, shortest, ordered=True)
        return body, hashlib.sha256(body.encode()).hexdigest(), None
    except (ValueError, RecursionError):
        return None, None, "not_json"


def stored_problem(event_id: int | None, episode: str | None, scenario_id: str | None, body: str | None, digest: str | None) -> str | None:
    """Why a stored scenario is refused, null if it isn't: it has to be its own canonical form."""
    if event_id is None or event_id <= 0 or not (episode or "").strip() or not (scenario_id or "").strip():
        return "incomplete_identity"
    if hashlib.sha256((body or "").encode()).hexdigest() != digest:
        return "digest_mismatch"
    form, _, problem = scenario_form(body, scenario_id)
    return problem or (None if form == body else "not_canonical")


@F.pandas_udf(StringType())
def canonical_json_udf(text: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else canonical_json(x) for x in text], dtype=object)


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("body", "sha256", "problem")]))
def scenario_form_udf(text: pd.Series, scenario_id: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scenario_form(a, b) for a, b in zip(text, scenario_id)], columns=["body", "sha256", "problem"], dtype=object)


@F.pandas_udf(StringType())
def stored_problem_udf(event_id: pd.Series, episode: pd.Series, scenario_id: pd.Series, body: pd.Series, digest: pd.Series) -> pd.Series:
    given = zip(event_id, episode, scenario_id, body, digest)
    return pd.Series([stored_problem(None if pd.isna(e) else int(e), *rest) for e, *rest in given], dtype=object)
