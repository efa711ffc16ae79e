"""Unicode normalisation, which Spark has no function for, as Arrow-batched Pandas UDFs.

Normalise once where data enters, into a key column; joins and groups then need no UDF.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType

#: Characters of titles that are written alike (fixed values).
FOLDED = str.maketrans({**dict.fromkeys("‘’‛′", "'"), **dict.fromkeys("“”‟″", '"'), **dict.fromkeys("‐‑‒–—―−", "-"), **dict.fromkeys("〜～∼", "~"), "…": "...", **dict.fromkeys("・･·•", "·")})
PAIRS = {"(": ")", "[": "]", "{": "}"}


def identity_text(s: str) -> str:
    """NFKC, trimmed, inner white space collapsed; a lone hyphen means nothing."""
    s = " ".join(unicodedata.normalize("NFKC", s).split())
    return "" if s == "-" else s


def work_text(s: str, also: str = "=?") -> str:
    """NFKC, lower case, letters and numbers alone, with the characters of `also`."""
    return "".join(c for c in unicodedata.normalize("NFKC", s).lower() if unicodedata.category(c)[0] in "LN" or c in also)


def alias_text(s: str) -> str:
    return work_text(s, "")


def canonical_title(s: str) -> str:
    """Unescaped, NFKC, without variation selectors, look-alike marks folded, spaces collapsed and
    dropped next to CJK characters and punctuation; '' where control or format characters remain."""
    s = unicodedata.normalize("NFKC", html.unescape(s))
    s = "".join(c for c in s if not ("︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef"))
    if any(unicodedata.category(c) in ("Cc", "Cf") and c not in "\t\n\r" for c in s):
        return ""
    words = s.translate(FOLDED).split()
    out = words[0] if words else ""
    for w in words[1:]:
        loose = lambda c: unicodedata.category(c)[0] in "PS" or unicodedata.east_asian_width(c) in "WF"
        out += w if loose(out[-1]) or loose(w[0]) else " " + w
    return out


def trailing_parenthesis(s: str) -> list[str]:
    """[what stands before, what stands inside] a balanced closing parenthesis, or [s, '']."""
    if not s.endswith(")"):
        return [s, ""]
    depth = 0
    for i in range(len(s) - 1, -1, -1):
        depth += (s[i] == ")") - (s[i] == "(")
        if depth == 0:
            return [s[:i].rstrip(), s[i + 1 : -1].strip()] if i else [s, ""]
    return [s, ""]


def top_level_parts(s: str, separators: str = "/／、,&＆") -> list[str]:
    """Parts between separators that no bracket encloses, trimmed, without empty ones."""
    parts, depth, at = [], [], 0
    for i, c in enumerate(s):
        if c in PAIRS or c in "（「『【":
            depth.append(c)
        elif depth and c in ")]}）」』】":
            depth.pop()
        elif not depth and c in separators:
            parts.append(s[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, s[at:]] if p.strip()]


def title_matches(title: str, wanted: str) -> bool:
    """Whether a title is the wanted one, as a whole, without its trailing parenthesis (or by the
    text in it), or without a creator after a slash."""
    t, w = canonical_title(title), canonical_title(wanted)
    if not t or not w:
        return False
    head, inner = trailing_parenthesis(t)
    candidates = {t, head, inner} | {t[:i].rstrip() for i in (m.start() for m in re.finditer("/", t)) if t[:i].count("(") == t[:i].count(")")}
    return any(c and alias_text(c) == alias_text(w) for c in candidates)


def _udf(f, kind: DataType):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


identity_text_udf = _udf(identity_text, StringType())
work_text_udf = _udf(work_text, StringType())
alias_text_udf = _udf(alias_text, StringType())
canonical_title_udf = _udf(canonical_title, StringType())
trailing_parenthesis_udf = _udf(trailing_parenthesis, ArrayType(StringType()))
top_level_parts_udf = _udf(top_level_parts, ArrayType(StringType()))


@F.pandas_udf(BooleanType())
def title_matches_udf(title: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([a is not None and b is not None and title_matches(a, b) for a, b in zip(title, wanted)])


def split_contributors(s: str) -> list[str]:
    """Distinct normalised contributors of a credit line, sorted."""
    return sorted({alias_text(p) for p in top_level_parts(s)} - {""})


split_contributors_udf = _udf(split_contributors, ArrayType(StringType()))


def unique_json(s: str) -> bool:
    """Whether a text is one JSON value without a repeated key at any depth and without lone surrogates."""
    import json

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("repeated key")
        return dict(items)

    try:
        value = json.loads(s, object_pairs_hook=pairs)
        json.dumps(value, ensure_ascii=False).encode()
        return True
    except (ValueError, UnicodeEncodeError, RecursionError):
        return False


unique_json_udf = _udf(unique_json, BooleanType())
