"""Scalar functions made of Spark built-ins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space for trimming: also the ideographic space and other Unicode separators.
EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def trimmed(c: Column) -> Column:
    """Trim Unicode white space at both ends (Spark's trim knows the blank alone)."""
    return F.regexp_replace(c, EDGES, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor '' after trimming, else ''."""
    return F.coalesce(*(blank_to_null(trimmed(c)) for c in columns), F.lit(""))


def display_text(preferred: Column, fallback: Column) -> Column:
    """preferred unless it is null or '', else fallback."""
    return F.coalesce(blank_to_null(preferred), fallback)


def safe_text(c: Column) -> Column:
    """Trimmed text; a lone hyphen means nothing."""
    t = trimmed(c)
    return F.when(t == "-", "").otherwise(t)


def pair_text(key: Column, text: Column) -> Column:
    """Translation of a pair: '' where it is missing or repeats the key."""
    t = F.coalesce(trimmed(text), F.lit(""))
    return F.when(t == trimmed(key), "").otherwise(t)


def credits(*columns: Column, separator: str = " | ") -> Column:
    """Credit fields joined, without empty and hyphen-only ones."""
    return F.array_join(F.filter(F.array(*map(safe_text, columns)), lambda x: x != ""), separator)


def strict_int(c: Column) -> Column:
    """A text that is an integer as a whole, else 0."""
    t = c.cast("string")
    return F.coalesce(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")), F.lit(0).cast("bigint"))


def prefix_int(c: Column) -> Column:
    """The integer that a text begins with, else 0."""
    found = F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(found.try_cast("bigint"), F.lit(0).cast("bigint"))


def truncated_int(c: Column) -> Column:
    """A number without its fraction; null counts as 0."""
    return F.coalesce(c.cast("double").cast("bigint"), F.lit(0).cast("bigint"))


def text_hash(c: Column) -> Column:
    """SHA-256 in hexadecimal; '' stays ''."""
    return F.when(c == "", "").otherwise(F.sha2(c.cast("binary"), 256))


def segment_id(event: Column, episode: Column, scenario: Column, kind: Column, position: Column, field: Column | None = None) -> Column:
    base = F.concat_ws(":", F.lit("event"), event.cast("string"), episode.cast("string"), scenario, kind, position.cast("string"))
    return base if field is None else F.concat_ws(":", base, blank_to_null(field))


def work_key(*columns: Column) -> Column:
    """Normalised fields joined by a unit separator, '?' for absent ones."""
    return F.concat_ws("\u001f", *(F.coalesce(blank_to_null(c), F.lit("?")) for c in columns))


def job_key(*columns: Column) -> Column:
    """SHA-256 over fields separated by NUL."""
    parts = [x for c in columns for x in (F.coalesce(c.cast("string"), F.lit("")), F.lit("\u0000"))][:-1]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def error_code(c: Column, longest: int = 64) -> Column:
    """Lower case, runs of other than letters and digits as one underscore, cut to a length."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "_")
    t = F.regexp_replace(F.substring(F.regexp_replace(t, r"^_+|_+$", ""), 1, longest), r"_+$", "")
    return F.coalesce(blank_to_null(t), F.lit("unknown_error"))


def _stamp(t: Column) -> Column:
    """The year in four digits or more without a plus sign, which yyyy puts before years from 10000 on
    (and it gives years before 1 as years of their era)."""
    year = F.year(t)
    return F.concat(F.when(year.between(0, 999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string")), F.date_format(t, "-MM-dd'T'HH:mm:ss'Z'"))


def rfc3339(seconds: Column) -> Column:
    """Epoch seconds as a UTC timestamp text (the session's time zone must be UTC)."""
    return _stamp(F.timestamp_seconds(seconds))


def canonical_timestamp(c: Column) -> Column:
    """The timestamp a text stands for, if the text is exactly its canonical form."""
    t = F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.when(_stamp(t) == c, t)


def backoff(attempt: Column, least: int, most: int) -> Column:
    """Exponential delay: least doubled for every attempt after the first, at most `most`."""
    grown = F.lit(least) * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(40)))
    return F.least(grown, F.lit(float(most))).cast("bigint")


def vote(*signals: Column) -> Column:
    """The one value on which all given signals agree, else 'unknown'."""
    given = F.array_distinct(F.filter(F.array(*signals), lambda x: x.isNotNull() & (x != "")))
    return F.when((F.size(given) == 1) & (F.element_at(given, 1) != "unknown"), F.element_at(given, 1)).otherwise("unknown")


def display_name(name: Column, first: Column, given: Column) -> Column:
    return F.coalesce(blank_to_null(trimmed(name)), trimmed(F.concat_ws(" ", first, given)))


def speaker_of(c: Column) -> Column:
    """What stands before the first underscore."""
    return F.element_at(F.split(c, "_", 2), 1)


def shortened(c: Column, longest: int) -> Column:
    """At most `longest` code points, an ellipsis for what is cut."""
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("…"))).otherwise(c)


def canonical_set(c: Column) -> Column:
    """Trimmed, filled, distinct and sorted elements."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, trimmed), lambda x: x.isNotNull() & (x != ""))))


def merged_ids(old: Column, new: Column) -> Column:
    """Old ids as they are, then new ones not among them, in order."""
    return F.concat(old, F.array_except(new, old))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def ascii_like(c: Column, needle: str) -> Column:
    """Contains, ignoring the case of A-Z alone; % and _ in the needle are wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(c, upper, lower).like("%" + needle.translate(str.maketrans(upper, lower)) + "%")


def xml_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_unescaped(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def batch_reply(reply: Column, size: Column, tag: str = "t") -> Column:
    """Texts of an indexed reply <t id="i">..</t> placed by index; indices that are missing stay ''."""
    pattern = rf'<{tag} id="(\d+)">([^<]*)</{tag}>'
    ids = F.transform(F.regexp_extract_all(reply, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    texts = F.regexp_extract_all(reply, F.lit(pattern), F.lit(2))
    place = lambda i: F.coalesce(xml_unescaped(F.get(texts, F.array_position(ids, i).cast("int") - 1)), F.lit(""))
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), place)).otherwise(F.array().cast("array<string>"))


def graphemes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\X"), F.lit(0))


def etag(body: Column) -> Column:
    """First half of the SHA-256 of a body."""
    return F.substring(F.sha2(body.cast("binary"), 256), 1, 32)


def cursor_encoded(payload: Column) -> Column:
    """URL-safe Base64 without padding."""
    return F.translate(F.base64(payload.cast("binary")), "+/=\r\n", "-_")


def cursor_decoded(cursor: Column) -> Column:
    """The payload of a cursor, null unless encoding it again gives the same cursor."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.rpad(plain, ((F.length(plain) + 3) / 4).cast("int") * 4, "=")
    payload = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    return F.when(cursor_encoded(payload) == cursor, payload)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def scenario_sound(vocals: Column, lyricist: Column) -> Column:
    """Instrumental: vocals are given, all of them instrumental, and nobody wrote lyrics."""
    return (F.size(vocals) > 0) & F.forall(vocals, lambda v: v == "instrumental") & (safe_text(F.coalesce(lyricist, F.lit(""))) == "")


def numeric_text_key(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def json_text(json: Column, path: str) -> Column:
    """The text at a path of a JSON value, '' where there is none or something else."""
    at = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string")).otherwise("")


def json_flag(json: Column, path: str) -> Column:
    """The truth value at a path of a JSON value, null where there is none or something else."""
    at = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.when(F.schema_of_variant(at) == "BOOLEAN", F.try_variant_get(at, "$", "boolean"))


def rebuilt(parts: Column, whole: Column) -> Column:
    """Whether parts make up a text without cutting any of its graphemes."""
    return F.flatten(F.transform(parts, graphemes)) == graphemes(whole)


def valid_reading(c: Column) -> Column:
    """A reading of kana alone (prolonged sounds and middle dots too)."""
    return c.rlike(r"^[\p{IsHiragana}\p{IsKatakana}ー・]+$")


def has_han(c: Column) -> Column:
    return c.rlike(r"\p{IsHan}")


def wiki_text(c: Column) -> Column:
    """Text without comments, references, tags, emphasis marks and links (their label stays)."""
    for pattern, left in ((r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>/]*>.*?</ref>", ""), (r"<[^>]*>", ""), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), (r"'{2,}", "")):
        c = F.regexp_replace(c, pattern, left)
    return trimmed(c)


def envelope_digest(lines: Column, version: str) -> Column:
    """SHA-256 of lines in their order under a versioned heading."""
    return F.sha2(F.concat_ws("\n", F.lit(version), lines).cast("binary"), 256)


def untranslated(text: Column, source: Column) -> Column:
    """No text, or one that neither a person nor an official source stands for."""
    return (F.coalesce(text, F.lit("")) == "") | F.coalesce(source, F.lit("unknown")).isin("unknown", "llm")


def title_variants(title: Column) -> Column:
    """Ways to search for a title: as it is, without a trailing parenthesis, and that one's content."""
    inner = F.regexp_extract(title, r"\(([^()]*)\)$", 1)
    return F.array_distinct(F.filter(F.array(trimmed(title), trimmed(F.regexp_replace(title, r"\s*\([^()]*\)$", "")), trimmed(inner)), lambda x: x != ""))
