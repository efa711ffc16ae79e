"""Personal data: patterns for the direct kinds, and information-theoretic sanitisation.

Direct identifiers (email, IP address, card and phone numbers) are found by pattern, secrets (keys,
tokens, passwords) by the information they hold: unbroken runs of letters and digits of at least
Settings.secret bits a character. Both are the protected entities. A second pass estimates from the
corpus how strongly a term reveals one of them, or that one of a kind follows (which is counted as an
entity named like the kind), or one of those that share a part (mail domain, network, first digits;
Settings.parts): with d(e) documents with an entity, d(t) with a term and d(t, e) with t
near e, of N in all, the term discloses log2(d(t, e) * N / (d(t) * d(e))) bits about e and names it
with the probability d(t, e) / d(t). All these count documents. So that copies of one text are no
evidence, t must be in several different contexts of e. Terms are words and, with Settings.phrases,
pairs of words that follow each other; a pair counts only where it discloses more than either of its
words. Terms beyond both thresholds are spans of the
kind "term" wherever they stand, and are generalised or removed like the others.

Matching takes time in proportion to the text: no run of digits, letters or signs is read again from
each of its characters. Texts are worked on in slices of about a MB (a longer text alone).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, rows, saved, strings

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret", "term")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Possessive quantifiers: what follows never begins with what they took, so no match is lost.
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match begins where a run of digits does (or at once after another match, which ends with its run).
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+(?![A-Za-z0-9])")
DIGIT, NUMBERS = re.compile("[0-9]"), re.compile("[^0-9]+")
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """near: words on each side of an entity that count as its context. support: least number of
    different contexts of an entity, and of documents, that a term must be near it in; kind_support:
    for all entities of a kind.
    bits: least disclosure. share: least probability of the entity given the term. secret: bits a
    character that make a run of letters and digits a secret. broadcast_rows: most terms that are
    sent to all tasks; beyond it, terms are joined with the documents' words. parts: entities that
    share a part count together too, with the support of an entity. phrases: pairs of words are terms too."""

    near: int = 5
    support: int = 2
    kind_support: int = 5
    bits: float = 4.0
    share: float = 0.5
    secret: float = 3.0
    broadcast_rows: int = 200_000
    parts: bool = False
    phrases: bool = False


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of a local part, "@" and a dotted host: around every "@", from the end of the match or
    the "@" before."""
    least, at = 0, text.find("@")
    while at >= 0:
        part = text[least:at]
        size = len(part) - len(part.rstrip(LOCAL))
        host = HOST.match(text, at + 1) if size else None
        if host:
            yield at - size, host.end()
        least = host.end() if host else at + 1
        at = text.find("@", max(least, at + 1))


def bits_per_character(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def secrets(text: str, least: float) -> Iterator[tuple[int, int]]:
    for m in SECRET.finditer(text):
        if DIGIT.search(m[0]) and not m[0].isdigit() and bits_per_character(m[0]) >= least:
            yield m.span()


def direct(text: str, secret: float | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind's index) of all direct identifiers, by start, then kind; with secret, of
    secrets too."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (x.lstrip("0") for x in m[0].split("."))):
                out.append((*m.span(), 1))
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := NUMBERS.sub("", m[0])) <= 19 and luhn(d):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(NUMBERS.sub("", m[0])) <= 15]
        if secret is not None:
            out += [(a, b, 4) for a, b in secrets(text, secret)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def entity(kind: int, value: str) -> str:
    """Name under which mentions of an entity are counted together; a secret is named by its digest."""
    if kind == 4:
        return f"secret:{hashlib.sha256(value.encode()).hexdigest()}"
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else NUMBERS.sub('', value)}"


def shared_parts(kind: int, value: str) -> list[str]:
    """Names of what an entity has in common with others: an address's mail domain, the first three
    numbers of an IP address, a phone number without its last four digits, a card's first six."""
    if kind == 0:
        return [f"domain:{value.rsplit('@', 1)[1].lower()}"]
    if kind == 1:
        return [f"network:{value.rsplit('.', 1)[0]}"]
    digits = NUMBERS.sub("", value)
    return [f"issuer:{digits[:6]}"] if kind == 2 else [f"exchange:{digits[:-4]}"] if kind == 3 else []


def contexts(text: str, found: list[tuple[int, int, int]], near: int, parts: bool = False, phrases: bool = False) -> dict[str, dict[int, list[str]]]:
    """Entity (and kind, and parts) -> its contexts in a text: hash of the words around -> those (and
    pairs of them) that can be terms. Words that overlap an identifier are in no context."""
    at = np.fromiter((x for m in WORD.finditer(text) for x in m.span()), dtype=np.int64).reshape(-1, 2)
    starts, ends = np.array([a for a, _, _ in found]), np.maximum.accumulate([b for _, b, _ in found])
    k = np.searchsorted(starts, at[:, 1], "left")
    place = np.flatnonzero((k == 0) | (ends[np.maximum(k - 1, 0)] <= at[:, 0]))
    at = at[place]
    of: dict[str, dict[int, list[str]]] = {}
    for a, b, kind in found:
        i, j = np.searchsorted(at[:, 0], (a, b))
        words = [text[x:y].lower() for x, y in at[max(i - near, 0) : i].tolist() + at[j : j + near].tolist()]
        context = xxhash.xxh64_intdigest("\0".join(words)) >> 1
        terms = {w for w in words if not w.isdigit()}
        if phrases:
            of_words = np.r_[place[max(i - near, 0) : i], place[j : j + near]].tolist()
            terms |= {f"{v} {w}" for v, w, x, y in zip(words, words[1:], of_words, of_words[1:]) if y == x + 1 and not v.isdigit() and not w.isdigit()}
        terms = sorted(terms)
        for name in (entity(kind, text[a:b]), ALL_KINDS[kind], *(shared_parts(kind, text[a:b]) if parts else ())):
            of.setdefault(name, {})[context] = terms
    return of


def disclosing(docs: DataFrame, s: Settings) -> DataFrame:
    """docs (text) -> (term, entity, n_both, n_term, n_entity, d_both, d_entity, bits) for terms beyond
    the thresholds; entity is a kind's name where the term discloses that one of the kind follows.

    n_both and n_entity count contexts by their own words, so that copies of a text count as one;
    only the support is held against them (and against d_both). d_both, n_term and d_entity count documents, each row as
    one; bits and share are taken from these. All numbers are aggregated over the whole corpus.
    """
    context = pa.struct([("context", pa.int64()), ("terms", pa.list_(pa.string()))])
    schema = pa.schema([("entity", pa.string()), ("place", pa.string()), ("contexts", pa.list_(context)), ("n", pa.int64())])

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in by_size(b, 0)):
            # What documents have of an entity, and how many have just that: copies fall into one row.
            count: dict[tuple[str, str], list] = {}
            for text in strings(batch.column(0)):
                if found := direct(text, s.secret):
                    for e, of in contexts(text, found, s.near, s.parts, s.phrases).items():
                        place = hashlib.sha256(",".join(map(str, sorted(of))).encode()).hexdigest()
                        count.setdefault((e, place), [of, 0])[1] += 1
            if count:
                yield rows(
                    schema, entity=[e for e, _ in count], place=[p for _, p in count],
                    contexts=[[{"context": c, "terms": t} for c, t in x.items()] for x, _ in count.values()], n=[n for _, n in count.values()],
                )

    made = docs.select("text").mapInArrow(mentions, "entity string, place string, contexts array<struct<context:long,terms:array<string>>>, n long")
    met = saved(made.groupBy("entity", "place").agg(F.first("contexts").alias("contexts"), F.sum("n").alias("n")))
    each = met.select("entity", F.explode("contexts").alias("x")).select("entity", "x.context", "x.terms").dropDuplicates(["entity", "context"])
    enough = F.when(F.col("entity").isin(*ALL_KINDS), s.kind_support).otherwise(s.support)
    both = each.select("entity", "context", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= enough)
    both = saved(both)
    of_entity = each.groupBy("entity").agg(F.count("*").alias("n_entity")).join(met.groupBy("entity").agg(F.sum("n").alias("d_entity")), "entity")
    near = met.select("entity", "n", F.explode(F.array_distinct(F.flatten(F.col("contexts.terms")))).alias("term")).groupBy("entity", "term").agg(F.sum("n").alias("d_both"))
    terms = both.select("term").distinct()
    n_terms = terms.count()
    total = docs.count()
    if n_terms == 0:
        none = F.lit(0).cast("long")
        return both.select("term", "entity", "n_both", none.alias("n_term"), none.alias("n_entity"), none.alias("d_both"), none.alias("d_entity"), F.lit(0.0).alias("bits"))
    n_term = frequencies(docs, terms, n_terms <= s.broadcast_rows, s.phrases)
    all_ = both.join(n_term, "term").join(near, ["entity", "term"]).join(of_entity, "entity")
    all_ = all_.where(F.col("d_both") >= enough)
    bits = F.log2(F.col("d_both") * F.lit(float(max(total, 1))) / (F.col("n_term") * F.col("d_entity")))
    beyond = all_.withColumn("bits", bits).where((F.col("bits") >= s.bits) & (F.col("d_both") >= s.share * F.col("n_term"))).select("term", "entity", "n_both", "n_term", "n_entity", "d_both", "d_entity", "bits")
    if not s.phrases:
        return beyond
    # A pair of words that discloses no more than one of its words is left to that word.
    beyond = saved(beyond)
    word = beyond.where("not contains(term, ' ')").select("entity", F.col("term").alias("w"), F.col("bits").alias("by_word"))
    pairs = beyond.where("contains(term, ' ')").select("entity", "term", "bits", F.explode(F.split("term", " ")).alias("w"))
    weaker = pairs.join(word, ["entity", "w"]).where("by_word >= bits").select("entity", "term")
    return beyond.join(weaker, ["entity", "term"], "left_anti").select(beyond.columns)


def words_of(text: str, phrases: bool = False) -> set[str]:
    """The distinct words of a text, and the pairs of words that follow each other; each word is
    lowered alone, as contexts and spans do."""
    if not phrases:
        return {w.lower() for w in set(WORD.findall(text))}
    words = [w.lower() for w in WORD.findall(text)]
    return set(words).union(f"{v} {w}" for v, w in zip(words, words[1:]))


def frequencies(docs: DataFrame, terms: DataFrame, small: bool, phrases: bool = False) -> DataFrame:
    """(term, n_term): the number of rows of docs with each of the terms."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])
    known = docs.sparkSession.sparkContext.broadcast({r["term"] for r in terms.toLocalIterator()}) if small else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        wanted = known.value if known is not None else None
        for batch in (x for b in batches for x in by_size(b, 0)):
            for text in strings(batch.column(0)):
                words = words_of(text, phrases)
                count.update(words if wanted is None else words & wanted)
            if len(count) > 200_000:
                yield rows(schema, term=list(count), n=list(count.values()))
                count = Counter()
        yield rows(schema, term=list(count), n=list(count.values()))

    counted = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counted if small else counted.join(terms, "term", "left_semi")


SPANS = "spans array<struct<start:int,end:int,kind:string>>"


def spans_of(text: str, terms, secret: float, phrases: bool = False) -> list[tuple[int, int, int]]:
    """(start, end, kind's index) of direct identifiers, secrets and terms, by start, then kind."""
    found = direct(text, secret)
    if terms and not terms.isdisjoint(words_of(text, phrases)):
        starts, ends = [a for a, _, _ in found], np.maximum.accumulate([b for _, b, _ in found]) if found else ()
        words = [(*m.span(), m[0].lower()) for m in WORD.finditer(text)]
        own = [(a, b) for a, b, w in words if w in terms]
        if phrases:
            own += [(a, b) for (a, _, v), (_, b, w) in zip(words, words[1:]) if f"{v} {w}" in terms]
        k = np.searchsorted(starts, [b for _, b in own], "left")
        found += [(a, b, 5) for (a, b), n in zip(own, k.tolist()) if n == 0 or ends[n - 1] <= a]
        found.sort(key=lambda x: (x[0], x[2], x[1]))
    return found


def span_lists(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    """The spans of texts as an Arrow list column."""
    flat = np.array([x for spans in found for x in spans], dtype=np.int32).reshape(-1, 3)
    kinds = pa.array(ALL_KINDS).take(pa.array(flat[:, 2]))
    made = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy()), kinds], names=["start", "end", "kind"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)), made)


def find_personal_data(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> their columns and spans: (start, end, kind) in code points, end
    exclusive, by start, then kind (email, ip, card, phone, secret, term).

    Null texts count as empty and have no spans; an empty table gives an empty one; a column of docs
    named spans gives way; very long texts, and runs of any one character, take time and memory in
    proportion to their length. Matches of different kinds may overlap and all stay; a term inside a
    direct identifier is no span of its own.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    s = s or Settings()
    kept = [c for c in docs.columns if c != "spans"]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    terms = saved(disclosing(docs, s).select("term").distinct())
    small = terms.count() <= s.broadcast_rows
    at = kept.index("text")
    schema = StructType([*docs.schema, *_parse_datatype_string(SPANS)])

    def apply(batches: Iterator[pa.RecordBatch], terms_of) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in by_size(b, at)):
            found = [spans_of(text, terms, s.secret, s.phrases) for text, terms in zip(strings(batch.column(at)), terms_of(batch))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), span_lists(found)], names=[*kept, "spans"])

    if small:
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.toLocalIterator()))
        return docs.mapInArrow(lambda batches: apply(batches, lambda b: [sent.value] * b.num_rows), schema)

    # Too many terms to send: each document's own terms come by a join with its words.
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("row", pa.string()), ("term", pa.string())])
        for batch in (x for b in batches for x in by_size(b, 0)):
            for text in strings(batch.column(0)):
                own = words_of(text, s.phrases)
                yield rows(out, row=[hashlib.sha256(text.encode()).hexdigest()] * len(own), term=sorted(own))

    pairs = docs.select("text").mapInArrow(words, "row string, term string").distinct().join(terms, "term")
    own = pairs.groupBy("row").agg(F.collect_set("term").alias("__terms")).withColumnRenamed("row", "__row")
    named = docs.withColumn("__row", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).join(own, "__row", "left").select(*kept, "__terms")
    return named.mapInArrow(lambda batches: apply(batches, lambda b: [frozenset(x or ()) for x in b.column(len(kept)).to_pylist()]), schema)


def sanitised(found: DataFrame, remove: bool = False) -> DataFrame:
    """The output of find_personal_data with its spans taken out of text (remove) or put as "<KIND>"."""
    schema = found.schema
    names = found.columns
    at, spans_at = names.index("text"), names.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist()):
                text, parts, end = text or "", [], 0
                for x in spans or ():
                    if x["start"] >= end:
                        parts += [text[end : x["start"]], "" if remove else f"<{x['kind'].upper()}>"]
                    end = max(end, x["end"])
                out.append("".join(parts) + text[end:])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=names)

    return found.mapInArrow(run, schema)
