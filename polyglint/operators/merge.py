"""Mutations as pure functions: current table and changes in, next table and change log out.

Each function returns one DataFrame with the next values and a column that says what happened to the
row; `applied` and `changes` split it. All categories are merged in one join rather than key by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import merged_ids

KEYS = ["category", "field", "jp_key"]


def applied(merged: DataFrame, log_columns: Sequence[str] = ("changed", "outcome")) -> DataFrame:
    """The next table: the merged rows without the columns of the log."""
    return merged.drop(*log_columns)


def official_merge(entries: DataFrame, official: DataFrame) -> DataFrame:
    """entries (keys, cn_text, source, ids) and official (keys, cn_text, ids) -> next entries with changed.

    A filled official text wins over everything but pinned rows; an empty one leaves a filled text
    alone, else the row is empty and unknown. Official ids are added to those there. A row counts as
    changed if its text, source or ids differ; missing keys are inserted; ids of trace-only keys
    (null cn_text) are added to rows that exist.
    """
    empty = F.array().cast("array<string>")
    o = official.select(*KEYS, F.col("cn_text").alias("__cn"), F.coalesce("ids", empty).alias("__ids"), F.lit(True).alias("__o"))
    both = entries.select(*KEYS, "cn_text", "source", F.coalesce("ids", empty).alias("ids"), F.lit(True).alias("__e")).join(o, KEYS, "full_outer")
    old_text, old_ids = F.coalesce("cn_text", F.lit("")), F.coalesce("ids", empty)
    cn = F.coalesce("__cn", F.lit(""))
    trace = F.col("__cn").isNull()
    untouched = F.col("__o").isNull() | trace | ((cn != "") & (F.coalesce("source", F.lit("")) == "pinned")) | ((cn == "") & (old_text != ""))
    text = F.when(untouched, old_text).when(cn != "", cn).otherwise("")
    source = F.when(untouched, F.col("source")).when(cn != "", "cn").otherwise("unknown")
    ids = F.when(F.col("__o").isNull(), old_ids).otherwise(merged_ids(old_ids, F.coalesce("__ids", empty)))
    made = both.where("__e is not null or __cn is not null").select(*KEYS, text.alias("__text"), source.alias("__source"), ids.alias("__new_ids"), "cn_text", "source", "ids", "__e")
    changed = F.col("__e").isNull() | ~F.col("__text").eqNullSafe(F.col("cn_text")) | ~F.col("__source").eqNullSafe(F.col("source")) | ~F.col("__new_ids").eqNullSafe(F.col("ids"))
    return made.select(*KEYS, F.col("__text").alias("cn_text"), F.col("__source").alias("source"), F.col("__new_ids").alias("ids"), changed.alias("changed"))


def machine_merge(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Machine translations (keys, text) onto entries: pinned, human and cn rows, and filled rows of
    any source but unknown and llm, are skipped; others get the text and the source llm; missing keys
    are inserted. outcome: kept, translated, skipped or inserted."""
    t = texts.select(*KEYS, F.col("text").alias("__t"))
    both = entries.select(*KEYS, "cn_text", "source", F.lit(True).alias("__e")).join(t, KEYS, "full_outer")
    guarded = F.col("source").isin("pinned", "human", "cn") | ((F.col("cn_text") != "") & ~F.col("source").isin("unknown", "llm"))
    outcome = F.when(F.col("__t").isNull(), "kept").when(F.col("__e").isNull(), "inserted").when(guarded, "skipped").otherwise("translated")
    made = both.withColumn("outcome", outcome)
    new = F.col("outcome").isin("inserted", "translated")
    return made.select(*KEYS, F.when(new, F.col("__t")).otherwise(F.col("cn_text")).alias("cn_text"), F.when(new, "llm").otherwise(F.col("source")).alias("source"), "outcome")


def propagated(entries: DataFrame, category: str, from_field: str, to_field: str) -> DataFrame:
    """Copy text and source of one field to another of the same category and key, over any source; changed marks rows that differ."""
    from .overlay import propagation_pairs

    pairs = propagation_pairs(entries, category, from_field, to_field).select(F.lit(category).alias("category"), F.lit(to_field).alias("field"), "jp_key", F.col("from_text").alias("__t"), F.col("from_source").alias("__s"))
    joined = entries.join(pairs, KEYS, "left")
    kept = [c for c in entries.columns if c not in ("cn_text", "source")]
    return joined.select(*kept, F.coalesce("__t", "cn_text").alias("cn_text"), F.coalesce("__s", "source").alias("source"), F.col("__t").isNotNull().alias("changed"))


def single_update(entries: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (keys, text, source) -> their outcome: ok, noop (nothing differs) or not_found."""
    joined = updates.join(entries.select(*KEYS, F.col("cn_text").alias("__t"), F.col("source").alias("__s")), KEYS, "left")
    same = F.col("text").eqNullSafe(F.col("__t")) & F.col("source").eqNullSafe(F.col("__s"))
    return joined.select(*KEYS, "text", "source", F.when(F.col("__s").isNull() & F.col("__t").isNull(), "not_found").when(same, "noop").otherwise("ok").alias("outcome"))


def revision_upsert(current: DataFrame, edits: DataFrame, keys: Sequence[str], values: Sequence[str], revision: str = "revision") -> DataFrame:
    """Edits replace values; a row's revision starts at 1 and grows by 1 with each real difference."""
    e = edits.select(*keys, *(F.col(v).alias(f"__{v}") for v in values), F.lit(True).alias("__e"))
    both = current.select(*keys, *values, revision, F.lit(True).alias("__c")).join(e, list(keys), "full_outer")
    differ = reduce(lambda a, b: a | b, (~F.col(v).eqNullSafe(F.col(f"__{v}")) for v in values))
    new = F.coalesce("__e", F.lit(False)) & (F.col("__c").isNull() | differ)
    made = both.withColumn("changed", new)
    return made.select(*keys, *(F.when(F.col("changed"), F.col(f"__{v}")).otherwise(F.col(v)).alias(v) for v in values), (F.coalesce(revision, F.lit(0)) + F.col("changed").cast("bigint")).cast("bigint").alias(revision), "changed")


def batch_problems(current: DataFrame, batch: DataFrame, keys: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """Why a batch can't be applied as a whole: unknown or repeated identities, sources out of the list."""
    missing = batch.join(current.select(*keys), list(keys), "left_anti").select(*keys, F.lit("unknown_identity").alias("problem"))
    twice = batch.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("repeated_identity").alias("problem"))
    bad = batch.where(~F.col("source").isin(*sources)).select(*keys, F.lit("bad_source").alias("problem"))
    return missing.unionByName(twice).unionByName(bad)


def batch_with_token(current: DataFrame, batch: DataFrame, keys: Sequence[str], sources: Sequence[str], token: Column, expected: Column) -> DataFrame:
    """Apply a batch only if it is sound as a whole and the snapshot token is the expected one;
    otherwise every row stays. outcome: applied, noop, kept or refused."""
    bad = batch_problems(current, batch, keys, sources).agg((F.count("*") > 0).alias("__bad"))
    b = batch.dropDuplicates(list(keys)).select(*keys, F.col("text").alias("__t"), F.col("source").alias("__s"), F.lit(True).alias("__b"))
    joined = current.join(b, list(keys), "left").crossJoin(F.broadcast(bad))
    same = F.col("__t").eqNullSafe(F.col("text")) & F.col("__s").eqNullSafe(F.col("source"))
    outcome = F.when(F.col("__b").isNull(), "kept").when(F.col("__bad") | (token != expected), "refused").when(same, "noop").otherwise("applied")
    made = joined.withColumn("outcome", outcome)
    new = F.col("outcome") == "applied"
    return made.select(*keys, F.when(new, F.col("__t")).otherwise(F.col("text")).alias("text"), F.when(new, F.col("__s")).otherwise(F.col("source")).alias("source"), "outcome")


def conditional_upsert(current: DataFrame, incoming: DataFrame, key: str, sticky: Sequence[str], plain: Sequence[str]) -> DataFrame:
    """Upsert in which '' never overwrites a filled sticky value; outcome: inserted, updated or same.
    Rows that are not in the incoming table stay as they are."""
    i = incoming.select(key, *(F.col(c).alias(f"__{c}") for c in (*sticky, *plain)), F.lit(True).alias("__i"))
    both = current.select(key, *sticky, *plain, F.lit(True).alias("__c")).join(i, key, "full_outer")
    there = F.col("__i").isNotNull()
    value = {c: F.when(there, F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c), F.lit(""))).otherwise(F.col(c)) for c in sticky}
    value |= {c: F.when(there, F.col(f"__{c}")).otherwise(F.col(c)) for c in plain}
    made = both.withColumns({f"__n_{c}": v for c, v in value.items()})
    differ = reduce(lambda a, b: a | b, (~F.col(f"__n_{c}").eqNullSafe(F.col(c)) for c in value))
    outcome = F.when(F.col("__c").isNull(), "inserted").when(there & differ, "updated").otherwise("same")
    return made.select(key, *(F.col(f"__n_{c}").alias(c) for c in value), outcome.alias("outcome"))


def superseded(reviews: DataFrame, catalog: DataFrame, key: str, fingerprint: str, state: str = "state") -> DataFrame:
    """Pending reviews whose catalogue fingerprint has changed or gone become superseded."""
    c = catalog.select(key, F.col(fingerprint).alias("__f"))
    joined = reviews.join(c, key, "left")
    stale = (F.col(state) == "pending") & ~F.col(fingerprint).eqNullSafe(F.col("__f"))
    return joined.select(*(F.when(stale, "superseded").otherwise(F.col(state)).alias(state) if x == state else F.col(x) for x in reviews.columns), stale.alias("changed"))


def row_edits(current: DataFrame, edits: DataFrame, key: str, revision: str = "revision", guard: str = "source_hash") -> DataFrame:
    """Line edits with a compare-and-set of each row's revision and a guard on its source.

    edits (key, text, expected, guard) -> outcome: ok, not_found, source_changed, revision_conflict or noop.
    """
    c = current.select(key, F.col("text").alias("__t"), F.col(revision).alias("__r"), F.col(guard).alias("__g"))
    joined = edits.join(c, key, "left")
    outcome = (
        F.when(F.col("__g").isNull(), "not_found").when(F.col("__g") != F.col(guard), "source_changed").when(F.col("__r") != F.col("expected"), "revision_conflict").when(F.col("__t").eqNullSafe(F.col("text")), "noop").otherwise("ok")
    )
    return joined.select(key, "text", outcome.alias("outcome"), (F.col("__r") + (outcome == "ok").cast("bigint")).alias(revision))


def insert_or_verify(current: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """Content-addressed insert: inserted, same, or conflict where the stored content differs."""
    joined = incoming.join(current.select(key, F.col(value).alias("__v"), F.lit(True).alias("__c")), key, "left")
    return joined.select(key, value, F.when(F.col("__c").isNull(), "inserted").when(F.col("__v").eqNullSafe(F.col(value)), "same").otherwise("conflict").alias("outcome"))


def review_state(gates: Sequence[Column]) -> Column:
    """State from gate decisions: rejected if any is, approved if all are, else pending."""
    any_ = reduce(lambda a, b: a | b, (g == "rejected" for g in gates))
    all_ = reduce(lambda a, b: a & b, (g == "approved" for g in gates))
    return F.when(any_, "rejected").when(all_, "approved").otherwise("pending")


def decided(reviews: DataFrame, decisions: DataFrame, key: str, gates: Sequence[str]) -> DataFrame:
    """decisions (key, gate, decision): the gate overall sets all gates; of several for one gate the
    last by order counts. Reviews that are not pending stay."""
    d = decisions.groupBy(key).agg(*(F.max_by(F.when(F.col("gate").isin(g, "overall"), F.col("decision")), F.when(F.col("gate").isin(g, "overall"), F.col("ord"))).alias(f"__{g}") for g in gates))
    joined = reviews.join(d, key, "left")
    new = {g: F.when(F.col("state") == "pending", F.coalesce(f"__{g}", g)).otherwise(F.col(g)) for g in gates}
    made = joined.select(key, "state", *(v.alias(g) for g, v in new.items()))
    return made.select(key, *gates, F.when(F.col("state") == "pending", review_state([F.col(g) for g in gates])).otherwise(F.col("state")).alias("state"))


def seeded(seed: DataFrame, owners: Sequence[DataFrame], key: str) -> DataFrame:
    """Seed rows are inserted only where nobody owns the key; others are preserved."""
    owned = reduce(DataFrame.unionByName, (o.select(key) for o in owners)).distinct().withColumn("__o", F.lit(True))
    return seed.join(owned, key, "left").select(*seed.columns, F.when(F.col("__o"), "preserved").otherwise("inserted").alias("outcome"))


def excluded(catalog: DataFrame, exclusions: DataFrame, key: str, title: str) -> DataFrame:
    """Catalogue without the excluded (id, title) pairs."""
    return catalog.join(exclusions.select(key, title), [key, title], "left_anti")


def exclusion_problems(catalog: DataFrame, exclusions: DataFrame, key: str, title: str) -> DataFrame:
    """Exclusions that don't match exactly one row."""
    n = catalog.groupBy(key, title).agg(F.count("*").alias("n"))
    return exclusions.join(n, [key, title], "left").select(key, title, F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def promoted(segments: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """All filled segments become human; the revision of active ones grows."""
    on = active.select(key).distinct().withColumn("__a", F.lit(True))
    grows = F.coalesce("__a", F.lit(False)) & (F.col("source") != "human") & (F.col("text") != "")
    return segments.join(on, key, "left").select(key, "text", F.when(F.col("text") != "", "human").otherwise(F.col("source")).alias("source"), (F.col("revision") + grows.cast("bigint")).alias("revision"))


def carried_over(old: DataFrame, new: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Localisations of replaced segments move to new ones of the same (episode, kind, source hash),
    where that is unambiguous on both sides."""
    one = lambda df: df.groupBy(*keys).agg(F.count("*").alias("__n"), F.max("segment_id").alias("segment_id"), *([F.max(text).alias(text)] if text in df.columns else [])).where("__n = 1").drop("__n")
    return one(new).join(one(old).select(*keys, text), list(keys)).select("segment_id", text)


def reconciled_segments(current: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """Segments after a scenario changes: kept, archived (no longer canonical) or inserted."""
    both = current.select(key, F.lit(True).alias("__c")).join(canonical.select(key, F.lit(True).alias("__n")), key, "full_outer")
    return both.select(key, F.when(F.col("__c").isNull(), "inserted").when(F.col("__n").isNull(), "archived").otherwise("kept").alias("outcome"))


def guarded_replace(stories: DataFrame, incoming: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """Incoming stories replace those there unless a translation of theirs is protected."""
    p = protected.select(key).distinct()
    taken = incoming.join(p, key, "left_anti")
    return stories.join(taken.select(key), key, "left_anti").unionByName(taken)


def still_open(targets: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Machine results apply only where the target is still empty and its source has not changed."""
    joined = results.join(targets.select(key, F.col("text").alias("__t"), F.col("source_text").alias("__s")), key, "left")
    return joined.select(key, "text", F.when(F.col("__s").isNull(), "not_found").when(F.col("__t") != "", "filled").when(F.col("__s") != F.col("source_text"), "source_changed").otherwise("applied").alias("outcome"))


def resumed(previous: DataFrame, catalog: DataFrame, key: str, same: Sequence[str], code: str, retry: Sequence[str]) -> DataFrame:
    """Results of a prior run that still match the catalogue and need no retry; for others the reason."""
    c = catalog.select(key, *(F.col(x).alias(f"__{x}") for x in same), F.lit(True).alias("__c"))
    joined = previous.join(c, key, "left")
    ok = reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(f"__{x}")) for x in same))
    return joined.select(*previous.columns, F.when(F.col("__c").isNull(), "gone").when(~ok, "changed").when(F.col(code).isin(*retry), "retry").otherwise("kept").alias("outcome"))


def repaired_links(artifacts: DataFrame, links: DataFrame, key: str, refs: str) -> DataFrame:
    """Links together with those that artifacts name and that are missing, by position."""
    named = artifacts.select(key, F.posexplode(refs).alias("position", "evidence"))
    missing = named.join(links, [key, "evidence"], "left_anti")
    return links.select(key, "evidence", "position", F.lit(False).alias("repaired")).unionByName(missing.select(key, "evidence", "position", F.lit(True).alias("repaired")))


def publish(published: DataFrame, documents: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Publish the requested revision of a document if it is the current one; -1 takes a document off.
    outcome: published, unpublished, conflict, not_found or kept."""
    d = documents.select(key, F.col("revision").alias("__d"))
    r = requests.select(key, F.col("revision").alias("__r"))
    all_ = published.select(key, F.col("revision").alias("__p")).join(r, key, "full_outer").join(d, key, "left")
    outcome = F.when(F.col("__r").isNull(), "kept").when(F.col("__r") == -1, F.when(F.col("__p").isNull(), "not_found").otherwise("unpublished")).when(F.col("__d").isNull(), "not_found").when(F.col("__d") != F.col("__r"), "conflict").otherwise("published")
    made = all_.withColumn("outcome", outcome)
    return made.select(key, F.when(F.col("outcome") == "published", F.col("__r")).when(F.col("outcome") == "unpublished", None).otherwise(F.col("__p")).alias("revision"), "outcome")
