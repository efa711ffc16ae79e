"""Documents that are saved, restored, published and judged as a whole."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_digest(columns: Sequence[str]) -> Column:
    """Digest of a document's content; null and missing members count as one."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def same_content(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, same) for the documents that are in both tables."""
    left, right = (df.select(key, content_digest(columns).alias(n)) for df, n in ((a, "__a"), (b, "__b")))
    return left.join(right, key).select(key, (F.col("__a") == F.col("__b")).alias("same"))


def _edited(current: DataFrame, edits: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Documents and edits of a key side by side, with an outcome; edits of one key count as one."""
    e = edits.groupBy(key).agg(F.count("*").alias("__n"), F.max(F.struct(F.col("revision").alias("__base"), content_digest(columns).alias("__new"), *(F.col(c).alias(f"__{c}") for c in columns))).alias("__e")).select(key, "__n", "__e.*")
    both = current.withColumn("__old", content_digest(columns)).join(e, key, "full_outer")
    outcome = (
        F.when(F.col("__n").isNull(), "kept")
        .when(F.col("__n") > 1, "repeated")
        .when(F.col("revision").isNull() & F.col("__base").isNotNull(), "not_found")
        .when(~F.col("__base").eqNullSafe(F.col("revision")), "conflict")
        .when(F.col("revision").isNull(), "created")
        .when(F.col("__old") == F.col("__new"), "unchanged")
        .otherwise("saved")
    )
    return both.withColumn("outcome", outcome)


def edit_outcomes(current: DataFrame, edits: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, outcome), one row for each edit: as in saved(), also for those that make no document, and
    not_found for an edit of a document that is not there."""
    judged = _edited(current, edits, key, columns).where("__n is not null")
    return judged.select(key, "outcome", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__i")).drop("__i")


def saved(current: DataFrame, edits: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Next documents (key, columns, revision) with an outcome. An edit states the revision it was made
    from (null: none). created, saved (revision grows), unchanged (the content is the same),
    conflict (another revision is current), repeated (two edits of it: none is taken), kept (no edit)."""
    takes = F.col("outcome").isin("created", "saved")
    made = _edited(current, edits, key, columns)
    out = made.select(key, *(F.when(takes, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns), (F.coalesce("revision", F.lit(0)) + takes.cast("int")).cast("bigint").alias("revision"), "outcome")
    return out.where("revision > 0")


def restored(current: dict[str, DataFrame], backup: dict[str, DataFrame], problems: DataFrame) -> dict[str, DataFrame]:
    """The backup's tables if nothing speaks against any of them, else all current ones. problems has a
    row for each thing that is wrong."""
    n = F.broadcast(problems.agg(F.count("*").alias("__n")))
    out = {}
    for name, df in current.items():
        new = backup[name].select(*df.columns)
        out[name] = df.crossJoin(n).where("__n > 0").drop("__n").unionByName(new.crossJoin(n).where("__n = 0").drop("__n"))
    return out


def decided_batch(reviews: DataFrame, decisions: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """Reviews after a batch of decisions (key, decision) that counts as a whole: none is taken if one is
    of an unknown review, of one that is not pending, of an unknown kind, or given twice."""
    d = decisions.groupBy(key).agg(F.count("*").alias("__n"), F.max("decision").alias("__d"))
    joined = d.join(reviews.select(key, F.col("state").alias("__s")), key, "left")
    wrong = joined.where(F.col("__s").isNull() | (F.col("__s") != "pending") | (F.col("__n") > 1) | ~F.col("__d").isin(*allowed))
    stop = F.broadcast(wrong.agg((F.count("*") > 0).alias("__stop")))
    return reviews.join(d.select(key, "__d"), key, "left").crossJoin(stop).select(key, F.when(F.col("__stop"), F.col("state")).otherwise(F.coalesce("__d", "state")).alias("state"))


def _requested(current: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Editions and requests side by side, with an outcome; requests for one edition count as one."""
    r = requests.groupBy(key, "edition").agg(F.count("*").alias("__n"), F.max("action").alias("__a"), F.max("title").alias("__t"))
    both = current.join(r, [key, "edition"], "full_outer")
    there = F.col("is_default").isNotNull()
    refused = F.when(F.col("__n") > 1, "repeated").when((F.col("__a") == "create") & there, "exists").when((F.col("__a") != "create") & ~there, "not_found").when((F.col("__a") == "delete") & F.col("is_default"), "is_default")
    return both.withColumn("outcome", F.when(F.col("__n").isNull(), "kept").otherwise(F.coalesce(refused, F.lit("ok"))))


def edition_outcomes(current: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """(key, edition, outcome), one row for each request: ok, exists, not_found, is_default or repeated."""
    judged = _requested(current, requests, key).where("__n is not null")
    return judged.select(key, "edition", "outcome", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__i")).drop("__i")


def editions(current: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Editions (key, edition, title, is_default) after one request each (key, edition, action, title):
    create, rename, default or delete. The default edition can't be deleted; of two requests for one
    edition none is taken."""
    made = _requested(current, requests, key)
    ok = F.col("outcome") == "ok"
    new_default = made.where(ok & (F.col("__a") == "default")).groupBy(key).agg(F.min("edition").alias("__default"))
    made = made.join(new_default, key, "left")
    title = F.when(ok & F.col("__a").isin("create", "rename"), F.col("__t")).otherwise(F.col("title"))
    is_default = F.when(F.col("__default").isNotNull(), F.col("edition") == F.col("__default")).otherwise(F.coalesce("is_default", F.lit(False)))
    there = F.col("is_default").isNotNull() | (ok & (F.col("__a") == "create"))
    gone = (ok & (F.col("__a") == "delete")) | ~there
    return made.where(~gone).select(key, "edition", title.alias("title"), is_default.alias("is_default"), "outcome")


def edition_choice(documents: DataFrame, available: DataFrame, requested: DataFrame, key: str, implicit: str = "main") -> DataFrame:
    """The edition that is shown: the requested one if it is there, else the default, else the implicit one."""
    default = available.where("is_default").groupBy(key).agg(F.min("edition").alias("__d"))
    wanted = requested.join(available.select(key, "edition"), [key, "edition"], "left_semi").select(key, F.col("edition").alias("__w"))
    return documents.select(key).join(wanted, key, "left").join(default, key, "left").select(key, F.coalesce("__w", "__d", F.lit(implicit)).alias("edition"))


def drafts(approved: DataFrame, documents: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Approved sources as drafts of revision 1, where the document is not there; a second run adds nothing."""
    new = approved.join(documents.select(key), key, "left_anti")
    one = new.groupBy(key).agg(F.min(F.struct(*columns)).alias("__v"))
    return one.select(key, "__v.*", F.lit(1).cast("bigint").alias("revision"), F.lit("draft").alias("state"))


def conflicts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that two tables claim, which only one may own."""
    return a.select(key).distinct().join(b.select(key).distinct(), key)


def verified_import(current: dict[str, DataFrame], manifest: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """(kind, key, outcome) of a manifest over several tables: inserted, replayed (there with the same
    value) or mismatch."""
    parts = []
    for kind, df in manifest.items():
        c = current[kind].select(key, F.col(value).alias("__c"), F.lit(True).alias("__k"))
        outcome = F.when(F.col("__k").isNull(), "inserted").when(F.col("__c").eqNullSafe(F.col(value)), "replayed").otherwise("mismatch")
        parts.append(df.join(c, key, "left").select(F.lit(kind).alias("kind"), key, outcome.alias("outcome")))
    return reduce(DataFrame.unionByName, parts)


def upconverted(documents: DataFrame, key: str, lines: str) -> DataFrame:
    """Documents of one list of lines (order, text) as those of one rendition with sides and line ids."""
    line = lambda x: F.struct(F.concat(F.lit("l"), x["order"]).alias("id"), x["order"].alias("order"), F.array(F.struct(F.lit("").alias("side"), x["text"].alias("text"))).alias("sides"))
    return documents.select(key, F.lit(3).alias("version"), F.array(F.struct(F.lit("main").alias("rendition"), F.transform(lines, line).alias("lines"))).alias("renditions"))


def downgraded(documents: DataFrame, key: str) -> DataFrame:
    """The older form of documents that have one rendition and one side a line; others have none."""
    r = F.col("renditions")[0]["lines"]
    fits = (F.size("renditions") == 1) & F.forall(r, lambda x: F.size(x["sides"]) == 1)
    return documents.where(fits).select(key, F.transform(r, lambda x: F.struct(x["order"].alias("order"), x["sides"][0]["text"].alias("text"))).alias("lines"))
