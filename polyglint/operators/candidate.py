"""Public candidates of a recovery batch: index and documents of all songs, or a refusal.

Nine record sets of a song meet in one tagged union and one exchange by its key: records of a line
fold to the line, all others to single values and counts, then both fold to the song. A song's state
decides what it must own; whatever is amiss is named in its problems, and one problem anywhere
refuses the batch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Availability states (fixed values of the format): two carry text, one is satisfied without, the others are open.
TEXT_STATES, SATISFIED, OPEN_STATES = ("complete", "game_only"), "satisfied_no_lyrics", ("ambiguous", "missing", "incomplete", "failed")
STATES = (*TEXT_STATES, SATISFIED, *OPEN_STATES)
#: Assignments to everybody, which name no performer (fixed values of the format).
EVERYBODY = ("", "chorus", "ensemble", "all", "everyone")
INSTRUMENTAL = "catalog_instrumental"
RUBY = "array<struct<text:string,reading:string>>"
SEGMENTS = f"array<struct<text:string,performers:array<string>,ruby:{RUBY}>>"
LINES = f"array<struct<id:string,text:string,stanza:boolean,trailing:array<string>,segments:{SEGMENTS}>>"
PUBLIC = f"array<struct<id:string,ja:string,zh:string,en:string,stanza:boolean,segments:array<struct<text:string,performers:array<bigint>,ruby:{RUBY}>>,trailing:array<bigint>>>"
SOURCE = "struct<provenance:map<string,string>>"
AVAILABILITY = f"struct<state:string,noLyricsReason:string,provenance:map<string,string>,performers:array<struct<id:string,name:string>>,lines:{LINES}>"
#: The record sets with the columns they bring into the union; those of a batch are cut to it.
SETS = {
    "music": ("title_ja string", "title_zh string", "title_en string"),
    "items": ("state string", "document_sha string", "availability_sha string"),
    "documents": ("revision bigint", "updated_at bigint"),
    "lines": ("line_id string", "position bigint", "ja string", "zh string", "en string", "stanza boolean"),
    "segments": ("line_id string", "position bigint", "text string", "performers array<bigint>", f"ruby {RUBY}"),
    "sources": ("document_sha string", "document_json string"),
    "availability": ("state string", "document_sha string", "document_json string", "created_at bigint"),
    "contributions": ("component string", "rendition string"),
    "aliases": ("alias string", "performer_id bigint"),
}
BATCHED = ("items", "sources", "availability", "contributions")
ONE = ("music", "items", "documents", "sources", "availability")


def normalised(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def aliases(performers: DataFrame) -> DataFrame:
    """(performer_id, name_ja, name_zh, name_en) -> (alias, performer_id); an alias of two performers is none's."""
    name = F.explode(F.array(*(normalised(F.col(c)) for c in ("name_ja", "name_zh", "name_en"))))
    named = performers.select(name.alias("alias"), "performer_id").where("alias <> ''")
    return named.groupBy("alias").agg(F.min("performer_id").alias("performer_id"), F.max("performer_id").alias("__m")).where("performer_id = __m").drop("__m")


def _names(lines: Column) -> Column:
    """Every performer that lines name, in their trailing lists and their segments."""
    own = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    return F.flatten(F.transform(_some(lines, LINES), lambda x: F.concat(own(x["trailing"]), F.flatten(F.transform(_some(x["segments"], SEGMENTS), lambda s: own(s["performers"]))))))


def _some(column: Column, kind: str) -> Column:
    return F.coalesce(column, F.array().cast(kind))


def _asked(availability: DataFrame) -> DataFrame:
    """The names that a song's availability document uses, once each."""
    d = F.from_json("document_json", AVAILABILITY)
    declared = F.flatten(F.transform(_some(d["performers"], "array<struct<id:string,name:string>>"), lambda p: F.array(p["id"], p["name"])))
    return availability.select("music_id", F.explode(F.array_distinct(F.transform(F.concat(_names(d["lines"]), declared), normalised))).alias("alias")).distinct()


def union(records: Mapping[str, DataFrame], batch: str) -> DataFrame:
    """The tagged union: (music_id, line, and one struct per record set, null in other sets' rows)."""
    cut = {k: df.where(F.col("batch") == batch) if k in BATCHED else df for k, df in records.items()}
    cut["aliases"] = _asked(cut["availability"]).join(aliases(records["performers"]), "alias")
    out = None
    for k, columns in SETS.items():
        payload = F.struct(*(F.col(n).cast(kind).alias(n) for n, kind in (c.split(" ", 1) for c in columns)))
        kinds = [(payload if k == j else F.lit(None).cast("struct<" + ",".join(c.replace(" ", ":", 1) for c in SETS[j]) + ">")).alias(j) for j in SETS]
        line = F.col("line_id").cast("string") if k in ("lines", "segments") else F.lit(None).cast("string")
        rows = cut[k].select(F.col("music_id").cast("bigint").alias("music_id"), line.alias("line"), *kinds)
        out = rows if out is None else out.unionByName(rows)
    return out


def _numbered(items: Column, at: str) -> Column:
    """Whether positions run 0, 1, 2, ..."""
    return F.forall(F.transform(items, lambda x, i: F.coalesce(x[at] == i, F.lit(False))), lambda ok: ok)


def songs(records: Mapping[str, DataFrame], batch: str, parts: int | None = None) -> DataFrame:
    """One row per song: its records, how many there were of those that must be one, its lines in order.

    Both folds run on the one exchange by song, to `parts` tasks where given; a song's records are its
    published document's, which is bounded."""
    lists = {"contributions": "components", "aliases": "names"}
    held = F.array_sort(F.collect_list(F.when(F.col("segments").isNotNull(), F.struct("segments.position", "segments"))))
    by_line = union(records, batch).repartition(*([parts] if parts else []), "music_id").groupBy("music_id", "line").agg(
        *(F.count(k).alias(f"n_{k}") for k in (*ONE, "lines")), *(F.max(k).alias(k) for k in (*ONE, "lines")), *(F.collect_list(k).alias(n) for k, n in lists.items()), held.alias("parts")
    )
    line = F.struct(
        "lines.position", F.col("line").alias("id"), "lines.ja", "lines.zh", "lines.en", F.coalesce("lines.stanza", F.lit(False)).alias("stanza"),
        F.col("n_lines").alias("n"), _numbered(F.col("parts"), "position").alias("numbered"), F.transform("parts", lambda p: p["segments"]).alias("segments"),
    )
    return by_line.groupBy("music_id").agg(
        *(F.sum(f"n_{k}").alias(f"n_{k}") for k in ONE), *(F.max(k).alias(k) for k in ONE), *(F.flatten(F.collect_list(n)).alias(n) for n in lists.values()),
        F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), line))).alias("lines"),
    )


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), "")


def _sound(lines: Column, text: str) -> Column:
    """Whether lines are there and whole: segments give the line's text, ruby gives the segment's, all within the format's bounds."""
    good_ruby = lambda s: (F.size(_some(s["ruby"], RUBY)) > 0) & (_joined(s["ruby"]) == s["text"])
    good = lambda x: F.coalesce((x[text] != "") & (F.octet_length(x[text]) <= 16 << 10) & F.size(x["segments"]).between(1, 100) & (_joined(x["segments"]) == x[text]) & F.forall(x["segments"], lambda s: F.coalesce((s["text"] != "") & good_ruby(s), F.lit(False))), F.lit(False))
    return F.coalesce(F.size(lines).between(1, 5000) & F.forall(lines, good), F.lit(False))


def _same_components(provenance: Column) -> Column:
    """Whether the stored contributions are exactly the document's."""
    stored = F.array_sort("components")
    expected = F.array_sort(F.transform(F.map_entries(provenance), lambda e: F.struct(e["key"].alias("component"), e["value"].alias("rendition"))))
    return F.coalesce((stored == expected) & F.forall(stored, lambda c: (c["component"] != "") & (c["rendition"] != "")), F.lit(False))


def states(records: Mapping[str, DataFrame], batch: str, parts: int | None = None) -> DataFrame:
    """One row per song of the catalogue or the batch: (music_id, state, revision, updated_at, titles,
    versions, no_lyrics_reason, lines, problems). Songs of text states alone have lines."""
    d, source, state = F.col("d"), F.col("source"), F.col("items.state")
    found = songs(records, batch, parts).where("n_items > 0 or n_music > 0")
    found = found.withColumns({"d": F.from_json("availability.document_json", AVAILABILITY), "source": F.from_json("sources.document_json", SOURCE)})
    # What a document declares, by id and by name, and which of the catalogue's performers that is.
    known = lambda n: F.get(F.filter("names", lambda x: x["alias"] == n), F.lit(0))["performer_id"]
    mapped = F.transform(_some(d["performers"], "array<struct<id:string,name:string>>"), lambda p: F.struct(normalised(p["id"]).alias("id"), normalised(p["name"]).alias("name"), F.coalesce(known(normalised(p["id"])), known(normalised(p["name"]))).alias("performer_id")))
    found = found.withColumn("declared", mapped)
    declared = lambda n: F.get(F.filter("declared", lambda p: (p["id"] == n) | (p["name"] == n)), F.lit(0))
    performer = lambda n: F.coalesce(declared(n)["performer_id"], known(n))
    named = lambda a: F.filter(F.transform(_some(a, "array<string>"), normalised), lambda n: ~n.isin(*EVERYBODY))
    ids = lambda a: F.array_distinct(F.array_compact(F.transform(named(a), performer)))
    game = F.transform(
        _some(d["lines"], LINES),
        lambda x: F.struct(
            x["id"].alias("id"), x["text"].alias("ja"), F.lit("").alias("zh"), F.lit("").alias("en"), F.coalesce(x["stanza"], F.lit(False)).alias("stanza"),
            F.transform(x["segments"], lambda s: F.struct(s["text"].alias("text"), ids(s["performers"]).alias("performers"), s["ruby"].alias("ruby"))).alias("segments"), ids(x["trailing"]).alias("trailing"),
        ),
    )
    full = F.transform("lines", lambda x: F.struct(x["id"].alias("id"), x["ja"].alias("ja"), F.coalesce(x["zh"], F.lit("")).alias("zh"), F.coalesce(x["en"], F.lit("")).alias("en"), x["stanza"].alias("stanza"), F.transform(x["segments"], lambda s: F.struct(s["text"].alias("text"), _some(s["performers"], "array<bigint>").alias("performers"), s["ruby"].alias("ruby"))).alias("segments"), F.array().cast("array<bigint>").alias("trailing")))
    complete, game_only, others = state == "complete", state == "game_only", state.isin(SATISFIED, *OPEN_STATES)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    held = F.col("n_availability") > 0
    ids_declared = F.array_compact(F.transform("declared", lambda p: p["performer_id"]))
    reason = F.coalesce(d["noLyricsReason"], F.lit(""))
    checks = {
        "not_in_catalog": F.col("n_music") == 0,
        "not_covered": F.col("n_items") == 0,
        "repeated": F.greatest(*(F.col(f"n_{k}") for k in ONE)) > 1,
        "state": (F.col("n_items") > 0) & no(state.isin(*STATES)),
        "title": (F.col("n_music") > 0) & no((F.col("music.title_ja") != "") & (F.greatest(*(F.coalesce(F.octet_length(f"music.title_{x}"), F.lit(0)) for x in ("ja", "zh", "en"))) <= 64 << 10)),
        "ownership": (complete & no((F.col("n_documents") > 0) & (F.col("sources.document_sha") == F.col("items.document_sha"))))
        | (game_only & no(held & (F.col("availability.state") == state) & (d["state"] == state) & (F.col("availability.document_sha") == F.col("items.availability_sha")) & (F.col("availability.created_at") > 0))),
        "header": complete & (F.col("n_documents") > 0) & no((F.col("documents.revision") > 0) & (F.col("documents.updated_at") > 0)),
        "contributions": (complete & ~_same_components(source["provenance"])) | (game_only & ~_same_components(d["provenance"])),
        "lines": (complete & no(_numbered(F.col("lines"), "position") & F.forall("lines", lambda x: (x["n"] == 1) & x["numbered"]) & _sound(F.col("lines"), "ja"))) | (game_only & ~_sound(d["lines"], "text")),
        "performers": game_only & (F.exists(named(_names(d["lines"])), lambda n: declared(n).isNull() & known(n).isNull()) | (F.size(ids_declared) > F.size(F.array_distinct(ids_declared)))),
        "availability": others & no(held & (F.col("availability.state") == state) & (d["state"] == state)),
        "reason": ((state == SATISFIED) & held & (reason != INSTRUMENTAL)) | (state.isin(*OPEN_STATES) & (reason != "")),
    }
    versions = F.when(complete, F.when(F.map_contains_key(source["provenance"], "game_projection"), F.array(F.lit("full"), F.lit("game"))).otherwise(F.array(F.lit("full")))).when(game_only, F.array(F.lit("game"))).otherwise(F.array().cast("array<string>"))
    return found.select(
        "music_id", state.alias("state"),
        F.when(complete, F.col("documents.revision")).otherwise(F.lit(1)).cast("bigint").alias("revision"),
        F.when(complete, F.col("documents.updated_at")).otherwise(F.col("availability.created_at")).alias("updated_at"),
        *(F.coalesce(f"music.title_{x}", F.lit("")).alias(f"title_{x}") for x in ("ja", "zh", "en")),
        versions.alias("versions"),
        F.when(state == SATISFIED, reason).otherwise("").alias("no_lyrics_reason"),
        F.when(complete, full.cast(PUBLIC)).when(game_only, game.cast(PUBLIC)).alias("lines"),
        F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()))).alias("problems"),
    )


def refusals(records: Mapping[str, DataFrame], batch: str, found: DataFrame) -> DataFrame:
    """(music_id, problem): why the batch is refused; problems of the batch itself have no music_id."""
    own = records["batches"].where(F.col("batch") == batch).agg(F.count("*").alias("n"), F.max("catalog_count").alias("expected"))
    songs_ = records["music"].agg(F.count("*").alias("catalog"))
    items = records["items"].where(F.col("batch") == batch).agg(F.count("*").alias("items"))
    counts = own.crossJoin(songs_).crossJoin(items)  # one row each
    named = F.array_compact(F.array(
        F.when(F.col("n") == 0, F.lit("not_found")), F.when(F.col("n") > 1, F.lit("batch_repeated")),
        F.when((F.col("n") > 0) & ~F.col("catalog").eqNullSafe(F.col("expected")), F.lit("catalog_count")), F.when((F.col("n") > 0) & ~F.col("items").eqNullSafe(F.col("expected")), F.lit("item_count")),
    ))
    whole = counts.select(F.lit(None).cast("bigint").alias("music_id"), F.explode(named).alias("problem"))
    return whole.unionByName(found.select("music_id", F.explode("problems").alias("problem")))


def public(records: Mapping[str, DataFrame], batch: str, parts: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, details, refusals) of a batch; with any refusal, index and details are empty."""
    found = states(records, batch, parts)
    why = refusals(records, batch, found)
    clean = found.crossJoin(F.broadcast(why.agg(F.count("*").alias("__n")))).where("__n = 0")  # one row
    index = clean.select("music_id", "state", "revision", "updated_at", "title_ja", "title_zh", "title_en", "versions", "no_lyrics_reason")
    details = clean.where(F.col("state").isin(*TEXT_STATES)).select("music_id", "state", "revision", "updated_at", "versions", "lines")
    return index, details, why
