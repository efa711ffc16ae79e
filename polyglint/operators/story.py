"""Stories: scenarios to segments, coverage, localised details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import segment_id, text_hash


def segments(lines: DataFrame, event: str, episode: str, scenario: str, position: str, body: str, speaker: str, title: str) -> DataFrame:
    """Text identities of episodes: the title at -1, a line's body at twice its position, its trimmed
    speaker one after it. Empty texts have none."""
    i = F.col(position).cast("bigint")
    each = F.array(F.struct(F.lit("body").alias("kind"), (i * 2).alias("position"), F.col(body).alias("text")), F.struct(F.lit("speaker").alias("kind"), (i * 2 + 1).alias("position"), F.trim(speaker).alias("text")))
    talk = lines.select(event, episode, scenario, F.explode(each).alias("s")).select(event, episode, scenario, "s.*")
    heads = lines.groupBy(event, episode, scenario).agg(F.min(title).alias("text")).select(event, episode, scenario, F.lit("title").alias("kind"), F.lit(-1).cast("bigint").alias("position"), "text")
    all_ = talk.unionByName(heads).where("text <> ''")
    return all_.withColumn("segment_id", segment_id(F.col(event), F.col(episode), F.col(scenario), F.col("kind"), F.col("position"))).withColumn("source_hash", text_hash(F.col("text")))


def coverage(canonical: DataFrame, stored: DataFrame, keys: Sequence[str], attributes: Sequence[str], group: Sequence[str]) -> DataFrame:
    """For each group whether every canonical segment is stored with equal attributes."""
    right = stored.select(*keys, *(F.col(a).alias(f"__{a}") for a in attributes), F.lit(True).alias("__m"))
    joined = canonical.join(right, list(keys), "left")
    equal = F.coalesce("__m", F.lit(False))
    for a in attributes:
        equal = equal & F.col(a).eqNullSafe(F.col(f"__{a}"))
    return joined.groupBy(*group).agg(F.count("*").alias("expected"), F.count_if(equal).alias("covered")).withColumn("complete", F.col("expected") == F.col("covered"))


SCENARIO = (
    "ScenarioId string, Snippets array<struct<Action:int,ReferenceIndex:int>>, TalkData array<struct<WindowDisplayName:string,Body:string,Voices:array<struct<VoiceId:string,Volume:double,Character2dId:int>>,WhenFinishCloseWindow:int>>, "
    "SpecialEffectData array<struct<EffectType:int,StringVal:string>>, AppearCharacters array<struct<Character2dId:int,CostumeType:string>>"
)


def decoded(documents: DataFrame, json: str = "json") -> DataFrame:
    return documents.withColumn("scenario", F.from_json(json, SCENARIO))


def talks(documents: DataFrame, keys: Sequence[str], effects: Sequence[int] = (8, 18, 23)) -> DataFrame:
    """Decoded scenarios flattened to (keys, ord, kind, speaker, body): dialogue of action 1, effect
    texts of action 6 and some types, and a separator after a talk that closes its window (none at the
    end). References out of range are skipped."""
    s = F.col("scenario")
    each = documents.select(*keys, s.alias("s"), F.posexplode("scenario.Snippets").alias("i", "x"))
    talk, effect = F.get(F.col("s.TalkData"), F.col("x.ReferenceIndex")), F.get(F.col("s.SpecialEffectData"), F.col("x.ReferenceIndex"))
    row = lambda kind, speaker, body, sub: F.struct(F.lit(sub).alias("sub"), F.lit(kind).alias("kind"), speaker.alias("speaker"), body.alias("body"))
    none = F.lit("").cast("string")
    said = F.when(talk.isNotNull(), F.when(talk["WhenFinishCloseWindow"] == 1, F.array(row("talk", F.split(talk["WindowDisplayName"], "_", 2)[0], talk["Body"], 0), row("separator", none, none, 1))).otherwise(F.array(row("talk", F.split(talk["WindowDisplayName"], "_", 2)[0], talk["Body"], 0))))
    shown = F.when(effect["EffectType"].isin(*effects), F.array(row("effect", none, effect["StringVal"], 0)))
    made = each.select(*keys, "i", F.explode(F.when(F.col("x.Action") == 1, said).when(F.col("x.Action") == 6, shown)).alias("r"))
    w = Window.partitionBy(*keys).orderBy("i", "r.sub")
    out = made.select(*keys, (F.row_number().over(w) - 1).cast("bigint").alias("ord"), "r.kind", "r.speaker", "r.body")
    last = F.max("ord").over(Window.partitionBy(*keys))
    return out.withColumn("__l", last).where("not (kind = 'separator' and ord = __l)").drop("__l")


def model_characters(documents: DataFrame, keys: Sequence[str], costumes: DataFrame) -> DataFrame:
    """First costume of each model in a scenario and the character its code stands for."""
    each = documents.select(*keys, F.posexplode("scenario.AppearCharacters").alias("i", "c"))
    first = each.groupBy(*keys, F.col("c.Character2dId").alias("model")).agg(F.min_by("c.CostumeType", "i").alias("costume"))
    code = first.withColumn("code", F.regexp_extract("costume", r"(?:^|_)\d{2}([a-z]+)", 1))
    return code.join(F.broadcast(costumes), "code", "left")


def ordered_detail(lines: DataFrame, event: str, episode: str, position: str, values: Sequence[str]) -> DataFrame:
    """One row for each event: episodes with their lines, both in order."""
    by_episode = lines.groupBy(event, episode).agg(F.array_sort(F.collect_list(F.struct(position, *values))).alias("lines"))
    return by_episode.groupBy(event).agg(F.array_sort(F.collect_list(F.struct(episode, "lines"))).alias("episodes"))


def localized_text(locale: str, source_text: Column, overlay: Column, legacy: Column, base: str = "ja-JP", main: str = "zh-CN") -> Column:
    """The source in the base language, else the overlay, else (main language) the legacy text, else ''."""
    if locale == base:
        return source_text
    filled = F.nullif(overlay, F.lit(""))
    return F.coalesce(filled, F.nullif(legacy, F.lit("")), F.lit("")) if locale == main else F.coalesce(filled, F.lit(""))


def locale_detail(segs: DataFrame, localizations: DataFrame, lines: DataFrame, locale: str) -> DataFrame:
    """Segments with their localised texts; an episode without any segment falls back to its lines."""
    own = localizations.where(F.col("locale") == locale).select("segment_id", F.col("text").alias("__t"))
    a = segs.join(own, "segment_id", "left").select("event_id", "episode", "position", F.col("text").alias("source_text"), localized_text(locale, F.col("text"), F.col("__t"), F.lit("")).alias("text"))
    missing = lines.join(segs.select("event_id", "episode").distinct(), ["event_id", "episode"], "left_anti")
    b = missing.select("event_id", "episode", F.col("position").cast("bigint").alias("position"), "source_text", localized_text(locale, F.col("source_text"), F.lit(None).cast("string"), F.col("legacy_text")).alias("text"))
    return a.unionByName(b)


def untranslated_targets(segs: DataFrame, localizations: DataFrame, locale: str) -> DataFrame:
    """Distinct untranslated texts of an event in stored order, with all segments that share each."""
    own = localizations.where((F.col("locale") == locale) & (F.col("text") != "")).select("segment_id")
    open_ = segs.join(own, "segment_id", "left_anti")
    return open_.groupBy("event_id", "text").agg(F.min(F.struct("episode", "position")).alias("first"), F.array_sort(F.collect_list("segment_id")).alias("segments"))


def missing_scenarios(episodes: DataFrame, scenarios: DataFrame, complete: DataFrame) -> DataFrame:
    """Episodes whose scenario is absent, whose stored digest is wrong, or whose coverage is incomplete."""
    keys = ["event_id", "episode"]
    s = scenarios.select(*keys, (F.sha2(F.col("json").cast("binary"), 256) == F.col("sha256")).alias("__ok"))
    c = complete.select(*keys, "complete")
    joined = episodes.join(s, keys, "left").join(c, keys, "left")
    reason = F.when(F.col("__ok").isNull(), "absent").when(~F.col("__ok"), "digest").when(~F.coalesce("complete", F.lit(False)), "coverage")
    return joined.select(*keys, reason.alias("reason")).where("reason is not null")


def violations(lines: DataFrame, key: str, performers: Sequence[int]) -> DataFrame:
    """Problems of lyric documents (key, lines array of struct<order, text, segments array of
    struct<text, performers>>): order, segments that don't make up the line, unknown performers."""
    each = lines.select(key, F.posexplode("lines").alias("i", "l"))
    known = F.array(*map(F.lit, performers))
    problem = F.array_compact(
        F.array(
            F.when(F.col("l.order") != F.col("i"), "order"),
            F.when(F.array_join(F.transform("l.segments", lambda s: s["text"]), "") != F.col("l.text"), "segments"),
            F.when(F.exists("l.segments", lambda s: F.size(F.array_except(s["performers"], known)) > 0), "performer"),
            F.when(F.size("l.segments") == 0, "empty"),
        )
    )
    return each.select(key, F.col("i").cast("bigint").alias("position"), F.explode(problem).alias("problem"))


def kept_ruby(saved: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ruby of the current version where a saved line omits it and its text is unchanged."""
    c = current.select(*keys, F.col("text").alias("__t"), F.col("ruby").alias("__r"))
    joined = saved.join(c, list(keys), "left")
    return joined.select(*keys, "text", F.coalesce("ruby", F.when(F.col("text") == F.col("__t"), F.col("__r"))).alias("ruby"))


def projected_lines(game: Column, full: Column) -> Column:
    """Full-version lines for the indices of a game version's lines."""
    return F.transform(game, lambda i: F.get(full, i))


def components(documents: DataFrame, key: str, named: dict[str, str]) -> DataFrame:
    """(key, rank, component) for each component column that is filled, ranked by its place."""
    parts = F.array(*(F.struct(F.lit(i).cast("bigint").alias("rank"), F.lit(n).alias("component"), F.col(c).alias("value")) for i, (n, c) in enumerate(named.items())))
    return documents.select(key, F.explode(F.filter(parts, lambda x: x["value"].isNotNull() & (x["value"] != ""))).alias("p")).select(key, "p.*")
