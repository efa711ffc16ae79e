"""The public candidate of a recovery batch: seven states, and every refusal."""

import json

from pyspark.sql import functions as F

from polyglint.operators import candidate

SCHEMAS = {
    "batches": "batch string, root string, catalog_count long",
    "music": "music_id long, title_ja string, title_zh string, title_en string",
    "items": "batch string, music_id long, state string, document_sha string, availability_sha string",
    "documents": "music_id long, revision long, updated_at long",
    "lines": "music_id long, line_id string, position long, ja string, zh string, en string, stanza boolean",
    "segments": "music_id long, line_id string, position long, text string, performers array<long>, ruby array<struct<text:string,reading:string>>",
    "sources": "batch string, music_id long, document_sha string, document_json string",
    "availability": "batch string, music_id long, state string, document_sha string, document_json string, created_at long",
    "contributions": "batch string, music_id long, component string, rendition string",
    "performers": "performer_id long, name_ja string, name_zh string, name_en string",
}
OTHERS = ("satisfied_no_lyrics", "ambiguous", "missing", "incomplete", "failed")


def fixture():
    ruby = lambda *parts: [{"text": t, "reading": r} for t, r in parts]
    game = {
        "state": "game_only", "provenance": {"game_text": "g1"}, "performers": [{"id": "p-one", "name": "Miku"}, {"id": "nobody", "name": "Guest"}],
        "lines": [{"id": "l1", "text": "歌う声", "trailing": ["P-One", "everyone"], "segments": [{"text": "歌う", "performers": [], "ruby": ruby(("歌", "うた"), ("う", ""))}, {"text": "声", "performers": ["nobody", "rin"], "ruby": ruby(("声", ""))}]}],
    }
    rows = {
        "batches": [("b", "root", 7), ("old", "root0", 3)],
        "music": [(10 * i, f"曲{i}", "", f"Song {i}") for i in range(1, 8)],
        "items": [("b", 10, "complete", "s10", None), ("b", 20, "game_only", None, "a20"), *(("b", 30 + 10 * i, s, None, f"a{30 + 10 * i}") for i, s in enumerate(OTHERS)), ("old", 10, "failed", None, None)],
        "documents": [(10, 4, 99), (999, 1, 1)],
        "lines": [(10, "x2", 1, "cd", None, "CD", None), (10, "x1", 0, "ab", "AB", None, True)],
        "segments": [(10, "x1", 1, "b", None, ruby(("b", ""))), (10, "x1", 0, "a", [3], ruby(("a", ""))), (10, "x2", 0, "cd", [1], ruby(("c", ""), ("d", "")))],
        "sources": [("b", 10, "s10", json.dumps({"provenance": {"full_text": "r1", "version_evidence": "r2"}})), ("old", 10, "zz", "{}")],
        "availability": [("b", 20, "game_only", "a20", json.dumps(game), 50), *(("b", 30 + 10 * i, s, f"a{30 + 10 * i}", json.dumps({"state": s} | ({"noLyricsReason": "catalog_instrumental"} if i == 0 else {})), 60) for i, s in enumerate(OTHERS))],
        "contributions": [("b", 10, "full_text", "r1"), ("b", 10, "version_evidence", "r2"), ("b", 20, "game_text", "g1"), ("old", 20, "x", "y")],
        "performers": [(1, "ミク", "", "Miku"), (2, "リン", None, "Rin"), (3, "双", "twin", None), (4, "双子", "Twin", None)],
    }
    return rows, game


def frames(spark, rows):
    return {k: spark.createDataFrame([tuple(r) for r in v], SCHEMAS[k]) for k, v in rows.items()}


def refused(spark, rows, batch="b"):
    return {(r.music_id, r.problem) for r in candidate.public(frames(spark, rows), batch)[2].collect()}


def test_seven_states(spark):
    rows, _ = fixture()
    index, details, why = candidate.public(frames(spark, rows), "b")
    assert why.collect() == []
    songs = {r.music_id: r for r in index.collect()}
    assert [songs[10 * i].state for i in range(1, 8)] == ["complete", "game_only", *OTHERS]
    assert (songs[10].revision, songs[10].updated_at, songs[10].versions) == (4, 99, ["full"])
    assert (songs[20].revision, songs[20].updated_at, songs[20].versions) == (1, 50, ["game"])
    assert songs[30].no_lyrics_reason == "catalog_instrumental" and {songs[i].no_lyrics_reason for i in (40, 50, 60, 70)} == {""}
    found = {r.music_id: r.lines for r in details.collect()}
    assert set(found) == {10, 20}
    assert [(x.id, x.ja, x.zh, x.en, x.stanza, [(s.text, s.performers) for s in x.segments]) for x in found[10]] == [("x1", "ab", "AB", "", True, [("a", [3]), ("b", [])]), ("x2", "cd", "", "CD", False, [("cd", [1])])]
    (line,) = found[20]
    assert (line.trailing, [s.performers for s in line.segments], line.ja) == ([1], [[], [2]], "歌う声")


def test_one_exchange(spark):
    rows, _ = fixture()
    data = frames(spark, rows)
    plan = candidate.songs({k: v for k, v in data.items()}, "b")._jdf.queryExecution().executedPlan().toString()
    by_song = [x for x in plan.split("\n") if "Exchange hashpartitioning(music_id" in x and "alias" not in x]
    assert len(by_song) == 1


def change(rows, name, at, **values):
    names = [c.strip().split(" ")[0] for c in SCHEMAS[name].replace("struct<text:string,reading:string>", "x").split(",")]
    row = list(rows[name][at])
    for k, v in values.items():
        row[names.index(k)] = v
    rows[name][at] = tuple(row)


def with_game(rows, game, edit):
    edit(game)
    change(rows, "availability", 0, document_json=json.dumps(game))


EDITS = [
    (lambda r, g: r["items"].pop(6), (70, "not_covered")),
    (lambda r, g: r["items"].append(("b", 80, "failed", None, None)), (80, "not_in_catalog")),
    (lambda r, g: r["items"].append(r["items"][3]), (40, "repeated")),
    (lambda r, g: change(r, "items", 3, state="gone"), (40, "state")),
    (lambda r, g: change(r, "music", 2, title_ja=""), (30, "title")),
    (lambda r, g: change(r, "sources", 0, document_sha="other"), (10, "ownership")),
    (lambda r, g: r["documents"].pop(0), (10, "ownership")),
    (lambda r, g: change(r, "documents", 0, revision=0), (10, "header")),
    (lambda r, g: r["contributions"].pop(2), (20, "contributions")),
    (lambda r, g: r["contributions"].append(("b", 10, "ruby", "r9")), (10, "contributions")),
    (lambda r, g: r["contributions"].append(r["contributions"][0]), (10, "contributions")),
    (lambda r, g: change(r, "lines", 0, position=2), (10, "lines")),
    (lambda r, g: r["lines"].append(r["lines"][0]), (10, "lines")),
    (lambda r, g: change(r, "segments", 0, text="c"), (10, "lines")),
    (lambda r, g: r["segments"].append((10, "x9", 0, "q", None, None)), (10, "lines")),
    (lambda r, g: with_game(r, g, lambda d: d["lines"][0]["segments"][0]["ruby"].pop()), (20, "lines")),
    (lambda r, g: with_game(r, g, lambda d: d["lines"].clear()), (20, "lines")),
    (lambda r, g: with_game(r, g, lambda d: d["lines"][0]["trailing"].append("twin")), (20, "performers")),
    (lambda r, g: with_game(r, g, lambda d: d["performers"].append({"id": "again", "name": "ミク"})), (20, "performers")),
    (lambda r, g: with_game(r, g, lambda d: d.update(state="failed")), (20, "ownership")),
    (lambda r, g: change(r, "availability", 3, state="failed"), (50, "availability")),
    (lambda r, g: change(r, "availability", 3, document_json="{broken"), (50, "availability")),
    (lambda r, g: r["availability"].pop(5), (70, "availability")),
    (lambda r, g: change(r, "availability", 1, document_json='{"state":"satisfied_no_lyrics"}'), (30, "reason")),
    (lambda r, g: change(r, "availability", 2, document_json='{"state":"ambiguous","noLyricsReason":"catalog_instrumental"}'), (40, "reason")),
]


def shifted(rows, by):
    at = {k: [c.strip().split(" ")[0] for c in SCHEMAS[k].split("array<struct")[0].split(",")].index("music_id") for k in rows if "music_id" in SCHEMAS[k]}
    return {k: [(*r[: at[k]], r[at[k]] + by, *r[at[k] + 1 :]) for r in v] if k in at else v for k, v in rows.items()}


def test_refusals_of_songs(spark):
    """Every edit in songs of its own, all in one batch: each song's fault is found, and no other song has one."""
    every = {k: [] for k in SCHEMAS}
    for v, (edit, _) in enumerate(EDITS):
        rows, game = fixture()
        edit(rows, game)
        for k, more in shifted(rows, 1000 * v).items():
            every[k] += more
    every["batches"], every["performers"] = [("b", "root", 7 * len(EDITS))], fixture()[0]["performers"]
    found = refused(spark, every)
    assert {(1000 * v + k, problem) for v, (_, (k, problem)) in enumerate(EDITS)} <= found
    assert {k for k, _ in found if k is not None} == {1000 * v + k for v, (_, (k, _)) in enumerate(EDITS)}
    assert (None, "item_count") in found or len(every["items"]) == 7 * len(EDITS)


def test_refusals_of_the_batch(spark):
    rows, _ = fixture()
    rows["batches"].append(("b", "root", 8))
    assert {(None, "batch_repeated"), (None, "catalog_count"), (None, "item_count")} == refused(spark, rows)


def test_unknown_batch_and_refused_means_nothing(spark):
    rows, _ = fixture()
    assert (None, "not_found") in refused(spark, rows, "f" * 64)
    change(rows, "documents", 0, revision=0)
    index, details, why = candidate.public(frames(spark, rows), "b")
    assert index.count() == details.count() == 0 and why.count() == 1


def test_empty_sets(spark):
    rows, _ = fixture()
    rows = {k: [] for k in rows} | {"batches": [("b", "r", 0)]}
    index, details, why = candidate.public(frames(spark, rows), "b")
    assert index.collect() == details.collect() == why.select(F.col("problem")).collect() == []


def test_tasks_grow_with_the_segments(spark, monkeypatch):
    """More rows go to more tasks, so that what one task sorts stays as it is."""
    from polyglint.plans import recovering
    from polyglint.plans.relations import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(recovering, "ROWS_A_TASK", 500)
    parts = recovering.recovered_parts(t)
    assert parts == -(-t.lineitem.count() // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = candidate.states(recovering.recovered(t), "b", parts)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
