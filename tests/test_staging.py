"""Staged imports: outcomes, crash, replay, concurrent publishers, damaged parts."""

import pytest

from polyglint.operators import documents, staging

ITEM, CATALOG = "k long, title string, body string", "k long, title string"


def frames(spark, items, catalog):
    return spark.createDataFrame(items, ITEM), spark.createDataFrame(catalog, CATALOG)


def run(store, spark, items, catalog, batch="b1", hook=None, count=None):
    i, c = frames(spark, items, catalog)
    state, found = staging.import_batch(store, batch, "songs", i, c, "k", ["body"], ["title"], len(catalog) if count is None else count, hook)
    return state, {r.k: r.outcome for r in found.collect()} if state != "published" else None


def songs(store, generation=None):
    return sorted(tuple(r) for r in store.read("songs", "k long, body string", generation).collect())


CAT = [(1, "a"), (2, "b"), (3, "c"), (4, None)]


def test_import_and_replay(spark, tmp_path):
    store = staging.Store(spark, str(tmp_path / "s"))
    items = [(1, "a", "x"), (2, "b", None)]
    assert run(store, spark, items, CAT)[0] == "published"
    assert songs(store) == [(1, "x"), (2, None)] and store.manifest()["generation"] == 1
    assert run(store, spark, items, CAT, "b1") == ("replayed", {1: "replayed", 2: "replayed"})
    assert store.manifest()["generation"] == 1
    assert run(store, spark, [*items, (4, None, "z")], CAT, "b2")[0] == "published"
    assert songs(store) == [(1, "x"), (2, None), (4, "z")] and songs(store, 1) == [(1, "x"), (2, None)]
    assert len(store.manifest()["tables"]["songs"]["parts"]) == 2


def test_one_bad_item_refuses_all(spark, tmp_path):
    store = staging.Store(spark, str(tmp_path / "s"))
    run(store, spark, [(1, "a", "x")], CAT)
    bad = [(1, "a", "y"), (2, "B", "q"), (3, "c", "r"), (3, "c", "r"), (9, "a", "n"), (4, None, "w")]
    state, found = run(store, spark, bad, CAT, "b2")
    assert state == "refused" and found == {1: "conflict", 2: "drift", 3: "repeated", 9: "drift", 4: "inserted"}
    assert songs(store) == [(1, "x")] and store.left_over() == []
    assert run(store, spark, [(2, "b", "q")], CAT, count=5)[0] == "catalog_drift"


def test_killed_between_stage_and_publish(spark, tmp_path):
    store = staging.Store(spark, str(tmp_path / "s"))
    run(store, spark, [(1, "a", "x")], CAT)

    def die(staged):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        run(store, spark, [(2, "b", "y")], CAT, "b2", die)
    again = staging.Store(spark, str(tmp_path / "s"))
    assert songs(again) == [(1, "x")] and again.manifest()["generation"] == 1 and len(again.left_over()) == 1
    assert run(again, spark, [(2, "b", "y")], CAT, "b2")[0] == "published"
    assert songs(again) == [(1, "x"), (2, "y")]
    assert again.swept() == 1 and again.left_over() == [] and songs(again) == [(1, "x"), (2, "y")]


def test_two_publishers(spark, tmp_path):
    store = staging.Store(spark, str(tmp_path / "s"))
    other = lambda staged: run(staging.Store(spark, str(tmp_path / "s")), spark, [(2, "b", "first")], CAT, "b2")
    assert run(store, spark, [(1, "a", "second")], CAT, "b1", other)[0] == "stale"
    assert songs(store) == [(2, "first")]
    assert run(store, spark, [(1, "a", "second")], CAT, "b1")[0] == "published"
    assert songs(store) == [(1, "second"), (2, "first")]


def test_damaged_part(spark, tmp_path):
    store = staging.Store(spark, str(tmp_path / "s"))

    def spoil(staged):
        ((_, path, _, _),) = staged.tables.values()
        spark.createDataFrame([(1, "other")], "k long, body string").write.mode("overwrite").parquet(f"{store.root}/{path}")

    assert run(store, spark, [(1, "a", "x")], CAT, hook=spoil)[0] == "damaged"
    assert songs(store) == []


def test_digest_tells_rows_and_their_number(spark):
    make = lambda *rows: staging.digest(spark.createDataFrame(list(rows), "a long, b string"))
    assert make((1, "x"), (2, None)) == make((2, None), (1, "x"))
    assert len({make((1, "x")), make((1, "x"), (1, "x")), make((1, "y")), make((None, "x")), staging.digest(spark.createDataFrame([], "a long, b string"))}) == 5


def test_write_all_and_export(spark, tmp_path):
    store = staging.Store(spark, str(tmp_path / "s"))
    docs = lambda *rows: spark.createDataFrame(list(rows), "path string, body string")
    assert staging.write_all(store, "g1", docs(("translation/cards.json", '{"a":"1"}'), ("translation/events.json", "{}"))) == "published"
    assert staging.write_all(store, "g2", docs(("x.json", "1"), ("x.json", "2"))) == "refused"
    assert staging.write_all(store, "g3", docs(("translation/cards.json", '{"a":"2"}'))) == "published"
    assert [tuple(r) for r in store.read("files").collect()] == [("translation/cards.json", '{"a":"2"}')]
    staging.exported(store, str(tmp_path / "out"))
    back = spark.read.option("wholetext", True).text(str(tmp_path / "out")).collect()
    assert [(r.path, r.value.rstrip("\n")) for r in back] == [("translation/cards.json", '{"a":"2"}')]


def test_every_edit_has_an_outcome(spark):
    current = spark.createDataFrame([(1, "a", 3), (2, "b", 1), (3, "c", 2), (4, None, 1), (9, "z", 5)], "k long, v string, revision long")
    edits = [(1, "A", 3), (2, "B", 7), (3, "C", 2), (3, "D", 2), (4, None, 1), (5, "new", None), (6, "gone", 4), (7, "x", None), (7, "y", None)]
    given = spark.createDataFrame(edits, "k long, v string, revision long")
    docs = {r.k: (r.v, r.revision, r.outcome) for r in documents.saved(current, given, "k", ["v"]).collect()}
    assert docs == {1: ("A", 4, "saved"), 2: ("b", 1, "conflict"), 3: ("c", 2, "repeated"), 4: (None, 1, "unchanged"), 5: ("new", 1, "created"), 9: ("z", 5, "kept")}
    found = sorted((r.k, r.outcome) for r in documents.edit_outcomes(current, given, "k", ["v"]).collect())
    assert found == [(1, "saved"), (2, "conflict"), (3, "repeated"), (3, "repeated"), (4, "unchanged"), (5, "created"), (6, "not_found"), (7, "repeated"), (7, "repeated")]


def test_every_request_has_an_outcome(spark):
    current = spark.createDataFrame([(1, "a", "A", True), (1, "b", "B", False), (2, "a", "A", True), (2, "b", "B", False)], "k long, edition string, title string, is_default boolean")
    asked = [(1, "a", "delete", None), (1, "b", "rename", "BB"), (1, "c", "rename", "x"), (1, "d", "create", "D"), (2, "b", "default", None), (2, "a", "rename", "p"), (2, "a", "rename", "q"), (2, "e", "create", "1"), (2, "e", "create", "2")]
    given = spark.createDataFrame(asked, "k long, edition string, action string, title string")
    found = sorted((r.k, r.edition, r.outcome) for r in documents.edition_outcomes(current, given, "k").collect())
    assert found == [(1, "a", "is_default"), (1, "b", "ok"), (1, "c", "not_found"), (1, "d", "ok"), (2, "a", "repeated"), (2, "a", "repeated"), (2, "b", "ok"), (2, "e", "repeated"), (2, "e", "repeated")]
    rows = sorted(tuple(r) for r in documents.editions(current, given, "k").collect())
    assert rows == [(1, "a", "A", True, "is_default"), (1, "b", "BB", False, "ok"), (1, "d", "D", False, "ok"), (2, "a", "A", False, "repeated"), (2, "b", "B", True, "ok")]
