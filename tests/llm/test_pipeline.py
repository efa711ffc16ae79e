import random

import corpus_pipeline
from polyglint.llm import queries

from .cases import WORDS, documents, prose

SPARED = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, folder):
    """Tables with toxic texts, shared lines, copies, near copies and benchmark passages."""
    r = random.Random(8)
    rows = []
    for i in range(240):
        words = prose(3000 + i, 60).split()
        if i % 4 == 0:
            words[7:7] = r.sample(["blasted", "rotten", "vile"], 2)
        rows.append(" ".join(words[:30]) + "\n" + " ".join(words[30:]))
    labels = [(i, 1, int(i % 4 == 0)) for i in range(240)]
    clean = rows[1]
    item = prose(77, 20)
    near = clean.split()
    near[20] = "changed"
    louder = "".join(c.upper() if "a" <= c <= "z" else c for c in item)  # other letters keep their case by the contract
    more = [clean, " ".join(near), prose(5000, 20) + " " + louder + " " + prose(5001, 20), None, ""]
    more += [f"A line that all of them share\n{prose(6000 + i, 40)}" for i in range(12)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows + more)]
    documents(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_each_stage_and_the_whole(spark, tmp_path):
    folder = str(tmp_path)
    rows = tables(spark, folder)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "bpe":
            assert docs.columns == SPARED
        kept[name] = {r.doc_id: r for r in docs.collect()}
    toxic = [i for i in range(0, 240, 4)]
    assert sum(i in kept["toxicity"] for i in toxic) <= 3
    assert sum(i not in kept["toxicity"] for i in range(240) if i % 4) <= 3
    shared = [i for i, r in kept["line_dedup"].items() if "that all of them share" in (r.text or "")]
    assert shared == [245] and kept["line_dedup"][246].n_chars == len(kept["line_dedup"][246].text)
    assert kept["line_dedup"].keys() == kept["toxicity"].keys()
    assert 240 in kept["line_dedup"] and 240 not in kept["simhash_near_dedup"] and 1 in kept["simhash_near_dedup"]
    assert 242 in kept["simhash_near_dedup"] and 242 not in kept["decontamination"]
    assert kept["decontamination"].keys() == kept["simhash_near_dedup"].keys() - {242}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in kept["bpe"].values())
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in whole) == sorted(kept["bpe"])
    assert rows


def test_stages_bear_odd_rows_and_extra_columns(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = documents(spark, extra=True)
    odd = docs.unionByName(docs.limit(3)).unionByName(documents(spark, [(None, None, None, None, None), (None, "x y", None, None, 3)], extra=True))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, folder).count() == odd.count()


def test_passages_of_two_documents_stay_in_the_first_alone(spark):
    passage, short = " ".join(f"word{i}" for i in range(60)), "a line of a few words"
    docs = documents(spark, [(i, f"{passage}\nown text {i}\n{short}" if i < 2 else f"other {i}", "en", "s", 0) for i in range(4)])
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got[0].startswith(passage) and got[1] == f"own text 1\n{short}" and got[2] == "other 2"


def test_near_dedup_of_repeated_ids_drops_only_copies(spark):
    one, two, three = (prose(9000 + i, 60) for i in range(3))
    rows = [(1, one), (5, one), (5, two), (5, three), (5, three), (7, two + " "), (None, one)]
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, one), (5, two), (5, three), (0, one)])


def test_all_queries_are_registered():
    names = queries.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names) and len(WORDS) > 5
