import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyglint.llm import bpe, tokencount
from polyglint.llm.queries import tokenizer_path

from .cases import documents, texts

tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS, PIECES = (tokenizer_path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def test_encoding_and_decoding_match_the_library(spark):
    model = tokenizers.Tokenizer.from_file(BYTES)
    rows = bpe.encode(documents(spark, extra=True), BYTES).collect()
    assert len(rows) == len(texts())
    for r in rows:
        ids = model.encode(texts()[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == model.decode(ids, skip_special_tokens=False) == (texts()[r.doc_id] or "")


def test_digests(spark):
    for r, e in zip(bpe.digests(documents(spark), BYTES).orderBy("doc_id").collect(), bpe.encode(documents(spark), BYTES).orderBy("doc_id").collect()):
        assert r.ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(e.decoded.encode()).hexdigest()


def test_index_merges_in_rank_order():
    coder = bpe.load(BYTES)
    model = tokenizers.Tokenizer.from_file(BYTES)
    words = ["aaaa", "aaaaaaa", "abababab", "mississippi", "antidisestablishmentarianism", "ing" * 50]
    assert [x.tolist() for x in coder.merge([w.encode() for w in words])] == [model.encode(w).ids for w in words]
    assert coder.merge([]) == []


def test_empty_table_and_repeated_rows(spark):
    assert bpe.encode(documents(spark, []), BYTES).count() == 0
    twice = documents(spark, [(1, "a b", "", "", 3)] * 2 + [(None, None, None, None, None)])
    assert sorted(r.n_tokens for r in bpe.digests(twice, BYTES).collect()) == [0, 2, 2]
    assert tokencount.token_counts(documents(spark, []), WORDS).count() == 0
    assert sorted(r.n_tokens for r in tokencount.token_counts(twice, WORDS).collect()) == [0, 2, 2]


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_counts_match_the_library(spark, path):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = tokenizers.Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    for r in tokencount.token_counts(documents(spark, extra=True), path, limit=100).collect():
        t = texts()[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), count(t), count(t) > 100)


def test_cache_is_used_and_appended_to(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    docs = documents(spark)
    first = tokencount.token_counts(docs, WORDS, cache).collect()
    stored = tokencount.stored(spark, cache)
    n = stored.count()
    assert n == stored.select("digest").distinct().count() < docs.count()
    # A stored count is believed: nothing is encoded again.
    changed = str(tmp_path / "changed")
    stored.withColumn("n_tokens", F.col("n_tokens") + 1000).write.parquet(changed)
    again = tokencount.token_counts(docs, WORDS, changed).collect()
    assert sorted((r.doc_id, r.n_tokens + 1000) for r in first) == sorted((r.doc_id, r.n_tokens) for r in again)
    assert tokencount.stored(spark, changed).count() == n
    # More texts: only their contents are added. The shuffle join gives the same.
    monkeypatch.setattr(tokencount, "BROADCAST_ROWS", 0)
    more = docs.unionByName(documents(spark, [(900, "entirely new", "", "", 0), (901, "entirely  new ", "", "", 0)]))
    third = {r.doc_id: r.n_tokens for r in tokencount.token_counts(more, WORDS, cache).collect()}
    assert third[900] == third[901] and tokencount.stored(spark, cache).count() == n + 1
    # Another tokenizer doesn't see those counts.
    assert {r.n_tokens for r in tokencount.token_counts(docs, BYTES, changed).collect()}.isdisjoint({r.n_tokens for r in again})


def test_a_second_run_of_the_query_encodes_nothing(spark, tmp_path):
    from polyglint.llm.queries import op4_token_counts

    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    cache = tokencount.default_cache(spark, tokencount.version_of(WORDS))
    first = sorted(map(tuple, op4_token_counts(spark, str(tmp_path)).collect()), key=str)
    n = tokencount.stored(spark, cache).count()
    again = sorted(map(tuple, op4_token_counts(spark, str(tmp_path)).collect()), key=str)
    assert first == again and n > 0 and tokencount.stored(spark, cache).count() == n


def test_other_kinds_of_tokenizer_files_are_refused(tmp_path):
    import json

    from polyglint.llm.queries import tokenizer_path

    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        data = json.load(f)
    bpe.check_supported(data)
    for part, key, value in (("pre_tokenizer", "add_prefix_space", True), ("pre_tokenizer", "type", "Whitespace"), ("model", "end_of_word_suffix", "</w>"), ("model", "type", "Unigram")):
        with pytest.raises(ValueError):
            bpe.check_supported(data | {part: data[part] | {key: value}})
