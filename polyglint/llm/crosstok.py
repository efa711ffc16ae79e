"""Alignment of two tokenizers' tokens of the same bytes.

Texts of an Arrow batch lie one after another on one axis of bytes; two tables hold the token
intervals of both tokenizers there. DuckDB, in the task, finds the offsets where both end (the
groups), numbers them by a window sum, gives the first tokenizer's tokens their group by that sum and
the second's by an ASOF join, counts a text's groups by a range join with what ends inside one, and joins the tokens of a group
to links. Each batch's counts of documents by id pair are merged in Spark; a second pass over the
written links weighs them with the merged counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import PATTERN, ByteBPE
from .common import by_size, strings, written

#: Id pairs that are broadcast, at most; links of rarer ones are weighed by a join.
BROADCAST_PAIRS = 2_000_000
#: Runs longer than this are left to the tokenizers library (the other one recurses on them).
LONG_RUN = regex.compile(r"\s{2000}")
COUNTED = ("n_a", "n_b", "n_groups", "n_links")


class First:
    """Byte-level BPE of a text with a space before it, special strings being plain text."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        known = ByteBPE(path)  # refuses files of another kind
        self.bytes = known.bytes
        self.lossless = min(known.first) >= 0  # with a token for every byte, ids give back any text
        ranks = {b: i for i, b in enumerate(known.bytes) if i not in set(known.special.values())}
        # Ids that ascend with the merges serve as ranks; else the library encodes alone.
        ascending = known.made == sorted(known.made) and min(known.made) > max(known.first) and len(set(known.made)) == len(known.made)
        self.fast = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ascending else None

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        made.no_truncation()
        made.no_padding()
        return made

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            if self.fast is None or LONG_RUN.search(t):
                out.append(self.library.encode(" " + t, add_special_tokens=False).ids)
            else:
                out.append(self.fast.encode_ordinary(" " + t))
        return out


class Second:
    """A sentencepiece model, which puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


@lru_cache(2)
def first(path: str) -> First:
    return First(path)


@lru_cache(2)
def second(path: str) -> Second:
    return Second(path)


def intervals(kept: list[int], ids: list[list[int]], size: np.ndarray) -> pa.Table:
    """One row per token: its text, its place among all tokens, its id, where its bytes end."""
    flat = np.concatenate([np.array(x, dtype=np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
    of = np.repeat(np.array(kept, dtype=np.int32), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
    return pa.table({"doc": of, "pos": np.arange(len(flat), dtype=np.int32), "id": flat, "stop": np.cumsum(size[flat], dtype=np.int64)})


#: A's tokens with the number of their group, counted from 0, by a running sum over them in order.
SUMMED = """CREATE OR REPLACE TEMP TABLE ag AS SELECT doc, pos, id, stop, cut, (sum(cut::INT) OVER (ROWS UNBOUNDED PRECEDING))::INT - cut::INT AS g
FROM (SELECT doc, pos, id, stop, stop IN (SELECT stop FROM b) AS cut FROM a{order})"""
#: The groups' ends, and B's tokens with the number of the first group that ends no earlier.
GROUPS = (
    "CREATE OR REPLACE TEMP TABLE groups AS SELECT stop, g FROM ag WHERE cut",
    "CREATE OR REPLACE TEMP TABLE bg AS SELECT b.pos, b.id, groups.g FROM b ASOF JOIN groups ON b.stop <= groups.stop",
)
#: Tokens of A that end inside a group, by text: A's others end one group each. The range join with the
#: texts is an ASOF join, as texts follow each other (an inequality join took eight times as long).
INNER = "SELECT t.doc, count(*) AS n FROM (SELECT stop FROM ag WHERE NOT cut) s ASOF JOIN texts t ON s.stop <= t.high GROUP BY t.doc"
#: Links by text and id pair: of the tokens of a group, or, where groups are wide, of its ids and how often each occurs.
LINKS = "CREATE OR REPLACE TEMP TABLE links AS SELECT ag.doc, ag.id::BIGINT * {width} + bg.id AS pair, count(*) AS n FROM ag JOIN bg USING (g) GROUP BY ALL"
WIDE_LINKS = """CREATE OR REPLACE TEMP TABLE links AS SELECT x.doc, x.id::BIGINT * {width} + y.id AS pair, sum(x.n * y.n)::BIGINT AS n
FROM (SELECT doc, g, id, count(*) AS n FROM ag GROUP BY ALL) x JOIN (SELECT g, id, count(*) AS n FROM bg GROUP BY ALL) y USING (g) GROUP BY ALL"""


def aligned_texts(texts: list[str], a: First, b: Second, db: duckdb.DuckDBPyConnection) -> dict:
    """n_a, n_b, n_groups, n_links and groups by text; links sorted by text and pair; documents by pair."""
    n = len(texts)
    zero = np.zeros(n, dtype=np.int64)
    out = {c: zero.copy() for c in COUNTED} | {"groups": [""] * n}
    asked = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = a.encode([texts[i] for i in asked]), b.encode([texts[i] for i in asked])
    whole = [(" " + texts[i]).encode() for i in asked]
    same = [(a.lossless or b"".join(map(a.bytes.__getitem__, x)) == w) and b"".join(map(b.bytes.__getitem__, y)) == w for x, y, w in zip(ids_a, ids_b, whole)]
    kept = [i for i, ok in zip(asked, same) if ok]
    if not kept:
        return out | {"doc": zero[:0], "pair": zero[:0], "n": zero[:0], "pairs": zero[:0], "docs": zero[:0]}
    ids_a, ids_b = ([x for x, ok in zip(ids, same) if ok] for ids in (ids_a, ids_b))
    high = np.cumsum([len(w) for w, ok in zip(whole, same) if ok])
    ta = intervals(kept, ids_a, np.fromiter(map(len, a.bytes), dtype=np.int64))
    tb = intervals(kept, ids_b, np.fromiter(map(len, b.bytes), dtype=np.int64))
    tables = {"a": ta, "b": tb, "texts": pa.table({"doc": np.array(kept, dtype=np.int32), "low": np.concatenate([[0], high[:-1]]), "high": high})}
    for name, t in tables.items():
        db.register(name, t)
    for order in ("", " ORDER BY pos"):  # one thread keeps the order of what it scans; where it did not, sort
        db.execute(SUMMED.format(order=order))
        found = db.execute("SELECT pos, g, cut FROM ag").fetchnumpy()
        if np.array_equal(found["pos"], np.arange(len(ta))):
            break
    for sql in GROUPS:
        db.execute(sql)
    ga, cut = found["g"].astype(np.int64), found["cut"].astype(bool)
    found = db.execute("SELECT pos, g FROM bg").fetchnumpy()
    gb = np.zeros(len(tb), dtype=np.int64)
    gb[found["pos"]] = found["g"]
    wide = int((np.bincount(ga) * np.bincount(gb)).sum()) > 4 * (len(ga) + len(gb))
    db.execute((WIDE_LINKS if wide else LINKS).format(width=len(b.bytes)))
    links = db.execute("SELECT doc, pair, n FROM links ORDER BY doc, pair").fetchnumpy()
    counts = db.execute("SELECT pair, count(*) AS n FROM links GROUP BY pair ORDER BY pair").fetchnumpy()
    inner = db.execute(INNER).fetchnumpy()
    for name in tables:
        db.unregister(name)
    out["n_a"][kept], out["n_b"][kept] = [len(x) for x in ids_a], [len(x) for x in ids_b]
    out["n_groups"] = out["n_a"].copy()
    out["n_groups"][inner["doc"]] -= inner["n"]
    out["n_links"] = np.bincount(links["doc"], weights=links["n"], minlength=n).astype(np.int64)
    for i, text in zip(kept, printed_groups(ta["id"].to_numpy(), ga, cut, tb["id"].to_numpy(), gb, out["n_a"][kept] + out["n_b"][kept], len(a.bytes), len(b.bytes))):
        out["groups"][i] = text
    return out | {"doc": links["doc"], "pair": links["pair"], "n": links["n"], "pairs": counts["pair"], "docs": counts["n"]}


@lru_cache(2)
def _words(size_a: int, size_b: int) -> list[str]:
    return [f"{i}{c}" for c, size in ((",", size_a), ("|", size_a), (",", size_b), (";", size_b)) for i in range(size)]


def printed_groups(ids_a, ga, cut, ids_b, gb, tokens, size_a: int, size_b: int) -> Iterator[str]:
    """`a1,a2|b1;a3|b2,b3` for each text, of which tokens says how many both sides have."""
    n = int(ga[-1]) + 1
    before_a, before_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n))]) for g in (ga, gb))
    code = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    code[np.arange(len(ids_a)) + before_b[ga]] = ids_a + np.where(cut, size_a, 0)
    last = np.append(gb[1:] != gb[:-1], True)
    code[np.arange(len(ids_b)) + before_a[gb + 1]] = ids_b + 2 * size_a + np.where(last, size_b, 0)
    word, at = _words(size_a, size_b).__getitem__, 0
    for k in tokens.tolist():
        yield "".join(map(word, code[at : at + k].tolist()))[:-1]
        at += k


def links(docs: DataFrame, path_a: str, path_b: str, shown: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> a written table: for each row of docs (row, doc_id, COUNTED, groups, pairs, times), and for
    each slice of texts a row without `row`, whose pairs and times are partial counts of documents.

    A pair is A id * size of B + B id; pairs ascend in a row. shown, if given, is applied to groups before
    it is written (it is several times as long as the text)."""
    of = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ints, longs = pa.int64(), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = first(path_a), second(path_b)
        db = duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True})
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in by_size(batch, 1):
                r, n = aligned_texts(strings(part.column(1)), a, b, db), part.num_rows
                bounds = np.append(np.searchsorted(r["doc"], np.arange(n + 1)), len(r["pair"]) + len(r["pairs"])).astype(np.int32)
                both = lambda x, y: pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([r[x], r[y]]).astype(np.int64)))  # noqa: B023, E731
                made = {
                    "row": pa.array([*range(row, row + n), None], type=ints),
                    "doc_id": pa.concat_arrays([part.column(0), pa.nulls(1, part.column(0).type)]),
                    **{c: pa.array(np.append(r[c], 0), type=ints) for c in COUNTED},
                    "groups": pa.array([*r["groups"], None], type=pa.string()),
                    "pairs": both("pair", "pairs").cast(longs),
                    "times": both("n", "docs").cast(longs),
                }
                row += n
                yield pa.RecordBatch.from_pydict(made)
        db.close()

    kind = of.schema["doc_id"].dataType.simpleString()
    made = of.mapInArrow(run, f"row long, doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTED) + ", groups string, pairs array<long>, times array<long>")
    return written(made.withColumn("groups", shown(F.col("groups"))) if shown else made, "token-links")


def pair_counts(linked: DataFrame, width: int) -> DataFrame:
    """(pair, docs, best): how many documents hold an id pair linked, and whether no pair of its A id is in more.

    An A id has at most `width` pairs, B's vocabulary, so that its window is bounded."""
    partial = linked.where("row is null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = partial.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("docs"))
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy(F.floor(F.col("pair") / width))))


def align(docs: DataFrame, path_a: str, path_b: str, shown: Callable[[Column], Column] | None = None, broadcast: int = BROADCAST_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row for each row of docs.

    groups is `a1,a2|b1;a3|b2,b3`, the ids of both tokenizers in order. n_best counts links whose id pair is
    linked in as many documents as any pair of its A id (ties included), count_sum sums those numbers over
    links. Null and empty texts, and texts whose bytes a tokenizer doesn't give back, have no tokens. Repeated
    rows count as so many documents; a text is held whole in a task, however long; other columns are not read.
    Pairs in more documents than a threshold, `broadcast` of them at most, go to the tasks as sorted arrays;
    links of the others are joined with their counts.
    """
    spark = docs.sparkSession
    linked = links(docs, path_a, path_b, shown, id_col, text_col)
    counts = written(pair_counts(linked, len(second(path_b).bytes)), "token-pairs")
    total, least = counts.count(), 0
    if total > broadcast:
        least = int(counts.agg(F.percentile_approx("docs", 1 - broadcast / total, 10_000)).first()[0])
    top = counts.where(F.col("docs") > least).select("pair", "docs", "best").toArrow()
    order = np.argsort(top["pair"].to_numpy())
    known = spark.sparkContext.broadcast([top[c].to_numpy()[order] for c in ("pair", "docs", "best")])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs_of, best = known.value
        for batch in batches:
            n = batch.num_rows
            keys, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            of = np.repeat(np.arange(n), batch.column("pairs").value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pair, keys), max(0, len(pair) - 1))
            hit = pair[at] == keys if len(pair) else np.zeros(len(keys), dtype=bool)
            best_sum, count_sum = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            np.add.at(best_sum, of[hit], times[hit] * best[at[hit]])
            np.add.at(count_sum, of[hit], times[hit] * docs_of[at[hit]])
            left = np.concatenate([[0], np.cumsum(np.bincount(of[~hit], minlength=n))]).astype(np.int32)
            rest = {c: pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit], type=pa.int64())) for c, x in (("pairs", keys), ("times", times))}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | rest | {"n_best": pa.array(best_sum), "count_sum": pa.array(count_sum)})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in linked.schema) + ", n_best long, count_sum long"
    weighed = linked.where("row is not null").mapInArrow(weigh, schema)
    if least:
        rare = weighed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
        rare = rare.join(counts.where(F.col("docs") <= least), "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("best").cast("long")).alias("b"), F.sum(F.col("n") * F.col("docs")).alias("c"))
        added = [(F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x) for x, y in (("n_best", "b"), ("count_sum", "c"))]
        weighed = weighed.drop("pairs", "times").join(rare, "row", "left").select("doc_id", *COUNTED, *added, "groups")
    return weighed.select("doc_id", *COUNTED, "n_best", "count_sum", "groups")
