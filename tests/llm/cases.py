"""Small tables with the cases that every operator has to bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "Beta", "gamma", "élan", "Ünit", "delta", "omega", "sigma", "kappa", "iota", "zeta", "naïve", "theta", "lambda", "nu"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + r.choice(["", "", "", str(r.randrange(40))]) for _ in range(n)]
    return " ".join(w + ("\n" if r.random() < 0.05 else "") for w in words)


def texts() -> list:
    base = prose(1, 80)
    near = base.replace("alpha", "alpba", 1)
    out = [None, "", " \t\n", "one", "one two", "!?", base, base, base + " ", near, base.upper(), prose(2, 200), prose(3, 200), prose(4, 30000)]
    out += ["x" * 70_000, "\n\n\n", "the line\nthe line\nother", "日本語 テスト 文章 です", "<|endoftext|> inside <|endoftext|>", "tab\tfeed\x0cvt\x0b\r\nend", "don't we'll  I'd   x y　z", "🙂🙂 é ﬁ"]
    return out + [prose(100 + i, 40) for i in range(12)]


def documents(spark, rows=None, extra=False):
    """The cases as documents; extra adds columns whose names operators use themselves."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())] if rows is None else rows
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("id", "key", "score", "predicted", "row", "w", "fingerprint", "content", "spans", "n_lines", "n_dropped", "label", "digest", "at", "__w"):
            df = df.withColumn(name, F.lit("clash"))
    return df
