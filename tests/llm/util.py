"""Small tables with hard cases, for all text operators."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, **extra):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in extra.items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    return df


def hard_texts(seed=1):
    r = random.Random(seed)
    words = ["the", "ré", "ß", "x1", "a,b", "don't", "ÉTÉ", "日本", "𝔘", "é", "K", "_", "##", "I'LL"]
    out = [None, "", " ", "\n\t \x0b", "a", "one two", "a b c", "x" * 3000, "\x1c\x00 z", "<|endoftext|> <|startoftext|>x <|ENDOFTEXT|>"]
    out += [" ".join(r.choice(words) for _ in range(r.randrange(1, 120))) for _ in range(30)]
    out += ["\n".join(r.choice(["same line here", "other", " ", "x y z x y z"]) for _ in range(40)), " ".join(["loop"] * 5000)]
    return out + [out[-1], out[12]]
