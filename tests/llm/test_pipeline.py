"""The pipeline, stage by stage, against plain versions."""

import pytest

pytest.importorskip("blockweave.llm")
import corpus_pipeline as pipeline
from blockweave.llm import decontaminate, lines, pieces, quality
from blockweave.llm.queries import tokenizer_path

from test_counts import plain_contamination, plain_words
from test_links import plain_near
from util import docs


def plain_lines(rows, t=2, least=30):
    """As the plain dedup of test_lines, with the tested banded distance."""
    entries = [(doc, i, x.strip(lines.BLANK)) for doc, text in rows for i, x in enumerate((text or "").split("\n"))]
    entries = [e for e in entries if e[2]]
    kinds, up = sorted({x for _, _, x in entries}, key=len), {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if len(b) - len(a) > t:
                break
            if len(a) >= least and lines.within(a, b, t):
                up[find(a)] = find(b)
    first = {}
    for doc, i, x in sorted(entries):
        first.setdefault(find(x), (doc, i))
    gone = {(doc, i) for doc, i, x in entries if first[find(x)] != (doc, i)}
    return {doc: "\n".join(x for i, x in enumerate((text or "").split("\n")) if (doc, i) not in gone) for doc, text in rows}


def test_stages(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    now = read("documents").cache()
    columns = now.columns
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    verdict = {r.doc_id: r.kept for r in quality.quality(now).collect()}
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in now.collect()]
        out = stage(spark, now, sf).cache()
        if name == "sentencepiece":
            back = {r.doc_id: r.text for r in pieces.decode(out, tokenizer_path("piece_bpe_32k.model")).collect()}
            assert back == dict(before)
            break
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert len(after) == out.count()
        if name == "quality_rules":
            assert after == {i: t for i, t in before if verdict[i]}
        if name == "line_dedup":
            plain = plain_lines(before)
            assert after == {i: plain[i] for i, t in before if plain[i] == t or plain[i].strip()}
        if name == "near_duplicates":
            kept = plain_near(before, 5)
            assert after == {i: t for i, t in before if kept[i][2]}
        if name == "decontamination":
            for i, t in before:
                n, hit = plain_contamination(t, items)[:2]
                assert (i in after) == (2 * hit <= n)
                if i in after:
                    assert after[i] == t if not hit else len(plain_words(after[i])) < n and not plain_contamination(after[i], items)[4]
        now = out
    assert pipeline.STAGES[-1][0] == "sentencepiece"


def test_planted(spark, tmp_path):
    """Copies, passages and bad documents go; clean documents stay as they are."""
    import random

    r = random.Random(11)
    sentence = lambda k: " ".join("".join(r.choices("bcdfglmnprst", k=2)) + r.choice("aeiou") + str(r.randrange(90)) for _ in range(k))
    clean = [sentence(80) + "\n" + sentence(60) for _ in range(30)]
    passage, item = sentence(55), sentence(25)
    texts = [*clean, clean[0], clean[1] + " x", *[sentence(70) + "\n" + passage + "\n" + sentence(20) for _ in range(5)], sentence(70) + "\n" + item + " " + sentence(70), "short", None, "spam " * 300]
    at = str(tmp_path)
    docs(spark, texts).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    rows = {x.doc_id: x for x in pipeline.run(spark, at).collect()}
    back = {x.doc_id: x.text for x in pieces.decode(pipeline.run(spark, at), tokenizer_path("piece_bpe_32k.model")).collect()}
    assert set(back) == set(rows)
    assert all(back[i] == clean[i] for i in range(30))
    assert sum(passage in t for t in back.values()) == 1
    assert not any(item in t for t in back.values()) and 37 in back
    assert not {38, 39, 40} & set(back)
    assert 30 not in back and 31 not in back


def test_short_items_are_cut(spark):
    """Items of fewer words than a window leave the text too."""
    items = spark.createDataFrame([(1, "Which river is longest?"), (2, "one two three four five six seven eight nine")], "item_id long, text string")
    fill = " ".join(f"w{i}" for i in range(40))
    texts = [f"{fill}\nwhich River is longest {fill}", f"{fill} one two three four five six seven eight nine. {fill}", f"{fill} which river {fill}", None]
    df = docs(spark, texts, drop="x", c1=2, row=3)
    got = {x.doc_id: x.text for x in decontaminate.decontaminate(df, items).collect()}
    blocks = decontaminate.decontaminate(df, items, block_bytes=30)
    assert blocks.columns == df.columns and {x.doc_id: x.text for x in blocks.collect()} == got
    assert got[0].split() == [*fill.split(), *fill.split()] and "seven" not in got[1] and got[2] == texts[2] and got[3] is None
    assert not any(x.contaminated for x in decontaminate.contamination(docs(spark, list(got.values())), items).collect())


def test_hard_tables(spark, tmp_path):
    """Empty tables, nulls in any column, repeated rows and columns with clashing names."""
    from pyspark.sql import functions as F

    from util import hard_texts

    texts = [*hard_texts(), *[" ".join(f"w{i}x{k}" for k in range(90)) for i in range(60)]]
    df = docs(spark, texts, bw_row="a", bw_text="b", line=1, bucket=2, kept=False)
    # null ids come first, so what they repeat of the others would go from these
    nulls = df.where(f"doc_id < {len(texts) - 60}").withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    for k, (rows, items) in enumerate([(df.limit(0), [(1, "a b c")]), (df.unionAll(df).unionAll(nulls), []), (df.unionAll(nulls), [(1, None), (None, "a b"), (2, texts[-1])])]):
        at = f"{tmp_path}/{k}"
        rows.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out = pipeline.run(spark, at)
        back = pieces.decode(out, tokenizer_path("piece_bpe_32k.model")).collect()
        clean = {x.doc_id: x.text for x in back if x.doc_id is not None}
        want = {i: t for i, t in enumerate(texts) if i >= len(texts) - 60} if k else {}
        if k == 2:
            want.pop(len(texts) - 1)
        assert {i: t for i, t in clean.items() if i >= len(texts) - 60} == want and len(back) == out.count()
