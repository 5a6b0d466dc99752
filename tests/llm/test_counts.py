"""Token counts, quality counts and decontamination against plain versions."""

import functools
import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

pytest.importorskip("blockweave.llm")
from blockweave.llm import decontaminate, quality, token_counts
from blockweave.llm.queries import QUERIES, tokenizer_path

from util import DOCS, WORD, docs, hard_texts

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def n_tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


COUNTER = token_counts.counter(open(PATH, encoding="utf-8").read())


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aIK'sT é̇́<|endoftext|>\n1.")), max_size=40))
def test_counts_as_the_library(text):
    from tokenizers import Tokenizer

    whole = n_tokens(COUNTER.library, text)
    ends, counts = COUNTER.table(text)
    assert (counts[-1] if counts else 0) == whole
    for i, n in zip(ends, counts):
        assert n == n_tokens(COUNTER.library, text[:i])


def test_every_prefix_and_budget(library):
    text = "It's a long-winded test, don't you think? 12345 naïve cafés " * 4
    exact = [n_tokens(library, text[:i]) for i in range(len(text) + 1)]
    assert COUNTER.prefixes(text).tolist() == exact
    for budget in (0, 1, 7, 20, 1000):
        assert COUNTER.fits(text, budget) == max(i for i, n in enumerate(exact) if n <= budget)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeiounstrhlIK'sdtmv.,-éßİ語한ж09 <|\u00a0")), max_size=30))
def test_stored_counts_are_the_librarys(text):
    from tokenizers import Tokenizer  # noqa: F401

    assert COUNTER.prefixes(text).tolist() == [n_tokens(COUNTER.library, text[:i]) for i in range(len(text) + 1)]


def test_prefixes_of_words_and_runs(library, monkeypatch):
    """The dynamic programme alone, on words, endings, numbers and runs without blanks; linear on long ones."""
    import base64
    import random
    import time

    r = random.Random(3)
    words = ["internationalisation", "they're", "we'll've", "''re", "don't!!!'s", "antidisestablishmentarianism", "日本語日本語", "привет", "x1y22z", base64.b64encode(r.randbytes(60)).decode()]
    words += ["".join(r.choices("etaoinshrdlucm", k=r.randrange(2, 18))) for _ in range(150)]
    want = {w: [n_tokens(library, w[:i]) for i in range(len(w) + 1)] for w in words}
    monkeypatch.setattr(COUNTER, "_whole", None)
    for w in words:
        assert COUNTER.merges.plain(w) and COUNTER.merges.chunk(w) == want[w], w
    long = base64.b64encode(r.randbytes(150_000)).decode()
    began = time.process_time()
    assert len(COUNTER.inside(long)) == len(long) + 1 and time.process_time() - began < 60
    monkeypatch.undo()
    assert COUNTER.prefixes(long)[-1] == n_tokens(library, long)


def test_stored_tables_answer_questions(spark, library):
    from pyspark.sql import functions as F

    texts = [t for t in hard_texts() if t is None or len(t) < 400]
    tables = token_counts.prefix_tables(docs(spark, texts, tokens="x"), PATH)
    at = {r.doc_id: r.n_tokens for r in token_counts.tokens_at(tables, F.lit(7)).collect()}
    fit = {r.doc_id: r.n_chars for r in token_counts.longest_within(tables, F.lit(5)).collect()}
    for i, t in enumerate(texts):
        assert at[i] == n_tokens(library, (t or "")[:7])
        assert fit[i] == max(k for k in range(len(t or "") + 1) if n_tokens(library, (t or "")[:k]) <= 5)


def test_token_query(spark, sf, library):
    rows = QUERIES["op1_token_counts"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), n_tokens(library, texts[r.doc_id]))
        assert r.over_limit == (r.n_tokens > 2048)
        fits = texts[r.doc_id].encode()[: r.budget_bytes].decode()
        assert n_tokens(library, fits) <= 2048


def test_token_cases(spark, library):
    texts = hard_texts()
    df = docs(spark, texts, n_tokens=5, n_bytes="x")
    rows = {r.doc_id: r for r in token_counts.token_counts(df, PATH, budget=50).collect()}
    assert [rows[i].n_tokens for i in range(len(texts))] == [n_tokens(library, t) for t in texts]
    cut = {r.doc_id: r.text for r in token_counts.truncate(df, PATH, 50).collect()}
    assert all(n_tokens(library, cut[i]) <= 50 for i in range(len(texts)))
    assert cut[0] is None and cut[4] == "a"
    tables = {r.doc_id: r for r in token_counts.prefix_tables(df, PATH).collect()}
    assert tables[0].tokens == [] and len(tables[5].tokens) == len(texts[5]) + 1 and tables[5].tokens[-1] == 2
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def test_quality_query(spark, sf):
    rows = QUERIES["op7_quality_rules"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == plain_quality(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_quality_cases(spark):
    texts = hard_texts()
    df = docs(spark, texts, bw_words="x", kept=3, n_words=1)
    rows = {r.doc_id: r for r in quality.quality(df).collect()}
    assert [tuple(rows[i])[1:7] for i in range(len(texts))] == [plain_quality(t) for t in texts]
    assert not rows[0].kept
    assert quality.quality(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    nulls = df.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    assert quality.quality(nulls).count() == len(texts)


def test_quality_adapts(spark):
    import random

    r = random.Random(3)
    clean = [" ".join(r.choice("abcdefgh") * r.randrange(1, 6) + str(r.randrange(99)) for _ in range(120)) for _ in range(120)]
    noisy = [" ".join(w + "###$$$%%%" for w in clean[0].split())]
    df = docs(spark, clean + noisy)
    kept = {x.doc_id: x.kept for x in quality.quality(df).collect()}
    assert all(kept[i] for i in range(120)) and not kept[120]
    assert quality.keep_good(df).columns == df.columns
    assert quality.keep_good(df).count() == 120


def test_groups_have_their_own_thresholds(spark):
    """Two sources of unlike text: what is usual in one is too much in the other; a third of junk moves nothing."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(9)
    words = lambda n, size: ["".join(r.choices("abcdefghij", k=r.randrange(size - 1, size + 2))) for _ in range(n)]
    prose = [" ".join(words(200, 4)) for _ in range(300)]
    code = [" ".join(w + r.choice(["#", "", "$", "%"]) for w in words(200, 9)) for _ in range(300)]
    junk = [" ".join(w + "#$%" for w in words(200, 4)) for _ in range(150)]
    rows = [(i, t, "en", s) for i, (t, s) in enumerate([*[(t, "a") for t in prose + junk], *[(t, "b") for t in code], (code[0], "a"), (prose[0], "b")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {x.doc_id: x.kept for x in quality.quality(df).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 450))
    assert sum(kept[i] for i in range(450, 750)) >= 297 and not kept[750] and not kept[751]
    judged = quality.with_verdict(quality.base_counts(df, keep=("lang", "source")))
    own = {x.source: x.asDict() for x in quality.bounds_of(judged, ["lang", "source"]).collect()}
    assert own["a"]["hi_word_len_pm"] < own["b"]["lo_word_len_pm"] and own["a"]["hi_symbol_pm"] < own["b"]["hi_symbol_pm"]
    shuffled = {x.doc_id: x.kept for x in quality.quality(df.repartition(7), limit=0).collect()}
    assert shuffled == kept


TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return TEST_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@functools.lru_cache(4)
def plain_windows(items, window):
    """Window -> names of the items that hold it."""
    found = {}
    for name, item in items:
        own = plain_words(item)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            found.setdefault(tuple(own[i : i + size]), set()).add(str(name))
    return found


def plain_contamination(text, items, window=10):
    words, hit, found = plain_words(text), set(), set()
    windows = plain_windows(tuple(items), window)
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            names = windows.get(tuple(words[i : i + size]))
            if names:
                hit |= set(range(i, i + size))
                found |= names
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_contamination_query(spark, sf, block_bytes):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    texts = {r.doc_id: r.text for r in read("documents").collect()}
    rows = decontaminate.contamination(read("documents"), read("benchmark"), block_bytes=block_bytes).collect()
    assert len(rows) == len(texts) and sum(r.contaminated for r in rows)
    for r in rows:
        assert tuple(r)[1:6] == plain_contamination(texts[r.doc_id], items)


def test_contamination_cases(spark):
    items = [(1, "a b c d e f g h i j k l"), (2, "b c d e f g h i j k"), (3, "solo"), (4, None), (5, ""), (6, "x y"), (7, "x y"), (10, "Ré 日本 ß a a a a a a a a"), (None, "q r s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [*hard_texts(), "A, b. c d-e f g h i j k l m", "SOLO x", "x Y x y", "z b c d e f g h i j k z", "ré 日本 ß " + "a " * 12, "q r s", "b c d e f g h i j"]
    df = docs(spark, texts, item_id=1, bw_text="q")
    rows = {r.doc_id: r for r in decontaminate.contamination(df, bench).collect()}
    want = [x for x in items if x[0] is not None]
    assert [tuple(rows[i])[1:6] for i in range(len(texts))] == [plain_contamination(t, want) for t in texts]
    assert not any(r.contaminated for r in decontaminate.contamination(df, bench.limit(0)).collect())
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_passages_are_cut(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    around = "Some Words, here " * 10
    texts = [around + item + " - " + around, "clean TEXT, kept.", item, None]
    df = docs(spark, texts, extra=1)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(df, bench).collect()}
    assert decontaminate.decontaminate(df, bench).columns == df.columns
    assert set(out) == {0, 1, 3} and out[1].text == texts[1] and out[3].text is None
    assert out[0].text == around + " - " + around
