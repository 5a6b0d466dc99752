"""Texts of a megabyte and more, in all operators."""

import random

import pytest

pytest.importorskip("blockweave.llm")
from blockweave.llm import decontaminate, html, lines, minhash, pieces, pii, quality, secrets, token_counts, urls
from blockweave.llm.queries import tokenizer_path

from test_counts import n_tokens, plain_contamination, plain_quality
from test_links import plain_base, plain_near
from util import docs

R = random.Random(12)
VOCABULARY = ["".join(R.choices("abcdefghijklmnop", k=R.randrange(2, 9))) for _ in range(4000)]
WORDS = [R.choice(VOCABULARY) for _ in range(220_000)]
#: Many lines, one line of a megabyte, one run of letters, and near copies.
TEXTS = ["\n".join(" ".join(WORDS[i : i + 12]) for i in range(0, len(WORDS), 12)), " ".join(WORDS[::-1]), "x" * 1_100_000, "a short text"]
TEXTS += [TEXTS[0].replace(WORDS[5], "other", 1), "first line\n" + TEXTS[1] + "\n" + TEXTS[1][:-1] + "!"]


@pytest.fixture(scope="module")
def long(spark):
    return docs(spark, TEXTS).repartition(3)


def test_counts(spark, long):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(long.where("doc_id < 2"), tokenizer_path("word_bpe_49k.json")).collect()}
    assert got == {i: n_tokens(library, TEXTS[i]) for i in got} and len(got) == 2
    rows = {r.doc_id: tuple(r)[1:7] for r in quality.quality(long).collect()}
    assert rows[1] == plain_quality(TEXTS[1]) and rows[2] == plain_quality(TEXTS[2])


def test_links_and_lines(long):
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(long, size=5).collect()}
    assert got == plain_near(list(enumerate(TEXTS)), 5)
    cut = {r.doc_id: (r.text, r.bw_dropped) for r in lines.dedup_lines(long).collect()}
    assert cut[0] == (TEXTS[0], 0) and cut[4][0].count("\n") == 0 and cut[5] == ("first line", 2)


def test_spans(spark, long):
    item = " ".join(WORDS[1000:1030])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.contamination(long, items).collect()}
    assert got[0] == plain_contamination(TEXTS[0], [(1, item)])[:2] and got[0][1] == 30 and got[1][1] == got[2][1] == 0
    marked = docs(spark, [TEXTS[1] + " password=abcdefgh1 a@b.org 4111111111111111 " + TEXTS[1]])
    row = secrets.scan(marked, secrets.train(secrets.labelled_sample(long))).first()
    assert [x for x in row.spans.split(",") if not x.startswith("model")] == plain_base(TEXTS[1] + " password=abcdefgh1 a@b.org 4111111111111111 " + TEXTS[1])
    out = pii.pseudonymise(marked, b"k").first()
    assert (out.n_mail, out.n_card) == (1, 1) and len(out.text) == 2 * len(TEXTS[1]) + len(" password=abcdefgh1 a@b.org 4111111111111111 ")


def test_pieces(long):
    out = pieces.encode(long, tokenizer_path("piece_bpe_32k.model"))
    assert {r.doc_id: r.text for r in pieces.decode(out, tokenizer_path("piece_bpe_32k.model")).collect()} == dict(enumerate(TEXTS))


def test_pages(spark):
    page = lambda i: f"<body><nav>menu</nav><div><p>Head {i}</p><p>{' '.join(WORDS[i : i + 150_000])}</p></div></body>"
    pages = [(i, "http://a.org/" + "p" * 1_000_000 + str(i), page(i)) for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.main_text(df).collect()} == {i: f"Head {i}\n{' '.join(WORDS[i : i + 150_000])}" for i in range(3)}
    rows = urls.judge_urls(df, urls.rule_table(spark), urls.link_edges(df)).collect()
    assert {(r.host, len(r.path), r.verdict) for r in rows} == {("a.org", 1_000_002, "allow")}
