"""Sampled pieces and pseudonyms."""

import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

pytest.importorskip("blockweave.llm")
from blockweave.llm import pieces, pii
from blockweave.llm.queries import QUERIES, tokenizer_path

from util import docs, hard_texts

PATH = tokenizer_path("piece_bpe_32k.model")
LATTICE = pieces.Lattice(open(PATH, "rb").read(), 6.0)
LIBRARY = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab ▁\n é")), max_size=60), st.integers(0, 2**63 - 1))
def test_lossless(text, key):
    ids = LATTICE.encode(text, key, 0)
    assert LATTICE.decode(ids) == text == LIBRARY.decode(ids)


def plain_paths(text):
    """Every segmentation of a text with its weight."""
    marked = " " + text

    def go(at):
        if at == len(marked):
            return [((), 1.0)]
        out = []
        for end in range(at + 1, len(marked) + 1):
            found = LATTICE.weight.get(marked[at:end].replace(" ", pieces.MARK))
            if found:
                out += [(found[0] + rest, found[1] * w) for rest, w in go(end)]
        return out

    paths = go(0)
    total = sum(w for _, w in paths)
    return {p: w / total for p, w in paths}


@pytest.mark.parametrize("widest", [64, 2])
def test_sampling_follows_the_lattice(widest):
    """Side by side, and alone as long units are."""
    own = pieces.Lattice(open(PATH, "rb").read(), 2.0, widest)
    LATTICE.weight, kept = own.weight, LATTICE.weight
    try:
        want = plain_paths("the cat")
    finally:
        LATTICE.weight = kept
    n = 20000
    ids, counts = own.encode_many(["the cat"] * n, range(n), 0)
    seen = Counter(map(tuple, pieces.np.split(ids, counts.cumsum()[:-1])))
    assert set(seen) <= set(want)
    for path, p in want.items():
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_ways_to_work_agree(monkeypatch):
    """Alone or among others, in chunks of any size, and with every unit worked on alone."""
    texts = ["thinghation ereble wherer " * 20, "", "a", "日本語 é ▁ x\n" * 9, "x" * 300, *[t for t in hard_texts() if t]]
    keys = list(range(len(texts)))
    ids, counts = LATTICE.encode_many(texts, keys, 0)
    first = [x.tolist() for x in pieces.np.split(ids, counts.cumsum()[:-1])]
    assert [LATTICE.encode(t, k, 0) for t, k in zip(texts, keys)] == first
    assert LATTICE.encode(texts[0], 1, 0) != first[0] != LATTICE.encode(texts[0], 0, 1)
    own = pieces.Lattice(open(PATH, "rb").read(), 6.0, 1)
    assert [own.encode(t, k, 0) for t, k in zip(texts, keys)] == first
    monkeypatch.setattr(pieces, "TABLE", 50)
    monkeypatch.setattr(pieces, "STRETCH", 7)
    monkeypatch.setattr(pieces, "CHUNK", 40)
    assert [own.encode(t, k, 0) for t, k in zip(texts, keys)] == first
    assert [LATTICE.encode(t, k, 0) for t, k in zip(texts, keys)] == first


def test_hashes_that_collide_do_no_harm(monkeypatch):
    text = "some words that are not alike, and some that are"
    first = LATTICE.encode(text, 3, 0)
    monkeypatch.setattr(pieces, "span_hashes", lambda codes, starts, ends: (starts % 3).astype(pieces.np.uint64))
    assert LATTICE.encode(text, 3, 0) == first


def test_long_runs_take_linear_time():
    import random
    import time

    r = random.Random(2)
    long = "".join(r.choice("etaoinshrdlu") for _ in range(1_200_000))
    began = time.process_time()
    assert LATTICE.decode(LATTICE.encode(long, 1, 0)) == long
    assert time.process_time() - began < 90
    mixed = long[:300_000] + " " + " ".join(["word"] * 120_000) + long[:100]
    assert LATTICE.decode(LATTICE.encode(mixed, 1, 0)) == mixed


def test_pieces_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op3_sampled_pieces"](spark, sf)
    rows = out.collect()
    assert len(rows) == len(texts) and all(r.n_pieces == len(r.pieces) for r in rows)
    assert {r.doc_id: r.text for r in pieces.decode(out, PATH).collect()} == texts
    assert all(LATTICE.decode(r.pieces) == texts[r.doc_id] for r in rows)


def test_pieces_cases(spark):
    texts = hard_texts()
    df = docs(spark, texts, pieces=1, n_pieces="x")
    out = pieces.encode(df, PATH)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].pieces is None and rows[0].n_pieces == 0 and rows[1].pieces == []
    assert {r.doc_id: r.text for r in pieces.decode(out, PATH).collect()} == dict(enumerate(texts))
    assert {r.doc_id: r.pieces for r in pieces.encode(df.repartition(5), PATH).collect()} == {i: r.pieces for i, r in rows.items()}
    assert pieces.encode(df.limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 3000), st.binary(min_size=1, max_size=8))
def test_feistel_is_a_permutation(n, key):
    f = pii.Feistel(key)
    assert sorted(f.permute(x, n, "a") for x in range(n)) == list(range(n))


OWN = pii.Pseudonyms(b"key")


def test_formats_stay():
    import datetime

    for text, kind in (("4012888888881881", "card"), ("4111 1111 1111 1111", "card"), ("+1 (826) 555-4081", "phone"), ("826-555-4081", "phone"), ("10.0.255.1", "ip"), ("2024-02-29", "date"), ("31/12/1999", "date"), ("31.12.1999", "date"), ("219-09-9999", "ssn")):
        for around in ("{}", "x {} y", "({}).", "{}, {}", "é {}!\n"):
            new, counts = OWN.replace(around.format(text, text))
            assert counts[kind] == around.count("{}") and text not in new
            one = OWN.replace(text)[0]
            assert new == around.format(one, one)
            assert re.sub(r"\d", "9", one) == re.sub(r"\d", "9", text) or kind == "ip"
    assert pii.luhn(OWN.replace("4111111111111111")[0]) % 10 == 0
    datetime.date.fromisoformat(OWN.replace("2024-02-29")[0])
    assert OWN.replace("a@b.org and A@b.org")[0].split(" and ")[0] == OWN.replace("A@b.org")[0]
    assert pii.Pseudonyms(b"other").replace("2024-02-29") != OWN.replace("2024-02-29")


@pytest.mark.parametrize("text", ["2023-02-30", "32/13/1999", "999.1.2.3", "000-12-3456", "1111111111111111", "4111111111111112", "word@", "12345", "v1.2.3.4.5", "00:11:22", "1234567890123456789012345"])
def test_invalid_values_stay(text):
    assert OWN.replace(text)[0] == text


def test_dates_permute():
    days = [(pii.FIRST + __import__("datetime").timedelta(d)).isoformat() for d in range(0, 73049, 7)]
    assert len({OWN._date(d) for d in days}) == len(days)


def test_pseudonym_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_pseudonyms"](spark, sf).collect()
    own = pii.Pseudonyms(b"example key of the test queries")
    assert len(rows) == len(texts) and any(r.n_card or r.n_phone or r.n_mail for r in rows)
    for r in rows:
        assert r.text == own.replace(texts[r.doc_id])[0]
        for x in re.findall(r"(?<!\d)\d{16}(?!\d)", texts[r.doc_id]):
            assert (x in r.text) == (pii.luhn(x) % 10 > 0)
        for x in re.findall(r"\+1 \(\d{3}\) 555-\d{4}|\b\d+\.\d+\.\d+\.\d+\b", texts[r.doc_id]):
            assert x not in r.text


def test_pseudonym_cases(spark):
    texts = [*hard_texts(), "a@b.org " * 2000, "5" * 5000]
    df = docs(spark, texts, n_mail="x")
    rows = {r.doc_id: r for r in pii.pseudonymise(df, b"k").collect()}
    assert rows[0].text is None and rows[len(texts) - 2].n_mail == 2000 and rows[len(texts) - 1].text == "5" * 5000
    assert pii.pseudonymise(df.limit(0), b"k").count() == 0


@pytest.mark.parametrize("kind, value, around", [
    ("phone", "+1 (826) 555-4081", "{} 190.137.20.7"),
    ("phone", "+1 (826) 555-4081", "{} 2024-02-29"),
    ("phone", "+1 (826) 555-4081", "{} 12/27"),
    ("phone", "+1 (826) 555-4081", "{} 826-555-4081"),
    ("phone", "+1 (826) 555-4081", "{} 4012888888881881"),
    ("phone", "+1 826-555-4081", "{} 15 times"),
    ("phone", "+44 20 7946 0958", "{} 190.137.20.7"),
    ("card", "4111 1111 1111 1111", "{} 12/27"),
    ("card", "4111 1111 1111 1111", "{} 123"),
    ("card", "4012888888881881", "12 {}"),
    ("card", "4111 1111 1111 1111", "77 {} 99"),
])
def test_neighbours_hide_nothing(kind, value, around):
    new, counts = OWN.replace(around.format(value))
    alone = OWN.replace(value)[0]
    assert counts[kind] >= 1 and alone != value and alone in new and value not in new
    for other in ("190.137.20.7", "2024-02-29", "826-555-4081", "4012888888881881"):
        if other in around:
            assert other not in new and OWN.replace(other)[0] in new


def test_lists_of_numbers_stay():
    for text in ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23", "12 34 56 78 90 12 34 56 79 11 22 33 44 55"):
        assert OWN.replace(text)[0] == text or not pii.luhn(re.sub(r"\D", "", pii.EACH[-1][1].match(text)[0])) % 10


def test_slash_dates_are_a_bijection():
    """Every string that is a day in one of the two orders has a pseudonym of its own, which is one too."""
    import calendar

    every = {f"{a:02d}/{b:02d}/{y}" for y in range(1900, 2100) for m in range(1, 13) for d in range(1, calendar.monthrange(y, m)[1] + 1) for a, b in ((m, d), (d, m))}
    own = pii.Pseudonyms(b"key", memo_limit=1)
    assert {own._date(x) for x in every} == every
    assert own._date("13/13/2000") is own._date("30/02/2000") is own._date("02/29/1900") is own._date("01/01/2100") is None


def test_equal_values_stay_linked():
    one = lambda text: OWN.replace(text)[0]
    digits = lambda text: re.sub(r"\D", "", one(text))
    assert digits("+49 30 1234567") == digits("+49301234567") == digits("+49-30-1234567") and digits("+49 30 1234567")[:2] == "49"
    assert digits("+49 (0)30 1234567").replace("490", "49", 1) == digits("+49 30 1234567")
    assert digits("+1 826 555 4081")[1:] == digits("(826) 555-4081") == digits("826-555-4081")
    assert one("Jo.Do12@Example.ORG") == one("jo.do12@example.org") and re.fullmatch(r"[a-z]{2}\.[a-z]{2}\d{2}@example\.org", one("jo.do12@example.org"))
    assert len({one(f"{a}{b}{c}@x.org") for a in "abcdefghijklmnopqrstuvwxyz" for b in "xyz" for c in range(10)}) == 780
    day = one("2024-02-29").split("-")
    assert one("29.02.2024") == ".".join(reversed(day))


#: Values as another program may look for them, and what of them must not change.
PLAIN = {
    "card": (r"(?<![\d -])\d{16}(?![\d -])", lambda x: sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(x))) % 10 == 0),
    "day": (r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])", lambda x: "1900" <= x[:4] <= "2099" and re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|1\d|2[0-8])", x)),
    "ssn": (r"(?<![\d-])[1-5]\d{2}-(?:0[1-9]|[1-9]\d)-\d{3}[1-9](?![\d-])", lambda x: True),
    "mail": (r"(?<![\w.%+-])[a-z0-9]+(?:\.[a-z0-9]+)?@[a-z0-9]+\.[a-z]+(?![\w.])", lambda x: True),
}


def test_pseudonyms_against_plain_search(spark, sf):
    """Found with other patterns, values of the given tables have gone, equal ones alike and others apart; the rest of the text stays."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    new = {r.doc_id: r.text for r in QUERIES["op9_pseudonyms"](spark, sf).collect()}
    seen, changed = {k: {} for k in PLAIN}, 0
    for i, old in texts.items():
        before, after = old.split(), new[i].split()
        assert len(before) == len(after)
        for a, b in zip(before, after):
            changed += a != b
            for kind, (pattern, valid) in PLAIN.items():
                x, y = re.search(pattern, a), re.search(pattern, b)
                if x and valid(x[0]):
                    assert y and valid(y[0]) and re.sub("[0-9]", "9", re.sub("[a-z]", "a", x[0].split("@")[0])) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", y[0].split("@")[0]))
                    assert seen[kind].setdefault(x[0], y[0]) == y[0]
            if not re.search(r"\d|@", a):
                assert a == b
    assert changed and all(len(set(m.values())) == len(m) for m in seen.values()) and any(seen.values())
