"""Line dedup against brute force."""

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

pytest.importorskip("blockweave.llm")
from blockweave.llm import lines

from util import docs, hard_texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(1, 4))
def test_banded_distance(a, b, t):
    assert lines.within(a, b, t) == (distance(a, b) <= t)


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", max_size=30), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.sampled_from("abx")), max_size=4))
def test_parities_bound_the_distance(a, edits):
    b = a
    for kind, at, c in edits:
        at %= len(b) + 1
        b = b[:at] + (c if kind != 2 else "") + b[at + (kind != 1) :]
    (p, q), (r, s) = lines.parities(a), lines.parities(b)
    bits = ((p ^ r) & (2**64 - 1)).bit_count() + ((q ^ s) & (2**64 - 1)).bit_count()
    assert bits <= 4 * distance(a, b)
    assert ((lines.odd_letters(a) ^ lines.odd_letters(b)) & (2**64 - 1)).bit_count() <= 2 * distance(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=6, max_size=20), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.sampled_from("abc")), max_size=3), st.integers(1, 3))
def test_probes_meet(a, edits, t):
    b = a
    for kind, at, c in edits[:t]:
        at %= len(b) + 1
        b = b[:at] + (c if kind != 2 else "") + b[at + (kind != 1) :]
    if min(len(a), len(b)) > t and distance(a, b) <= t:
        keys = [{(o, i, x[s : s + n]) for o, i, s, n in lines.probes(len(x), t)} for x in (a, b)]
        assert keys[0] & keys[1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefghij é𝔘", max_size=60), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.sampled_from("abxyzé")), max_size=3), st.integers(1, 3))
def test_projections_meet(a, edits, t):
    b = a
    for kind, at, c in edits[:t]:
        at %= len(b) + 1
        b = b[:at] + (c if kind != 2 else "") + b[at + (kind != 1) :]
    if distance(a, b) <= t:
        (p, q), (r, s) = lines.projections(a, t), lines.projections(b, t)
        assert set(p) & set(r) or set(q) & set(s)
        assert sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(lines.parities(a, 8), lines.parities(b, 8))) <= 4 * t


def plain_dedup(rows, t, least):
    entries = []
    for k, (doc, text) in enumerate(rows):
        for i, x in enumerate((text or "").split("\n")):
            x = x.strip(lines.BLANK)
            if text is not None and x:
                entries.append((doc, i, x))
    kinds = sorted({x for _, _, x in entries})
    up = {x: x for x in kinds}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= t and distance(a, b) <= t:
                up[find(a)] = find(b)
    first = {}
    for doc, i, x in sorted(entries):
        first.setdefault(find(x), (doc, i))
    drop = {(doc, i) for doc, i, x in entries if first[find(x)] != (doc, i)}
    return {doc: None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, i) not in drop) for doc, text in rows}


def test_lines(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abc dé") for _ in range(r.randrange(8, 40))).strip() + "x" for _ in range(40)]
    texts = [t for t in hard_texts() if t is None or len(t) < 2000]
    for _ in range(60):
        out = []
        for _ in range(r.randrange(1, 6)):
            x = r.choice(base)
            for _ in range(r.randrange(0, 4)):
                at = r.randrange(len(x) + 1)
                x = x[:at] + r.choice(["", "q", "é"]) + x[at + r.randrange(0, 2) :]
            out.append(r.choice(["", " ", "\t"]) + x)
        texts.append("\n".join(out))
    df = docs(spark, texts, line=1, h=2, bw_drop="x")
    want = plain_dedup(list(enumerate(texts)), 2, 8)
    for options in ({}, {"bits": 5}, {"limit": 0, "rounds": 0}):  # names that clash; no broadcast and no hubs among parts
        out = lines.dedup_lines(df, t=2, edit_chars=8, **options)
        assert out.columns == [*df.columns, "bw_dropped"]
        got = {x.doc_id: x.text for x in out.collect()}
        assert got == want, options
    report = {x.doc_id: x for x in lines.dedup_report(df, t=2, edit_chars=8).collect()}
    assert all(report[i].n_lines - report[i].n_dropped == len(got[i].split("\n")) for i in got if got[i])
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_line_groups(spark):
    """Very many variants of one line, and one very common line."""
    base = "this is one common passage that stands in very many documents of the corpus"
    texts = [base[: i % 60 + 5] + "#" + base[i % 60 + 6 :] + "\n" + base + f"\nown line {hashlib.md5(str(i).encode()).hexdigest()} of this document" for i in range(150)]
    got = {x.doc_id: x.text for x in lines.dedup_lines(docs(spark, texts), t=2).collect()}
    assert all(got[i].split("\n")[-1].startswith("own line") for i in got)
    assert got[0].count("\n") == 1 and all("passage" not in got[i] for i in range(1, 150))


def test_short_lines(spark, sf):
    """Short lines go where they are equal, long ones within two edits; the query runs so."""
    from blockweave.llm.queries import QUERIES

    texts = ["All rights reserved.\n\nYes\n}", " All rights reserved.\t\n\nYess\n}", "All rights reserved!\nYes", "one line that is long enough for the join\nx", "one line that is long enough for the joins\nx", None]
    got = {x.doc_id: x.text for x in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "\nYess", 2: "All rights reserved!", 3: texts[3], 4: "", 5: None}
    report = {x.doc_id: x.n_dropped for x in QUERIES["op10_line_dedup"](spark, sf).collect()}
    seen, short = set(), {}
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        for x in (r.text or "").split("\n"):
            x = x.strip(lines.BLANK)
            if 0 < len(x) < 30:
                short[r.doc_id] = short.get(r.doc_id, 0) + (x in seen)
                seen.add(x)
    assert sum(short.values()) > 0 and all(report[i] >= n for i, n in short.items())


def test_buckets_of_many_lines_at_once():
    """Equal substrings at the places of probes() meet, and hardly others; lines beyond a chunk are hashed alike."""
    r = random.Random(8)
    bodies = ["".join(r.choice("abé𝔘") for _ in range(r.randrange(3, 60))) for _ in range(200)]
    prober = lines.Prober(2)
    whole, owner = prober.buckets(bodies)
    seen = {}
    for k, b in enumerate(bodies):
        assert whole[owner == k].tolist() == prober.buckets([b])[0].tolist()
        for z, (other, i, start, size) in zip(whole[owner == k].tolist(), lines.probes(len(b), 2)):
            assert seen.setdefault(z, (other, i, b[start : start + size])) == (other, i, b[start : start + size])
    assert len(seen) == len(set(seen.values()))
    long = "".join(r.choice("abcdefgh ") for _ in range(lines.CHUNK + 5000))
    near = long[: 40_000] + "#" + long[40_000:]
    (p, _), (q, _) = prober.buckets([long]), prober.buckets(["x" * 40, near])
    assert set(p.tolist()) & set(q.tolist()) and not set(p.tolist()) & set(prober.buckets([long[::-1]])[0].tolist())


def test_variants_that_are_not_linked(spark, monkeypatch):
    """Lines that differ from one line by a word or some letters each, all beyond two edits, make few rows and pairs."""
    from blockweave.llm import blocking

    r = random.Random(11)
    words = ["".join(r.choice("etaoinshrdlucm") for _ in range(r.randrange(2, 9))) for _ in range(60)]

    def variant():
        out, at = list(words), r.randrange(len(words))
        out[at] = "".join(r.choice("etaoinshrdlucm") for _ in range(6)) if r.random() < 0.5 else out[at] + "".join(r.choice("abcdhilmn") for _ in range(4))
        return " ".join(out)

    texts = [variant() for _ in range(240)]
    texts += [x[:40] + "#" + x[41:] for x in texts[:20]]  # and some that are linked
    sizes = {}

    def counted(session, df, at, name):
        out = plain(session, df, at, name)
        if name.startswith(("fine", "placed-", "rest")):
            sizes[name] = out.count()
        return out

    plain = blocking.materialize
    monkeypatch.setattr(blocking, "materialize", counted)
    got = {x.doc_id: x.text for x in lines.dedup_lines(docs(spark, texts)).collect()}
    assert sizes["fine"] <= 9 * len(texts), sizes
    assert sizes.get("rest", 0) <= len(texts) ** 2 // 40, sizes  # of the 33,670 pairs
    first = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if first[i] != first[j] and lines.within(texts[j], a, 2):
                low, high = sorted((first[i], first[j]))
                first = [low if x == high else x for x in first]
    assert got == {i: x if first[i] == i else "" for i, x in enumerate(texts)}
