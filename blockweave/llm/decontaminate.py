"""Benchmark decontamination by a generalised suffix automaton of test items.

The items' words form one automaton (a block of items at a time, each of a
bounded number of bytes). A document streams through it word by word; the
state keeps the longest run of words, ending here, that occurs in some item.
A window is a run of `window` item words; an item with fewer words is one
window as a whole. Where the longest match reaches a window, its words are hit.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import BROADCAST_BYTES, discard, map_batches, materialize, stage_dir

#: Lower-cases A-Z and turns every other ASCII character than a-z and 0-9 into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A copy of target for the strings no longer than state's and symbol."""
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            target = self.next[last].get(symbol)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target)
                continue
            state, new = last, self._new(self.length[last] + 1, {}, 0)
            while state >= 0 and symbol not in self.next[state]:
                self.next[state][symbol] = new
                state = self.link[state]
            if state >= 0:
                target = self.next[state][symbol]
                self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, symbol, target)
            last = new

    def walk(self, sequence):
        """(state, longest match) after each symbol."""
        state = matched = 0
        edges, link, length = self.next, self.link, self.length
        for symbol in sequence:
            target = edges[state].get(symbol)
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = edges[state].get(symbol)
            if target is not None:
                state, matched = target, matched + 1
            yield state, matched


class ItemIndex:
    """The automaton of one block of items, with the windows its states end."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        sequences = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        self.automaton = SuffixAutomaton()
        for _, sequence in sequences:
            self.automaton.add(sequence)
        self.shortest = min([window, *(len(s) for _, s in sequences)], default=window)
        self.ends: dict[int, dict[int, set[str]]] = {}
        link, length = self.automaton.link, self.automaton.length
        for name, sequence in sequences:
            size = min(window, len(sequence))
            for state, matched in self.automaton.walk(sequence):
                if matched >= size:
                    while length[link[state]] >= size:
                        state = link[state]
                    self.ends.setdefault(state, {}).setdefault(size, set()).add(name)
        pairs = {a * len(self.vocabulary) + b for _, s in sequences for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.memo: dict[int, tuple] = {}

    def endings(self, state: int) -> tuple:
        """(size, items, exact) of the windows ending at a state; exact where the match must be long enough itself."""
        found = self.memo.get(state)
        if found is None:
            out, at = [], state
            while at > 0:
                out += [(size, names, at == state) for size, names in self.ends.get(at, {}).items()]
                at = self.automaton.link[at]
            found = self.memo[state] = tuple(out)
        return found

    def runs(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Spans of words outside of which no window can occur: every pair of neighbours stands in some item."""
        if self.shortest == 1:
            good, extra = numbers >= 0, 0
        else:
            codes = numbers[:-1] * len(self.vocabulary) + numbers[1:]
            codes[(numbers[:-1] < 0) | (numbers[1:] < 0)] = -1
            at = np.searchsorted(self.pairs, codes)
            at[at == len(self.pairs)] = 0
            good, extra = self.pairs[at] == codes, 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        return [(a, b + extra) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a + extra >= self.shortest]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit word spans (start, end), items found, and the longest match seen in the spans looked at."""
        if len(words) < self.shortest or not self.ends:
            return [], set(), 0
        numbers = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        spans, items, longest = [], set(), 0
        for start, end in self.runs(numbers):
            for i, (state, matched) in enumerate(self.automaton.walk(numbers[start:end].tolist()), start + 1):
                longest = max(longest, matched)
                if matched >= self.shortest:
                    for size, names, exact in self.endings(state):
                        if not exact or matched >= size:
                            spans.append((i - size, i))
                            items |= names
        return spans, items, longest


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The items (name, body) in blocks of about block_bytes of text; the size is measured, and more are dealt by the hash of the id."""
    items = items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("body")).where("name IS NOT NULL AND body IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("name"), F.lit(n)) == k) for k in range(n)]


@functools.lru_cache(maxsize=1)
def _index(key, broadcast, window: int) -> ItemIndex:
    return ItemIndex([(name, words_of(text)) for name, text in broadcast.value], window)


#: Word spans as start, end, start, end ...
SPANS = ArrayType(LongType())
FOUND = [StructField("bw_spans", SPANS), StructField("bw_items", ArrayType(StringType())), StructField("bw_longest", LongType())]


def send(block: DataFrame):
    """A broadcast of one block of items, which is all of them that the driver holds at a time."""
    return block.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in block.collect()])


def block_matches(texts: DataFrame, broadcast, window: int, schema: StructType) -> DataFrame:
    """The columns of texts (..., bw_text last) with what one block of items has in each text."""

    def make():
        index = _index(id(broadcast.value), broadcast, window)

        def step(batch):
            found = [index.match(words_of(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            spans = [[x for pair in merge(hits) for x in pair] for hits, _, _ in found]
            return [*batch.columns, spans, [sorted(names) for _, names, _ in found], [n for _, _, n in found]]

        return step

    return map_batches(texts, schema, make)


def match_items(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """For each document: bw_id, bw_text, bw_spans (hit words, merged), bw_items, bw_longest.

    Items of up to block_bytes are one automaton, and the documents are gone
    through once, without a shuffle. An automaton takes some 150 times the
    bytes of its items, so larger sets are worked on a block after the other:
    only one is in memory at a time, what it finds is written under the hashes
    of the texts, and at the end these rows are joined to the documents.
    """
    df = docs.select(F.col(id_col).alias("bw_id"), F.col(text_col).cast("string").alias("bw_text"))
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    if len(blocks) == 1:
        return block_matches(df, send(blocks[0]), window, StructType([*df.schema.fields, *FOUND]))
    spark, at = docs.sparkSession, stage_dir(docs.sparkSession)
    print_ = lambda: (F.xxhash64("bw_text").alias("bw_h"), F.xxhash64("bw_text", F.lit(1)).alias("bw_g"))
    texts, parts = df.select(*print_(), "bw_text"), []
    for k, block in enumerate(blocks):
        broadcast = send(block)
        found = block_matches(texts, broadcast, window, StructType([*texts.schema.fields, *FOUND]))
        parts.append(materialize(spark, found.where("bw_longest > 0").drop("bw_text"), at, f"block-{k}"))
        broadcast.destroy()
    every = functools.reduce(DataFrame.unionAll, parts).distinct()
    merged = every.groupBy("bw_h", "bw_g").agg(F.flatten(F.collect_list("bw_spans")).alias("bw_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bw_items")))).alias("bw_items"), F.max("bw_longest").alias("bw_longest"))
    merged = materialize(spark, merged, at, "merged")
    discard(spark, at, keep=("merged",))
    size = merged.agg(F.sum(64 + 16 * F.size("bw_spans") + 64 * F.size("bw_items"))).first()[0] or 0
    joined = df.select("*", *print_()).join(F.broadcast(merged) if size <= BROADCAST_BYTES else merged, ["bw_h", "bw_g"], "left")
    joined = joined.select("bw_id", "bw_text", F.coalesce("bw_spans", F.array().cast(SPANS)).alias("bw_spans"), F.coalesce("bw_items", F.array().cast("array<string>")).alias("bw_items"), F.coalesce("bw_longest", F.lit(0)).cast("long").alias("bw_longest"))

    def make():
        def step(batch):
            spans = [[x for pair in merge(list(zip(s[::2], s[1::2]))) for x in pair] for s in batch.column(2).to_pylist()]
            return [batch.column(0), batch.column(1), spans, batch.column(3), batch.column(4)]

        return step

    return map_batches(joined, StructType([*df.schema.fields, *FOUND]), make)


def contamination(docs: DataFrame, items: DataFrame, id_col="doc_id", **options) -> DataFrame:
    """Per document: id_col, n_words, n_hit, n_items, items_sha256, contaminated, longest_match.

    Null and empty texts have no words and no hits; null or empty items have
    no windows; repeated rows are each judged; an empty item table hits
    nothing; other columns are ignored. longest_match is the longest run of
    item words seen where a window was possible.
    """
    own = docs.schema[id_col].dataType
    matched = match_items(docs, items, id_col=id_col, **options)
    schema = StructType([StructField(id_col, own), StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items_sha256", StringType()), StructField("contaminated", BooleanType()), StructField("longest_match", LongType())])

    def make():
        def step(batch):
            spans = batch.column(2).to_pylist()
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            items = batch.column(3).to_pylist()
            return [batch.column(0), [len(words_of(t)) for t in batch.column(1).to_pylist()], hit, [len(x) for x in items], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], [n > 0 for n in hit], batch.column(4)]

        return step

    return map_batches(matched, schema, make)


def remove_spans(text: str, spans: list[int]) -> str:
    """The text without its hit words; the characters between kept words stay."""
    data = text.encode("utf-8", "surrogatepass")
    folded, at, starts, ends = data.translate(FOLD), 0, [], []
    for word in folded.split():
        at = folded.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    out, kept = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(data[kept : starts[a]])
        kept = ends[b - 1]
    return b"".join([*out, data[kept:]]).decode("utf-8", "surrogatepass")


def without(text: str | None, spans: list[int], max_coverage: float) -> tuple[str | None, bool]:
    """The text without its hit words, and whether they are so many that it goes altogether."""
    hit = sum(spans[1::2]) - sum(spans[::2])
    if not hit:
        return text, False
    if hit > max_coverage * len(words_of(text)):
        return None, True
    return remove_spans(text, spans), False


def decontaminate(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window: int = 10, max_coverage: float = 0.5, block_bytes: int = 1 << 20) -> DataFrame:
    """The documents without benchmark passages, with the columns they came with.

    All hit words are cut out of the text: windows, and whole items that have
    fewer words than a window. A document whose
    hit words are more than max_coverage of all its words goes altogether.
    Documents without hits stay as they are, null texts included; repeated rows
    are treated alike; an empty table stays empty.
    """
    names, own = docs.columns, docs.schema
    at = names.index(text_col)
    # by place, so that columns may have any name; each row passes once through one worker
    rows = docs.select(*[(F.col(f"`{c}`").cast("string") if i == at else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)])
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    if len(blocks) == 1:
        broadcast = send(blocks[0])
        schema = StructType([*rows.schema.fields, StructField("drop", BooleanType())])

        def make():
            index = _index(id(broadcast.value), broadcast, window)

            def step(batch):
                found = []
                for text in batch.column(at).to_pylist():
                    hits = index.match(words_of(text))[0]
                    found.append(without(text, [x for pair in merge(hits) for x in pair], max_coverage))
                columns = [[f[0] for f in found] if i == at else c for i, c in enumerate(batch.columns)]
                return [*columns, [f[1] for f in found]]

            return step
    else:
        packed = rows.select(F.col(f"c{at}"), F.struct(*rows.columns).alias("row"))
        rows = match_items(packed, items, "row", f"c{at}", item_id, item_text, window, block_bytes)
        schema = StructType([StructField("row", rows.schema["bw_id"].dataType), StructField("text", StringType()), StructField("drop", BooleanType())])

        def make():
            def step(batch):
                found = [without(t, s, max_coverage) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                return [batch.column(0), [f[0] for f in found], [f[1] for f in found]]

            return step

    kept = map_batches(rows, schema, make).where("NOT drop")
    if len(blocks) > 1:
        kept = kept.select(*[F.col("text" if i == at else f"row.c{i}").alias(f"c{i}") for i in range(len(names))])
    return kept.select(*[F.col(f"c{i}").cast(own[i].dataType).alias(c) for i, c in enumerate(names)])
