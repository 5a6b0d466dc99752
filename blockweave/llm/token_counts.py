"""Exact token counts of every prefix of a text, by dynamic programming over its places.

The last token of every prefix follows from those of shorter prefixes: it is the
vocabulary entry that ends there and that byte-pair merging leaves beside the
last token of what stands before it. So the count of a prefix is one more than
the count before its last token, and one pass from left to right stores the
exact counts of all prefixes. They answer how many tokens a prefix has and how
long a prefix fits a budget by a lookup; no text is encoded again.

A chunk is a run of bytes without ASCII white space. The tokenizer's
pre-tokens never cross white space and its normalizer never joins across it,
so chunks are independent, and each different one is worked out once. Where
only ends of chunks are asked for, the library counts each different piece.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate, islice

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import map_batches

#: The pre-token pattern for lower-case ASCII text, as in the vocabulary's own file.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Special strings start so; such chunks are left to the library.
SPECIAL = b"<|"


#: The pre-token pattern of the vocabulary's file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Blocks of characters that never join with the one before when normalised.
ALONE = ((0x21, 0x2FF), (0x370, 0x482), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    kept = set(own)
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Merges:
    """Byte-pair merging of one pre-token, for all its prefixes at once."""

    def __init__(self, vocabulary: str, memo_limit: int = 400_000):
        import regex

        model = json.loads(vocabulary)["model"]
        self.tokens, self.end = set(model["vocab"]), model["end_of_word_suffix"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.tokens)
        self.letters, self.split = byte_letters(), regex.compile(PIECES)
        self.beside: dict[tuple[str, str], bool] = {}
        self.memo_limit = memo_limit

    def symbols(self, token: str) -> list[str]:
        return [*token[: -len(self.end) - 1], token[-len(self.end) - 1 :]] if token.endswith(self.end) else list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """What is left when the pair of the lowest rank is merged again and again."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.ranks):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def stay(self, before: str, last: str) -> bool:
        """Whether both tokens stay as they are beside each other; before is empty where a pre-token begins."""
        found = self.beside.get((before, last))
        if found is None:
            if len(self.beside) >= self.memo_limit:
                self.beside.clear()
            want = [before, last] if before else [last]
            found = self.beside[before, last] = self.merged([x for t in want for x in self.symbols(t)]) == want
        return found

    def prefixes(self, letters: str) -> list[int]:
        """Tokens of each prefix of a pre-token, each ended as a pre-token is."""
        lasts, inner, ended = [""], [0], [0]
        for i in range(1, len(letters) + 1):
            here = outer = None
            for k in range(min(i, self.longest), 0, -1):
                part = letters[i - k : i]
                before = lasts[i - k]
                if before is None:
                    continue
                if here is None and part in self.tokens and self.stay(before, part):
                    here = part, inner[i - k] + 1
                if outer is None and part + self.end in self.tokens and self.stay(before, part + self.end):
                    outer = inner[i - k] + 1
                if here and outer:
                    break
            lasts.append(here[0] if here else None)
            inner.append(here[1] if here else 0)
            ended.append(outer)
        return ended

    def plain(self, chunk: str) -> bool:
        """Whether every character of the chunk is normalised on its own."""
        return all(any(a <= ord(c) <= b for a, b in ALONE) and c.isprintable() for c in chunk) and unicodedata.is_normalized("NFC", chunk)

    def chunk(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a chunk, in code points, the empty one first."""
        small = [c.lower() for c in chunk]
        text = "".join(small)
        counts, total = [0] * (len(text) + 1), 0
        for m in self.split.finditer(text):
            sizes = [len(c.encode()) for c in m[0]]
            ended = self.prefixes("".join([self.letters[b] for b in m[0].encode()]))
            for k, at in enumerate(accumulate(sizes), 1):
                # an apostrophe and one letter of a longer ending are two pre-tokens
                counts[m.start() + k] = total + (2 if m[0][0] == "'" and len(m[0]) == 3 and k == 2 else ended[at])
            total += ended[-1]
        return [counts[n] for n in accumulate(map(len, small), initial=0)]


class PrefixCounter:
    """Counts tokens of texts by chunk, with a bounded memo of chunks."""

    def __init__(self, vocabulary: str, memo_limit: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.merges = Merges(vocabulary)
        self.tables: dict[str, list[int]] = {}
        self.memo: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}
        self.memo_limit = memo_limit

    def _whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: bytes) -> int:
        if SPECIAL in chunk or not chunk.isascii() or not chunk.decode().isprintable():
            return self._whole(chunk.decode("utf-8", "replace"))
        n, pieces = 0, self.pieces
        for piece in ASCII_PIECES.findall(chunk.lower().decode()):
            k = pieces.get(piece)
            if k is None:
                if len(pieces) >= self.memo_limit:
                    pieces.clear()
                k = pieces[piece] = len(self.model.tokenize(piece))
            n += k
        return n

    def chunks(self, text: str) -> list[bytes]:
        data = text.encode("utf-8", "surrogatepass")
        return data.split() if SPECIAL in data else data.lower().split()

    def counts(self, chunks: list[bytes]) -> list[int]:
        """Tokens of each chunk. Only misses leave the dictionary lookup."""
        memo = self.memo
        found = list(map(memo.get, chunks))
        if None in found:
            if len(memo) >= self.memo_limit:
                memo.clear()
            for i, k in enumerate(found):
                if k is None:
                    chunk = chunks[i]
                    k = memo.get(chunk)
                    if k is None:
                        k = memo[chunk] = self._chunk(chunk)
                    found[i] = k
        return found

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of the chunks in code points, and the exact token count up to each."""
        ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        return ends, list(accumulate(self.counts(self.chunks(text))))

    def inside(self, chunk: str) -> list[int]:
        """Tokens of every prefix of one chunk, the empty one first.

        Chunks with special strings, or with characters that the normalizer may
        join, are the library's.
        """
        found = self.tables.get(chunk)
        if found is None:
            if "<|" in chunk or not self.merges.plain(chunk):
                found = [0] + [self._whole(chunk[:i]) for i in range(1, len(chunk) + 1)]
            else:
                found = self.merges.chunk(chunk)
            if len(chunk) <= 64:
                if len(self.tables) >= 100_000:
                    self.tables.clear()
                self.tables[chunk] = found
        return found

    def prefixes(self, text: str) -> np.ndarray:
        """The exact count at every prefix: entry i is that of text[:i]."""
        out, total, at = np.zeros(len(text) + 1, dtype=np.int32), 0, 0
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            own = self.inside(m[0])
            out[at : m.start() + 1] = total
            out[m.start() : m.end() + 1] = own
            out[m.start() : m.end() + 1] += total
            total, at = int(out[m.end()]), m.end()
        out[at:] = total
        return out

    def fits(self, text: str, budget: int, counts: list[int] | None = None) -> int:
        """The longest prefix, in code points, of at most budget tokens.

        Counts of prefixes need not grow with every character, but those of
        chunks do, so only the chunk that crosses the budget is looked into.
        counts are those up to the end of each chunk.
        """
        counts = list(accumulate(self.counts(self.chunks(text)))) if counts is None else counts
        if not len(counts) or counts[-1] <= budget:
            return len(text)
        k = bisect_right(counts, budget)
        m = next(islice(re.finditer(r"[^\x20\x09-\x0D]+", text), k, None))
        before = int(counts[k - 1]) if k else 0
        inner = self.inside(m[0])
        return m.start() + max(i for i, n in enumerate(inner) if before + n <= budget)


@functools.lru_cache(maxsize=2)
def counter(vocabulary: str) -> PrefixCounter:
    return PrefixCounter(vocabulary)


def _vocabulary(docs: DataFrame, path: str):
    """The vocabulary file is of fixed size (a few MB) and is broadcast."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 2048) -> DataFrame:
    """Token counts of whole texts, one row for each input row.

    Returns id_col, n_bytes, n_tokens, over_limit, budget_bytes: the UTF-8
    length, the exact count without added special tokens, whether it exceeds
    the budget, and the bytes of the longest prefix that still fits.
    A null text counts as empty; null ids are kept; repeated rows stay
    repeated; an empty table gives no rows; other columns are ignored. Long
    texts are counted whole.
    """
    vocabulary = _vocabulary(docs, vocabulary_path)
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType()), StructField("budget_bytes", LongType())])

    def make():
        count = counter(vocabulary.value)

        def step(batch):
            n_bytes, n_tokens, fits = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                chunks = count.chunks(text)
                prefix = np.cumsum(count.counts(chunks), dtype=np.int64) if chunks else np.zeros(0, np.int64)
                size = len(text.encode("utf-8", "surrogatepass"))
                total = int(prefix[-1]) if len(prefix) else 0
                n_bytes.append(size)
                n_tokens.append(total)
                fits.append(size if total <= budget else len(text[: count.fits(text, budget, prefix)].encode("utf-8", "surrogatepass")))
            return [batch.column(0), n_bytes, n_tokens, [n > budget for n in n_tokens], fits]

        return step

    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), schema, make)


def prefix_tables(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored prefix tables: id_col and tokens, an array of int.

    tokens[i] is the exact token count of the first i code points, from 0 to
    all of them. Null texts have an empty array.
    """
    vocabulary = _vocabulary(docs, vocabulary_path)
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("tokens", ArrayType(IntegerType()))])

    def make():
        count = counter(vocabulary.value)
        return lambda batch: [batch.column(0), [[] if t is None else count.prefixes(t) for t in batch.column(1).to_pylist()]]

    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), schema, make)


def tokens_at(tables: DataFrame, position: Column, tokens_col: str = "tokens") -> DataFrame:
    """tables with n_tokens, the count of the prefix of position code points; beyond the end, of the whole text."""
    return tables.withColumn("n_tokens", F.coalesce(F.get(tokens_col, F.least(position, F.size(tokens_col) - 1)), F.lit(0)))


def longest_within(tables: DataFrame, budget: Column, tokens_col: str = "tokens") -> DataFrame:
    """tables with n_chars, the longest prefix whose count is at most budget, read off the stored counts."""
    places = F.transform(tokens_col, lambda n, i: F.when(n <= budget, i).otherwise(0))
    return tables.withColumn("n_chars", F.coalesce(F.array_max(places), F.lit(0)))


def truncate(docs: DataFrame, vocabulary_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the longest prefix of each text that has at most budget tokens."""
    vocabulary = _vocabulary(docs, vocabulary_path)
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField(text_col, StringType())])

    def make():
        count = counter(vocabulary.value)

        def step(batch):
            return [batch.column(0), [None if t is None else t[: count.fits(t, budget)] for t in batch.column(1).to_pylist()]]

        return step

    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), schema, make)
