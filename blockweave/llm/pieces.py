"""Sampled SentencePiece segmentation: forward filtering, backward sampling.

The lattice of a text holds every vocabulary piece that matches at every
place. Forward filtering sums the weights of all paths up to each place;
backward sampling draws the pieces from the end, each in proportion to the
weight of the paths it closes. The draw at a place is a hash of the row key, the
seed and the place, so a row is segmented alike on every run and any executor.

Where no piece holds two neighbouring characters, no path crosses between them:
a text is cut there into units, mostly words. Many texts are worked on at once:
the tables of each different unit of a chunk are made in one go, and all its
occurrences draw from them side by side. Nothing is kept between chunks.
Characters outside the vocabulary become byte pieces, and so does a space mark
that stands in the text itself, so that decoding gives back every text.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import map_batches
from .rolling import CHUNK, code_points, scatter, span_hashes

#: The mark that stands for a space in pieces.
MARK = "▁"
#: Units of up to so many code points are worked on side by side, in tables of these widths; longer ones alone.
WIDTHS = (1, 2, 4, 8, 16, 32, 64)
#: Numbers that a table may hold.
TABLE = 1 << 20
#: Code points of a longer unit that are held at a time.
STRETCH = 1 << 14
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Stands in the output where no piece begins; -2 - c and below for the bytes of character c.
NONE = -1


def row_key(key: int, seed: int) -> np.uint64:
    mixed = scatter(np.array([(key * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))
    return mixed[0]


def draws(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each row key and place."""
    z = scatter(scatter(keys + places.astype(np.uint64) * GOLDEN) + GOLDEN)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Lattice:
    """The pieces of a model as arrays, and sampled segmentations of texts."""

    def __init__(self, model: bytes, theta: float, widest: int = WIDTHS[-1]):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.widest = widest
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        normal = [i for i, p in enumerate(self.pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        low = min(sp.get_score(i) for i in normal)
        # scores are ranks: scaled so that the rarest piece weighs exp(-theta), times a price for each piece
        self.weight = {self.pieces[i]: ((i,), math.exp(theta * (sp.get_score(i) / -low - 1.0)) if low else math.exp(-theta)) for i in normal}
        self.byte_weight = math.exp(-2 * theta)
        self.plain = {i: p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)} | {i: bytes([b]) for b, i in self.bytes.items()}
        shown = [(p.replace(MARK, " "), ids[0], w) for p, (ids, w) in self.weight.items()]
        self.longest = max(len(p) for p, _, _ in shown)
        # numbers of the characters of pieces; 0 is any other
        letters = sorted({c for p, _, _ in shown for c in p})
        self.letter = np.zeros(0x110000, dtype=np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        # the pieces as a tree: sorted edges node * letters + letter -> node, and each node's piece
        edges: dict[int, int] = {}
        ends = [(0, 0.0)]
        for piece, i, w in shown:
            node = 0
            for c in self.letter[[ord(c) for c in piece]].tolist():
                edge = node * self.letters + c
                node = edges.get(edge)
                if node is None:
                    node = edges[edge] = len(ends)
                    ends.append((0, 0.0))
            ends[node] = (i, w)
        self.edges = np.array(sorted(edges), dtype=np.int64)
        self.child = np.array([edges[e] for e in self.edges.tolist()], dtype=np.int64)
        self.end_id = np.array([e[0] for e in ends], dtype=np.int32)
        self.end_weight = np.array([e[1] for e in ends])
        # neighbouring characters that some piece holds, among those that stand in any such pair
        inner = {(x, y) for p, _, _ in shown for x, y in zip(p, p[1:])}
        paired = sorted({c for pair in inner for c in pair})
        self.pair = np.zeros(0x110000, dtype=np.int32)
        self.pair[[ord(c) for c in paired]] = np.arange(1, len(paired) + 1)
        self.inner = np.zeros((len(paired) + 1, len(paired) + 1), dtype=bool)
        for x, y in inner:
            self.inner[self.pair[ord(x)], self.pair[ord(y)]] = True

    def matches(self, letters: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """For each piece length less one: the rows and ends in letters (rows x places) where such pieces end, and their nodes."""
        rows, starts = np.nonzero(np.arange(letters.shape[1]) < lengths[:, None])
        nodes = np.zeros(len(rows), dtype=np.int64)
        for k in range(min(self.longest, letters.shape[1])):
            inside = starts + k < lengths[rows]
            rows, starts, nodes = rows[inside], starts[inside], nodes[inside]
            edge = nodes * self.letters + letters[rows, starts + k]
            at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            known = self.edges[at] == edge
            rows, starts, nodes = rows[known], starts[known], self.child[at[known]]
            whole = self.end_weight[nodes] > 0
            yield rows[whole], starts[whole] + k + 1, k, nodes[whole]

    def tables(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each unit, end and piece length less one: the share of paths up to that end that close with such a piece or a shorter one; and its id."""
        grid = codes[np.minimum(starts[:, None] + np.arange(width), len(codes) - 1)]
        letters, k_most = self.letter[grid], min(self.longest, width)
        # units stand last while sums are made, so that each step runs along them
        weight = np.zeros((width + 1, k_most, len(starts)))
        ids = np.full((len(starts), width + 1, k_most), NONE, dtype=np.int32)
        for rows, ends, k, nodes in self.matches(letters, lengths):
            weight[ends, k, rows] = self.end_weight[nodes]
            ids[rows, ends, k] = self.end_id[nodes]
        places, rows = np.nonzero((weight[1:, 0] == 0) & (np.arange(width)[:, None] < lengths))
        weight[places + 1, 0, rows] = self.byte_weight
        ids[rows, places + 1, 0] = -2 - grid[rows, places].astype(np.int32)
        # forward sums of the last ends, relative to the last one: long units never leave the range of floats
        recent = np.zeros((k_most, len(starts)))
        recent[0] = 1.0
        for end in range(1, width + 1):
            upto, most = weight[end], min(end, k_most)
            upto[:most] *= recent[:most]
            for k in range(1, most):
                upto[k] += upto[k - 1]
            upto[most:] = upto[most - 1]
            total = np.where(upto[-1] > 0, upto[-1], 1.0)
            upto /= total
            recent[1 : most + 1] = recent[:most][: k_most - 1] / total
            recent[0] = 1.0
        return np.ascontiguousarray(weight.transpose(2, 0, 1)), ids

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a unit begins at each place, from what stands before it."""
        pair = self.pair[codes]
        out = np.ones(len(codes), dtype=bool)
        out[1:] = ~self.inner[pair[:-1], pair[1:]]
        return out

    def sample(self, codes: np.ndarray, first: np.ndarray, keys: np.ndarray, offset: int, begins: np.ndarray) -> np.ndarray:
        """The piece that begins at each place of texts put together, NONE where none does.

        first are the places where the texts begin and keys their row keys;
        offset is added to places in the text, begins marks the units.
        """
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(codes)))
        owner = np.searchsorted(first, starts, "right") - 1
        places, keys = starts - first[owner] + offset, keys[owner]
        out = np.full(len(codes), NONE, dtype=np.int32)
        short = np.flatnonzero(lengths <= self.widest)
        _, example, kind = np.unique(span_hashes(codes, starts[short], starts[short] + lengths[short]), return_index=True, return_inverse=True)
        # equal hashes are no proof: units that differ from their example stand for themselves
        wrong = lengths[short] != lengths[short][example][kind]
        near = np.where(wrong, 0, lengths[short])
        offsets = np.arange(near.sum()) - np.repeat(np.cumsum(near) - near, near)
        same = codes[np.repeat(starts[short], near) + offsets] == codes[np.repeat(starts[short][example][kind], near) + offsets]
        wrong[np.repeat(np.arange(len(near)), near)[~same]] = True
        kind[wrong] = len(example) + np.arange(wrong.sum())
        example = short[np.concatenate([example, np.flatnonzero(wrong)])]
        order = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(len(example) + 1))
        width_of = np.searchsorted(WIDTHS, lengths[example])
        for w, width in enumerate(WIDTHS):
            of_width = np.flatnonzero(width_of == w)
            step = max(1, TABLE // ((width + 1) * min(width, self.longest)))
            for at in range(0, len(of_width), step):
                some = of_width[at : at + step]
                upto, ids = self.tables(codes, starts[example[some]], lengths[example[some]], width)
                counts = bounds[some + 1] - bounds[some]
                table = np.repeat(np.arange(len(some)), counts)
                units = short[order[np.repeat(bounds[some], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]]
                end, start, place, key = lengths[units], starts[units], places[units], keys[units]
                while len(end):
                    k = (upto[table, end] <= draws(key, place + end)[:, None]).sum(axis=1)
                    left = end - 1 - k
                    out[start + left] = ids[table, end, k]
                    more = left > 0
                    table, end, start, place, key = table[more], left[more], start[more], place[more], key[more]
        for unit in np.flatnonzero(lengths > self.widest).tolist():
            a, n = int(starts[unit]), int(lengths[unit])
            out[a : a + n] = self.sample_long(codes[a : a + n], keys[unit], int(places[unit]))
        return out

    def closing(self, codes: np.ndarray, a: int, b: int) -> list[list[tuple[int, float, int]]]:
        """(length less one, weight, id) of the pieces that close at each end in a+1 .. b of one unit."""
        low = max(0, a - self.longest)
        part = codes[low:b]
        out: list[list] = [[] for _ in range(b - a)]
        for _, ends, k, nodes in self.matches(self.letter[part][None, :], np.array([len(part)])):
            for end, w, i in zip((ends + low - a - 1).tolist(), self.end_weight[nodes].tolist(), self.end_id[nodes].tolist()):
                if end >= 0:
                    out[end].append((k, w, i))
        for end, here in enumerate(out):
            if not here or here[0][0]:
                here.insert(0, (0, self.byte_weight, -2 - int(codes[a + end])))
        return out

    def sample_long(self, codes: np.ndarray, key: np.uint64, place: int) -> np.ndarray:
        """The same for one unit of any length, a stretch at a time: forward over all, then again from the last to the first."""
        n = len(codes)
        out = np.full(n, NONE, dtype=np.int32)
        recent, kept = [1.0] + [0.0] * (self.longest - 1), []

        def forward(a: int, recent: list[float]) -> tuple[list[float], list[list[tuple[float, int, int]]]]:
            rows = []
            for here in self.closing(codes, a, min(n, a + STRETCH)):
                total, row = 0.0, []
                for k, w, i in here:
                    total += recent[k] * w
                    row.append((total, k, i))
                rows.append([(upto / total, k, i) for upto, k, i in row])
                recent = [1.0, *[x / total for x in recent[:-1]]]
            return recent, rows

        for a in range(0, n, STRETCH):
            kept.append(recent)
            recent, _ = forward(a, recent)
        end = n
        for a in reversed(range(0, n, STRETCH)):
            _, rows = forward(a, kept.pop())
            u = draws(np.full(len(rows), key), place + a + 1 + np.arange(len(rows))).tolist()
            while end > a:
                k, i = next((k, i) for upto, k, i in rows[end - a - 1] if upto > u[end - a - 1])
                end -= 1 + k
                out[end] = i
        return out

    def spelled(self, sampled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with bytes in place of other characters, and their places in what sample() gave."""
        places = np.flatnonzero(sampled != NONE)
        ids = sampled[places]
        other = ids < NONE
        if not other.any():
            return ids, places
        codes, kind = np.unique(-2 - ids[other], return_inverse=True)
        spelt = [[self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in codes.tolist()]
        counts = np.ones(len(ids), dtype=np.int64)
        counts[other] = np.array([len(x) for x in spelt])[kind]
        out, begin = np.repeat(ids, counts), np.cumsum(counts) - counts
        table = np.array([x + [0] * (4 - len(x)) for x in spelt], dtype=np.int32)
        for k in range(4):
            has = counts[other] > k
            out[begin[other][has] + k] = table[kind[has], k]
        return out, np.repeat(places, counts)

    def encode_many(self, texts: list[str], keys: list[int], seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of one sampled segmentation of each text, put together, and how many each has.

        A text is led by a space, as the model's own encoder does.
        """
        flat, counts, held, total = [], np.zeros(len(texts), dtype=np.int64), [], 0

        def flush():
            nonlocal total
            if held:
                codes = code_points("".join([" " + texts[k] for k in held]))
                first = np.cumsum([0, *[len(texts[k]) + 1 for k in held[:-1]]])
                begins = self.cuts(codes)
                begins[first] = True
                ids, places = self.spelled(self.sample(codes, first, np.array([row_key(keys[k], seed) for k in held]), 0, begins))
                flat.append(ids)
                counts[held] = np.bincount(np.searchsorted(first, places, "right") - 1, minlength=len(held))
            held.clear()
            total = 0

        for k, text in enumerate(texts):
            if total + len(text) >= CHUNK:
                flush()
            if len(text) >= CHUNK:
                for ids in self.encode_long(text, row_key(keys[k], seed)):
                    flat.append(ids)
                    counts[k] += len(ids)
            elif text:
                held.append(k)
                total += len(text) + 1
        flush()
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), counts

    def encode_long(self, text: str, key: np.uint64) -> Iterator[np.ndarray]:
        """The ids of a text beyond a chunk, cut where units begin."""
        codes = code_points(" " + text)
        at = 0
        while at < len(codes):
            end, reach = len(codes), CHUNK
            while at + reach < len(codes):
                cuts = np.flatnonzero(self.cuts(codes[at : at + reach])[1:])
                if len(cuts):
                    end = at + 1 + int(cuts[-1])
                    break
                reach *= 2
            part = codes[at:end]
            if len(part) > CHUNK:  # one unit, or the rest after it
                begins = self.cuts(part)
                inside = np.flatnonzero(begins[1:])
                end = at + (int(inside[0]) + 1 if len(inside) else len(part))
                sampled = self.sample_long(codes[at:end], key, at)
            else:
                sampled = self.sample(part, np.zeros(1, np.int64), np.array([key]), at, self.cuts(part))
            yield self.spelled(sampled)[0]
            at = end

    def encode(self, text: str, key: int, seed: int) -> list[int]:
        return self.encode_many([text], [key], seed)[0].tolist()

    def decode(self, ids: list[int]) -> str:
        data = b"".join([self.plain[i] for i in ids])
        return data[1:].decode("utf-8", "surrogatepass") if data[:1] == b" " else data.decode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=1)
def lattice(model: bytes, theta: float) -> Lattice:
    return Lattice(model, theta)


def _model(df: DataFrame, path: str):
    """The model file is of fixed size (below 1 MB) and is broadcast."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, id_col="doc_id", text_col="text", theta: float = 6.0, seed: int = 0) -> DataFrame:
    """id_col, pieces (array of int), n_pieces for every row of docs.

    The row key is a hash of the id. Empty texts give no pieces; null texts
    null pieces with n_pieces 0; rows that repeat an id and a text are
    segmented alike, and different texts of one id share its draws; texts of any
    length are worked on a chunk at a time, runs without a cut a stretch at a
    time; other columns are ignored; an empty table gives no rows. decode()
    gives back every text.
    """
    model = _model(docs, model_path)
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("pieces", ArrayType(IntegerType(), False)), StructField("n_pieces", LongType())])

    def make():
        own = lattice(model.value, theta)

        def step(batch):
            texts = batch.column(2).to_pylist()
            flat, counts = own.encode_many([t or "" for t in texts], batch.column(1).to_pylist(), seed)
            values, offsets = pa.array(flat), np.concatenate(([0], np.cumsum(counts)))
            valid = [t is None for t in texts]
            pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(valid))
            return [batch.column(0), pieces.cast(pa.list_(pa.field("element", pa.int32(), nullable=False))), counts]

        return step

    return map_batches(docs.select(F.col(id_col), F.xxhash64(F.col(id_col)), F.col(text_col).cast("string")), schema, make)


def decode(encoded: DataFrame, model_path: str, id_col="doc_id", pieces_col="pieces", text_col="text") -> DataFrame:
    """id_col and the text of each row of pieces; null pieces give a null text."""
    model = _model(encoded, model_path)
    schema = StructType([StructField(id_col, encoded.schema[id_col].dataType), StructField(text_col, StringType())])

    def make():
        own = lattice(model.value, 6.0)
        return lambda batch: [batch.column(0), [None if p is None else own.decode(p) for p in batch.column(1).to_pylist()]]

    return map_batches(encoded.select(id_col, pieces_col), schema, make)
