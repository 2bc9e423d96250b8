"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel and stitched, then pieces are encoded.

Pre-tokenisation has no memory: from a boundary on, its pieces depend on the text alone. Two
chunks that overlap therefore agree from the first boundary they share. A text longer
than `CHUNK` becomes overlapping chunks, rows of their own; in each overlap the first
common boundary is where the earlier chunk ends and the later one begins. A text
with an overlap without one (a single piece longer than `OVERLAP`) is pre-tokenised as a
whole. Every stitched range is then encoded piece by piece, and its ids go back to the text's row.

A null text counts as empty; empty texts have no ids; repeated rows and null keys are
ordinary rows. Unpaired surrogates cannot occur in Spark strings. Ids outside the ranks raise
when decoding.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from brinewave.llm.memory import Remembered
from brinewave.llm.rows import named, packed, unpacked
from brinewave.llm.wavelet import LETTERS_UNTIL, MARKS, spaces_touch
from brinewave.session import cut_lineage

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: No alternative of the pattern looks more than this many characters beyond a piece.
LOOK = 3
#: Encoded stretches, and pieces within them, that a worker remembers.
REMEMBERED, REMEMBERED_PIECES = 500_000, 300_000
NO_RANK = 1 << 60
#: Bytes of a piece from which on it is merged on its own.
LONG = 100
#: Documents in one batch of results.
ROWS = 200
#: Documents whose new pieces are merged together.
PREPARED = 5 * ROWS


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Pieces to packed ids (little-endian unsigned 32-bit), remembered within bounds, and back."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.stretches, self.pieces = Remembered(REMEMBERED), Remembered(REMEMBERED_PIECES)
        # a space alone between characters that are none always begins a piece where the pattern says so
        self.by_spaces = pattern == public_tokenizers.PATTERN
        self.alone = re.compile(r"(?<=\S) (?=\S)").split
        self.raw = [b""] * (max(self.ranks.values()) + 1)
        pairs: dict[int, int] = {}
        for piece, rank in self.ranks.items():
            self.raw[rank] = piece
            for i in range(1, len(piece)):
                if (a := self.ranks.get(piece[:i])) is not None and (b := self.ranks.get(piece[i:])) is not None:
                    pairs[a * len(self.raw) + b] = rank
        self.pairs = np.array(sorted(pairs), "i8")
        self.pair_ranks = np.array([pairs[x] for x in self.pairs.tolist()], "i8")
        self.single = np.array([self.ranks[bytes([x])] for x in range(256)], "i8")

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        return np.frombuffer(self.merged([piece])[0], "<u4").tolist()

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The pieces' packed ids: in each the pair with the lowest rank merges first, leftmost first. All pieces of a length take
        their next merge together."""
        out: list[bytes] = [b""] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[i] = np.array(_merged_long(piece, self.ranks), "<u4").tobytes()
            else:
                by_length.setdefault(len(piece), []).append(i)
        for n, places in by_length.items():
            raw = np.frombuffer(b"".join(pieces[i] for i in places), "u1").reshape(-1, n)
            for i, ids in zip(places, self._merged_together(self.single[raw])):
                out[i] = ids
        return out

    def _merged_together(self, ids: np.ndarray) -> list[bytes]:
        """Rows of ids, merged as far as they go."""
        out: list[bytes] = [b""] * len(ids)
        rows, ranks = np.arange(len(ids)), self.pair_rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            every = np.arange(len(rows))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), "i8")
            least = ranks[every, at] if ranks.shape[1] else np.full(len(rows), NO_RANK)
            done = least == NO_RANK
            if done.any():
                for row, left in zip(rows[done].tolist(), ids[done].astype("<u4")):
                    out[row] = left.tobytes()
                rows, ids, ranks, at, least = rows[~done], ids[~done], ranks[~done], at[~done], least[~done]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            ids[every, at] = least
            places = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, places + (places > at[:, None]), axis=1)
            places = places[:-1]
            ranks = np.take_along_axis(ranks, places + (places >= at[:, None]), axis=1)
            # the pairs before and behind the new token are new
            for move in (0, 1):
                some = np.flatnonzero((at - 1 + move >= 0) & (at + move < ids.shape[1]))
                a = at[some] - 1 + move
                ranks[some, a] = self.pair_rank(ids[some, a], ids[some, a + 1])
        return out

    def pair_rank(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of the token that two neighbours make."""
        code = first * len(self.raw) + second
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, self.pair_ranks[at], NO_RANK)

    def prepare(self, texts: list[str | dict]) -> None:
        """Learn what is new in many texts together."""
        if self.by_spaces:
            self.stretches.ready({p for x in texts if isinstance(x, str) for p in self._stretches(x)[1:]}, self._learn)

    def _stretches(self, text: str) -> list[str]:
        return self.alone(text) if spaces_touch(text) else text.split(" ")

    def encode(self, text: str, size: int | None = None) -> bytes:
        """The ids of the text; with `size`, of its pieces up to that boundary, the rest being there to look at."""
        if size is None and self.by_spaces:
            parts = self._stretches(text)
            first = self._pieces(self.split(parts[0])) if parts[0] else b""
            return first + self.stretches.joined(parts[1:], self._learn)
        pieces = self.split(text)
        if size is not None and size < len(text):
            pieces = pieces[: int(np.searchsorted(np.cumsum([len(p) for p in pieces]), size, "right"))]
        return self._pieces(pieces)

    def _pieces(self, pieces: list[str]) -> bytes:
        return self.pieces.joined(pieces, self._merge)

    def _learn(self, stretches: set[str]) -> None:
        plain, marked, others = [], [], []
        for x in stretches:
            word = x.rstrip(MARKS)
            # letters are a piece with the space before them, and the marks behind are one
            if not (word.isalpha() and max(word) < LETTERS_UNTIL):
                others.append((x, self.split(" " + x)))
            elif len(word) == len(x):
                plain.append(x)
            else:
                marked.append((x, " " + word, x[len(word) :]))
        new = {" " + x for x in plain}
        new.update(p for _, pieces in others for p in pieces)
        for _, word, marks in marked:
            new.add(word)
            new.add(marks)
        self.pieces.ready(new, self._merge)
        known, to = self.pieces.new, self.stretches.new
        to.update((x, known[" " + x]) for x in plain)
        to.update((x, known[word] + known[marks]) for x, word, marks in marked)
        to.update((x, b"".join(map(known.__getitem__, pieces))) for x, pieces in others)

    def _merge(self, pieces: set[str]) -> None:
        new = list(pieces)
        self.pieces.new.update(zip(new, self.merged([p.encode() for p in new])))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As Encoder.merge, by a heap over a linked list: for pieces of any length."""
    import heapq

    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] >= 0 else n
        if end[i] < 0 or j >= n or end[j] != stop:
            continue  # one of the two has merged since
        end[i], after[i], end[j] = stop, after[j], -1
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def replaced(df: DataFrame, column: str, new: list[str], make, prepare=None) -> DataFrame:
    """df with `column` replaced by the binary columns `new`, which make()(value) gives as a tuple; prepare(values) may see many before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                i = part.schema.get_field_index(column)
                values = part.column(i).to_pylist()
                if prepare and at % PREPARED == 0:
                    prepare(batch.slice(at, PREPARED).column(i).to_pylist())
                found = list(zip(*map(f, values)))
                kept = [c for c in part.schema.names if c != column]
                columns = [part.column(c) for c in kept] + [pa.array(x, pa.binary()) for x in found]
                yield pa.RecordBatch.from_arrays(columns, kept + new)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column]
    return df.mapInArrow(run, ", ".join(kept + [f"`{c}` binary" for c in new]))


def boundaries(text: str, split, start: int, last: bool) -> np.ndarray:
    """Piece boundaries that are certain, `start` being the text's offset."""
    ends = start + np.cumsum([0] + [len(p) for p in split(text)])
    return ends if last else ends[ends + LOOK <= start + len(text)]


def chunk_ranges(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """chunks(row, k, begin, last, part) -> adds `sync`: the first boundary it shares with the chunk before (its own
    begin for the first; null if there is none), and `stop`, the next chunk's sync (null for the last)."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                begin, last, part = (one.column(c)[0].as_py() for c in ("begin", "last", "part"))
                found = boundaries(part, split, begin, last)
                head, tail = found[found <= begin + overlap], found[found >= begin + chunk]
                yield one.append_column("head", pa.array([head], pa.list_(pa.int64()))).append_column("tail", pa.array([tail], pa.list_(pa.int64())))

    schema = "row long, k long, begin long, last boolean, part string, head array<long>, tail array<long>"
    line = Window.partitionBy("row").orderBy("k")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(line)))
    sync = F.when(F.col("k") == 0, F.col("begin")).otherwise(common)
    synced = chunks.mapInArrow(edges, schema).withColumn("sync", sync).drop("head", "tail")
    return synced.withColumn("stop", F.lead("sync").over(line))


def encode(
    docs: DataFrame, text: str = "text", ids: str = "ids", ranks: str | None = None, raw: str | None = None,
    pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """docs with `ids` (packed little-endian unsigned 32-bit) for `text`; with `raw`, also the bytes that decoding them gives."""
    path = ranks or default_ranks()
    rest = [c for c in docs.columns if c not in (text, ids, raw)]
    new = ["ids", "raw"] if raw else ["ids"]

    def code():
        own = encoder(path, pattern)

        def one(x: str | dict) -> tuple[bytes, ...]:
            found = own.encode(x) if isinstance(x, str) else own.encode(x["text"], x["size"])
            return (found, own.decode(found)) if raw else (found,)

        return one

    plain = docs.select(packed(rest), F.coalesce(named(text), F.lit("")).alias("text"))
    short = replaced(plain.where(F.length("text") <= chunk), "text", new, code, lambda values: encoder(path, pattern).prepare(values))

    long = cut_lineage(plain.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()))
    count = F.ceil(F.length("text") / chunk).cast("long")
    cut = long.select("row", "text", count.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("k"))
    begin = (F.col("k") * chunk).alias("begin")
    part = F.substring("text", (F.col("k") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("part")
    chunks = cut.select("row", "k", begin, (F.col("k") == F.col("n") - 1).alias("last"), part).repartition("row", "k")
    ranges = cut_lineage(chunk_ranges(chunks, pattern, chunk, overlap))
    lost = ranges.where(F.col("sync").isNull()).select("row").distinct()
    piece = F.expr("substring(part, cast(sync - begin + 1 as int))").alias("text")
    stitched = ranges.join(lost, "row", "left_anti").select("row", "k", piece, (F.col("stop") - F.col("sync")).alias("size"))
    whole = long.join(lost, "row", "left_semi").select("row", F.lit(0).cast("long").alias("k"), "text", F.lit(None).cast("long").alias("size"))
    coded = replaced(stitched.unionByName(whole).select("row", "k", F.struct("text", "size").alias("text")), "text", new, code)
    lists = coded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", *new))).alias("parts"))
    columns = F.struct(*[F.col("parts")[c].alias(c) for c in new]).alias("parts")
    joined = replaced(lists.select("row", columns), "parts", new, lambda: lambda x: tuple(b"".join(x[c]) for c in new))
    everything = short.unionByName(long.drop("text").join(joined, "row").select("_row", *new))
    return everything.select(*unpacked(rest), *[F.col(c).alias(n) for c, n in zip(new, [ids, raw])])


def decode(encoded: DataFrame, ids: str = "ids", raw: str = "decoded", ranks: str | None = None) -> DataFrame:
    """encoded with `raw`, the concatenated bytes of its tokens, instead of the ids."""
    path = ranks or default_ranks()
    rest = [c for c in encoded.columns if c not in (ids, raw)]
    rows = encoded.select(packed(rest), named(ids).alias("ids"))
    back = replaced(rows, "ids", ["raw"], lambda: lambda x: (encoder(path, public_tokenizers.PATTERN).decode(x or b""),))
    return back.select(*unpacked(rest), F.col("raw").alias(raw))
