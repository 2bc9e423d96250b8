"""Token ids in wavelet matrices: one compressed file for each shard, read by rank and select.

A shard holds the ids of consecutive documents (ascending key) as bit-planes, highest bit
first; after each plane, ids with a 0 go before those with a 1, in order. A rank directory
every 512 bits makes any token, count or occurrence a walk over the planes.

Shards are written by Spark in the shared folder, one file each (a row with the planes and
the documents' keys and lengths, compressed), so any executor can read or rebuild one.
`start` is a sum over the shards' totals, one small row each.

A null text counts as empty and still has its end id. Null keys come first, repeated keys
stay rows, ordered by a hash of their text. An empty table gives no files' rows.
"""

from __future__ import annotations

import re
import string
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brinewave.llm.memory import Remembered
from brinewave.session import cut_lineage, job_dir

MAGIC = b"WVM1"
BLOCK = 512
SHARD_TOKENS = 1 << 22
#: Stretches that a worker remembers, some 200 bytes each.
REMEMBERED = 1_600_000
# white space other than the space, in Unicode (and what Python counts to it)
BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]
MARKS = ".,;:!?"
PUNCTUATION = string.punctuation
LETTERS_UNTIL = "\u2000"
#: Texts are encoded together, up to so many characters (or one longer text).
TOGETHER = 1 << 21
ROWS = "shard long, keys array<long>, lengths array<long>, tokens long, file binary"


def build(ids: np.ndarray, levels: int) -> bytes:
    """The file of one shard: a head, then per plane its number of zeros, its bits and its rank directory."""
    out, now = [MAGIC + struct.pack("<QI", len(ids), levels)], ids.astype("<u2" if levels <= 16 else "<u4")
    words = -(-max(1, len(ids)) // BLOCK) * BLOCK // 8
    for level in range(levels):
        ones = now & now.dtype.type(1 << (levels - 1 - level)) != 0
        packed = np.packbits(ones, bitorder="little")
        packed = np.concatenate([packed, np.zeros(words - len(packed), "u1")])
        each = np.bitwise_count(packed.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype="i8")
        ranks = np.concatenate([[0], np.cumsum(each)])
        now = np.concatenate([now.take(np.flatnonzero(~ones)), now.take(np.flatnonzero(ones))])
        out += [struct.pack("<Q", len(ids) - int(ranks[-1])), packed.tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(out)


class WaveletMatrix:
    """A shard's file, opened."""

    def __init__(self, file: bytes):
        if file[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.n, self.levels = struct.unpack_from("<QI", file, 4)
        words = -(-max(1, self.n) // BLOCK) * BLOCK // 8
        self.zeros, self.bits, self.ranks, at = [], [], [], 16
        for _ in range(self.levels):
            self.zeros.append(struct.unpack_from("<Q", file, at)[0])
            self.bits.append(np.frombuffer(file, "u1", words, at + 8))
            self.ranks.append(np.frombuffer(file, "<u8", words * 8 // BLOCK + 1, at + 8 + words))
            at += 8 + words + 8 * (words * 8 // BLOCK + 1)

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, more = divmod(i, BLOCK)
        part = self.bits[level][block * BLOCK // 8 : (i + 7) // 8].copy()
        if i % 8 and len(part):
            part[-1] &= (1 << i % 8) - 1
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum())

    def bit(self, level: int, i: int) -> int:
        return int(self.bits[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.levels):
            one = self.bit(level, i)
            token = token << 1 | one
            i = self.zeros[level] + self.rank1(level, i) if one else i - self.rank1(level, i)
        return token

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self.rank1(level, low), self.rank1(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often the token occurs at places low..high-1."""
        if token >> self.levels:
            return 0
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence; -1 if there are fewer."""
        if token >> self.levels:
            return -1
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in reversed(range(self.levels)):
            one = token >> (self.levels - 1 - level) & 1
            i = self._select(level, one, i - self.zeros[level] if one else i)
        return i

    def _select(self, level: int, one: int, k: int) -> int:
        ranks = self.ranks[level].astype("i8")
        if not one:
            ranks = np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(ranks, k, "right")) - 1
        bits = np.unpackbits(self.bits[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(ranks[block])])

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes undone from the last to the first."""
        now = np.zeros(self.n, "<u2" if self.levels <= 16 else "<u4")
        for level in reversed(range(self.levels)):
            ones = np.unpackbits(self.bits[level], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(now)
            zeros = self.zeros[level]
            back[np.flatnonzero(~ones)] = now[:zeros]
            back[np.flatnonzero(ones)] = now[zeros:] | now.dtype.type(1 << (self.levels - 1 - level))
            now = back
        return now


class Tokens:
    """Whole texts to ids by the tokenizers library, which is asked once for each stretch between single spaces.
    Special tokens in a text are what the library's plain call takes them for.

    A single space between two characters that are no white space always begins a
    pre-token, so stretches that begin there are encoded on their own.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.levels = max(2, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kind, self.code = ("<u2", "H") if self.levels <= 16 else ("<u4", "I")
        self.split = re.compile(r"(?<=\S) (?=\S)").split
        self.known = Remembered(REMEMBERED)
        self.tails: dict[str, bytes] = {}
        self.space, self.letters = self._alphabet()
        self.are_letters = frozenset(map(chr, self.letters)).issuperset
        self.plain = self.are_letters(string.ascii_letters)
        self.newline = self._ids("\n")

    def _alphabet(self) -> tuple[str, dict[int, str]]:
        """The space and the letters as the model spells them: those that the library joins to a letter before them. None if it
        changes texts first or knows added tokens of letters, marks and newlines that a word could hold.
        """
        added = (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        if self.tokenizer.normalizer or any(all(w.isalpha() or not w for w in (line.rstrip(PUNCTUATION) for line in t.split("\n"))) for t in added):
            return "", {}
        letters = "".join(c for c in map(chr, range(ord(LETTERS_UNTIL))) if c.isalpha())
        text = "".join(" a" + c for c in letters)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        space = pieces[0][0].partition("a")[0]
        return space, {ord(text[b - 1]): piece[len(space) + 1 :] for piece, (a, b) in pieces if b - a == 3 and text[a] == " " and piece.startswith(space + "a")}

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids. Stretches of all texts are numbered together, so one that they share is looked up once."""
        touching = [spaces_touch(t) for t in texts]
        cuts = [("", "", "") if odd else t.partition(" ") for t, odd in zip(texts, touching)]
        stretches = pc.split_pattern(pa.array([rest for _, space, rest in cuts if space], pa.string()), " ")
        numbered = stretches.flatten().dictionary_encode()
        values = list(self.known.values(numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), self._learn).values())
        ids = pa.array(values, pa.large_binary()).take(numbered.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy())])[stretches.offsets.to_numpy()].tolist()
        data = ids.buffers()[2]
        each = (data[a:b].to_pybytes() if b > a else b"" for a, b in zip(ends, ends[1:]))
        return [self._parts(self.split(t)) if odd else self._ids(first) + (next(each) if space else b"") for t, odd, (first, space, _) in zip(texts, touching, cuts)]

    def _parts(self, parts: list[str]) -> bytes:
        """The ids of one text's stretches."""
        ids = self.known.values(dict.fromkeys(parts[1:]), self._learn)
        return self._ids(parts[0]) + b"".join(map(ids.__getitem__, parts[1:]))

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new stretches; those with newlines seldom come again and are not remembered. Letters and the marks after them
        are two pre-tokens, and a single newline between words is one: the model is asked for the letters, the library's
        plain call for anything else."""
        found: dict[str, bytes] = {}
        known, others, are_letters, plain, word = self.known.new, [], self.are_letters, self.plain, self._word
        for part in new:
            core = part.rstrip(PUNCTUATION)
            if plain and core.isascii() and core.isalpha() or core and are_letters(core):
                if core == part:
                    ids = self._asked(core)
                else:
                    ids = word(core) + self._tail(part[len(core) :])
                known[part] = found[part] = ids
            elif "\n" in part and all(lines := [line.rstrip(PUNCTUATION) for line in part.split("\n")]) and all(map(are_letters, lines)):
                each = zip([lines[0], *["\n" + core for core in lines[1:]]], lines, part.split("\n"))
                found[part] = self.newline.join([word(key) + self._tail(line[len(core) :]) for key, core, line in each])
            else:
                others.append(part)
        if others:
            each = self.tokenizer.encode_batch_fast([" " + p for p in others], add_special_tokens=False)
            asked = {p: array(self.code, e.ids).tobytes() for p, e in zip(others, each)}
            known.update(asked)
            found.update(asked)
        return found

    def _word(self, key: str) -> bytes:
        """The ids of a pre-token of letters alone, after a space or (marked by a newline before it) after none."""
        known = self.known.new
        if (ids := known.get(key)) is None:
            if (ids := self.known.old.get(key)) is None:
                ids = self._asked(key)
            known[key] = ids
        return ids

    def _asked(self, key: str) -> bytes:
        spelt = key if key.isascii() else key.translate(self.letters)
        spelt = spelt[1:] if key[0] == "\n" else self.space + spelt
        return array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _tail(self, marks: str) -> bytes:
        """The ids of the marks after letters."""
        if marks and marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[marks] = self._ids(marks)
        return self.tails[marks] if marks else b""

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def spaces_touch(text: str) -> bool:
    """True if a space has white space beside it."""
    return "  " in text or any(c in text and (" " + c in text or c + " " in text) for c in BLANKS)


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One for each worker process, which keeps what it remembers from task to task."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str]]]:
    """The rows, as many at a time as are encoded together."""
    rows, held = [], 0
    for batch in batches:
        for key, text in zip(batch.column("key"), batch.column("text")):
            rows.append((key.as_py(), text.as_py()))
            held += len(rows[-1][1]) + 1
            if held >= TOGETHER:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _shards(path: str, end: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(path)
        last = np.array([end], coder.kind).tobytes()
        first, width = TaskContext.get().partitionId() << 32, np.dtype(coder.kind).itemsize
        keys: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        made = held = 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), coder.kind)
            row = {"shard": [first + made], "keys": [keys], "lengths": [lengths], "tokens": [len(ids)], "file": [build(ids, coder.levels)]}
            long = pa.int64()
            kinds = pa.schema([("shard", long), ("keys", pa.list_(long)), ("lengths", pa.list_(long)), ("tokens", long), ("file", pa.binary())])
            return pa.RecordBatch.from_pydict(row, schema=kinds)

        for rows in _together(batches):
            for (key, _), ids in zip(rows, coder.encode_all([text for _, text in rows])):
                keys.append(key)
                lengths.append(len(ids) // width + 1)
                parts += [ids, last]
                held += lengths[-1]
                if held >= most:
                    yield shard()
                    keys, lengths, parts = [], [], []
                    made, held = made + 1, 0
        if keys:
            yield shard()

    return run


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 2, most: int = SHARD_TOKENS) -> None:
    """Write the ids of all documents, each with the end id, in ascending key order; shards of about `most` ids."""
    plain = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    line = plain.withColumn("tie", F.xxhash64("text"))
    ordered = line.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    shards = ordered.mapInArrow(_shards(tokenizer or default_tokenizer(), end, most), ROWS)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (packed little-endian unsigned 32-bit) of every document, from the shards' files."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                shard, keys, lengths, file = (batch.column(c)[at] for c in ("shard", "keys", "lengths", "file"))
                ids = WaveletMatrix(file.as_py()).tokens().astype("<u4")
                ends = np.cumsum(lengths.values.to_numpy())
                starts = np.concatenate([[0], ends[:-1]])
                for i in range(0, len(ends), 500):
                    a, b = starts[i : i + 500], ends[i : i + 500]
                    raw = pa.array([ids[x:y].tobytes() for x, y in zip(a, b)], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(a), shard.as_py())), keys.values.slice(i, 500), pa.array(a), pa.array(b - a), raw],
                        ["shard", "doc_id", "place", "n_tokens", "ids"],
                    )

    table = spark.read.schema(ROWS).parquet(folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(table.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")))
    rows = table.mapInArrow(documents, "shard long, doc_id long, place long, n_tokens long, ids binary")
    return rows.join(starts, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    """Write to a new folder in the shared one and read that back."""
    folder = f"{job_dir(docs.sparkSession)}/wavelet-{uuid.uuid4().hex}"
    write(docs, folder, **options)
    return read(docs.sparkSession, folder)
