"""Fill-in-the-middle on texts that are stored as seekable compressed frames.

A text is cut into stretches of FRAME code points, each an independent zstandard frame; beside the frames
lie the cumulative counts of code points (`units`) and of bytes (`places`). Any stretch of the text is read by
decompressing the frames at its two ends only: the frames between are copied as they are. The transformed
text is such a row of frames as well, so that neither it nor the text is ever whole in a task; digests stream
the frames in order, and the text is rebuilt from the output and its form alone.

    stored = store(docs)                      # n, marked, stored (frames)
    filled = fill_in_middle(stored)           # form, prefix_chars, middle_chars, filled (frames)
    filled.select(digest("filled"), restored_digest("filled", "form"))

A null text counts as empty; an empty text is plain and has no frame. A null key is hashed as the empty string. Rows
are independent: ties and repeated rows get equal results, an empty table gives no rows. Columns of the
documents stay, but for the text and those whose names an operator's own columns take.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from brinewave.functions.kernels import arrow_function
from brinewave.llm.rows import named
from brinewave.session import cut_lineage

FRAME = 1 << 16  # code points in a frame
LEVEL = 3
# The marks before prefix, suffix and middle.
P, S, M = "<P>", "<S>", "<M>"
#: The marks in the order of each form, and which section follows each.
ORDER = {"psm": (P, S, M), "spm": (S, P, M)}

SEEKABLE = "struct<units: array<bigint>, places: array<bigint>, body: binary>"
LISTS = pa.list_(pa.int64())


@functools.cache
def _press() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One pair for each worker: making them costs more than a short text."""
    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


class Writer:
    """Frames in the making: texts are joined until a frame is full, frames that are whole already are taken over."""

    def __init__(self, frame: int = FRAME):
        self.frame, self.held, self.waiting = frame, 0, []
        self.units, self.places, self.parts = [0], [0], []

    def text(self, piece: str) -> None:
        while piece:
            room = self.frame - self.held
            self.waiting.append(piece[:room])
            self.held += len(self.waiting[-1])
            piece = piece[room:]
            if self.held == self.frame:
                self.flush()

    def whole(self, compressed: bytes, n: int) -> None:
        self.flush()
        self._add(compressed, n)

    def flush(self) -> None:
        if self.held:
            self._add(_press()[0].compress("".join(self.waiting).encode()), self.held)
            self.held, self.waiting = 0, []

    def _add(self, compressed: bytes, n: int) -> None:
        self.parts.append(compressed)
        self.units.append(self.units[-1] + n)
        self.places.append(self.places[-1] + len(compressed))

    def done(self) -> tuple[list[int], list[int], bytes]:
        self.flush()
        return self.units, self.places, b"".join(self.parts)


class Frames:
    """A stored text, opened: read by code points, a frame at a time."""

    def __init__(self, units: list[int], places: list[int], body: bytes):
        self.units, self.places, self.body = units, places, memoryview(body)
        self.last = (-1, "")

    def __len__(self) -> int:
        return self.units[-1]

    def compressed(self, i: int) -> bytes:
        return bytes(self.body[self.places[i] : self.places[i + 1]])

    def decoded(self, i: int) -> str:
        if self.last[0] != i:
            self.last = (i, _press()[1].decompress(self.compressed(i)).decode())
        return self.last[1]

    def touched(self, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """Frames that hold units a..b-1, with the stretch wanted inside each."""
        i = bisect.bisect_right(self.units, a) - 1
        while a < b:
            first, end = self.units[i], self.units[i + 1]
            yield i, a - first, min(b, end) - first
            a, i = end, i + 1

    def pieces(self, a: int, b: int) -> Iterator[str]:
        for i, lo, hi in self.touched(a, b):
            yield self.decoded(i)[lo:hi]

    def copy(self, a: int, b: int, out: Writer) -> None:
        """Units a..b-1 to `out`: frames that lie inside are handed on compressed, only cut ones are opened."""
        for i, lo, hi in self.touched(a, b):
            n = self.units[i + 1] - self.units[i]
            if hi - lo == n and 4 * n >= out.frame:
                out.whole(self.compressed(i), n)
            else:
                out.text(self.decoded(i)[lo:hi])

    def find(self, marks: tuple[str, ...]) -> list[int]:
        """The place of the first mark, of the next one after it, and so on; marks may lie across frames."""
        found, at, before = [], 0, ""
        for i in range(len(self.units) - 1):
            seen = before + self.decoded(i)
            base = self.units[i] - len(before)
            while len(found) < len(marks):
                mark = marks[len(found)]
                if (hit := seen.find(mark, max(at - base, 0))) < 0:
                    break
                found.append(base + hit)
                at = base + hit + len(mark)
            before = seen[-2:]
        if len(found) < len(marks):
            raise ValueError("the output lacks a mark of its form")
        return found


def filled(text: Frames, form: str, first: int, second: int, frame: int = FRAME) -> Writer:
    """The output of a text whose middle is units first..second-1."""
    out = Writer(frame)
    if form == "plain":
        text.copy(0, len(text), out)
        return out
    section = {P: (0, first), S: (second, len(text)), M: (first, second)}
    for mark in ORDER[form]:
        out.text(mark)
        text.copy(*section[mark], out)
    return out


def restored(output: Frames, form: str) -> Iterator[str]:
    """The text, piece by piece, from an output and its form."""
    if form == "plain":
        yield from output.pieces(0, len(output))
        return
    marks = ORDER[form]
    at = output.find(marks)
    section = {m: (a + len(m), b) for m, a, b in zip(marks, at, [*at[1:], len(output)])}
    for mark in (P, M, S):
        yield from output.pieces(*section[mark])


def _opened(column: pa.Array) -> Iterator[Frames]:
    for units, places, body in zip(*(column.field(i) for i in range(3))):
        yield Frames(units.as_py(), places.as_py(), body.as_py())


def _framed(made: Iterator[Writer]) -> pa.Array:
    units, places, bodies = zip(*(w.done() for w in made)) if made else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(units, LISTS), pa.array(places, LISTS), pa.array(bodies, pa.binary())], names=["units", "places", "body"])


def _compressed(frame: int) -> Callable[..., Column]:
    @arrow_function(SEEKABLE)
    def run(texts: pa.Array) -> pa.Array:
        made = []
        for text in texts:
            made.append(Writer(frame))
            made[-1].text(text.as_py() or "")
            made[-1].flush()
        return _framed(made)

    return run


def _rearranged(frame: int) -> Callable[..., Column]:
    @arrow_function(SEEKABLE)
    def run(stored: pa.Array, forms: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        cuts = zip(_opened(stored), forms.to_pylist(), firsts.to_pylist(), seconds.to_pylist())
        return _framed([filled(text, form, a, b, frame) for text, form, a, b in cuts])

    return run


def _sha256(pieces: Iterator[str]) -> str:
    seen = hashlib.sha256()
    for piece in pieces:
        seen.update(piece.encode())
    return seen.hexdigest()


@arrow_function("string")
def digest(frames: pa.Array) -> pa.Array:
    """Lowercase hex SHA-256 of what the frames hold, streamed."""
    return pa.array([_sha256(f.pieces(0, len(f))) for f in _opened(frames)], pa.string())


@arrow_function("string")
def restored_digest(frames: pa.Array, forms: pa.Array) -> pa.Array:
    """The same of the text rebuilt from an output and its form."""
    return pa.array([_sha256(restored(f, form)) for f, form in zip(_opened(frames), forms.to_pylist())], pa.string())


@arrow_function("string")
def text_of(frames: pa.Array) -> pa.Array:
    """The whole text of frames, for those who want it in one row."""
    return pa.array(["".join(f.pieces(0, len(f))) for f in _opened(frames)], pa.string())


@arrow_function("string")
def restored_text(frames: pa.Array, forms: pa.Array) -> pa.Array:
    """The whole text rebuilt from an output and its form."""
    return pa.array(["".join(restored(f, form)) for f, form in zip(_opened(frames), forms.to_pylist())], pa.string())


def _others(columns: list[str], *own: str) -> list[Column]:
    return [named(c) for c in columns if c.lower() not in own]


def store(docs: DataFrame, text: str = "text", frame: int = FRAME) -> DataFrame:
    """The documents with their texts in frames (`stored`), written as a table in the shared folder; `n` counts code
    points, `marked` says that a text holds one of the marks itself."""
    whole = F.coalesce(named(text), F.lit(""))
    marked = whole.contains(P) | whole.contains(S) | whole.contains(M)
    own = [F.length(whole).cast("long").alias("n"), marked.alias("marked"), _compressed(frame)(named(text)).alias("stored")]
    return cut_lineage(docs.select(*_others(docs.columns, text.lower(), "n", "marked", "stored"), *own))


def _group(key: Column, i: int) -> Column:
    """The i-th group of eight hex digits of the key's hash, as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(stored: DataFrame, key: str = "doc_id", plain_from: int = 90, spm_below: int = 20, frame: int = FRAME) -> DataFrame:
    """Stored documents with form, prefix_chars, middle_chars (null if plain) and `filled`, the output's frames.

    Cuts and forms follow from the key's hash alone, so that reruns agree. Nothing is written here: the frames of
    the store are read and rearranged as the output is asked for.
    """
    h = [_group(named(key), i) for i in range(4)]
    cuts = [h[i] % (F.col("n") + 1) for i in (0, 1)]
    first, second = F.least(*cuts), F.greatest(*cuts)
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= plain_from)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    cut = F.struct(form.alias("form"), first.alias("first"), second.alias("second")).alias("_cut")
    others = _others(stored.columns, "n", "marked", "stored", "form", "prefix_chars", "middle_chars", "filled")
    ready = stored.select(*others, "n", "stored", cut)
    moved = F.col("_cut.form") != "plain"
    made = _rearranged(frame)(F.col("stored"), F.col("_cut.form"), F.col("_cut.first"), F.col("_cut.second"))
    return ready.select(
        *[named(c) for c in ready.columns if c not in ("stored", "_cut")],
        F.col("_cut.form").alias("form"),
        F.when(moved, F.col("_cut.first")).alias("prefix_chars"),
        F.when(moved, F.col("_cut.second") - F.col("_cut.first")).alias("middle_chars"),
        made.alias("filled"),
    )
