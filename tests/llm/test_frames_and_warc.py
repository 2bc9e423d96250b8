"""Seekable frames and WARC archives: round trips, plain forms of the contract, odd rows, damaged files."""

from __future__ import annotations

import base64
import hashlib
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brinewave.llm import frames, warc

TEXTS = [None, "", "a", "é漢🙂", "plain <P> in it", "ends with <", "<", "<S", "x" * 500, "ab<M>c", "line\n" * 90, "🙂" * 333]


def plain_form(key: int | None, text: str | None) -> tuple:
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    if h4 % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame", [1, 7, 64, frames.FRAME])
def test_outputs_equal_the_plain_form(spark, frame):
    rows = [(i * 100 + j, t, 1, "f", "s", 2) for i, t in enumerate(TEXTS) for j in range(12)] + [(None, t, 1, "f", "s", 2) for t in TEXTS] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string, stored string, `a.b` int")
    made = frames.fill_in_middle(frames.store(docs, frame=frame), frame=frame)
    got = made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", frames.text_of("filled").alias("output"), frames.digest("filled").alias("sha"),
        frames.restored_text("filled", "form").alias("back"), frames.restored_digest("filled", "form").alias("back_sha"), F.col("`a.b`").alias("kept"),
    ).collect()
    want = sorted((repr((r[0], *plain_form(r[0], r[1]), r[1] or "", 2)) for r in rows))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back, r.kept)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert r.sha == hashlib.sha256(r.output.encode()).hexdigest() and r.back_sha == hashlib.sha256(r.back.encode()).hexdigest()


def test_only_cut_frames_are_opened(monkeypatch):
    out = frames.Writer(10)
    text = "".join(random.Random(2).choice("abcdé") for _ in range(205))
    out.text(text)
    stored = frames.Frames(*out.done())
    opened = []
    real = frames.Frames.decoded
    monkeypatch.setattr(frames.Frames, "decoded", lambda self, i: (opened.append(i), real(self, i))[1])
    made = frames.filled(stored, "psm", 33, 101, 10)
    assert set(opened) == {3, 10}
    assert "".join(frames.restored(frames.Frames(*made.done()), "psm")) == text
    assert "".join(stored.pieces(7, 23)) == text[7:23]


def test_an_output_without_its_marks_is_refused():
    out = frames.Writer()
    out.text("<P>no others")
    with pytest.raises(ValueError, match="mark"):
        list(frames.restored(frames.Frames(*out.done()), "psm"))


def test_frames_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert frames.fill_in_middle(frames.store(none)).select(frames.digest("filled")).collect() == []


# ---- archives

PAGES = "page_id long, url string, html string, kind string, payload string, `x.y` int"


def pages_of(spark, rows):
    return spark.createDataFrame([(k, u, h, "mine", "also", 1) for k, u, h in rows], PAGES).repartition(5)


def rows_of_pages() -> list[tuple]:
    rng = random.Random(8)
    bodies = [None, "", "short", "é漢🙂\r\n\r\n0\r\n\r\n", "WARC/1.1\r\n", "long " * 4000] + [f"<html>{rng.random()}</html>" * rng.randint(1, 300) for _ in range(30)]
    rows = [(i, f"http://h/{i}\r\nX: y z", b) for i, b in enumerate(bodies)]
    rows += [(1000 + i, None, "copied " * 50) for i in range(300)]  # copies of one page hold most rows
    return rows + [(None, None, "copied " * 50), (None, "u", "no id"), (None, "u", "no id"), (2, "again", "short"), (5, "x", "other"), (7, "y", None)]


def plain_pages(rows: list[tuple], min_bytes: int) -> list[tuple]:
    found, first = [], {}
    for k, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        shared = len(data) >= min_bytes and data in first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        found.append((k, len(data), digest, "revisit" if shared else "response", first[data] if shared else None))
        first.setdefault(data, k)
    return sorted(map(repr, found))


@pytest.mark.parametrize("sizes", [{}, {"segment": 50, "chunk": 7, "most": 3000}, {"segment": 1000, "min_bytes": 100, "most": 1}])
def test_pages_come_back(spark, tmp_path, sizes):
    rows = rows_of_pages()
    folder = f"file://{tmp_path}/a"
    warc.write(pages_of(spark, rows), folder, **sizes)
    got = warc.read(spark, folder, payloads=True).collect()
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == plain_pages(rows, sizes.get("min_bytes", 0))
    known = {(k, (h or "").encode()) for k, _, h in rows}
    assert all((r.page_id, bytes(r.payload)) in known for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def manifest(spark, folder: str):
    return spark.read.parquet(f"{folder}/manifest")


def test_segments_lie_in_several_files_and_losses_are_seen(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write(pages_of(spark, [(1, "u", "body " * 5000)]), folder, segment=2000, most=1)
    files = [r.file for r in manifest(spark, folder).collect()]
    assert len(files) == 13
    kinds = [next(warc.file_records(f))[0] for f in files]
    assert sorted(int(h["warc-segment-number"]) for h in kinds) == list(range(1, 14))
    assert [h["warc-segment-origin-id"] for h in kinds if h["warc-type"] == "continuation"] == [h["warc-record-id"] for h in kinds if h["warc-type"] == "response"] * 12
    middle = next(f for f, h in zip(files, kinds) if h["warc-segment-number"] == "5")
    with pytest.raises(Exception, match="missing or repeated"):
        warc.read_files(manifest(spark, folder).where(F.col("file") != middle)).collect()
    last = next(f for f, h in zip(files, kinds) if h["warc-segment-number"] == "13")
    with pytest.raises(Exception, match="missing or repeated"):
        warc.read_files(manifest(spark, folder).where(F.col("file") != last)).collect()


def test_damaged_files_are_refused(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write(pages_of(spark, [(1, "u", "body " * 500)]), folder)
    [path] = [r.file for r in manifest(spark, folder).collect()]
    plain = b"".join(warc.inflated(iter([open(path, "rb").read()])))
    for name, data in (("cut", plain[:-200]), ("changed", plain.replace(b"body", b"bodi", 1))):
        other = os.path.join(tmp_path, name + ".warc")
        with open(other, "wb") as f:
            f.write(data)
        with pytest.raises(ValueError, match="ends within|another digest"):
            list(warc.file_records(other))


def test_files_that_no_manifest_names_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write(pages_of(spark, [(1, "u", "x")]), folder)
    with open(f"{folder}/archive/left-behind.warc.gz", "wb") as f:
        f.write(b"half a file")
    assert warc.read(spark, folder).count() == 1


def test_framing():
    for data in (b"", b"a", b"0\r\n\r\n" * 9, bytes(range(256)) * 40):
        for size in (1, 7, 10_000):
            assert warc.unchunked(warc.chunked(data, size)) == data
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError, match="cut short"):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_text_ids_and_an_empty_table(spark, tmp_path):
    some = spark.createDataFrame([("a:b >c", "u", "x"), ("", "u", "x"), (None, "u", "x")], "page_id string, url string, html string")
    warc.write(some, str(tmp_path / "a"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "a"), key_type="string").collect()}
    assert got == {"": ("response", None), "a:b >c": ("revisit", ""), None: ("revisit", "")}
    warc.write(pages_of(spark, []), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).collect() == []


def test_schema_of_rows():
    assert [f.name for f in warc.ARROW_ROW] == [x.split()[0] for x in warc.ROW.split(", ")]
    assert pa.types.is_binary(warc.ARROW_ROW.field("block").type)
