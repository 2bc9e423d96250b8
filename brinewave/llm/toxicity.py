"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word's bag holds its character 3- to 6-grams (with marks for its ends, hashed into
`BUCKETS` shared rows of the embedding), so a misspelling shares most of its vector with the word
it comes from. The average of a bag goes through a linear softmax of two classes.
Labels belong to documents: a document is clean if all of its words are, so
training multiplies the words' clean probabilities (embeddings and softmax are
updated jointly), and the score of a document is that of its most toxic word.

The fit uses labelled documents of at most `longest` characters, `per_class` of each label, in the order
of a seeded hash of their ids; every whole text is scored. Only texts are inputs.

Null and empty texts and texts without words score the model's prior word, near zero.
Null ids count as empty text for the split. Without training rows of both labels all
scores are 0. Repeated rows are scored alike; labels repeated for an id count as toxic if one is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brinewave.llm.rows import named, packed, unpacked

BUCKETS = 1 << 18
WIDTH = 16
GRAMS = (3, 4, 5, 6)
THRESHOLD = 0.7
PRIOR = -8.0
#: Bytes scored in one call.
STEP = 1 << 20

# letters, digits and bytes beyond ASCII make words; A-Z count as a-z
_MAP = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)], "u1")


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(3)) == 1


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of the texts with blanks around words; start and end of each word, and its text."""
    raw = _MAP[np.frombuffer(b" " + b" ".join(texts) + b" " * 8, "u1")]
    inside = raw != 32
    step = np.diff(inside.view("i1"))
    starts, ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    begins = 1 + np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    return raw, starts, ends, np.searchsorted(begins, starts, "right") - 1


def gram_rows(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each length n the embedding row of the n-gram that starts at every byte."""
    h = np.zeros(len(raw), "u4")
    wide = raw.astype("u4")
    for n in range(1, GRAMS[-1] + 1):
        h[: len(raw) - n + 1] = h[: len(raw) - n + 1] * np.uint32(0x01000193) + wide[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            mixed = h * np.uint32(0x9E3779B1)
            yield n, (mixed >> np.uint32(14)) & np.uint32(BUCKETS - 1)


def word_logits(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The average of z over each word's bag."""
    total, count = np.zeros(len(starts)), np.zeros(len(starts), "i8")
    for n, rows in gram_rows(raw):
        run = np.concatenate([[0.0], np.cumsum(z[rows], dtype="f8")])
        grams = np.maximum(0, ends - starts + 3 - n)
        total += run[starts - 1 + grams] - run[starts - 1]
        count += grams
    return total / np.maximum(1, count)


def scores(texts: list[str | None], z: np.ndarray | None) -> np.ndarray:
    """The score of each text."""
    if z is None:
        return np.zeros(len(texts))
    best = np.full(len(texts), PRIOR)
    coded = [(t or "").encode() for t in texts]
    at = 0
    while at < len(coded):
        stop, size = at, 0
        while stop < len(coded) and (stop == at or size + len(coded[stop]) <= STEP):
            size += len(coded[stop])
            stop += 1
        raw, starts, ends, owner = words_of(coded[at:stop])
        if len(starts):
            np.maximum.at(best, at + owner, word_logits(raw, starts, ends, z) + PRIOR)
        at = stop
    return 1 / (1 + np.exp(-best))


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 150, rate: float = 0.3, decay: float = 1e-3, power: float = 0.75, seed: int = 5) -> np.ndarray | None:
    """z: each embedding row's contribution to the toxic logit, after joint training of embeddings and softmax."""
    if not len(texts) or toxic.min() == toxic.max():
        return None
    raw, starts, ends, owner = words_of([t.encode() for t in texts])
    # each distinct word once, with the documents it occurs in
    names, word = np.unique([bytes(raw[a:b]) for a, b in zip(starts, ends)], return_inverse=True)
    pairs = np.unique(owner.astype("i8") * len(names) + word)
    doc, word = pairs // len(names), pairs % len(names)
    raw, starts, ends, _ = words_of(list(names))
    rows, lengths = [], np.zeros(len(names), "i8")
    for n, at in gram_rows(raw):
        grams = np.maximum(0, ends - starts + 3 - n)
        offset = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
        rows.append((np.repeat(np.arange(len(names)), grams), at[np.repeat(starts - 1, grams) + offset]))
        lengths += grams
    bag, row = (np.concatenate(x) for x in zip(*rows))
    used, row = np.unique(row, return_inverse=True)
    rng = np.random.default_rng(seed)
    emb, out = rng.normal(0, 0.1, (len(used), WIDTH)), rng.normal(0, 0.5, (WIDTH, 2))
    pace, speed = [np.zeros_like(emb), np.zeros_like(out)], [0.0, 0.0]
    weight = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
    for step in range(rounds):
        u = out[:, 1] - out[:, 0]
        s = np.bincount(bag, (emb @ u)[row], len(names)) / lengths + PRIOR
        s = np.clip(s, -30, 30)
        p = 1 / (1 + np.exp(-s))
        unclean = np.bincount(doc, np.logaddexp(0, s)[word], len(texts))  # -log of the clean probability
        slope = np.where(toxic == 1, -1 / np.expm1(np.clip(unclean, 1e-9, 500)), 1.0) * weight
        g = p * np.bincount(word, slope[doc], len(names)) / lengths
        c = np.bincount(row, g[bag], len(used))
        du = emb.T @ c
        # one scale for all rows, so that what many documents share moves first
        for i, (value, grad) in enumerate(((emb, np.outer(c, u)), (out, np.column_stack([-du, du])))):
            pace[i] = 0.8 * pace[i] + 0.2 * grad
            speed[i] = max(0.8 * speed[i], float(np.abs(pace[i]).max()))
            share = np.abs(pace[i]) / (speed[i] + 1e-12)
            value -= rate * (1 - step / rounds) * (np.sign(pace[i]) * share**power + decay * value)
    z = np.zeros(BUCKETS, "f4")
    z[used] = emb @ (out[:, 1] - out[:, 0])
    return z


def sample(docs: DataFrame, labels: DataFrame, per_class: int, longest: int, key: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray]:
    """At most 2 * per_class labelled training texts, a bounded sample, on the driver."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(3), F.col(key).cast("string"))
    parts = [
        known.where((F.col("toxic") == c) & ~held_out(key)).orderBy(order, key).limit(2 * per_class).select(F.col(key).alias("_id"), "toxic")
        for c in (0, 1)
    ]
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).where(F.length("text").between(1, longest))
    found = texts.join(F.broadcast(parts[0].unionByName(parts[1])), "_id")  # at most 4 * per_class ids
    rows = []
    for c in (0, 1):
        one = found.where(F.col("toxic") == c).orderBy(F.xxhash64(F.lit(3), F.col("_id").cast("string")), "_id", "text")
        rows += one.limit(per_class).select("text", "toxic").collect()
    return [r.text for r in rows], np.array([r.toxic for r in rows], "i8")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1000, longest: int = 12_000, **names: str) -> np.ndarray | None:
    return fit(*sample(docs, labels, per_class, longest, **names))


def scored(docs: DataFrame, z: np.ndarray | None, text: str = "text", score: str = "score") -> DataFrame:
    """docs with `score` for every whole text; it takes the place of a column of that name."""
    names = [c for c in docs.columns if c != score]
    return _scored(docs, z, text, names).select(*unpacked(names), F.col("_score").alias(score))


def _scored(docs: DataFrame, z: np.ndarray | None, text: str, names: list[str]) -> DataFrame:
    """_row (the named columns) and _score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = pa.array(scores(part.column("_text").to_pylist(), z))
                yield pa.RecordBatch.from_arrays([part.column("_row"), found], ["_row", "_score"])

    both = docs.select(packed(names), named(text).alias("_text"))
    return both.mapInArrow(run, f"_row {both.schema['_row'].dataType.simpleString()}, _score double")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **names: str) -> DataFrame:
    """The documents that score below the threshold, with the columns of docs."""
    z = train(docs, labels, **names)
    kept = _scored(docs, z, names.get("text", "text"), docs.columns).where(F.col("_score") < threshold)
    return kept.select(*unpacked(docs.columns))
