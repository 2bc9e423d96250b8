"""Operators on documents against plain Python, with odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brinewave.llm import bpe, mixing, pitman_yor, sanitising, simhash, suffixes, toxicity, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, _text string, spans string, ids string, `a.b` int"


def passage(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(n))


def odd_texts() -> list[str | None]:
    rng = random.Random(4)
    shared = passage(rng, 80)
    texts: list[str | None] = [passage(rng, rng.choice([1, 5, 60, 200])) for _ in range(40)]
    texts += [f"{passage(rng, 20)} {shared} {passage(rng, 9)}" for _ in range(6)]
    texts += [None, "", "   \n\t ", "a", shared, shared, shared + " x", "Ünïcode 漢字 🙂 don't  stop\n\n 'll", passage(rng, 9000), "z" * 3000]
    texts += ["mail bob.x@mail8.example.com or +1 (724) 555-7058 at 10.0.0.255, card 4111 1111 1111 1111"] * 2
    return texts


def row(i: int | None, text: str | None) -> tuple:
    return (i, text, "en", None if i is None else ["s1", "s0", "", None][i % 4], 7, 1, 0.5, "mine", "also", "too", 3)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(i, t) for i, t in enumerate(odd_texts())] + [row(None, "x y"), row(None, None), row(3, "dup"), row(3, "dup")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")


def same(got, want) -> None:
    assert collections.Counter(got) == collections.Counter(want)


def test_mixing(docs, empty):
    mixed = mixing.mix(docs, keep=docs.columns).collect()
    assert len(mixed) == docs.count() and mixed == mixing.mix(docs, keep=docs.columns).collect()
    words = collections.Counter()
    for r in docs.collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(words, key=lambda s: (s is None, s)))}
    target, open_, rest = {}, set(words), sum(words.values())
    while True:  # the plain form: cap, share again
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * words[s]}
        if not full:
            break
        target |= {s: 3 * words[s] for s in full}
        rest -= sum(3 * words[s] for s in full)
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    taken = collections.Counter()
    for r in mixed:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == words[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in words:
        assert abs(taken[s] - target[s]) <= 40 + 0.01 * target[s]
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns
    got = sum(len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for r in texts.collect())
    assert got == sum(taken.values())
    assert mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0


@pytest.mark.parametrize("scale", [1, 4, 16])
def test_small_sources_of_short_texts_meet_their_target(spark, scale):
    """A hundred documents of five words beside ever more long ones."""
    small = [(i, " ".join("abcde"), "b") for i in range(100)] + [(200 + i, "one two", "a") for i in range(7)]
    large = spark.range(1000, 1000 + 600 * scale).selectExpr("id as doc_id", "repeat('word ', 50) as text", "'c' as source")
    rows = mixing.mix(spark.createDataFrame(small, "doc_id long, text string, source string").unionByName(large), keep=["doc_id", "source"]).collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert target["b"] == 1500 and target["a"] == 42
    assert taken["b"] == pytest.approx(1500, rel=0.05) and taken["c"] == pytest.approx(target["c"], rel=0.01)
    assert abs(taken["a"] - 42) <= mixing.BLOCK


def test_highest_quotients(spark):
    from brinewave.llm.apportionment import sainte_lague

    rng = random.Random(1)
    for seats in (1, 7, 50):
        votes = {i: rng.choice([0, 1, 5, 5, 40, 1000]) for i in range(9)}
        rows = spark.createDataFrame([(1, i, v, seats) for i, v in votes.items()], "g int, i int, v long, s long")
        got = {r.i: r.n for r in sainte_lague(rows, ["g"], ["i"], "v", "s", "n").collect()}
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            want[max(votes, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert got == want


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 10), (300, 40)])
def test_bpe(docs, empty, library, chunk, overlap):
    got = bpe.encode(docs, raw="decoded", chunk=chunk, overlap=overlap)
    assert got.columns == [c for c in docs.columns if c not in ("text", "ids")] + ["ids", "decoded"]
    want = [(r.doc_id, packed(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect()]
    same([(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got.collect()], want)
    back = bpe.decode(got.drop("decoded")).collect()
    same([(r.doc_id, bytes(r.decoded)) for r in back], [(a, c) for a, _, c in want])
    assert bpe.encode(empty).count() == 0


def test_bpe_pieces(library):
    own = bpe.Encoder(bpe.default_ranks(), public_tokenizers.PATTERN)
    rng = random.Random(2)
    for n in (1, 30, 401, 5000):
        piece = "".join(rng.choice("abé0 ") for _ in range(n)).encode()
        assert own.merge(piece) == library._core_bpe.encode_single_piece(piece)


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n, levels in ((0, 4), (1, 4), (511, 4), (3000, 6)):
        ids = rng.integers(0, 1 << levels, n)
        matrix = wavelet.WaveletMatrix(wavelet.build(ids, levels))
        assert np.array_equal(matrix.tokens(), ids)
        for i in range(0, n, 97):
            assert matrix.access(i) == ids[i]
            low, high = sorted(rng.integers(0, n + 1, 2).tolist())
            assert matrix.count(int(ids[i]), low, high) == (ids[low:high] == ids[i]).sum()
            k = int((ids[:i] == ids[i]).sum())
            assert matrix.occurrence(int(ids[i]), k) == i
        assert matrix.occurrence(0, n) == -1 and matrix.count(1 << levels) == 0


@pytest.mark.parametrize("most", [wavelet.SHARD_TOKENS, 500])
def test_wavelet_files(docs, empty, most):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = wavelet.write_and_read(docs, most=most).collect()
    want = [(r.doc_id, packed(own.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in docs.collect()]
    same([(r.doc_id, bytes(r.ids)) for r in got], want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    keys = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert wavelet.write_and_read(empty).count() == 0


SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|> c.", "<|endoftext| >", "x  <|endoftext|>\n"]


def test_special_tokens_are_as_the_library_takes_them(spark):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.ids) for r in wavelet.write_and_read(rows).collect()}
    assert got == {i: packed(own.encode(t, add_special_tokens=False).ids + [2]) for i, t in enumerate(SPECIAL)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(bpe.default_ranks(), public_tokenizers.PATTERN).ranks, special_tokens={})
    ids = {r.doc_id: bytes(r.ids) for r in bpe.encode(rows).collect()}
    assert ids == {i: packed(plain.encode_ordinary(t)) for i, t in enumerate(SPECIAL)}


def test_what_is_remembered_is_bounded_and_right(monkeypatch):
    rng = random.Random(6)
    texts = [passage(rng, 60) for _ in range(60)] + [t for t in odd_texts() if t]
    plain = bpe.Encoder(bpe.default_ranks(), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain.ranks, special_tokens={})
    monkeypatch.setattr(bpe, "REMEMBERED", 100)
    monkeypatch.setattr(bpe, "REMEMBERED_PIECES", 60)
    monkeypatch.setattr(wavelet, "REMEMBERED", 100)
    small, tokens = bpe.Encoder(bpe.default_ranks(), public_tokenizers.PATTERN), wavelet.Tokens(wavelet.default_tokenizer())
    most = 50
    for text in texts:
        want = packed(own.encode_ordinary(text))
        assert plain.encode(text) == small.encode(text) == want
        assert np.frombuffer(tokens.encode(text), tokens.kind).astype("<u4").tobytes() == want
        most = max(most, len(set(text.split(" "))))  # a text's own stretches are there together
        assert len(small.stretches.new) <= most
    assert small.stretches.old and not plain.stretches.old


def test_texts_encoded_together_are_asked_for_once_and_right():
    """Words of several texts, with marks and newlines after them, cost one question each to the model."""
    tokens, asked = wavelet.Tokens(wavelet.default_tokenizer()), []
    own = tokens.tokenizer
    texts = ["Zorble zorble, zorble.\nZorble éçon *** \nx", "zorble éçon.\nZorble", "", " ", "zorble", "a  b zorble", "don't 12 zorble", "漢字 zorble\n\nzorble ﬁne"]
    once = tokens._asked
    tokens._asked = lambda key: asked.append(key) or once(key)
    got = tokens.encode_all(texts)
    assert [np.frombuffer(g, tokens.kind).tolist() for g in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.count("\nZorble") == 1 and asked.count("éçon") <= 2 and asked.count("zorble") <= 2
    before = len(asked)
    assert tokens.encode_all(texts) == got and len(asked) == before
    other = [chr(c) for c in tokens.letters]
    texts = [f"x {c}{c}. {c}\n{c} a{c}" for c in other]
    assert [np.frombuffer(g, tokens.kind).tolist() for g in tokens.encode_all(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_grams_are_dealt_evenly():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 105, 400_000).astype("u1").tobytes()
    found, (grams, counts), _ = suffixes.levels({"body": raw, "lengths": [len(raw)]})
    for parts in (16, 64, 480):
        sizes = [len(k.as_py()) for k in suffixes.ex.sent(0, 0, grams, counts, parts).column("keys")]
        mean = 8 * len(grams) / parts
        assert max(sizes) < 1.5 * mean + 6 * 8 * (len(grams) / parts) ** 0.5 if parts > 100 else max(sizes) < 1.5 * mean


def brute_runs(texts: list[bytes]) -> list[tuple]:
    starts = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if starts[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(t), tuple(np.flatnonzero(edge == 1)), tuple(np.flatnonzero(edge == -1)), np.frombuffer(t, "u1")[~gone].tobytes()))
    return out


def test_repeated_bytes(docs, empty, spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 9000)
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, brute_runs([(r.text or "").encode() for r in rows]))]
    got = suffixes.repeated(docs).collect()
    same([(r.key, r.n_bytes, tuple(r.starts), tuple(r.ends), bytes(r.kept)) for r in got], want)
    edge = ["a" * 199, "b" * 200, "c" * 201, "ab" * 150, "é" * 150] + [passage(random.Random(9), 300)] * 300
    got = suffixes.repeated(spark.createDataFrame(list(enumerate(edge)), "doc_id long, text string")).collect()
    want = brute_runs([t.encode() for t in edge])
    same([(r.key, tuple(r.starts), bytes(r.kept)) for r in got], [(i, x[1], x[3]) for i, x in enumerate(want)])
    assert suffixes.repeated(empty).count() == 0


def test_scores(docs, empty, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BATCH_BYTES", 20_000)
    token = {}
    for r in docs.collect():
        token.setdefault((r.doc_id, r.text), [w for w in re.split(rb"[\x20\x09-\x0d]+", (r.text or "").encode().lower()) if w] + [None])
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    rows = [(r.doc_id, token[r.doc_id, r.text]) for r in docs.collect()]
    count = collections.Counter(w for i, words in rows if not held(i) for w in words)
    n, v = sum(count.values()), len(count)
    want = [
        (i, held(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4))
        for i, w in rows
    ]
    scored = pitman_yor.score(docs)
    got = scored.collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got], want)
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert all(r.perplexity < r.base_perplexity for r in pitman_yor.perplexity(scored).collect())
    assert pitman_yor.score(empty).count() == 0


def test_scores_do_not_depend_on_the_number_of_parts(spark, monkeypatch):
    """Hot words are split over parts, their parents are not."""
    rng = np.random.default_rng(3)
    word = (rng.random(60_000) ** 3 * 400).astype(int)
    follows = np.where(rng.random(len(word)) < 0.5, np.roll(word, 1) * 7 % 400, word)
    table = spark.createDataFrame([(i, " ".join(f"w{x}" for x in follows[i::300])) for i in range(300)], "doc_id long, text string")
    found = []
    for parts in (1, 40):
        monkeypatch.setattr(pitman_yor.ex, "sizes", lambda spark, size, parts=parts: (parts, 8))
        found.append({r.held_out: r.perplexity for r in pitman_yor.perplexity(pitman_yor.score(table)).collect()})
    assert found[1][False] == pytest.approx(found[0][False], rel=0.01) and found[1][True] == pytest.approx(found[0][True], rel=0.01)


def test_probabilities_sum_to_one():
    """Over all known words and the unknown one, in every context that occurs."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(60)).encode() for _ in range(80)]
    row = {"body": b"".join(texts), "lengths": [len(t) for t in texts], "keys": list(range(80))}
    none = np.empty(0, "u8")
    batch = pitman_yor.Batch(row, none, 1)
    answers = list(pitman_yor.seated(pa.Table.from_batches([batch.rows(0)]), none, batch.trained.sum(), 1))
    near, totals = np.frombuffer(answers[0]["near"], "<f4"), np.frombuffer(answers[1]["near"], "<f8").reshape(2, -1)
    known, customers, roots, _ = np.frombuffer(answers[1]["words"], "<f8")
    k, c = np.frombuffer(answers[0]["parents"], "<f4"), np.frombuffer(answers[0]["words"], "<u8")
    d, s = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    seats = np.bincount(batch.pair_ctx, near, pitman_yor.CONTEXTS)
    assert seats + d * totals[0] == pytest.approx(totals[1], abs=1e-3)
    fresh = pitman_yor.PARENT_STRENGTH + pitman_yor.PARENT_DISCOUNT * roots
    parent = (k[c > 0].sum() + fresh) / (customers + pitman_yor.PARENT_STRENGTH)
    assert parent == pytest.approx(1, abs=1e-3) and known == (c > 0).sum()
    assert (seats + (s + d * totals[0]) * parent)[totals[1] > 0] == pytest.approx((totals[1] + s)[totals[1] > 0], rel=1e-3)


def test_seating_counts():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 2, 5, 70, 1000, 10**6])
    tables = pitman_yor.Seating(c, 0.5, rng)
    rate = np.full(len(c), 0.7)
    tables.arrive(rate)
    for _ in range(20):
        tables.sweep(rate)
        assert (tables.h >= 0).all() and (tables.t[c > 0] >= 1).all() and (tables.t <= c).all()
        small = tables.h[:, :-1] @ np.arange(1, pitman_yor.SIZES)
        assert (small[:3] <= tables.c[:3]).all() and tables.t[1] == 1


def test_a_sweep_seats_whole_dishes():
    """A sweep gives the distribution over all ways to seat a dish's customers."""

    def ways(n: int) -> list[list[int]]:
        if n == 1:
            return [[1]]
        return [x for w in ways(n - 1) for x in [w + [1], *([*w[:i], w[i] + 1, *w[i + 1 :]] for i in range(len(w)))]]

    near, grow, parent, d, n = 2.0, 0.75, 0.2, 0.75, 200_000
    want = np.zeros(8)
    for w in ways(7):
        want[len(w)] += np.prod([near + grow * k for k in range(len(w))]) * parent ** len(w) * np.prod([j - d for size in w for j in range(1, size)])
    rng = np.random.default_rng(2)
    t = pitman_yor.reseated(np.full(n, 7.0), np.full(n, near), grow, np.full(n, parent), d, rng)
    assert np.bincount(t.astype(int), minlength=8) / n == pytest.approx(want / want.sum(), abs=0.005)


@pytest.mark.parametrize("discount", [pitman_yor.DISCOUNT, pitman_yor.PARENT_DISCOUNT])
def test_sweeps_of_large_dishes(discount, monkeypatch):
    """The approximation against the exact distribution, for few tables and for many."""
    rng, n = np.random.default_rng(2), 4000
    for near, parent in ((9.0, 0.1), (400.0, 0.05), (3000.0, 0.1), (20_000.0, 0.2)):
        drawn = []
        for exact in (1024, 500):
            monkeypatch.setattr(pitman_yor, "EXACT", exact)
            monkeypatch.setattr(pitman_yor, "_STIRLING", {})
            drawn.append(pitman_yor.reseated(np.full(n, 1000.0), np.full(n, near), discount, np.full(n, parent), discount, rng))
        assert drawn[1].mean() == pytest.approx(drawn[0].mean(), rel=0.02, abs=0.1), (near, parent)
        assert drawn[1].std() == pytest.approx(drawn[0].std(), rel=0.1, abs=0.1), (near, parent)
    c = np.array([0.0, 1, 2, 70, 1024, 1025, 10**6])
    t = pitman_yor.reseated(c, np.full(7, 9.0), discount, np.full(7, 0.1), discount, rng)
    assert (t[:2] == c[:2]).all() and (t[2:] >= 1).all() and (t <= c).all()


def test_toxicity(spark, docs, empty, labels):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        words = passage(rng, rng.randint(5, 80)).split()
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["wortkloss", "grumpfish", "zankolith"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    z = toxicity.train(table.drop("toxic"), table.drop("text"))
    got = {r.doc_id: r for r in toxicity.scored(table, z).select("*", toxicity.held_out().alias("held")).collect()}
    held = [r for r in got.values() if r.held]
    assert sum((r.score >= 0.7) == r.toxic for r in held) >= 0.97 * len(held)
    assert (toxicity.scores(["grumpfissh", "wortklos"], z) > 10 * toxicity.scores(["quite", "gardens"], z)).all()
    odd = toxicity.scored(docs, z)
    assert odd.count() == docs.count() and odd.where("score between 0 and 1").count() == docs.count()
    assert odd.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert toxicity.scored(docs, toxicity.train(docs, labels.limit(0))).where("score = 0").count() == docs.count()
    assert toxicity.clean_documents(empty, labels).count() == 0


def plain_fingerprint(text: str | None, width: int) -> int:
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps: list[int], radius: int) -> list[int]:
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root


def brute_classes(fps: list[int], keys: list[int | None], radius: int) -> list[int | None]:
    root = brute_roots(fps, radius)
    known = collections.defaultdict(list)
    for r, k in zip(root, keys):
        if k is not None:
            known[r].append(k)
    return [min(known[r]) if known[r] else None for r in root]


def test_simhash(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text, 4) for r in rows]
    want = [(r.doc_id, f, c) for r, f, c in zip(rows, fps, brute_classes(fps, [r.doc_id for r in rows], 4))]
    got = simhash.near_duplicates(docs).collect()
    same([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got], want)
    kept = simhash.kept_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(brute_roots(fps, 4)))
    assert simhash.near_duplicates(empty).count() == simhash.kept_documents(empty).count() == 0


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 20])
def test_simhash_crowds(spark, monkeypatch, chunk):
    """Chains and crowds of fingerprints, also where meeting places are cut into chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for start in list(fps)[:3]:
        at = start
        for _ in range(60):
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.randrange(64)
            fps |= {at, start ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from brinewave.llm.components import components

    found = {r.node % (1 << 64): r.root % (1 << 64) for r in components(simhash.links(nodes)).collect()}
    want = brute_classes(fps, list(range(len(fps))), 4)
    groups, truth = collections.defaultdict(set), collections.defaultdict(set)
    for f, c in zip(fps, want):
        groups[found.get(f, f)].add(f)
        truth[c].add(f)
    same(map(frozenset, groups.values()), map(frozenset, truth.values()))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str | None) -> str:
    def good(kind: str, value: str) -> bool:
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
        return kind != "phone" or 8 <= len(digits) <= 15

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0]))


def test_base_spans(spark, docs, empty):
    rng = random.Random(2)
    alphabet = list("ab._%+-@  \n.0123456789é🙂\x01\x02()")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 5, 60, 600]))) for _ in range(300)]
    texts += ["a@b.c.d@e.f a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "4111 1111 1111 1111-", "7" * 20000, None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sanitising.find(table, keep=["doc_id"]).select("doc_id", F.filter("spans", lambda s: s["kind"] != "term").alias("s"))
    got = {r.doc_id: r.s for r in found.select("doc_id", sanitising.described(F.col("s")).alias("s")).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(texts)}
    odd = sanitising.find(docs)
    assert odd.count() == docs.count() and odd.columns == [c for c in docs.columns if c != "spans"] + ["spans"]
    hidden = sanitising.sanitised(docs)
    assert hidden.columns == docs.columns and hidden.where("text like '%[CARD]%'").count() == 2
    assert sanitising.find(empty).count() == sanitising.sanitised(empty).count() == 0


def test_disclosing_terms(spark):
    """A name that is only found beside one address discloses it; words that are everywhere do not."""
    rng = random.Random(3)
    rows = [(i, f"{passage(rng, 10)} about Zanderley write zander@mail1.example.com about {passage(rng, 10)}") for i in range(4)]
    rows += [(i, f"about {passage(rng, 30)} about") for i in range(4, 60)] + [(60, "Zander about nothing")]
    found = sanitising.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    terms = {r.doc_id: [s.value for s in r.spans if s.kind == "term"] for r in found}
    assert all("Zanderley" in terms[i] and "about" not in terms[i] for i in range(4))
    assert not any(terms[i] for i in range(4, 61))


def plain_terms(rows: list[tuple], support: int, share: float) -> dict:
    """doc_id to the places of terms, by counting every token of every text."""
    token = re.compile(r"[^\W_]+")
    masked, values = {}, {}
    for i, text in rows:
        body = list(text)
        values[i] = set()
        for span in plain_spans(text).split(","):
            if span:
                _, a, b = span.split(":")
                values[i].add(text[int(a) : int(b)])
                body[int(a) : int(b)] = " " * (int(b) - int(a))
        masked[i] = "".join(body)
    texts = {i: t for i, t in rows}
    inside = {i: {m[0].lower() for m in token.finditer(t)} for i, t in masked.items()}
    whole = collections.Counter(x for t in texts.values() for x in {m[0].lower() for m in token.finditer(t)})
    d, flagged = len(rows), collections.defaultdict(set)
    for e in set().union(*values.values()):
        mine = [i for i in values if e in values[i]]
        if len({texts[i] for i in mine}) < support:
            continue
        content = math.log(d / len(mine))
        for t in set().union(*(inside[i] for i in mine)):
            having = [i for i in mine if t in inside[i]]
            if len({texts[i] for i in having}) >= support and content > 0 and math.log(len(having) * d / (whole[t] * len(mine))) >= share * content:
                for i in mine:
                    flagged[i].add(t)
    return {i: [(m.start(), m.end()) for m in token.finditer(masked[i]) if m[0].lower() in flagged[i]] for i in texts}


def test_terms_of_any_length_and_distance(spark):
    """Short names, identifiers with digits, and names far from the value, against counting everything."""
    rng = random.Random(12)
    rows = [(i, f"Lee {passage(rng, 5)} zander@mail.example.com AB12 {passage(rng, 120)} Farawayname") for i in range(8)]
    rows += [(i, f"{passage(rng, 40)} 10.0.0.{i % 3} room {i % 5}, ÉTÉ {'x9' if i % 3 else 'y9'}") for i in range(8, 40)]
    rows += [(i, passage(rng, rng.choice([3, 60]))) for i in range(40, 200)] + [(200, ""), (201, rows[0][1]), (202, "+1 202 555 0100 " * 900)]
    found = sanitising.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in found}
    assert got == plain_terms(rows, sanitising.SUPPORT, sanitising.SHARE)
    for i in range(8):
        words = {rows[i][1][a:b] for a, b in got[i]}
        assert {"Lee", "AB12", "Farawayname"} <= words
    assert not got[100]


def test_pipeline(spark, docs, empty, labels, tmp_path, library):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "personal_data", "mixing", "bpe"]
    now = docs
    for name, stage in list(stages.items())[:-1]:
        now = corpus_pipeline.cut_lineage(stage(spark, now, folder))
        assert now.columns == docs.columns, name
        assert stage(spark, empty, folder).count() == 0, name
    want = [(r.doc_id, packed(library.encode_ordinary(r.text or ""))) for r in now.collect()]
    got = corpus_pipeline.run(spark, folder).collect()
    same([(r.doc_id, bytes(r.ids)) for r in got], want)
    assert all(hashlib.sha256(library.decode_bytes(np.frombuffer(r.ids, "<u4").tolist())).hexdigest() == r.decoded_sha256 for r in got)
    assert not [r for r in now.collect() if r.text and "@mail8" in r.text]
