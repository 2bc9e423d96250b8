"""LM scoring with a hierarchical Pitman-Yor model.

Every token's restaurant is its context: the token before it, hashed into `CONTEXTS`
restaurants. All share one parent, the restaurant of single words, which draws from a base measure
(half on unknown words, half evenly on the V known ones). Customers are the training tokens.
Seating is a Chinese-restaurant process: arrivals one by one, then Gibbs sweeps in which every customer
of a dish leaves and all are seated again, in contexts and then in their parent; only the dish's number of
tables matters, and is drawn from its exact distribution (a saddle-point approximation above `EXACT` customers). The terms of the predictive probability are averaged over the
samples after burn-in.

The corpus is counted by exchange of packed arrays (exchange.py has the idea): a batch of
documents sends each distinct (word, context) once, with its training count, to the task
of its word, which has all customers of the word, seats them and answers with the
averages. Words above a share of 1/`HOT` of all tokens (so fewer than `HOT`
of them) are split by context among the tasks. Before each step the driver sums the tables of all contexts
(`CONTEXTS` numbers) and of all hot words over the parts and seats the hot words' parents, and all parts take
the step with these sums; so rates do not depend on the number of parts. Within a step they stay as they are. No table that grows with the data is broadcast, and no word,
document or pair makes a large group.

Nulls count as empty: such a text is its end token alone; a null id is as empty text for the split.
Repeated rows are scored alike. Without training tokens every score is that of unknown words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brinewave.llm import exchange as ex
from brinewave.session import cut_lineage

CONTEXTS = 1 << 14
HOT = 10_000
BATCH_BYTES = 4 << 20
DISCOUNT, STRENGTH = 0.75, 2.0  # of the contexts
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 50.0
UNKNOWN = 0.5
BURN, SAMPLES = 2, 3
SIZES = 8
#: Dishes with up to so many customers are drawn whole and exactly in a sweep; weights held at once.
EXACT = 1024
CELLS = 1 << 20
#: Tables of a larger dish that count as few.
FEW = 512
_STIRLING: dict[float, np.ndarray] = {}
#: Dishes handled at once.
STEP = 1 << 16
END = np.uint64(0x51ED270B7F4A7C15)
U = np.uint64

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], "u1")
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[bool, np.ndarray] = {}
#: Bytes whose words are named at once.
PIECE = 1 << 16

SENT = "part int, batch long, names binary, sizes binary, ctx binary, counts binary"
SUMS = "near binary, words binary, parents binary"
BUILT = f"part int, every binary, w binary, u binary, c binary, batches binary, pairs binary, pair_ends binary, own binary, own_ends binary, {SUMS}"
STATE = f"part int, tables binary, seats binary, t_p binary, kept binary, roots binary, {SUMS}"
BACK = f"batch long, part int, {SUMS}"
#: Rows in which a step's sums reach the driver.
GROUPS = 8


def arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])


def powers(n: int, inverse: bool) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse, modulo 2^64."""
    if len(_POWERS.get(inverse, ())) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        out = np.ones(1 << n.bit_length(), "u8")
        done = 1
        while done < len(out):
            out[done : 2 * done] = out[:done] * U(pow(base, done, 1 << 64))
            done *= 2
        _POWERS[inverse] = out
    return _POWERS[inverse][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def tokens(body: bytes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens in order, each document's end included, and the document of each."""
    ends = np.cumsum(lengths, dtype="i8")
    texts = [body[b - n : b] for b, n in zip(ends.tolist(), lengths)]
    line = _LOWER[np.frombuffer(b" ".join([*texts, b" "]), "u1")]  # a blank after each document
    edge = np.diff(_BLANK[line].view("i1"), prepend=1)
    first, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    names = np.empty(len(first), "u8")
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(line), PIECE)), len(first)))
    for i, j in zip(cuts, cuts[1:]):
        low, high = first[i], stop[j - 1]
        run = np.zeros(high - low + 1, "u8")
        np.cumsum((line[low:high].astype("u8") + U(1)) * powers(int(high - low), False), out=run[1:])
        a, b = first[i:j] - low, stop[i:j] - low
        names[i:j] = mixed((run[b] - run[a]) * powers(int(high - low), True)[a] + (b - a).astype("u8"))
    doc = np.searchsorted(ends + np.arange(len(ends)), first, "left")  # the blank after a document closes it
    out = np.full(len(names) + len(lengths), END, "u8")
    out[np.arange(len(names)) + doc] = names
    per = np.bincount(doc, minlength=len(lengths)) + 1
    return out, np.repeat(np.arange(len(lengths)), per)


def held_out(keys: list) -> np.ndarray:
    return np.array([zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k in keys], bool)


class Batch:
    """A batch's distinct words, and its distinct (word, context) in the order in which they are sent."""

    def __init__(self, row: dict, hot: np.ndarray, parts: int):
        self.names, self.doc = tokens(row["body"], row["lengths"])
        start = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])
        before = np.where(start, END, np.roll(self.names, 1))
        self.ctx = (mixed(before + U(7)) >> U(50)).astype("i8") % CONTEXTS
        self.trained = ~held_out(row["keys"])[self.doc]
        self.words, word = np.unique(self.names, return_inverse=True)
        code, pair = np.unique(word * CONTEXTS + self.ctx, return_inverse=True)
        w, c = code // CONTEXTS, code % CONTEXTS
        spread = np.isin(self.words, hot)[w]
        mark = mixed(np.where(spread, self.words[w] + (c.astype("u8") + U(1)) * U(_BASE), self.words[w]))
        part = (((mark >> U(32)) * U(parts)) >> U(32)).astype("i8")
        order = np.argsort(part, kind="stable")
        self.part, self.pair_word, self.pair_ctx = part[order], w[order], c[order]
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        self.pair, self.word = place[pair], word
        self.counts = np.bincount(self.pair, self.trained, len(order)).astype("<u4")
        # a word once in each part that it is sent to
        new = np.concatenate([[True], (np.diff(self.pair_word) != 0) | (np.diff(self.part) != 0)])
        self.heads = np.flatnonzero(new)

    def rows(self, number: int) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(self.part) != 0, [True]]))
        heads = np.append(self.heads, len(self.part))
        at = np.searchsorted(heads, cuts)
        names, sizes = self.words[self.pair_word[self.heads]], np.diff(heads).astype("<u4")
        cut = lambda x, edges: pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.part[cuts[:-1]].astype("i4")), pa.array(np.full(len(cuts) - 1, number)),
                cut(names, at), cut(sizes, at), cut(self.pair_ctx.astype("<u2"), cuts), cut(self.counts, cuts),
            ],
            ["part", "batch", "names", "sizes", "ctx", "counts"],
        )


class Seating:
    """Tables of dishes in restaurants: how many of each size 1 .. SIZES-1, and how many larger ones.

    A dish with one customer has one table, always; only the others are kept.
    """

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator):
        self.once, self.many = customers > 0, np.flatnonzero(customers > 1)
        self.c, self.d, self.rng = customers[self.many], discount, rng
        self.h = np.zeros((len(self.many), SIZES), "f4")

    @property
    def t(self) -> np.ndarray:
        """Tables of every dish."""
        out = self.once.astype("f8")
        out[self.many] = self.h.sum(axis=1, dtype="f8")
        return out

    def arrive(self, rate: np.ndarray) -> None:
        """Seats all customers one by one; beyond 64 in leaps that double, in which new tables are Poisson."""
        rate = rate[self.many]
        self.h[:, 0] = 1
        for i in range(1, 64):
            who = np.flatnonzero(self.c > i)
            if not len(who):
                return
            self._seat(who, np.full(len(who), float(i)), rate[who])
        i = 64.0
        while len(who := np.flatnonzero(self.c > i)):
            m = np.minimum(i, self.c[who] - i)
            share = rate[who] / (rate[who] + i + m / 2 - self.d * self.h[who].sum(axis=1))
            self.h[who, 0] += self.rng.poisson(np.clip(share, 0, 1) * m)
            i *= 2

    def _seat(self, who: np.ndarray, present: np.ndarray, rate: np.ndarray) -> None:
        """One customer for each of `who`, where `present` others sit: a new table by `rate`, or one by its size less the discount."""
        for at in range(0, len(who), STEP):
            self._seat_some(who[at : at + STEP], present[at : at + STEP], rate[at : at + STEP])

    def _seat_some(self, who: np.ndarray, present: np.ndarray, rate: np.ndarray) -> None:
        h = self.h[who]
        small = h[:, :-1] * (np.arange(1, SIZES) - self.d)
        large = np.maximum(0, present - h[:, :-1] @ np.arange(1, SIZES) - self.d * h[:, -1]) * (h[:, -1] > 0)
        edges = np.cumsum(np.column_stack([rate, small, large]), axis=1)
        pick = (self.rng.random(len(who)) * edges[:, -1])[:, None]
        chosen = np.minimum((edges <= pick).sum(axis=1), SIZES)
        new, grown = chosen == 0, (chosen > 0) & (chosen < SIZES)
        self.h[who[new], 0] += 1
        self.h[who[grown], chosen[grown] - 1] -= 1
        self.h[who[grown], chosen[grown]] += 1

    def sweep(self, rate: np.ndarray) -> None:
        """Gibbs: a customer of every dish with two or more leaves and is seated again."""
        rate = rate[self.many]
        for at in range(0, len(self.many), STEP):
            who = np.arange(at, min(at + STEP, len(self.many)))
            h = self.h[who]
            small = h[:, :-1] * np.arange(1, SIZES)
            edges = np.cumsum(np.column_stack([small, np.maximum(0, self.c[who] - small.sum(axis=1)) * (h[:, -1] > 0)]), axis=1)
            chosen = np.minimum((edges <= (self.rng.random(len(who)) * edges[:, -1])[:, None]).sum(axis=1), SIZES - 1)
            known = chosen < SIZES - 1  # a larger table stays one of the larger
            self.h[who[known], chosen[known]] -= 1
            shrunk = known & (chosen > 0)
            self.h[who[shrunk], chosen[shrunk] - 1] += 1
            self._seat(who, self.c[who] - 1.0, rate[who])


def _log_stirling(discount: float) -> np.ndarray:
    """log S(c, t), up to a number for each c, of the ways to seat c customers at t tables (row c, column t - 1)."""
    if discount not in _STIRLING:
        table = np.full((EXACT + 1, EXACT), -np.inf, "f4")
        line, t = np.full(EXACT, -np.inf), np.arange(1, EXACT + 1)
        line[0] = 0
        table[1] = line
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in range(1, EXACT):
                stay = np.where(t <= c, line + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
                line = np.logaddexp(stay, np.append(-np.inf, line[:-1]))
                table[c + 1] = line - line.max()
                line = table[c + 1].astype("f8")
        _STIRLING[discount] = table
    return _STIRLING[discount]


def reseated(c: np.ndarray, near: np.ndarray, grow: float, parent: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Gibbs: every customer of every dish leaves and is seated again; gives the new tables of the dishes.

    Without the dish's own tables a new one weighs `near` times `parent`, and each table of the dish adds
    `grow` to `near`; so t tables have the probability prod(near + k grow, k < t) parent^t S(c, t), drawn from directly, by
    approximation where there are more than EXACT customers.
    """
    out = np.minimum(c, 1).astype("f8")
    many = np.flatnonzero((c > 1) & (c <= EXACT))
    many = many[np.argsort(c[many], kind="stable")]
    stirling, at = _log_stirling(discount), 0
    while at < len(many):
        width = int(c[many[at]])
        # dishes of nearly this size, so many that the weights stay small
        stop = min(at + max(1, CELLS // width), np.searchsorted(c[many], width + width // 8, "right"))
        who = many[at:stop]
        width = int(c[who[-1]])
        weight = np.log((near[who, None] + grow * np.arange(width, dtype="f4")).astype("f4") * parent[who, None].astype("f4"))
        np.cumsum(weight, axis=1, out=weight)
        weight += stirling[c[who].astype("i8"), :width]
        weight -= weight.max(axis=1, keepdims=True)
        np.exp(weight, out=weight)
        np.cumsum(weight, axis=1, out=weight)
        pick = (rng.random(len(who)) * weight[:, -1])[:, None]
        out[who] = np.minimum((weight <= pick).sum(axis=1) + 1, c[who])
        at = stop
    large = np.flatnonzero(c > EXACT)
    for at in range(0, len(large), CELLS // FEW):
        who = large[at : at + CELLS // FEW]
        out[who] = _reseated_large(c[who].astype("f8"), near[who], grow, parent[who], discount, rng)
    return out


def _reseated_large(c: np.ndarray, near: np.ndarray, grow: float, parent: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """The same for many customers: S(c, t + 1) / S(c, t) is (1 - y^d) / (d t) at the saddle point y of its generating function.

    Few tables are drawn from their weights, many from a normal distribution around the likeliest number.
    """
    tables = lambda y: c * (1 - y**d) * y ** (1 - d) / (d * (1 - y))
    gain = lambda t, y: np.log((near + grow * t) * parent * (1 - y**d) / (d * t))  # noqa: E731  # of one table more
    low, high = np.full(len(c), -500.0), np.full(len(c), -1e-9)  # log y; the gain falls as y and t rise
    for _ in range(60):
        middle = (low + high) / 2
        y = np.exp(middle)
        up = gain(tables(y), y) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    ends = [np.exp(np.minimum(middle + x, -1e-10)) for x in (-1e-3, 1e-3)]
    rise = [gain(tables(y), y) for y in ends]
    spread = np.sqrt((tables(ends[1]) - tables(ends[0])) / np.maximum(rise[0] - rise[1], 1e-12))
    mode = tables(np.exp(middle))
    out = np.rint(mode + spread * rng.standard_normal(len(c)) + 0.5)
    few = mode + 10 * spread < FEW
    if few.any():
        k, c_few = np.arange(1, FEW)[None, :], c[few, None]
        y = np.zeros((len(c_few), FEW - 1))
        for _ in range(4):
            y = (k * d / c_few * (1 - y) / (1 - y**d)) ** (1 / (1 - d))
        step = np.log((near[few, None] + grow * k) * parent[few, None] * (1 - y**d) / (d * k))
        weight = np.cumsum(np.column_stack([np.zeros(len(c_few)), step]), axis=1)
        weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        out[few] = (weight <= (rng.random(len(c_few)) * weight[:, -1])[:, None]).sum(axis=1) + 1
    return np.clip(out, 1, c)


class Part:
    """The customers of one part: its dishes (word, context), and the parents of words that are not spread."""

    def __init__(self, every: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray, hot: np.ndarray):
        self.every, self.w, self.u, self.c = every, w.astype("i8"), u.astype("i8"), c.astype("f8")
        self.c_w = np.bincount(self.w, self.c, len(every))
        self.spread = np.isin(every, hot)
        self.place = np.searchsorted(hot, every[self.spread])
        self.t_p, self.seats, self.kept, self.roots = np.zeros(len(every)), np.zeros(len(c)), np.zeros(len(every)), np.zeros(len(every))
        self.t = np.zeros(len(c))

    @staticmethod
    def fixed(table: pa.Table) -> dict:
        """What one part was sent: distinct words, its dishes, and the places of each batch's entries among them."""
        get = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(c)]
        names, sizes, ctx, counts = get("names", "<u8"), get("sizes", "<u4"), get("ctx", "<u2"), get("counts", "<u4")
        every, word = np.unique(np.concatenate(names), return_inverse=True)
        code = np.repeat(word, np.concatenate(sizes)).astype("i8") * CONTEXTS + np.concatenate(ctx)
        kinds, back = np.unique(code, return_inverse=True)
        c = np.bincount(back, np.concatenate(counts), len(kinds))
        ends = [np.cumsum([len(x) for x in g]) for g in (ctx, names)]
        found = {
            "every": (every, "<u8"), "w": (kinds // CONTEXTS, "<u4"), "u": (kinds % CONTEXTS, "<u2"), "c": (c, "<u8"),
            "batches": (table.column("batch").to_numpy(), "<i8"), "pairs": (back, "<u4"), "pair_ends": (ends[0], "<i8"),
            "own": (word, "<u4"), "own_ends": (ends[1], "<i8"),
        }
        return {k: np.asarray(x).astype(kind).tobytes() for k, (x, kind) in found.items()}

    @classmethod
    def of(cls, row: dict, hot: np.ndarray) -> Part:
        part = cls(*(np.frombuffer(row[k], kind) for k, kind in (("every", "<u8"), ("w", "<u4"), ("u", "<u2"), ("c", "<u8"))), hot)
        if row.get("tables") is not None:
            part.t, part.seats, part.t_p, part.kept, part.roots = (np.frombuffer(row[k], "<f4").astype("f8") for k in ("tables", "seats", "t_p", "kept", "roots"))
        return part

    def state(self) -> dict:
        kept = {"tables": self.t, "seats": self.seats, "t_p": self.t_p, "kept": self.kept, "roots": self.roots}
        return {k: x.astype("<f4").tobytes() for k, x in kept.items()}

    def sums(self, step: int) -> dict:
        """What is to be summed over parts: numbers of each context, of each spread word, and of the others together."""
        if step < 0:  # nobody sits yet
            ctx, of_word = (np.bincount(self.u, x, CONTEXTS) for x in (self.c > 0, self.c)), self.c_w
        else:
            ctx, of_word = (np.bincount(self.u, self.t, CONTEXTS), np.zeros(CONTEXTS)), np.bincount(self.w, self.t, len(self.every))
        own, mine = ~self.spread, np.flatnonzero(self.spread)
        few = [(self.c_w[own] > 0).sum(), of_word[own].sum(), self.t_p[own].sum(), self.c.sum()]
        rows = np.column_stack([self.every[mine].view("f8"), of_word[mine]])
        return {"near": np.concatenate([*ctx]).astype("<f8").tobytes(), "words": np.array(few, "<f8").tobytes(), "parents": rows.astype("<f8").tobytes()}

    def step(self, step: int, now: Totals, rng: np.random.Generator) -> None:
        """Step 0 seats everybody, the later ones sweep; parents follow their words' tables."""
        near = STRENGTH + DISCOUNT * now.t_u[self.u]
        if step == 0:
            parent = self.c_w / max(1.0, now.total)
        else:
            parent = (np.bincount(self.w, self.t, len(self.every)) - PARENT_DISCOUNT * self.t_p + now.base) / (now.customers + PARENT_STRENGTH)
        parent[self.spread] = now.hot_parent[self.place]
        if step == 0:
            tables = Seating(self.c, DISCOUNT, rng)
            tables.arrive(near * parent[self.w])
            self.t = tables.t
        else:
            self.t = reseated(self.c, near - DISCOUNT * self.t, DISCOUNT, parent[self.w], DISCOUNT, rng)
        c_p = np.where(self.spread, 0, np.bincount(self.w, self.t, len(self.every)))
        self.t_p = now.parents(c_p, self.t_p, step, rng)
        if step > BURN:
            self.seats += self.t / SAMPLES
            self.kept += c_p / SAMPLES
            self.roots += self.t_p / SAMPLES

    def answers(self, row: dict) -> Iterator[dict]:
        """For each batch: its entries' customers less discounts, and its words' counts and parents' numbers."""
        near, k = self.c - DISCOUNT * self.seats, self.kept - PARENT_DISCOUNT * self.roots
        get = lambda c, kind: np.frombuffer(row[c], kind)
        pairs, own = np.split(get("pairs", "<u4"), get("pair_ends", "<i8")), np.split(get("own", "<u4"), get("own_ends", "<i8"))
        for number, p, o in zip(get("batches", "<i8").tolist(), pairs, own):
            yield {"batch": number, "near": near[p].astype("<f4").tobytes(), "words": self.c_w[o].astype("<u8").tobytes(), "parents": k[o].astype("<f4").tobytes()}


class Totals:
    """Sums over all parts, which every part takes its next step with, and the parents of the hot words.

    As many numbers as there are contexts and hot words.
    """

    def __init__(self, hot: np.ndarray, total: int, seed: int):
        self.hot, self.total, self.rng = hot, total, np.random.default_rng([seed, 1 << 32])
        n = len(hot)
        self.t_u, self.c_u, self.t_mean = np.zeros(CONTEXTS), np.zeros(CONTEXTS), np.zeros(CONTEXTS)
        self.hot_c, self.hot_parent, self.hot_kept, self.hot_roots = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        self.hot_t = np.zeros(n)
        self.v = self.customers = self.base = self.own = self.own_roots = 0.0

    def add(self, step: int, ctx: np.ndarray, of_hot: np.ndarray, few: np.ndarray) -> None:
        """Takes in what parts sum to after a step (-1: before the first)."""
        self.t_u = ctx[0]
        if step < 0:
            self.c_u, self.hot_c, self.v = ctx[1], of_hot, few[0] + (of_hot > 0).sum()
            self.hot_parent = of_hot / max(1.0, self.total)
            self._base(self.v)
            return
        self.hot_t = t_p = self.parents(of_hot, self.hot_t, step, self.rng)
        self.customers = few[1] + of_hot.sum()
        self._base(few[2] + t_p.sum())
        self.hot_parent = (of_hot - PARENT_DISCOUNT * t_p + self.base) / (self.customers + PARENT_STRENGTH)
        if step > BURN:
            self.t_mean += self.t_u / SAMPLES
            self.own += few[1] / SAMPLES
            self.own_roots += few[2] / SAMPLES
            self.hot_kept += of_hot / SAMPLES
            self.hot_roots += t_p / SAMPLES

    def parents(self, c_p: np.ndarray, t_p: np.ndarray, step: int, rng: np.random.Generator) -> np.ndarray:
        """The tables of words in the restaurant of single words, whose customers c_p are the tables of the contexts."""
        if step == 0:
            root = Seating(c_p, PARENT_DISCOUNT, rng)
            root.arrive(np.full(len(c_p), self.base))
            return root.t
        word = (1 - UNKNOWN) / max(1.0, self.v)
        return reseated(c_p, self.base / word - PARENT_DISCOUNT * t_p, PARENT_DISCOUNT, np.full(len(c_p), word), PARENT_DISCOUNT, rng)

    def _base(self, tables: float) -> None:
        self.base = (PARENT_STRENGTH + PARENT_DISCOUNT * tables) * (1 - UNKNOWN) / max(1.0, self.v)

    def add_rows(self, step: int, rows: list[dict]) -> None:
        """The rows of sums(), of any number of parts or of sums of them."""
        ctx, of_hot, few = np.zeros((2, CONTEXTS)), np.zeros(len(self.hot)), np.zeros(4)
        for r in rows:
            c, h, f = unpacked_sums(r, self.hot)
            ctx, of_hot, few = ctx + c, of_hot + h, few + f
        self.add(step, ctx, of_hot, few)


def unpacked_sums(row: dict, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, of_hot = np.frombuffer(row["parents"], "<f8").reshape(-1, 2), np.zeros(len(hot))
    of_hot[np.searchsorted(hot, rows[:, 0].copy().view("u8"))] = rows[:, 1]
    return np.frombuffer(row["near"], "<f8").reshape(2, -1), of_hot, np.frombuffer(row["words"], "<f8")


def seated(table: pa.Table, hot: np.ndarray, total: float, seed: int) -> Iterator[dict]:
    """All steps where one part is all there is: the answers to its batches, then a row (batch -1) of averaged totals."""
    row = Part.fixed(table)
    part, now = Part.of(row, hot), Totals(hot, total, seed)
    now.add_rows(-1, [part.sums(-1)])
    for step in range(1 + BURN + SAMPLES):
        part.step(step, now, np.random.default_rng([seed, 0, step]))
        now.add_rows(step, [part.sums(step)])
    yield from part.answers(row)
    few = np.array([now.v - (now.hot_c > 0).sum(), now.own, now.own_roots, total], "<f8")
    yield {"batch": -1, "near": np.concatenate([now.t_mean, now.c_u]).tobytes(), "words": few.tobytes()}


def _summed(rows: DataFrame, hot: np.ndarray) -> list[dict]:
    """The parts' sums as rows of the same form, one for each of a few groups of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, of_hot, few, some = np.zeros((2, CONTEXTS)), np.zeros(len(hot)), np.zeros(4), False
        for row in ex.each(batches):
            c, h, f = unpacked_sums(row, hot)
            ctx, of_hot, few, some = ctx + c, of_hot + h, few + f, True
        if some:
            packed = [ctx, np.column_stack([hot.view("f8"), of_hot]), few]
            columns = [pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (packed[0], packed[2], packed[1])]
            yield pa.RecordBatch.from_arrays(columns, ["near", "words", "parents"])

    some = rows.mapInArrow(run, SUMS).repartition(GROUPS)
    return [r.asDict() for r in some.mapInArrow(run, SUMS).collect()]


def hot_words(batches: DataFrame) -> tuple[np.ndarray, int]:
    """Words with more than 1/HOT of all training tokens where they are frequent, and the number of training tokens.

    A word above 2/HOT is above 1/HOT in batches with half of it at least, so it is found.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in ex.each(rows):
            names, doc = tokens(row["body"], row["lengths"])
            own = names[~held_out(row["keys"])[doc]]
            words, counts = np.unique(own, return_counts=True)
            some = counts * HOT >= len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(words[some].view("i8"), 0)), pa.array(np.append(counts[some], len(own))), pa.array(np.append(np.zeros(some.sum(), bool), True))],
                ["name", "n", "total"],
            )

    found = cut_lineage(batches.mapInArrow(run, "name long, n long, total boolean").groupBy("total", "name").agg(F.sum("n").alias("n")))
    total = found.where("total").agg(F.sum("n")).first()[0] or 0
    rows = found.where(~F.col("total") & (F.col("n") * HOT >= total)).select("name").collect()  # HOT rows at most
    return np.sort(np.array([r.name for r in rows], "i8").view("u8")), total


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 13) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    batches, parts = ex.in_batches(docs, key, text, BATCH_BYTES)
    parts *= 2  # a task holds a part's dishes, their seating and the places of its batches' entries together
    hot, total = hot_words(batches)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in ex.each(rows):
            yield Batch(row, hot, parts).rows(row["batch"])

    def build(table: pa.Table) -> pa.Table:
        row = Part.fixed(table)
        found = {"part": table.column("part")[0].as_py()} | row | Part.of(row, hot).sums(-1)
        return pa.Table.from_pylist([found], schema=arrow(BUILT))

    # both kinds of table are bucketed by part, so that a step moves nothing but its sums
    buckets = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    built = ex.staged(batches.mapInArrow(send, SENT).groupBy("part").applyInArrow(build, BUILT), buckets, "part")
    now = Totals(hot, total, seed)
    now.add_rows(-1, _summed(built.select("near", "words", "parents"), hot))
    dishes, state = built.select("part", "every", "w", "u", "c"), None
    for step in range(1 + BURN + SAMPLES):

        def stepped(rows: Iterator[pa.RecordBatch], step: int = step, now: Totals = now) -> Iterator[pa.RecordBatch]:
            for row in ex.each(rows):
                part = Part.of(row, hot)
                part.step(step, now, np.random.default_rng([seed, row["part"], step]))
                yield from pa.Table.from_pylist([{"part": row["part"]} | part.state() | part.sums(step)], schema=arrow(STATE)).to_batches()

        before = dishes if state is None else dishes.join(state.drop("near", "words", "parents"), "part")
        state = ex.staged(before.mapInArrow(stepped, STATE), buckets, "part")
        now.add_rows(step, _summed(state.select("near", "words", "parents"), hot))
    model = Model(now)

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in ex.each(rows):
            for found in Part.of(row, hot).answers(row):
                yield from pa.Table.from_pylist([found | {"part": row["part"]}], schema=arrow(BACK)).to_batches()

    answers = built.drop("near", "words", "parents").join(state.drop("near", "words", "parents"), "part").mapInArrow(answer, BACK)

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in ex.each(rows):
            yield model.scored(row, Batch(row, hot, parts))

    back = answers.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("part", "near", "words", "parents"))).alias("back"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return batches.join(back, "batch").mapInArrow(finish, schema)


class Model:
    """The totals that every document is scored with: as many numbers as there are contexts and hot words."""

    def __init__(self, now: Totals):
        self.hot, self.total, self.v, self.known = now.hot, now.total, now.v, max(1.0, now.v)
        self.t_u, self.c_u, self.hot_c = now.t_mean, now.c_u, now.hot_c
        self.hot_k = now.hot_kept - PARENT_DISCOUNT * now.hot_roots
        self.fresh = PARENT_STRENGTH + PARENT_DISCOUNT * (now.own_roots + now.hot_roots.sum())
        self.all = now.own + now.hot_kept.sum() + PARENT_STRENGTH

    def scored(self, row: dict, b: Batch) -> pa.RecordBatch:
        get = lambda c, kind: np.frombuffer(b"".join(x[c] for x in row["back"]), kind)
        near, c_head, k_head = get("near", "<f4"), get("words", "<u8"), get("parents", "<f4")
        c, k = np.zeros(len(b.words)), np.zeros(len(b.words))
        c[b.pair_word[b.heads]], k[b.pair_word[b.heads]] = c_head, k_head
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, b.words), len(self.hot) - 1)
            mine = self.hot[at] == b.words
            c[mine], k[mine] = self.hot_c[at[mine]], self.hot_k[at[mine]]
        parent = (k + self.fresh * np.where(c > 0, (1 - UNKNOWN) / self.known, UNKNOWN)) / self.all
        u = b.ctx
        p = (near[b.pair] + (STRENGTH + DISCOUNT * self.t_u[u]) * parent[b.word]) / (self.c_u[u] + STRENGTH)
        n = len(row["keys"])
        base = np.log10((c[b.word] + 0.1) / (self.total + 0.1 * (self.v + 1)))
        count = lambda x: np.bincount(b.doc, x, n)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(row["keys"], pa.int64()), pa.array(held_out(row["keys"])), pa.array(np.bincount(b.doc, minlength=n).astype("i8")),
                pa.array(count(c[b.word] > 0).astype("i8")), pa.array(np.full(n, self.total, "i8")), pa.array(count(base)), pa.array(count(np.log10(p))),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, and the perplexities of the model and of the base over all tokens."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
