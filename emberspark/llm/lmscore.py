"""Language-model scores by logistic context mixing.

The text that is scored is its words (A-Z as a-z) with single blanks between them and an
end mark.  It is coded bit by bit.  For each bit, predictors for five contexts - the last 2 to 6 bytes -
give log-odds from the counts of zeros and ones seen after that context in all
training documents.  Two sets of weights, each chosen by its own gate - how
often the longer contexts have been seen, and the bits already known of this byte - combine
them in the logistic domain.  While a
document is scored, the mixtures are themselves weighted by how well they have done so far
in it, with a share for switching, block by block.

As a Spark job: each run of texts (what a task reads, up to ``RUN_BYTES``) names its distinct strings of
seven bytes (six of context and the byte) once, with their counts by fold.  They are dealt by the last three bytes of the context,
so that all contexts of three to six bytes lie whole in one part, and are counted there exactly,
without hashing; the counts of two-byte contexts (at most 2^24, whatever the corpus) are added
up over all parts.  What is counted and written so grows with the corpus, and no task holds
more than a part.  Weights are learned from all training documents, whatever their length:
in ``ROUNDS`` rounds each part adds up the gradient and the curvature of its strings' cost by
gate, with the counts of the string's own fold left out, and one Newton step is taken.  Then
each distinct string is predicted once, in its part, and the runs of texts get their strings with the
predictions (as half-precision numbers) back, where a table of them answers for all their texts.

Texts of one process can also be scored with hashed counts (``count_bits``, ``learn``,
``score_texts``): the same model with a fixed number of slots; the query does not use it.

Beside it stands the unigram base score: token counts of the whole training corpus, where
tokens with a share of at least 1 / ``FREQUENT`` (so at most that many) are broadcast and
all rarer ones are joined.

Defined cases: null or empty text is an end alone; a null id is held out; without training
documents all contexts are unseen (probability 1/2 a bit) and every count is 0; repeated
rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberspark.llm.common import LOWER, cut, held_out, small, table, utf8

FOLD = 10
#: Contexts: the last 2 to 6 bytes.
ORDERS = (2, 3, 4, 5, 6)
SLOT_BITS = (18, 20, 21, 23, 23)
FIRST = tuple(int(x) for x in np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])]))
SLOTS = FIRST[-1]
#: Folds of the training documents for the weights, and the mark of texts that are not trained on.
FOLDS, ASIDE = 4, 15
ROUNDS = 5
#: Bytes of text for each part of the contexts.
PART_BYTES = 4 << 20
START = 0.35  # all weights before learning
PAIRS = [(a, b) for a in range(len(ORDERS)) for b in range(a, len(ORDERS))]
FREQUENT = 1_000_000
BATCH = 1 << 20  # bytes predicted together
COUNTED = 2 << 20  # bytes counted, and scored, together
RUN_BYTES = 32 << 20  # bytes whose strings are named, and predicted, once
CACHE_BITS = 21  # predictions that a task keeps
CHUNK = 1 << 14  # predictions held in the processor's cache
BLOCK = 32  # bytes between two updates of the mixtures' weights
SHARE = 0.02
END = b"\xff"  # never part of UTF-8
HEAD = 6  # zero bytes before each text: the longest context
GATES = (512, 2048)


def normal(text: bytes) -> bytes:
    """Lower-cased words with single blanks between them, and the end mark."""
    return b" ".join(text.translate(LOWER).split()) + END


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What the prediction of each byte rests on, and the texts' lengths: the six bytes before it, the
    latest on top, then the byte itself.  Sorted, neighbours share their shorter contexts."""
    raw = np.frombuffer(b"".join(bytes(HEAD) + t for t in texts), np.uint8)
    n = np.array([len(t) for t in texts], np.int64)
    key = np.zeros(len(raw) - HEAD, np.uint64)
    for j in (*range(HEAD - 1, -1, -1), HEAD):
        key <<= np.uint64(8)
        key |= raw[j:len(raw) - HEAD + j]
    own = np.ones(len(key), bool)  # windows that end in the zeros before a text are not a text's bytes
    start = np.cumsum(n + HEAD)[:-1] - HEAD
    own[(start[:, None] + np.arange(HEAD)).ravel()] = False
    return key[own], n


def contexts(key: np.ndarray) -> list[np.ndarray]:
    """A hash of each context, below its number of slots."""
    return [((((key >> np.uint64(8 * (HEAD + 1 - o))) + np.uint64(o)) * np.uint64(0x9E3779B97F4A7C15))
             >> np.uint64(64 - bits)).astype(np.int32) for o, bits in zip(ORDERS, SLOT_BITS)]


#: Where a byte's known bits lead: the first four bits stay near the context's place, and so do the last.
NODE = ((np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int32) & ~63
NODE = np.array([(NODE[n if n < 16 else n >> (n.bit_length() - 5)] if n >= 16 else 0) ^ (n & 63) for n in range(256)], np.int32)


def slot(o: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The slot of one context for the bits known so far (1, then the bits)."""
    return FIRST[o] + ((context ^ NODE[node]) & ((1 << SLOT_BITS[o]) - 1))


def slots(context: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    return [slot(o, c, node) for o, c in enumerate(context)]


def count_bits(key: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
    """Add the bits of the distinct ``key`` to counts (zeros and ones of slot s at 2s and 2s+1).

    From the longest context to the shortest, strings that differ only before it are added up first.
    """
    for o in range(len(ORDERS) - 1, -1, -1):
        rest = np.uint64((1 << 8 * (HEAD + 1 - ORDERS[o])) - 256)  # the bytes beyond this context
        short = key & ~rest
        key, back = np.unique(short, return_inverse=True)
        times = np.bincount(back, times).astype(np.uint32)
        for at in range(0, len(key), CHUNK):
            k, t = key[at:at + CHUNK], times[at:at + CHUNK]
            context, byte, node = contexts(k)[o], (k & np.uint64(255)).astype(np.int32), np.ones(len(k), np.int32)
            for i in range(7, -1, -1):
                bit = (byte >> i) & 1
                np.add.at(counts, 2 * slot(o, context, node) + bit, t)
                node = 2 * node + bit


def odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log-odds in 1/256 and two bits for how often the context was seen, as one int16."""
    n = n0 + n1
    seen = (n > 0).astype(np.int16) + (n > 2) + (n > 10)
    st = np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -7.9, 7.9)
    return (np.rint(st * 256).astype(np.int16) * 4 + seen).astype(np.int16)


def gates(values: list[np.ndarray], node: np.ndarray, bit: int) -> list[np.ndarray]:
    """Which row of each set of weights is used: by what was seen of the long contexts, and by the known bits."""
    six, five, four = (v & 3 for v in values[:1:-1])
    return [((six << 4) + (five << 2) + four) * np.int32(8) + np.int32(bit), (node << 3) + ((six > 0) * np.int16(4)) + five]


def new_weights() -> list[np.ndarray]:
    return [np.full((len(ORDERS), g), START, np.float32) for g in GATES]


def learn(texts: list[bytes], counts: np.ndarray, weights: list[np.ndarray], rate: float = 0.003, part: int = 1024) -> list[np.ndarray]:
    """Online learning of the weights, some bytes at a time; each text's own counts are left out."""
    for number, text in enumerate(texts):
        key, _ = keys_of([text])
        now = rate * max(0.1, 1 - number / len(texts))
        context, byte, node = contexts(key), (key & np.uint64(255)).astype(np.int32), np.ones(len(key), np.int32)
        for i in range(7, -1, -1):
            bit = (byte >> i) & 1
            values = []
            for s in slots(context, node):
                names, back = np.unique(s, return_inverse=True)
                own1 = np.bincount(back, bit, len(names))
                own = np.bincount(back, minlength=len(names))
                n0 = np.maximum(counts[2 * names] - (own - own1), 0)
                n1 = np.maximum(counts[2 * names + 1] - own1, 0)
                values.append(odds(n0, n1)[back])
            x = np.stack([(v >> 2).astype(np.float32) / 256 for v in values])
            for w, g in zip(weights, gates(values, node, 7 - i)):
                for at in range(0, len(g), part):
                    own_g, own_x = g[at:at + part], x[:, at:at + part]
                    miss = bit[at:at + part] - 0.5 * (1 + np.tanh(0.5 * (w[:, own_g] * own_x).sum(axis=0)))
                    for o in range(len(w)):
                        w[o] += now * np.bincount(own_g, miss * own_x[o], w.shape[1])
            node = 2 * node + bit
    return weights


def add_bit(cost: np.ndarray, values: list[np.ndarray], bit: np.ndarray, node: np.ndarray, number: int, weights: list[np.ndarray]) -> None:
    """Multiply ``cost`` by one over the probability of the bit under each set of weights."""
    sign = ((1 - 2 * bit) * np.float32(1 / 256)).astype(np.float32)  # log(1 + e^z) is the cost in nats
    x = [(v >> 2) * sign for v in values]
    for j, (w, g) in enumerate(zip(weights, gates(values, node, number))):
        g = g.astype(np.intp)
        z = w[0].take(g, mode="clip")
        z *= x[0]
        for o in range(1, len(x)):
            z += w[o].take(g, mode="clip") * x[o]
        cost[j] *= 1 + np.exp(np.minimum(z, 80, out=z), out=z)


def predict(key: np.ndarray, tab: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of the byte of each key under each set of weights."""
    out = np.empty((len(GATES), len(key)), np.float32)
    for at in range(0, len(key), CHUNK):
        k = key[at:at + CHUNK]
        context, byte, node = contexts(k), (k & np.uint64(255)).astype(np.int32), np.ones(len(k), np.int32)
        cost = np.ones((len(GATES), len(k)))  # one over the probability
        for i in range(7, -1, -1):
            bit = (byte >> i) & 1
            add_bit(cost, [tab.take(s, mode="clip") for s in slots(context, node)], bit, node, 7 - i, weights)
            node = 2 * node + bit
        out[:, at:at + CHUNK] = -np.log(cost)
    return out


def new_cache() -> tuple[np.ndarray, np.ndarray]:
    """Keys (none yet) and their predictions, two 32-bit numbers as one, at a place that a hash of the key gives."""
    return np.full(1 << CACHE_BITS, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << CACHE_BITS, np.uint64)


def cache_place(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - CACHE_BITS)).astype(np.intp)


def predict_all(key: np.ndarray, tab: np.ndarray, weights: list[np.ndarray], cache: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """:func:`predict`; a key that the cache knows, or that comes again, is not predicted anew."""
    place = cache_place(key)
    values = cache[1].take(place)
    new = np.flatnonzero(cache[0].take(place) != key)
    distinct, back = np.unique(key[new], return_inverse=True)
    found = np.ascontiguousarray(predict(distinct, tab, weights).T).view(np.uint64).ravel()
    values[new] = found[back]
    place = cache_place(distinct)
    cache[0][place], cache[1][place] = distinct, found
    return np.ascontiguousarray(values.view(np.float32).reshape(-1, len(GATES)).T)


def combine(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-probability of each text: mixtures weighted by their success in the blocks before."""
    blocks = -(-n // BLOCK)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    edges = np.concatenate([f + BLOCK * np.arange(b) for f, b in zip(first, blocks)])
    sums = np.add.reduceat(values.astype(np.float64), edges, axis=1)  # a text's blocks, one after another
    begin = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    order = np.argsort(-blocks, kind="stable")
    belief = np.full((len(values), len(n)), -math.log(len(values)))
    total = np.zeros(len(n))
    live = len(n)
    for step in range(int(blocks.max(initial=0))):
        while blocks[order[live - 1]] <= step:
            live -= 1
        d = order[:live]
        a = belief[:, d] + sums[:, begin[d] + step]
        top = a.max(axis=0)
        gained = top + np.log(np.exp(a - top).sum(axis=0))
        total[d] += gained
        belief[:, d] = np.log((1 - SHARE) * np.exp(a - gained) + SHARE / len(values))
    return total


def batches_of(texts: list[bytes], size: int = BATCH):
    """Runs of texts of up to ``size`` bytes together (a longer text alone)."""
    at = 0
    while at < len(texts):
        to, held = at + 1, len(texts[at])
        while to < len(texts) and held + len(texts[to]) <= size:
            held += len(texts[to])
            to += 1
        yield at, to
        at = to


def score_texts(texts: list[bytes], tab: np.ndarray, weights: list[np.ndarray], cache: tuple | None = None) -> np.ndarray:
    """Natural log of the probability of each normal text."""
    out, cache = np.zeros(len(texts)), cache or new_cache()
    for at, to in batches_of(texts):
        key, n = keys_of(texts[at:to])
        values = [predict_all(key[lo:lo + BATCH], tab, weights, cache) for lo in range(0, len(key), BATCH)]
        out[at:to] = combine(values[0] if len(values) == 1 else np.concatenate(values, axis=1), n)
    return out


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes before all second ones."""
    planes = values.view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes, kind) -> np.ndarray:
    planes = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_names(names: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return pack(np.diff(names, prepend=np.uint64(0)))


def unpack_names(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of a key: by the last three bytes of its context."""
    return (((key >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts


def by_part(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts that hold any of the keys, the order that deals them out, and where each part begins."""
    part = np.empty(len(key), np.uint16 if parts <= 1 << 16 else np.int64)  # the short ones are sorted by digits
    for at in range(0, len(key), BATCH):
        part[at:at + BATCH] = part_of(key[at:at + BATCH], parts)
    n = np.bincount(part, minlength=parts)
    names = np.flatnonzero(n)
    return names, np.argsort(part, kind="stable"), np.append(0, np.cumsum(n[names]))


def added_up(names: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, sorted, and the sums of their times."""
    order = np.argsort(names, kind="stable")
    names = names[order]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    return names[first], np.add.reduceat(times[order], first) if len(names) else times


def shortened(key: np.ndarray, o: int) -> np.ndarray:
    """The key without the bytes beyond the context of ``o`` bytes."""
    return key & ~np.uint64((1 << 8 * (HEAD + 1 - o)) - 256)


class Sums:
    """Times of distinct names, added up as they come; what is held stays near the distinct ones, or a million."""

    def __init__(self, kind=np.int64):
        self.names, self.times = np.zeros(0, np.uint64), np.zeros(0, kind)
        self.held: list = []

    def add(self, names: np.ndarray, times: np.ndarray) -> None:
        """``names`` are distinct and sorted."""
        self.held.append((names, times))
        if sum(len(x) for x, _ in self.held) > max(1 << 20, len(self.names) // 2):
            self.joined()

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All names so far, sorted, and their times."""
        if self.held:
            names, times = self.held[0] if len(self.held) == 1 else added_up(*(np.concatenate(x) for x in zip(*self.held)))
            self.held = []
            at = np.searchsorted(self.names, names)
            old = np.flatnonzero(self.names.take(at, mode="clip") == names) if len(self.names) else at[:0]
            self.times[at[old]] += times[old].astype(self.times.dtype)
            new = np.ones(len(names), bool)
            new[old] = False
            at, names, times = at[new], names[new], times[new]
            # each new name stands behind those before it, old and new
            at += np.arange(len(at))
            stays = np.ones(len(self.names) + len(at), bool)
            stays[at] = False
            for mine, more in (("names", names), ("times", times)):
                both = np.empty(len(stays), getattr(self, mine).dtype)
                both[at], both[stays] = more, getattr(self, mine)
                setattr(self, mine, both)
        return self.names, self.times


def tally(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, sorted, and how often each comes; sorts ``names`` in place."""
    names.sort()
    first = np.flatnonzero(np.diff(names, prepend=~names[:1]))
    return names[first], np.diff(first, append=len(names))


def by_key(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted names, and each name's place among them."""
    key = names >> np.uint64(4)
    new = np.diff(key, prepend=~key[:1]) != 0
    return key[new], np.cumsum(new) - 1


def by_fold(names: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts in each fold, from sorted names; a name is a key and its fold's four bits."""
    key, back = by_key(names)
    fold = (names & np.uint64(15)).astype(np.int64)
    counts = np.zeros((len(key), FOLDS), np.int64)
    own = fold < FOLDS
    counts[back[own], fold[own]] = times[own]
    return key, counts


def sum_of(w: np.ndarray, gate: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
    """The weighted sum of the odds, by the weights of each row's gate."""
    z = w[0].take(gate)
    z *= x[0]
    for o in range(1, len(x)):
        z += w[o].take(gate) * x[o]
    return z


def add_slopes(total: np.ndarray, x: np.ndarray, gate: np.ndarray, w: np.ndarray, times: np.ndarray, ones: np.ndarray) -> None:
    """Add to each gate's row of ``total`` gradient and curvature of rows of odds that came ``times``, ``ones`` of them before a one."""
    p = 0.5 * (1 + np.tanh(0.5 * sum_of(w, gate, x)))
    miss, bend = ones - times * p, times * (p * (1 - p))
    x = x.astype(float)
    for o, v in enumerate(x):
        total[:, o] += np.bincount(gate, miss * v, len(total))
    for a, v in enumerate(x):
        v = bend * v
        for b in range(a, len(x)):
            total[:, len(x) + PAIRS.index((a, b))] += np.bincount(gate, v * x[b], len(total))


class Counted:
    """Exact counts of the contexts of sorted distinct keys; those of two bytes come from ``two`` (keys, counts by fold)."""

    def __init__(self, key: np.ndarray, counts: np.ndarray, two: tuple[np.ndarray, np.ndarray]):
        self.key, self.counts = key, counts
        self.byte = (key & np.uint64(255)).astype(np.int32)
        self.orders = []
        for o in ORDERS:
            short = shortened(key, o)
            if o == ORDERS[0]:
                self.orders.append((*two, np.searchsorted(two[0], short)))
            else:
                names, back = np.unique(short, return_inverse=True)
                total = np.stack([np.bincount(back, counts[:, f], len(names)) for f in range(FOLDS)], axis=1)
                self.orders.append((names, total.astype(np.int64), back))

    def bits(self):
        """For each bit: its number, its value, the bits before it, and for each order zeros and ones by place and fold, and the keys' places.

        The longest context with the bits before it settles all others: keys side by side that agree in it share their odds.
        """
        node = np.ones(len(self.key), np.int32)
        for k in range(8):
            found = []
            for names, counts, back in self.orders:
                prefix = names >> np.uint64(8 - k)
                new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
                first, place = np.flatnonzero(new), np.cumsum(new) - 1
                ones = ((names >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
                n = np.add.reduceat(counts, first, axis=0)
                n1 = np.add.reduceat(counts * ones[:, None], first, axis=0)
                found.append((n - n1, n1, place[back]))
            bit = (self.byte >> (7 - k)) & 1
            yield k, bit, node, found
            node = 2 * node + bit

    def predict(self, weights: list[np.ndarray]) -> np.ndarray:
        """Natural log of the probability of the byte of each key under each set of weights."""
        cost = np.ones((len(GATES), len(self.key)))
        for k, bit, node, found in self.bits():
            last = found[-1][2]
            lead = np.flatnonzero(np.diff(last, prepend=-1))
            values = [odds(n0.sum(axis=1), n1.sum(axis=1))[place[lead]] for n0, n1, place in found]
            x = [(v >> 2) * np.float32(1 / 256) for v in values]
            sign = (1 - 2 * bit).astype(np.float32)
            for j, (w, g) in enumerate(zip(weights, gates(values, node[lead], k))):
                z = sum_of(w, g.astype(np.intp), x)[last]
                z *= sign  # log(1 + e^z) is the cost in nats
                cost[j] *= 1 + np.exp(np.minimum(z, 80, out=z), out=z)
        return -np.log(cost)

    def slopes(self, weights: list[np.ndarray]) -> list[np.ndarray]:
        """By gate: gradient and curvature of the log-probability of all training bytes, each without the counts of its fold."""
        out = [np.zeros((g, len(ORDERS) + len(PAIRS))) for g in GATES]
        for k, _, node, found in self.bits():
            lead = np.flatnonzero(np.diff(found[-1][2], prepend=-1))
            whole = [(n0.sum(axis=1), n1.sum(axis=1)) for n0, n1, _ in found]
            for f in range(FOLDS):
                times = found[-1][0][:, f] + found[-1][1][:, f]
                rows = np.flatnonzero(times)
                if not len(rows):
                    continue
                known = [odds(a0 - n0[:, f], a1 - n1[:, f]) for (a0, a1), (n0, n1, _) in zip(whole, found)]
                for lo in range(0, len(rows), CHUNK):
                    own = rows[lo:lo + CHUNK]
                    at, n, ones = lead[own], times[own].astype(float), found[-1][1][own, f]
                    values = [v[place[at]] for v, (_, _, place) in zip(known, found)]
                    x = np.stack([(v >> 2).astype(np.float32) / 256 for v in values])
                    for total, w, g in zip(out, weights, gates(values, node[at], k)):
                        add_slopes(total, x, g.astype(np.intp), w, n, ones)
        return out


def newton(weights: list[np.ndarray], slopes: list[np.ndarray], hold: float = 1.0, most: float = 0.5) -> list[np.ndarray]:
    """One step of each gate's weights; ``hold`` draws those with few bytes to the start, no weight moves by more than ``most``."""
    out, n = [], len(ORDERS)
    for w, s in zip(weights, slopes):
        bend = np.zeros((len(s), n, n))
        for i, (a, b) in enumerate(PAIRS):
            bend[:, a, b] = bend[:, b, a] = s[:, n + i]
        step = np.linalg.solve(bend + hold * np.eye(n), (s[:, :n] - hold * (w.T - START))[:, :, None])[:, :, 0]
        out.append((w + np.clip(step, -most, most).T).astype(np.float32))
    return out


def named(docs: DataFrame, parts: int) -> DataFrame:
    """Runs of texts (``row, doc_id, text, fold``), written: ``batch, part, names, times``, and the texts, a few MB a row, as ``texts`` of part -1.

    A run is what a task reads, up to ``RUN_BYTES``: the more texts it has, the fewer strings are named again and again.
    """

    def rows_of(batch, part, names=None, times=None, texts=None):
        empty = [None] * len(part)
        return pa.RecordBatch.from_arrays(
            [pa.array([batch] * len(part), pa.int64()), pa.array(part, pa.int32()), *(pa.array(x or empty, pa.binary()) for x in (names, times, texts))],
            names=["batch", "part", "names", "times", "texts"])

    def dealt_out(batch, sums):
        names, times = sums.joined()
        own, order, first = by_part(names >> np.uint64(4), parts)
        names, times = names[order], times[order]
        cuts = list(zip(first[:-1], first[1:]))
        return rows_of(batch, own.tolist(), [pack_names(names[x:y]) for x, y in cuts], [pack(times[x:y]) for x, y in cuts])

    def counted_in(b):
        key, n = keys_of([normal(t) for t in b.column("text").to_pylist()])
        key <<= np.uint64(4)
        key |= np.repeat(b.column("fold").to_numpy(zero_copy_only=False).astype(np.uint8), n)
        return len(key), *tally(key)

    def run(batches):
        batch, sums, size = None, Sums(np.uint32), 0
        for b in small(batches, "text", COUNTED):
            n, names, times = counted_in(b)
            if batch is not None and size + n > RUN_BYTES:
                yield dealt_out(batch, sums)
                batch, sums, size = None, Sums(np.uint32), 0
            batch = b.column("row")[0].as_py() if batch is None else batch
            size += n
            sums.add(names, times)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
                w.write_batch(b)
            yield rows_of(batch, [-1], texts=[sink.getvalue().to_pybytes()])
        if batch is not None:
            yield dealt_out(batch, sums)

    return cut(docs.mapInArrow(run, "batch long, part int, names binary, times binary, texts binary"))


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """Rows by part, in a fixed number of tasks: the blobs are small beside the work on them."""
    return df.repartition(2 * parts, "part")


def counted(runs: DataFrame, parts: int) -> DataFrame:
    """``part, names, times`` of all runs together, one row a part, written."""

    def merge(rows):
        sums = Sums()
        for x, y in zip(rows.column("names"), rows.column("times")):
            sums.add(unpack_names(x.as_py()), unpack(y.as_py(), np.uint32).astype(np.int64))
        names, times = sums.joined()
        return pa.table({"part": rows.column("part").slice(0, 1), "names": pa.array([pack_names(names)], pa.binary()),
                         "times": pa.array([pack(times)], pa.binary())})

    return cut(dealt(runs.where("part >= 0").select("part", "names", "times"), parts).groupBy("part").applyInArrow(
        merge, "part int, names binary, times binary"))


def opened(names: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return by_fold(unpack_names(names), unpack(times, np.int64))


def short_counts(whole: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by fold of the two-byte contexts of all parts: at most 2^24, whatever the corpus."""

    def shorten(batches):
        for b in batches:
            for x, y in zip(b.column("names"), b.column("times")):
                names, times = unpack_names(x.as_py()), unpack(y.as_py(), np.int64)
                fold = names & np.uint64(15)
                names, times = added_up((shortened(names >> np.uint64(4), ORDERS[0]) << np.uint64(4)) | fold, times)
                yield pa.RecordBatch.from_arrays([pa.array([pack_names(names)], pa.binary()), pa.array([pack(times)], pa.binary())],
                                                 names=["names", "times"])

    names, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for r in whole.select("names", "times").mapInArrow(shorten, "names binary, times binary").toLocalIterator():
        names, times = added_up(np.concatenate([names, unpack_names(bytes(r.names))]), np.concatenate([times, unpack(bytes(r.times), np.int64)]))
    return by_fold(names, times)


def learn_all(whole: DataFrame, two: tuple[np.ndarray, np.ndarray], parts: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights from all training documents of :func:`counted`."""
    weights = new_weights()
    fixed = whole.sparkSession.sparkContext.broadcast(two)
    columns = [f"s{i}" for i in range(len(ORDERS) + len(PAIRS))]
    for _ in range(rounds):

        def run(batches, weights=weights):
            total = None
            for b in batches:
                for x, y in zip(b.column("names"), b.column("times")):
                    own = Counted(*opened(x.as_py(), y.as_py()), fixed.value).slopes(weights)
                    total = own if total is None else [t + o for t, o in zip(total, own)]
            if total is not None:
                total = np.concatenate(total)
                rows = np.flatnonzero(total.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(total[rows, i]) for i in range(len(columns)))],
                                                 names=["gate", *columns])

        sums = dealt(whole, parts).select("names", "times").mapInArrow(run, "gate int, " + ", ".join(f"{c} double" for c in columns))
        slopes = np.zeros((sum(GATES), len(columns)))
        for r in sums.groupBy("gate").agg(*(F.sum(c).alias(c) for c in columns)).collect():  # one row a gate
            slopes[r.gate] = r[1:]
        weights = newton(weights, np.split(slopes, np.cumsum(GATES)[:-1]))
    return weights


def answers(runs: DataFrame, whole: DataFrame, two: tuple[np.ndarray, np.ndarray], weights: list[np.ndarray],
            parts: int) -> DataFrame:
    """``batch, part, names, found``: the keys of each run, in order, and their predictions, part by part."""
    model = runs.sparkSession.sparkContext.broadcast((two, weights))

    def run(rows):
        two, weights = model.value
        batch, part = rows.column("batch").to_pylist(), rows.column("part").slice(0, 1)[0].as_py()
        at = batch.index(None)
        whole = Counted(*opened(rows.column("names")[at].as_py(), rows.column("times")[at].as_py()), two)
        found = whole.predict(weights).astype(np.float16)
        own = [i for i in range(len(batch)) if i != at]

        def told(i):
            key = unpack_names(rows.column("names")[i].as_py())
            return pack(np.ascontiguousarray(found[:, np.searchsorted(whole.key, key)].T).view(np.uint32).ravel())

        return pa.table({"batch": pa.array([batch[i] for i in own], pa.int64()), "part": pa.array([part] * len(own), pa.int32()),
                         "names": rows.column("names").take(pa.array(own, pa.int64())), "found": pa.array([told(i) for i in own], pa.binary())})

    def keys(batches):
        for b in batches:
            distinct = [by_key(unpack_names(x.as_py()))[0] for x in b.column("names")]
            yield pa.RecordBatch.from_arrays([b.column("batch"), b.column("part"), pa.array(map(pack_names, distinct), pa.binary())],
                                             names=["batch", "part", "names"])

    asked = (runs.where("part >= 0").select("batch", "part", "names").mapInArrow(keys, "batch long, part int, names binary")
             .withColumn("times", F.lit(None).cast("binary")))
    known = whole.select(F.lit(None).cast("long").alias("batch"), "part", "names", "times")
    return dealt(asked.unionByName(known), parts).groupBy("part").applyInArrow(
        run, "batch long, part int, names binary, found binary")


class Told:
    """The predictions of one run's keys, found by a hash of the key; keys whose place another has taken are in a further table, and so on."""

    def __init__(self, key: np.ndarray, found: np.ndarray):
        self.tables = []
        while len(key):
            bits = max(4, len(key).bit_length())
            names, values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32)
            place = self.place(key, bits, len(self.tables))
            names[place] = key
            own = names.take(place) == key
            values[place[own]] = found[own]
            self.tables.append((bits, names, values))
            key, found = key[~own], found[~own]

    @staticmethod
    def place(key: np.ndarray, bits: int, level: int) -> np.ndarray:
        """Each table has a hash of its own."""
        turn = (0x9E3779B97F4A7C15 * (2 * level + 1)) & (2 ** 64 - 1)
        return ((key * np.uint64(turn) ^ key >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.intp)

    def of(self, key: np.ndarray) -> np.ndarray:
        """The predictions of keys that are all in the tables, one row a set of weights."""
        out, rest = np.empty(len(key), np.uint32), None
        for level, (bits, names, values) in enumerate(self.tables):
            place = self.place(key, bits, level)
            out[slice(None) if rest is None else rest] = values.take(place)
            missed = np.flatnonzero(names.take(place) != key)
            key, rest = key[missed], missed if rest is None else rest[missed]
            if not len(key):
                break
        return np.ascontiguousarray(out.view(np.float16).reshape(-1, len(GATES)).T.astype(np.float32))


def told_scores(texts: list[bytes], told: Told) -> np.ndarray:
    """Natural log of the probability of each normal text, from the predictions of its run's keys."""
    key, n = keys_of(texts)
    return combine(told.of(key), n)


def token_counts(texts: DataFrame) -> DataFrame:
    """``token, c`` of all rows of ``texts``; the end mark is the empty token."""

    def count(batches):
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                              names=["token", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                held.update(t.translate(LOWER).split())
                held[b""] += 1
                if len(held) > 800_000:
                    yield flush()
                    held.clear()
        yield flush()

    return texts.mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def train(docs: DataFrame, fold: int = FOLD) -> tuple[DataFrame, DataFrame, tuple[np.ndarray, np.ndarray], list[np.ndarray], int]:
    """Of ``row, doc_id, text``: the runs of texts, the counts outside the held-out fold, those of two bytes, the weights, the number of parts."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    runs = named(docs.withColumn("fold", F.when(held_out("doc_id", fold), ASIDE).otherwise(
        F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))).cast("int")), parts)
    whole = counted(runs, parts)
    two = short_counts(whole)
    return runs, whole, two, learn_all(whole, two, parts), parts


def score_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: int = FOLD) -> DataFrame:
    """Scores of every document: the columns of :func:`op1_lm`, in natural units of log10, and ``bits_per_byte``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("text"))
    runs, whole, two, weights, parts = train(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), fold)
    vocabulary = cut(token_counts(docs.where(~held_out("doc_id", fold)).select("text")))
    size = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(size.n), int(size.v)
    # at most FREQUENT tokens can have so large a share
    often = {bytes(r.token): math.log10(r.c + 0.1) for r in vocabulary.where(F.col("c") * FREQUENT >= max(n, 1)).collect()}
    common = spark.sparkContext.broadcast(often)
    base = math.log10(n + 0.1 * (v + 1))

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], []
        for b in rows:
            for names, values, text in zip(b.column("names"), b.column("found"), b.column("texts")):
                if text.is_valid:
                    texts.append(text.as_py())
                else:
                    keys.append(unpack_names(names.as_py()))
                    found.append(unpack(values.as_py(), np.uint32))
        told = Told(np.concatenate(keys), np.concatenate(found))
        del keys, found
        for blob in texts:
            run = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]
            normals = [normal(t) for t in run.column("text").to_pylist()]
            lm = told_scores(normals, told) / math.log(10)
            for x, y in batches_of(normals):
                yield rows_of(run.slice(x, y - x), normals[x:y], lm[x:y], common.value)

    def rows_of(b, normals, lm, often):
        rows, token, tf, tokens, known, part, score, size = [], [], [], [], [], [], [], []
        for i, text in enumerate(normals):
            counted = Counter(text[:-1].split())
            counted[b""] = 1
            sure, hits = 0.0, 0
            for t, k in counted.items():
                found = often.get(t)
                if found is not None:
                    sure += k * found
                    hits += k
                else:
                    rows.append(i)
                    token.append(t)
                    tf.append(k)
            # the text's own row: its token holds a blank, which no word does
            rows.append(i)
            token.append(b" %d" % b.column("row")[i].as_py())
            tf.append(0)
            tokens.append(sum(counted.values()))
            known.append(hits)
            part.append(sure)
            score.append(float(lm[i]))
            size.append(len(text) - 1)
        index = pa.array(rows, pa.int32())
        own = np.array(tf) == 0

        def only(values, kind):
            out = np.zeros(len(rows), kind)
            out[own] = values
            return pa.array(out)

        return pa.RecordBatch.from_arrays(
            [b.column("row").take(index), b.column("doc_id").take(index), pa.array(token, pa.binary()), pa.array(tf, pa.int64()),
             only(tokens, np.int64), only(known, np.int64), only(part, np.float64), only(score, np.float64), only(size, np.int64)],
            names=["row", "doc_id", "token", "tf", "n_tokens", "known", "part", "score", "bytes"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    told = answers(runs, whole, two, weights, parts).withColumn("texts", F.lit(None).cast("binary"))
    own = runs.where("part = -1").select("batch", "part", *(F.lit(None).cast("binary").alias(c) for c in ("names", "found")), "texts")
    scored = told.unionByName(own).groupBy("batch").applyInArrow(
        score, f"row long, doc_id {id_type}, token binary, tf long, n_tokens long, known long, part double, score double, bytes long")
    joined = scored.join(vocabulary.where(F.col("c") * FREQUENT < max(n, 1)), "token", "left")
    c = F.coalesce("c", F.lit(0))
    out = joined.groupBy("row", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"), (F.sum("known") + F.sum(F.when(c > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.sum("part") + F.sum(F.col("tf") * F.log10(c + 0.1))).alias("sum"), F.sum("score").alias("score"), F.sum("bytes").alias("bytes"))
    return out.select("doc_id", held_out("doc_id", fold).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("sum") - F.col("n_tokens") * F.lit(base)).alias("base_score"), "score",
                      (-F.col("score") * math.log2(10) / (F.col("bytes") + 1)).alias("bits_per_byte"))


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed-context and unigram scores of every document."""
    return score_corpus(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL: dict[str, str] = {}
