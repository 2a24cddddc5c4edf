"""Katz backoff language model over words, of order 3, learned and evaluated as Spark jobs.

P(w | context) is the discounted relative frequency of an n-gram that was learned, else alpha(context) times the
probability in the context without its first word, down to single words. Counts above K stay, counts up to K are
discounted by Good-Turing, and what that frees goes to the lower order: alpha makes each context's probabilities sum to
one exactly. Words that were not learned are one class with the mass that Good-Turing leaves over. Where a context has
no count to discount, its counts are taken out of one more, so that some mass is always left. A text begins with a mark
that is a context only, and ends with a token of its own.

Nothing of the model's size is ever in one place. A task turns texts into lots of word numbers (written). For each order
a lot sends its n-grams, sorted and compressed, to the part that their context's hash names; a part counts those of
learning texts, writes them as its share of the order's table, and looks up those of all texts. What a text needs goes
back as a few sums: log P(n-gram) = log P(lower order) + a difference that the part knows, namely, for a learned n-gram,
its discounted frequency against the lower order's, for another, alpha. Pair counts also go back, as they say what the
next order backs off to. A context of more tokens than half of what a part holds is dealt by its n-grams (`hot`): what
its divisor takes off is summed up in the lot, as if all were learned, and parts name those of its n-grams that are not.

A lot sends a row to each part, and parts grow with the corpus. So lots grow with the parts, which keeps rows in
proportion to the corpus; a lot is worked on in slices of the same text whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K_
from millrace.llm.ngram_join import groups_of
from millrace.llm.store import Table, cut

K = 5
UNIT = 2.0**-27  # of the sums that parts send back
LOT_BYTES = 32 << 20  # of text in a lot at most (a slice can be one longer text)
TURNS = 2  # the highest order's n-grams are exchanged in so many shares, one after another, which bounds the disk
END = np.uint64(0x6A09E667F3BCC909)  # the hash of the end token
UNKNOWN, BEGIN = (1 << 40) - 1, (1 << 40) - 2  # word numbers have 40 bits
ROW = "part int, lot long, kind int, body binary, few array<long>"
#: Kinds of rows: a lot's own, a lot's words or what is answered to them, a part's table, its hot contexts, sums of texts,
#: what texts have in hot contexts, what is answered to pairs.
LOT, WORDS, TABLE, HOT, SUMS, HOT_SUMS, PAIRS = range(7)


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..K from how many things were counted 1..K+1 times. Where Good-Turing gives no proper discount
    (too little data), r / (r + 1) stands in."""
    n = np.concatenate([[0], np.asarray(counts_of_counts, float)])
    d = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        value = (star - common) / (1 - common) if common < 1 else 0.0
        d[r] = value if 0 < value < 1 else r / (r + 1)
    return d


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of numbers (as byte planes, so that equal high bytes lie together) and blobs, compressed as one."""
    out = []
    for x in arrays:
        if isinstance(x, bytes):
            kind, raw = 0, x
        elif x.dtype == np.float64:
            kind, raw = 9, x.tobytes()
        else:
            x = x.astype(np.uint64)
            kind = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
            raw = K_.planes(x, kind)
        out.append(np.array([kind, len(raw)], "<i8").tobytes() + raw)
    whole = b"".join(out)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def unpack(b: bytes) -> list:
    whole = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(whole):
        kind, size = np.frombuffer(whole, "<i8", 2, at).tolist()
        raw = whole[at + 16 : at + 16 + size]
        at += 16 + size
        out.append(raw if kind == 0 else np.frombuffer(raw) if kind == 9 else K_.unplanes(raw, kind).astype(np.int64))
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (part, lot, kind, body, few)."""
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["part", "lot", "kind", "body", "few"])


def listed(batch: pa.RecordBatch) -> list[tuple]:
    """(part, lot, kind, body) of each row."""
    return list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))


def as_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token, the end of each row included."""
    data, at = K_.utf8(column)
    h, rows = K_.words(data, at)
    n = len(at) - 1
    where = np.searchsorted(rows, np.arange(n), "right")
    return np.insert(h, where, END), np.insert(rows, where, np.arange(n))


@dataclass
class Level:
    """What one order gives the next: discounts, and for single words the divisor and the unknown class's probability."""

    d: np.ndarray
    total: float = 0.0
    unknown: float = 0.0

    def p(self, r: np.ndarray, base: np.ndarray | float) -> np.ndarray:
        """Discounted relative frequency of counts r > 0."""
        return self.d[np.minimum(r, K)] ** (r <= K) * r / base


def ranks(order: np.ndarray) -> np.ndarray:
    """The place that an order gives each row."""
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return rank


def home(lot: int, parts: int) -> int:
    """The part that a lot's own rows are sent to."""
    return int(part_of(K_.mix(np.array([lot], np.uint64), 23), parts)[0])


def in_lots(rows: DataFrame, parts: int, at_once: int, wide: int) -> DataFrame:
    """Texts as lots of `wide` bytes, in slices of `at_once`, and each lot's distinct words (by part, then hash) with their
    times in learning texts. A slice has its own distinct words as places among the lot's."""

    def sent(lot: int, slices: list[tuple]) -> pa.RecordBatch:
        keys, found = K_.distinct(np.concatenate([x[0] for x in slices]))
        times = np.bincount(found, weights=np.concatenate([x[1] for x in slices])).astype(np.int64)
        part = part_of(keys, parts)
        order = np.argsort(part, kind="stable")
        rank = ranks(order)
        edge = np.searchsorted(part[order], np.arange(parts + 1))
        bodies, at = [], 0
        for h, _, back, sizes, meta in slices:
            own = rank[found[at : at + len(h)]]
            at += len(h)
            ascending = np.argsort(own)
            bodies.append(pack(meta, np.diff(own[ascending], prepend=0), ranks(ascending)[back], sizes))
        out = [(home(lot, parts), lot, LOT, pack(*bodies), None)]
        for p in np.flatnonzero(np.diff(edge)).tolist():
            own = order[edge[p] : edge[p + 1]]
            out.append((p, lot, WORDS, pack(keys[own].tobytes(), times[own]), None))
        return rows_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId() << 32  # the same if the task is run again
        held, size = [], 0
        for batch in batches:
            for i, j in K_.slices(batch.column(1), at_once):
                mine = batch.slice(i, j - i)
                h, row = tokens(mine.column(1))
                distinct, back = K_.distinct(h)
                learned = mine.column(2).to_numpy(zero_copy_only=False)
                meta = as_ipc(pa.RecordBatch.from_arrays([mine.column(0), mine.column(2)], ["doc_id", "learn"]))
                held.append((distinct, np.bincount(back, weights=learned[row]), small(back), np.bincount(row, minlength=j - i), meta))
                size += mine.column(1).nbytes
                if size + at_once > wide:
                    yield sent(lot, held)
                    lot, held, size = lot + 1, [], 0
        if held:
            yield sent(lot, held)

    return rows.mapInArrow(run, ROW)


def count_words(dealt: DataFrame, parts: int) -> DataFrame:
    """Each part's words with their counts (TABLE; few: tokens, words, then how many words come 1..K+1 times); to the
    lots, in their order, their words' numbers (by falling count within the part) and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1):
            rows = listed(group)
            yield rows_of([(*r, None) for r in rows if r[2] == LOT])
            rows = [(r, unpack(r[3])) for r in rows if r[2] == WORDS]
            if not rows:
                continue
            h = [np.frombuffer(x[0], np.uint64) for _, x in rows]
            keys, back = K_.distinct(np.concatenate(h))
            c = np.bincount(back, weights=np.concatenate([x[1] for _, x in rows])).astype(np.int64)
            p, learned = rows[0][0][0], c > 0
            number = np.full(len(c), UNKNOWN)
            number[np.argsort(-c, kind="stable")[: int(learned.sum())]] = np.arange(int(learned.sum())) * parts + p
            if learned.sum() * parts + p >= BEGIN:
                raise OverflowError("more words than numbers")
            few = np.bincount(np.minimum(c[learned], K + 2), minlength=K + 3)[1 : K + 2]
            out = [(p, -1, TABLE, pack(keys[learned].tobytes(), c[learned]), [int(c.sum()), int(learned.sum()), *few.tolist()])]
            at = 0
            for (r, _), x in zip(rows, h, strict=True):
                own = back[at : at + len(x)]
                at += len(x)
                out.append((p, r[1], WORDS, pack(number[own], c[own]), None))
            yield rows_of(out)

    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, ROW)


def lot_of(lot: int, meta: bytes, bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lot], pa.int64()), pa.array([meta], pa.binary()), pa.array([pack(*bodies)], pa.binary())], ["lot", "meta", "body"])


def slices_of(body: bytes) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each slice of a lot (numbers of its tokens' words among the slice's own, tokens of each text, whether it is learned,
    the words' ascending numbers, what is known of each), and how many texts are before it."""
    first = 0
    for one in unpack(body):
        x = unpack(one)
        x[3] = np.cumsum(x[3])
        yield first, x
        first += len(x[1])


def number_lots(answered: DataFrame, parts: int, uni: Level, n: int, v: int) -> DataFrame:
    """Lots as word numbers: meta (rows of the result so far, scored by single words) and body."""
    denominator = n + 0.5 * (v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1, at=1):
            rows = sorted((r for r in listed(group)), key=lambda r: (r[2], r[0]))
            got = [unpack(r[3]) for r in rows[1:]]
            every = [np.concatenate([x[i] for x in got]) for i in (0, 1)]
            metas, bodies = [], []
            for one in unpack(rows[0][3]):
                meta, own, back, sizes = unpack(one)
                ids, c = (x[np.cumsum(own)] for x in every)
                row = np.repeat(np.arange(len(sizes)), sizes)
                per_row = lambda w: np.bincount(row, weights=w[back], minlength=len(sizes))  # noqa: B023, E731
                p = np.where(c > 0, uni.p(np.maximum(c, 1), uni.total), uni.unknown)
                (old,) = pa.ipc.open_stream(meta)
                learned = old.column(1).to_numpy(zero_copy_only=False)
                metas.append(pa.RecordBatch.from_arrays([old.column(0), pa.array(~learned), pa.array(sizes), pa.array(per_row(c > 0).astype(np.int64)), pa.array(np.full(len(sizes), n)), pa.array(per_row(np.log10((c + 0.5) / denominator))), pa.array(per_row(np.log10(p)))], list(NAMES)))
                # the mark of the beginning has a place among the slice's numbers, words that were not learned have one together
                values, index = K_.distinct(np.append(ids, BEGIN))
                times = np.zeros(len(values), np.int64)
                times[index[:-1]] = c
                bodies.append(pack(index[:-1][back], sizes, learned, np.diff(values, prepend=0), times))
            new = pa.Table.from_batches(metas).combine_chunks().to_batches()[0]
            yield lot_of(rows[0][1], as_ipc(new), bodies)

    return answered.repartition(parts, "lot").sortWithinPartitions("lot").mapInArrow(run, "lot long, meta binary, body binary")


NAMES = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def before(x: np.ndarray, sizes: np.ndarray, first) -> np.ndarray:
    """x of the token before; first for each text's first."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[np.cumsum(sizes) - sizes] = first
    return out


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def ranked(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of rows by columns, the first one first, and whether each row in it differs from the one before.
    What is sorted are numbers of 64 bits that end with the row's place: columns that would not fit are ranked first."""
    n = len(columns[0])
    place = np.uint64(n.bit_length())

    def sort(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = key << place | np.arange(n, dtype=np.uint64)
        key.sort()
        return (key & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64), changes(key >> place)

    key, bits = np.zeros(n, np.uint64), 0
    for c in columns:
        most = c[c < BEGIN].max(initial=0)
        c = np.where(c >= BEGIN, c - BEGIN + most + 1, c)
        width = int(c.max(initial=0)).bit_length()
        if bits + width + int(place) > 64:
            order, new = sort(key)
            key = np.empty(n, np.uint64)
            key[order] = np.cumsum(new) - 1
            bits = int(new.sum()).bit_length()
        if bits + width + int(place) > 64:
            order = np.lexsort(columns[::-1])
            return order, changes(*(x[order] for x in columns))
        key, bits = key << np.uint64(width) | c.astype(np.uint64), bits + width
    return sort(key)


@dataclass
class Asked:
    """A slice's n-grams of one order, sorted: by part, words, text."""

    words: list[np.ndarray]  # of the distinct ones
    lower: np.ndarray  # their count in the lower order
    base: np.ndarray  # of each distinct context, the divisor of its lower order (0: the order's own total)
    hot: np.ndarray
    times: np.ndarray
    doc: np.ndarray  # text * 2 + learned, of each occurrence
    edge: np.ndarray  # of the parts, among the distinct ones
    back: np.ndarray  # the distinct one of each of the slice's tokens, -1 for those not asked
    in_hot: list[np.ndarray]  # text, times, context's words of what is asked in hot contexts

    def starts(self) -> np.ndarray:
        """Whether each distinct one is its context's first in its part."""
        out = changes(*self.words[:-1]) if len(self.lower) else np.zeros(0, bool)
        out[self.edge[:-1][self.edge[:-1] < len(out)]] = True
        return out


def ask(values: np.ndarray, words: list[np.ndarray], asked: np.ndarray, doc: np.ndarray, lower: np.ndarray, base: np.ndarray, hot: np.ndarray, parts: int, turn: int = 0, turns: int = 1) -> Asked:
    """words: each token's n-gram, as indices of the ascending values. Of `turns` equal shares of the parts, those of one
    are asked."""
    number = values.astype(np.uint64)
    key = K_.mix(number, 21)[words[0]]
    for w in words[1:-1]:
        key = K_.mix(key + number[w], 21)
    key = np.where(hot, K_.mix(key + number[words[-1]], 22), key) if hot.any() else key
    part = part_of(key, parts)
    at = np.flatnonzero(asked & (part % turns == turn) if turns > 1 else asked)
    cols, doc, hot, part = [w[at] for w in words], doc[at], hot[at], part[at]
    in_hot = [doc[hot] >> 1, *(w[hot] for w in cols[:-1])]
    order, new = ranked(*in_hot)
    e = np.flatnonzero(new)
    in_hot = [in_hot[0][order[e]], np.diff(np.append(e, len(order))), *(values[x[order[e]]] for x in in_hot[1:])]
    order, new = ranked(part, *cols)  # tokens come in the order of their texts
    e = np.flatnonzero(new)
    first = order[e]
    cols, part = [w[first] for w in cols], part[first]
    context = changes(part, *cols[:-1])
    back = np.full(len(asked), -1)
    back[at[order]] = np.cumsum(new) - 1
    return Asked([values[w] for w in cols], lower[at[first]], base[at[first[context]]], hot[first], np.diff(np.append(e, len(order))), doc[order], np.searchsorted(part, np.arange(parts + 1)), back, in_hot)


def send(lot: int, asked: Iterable[Asked], parts: int) -> pa.RecordBatch:
    """The rows of what a lot asks, one a part, its slices one after another; and one of what its texts have in hot
    contexts. The first word ascends within a slice of a part, so its steps are sent."""
    n, held, in_hot = 0, [], []
    for a in asked:
        n = len(a.words)
        begins = a.edge[:-1][np.diff(a.edge) > 0]
        step = np.diff(a.words[0], prepend=0)
        step[begins] = a.words[0][begins]
        contexts, occurrences = (np.concatenate([[0], np.cumsum(x)])[a.edge].tolist() for x in (a.starts(), a.times))
        edge = a.edge.tolist()
        held.append([(small(x), at) for x, at in [*((x, edge) for x in (step, *a.words[1:], a.lower)), (a.base, contexts), (a.hot, edge), (a.times, edge), (a.doc, occurrences)]])
        in_hot.append(a.in_hot)
    out = []
    for p in range(parts):
        sizes = np.array([x[0][1][p + 1] - x[0][1][p] for x in held])
        if sizes.any():
            out.append((p, lot, n, pack(sizes, *(np.concatenate([v[at[p] : at[p + 1]] for v, at in x]) for x in zip(*held, strict=True))), None))
    if any(len(x[0]) for x in in_hot):
        doc, times, *words = (np.concatenate(x) for x in zip(*in_hot, strict=True))
        out.append((home(lot, parts), lot, HOT_SUMS, pack(doc, np.zeros(len(doc), bool), times, *words), None))
    return rows_of(out)


def steps_back(sizes: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that steps lead to, each slice from 0, and where the slices begin."""
    begins = np.cumsum(sizes) - sizes
    begins, sizes = begins[sizes > 0], sizes[sizes > 0]
    to = np.cumsum(step)
    return to - np.repeat(to[begins] - step[begins], sizes), begins


def look_up(sent: DataFrame, parts: int, low: Level, answer: bool) -> DataFrame:
    """Per part: the order's table, what its hot contexts add up to, and for each lot the sums of its texts; if answer,
    also each n-gram's count and its context's divisor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1):
            rows = listed(group)
            out = [(*r, None) for r in rows if r[2] == HOT_SUMS]
            rows = [r for r in rows if r[2] != HOT_SUMS]
            if not rows:
                yield rows_of(out)
                continue
            p, n = rows[0][0], rows[0][2]
            lots, got, opens = [r[1] for r in rows], [], []
            for r in rows:
                sizes, step, *x = unpack(r[3])
                to, begins = steps_back(sizes, step)
                got.append([to, *x])
                opens.append(changes(*got[-1][: n - 1]))  # a context, in a slice
                opens[-1][begins] = True
            del rows, group
            size = np.array([len(x[0]) for x in got])
            words = [np.concatenate([x[i] for x in got]) for i in range(n)]
            order, new = ranked(*words)
            back = np.empty_like(order)
            back[order] = np.cumsum(new) - 1
            first = order[new]
            words = [w[first] for w in words]
            lower = np.concatenate([x[n] for x in got])[first]
            # a context's divisor comes once in each slice: spread over the slice's n-grams, then one each
            spread = [x[n + 1][np.cumsum(new_) - 1] for x, new_ in zip(got, opens, strict=True)]
            base_low = np.concatenate(spread)[first].astype(float)
            del spread
            base_low[base_low == 0] = low.total
            is_hot = np.concatenate([x[n + 2] for x in got])[first] > 0
            learned = np.concatenate([np.add.reduceat(x[n + 4] & 1, np.cumsum(x[n + 3]) - x[n + 3]) for x in got])
            r = np.bincount(back, weights=learned).astype(np.int64)
            starts = changes(*words[:-1])
            of = np.cumsum(starts) - 1
            first_of = np.flatnonzero(starts)
            hot = is_hot[starts]
            total, few, mass = _added(r, of, np.where(r > 0, low.p(np.maximum(lower, 1), base_low), 0.0))
            seen = r > 0
            few_kinds, few_of = _kinds(few)
            base, alpha = _logs(total, few, mass)
            gain = np.where(seen, np.log10(np.maximum(r, 1)) - np.log10(low.p(np.maximum(lower, 1), base_low)), 0.0)
            out.append((p, -1, TABLE, pack(np.diff(words[0][seen], prepend=0), *(w[seen] for w in words[1:]), r[seen]), np.bincount(np.minimum(r, K + 2), minlength=K + 3)[1 : K + 2].tolist()))
            if hot.any():
                out.append((p, -1, HOT, pack(*(w[starts][hot] for w in words[:-1]), total[hot], few[hot].ravel(), mass[hot]), None))
            at = 0
            for lot, x, new_, k in zip(lots, got, opens, size.tolist(), strict=True):
                own = back[at : at + k]
                at += k
                if answer:
                    ctx = of[own][new_]
                    out.append((p, lot, PAIRS, pack(r[own], np.where(hot[ctx], 0, total[ctx] + (few[ctx].sum(axis=1) == 0))), None))
                e, doc = np.repeat(own, x[n + 3]), x[n + 4] >> 1
                docs, doc = K_.distinct(doc)
                ctx, rr = of[e], r[e]
                cold, known = ~hot[ctx], rr > 0
                backs_off = cold & ~known & (total[ctx] > 0)
                fixed = np.bincount(doc, weights=gain[e] - np.where(cold & known, base[ctx], 0.0) + np.where(backs_off, alpha[ctx], 0.0), minlength=len(docs))
                few_times = np.flatnonzero(known & (rr <= K))
                ones = np.bincount((rr[few_times] - 1) * len(docs) + doc[few_times], minlength=K * len(docs))
                pair, times = np.unique(doc[backs_off] * len(few_kinds) + few_of[ctx[backs_off]], return_counts=True)
                used, f = np.unique(pair % len(few_kinds), return_inverse=True)
                fixed = np.rint(fixed / UNIT).astype(np.int64)
                least = fixed.min(initial=0)
                out.append((p, lot, SUMS, pack(np.diff(docs, prepend=0), np.array([-least]), fixed - least, ones, pair // len(few_kinds), f, times, few_kinds[used].ravel()), None))
                if (missed := ~cold & ~known).any():
                    pair, times = np.unique(doc[missed] * len(total) + ctx[missed], return_counts=True)
                    ctx = first_of[pair % len(total)]
                    out.append((p, lot, HOT_SUMS, pack(docs[pair // len(total)], np.ones(len(pair), bool), times, *(w[ctx] for w in words[:-1])), None))
                if len(out) > 200:
                    yield rows_of(out)
                    out = []
            yield rows_of(out)

    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, ROW)


def _kinds(few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and which of them each is. Columns are packed into one number as long as that fits."""
    key = np.zeros(len(few), np.int64)
    bits = 0
    for c in few.T:
        width = int(c.max(initial=0)).bit_length()
        if bits + width > 63:
            values, key = K_.distinct(key)
            bits = len(values).bit_length()
        key, bits = key << width | c, bits + width
    values, of = K_.distinct(key)
    first = np.empty(len(values), np.int64)
    first[of[::-1]] = np.arange(len(few))[::-1]
    return few[first], of


def _added(r: np.ndarray, of: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each context: tokens, n-grams that come 1..K times, and the lower order's mass of its n-grams."""
    m = int(of[-1]) + 1 if len(of) else 0
    few = np.stack([np.bincount(of, weights=r == i, minlength=m) for i in range(1, K + 1)], axis=1).astype(np.int64)
    return np.bincount(of, weights=r, minlength=m).astype(np.int64), few, np.bincount(of, weights=p, minlength=m)


def _logs(total: np.ndarray, few: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each context's divisor, and of its backoff weight but for what discounting frees (see _freed)."""
    base = np.log10(np.maximum(total + (few.sum(axis=1) == 0), 1))
    return base, -base - np.log10(np.maximum(1 - mass, 1e-12))


def _freed(few: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 of the counts that discounting frees in a context; of the one that is added where there are none."""
    freed = few @ ((1 - d[1:]) * np.arange(1, K + 1))
    return np.log10(np.where(few.sum(axis=1) > 0, freed, 1.0))


class Hot:
    """Contexts that are dealt by their n-grams: fewer than 2 / `held` of all tokens. What each part says of them is added
    up on the executors; one row a context comes back."""

    def __init__(self, table: DataFrame, n: int):
        names = [*(f"w{i}" for i in range(n - 1)), "total", *(f"few{i}" for i in range(K)), "mass"]

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for body in batch.column(0):
                    *words, total, few, mass = unpack(body.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*words, total, *few.reshape(-1, K).T, np.asarray(mass, float))], names)

        rows = table.filter(F.col("kind") == HOT).select("body").mapInArrow(spread, ", ".join(f"{x} {'double' if x == 'mass' else 'long'}" for x in names))
        sums = rows.groupBy(*names[: n - 1]).agg(*(F.sum(x).alias(x) for x in names[n - 1 :])).orderBy(*names[: n - 1]).toArrow()
        columns = [c.to_numpy() for c in sums.columns]
        self.words = [c.astype(np.int64) for c in columns[: n - 1]]
        stats = np.stack([c.astype(float) for c in columns[n - 1 :]], axis=1)
        self.total, self.few = stats[:, 0], stats[:, 1:-1]
        self.base, self.alpha = _logs(self.total, self.few, stats[:, -1])
        self.divisor = self.total + (self.few.sum(axis=1) == 0)

    def find(self, words: list[np.ndarray]) -> np.ndarray:
        """Which one each context is."""
        both = [np.concatenate([a, b]) for a, b in zip(self.words, words, strict=True)]
        _, back = np.unique(np.stack(both), axis=1, return_inverse=True)
        return back.ravel()[len(self.words[0]) :]


def score(docs: DataFrame, learn: Column, held: int = 1_500_000, at_once: int = 3 << 20, share: int = 64 << 10) -> DataFrame:
    """doc_id, held_out (not learn), n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text).

    learn: which rows the model is learned from. Null text is empty and has its end token alone; repeated rows are each
    learned and scored, equal ones alike; a very long text is a lot of its own; other columns of docs are left out,
    whatever their names. Without rows to learn from every token is of the unknown class. An empty table gives an empty
    table. Scores are log10; base_score has add-half unigram counts. held: about how many tokens a task holds; at_once: how
    many bytes of text it works on at a time; share: of how many bytes of text a lot has the n-grams for each part.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(True)).alias("learn"))
    size = rows.agg(F.sum(F.length("text")), F.count_if("learn")).first()
    parts, texts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size[0] or 0) // (6 * held))), size[1]
    wide = max(at_once, min(LOT_BYTES, parts * share))
    answered = Table(count_words(in_lots(rows, parts, at_once, wide), parts))
    words = cut(answered.rows.filter(F.col("kind") == TABLE))
    few = [int(x or 0) for x in words.agg(*(F.sum(F.get("few", F.lit(i))) for i in range(K + 3))).first()]
    n, v, few = few[0], few[1], np.array(few[2:], float)
    d = discounts(few)
    left = float(((1 - d[1:]) * np.arange(1, K + 1) * few[:K]).sum())
    uni = Level(d, *((n, left / n) if left > 0 else (n + 1, 1 / (n + 1))))
    lots = Table(number_lots(answered.rows.filter(F.col("kind").isin(LOT, WORDS)).select("part", "lot", "kind", "body", "few"), parts, uni, n, v))
    answered.remove()

    def pairs(first: int, back: np.ndarray, sizes: np.ndarray, learned: np.ndarray, ids: np.ndarray, c: np.ndarray) -> Asked:
        ahead = before(back, sizes, np.searchsorted(ids, BEGIN))
        row, c = np.repeat(np.arange(len(sizes)), sizes), c[back]
        return ask(ids, [ahead, back], ids[ahead] != UNKNOWN, (first + row) * 2 + learned[row], c, np.zeros(len(c), np.int64), before(c, sizes, texts) > held // 2, parts)

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield send(lot, (pairs(first, *x) for first, x in slices_of(body.as_py())), parts)

    two = Table(look_up(lots.rows.select("lot", "body").mapInArrow(send_pairs, ROW), parts, uni, answer=True), by="kind")
    level2, hot2 = _level(two.rows), Hot(two.rows, 2)

    def with_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1, at=1):
            metas = dict(zip(group.column(2).to_pylist(), group.column(4).to_pylist(), strict=True))
            rows = sorted(listed(group), key=lambda r: (r[2], r[0]))
            got = [unpack(x[3]) for x in rows[1:]]
            place = np.zeros((2, parts), np.int64)  # how far each part's answers have been taken
            for i in (0, 1):
                ends = np.cumsum([len(x[i]) for x in got])
                place[i, [x[0] for x in rows[1:]]] = ends - [len(x[i]) for x in got]
            answers = [np.concatenate([np.zeros(0, np.int64), *(x[i] for x in got)]) for i in (0, 1)]
            del got

            def taken(i: int, n: np.ndarray) -> np.ndarray:
                """The next n answers of each part."""
                at = np.repeat(place[i] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))  # noqa: B023
                place[i] += n  # noqa: B023
                return answers[i][at]  # noqa: B023

            bodies = []
            for before_, x in slices_of(rows[0][3]):
                a = pairs(before_, *x)
                back, sizes, learned, ids, _ = x
                starts = a.starts()
                r, divisor = taken(0, np.diff(a.edge)), taken(1, np.diff(np.concatenate([[0], np.cumsum(starts)])[a.edge]))
                base = np.zeros(len(ids), np.int64)
                if len(r):
                    context = a.words[0][starts]
                    hot = divisor == 0
                    if hot.any():
                        divisor[hot] = hot2.divisor[hot2.find([context[hot]])]
                    context, first = np.unique(context, return_index=True)
                    at = np.minimum(np.searchsorted(context, ids), len(context) - 1)
                    base = np.where(context[at] == ids, divisor[first][at], 0)
                r = np.where(a.back >= 0, r[a.back], 0) if len(r) else np.zeros(len(back), np.int64)
                bodies.append(pack(back, sizes, learned, np.diff(ids, prepend=0), r, base))
            yield lot_of(rows[0][1], metas[LOT], bodies)

    both = lots.rows.select(F.lit(0).alias("part"), "lot", F.lit(LOT).alias("kind"), "body", "meta").unionByName(two.rows.filter(F.col("kind") == PAIRS).select("part", "lot", "kind", "body", F.lit(None).cast("binary").alias("meta")))
    paired = Table(both.repartition(parts, "lot").sortWithinPartitions("lot").mapInArrow(with_pairs, "lot long, meta binary, body binary"))
    lots.remove()
    two.remove(PAIRS)

    def asked(turn: int, first: int, back: np.ndarray, sizes: np.ndarray, learned: np.ndarray, ids: np.ndarray, r: np.ndarray, base: np.ndarray) -> Asked:
        row = np.repeat(np.arange(len(sizes)), sizes)
        ahead = before(back, sizes, np.searchsorted(ids, BEGIN))
        ahead2, ahead_r = before(ahead, sizes, 0), before(r, sizes, 0)  # not asked where a text begins, nor where the context was not learned: it backs off whole
        return ask(ids, [ahead2, ahead, back], ahead_r > 0, (first + row) * 2 + learned[row], r, before(base[back], sizes, 0), ahead_r > held // 2, parts, turn, TURNS)

    def triples(turn: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lot, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield send(lot, (asked(turn, first, *x) for first, x in slices_of(body.as_py())), parts)

        return look_up(paired.rows.select("lot", "body").mapInArrow(run, ROW), parts, level2, answer=False)

    turns = [Table(triples(k)).rows for k in range(TURNS)]
    three = turns[0]
    for more in turns[1:]:
        three = three.unionByName(more)
    orders = [(level2.d, hot2), (_level(three).d, Hot(three, 3))]
    kind_of = docs.schema["doc_id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1, at=1):
            rows = listed(group)
            (meta,) = pa.ipc.open_stream(next(r[3] for r in rows if r[2] == LOT))
            s = meta.column(6).to_numpy().copy()
            for order, (d, hot) in enumerate(orders, 2):
                got = [unpack(r[3]) for r in rows if r[0] == order and r[2] == SUMS]
                if got:
                    docs_ = [np.cumsum(x[0]) for x in got]
                    fixed = np.concatenate([x[2] - x[1] for x in got]) * UNIT
                    ones = np.concatenate([x[3].reshape(K, -1) for x in got], axis=1)
                    s += np.bincount(np.concatenate(docs_), weights=fixed + np.log10(d[1:]) @ ones, minlength=len(s))
                    doc, times = np.concatenate([of[x[4]] for of, x in zip(docs_, got, strict=True)]), np.concatenate([x[6] for x in got])
                    few, kinds = np.concatenate([x[7] for x in got]).reshape(-1, K), [len(x[7]) // K for x in got]
                    kind = np.concatenate([x[5] for x in got]) + np.repeat(np.cumsum(kinds) - kinds, [len(x[5]) for x in got])
                    s += np.bincount(doc, weights=times * _freed(few, d)[kind], minlength=len(s))
                got = [unpack(r[3]) for r in rows if r[0] == order and r[2] == HOT_SUMS]
                if got:
                    doc, missed, times, *words_ = (np.concatenate(x) for x in zip(*got, strict=True))
                    at = hot.find(words_)
                    s += np.bincount(doc, weights=times * np.where(missed > 0, (hot.base + hot.alpha + _freed(hot.few, d))[at], -hot.base[at]), minlength=len(s))
            yield pa.RecordBatch.from_arrays([*meta.columns[:6], pa.array(s)], list(NAMES))

    sums = [t.filter(F.col("kind").isin(SUMS, HOT_SUMS)).select(F.lit(o).alias("part"), "lot", "kind", "body") for o, t in ((2, two.rows), (3, three))]
    metas = paired.rows.select(F.lit(0).alias("part"), "lot", F.lit(LOT).alias("kind"), F.col("meta").alias("body"))
    return metas.unionByName(sums[0]).unionByName(sums[1]).repartition(parts, "lot").sortWithinPartitions("lot").mapInArrow(gather, f"doc_id {kind_of}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _level(table: DataFrame) -> Level:
    few = table.filter(F.col("kind") == TABLE).agg(*(F.sum(F.get("few", F.lit(i))) for i in range(K + 1))).first()
    return Level(discounts(np.array([int(x or 0) for x in few], float)))
