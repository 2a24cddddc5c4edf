"""N-gram Jaccard join by T-occurrence search (DivideSkip).

1. Each text becomes its set of hashed word shingles; texts with equal sets are one class from here on.
2. Sets of Jaccard similarity J or more share one of the first n - J n + 1 shingles of each, in any order that is the
   same for all. Ordered by how many sets have a shingle, rarest first, sets most of whose shingles are theirs alone
   drop out at once. Classes of about equal size with a prefix shingle in common are candidates of each other, and
   connected candidates form a group. No pair is ever formed here.
3. In a group, inverted lists over its shingles are searched: for a query of n shingles and the least overlap T that
   its partners need, short lists are merged and counted, long ones are probed by binary search for those that can
   still reach T, and the ones that do are linked. As only components are asked for, the group's first class is
   searched, and then every class outside the largest component: any link between two components has an end there.
4. Groups with more shingles than a task should hold are dealt into blocks. The group's first class is in each; classes
   not connected to it within their own block are searched in all other blocks too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.components import components
from millrace.llm.store import Table, cut


def bands(percent: int, most: int = 1 << 33) -> np.ndarray:
    """Least size of each size band: linked sets are in one band or in two neighbouring ones."""
    least = [1]
    while least[-1] < most:
        least.append(least[-1] * 100 // percent + 1)
    return np.array(least)


def set_ids(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set; equal sets have equal ones. Empty sets have 0."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        begin = at[:-1][some]
        out[some] = K.mix(np.add.reduceat(K.mix(keys, 5), begin) ^ K.mix(np.add.reduceat(K.mix(keys, 6), begin) + n[some].astype(np.uint64), 3), 4)
    return out.view(np.int64)


class Lists:
    """Inverted lists over the sets of a block."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        all_ = np.concatenate(sets)
        self.tokens, local = np.unique(all_, return_inverse=True)
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        self.n = len(sets)
        self.postings = np.sort(local.astype(np.int64) * self.n + doc)
        self.ends = np.cumsum(np.bincount(local, minlength=len(self.tokens)))
        self.own = np.split(local, np.cumsum(self.sizes)[:-1])

    def find(self, query: np.ndarray) -> np.ndarray:
        """Local tokens of a set from outside the block; those that are in no list have none."""
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        return at[self.tokens[at] == query]

    def search(self, tokens: np.ndarray, n: int, percent: int, skip: np.ndarray) -> np.ndarray:
        """Sets of the block whose similarity to a set of n shingles (tokens: those that have lists) is percent or
        more, without those in skip (a mask)."""
        lowest, highest = -(-percent * n // 100), 100 * n // percent
        fits = (self.sizes >= lowest) & (self.sizes <= highest) & ~skip
        need = -(-percent * (n + self.sizes) // (100 + percent))  # overlap asked for, by partner
        if not fits.any():
            return np.zeros(0, np.int64)
        least = int(need[fits].min())
        if len(tokens) < least:
            return np.zeros(0, np.int64)
        begin = np.where(tokens > 0, self.ends[np.maximum(tokens - 1, 0)], 0)
        length = self.ends[tokens] - begin
        order = np.argsort(length, kind="stable")
        tokens, begin, length = tokens[order], begin[order], length[order]
        longest = int(length[-1])
        n_long = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)))
        n_short = len(tokens) - n_long
        span = length[:n_short]
        at = np.repeat(begin[:n_short] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        merged = self.postings[at] - np.repeat(tokens[:n_short], span) * self.n  # the lists' entries, merged by document
        count = np.bincount(merged, minlength=self.n)
        found = np.flatnonzero(fits & (count >= np.maximum(need - n_long, 1)))
        count = count[found]
        for a in range(n_short, len(tokens), 64):  # binary probes of the long lists, the candidates fewer each time
            if not len(found):
                break
            b = min(a + 64, len(tokens))
            want = tokens[a:b, None] * self.n + found[None, :]
            there = np.searchsorted(self.postings, want)
            count = count + (self.postings[np.minimum(there, len(self.postings) - 1)] == want).sum(axis=0)
            may = count + (len(tokens) - b) >= need[found]
            found, count = found[may], count[may]
        return found[count >= need[found]] if len(found) else found


def link_block(sets: list[np.ndarray], percent: int, first: int = 0) -> np.ndarray:
    """Component of each set of a block, as the index of one of its sets."""
    lists = Lists(sets)
    comp, done, i = np.arange(lists.n), np.zeros(lists.n, bool), first
    while True:
        done[i] = True
        found = lists.search(lists.own[i], len(sets[i]), percent, comp == comp[i])
        if len(found):
            comp[np.isin(comp, np.unique(comp[found]))] = comp[i]
        size = np.bincount(comp, minlength=lists.n)
        rest = np.flatnonzero((comp != size.argmax()) & ~done)
        if not len(rest):
            return comp
        i = int(rest[0])


def groups_of(batches: Iterator[pa.RecordBatch], keys: int, at: int = 0) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal values in `keys` columns from column `at`, whole across batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(at, at + keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != held_key:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def identified(docs: DataFrame, shingle: int) -> DataFrame:
    """_doc, _text (hash), n (shingles), cid of each row; texts are left behind."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in K.slices(batch.column(2), 2 << 20):
                keys, at = K.shingles(*K.words(*K.utf8(batch.column(2).slice(i, j - i))), j - i, shingle)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(at)), pa.array(set_ids(keys, at))], ["_doc", "_text", "n", "cid"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(make, f"_doc {kind}, _text long, n long, cid long")


def first_of(sig: np.ndarray, cid: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (sig, cid, to): each signature with its least class; each other class that has it with that one (to), once
    for each two classes and under a number of its own in place of a signature."""
    order = np.lexsort((cid, sig))
    sig, cid = sig[order], cid[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    least = cid[new][np.cumsum(new) - 1]
    other = cid != least
    link = np.unique(np.stack([cid[other], least[other]], axis=1), axis=0)
    own = K.mix(link[:, 0].view(np.uint64) + K.mix(link[:, 1].view(np.uint64), 11), 12).view(np.int64)
    whole = pa.RecordBatch.from_arrays([pa.array(np.concatenate([sig[new], own])), pa.array(np.concatenate([cid[new], link[:, 0]])), pa.array(np.concatenate([np.zeros(int(new.sum()), np.int64), link[:, 1]]), mask=np.arange(int(new.sum()) + len(link)) < int(new.sum()))], ["sig", "cid", "to"])
    for i in range(0, whole.num_rows, 1 << 17):
        yield whole.slice(i, 1 << 17)


def prefixes(doc: np.ndarray, level: np.ndarray, token: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which of the shared shingles (doc, level, token) are in their set's prefix: sets of n shingles that link have one
    in common among the first n - percent * n / 100 + 1 of each, rarest first. Shingles that no other set has come
    first of all and are not given here."""
    order = np.lexsort((token, level, doc))
    shared = np.bincount(doc, minlength=len(n))
    room = n - -(-percent * n // 100) + 1 - (n - shared)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(shared) - shared, shared)
    return order[rank < room[doc[order]]]


def candidates(docs: DataFrame, shingle: int, percent: int, total: int, held: int = 2_000_000, most: int = 1_000_000) -> DataFrame:
    """node, root: classes that may link, in components of what shares a prefix shingle (never as pairs).

    Shingles, as 48-bit hashes dealt by other bits of theirs, are counted over all sets; those that a second set has go
    back to their sets with their frequency. (Two that are taken for one by their hash only make more candidates.) A
    set's rarest shingles are its prefix, which says whether anything can link with it at all. Prefix shingles are
    exchanged with the set's class; what a task holds (some `most` at a time) it links before it sends, so one that very
    many classes share sends a row for each such lot. total: all shingles; a task counts some `held` of them.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // held))
    least = bands(percent)
    names = ["part", "lot", "doc", "token", "level"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId() << 32  # the same if the task is run again
        for batch in batches:
            for i, j in K.slices(batch.column(0), 2 << 20):
                keys, at = K.shingles(*K.words(*K.utf8(batch.column(0).slice(i, j - i))), j - i, shingle)
                n, cid = np.diff(at), set_ids(keys, at)
                if not len(keys):
                    continue
                _, first = np.unique(cid, return_index=True)
                once = np.zeros(len(n), bool)
                once[first] = n[first] > 0  # copies in a lot count once
                keys, doc = keys[np.repeat(once, n)], np.repeat(np.arange(int(once.sum())), n[once])
                part = ((K.mix(keys, 13) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(lot % parts, K.planes(n[once].astype(np.uint64), 5), cid[once].tobytes(), None)]
                for p in np.flatnonzero(np.diff(edge)).tolist():
                    mine = order[edge[p] : edge[p + 1]]
                    rows.append((p, K.planes(doc[mine], 4), K.planes(keys[mine], 6), b""))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([lot] * len(rows), pa.int64()), *(pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2, 3))], names)
                lot += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1):
            sizes = group.filter(pc.is_null(group.column(4)))
            if sizes.num_rows:
                yield sizes
            group = group.filter(pc.is_valid(group.column(4)))
            token = [K.unplanes(x.as_py(), 6) for x in group.column(3)]
            if not token:
                continue
            _, back, times = np.unique(np.concatenate(token), return_inverse=True, return_counts=True)
            level = np.minimum(255, 8 * np.log2(times)).astype(np.uint8)[back]
            at = 0
            for r, mine in enumerate(token):
                own = level[at : at + len(mine)]
                at += len(mine)
                if (own > 0).any():
                    doc = K.unplanes(group.column(2)[r].as_py(), 4)[own > 0]
                    yield pa.RecordBatch.from_arrays([*group.slice(r, 1).columns[:2], *(pa.array([x], pa.binary()) for x in (K.planes(doc, 4), K.planes(mine[own > 0], 6), own[own > 0].tobytes()))], names)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for group in groups_of(batches, 1, at=1):
            sizes = pc.is_null(group.column(4))
            (of,) = group.filter(sizes).to_pylist()
            n, cid = K.unplanes(of["doc"], 5).astype(np.int64), np.frombuffer(of["token"], np.int64)
            group = group.filter(pc.invert(sizes))
            if not group.num_rows:
                continue
            doc = np.concatenate([K.unplanes(x.as_py(), 4) for x in group.column(2)]).astype(np.int64)
            token = np.concatenate([K.mix(K.unplanes(x.as_py(), 6), 14 + p) for p, x in zip(group.column(0).to_pylist(), group.column(3), strict=True)])
            level = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in group.column(4)])
            mine = prefixes(doc, level, token, n, percent)
            band = np.searchsorted(least, n, "right")[doc[mine]].astype(np.uint64)
            for up in (0, 1):
                waiting.append((K.mix(token[mine] + K.mix(band + np.uint64(up), 9), 10).view(np.int64), cid[doc[mine]]))
            if sum(len(x) for x, _ in waiting) > most:
                yield from first_of(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting = []
        if waiting:
            yield from first_of(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

    blobs = "part int, lot long, doc binary, token binary, level binary"
    shared = Table(docs.select("text").mapInArrow(send, blobs).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, blobs))
    sent = shared.rows.repartition(parts, "lot").sortWithinPartitions("lot").mapInArrow(choose, "sig long, cid long, to long")
    to = F.min(F.coalesce("to", "cid")).over(Window.partitionBy("sig"))
    found = components(sent.select("cid", to.alias("a")).filter("cid != a").select(F.col("cid").alias("b"), "a"))
    shared.remove()
    return found


def join(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = 1_500_000, root: bool = False) -> DataFrame:
    """doc_id, text_hash (xxhash64), n_shingles, component_id per row of docs (doc_id, text): rows link when 100 * intersection is at least
    percent * union of their sets of distinct word shingles; component_id is the least doc_id that links reach.

    Null, empty and blank texts have no shingles and are linked with nothing (component_id is their own doc_id); a text
    with fewer words than a shingle is one shingle. Equal rows are linked as any equal texts are; a null doc_id is
    ignored as a component's least one unless all are null. block: shingles that one search task holds.
    root: also root, a number of the component that rows of other components never have; null without shingles.
    """
    spark, table = docs.sparkSession, cut(identified(docs, shingle))
    firsts = table.filter("n > 0").groupBy("cid").agg(F.min("_doc").alias("doc"), F.min(F.struct("_doc", "_text")).alias("_one"), F.first("n").alias("n"))
    near = candidates(docs, shingle, percent, table.agg(F.sum("n")).first()[0] or 0)
    members = near.select(F.col("node").alias("cid"), F.col("root").alias("comp")).join(firsts, "cid")
    blocks = members.groupBy("comp").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    members = members.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    least = -(1 << 63)
    wanted = members.select("comp", "block", "blocks", "cid", F.coalesce(F.col("_one._doc").cast("long"), F.lit(least)).alias("_d"), F.col("_one._text").alias("_t"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("_d"), F.xxhash64("text").alias("_t"), "text").join(wanted, ["_d", "_t"]).select("comp", "block", "blocks", "cid", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in K.slices(batch.column(4), 2 << 20):
                keys, at = K.shingles(*K.words(*K.utf8(batch.column(4).slice(i, j - i))), j - i, shingle)
                part, raw = batch.slice(i, j - i), keys.tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["comp", "block", "blocks", "cid", "grams"])

    sets = texts.mapInArrow(to_sets, "comp long, block int, blocks int, cid long, grams binary")
    sets = cut(sets)  # texts are exchanged for it, and go before sets are
    many = bool(blocks.filter("blocks > 1").head(1))
    if many:
        anchors = sets.filter("cid = comp and blocks > 1").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("_b != block").select("comp", F.col("_b").alias("block"), "blocks", "cid", "grams")
        sets_in = sets.union(anchors)
    else:
        sets_in = sets

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 2):
            cid, first = np.unique(group.column(3).to_numpy(), return_index=True)
            found = [np.frombuffer(group.column(4)[i].as_py(), np.uint64) for i in first.tolist()]
            comp = group.column(0)[0].as_py()
            parts = link_block(found, percent) if len(found) > 1 else np.zeros(1, int)
            roots = np.full(len(cid), np.iinfo(np.int64).max)
            np.minimum.at(roots, parts, cid)
            roots = roots[parts]
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(roots), pa.array(roots != comp) if group.column(2)[0].as_py() > 1 else pa.array(np.zeros(len(cid), bool))], ["cid", "root", "apart"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    linked = cut(sets_in.repartition(n, "comp", "block").sortWithinPartitions("comp", "block").mapInArrow(search, "cid long, root long, apart boolean"))
    labels = linked.select("cid", "root")
    if many and linked.filter("apart").head(1):
        # a set's least root in any block; what this links already is not searched or sent again
        known = linked.groupBy("cid").agg(F.min("root").alias("root"), F.max("apart").alias("apart"))
        rooted = sets.join(known, "cid").select("comp", "block", "blocks", "cid", "root", "apart", "grams")
        asked = rooted.filter("apart").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("_b != block").select("comp", F.col("_b").alias("block"), F.lit(-1).alias("blocks"), "cid", "root", "apart", "grams")

        def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in groups_of(batches, 2):
                asks = group.column(2).to_numpy() < 0
                if not asks.any() or asks.all():
                    continue
                roots, of = np.unique(group.column(4).to_numpy(), return_inverse=True)
                comp = np.arange(len(roots))
                grams = [np.frombuffer(x.as_py(), np.uint64) for x in group.column(6)]
                own = np.flatnonzero(~asks)
                lists = Lists([grams[i] for i in own])
                for i in np.flatnonzero(asks):
                    mine = comp[of[i]]
                    got = lists.search(lists.find(grams[i]), len(grams[i]), percent, comp[of[own]] == mine)
                    if len(got):
                        new = np.unique(comp[of[own[got]]])
                        comp[np.isin(comp, new)] = mine
                        # one row for each component that joins: fewer than the block has roots
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), roots[mine])), pa.array(roots[new])], ["a", "b"])

        busy = asked.select("comp", "block").distinct()
        more = rooted.join(busy, ["comp", "block"], "left_semi").select(asked.columns).union(asked).repartition(n, "comp", "block").sortWithinPartitions("comp", "block").mapInArrow(across, "a long, b long")
        labels = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")).union(more)).select(F.col("node").alias("cid"), "root")
    labels = labels.groupBy("cid").agg(F.min("root").alias("root"))
    named = firsts.select("cid", "doc").join(labels, "cid", "left").select("cid", "doc", F.coalesce("root", "cid").alias("root"))
    least_doc = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = named.join(least_doc, "root").select("cid", "component_id", "root")
    rows = table.select(F.col("_doc").alias("doc_id"), F.col("_text").alias("text_hash"), F.col("n").alias("n_shingles"), "cid").join(named, "cid", "left")
    return rows.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *(["root"] if root else []))
