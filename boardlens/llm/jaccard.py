"""N-gram Jaccard self-join by partitioning the universe (pigeonhole), verified exactly.

A document's set is its distinct word shingles. Two sets of sizes s and l with
Jaccard similarity of at least t differ in at most (1-t)/(1+t) * (s+l) members.
Members are hashed into more segments than that, so some segment of the two is
equal: each segment's content is a signature, and sets that share one are
candidates. Sizes form bands of ratio 1/t**2 that overlap by half, so every
pair that can link meets in a band, and a band has as many segments as its
largest pair needs, and some to spare.

Which segments a set is indexed by follows from their cost. Empty segments and
those made of common members only (as counted in a bounded sample; it sways the
cost, never the result) match too many others and are skipped, as long as the
rest are more than the sets may differ in. A set left with fewer also indexes
the contents of its segments with one member deleted, which catches segments
that differ by one and so counts a segment twice; a set left short even then
indexes all its segments among the sets of its kind. The rules look at contents
only, so both sides of a pair agree on them.

Signatures travel packed, by ranges of their value; equal ones are found by
sorting. A signature of more than ``HOT_SETS`` sets leaves this way: its sets are
grouped by the table's own aggregation and cut into slices of about
``SLICE_SETS``, and no task holds more of it than a slice. Groups of sets that share a signature are never expanded into pairs:
one member is compared with the others, the links found are joined into
components, and only groups that still hold several components go on, with the
best-linked members as the next ones to compare, more in each round, until every
pair of a group is compared or known to be connected. Comparisons are first by
parity sketches, which refute pairs for certain but confirm none; what they
leave is verified on the sets. So no link is lost and a group of thousands of
copies costs a few comparisons each.

Sets are told apart by 64-bit keys of their members' 64-bit keys: equal texts
are one set from the start. Nulls and odd rows: texts that are null or have no
word are empty, linked with nothing; with fewer words than a shingle the whole
text is one; a null key takes part but names no component; rows that repeat are
rows of one set; an empty table gives an empty result; columns other than key
and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardlens.llm import words as W
from boardlens.llm.shared import drop_table, lean, materialise
from boardlens.operators.components import LOCAL_EDGES, connected_components, local_components

U64 = np.uint64
SHINGLE = 5
#: Link if PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Segments beyond those that the pigeonhole needs.
SPARE = 1.15
#: Texts that common members are counted in, and in how many of them one is common.
SAMPLE_TEXTS, COMMON_IN, MAX_COMMON = 4_000, 4, 1 << 16
#: Signatures that a task holds before it hands them on, and that a part has about (a set has about one for each member).
FLUSH_ROWS, PART_ROWS = 1 << 18, 1 << 20
#: Partitions that the parts are dealt to at most.
MAX_PARTITIONS = 1 << 14
BLOOM_BITS = 1 << 26
#: Sets of one signature from which on they are grouped in slices, sets of a slice about, signatures that a task holds before it looks for such ones.
HOT_SETS, SLICE_SETS, HELD_SIGS = 1 << 16, 1 << 14, 1 << 21


def shingle_rows(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) of the distinct shingles of each text in order of row and key, and the rows' set sizes, from its words' keys."""
    many = np.bincount(row, minlength=rows)
    n = len(keys) - SHINGLE + 1
    h = np.zeros(max(n, 0), U64)
    for j in range(SHINGLE if n > 0 else 0):
        h *= U64(0x9E3779B97F4A7C15)
        h += keys[j : j + n]
        h ^= h >> U64(29)
    at = np.flatnonzero(row[:n] == row[SHINGLE - 1 :]) if n > 0 else np.zeros(0, np.int64)
    h, r = W.mix(h[at]), row[:n][at] if n > 0 else row[:0]
    few = np.flatnonzero((many > 0) & (many < SHINGLE))
    if len(few):  # short texts: all their words are one shingle
        first = np.searchsorted(row, few)
        one = np.zeros(len(few), U64)
        for j in range(SHINGLE - 1):
            on = many[few] > j
            one[on] = one[on] * U64(0x9E3779B97F4A7C15) + keys[first[on] + j]
            one[on] ^= one[on] >> U64(29)
        h, r = np.concatenate([h, W.mix(one + many[few].astype(U64))]), np.concatenate([r, few])
    if rows == 1:
        h.sort()
    else:
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return r, h, np.bincount(r, minlength=rows)


def set_keys(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's set (0 for empty sets)."""
    out = np.zeros(len(size), U64)
    some = np.flatnonzero(size)
    if len(some):
        total = np.add.reduceat(W.mix(h ^ U64(0x5851F42D4C957F2D)), np.searchsorted(row, some))
        out[some] = np.maximum(W.mix(total + size[some].astype(U64) * U64(0x2545F4914F6CDD1D)), U64(1))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _sets(column: pa.Array):
    """(first row, rows, row, member, sizes, set keys) of runs of rows."""
    held: list[np.ndarray] = []  # of a text that comes in windows, the keys of its words
    for a, rows, ended, _, _, _, _, row, keys in W.word_runs(column):
        if held or not ended:
            held.append(keys)
            if not ended:
                continue
            keys, held = np.concatenate(held), []
            row = np.zeros(len(keys), np.int64)
        row, h, size = shingle_rows(keys, row, rows)
        yield a, rows, row, h, size, set_keys(row, h, size)


@cache
def cell_start(c: int) -> int:
    """The least size in cell c (cells grow by 100 / PERCENT)."""
    x = (100 / PERCENT) ** c
    return int(np.ceil(x - 1e-9))


def _cells(size: np.ndarray) -> np.ndarray:
    starts = np.array([cell_start(c) for c in range(200) if cell_start(c) < 1 << 40])
    return np.searchsorted(starts, size, side="right") - 1


def differ(a, b):
    """Most members in which linked sets of these sizes differ."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def band_segments(g: int) -> int:
    """Segments of band g, whose smaller sets lie in cell g."""
    top = max(cell_start(g + 1) - 1, cell_start(g))
    return max(2, int(np.ceil(SPARE * (differ(top, top * 100 // PERCENT) + 1))))


def signatures(row: np.ndarray, h: np.ndarray, size: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) by which the sets are indexed, in all their bands."""
    out_row, out_sig = [], []
    cells = _cells(np.maximum(size, 1))
    plain = np.ones(len(h), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        plain = common[at] != h
    value = W.mix(h ^ U64(0xD1342543DE82EF95))
    for upper in (False, True):
        band = cells - upper
        can = (size >= 3) & (band >= 0)
        use = can[row]
        if not use.any():
            continue
        r, v, p = row[use], value[use], plain[use]
        bands, place = np.unique(np.where(can, band, 0), return_inverse=True)
        m = np.array([band_segments(int(g)) for g in bands])[place]
        top = np.array([max(cell_start(int(g) + 1) - 1, cell_start(int(g))) for g in bands])[place]
        most = differ(size, top if upper else size * 100 // PERCENT)
        seg = ((W.mix(h[use] + band[r].astype(U64) * U64(0x9E6C63D0876A9A47)) >> U64(32)) * m[r].astype(U64) >> U64(32)).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(np.where(can, m, 0))])
        key = base[r] + seg
        order = np.argsort(key, kind="stable")
        key, v, p, r = key[order], v[order], p[order], r[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(v, head)
        plains = np.add.reduceat(p.astype(np.int64), head)
        seg_row, seg_key = r[head], key[head]
        name = W.mix((seg_key - base[seg_row]).astype(U64) + band[seg_row].astype(U64) * U64(1 << 32))

        def sig(content: np.ndarray, of: np.ndarray, space: int) -> np.ndarray:
            return W.mix(content + of + U64(space * 0xA24BAED4963EE407 % (1 << 64)))

        exact = np.flatnonzero(plains > 0)
        out_row.append(seg_row[exact])
        out_sig.append(sig(total[exact], name[exact], 1))
        n1 = np.bincount(seg_row[plains == 1], minlength=len(size))
        n2 = np.bincount(seg_row[plains > 1], minlength=len(size))
        short = can & (n1 + n2 <= most)
        if not short.any():
            continue
        # Short of segments: contents with one member deleted count their segments twice.
        own = exact[short[seg_row[exact]]]
        out_row.append(seg_row[own])
        out_sig.append(sig(total[own], name[own], 2))
        many = short[r] & np.repeat(plains > 1, np.diff(np.append(head, len(key))))
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key))))[many]
        out_row.append(r[many])
        out_sig.append(sig(total[group] - v[many], name[group], 2))
        # Short even so: all segments, the empty ones too, among sets of this kind.
        bare = np.flatnonzero(short & (n1 + 2 * n2 <= most))
        if len(bare):
            rows = np.repeat(bare, m[bare])
            segs = np.arange(len(rows)) - np.repeat(np.cumsum(m[bare]) - m[bare], m[bare])
            content = np.zeros(len(rows), U64)
            at = np.searchsorted(seg_key, base[rows] + segs)
            hit = (at < len(seg_key)) & (seg_key[np.minimum(at, len(seg_key) - 1)] == base[rows] + segs)
            content[hit] = total[at[hit]]
            out_row.append(rows)
            out_sig.append(sig(content, W.mix(segs.astype(U64) + band[rows].astype(U64) * U64(1 << 32)), 3))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(out_row), np.concatenate(out_sig)


#: Bytes of a signature that travel (its part stands for its upper bits; a chance match only costs a comparison).
_SIG_BYTES, _MOST = 5, (1 << 16) - 1


def _pack(part: np.ndarray, node: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blobs by part: sets, signatures per set, signatures."""
    order = np.lexsort((node, part))
    part, node, sig = part[order], node[order], sig[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        nodes, counts = np.unique(node[a:b], return_counts=True)
        if counts.max() > _MOST:  # a set that holds more stands there again
            again = -(-counts // _MOST)
            last = np.cumsum(again) - 1
            rest = counts - (again - 1) * _MOST
            nodes, counts = np.repeat(nodes, again), np.full(int(again.sum()), _MOST)
            counts[last] = rest
        low = np.ascontiguousarray(sig[a:b]).view(np.uint8).reshape(-1, 8)[:, :_SIG_BYTES]
        yield int(part[a]), np.array([len(nodes), b - a], "<i8").tobytes() + nodes.tobytes() + counts.astype("<u2").tobytes() + low.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.frombuffer(blob, "<i8", 2)
    nodes = np.frombuffer(blob, "<u8", k, 16)
    counts = np.frombuffer(blob, "<u2", k, 16 + 8 * k)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :_SIG_BYTES] = np.frombuffer(blob, np.uint8, _SIG_BYTES * n, 16 + 10 * k).reshape(-1, _SIG_BYTES)
    return np.repeat(nodes, counts), wide.view("<u8").ravel()


def groups_of(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group key, first place, sets joined) of the distinct groups of two or more sets that share a signature."""
    order = np.argsort(sig, kind="stable")
    s = sig[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    order = order[same[1:] | same[:-1]]
    order = order[np.lexsort((node[order], sig[order]))]
    s, n = sig[order], node[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1])
    s, n = s[keep], n[keep]
    if not len(s):
        return np.zeros(0, U64), np.zeros(1, np.int64), n
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    many = np.diff(np.append(head, len(s)))
    gid = W.mix(np.add.reduceat(W.mix(n), head) + many.astype(U64))
    _, first = np.unique(gid, return_index=True)
    first = first[many[first] > 1]
    size = many[first]
    ends = np.cumsum(size)
    at = np.repeat(head[first] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return gid[first], np.concatenate([[0], ends]), n[at]


def _common_members(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Members that several of a bounded sample of texts hold (sorted keys)."""
    every = max(1, n_docs // SAMPLE_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, h, size, _ in _sets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), _signed(h))], names=["h"])

    sample = docs.where(F.pmod(F.xxhash64("k", F.length("t")), F.lit(every)) == 0).select("t")
    held = sample.mapInArrow(lean(run), "h array<long>").select(F.explode("h").alias("h")).groupBy("h").count().where(F.col("count") >= COMMON_IN)
    top = held.orderBy(F.desc("count"), "h").limit(MAX_COMMON).select("h").toArrow()
    return np.sort(np.asarray(top["h"]).astype(np.int64).view(U64))


def candidate_groups(docs: DataFrame, n_docs: int, members: int) -> DataFrame:
    """(gid, sig, nodes): distinct groups of sets that share a signature; where ``sig`` is given, some sets of that hot one."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(_common_members(docs, n_docs))  # at most MAX_COMMON keys
    bits = max(6, int(np.ceil(np.log2(max(1, members) / PART_ROWS + 1e-9))))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: np.ndarray = np.zeros(0, U64)
        nodes, sigs, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            node, sig = np.concatenate(nodes), np.concatenate(sigs)
            for part, blob in _pack((sig >> U64(64 - bits)).astype(np.int64), node, sig):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

        for batch in batches:
            for _, _, row, h, size, key in _sets(batch.column(0)):
                # A task indexes equal sets once.
                first = np.zeros(len(key), bool)
                first[np.unique(key, return_index=True)[1]] = True
                first &= (key != 0) & ~np.isin(key, seen)
                seen = np.concatenate([seen, key[first]])
                on = first[row]
                r, s = signatures(row[on], h[on], np.where(first, size, 0), common.value)
                nodes.append(key[r])
                sigs.append(s)
                held += len(s)
                if held >= FLUSH_ROWS:
                    yield from flush()
                    nodes, sigs, held = [], [], 0
        if held:
            yield from flush()

    hot_sets, held_sigs = HOT_SETS, HELD_SIGS
    names = ["gid", "sig", "nodes"]

    def lists(nodes: np.ndarray, cut: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), _signed(nodes))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last, rows, hot = None, 0, np.zeros(0, U64)

        def cool() -> Iterator[pa.RecordBatch]:
            """Hand the sets of hot signatures on."""
            nonlocal held, rows, hot
            node, sig = (np.concatenate(x) for x in zip(*held, strict=True))
            values, many = np.unique(sig, return_counts=True)
            hot = np.union1d(hot, values[many > hot_sets])
            out = np.isin(sig, hot)
            order = np.argsort(sig[out], kind="stable")
            node_out, sig_out = node[out][order], sig[out][order]
            held, rows = [(node[~out], sig[~out])], int((~out).sum())
            if len(sig_out):
                # Of a signature as much as fits a list: equal values lie together.
                cut = np.unique(np.concatenate([np.flatnonzero(np.concatenate([[True], sig_out[1:] != sig_out[:-1]])), np.arange(0, len(sig_out), 1 << 16), [len(sig_out)]]))
                value = W.mix(sig_out[cut[:-1]] + U64(last * 0x9E3779B97F4A7C15 % (1 << 64)))
                own = W.mix(np.add.reduceat(W.mix(node_out), cut[:-1]) ^ value)  # equal pieces are one
                yield pa.RecordBatch.from_arrays([_signed(own), _signed(value), lists(node_out, cut)], names=names)

        def finish() -> Iterator[pa.RecordBatch]:
            if len(hot):
                yield from cool()
            gid, cut, nodes = groups_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if len(gid) and np.diff(cut).max() > hot_sets:
                yield from cool()
                gid, cut, nodes = groups_of(*held[0])
            if len(gid):
                yield pa.RecordBatch.from_arrays([_signed(gid), pa.nulls(len(gid), pa.int64()), lists(nodes, cut)], names=names)

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != last and held:
                    yield from finish()
                    held, rows, hot = [], 0, hot[:0]
                last = part
                held.append(_unpack(blob.as_buffer()))
                rows += len(held[-1][0])
                if rows > held_sigs:
                    yield from cool()
        if held:
            yield from finish()

    blobs = docs.select("t").mapInArrow(lean(index), "part int, blob binary")
    dealt = blobs.repartition(min(1 << bits, MAX_PARTITIONS), "part").sortWithinPartitions("part")
    found = dealt.mapInArrow(lean(match), "gid long, sig long, nodes array<long>")
    return found.groupBy("gid").agg(F.first("sig").alias("sig"), F.first("nodes").alias("nodes"))


def slices_of(hot: DataFrame) -> DataFrame:
    """(gid, slice, nodes): the distinct groups of the hot signatures' sets, in slices."""
    rows = materialise(hot.select("sig", F.explode("nodes").alias("node")).distinct(), "jaccard-hot")
    own = F.xxhash64(F.col("node"), F.lit(3))
    groups = rows.groupBy("sig").agg(F.bit_xor(own).alias("x"), F.count("*").alias("n")).select("sig", "n", F.xxhash64("x", "n").alias("gid"))
    one = groups.groupBy("gid").agg(F.min("sig").alias("sig"), F.first("n").alias("n"))
    of = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SLICE_SETS)).cast("int")
    return rows.join(one, "sig").groupBy("gid", of.alias("slice")).agg(F.collect_list("node").alias("nodes"))


def sketch(members: np.ndarray) -> bytes:
    """Parity of the members by bit, in a power of two of bits, two a member or more.

    Each member flips one bit, so two sketches (folded to one length) differ in
    no more bits than their sets differ in members.
    """
    bits = max(256, 1 << int(np.ceil(np.log2(max(1, 2 * len(members))))))
    odd = np.bincount((members & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _fold(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the shortest."""
    size = min(map(len, sketches))
    out = np.empty((len(sketches), size // 8), U64)
    for i, raw in enumerate(sketches):
        x = np.frombuffer(raw, U64)
        while len(x) > size // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def _members(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, size, sketch, members) of the sets in ``groups``; copies met by other tasks repeat."""
    spark = docs.sparkSession
    wanted = groups.select(F.explode("nodes").alias("node")).distinct()

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in batches:
            at = (np.asarray(batch.column(0)).view(U64) >> U64(38)).astype(np.int64)
            np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        packed = packed.reshape(64, -1)
        at = [i for i in range(64) if packed[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([packed[i].tobytes() for i in at], pa.binary())], names=["s", "bits"])

    def either(part: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce(np.stack([np.frombuffer(b, np.uint8) for b in part["bits"].to_pylist()]))
        return pa.table({"s": pa.array([part["s"][0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    packed = np.zeros((64, BLOOM_BITS // 512), np.uint8)  # 8 MB, whatever the input
    for r in wanted.coalesce(16).mapInArrow(lean(bits), "s int, bits binary").groupBy("s").applyInArrow(either, "s int, bits binary").collect():
        packed[r["s"]] = np.frombuffer(r["bits"], np.uint8)
    slots = spark.sparkContext.broadcast(packed.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, U64)
        for batch in batches:
            for _, _, row, h, size, key in _sets(batch.column(0)):
                at = (key >> U64(38)).astype(np.int64)
                first = np.zeros(len(key), bool)
                first[np.unique(key, return_index=True)[1]] = True
                first &= (key != 0) & (slots.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) & ~np.isin(key, seen)
                seen = np.concatenate([seen, key[first]])
                cut = np.searchsorted(row, np.arange(len(key) + 1))
                some = np.flatnonzero(first).tolist()
                if some:
                    sets = [h[cut[i] : cut[i + 1]] for i in some]
                    yield pa.RecordBatch.from_arrays([_signed(key[some]), pa.array(size[some], pa.int64()), pa.array(map(sketch, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "size", "sketch", "members"])

    return docs.select("t").mapInArrow(lean(run), "node long, size long, sketch binary, members binary")


def compare_group(node: np.ndarray, part: np.ndarray, degree: np.ndarray, size: np.ndarray, sketches: list[bytes], centres: int, first: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(pairs worth verifying, nodes that go on) of one group.

    The best-linked members are compared with all members of other components;
    sketches refute most pairs that are no link. ``first``: stop at the first
    member that some pair is left of, and let it go on (not all its pairs are
    verified at once); members before it have no link here and are done.
    """
    if (part == part[0]).all():
        return [], node[:0]
    order = np.lexsort((node, -degree))
    node, part, size = node[order], part[order], size[order]
    rows = _fold([sketches[i] for i in order.tolist()])
    pairs: list[tuple[int, int]] = []
    done = min(centres, len(node))
    for c in range(done):
        at = np.flatnonzero((part != part[c]) & (differ(size, size[c]) >= np.abs(size - size[c])))
        at = at[at > c]
        apart = np.bitwise_count(rows[at] ^ rows[c]).sum(1)
        at = at[apart <= differ(size[at], size[c])]
        pairs += [(int(node[c]), int(node[i])) for i in at.tolist()]
        if first and pairs:
            done = c
            break
    rest = node[done:]
    return pairs, rest if len(rest) > 1 else node[:0]


def verify(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, linked) of distinct candidate pairs, by exact intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            linked = []
            for i in range(len(batch)):
                u, v = (np.frombuffer(c[i].as_buffer(), U64) for c in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if pairs.count() <= LOCAL_EDGES:  # a checked number of 8-byte keys
        met = F.broadcast(met)
    sets = members.select("node", "members").join(met, "node", "left_semi").dropDuplicates(["node"])
    full = pairs.join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b").select("a", "b", "a_set", "b_set")
    return full.mapInArrow(lean(run), "a long, b long, linked boolean")


TURN = "gid long, a long, b long, nodes array<long>"
#: Members of a group that are compared with the others, by turn.
CENTRES = (64, 1, 64, 4096)


def _comparer(centres: int, first: bool):
    def compare(group: pa.Table) -> pa.Table:
        gid = group["gid"][0].as_py()
        pairs, rest = compare_group(*(np.asarray(group[c]) for c in ("node", "part", "degree", "size")), group["sketch"].to_pylist(), centres, first)
        n = len(pairs)
        more = [rest.tolist()] if len(rest) else []
        lo, hi = [min(p) for p in pairs], [max(p) for p in pairs]
        k = n + len(more)
        return pa.table({"gid": pa.array([gid] * k, pa.int64()), "a": pa.array(lo + [None] * len(more), pa.int64()), "b": pa.array(hi + [None] * len(more), pa.int64()), "nodes": pa.array([None] * n + more, pa.list_(pa.int64()))})

    return compare


def _facts(short: DataFrame, links: DataFrame | None, parts: DataFrame | None) -> DataFrame:
    """(node, size, sketch, part, degree) of the sets as far as links are known."""
    if parts is not None:
        degree = links.select("a").union(links.select("b")).groupBy("a").count()
        facts = short.join(parts, "node", "left").join(degree.toDF("node", "degree"), "node", "left")
    else:
        facts = short.withColumns({"component": F.lit(None).cast("long"), "degree": F.lit(0).cast("long")})
    return facts.select("node", "size", "sketch", F.coalesce("component", "node").alias("part"), F.coalesce("degree", F.lit(0)).alias("degree"))


def _most_met(pairs: DataFrame) -> DataFrame:
    """Of each set's pairs the one that is met most often."""
    both = pairs.select("a", "b", F.col("a").alias("of")).union(pairs.select("a", "b", F.col("b").alias("of")))
    met = both.groupBy("of", "a", "b").count()
    return met.groupBy("of").agg(F.max_by(F.struct("a", "b"), F.struct("count", "a", "b")).alias("p")).select("p.*")


def _linked(pairs: DataFrame, members: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(links, components) with those that verification finds among ``pairs``."""
    pairs = materialise(pairs.distinct(), "jaccard-pairs")
    found = materialise(verify(pairs, members).where("linked").select("a", "b"), "jaccard-links")
    drop_table(pairs)
    links = found if links is None else links.unionByName(found)
    # A checked number of links is joined in one task; beyond it, by forests and rounds over all.
    return links, (local_components if links.count() <= LOCAL_EDGES else connected_components)(links)


def _beside(group: pa.Table) -> pa.Table:
    """Pairs worth verifying of a slice's sets with the centres of its group."""
    centre = np.asarray(group["centre"])
    node, part, size = (np.asarray(group[c]) for c in ("node", "part", "size"))
    rows = _fold(group["sketch"].to_pylist())
    members, pairs = np.flatnonzero(~centre), []
    for c in np.flatnonzero(centre).tolist():
        at = members[(part[members] != part[c]) & (differ(size[members], size[c]) >= np.abs(size[members] - size[c]))]
        at = at[np.bitwise_count(rows[at] ^ rows[c]).sum(1) <= differ(size[at], size[c])]
        pairs.append(np.stack([np.minimum(node[at], node[c]), np.maximum(node[at], node[c])]))
    a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


#: Sets of a sliced group that are compared with all its others, by turn.
SLICED_CENTRES = (1, 16, 256)


def link_slices(slices: DataFrame, short: DataFrame, members: DataFrame, links: DataFrame | None, parts: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(links, components) with those of groups in slices: the best-linked sets of a group go to each of its slices, turn by turn."""
    rows = materialise(slices.select("gid", "slice", F.explode("nodes").alias("node")), "jaccard-sliced")
    done = rows.select("gid", "node").limit(0)
    for turn in range(1 << 20):
        facts = rows.join(_facts(short, links, parts), "node")
        apart = facts.groupBy("gid").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("gid")
        facts = facts.join(apart, "gid", "left_semi")
        best = Window.partitionBy("gid").orderBy(F.desc("degree"), "node")
        left = facts.join(done, ["gid", "node"], "left_anti")
        centres = left.withColumn("r", F.row_number().over(best)).where(F.col("r") <= SLICED_CENTRES[min(turn, len(SLICED_CENTRES) - 1)])
        centres = materialise(centres.select("gid", "node", "size", "sketch", "part"), "jaccard-centres")
        if not centres.limit(1).count():
            return links, parts
        columns = ["gid", "slice", "node", "size", "sketch", "part"]
        sent = centres.join(slices.select("gid", "slice"), "gid").select(*columns, F.lit(True).alias("centre"))
        met = facts.select(*columns, F.lit(False).alias("centre")).unionByName(sent).groupBy("gid", "slice").applyInArrow(_beside, "a long, b long")
        pairs = materialise(met, "jaccard-turn")
        done = done.union(centres.select("gid", "node")) if turn else done  # the first turn verifies one pair a set
        links, parts = _linked(pairs if turn else _most_met(pairs), members, links)


def link_groups(groups: DataFrame, short: DataFrame, members: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(links found, components of the linked sets) of the candidate groups; see the module's text."""
    left = groups
    links: DataFrame | None = None
    parts: DataFrame | None = None
    for turn in range(1 << 20):
        centres = CENTRES[min(turn, len(CENTRES) - 1)]
        facts = _facts(short, links, parts)
        rows = left.select("gid", F.explode("nodes").alias("node"))
        if parts is not None:  # groups that are one component need no sketches
            apart = rows.join(facts.select("node", "part"), "node").groupBy("gid").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("gid")
            rows = rows.join(apart, "gid", "left_semi")

        done = materialise(rows.join(facts, "node").groupBy("gid").applyInArrow(_comparer(centres, turn == 0), TURN), "jaccard-turn")
        pairs = done.where("a IS NOT NULL").select("a", "b")
        # Each set is first verified with the one that it meets most often.
        links, parts = _linked(pairs if turn else _most_met(pairs), members, links)
        if left is not groups:
            drop_table(left)
        left = done.where("nodes IS NOT NULL").select("gid", "nodes")  # whose members have not all met
        if not left.limit(1).count():
            break
    return links, parts


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: key, n_shingles, component_id (the smallest key reachable by links), set_links.

    ``set_links`` counts the links that were verified for the text's set (links
    inside a component that were not needed to connect it are not counted).
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def size_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, _, _, size, node in _sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(size, pa.int64()), _signed(node)], names=["k", "n", "node"])

    kind = docs.schema[key].dataType.simpleString()
    sets = materialise(rows.mapInArrow(lean(size_up), f"k {kind}, n long, node long"), "jaccard-sets")
    totals = sets.agg(F.count("*"), F.sum("n")).first()
    found = materialise(candidate_groups(rows, totals[0], totals[1] or 0), "jaccard-groups")
    groups, hot = found.where("sig IS NULL").select("gid", "nodes"), found.where("sig IS NOT NULL")
    slices = materialise(slices_of(hot), "jaccard-slices") if hot.limit(1).count() else None
    every = groups.select("nodes") if slices is None else groups.select("nodes").unionByName(slices.select("nodes"))
    members = materialise(_members(rows, every), "jaccard-members")
    short = materialise(members.select("node", "size", "sketch").dropDuplicates(["node"]), "jaccard-sketches")
    links, parts = link_groups(groups, short, members)
    if slices is not None:
        links, parts = link_slices(slices, short, members, links, parts)
    if links is None:
        links = docs.sparkSession.createDataFrame([], "a long, b long")
    nodes = sets.where("node <> 0").groupBy("node").agg(F.min("k").alias("least"))
    if parts is not None:
        nodes = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
        nodes = nodes.join(least, "component").select("node", "component_id")
    else:
        nodes = nodes.select("node", F.col("least").alias("component_id"))
    degree = links.select("a", "b").union(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    nodes = materialise(nodes.join(degree, "node", "left"), "jaccard-nodes")
    for table in (members, short, found):
        drop_table(table)
    out = sets.join(nodes, "node", "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "k").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("set_links"))
