"""Removing repeated passages: depth-limited most-significant-digit radix sort of suffixes, distributed.

A byte goes when it lies in a window of ``LENGTH`` bytes that also starts earlier (smaller doc_id, or same document,
earlier start). Suffixes need to be ordered only through LENGTH bytes: groups that are still equal then are exactly
the repeated windows.

First digit, by Spark: each window's minimiser (the smallest hash of its GRAM-byte substrings, leftmost on ties)
depends on the window's bytes only, so equal windows meet in one group. Windows whose minimiser occurs once cannot
repeat. 1. Count minimiser hashes over all documents; those that occur twice are marked in a bit map of fixed size
(bounded broadcast; a fuller map only lets more through), and those that occur over HOT times in another. 2. Marked
anchors are shuffled by hash with the bytes around them (all their windows); anchors with equal bytes meet in their
task already, and only the first of them is sent with its bytes: of the others every window stands earlier. 3. Within a
group anchors with equal bytes count once more, and the windows of the others are ordered by digits of 8 bytes, the most
significant first, each pass looking only into groups that are still equal. The digits are the bytes themselves: what is
equal after the last one is equal byte by byte. 4. Runs of repeated windows are joined to the documents and cut.

Hot minimisers (a common line) are dealt out by further digits: their windows are split by where the anchor stands in
them, STEP places a class, and by the LENGTH - STEP + 1 bytes that all windows of that class hold there.

Documents with equal bytes are found by digest first: of windows in later copies everything goes, and only the first
copy goes through the steps above, so large groups of copies cost one row each.

Scale: rows of a group arrive ordered by (doc_id, position) and are streamed in bounded chunks; what is kept of a group
is its different windows so far. A group has up to HOT anchors, or windows that agree in all but STEP - 1 bytes.

Edge cases: null text is empty; texts under LENGTH bytes lose nothing; rows with the same doc_id and different texts are
ordered by a hash of the text; rows that repeat both doc_id and text are judged as one and get the same result; a null
doc_id comes last; an empty table gives an empty result. As text, what is left loses the sequences that a cut broke.
Carried columns may have any name but those of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._bitmap import bit_map, marked
from tessera.llm._spark import cut, drop_table
from tessera.llm._text import U, chunks, mix

LENGTH = 100
GRAM = 31
STEP = 7
HOT = 1024
MAP_BITS, HOT_BITS = 27, 24
STREAM_ROWS = 4096
SEND_ROWS = 50_000
SEGMENT = 1 << 22
_A = U(0x9E3779B97F4A7C15)
NONE = U(0xFFFFFFFFFFFFFFFF)


def _loads(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each place, little endian (zeros past the end)."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    return np.ndarray(shape=(len(raw),), dtype="<u8", buffer=padded, strides=(1,)).copy()


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place where there are so many."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U)
    e = _loads(raw)
    h = np.zeros(n, U)
    for at in (0, 8, 16, GRAM - 8):
        h = (h ^ e[at : at + n]) * _A
        h ^= h >> U(29)
    return mix(h)


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest (leftmost on ties) of v[i:i+w], for each i."""
    n = len(v) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = U(24)
    packed = (v >> bits << bits) | np.arange(len(v), dtype=U)
    size = -(-len(v) // w) * w
    full = np.full(size, NONE, U)
    full[: len(v)] = packed
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
    return (least & ((U(1) << bits) - U(1))).astype(np.int64)


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start, place): each minimiser of one text with the run of window starts it stands for."""
    hs, firsts, lasts, places = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(raw) - LENGTH + 1, SEGMENT):
        # ties must be judged alike in every text, so only the bits that are left beside any place count
        h = gram_hashes(raw[a : a + SEGMENT + LENGTH - 1]) >> U(24) << U(24)
        place = sliding_argmin(h, LENGTH - GRAM + 1)
        new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        hs.append(mix(h[place[new]]))
        firsts.append(new + a)
        lasts.append(np.concatenate((new[1:], [len(place)])) - 1 + a)
        places.append(place[new] + a)
    return np.concatenate(hs), np.concatenate(firsts), np.concatenate(lasts), np.concatenate(places)


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, raw, off in chunks(column):
        for a, b in zip(off[:-1], off[1:], strict=True):
            yield raw[a:b]


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, how often) of a batch's anchors."""
    for batch in batches:
        found = [anchors(t)[0] for t in _texts(batch.column("text"))]
        h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, U), np.zeros(0, int))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])


def _repeated_hashes(docs: DataFrame) -> DataFrame:
    """h, n of the minimiser hashes that occur more than once."""
    counts = docs.select("text").mapInArrow(_anchor_counts, "h long, n int")
    return cut(counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "minimisers")


def _classes(t: np.ndarray, h: int, lo: int, hi: int, place: int) -> Iterator[tuple[int, int, int]]:
    """A hot anchor's windows by class: (key, first start, last start). All windows of a class that are equal hold the
    same LENGTH - STEP + 1 bytes around the anchor, which make the key."""
    for c in range((place - hi) // STEP, (place - lo) // STEP + 1):
        own = t[place - c * STEP : place - c * STEP + LENGTH - STEP + 1].tobytes()
        key = int.from_bytes(hashlib.blake2b(own, digest_size=8, salt=int(h).to_bytes(8, "little") + bytes([c])).digest(), "little")
        yield key, max(lo, place - c * STEP - STEP + 1), min(hi, place - c * STEP)


class _Sender:
    """Rows (h, doc_id, g, first, n, ctx) of anchors; of those with equal bytes only the first keeps its bytes."""

    def __init__(self):
        self.best: dict[tuple[int, bytes], tuple] = {}
        self.later: list[tuple] = []

    def add(self, h: int, doc_id: int | None, g: int, first: int, n: int, ctx: bytes) -> None:
        order = (doc_id is None, doc_id or 0, g, first)
        old = self.best.get((h, ctx))
        if old is None:
            self.best[h, ctx] = (order, n)
        elif order != old[0]:  # the same place comes again only with rows that repeat doc_id and text
            self.later.append((*max(order, old[0]), n))
            if order < old[0]:
                self.best[h, ctx] = (order, n)

    def __len__(self) -> int:
        return len(self.best) + len(self.later)

    def batch(self) -> pa.RecordBatch:
        rows = [(h, *order, n, ctx) for (h, ctx), (order, n) in self.best.items()]
        rows += [(hash(x[:3]) & 0xFFFFFFFFFFFFFFFF, *x, None) for x in self.later]
        self.best, self.later = {}, []
        h, none, ids, gs, first, n, ctx = zip(*rows, strict=True)
        cols = [pa.array(np.array(h, U).view(np.int64)), pa.array(ids, pa.int64(), mask=np.array(none, bool)), pa.array(gs, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int32()), pa.array(ctx, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["h", "doc_id", "g", "first", "n", "ctx"])


def _contexts(marks, hot):
    """Rows for marked anchors: all the bytes of their windows; ctx is null where an earlier anchor is known to have the
    same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender()
        for batch in batches:
            ids, gs = batch.column("doc_id").to_pylist(), batch.column("g").to_pylist()
            for d, t in enumerate(_texts(batch.column("text"))):
                h, lo, hi, place = anchors(t)
                if not len(h):
                    continue
                on = np.flatnonzero(marked(h, marks.value))
                split = marked(h[on], hot.value)
                for k, a, b, p, many in zip(h[on].tolist(), lo[on].tolist(), hi[on].tolist(), place[on].tolist(), split.tolist(), strict=True):
                    for key, x, y in _classes(t, k, a, b, p) if many else ((k, a, b),):
                        out.add(key, ids[d], gs[d], x, y - x + 1, t[x : y + LENGTH].tobytes())
                if len(out) >= SEND_ROWS:
                    yield out.batch()
        if len(out):
            yield out.batch()

    return run


def radix_groups(e: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Most-significant-digit passes over the windows of LENGTH bytes at ``starts``, within the given groups, by the
    8-byte loads ``e``: for each window whether an equal one of its group stands before it in the given order."""
    repeated = np.zeros(len(starts), bool)
    todo, part = np.arange(len(starts)), group
    digits = [*range(0, LENGTH - 8, 8), LENGTH - 8]
    for k in digits:
        if not len(todo):
            break
        digit = e[starts[todo] + k].byteswap()  # as a number it sorts like its bytes
        order = np.lexsort((digit, part))
        digit, part, todo = digit[order], part[order], todo[order]
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (digit[1:] != digit[:-1])))
        if k == digits[-1]:
            repeated[todo[~new]] = True
            break
        several = ~(new & np.concatenate((new[1:], [True])))
        todo, part = todo[several], np.cumsum(new)[several]
    return repeated


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ordered by (h, doc_id, g, first): runs of window starts that stand earlier as well."""
    carry, seen, before = None, np.zeros((0, LENGTH), np.uint8), None  # seen: the different windows of the group so far
    for batch in batches:
        for a in range(0, batch.num_rows, STREAM_ROWS):
            part = batch.slice(a, STREAM_ROWS)
            known = part.filter(pc.is_null(part.column("ctx")))
            if known.num_rows:
                first, n = known.column("first").to_numpy(), known.column("n").to_numpy()
                yield _spans(known, np.arange(len(n)), first, first + n - 1)
                part = part.filter(pc.is_valid(part.column("ctx")))
            if not part.num_rows:
                continue
            key = list(zip(*(part.column(c).to_pylist() for c in ("h", "doc_id", "g", "first")), strict=True))
            new_row = np.array([k != b for k, b in zip(key, [before, *key[:-1]], strict=True)])
            before = key[-1]
            if not new_row.all():  # rows of the table that repeat doc_id and text
                part = part.filter(pa.array(new_row))
            if not part.num_rows:
                continue
            h = part.column("h").to_numpy()
            first, n = part.column("first").to_numpy(), part.column("n").to_numpy().astype(np.int64)
            pieces = part.column("ctx").to_pylist()
            group = np.cumsum(np.concatenate(([False], h[1:] != h[:-1])))
            old = seen if carry == h[0] else seen[:0]
            # anchors with equal bytes: all windows of the later ones are repeated
            met: set[tuple[int, bytes]] = set()
            later = np.zeros(len(n), bool)
            for i, x in enumerate(zip(group.tolist(), pieces, strict=True)):
                later[i] = x in met
                met.add(x)
            alone = np.bincount(group[~later], minlength=int(group[-1]) + 1) == 1
            alone[0] &= not len(old)
            alone[-1] = False  # it may go on in the next chunk
            rows = np.flatnonzero(~later & ~alone[group])
            sizes = np.array([len(pieces[i]) for i in rows], np.int64)
            raw = np.frombuffer(old.tobytes() + b"".join(pieces[i] for i in rows), np.uint8)
            row = np.repeat(np.arange(len(rows)), n[rows])
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
            at = np.concatenate((np.arange(len(old)) * LENGTH, len(old) * LENGTH + (np.cumsum(sizes) - sizes)[row] + offset))
            of = np.concatenate((np.zeros(len(old), np.int64), group[rows[row]]))
            again = radix_groups(_loads(raw), at, of)
            last = np.flatnonzero(~again & (of == group[-1]))
            seen, carry = raw[at[last][:, None] + np.arange(LENGTH)] if len(last) else seen[:0], h[-1]
            whole = np.flatnonzero(later)
            if len(whole):
                yield _spans(part, whole, first[whole], first[whole] + n[whole] - 1)
            on = np.flatnonzero(again[len(old) :])
            if len(on):
                r, start = rows[row[on]], first[rows[row[on]]] + offset[on]
                lo = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (start[1:] != start[:-1] + 1))))
                hi = np.concatenate((lo[1:], [len(on)])) - 1
                yield _spans(part, r[lo], start[lo], start[hi])


def _spans(part: pa.RecordBatch, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    rows = pa.array(rows)
    return pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("g").take(rows), pa.array(first, pa.int64()), pa.array(last + LENGTH, pa.int64())], names=["doc_id", "g", "lo", "hi"])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces text, copy and spans by the result's columns; the others are carried."""
    for batch in batches:
        copy, found = batch.column("copy").to_pylist(), batch.column("spans").to_pylist()
        rows = []
        for i, t in enumerate(_texts(batch.column("text"))):
            raw = t.tobytes()
            if copy[i]:
                spans = [(0, len(raw))] if len(raw) >= LENGTH else []
            else:
                spans = _union([(s["lo"], s["hi"]) for s in found[i] or []])
            edges = [0, *(x for s in spans for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(raw), sum(b - a for a, b in spans), len(spans), kept, kept.decode("utf-8", "ignore")))
        if rows:
            names = [c for c in batch.schema.names if c not in ("text", "copy", "spans")]
            out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *out], names=[*names, "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])


def dedup(docs: DataFrame, map_bits: int = MAP_BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_bytes, n_removed, n_spans, kept (bytes), kept_text for each document."""
    kept_names = [f"__carry{i}" for i in range(len(carry))]
    base = docs.select(*(docs[c].alias(n) for c, n in zip(carry, kept_names, strict=True)), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    base = base.withColumn("g", F.xxhash64("text"))
    # first copy of each text, by digest and without the texts
    digests = base.select("doc_id", "g", F.sha1(F.encode("text", "UTF-8")).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = cut(firsts, "first-copies")  # read anew, so that a large group of copies can be split in the join
    later = digests.join(firsts, "digest").where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "g").distinct().withColumn("copy", F.lit(True))
    later = cut(later, "copies").select(F.col("doc_id").alias("c_id"), F.col("g").alias("c_g"), "copy")
    d = base.join(later, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("g") == F.col("c_g")), "left").select("doc_id", *kept_names, "text", "g", F.coalesce("copy", F.lit(False)).alias("copy"))
    first_copies = d.where(~F.col("copy")).select("doc_id", "text", "g")
    counts = _repeated_hashes(first_copies)
    sc = docs.sparkSession.sparkContext
    marks, hot = sc.broadcast(bit_map(counts, map_bits)), sc.broadcast(bit_map(counts.where(F.col("n") > HOT), HOT_BITS))
    drop_table(counts)
    rows = first_copies.mapInArrow(_contexts(marks, hot), "h long, doc_id long, g long, first long, n int, ctx binary")
    ordered = rows.repartition("h").sortWithinPartitions("h", F.col("doc_id").asc_nulls_last(), "g", "first")
    spans = ordered.mapInArrow(_repeats, "doc_id long, g long, lo long, hi long").groupBy("doc_id", "g").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = cut(spans, "spans").select(F.col("doc_id").alias("s_id"), F.col("g").alias("s_g"), "spans")
    d = d.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("g") == F.col("s_g")), "left")
    d = d.select("doc_id", *kept_names, "text", "copy", "spans")
    more = "n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"
    out = d.mapInArrow(_cut, T.StructType([*d.drop("text", "copy", "spans").schema.fields, *T._parse_datatype_string(more).fields]))
    return out.withColumnsRenamed(dict(zip(kept_names, carry, strict=True)))


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
