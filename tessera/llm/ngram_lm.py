"""Language-model scoring with an Elias-Fano n-gram trie.

Model: words and one end a text, p(w | v) = (c(v w) + MU * p1(w)) / (c(v) + MU) with p1(w) = (c(w) + 1) / (N + V + 1),
a Dirichlet-smoothed bigram model (it sums to 1 over the training words and one unknown word).

Trie: the first level has the contexts v, in order of their hashes, with pointers into the second level, the words that
follow each. A following word is known by its hash relative to its context (``CHILD_BITS`` bits, so that two followers
of one context that are taken for each other have a chance of 1 in 2**40). Hashes, keys and pointers are monotone and
held as Elias-Fano sequences: low bits packed, high bits unary with a select directory. The smoothed share
c(v w) / (c(v) + MU) is quantised to 16 bits on one fixed scale, the same for any data and any number of shards (error
under 2e-4 of log10). A lookup finds the context, takes its range by the pointers and searches the word's successor
within the range (the high part leads to a short run of low parts).

Distribution: the trie is cut into shards by context; very frequent contexts are cut by word, with their exact counts
sent to all shards. 1. Tasks turn each chunk of texts into its different n-grams, packed by shard, with their training
counts; texts themselves are not sent. 2. A shard's task adds up the training counts, builds its trie once, writes it to
the shared folder (it stays there as the model), drops the counts, maps the file into memory and looks up the n-grams
of one chunk after another in it. 3. Codes come back by chunk, where the texts' sums are made. What is moved is
proportional to the n-grams, however many shards there are.

Scale: shards follow spark.sql.shuffle.partitions; results don't depend on their number, nor on which contexts are
cut (``PROBE`` of the texts tell which may be frequent; their counts are then made over all texts).

Edge cases: null text is empty and has one token, the end; a null doc_id is never learned from and has no fold
(held_out is null); no training documents: all counts are 0 and both scores come from p1 alone; rows that repeat doc_id
and text get equal results; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import cut, fold, new_path
from tessera.llm._text import U, Words, mix
from tessera.llm._text import buffers as _buffers
from tessera.llm.warc import open_shared

FOLDS, HELD = 7, 2
MU = 64.0
CHUNK = 12 << 20
SHARDS = 2  # shards a shuffle partition
FREQUENT = 8  # a context with over 1 / (FREQUENT * shards) of all tokens is cut by word
PROBE = 16  # one of so many texts shows which words may be that frequent
CHILD_BITS = 40
LOWEST, LEVELS = -24.0, (1 << 16) - 2  # the scale of codes: log10 from LOWEST to 0; code 0: not there
MERGE = 1 << 21  # n-grams added up at once
MOST = 1 << (64 - CHILD_BITS - 1)  # n-grams of a shard
ASKED = 1 << 18  # n-grams looked up at once
_END, _BEGIN = U(0x1D8E4E27C47D124F), U(0x71C9BF9A4DD5B7A3)
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: place of the k-th set bit of a byte
SELECT = np.array([[([j for j in range(8) if b >> j & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


class Store:
    """Arrays one after another in one file: written once, then mapped into memory (or read, where the store has no files)."""

    def __init__(self, raw: np.ndarray | None = None):
        self.parts: list[bytes] = []
        self.raw, self.at = raw, 0

    def put(self, a: np.ndarray) -> np.ndarray:
        body = a.tobytes()
        self.parts += [np.array([a.dtype.num, len(a)], np.int64).tobytes(), body, b"\0" * (-len(body) % 8)]
        return a

    def take(self) -> np.ndarray:
        num, n = self.raw[self.at : self.at + 16].view(np.int64).tolist()
        kind = KINDS[num]
        size = n * kind.itemsize
        out = self.raw[self.at + 16 : self.at + 16 + size].view(kind)
        self.at += 16 + size + -size % 8
        return out

    def write(self, uri: str) -> None:
        with open_shared(uri, write=True) as f:
            for part in self.parts:
                f.write(part)

    @classmethod
    def mapped(cls, uri: str) -> Store:
        if uri.startswith(("file:", "/")):
            return cls(np.asarray(np.memmap("/" + uri.removeprefix("file:").lstrip("/"), np.uint8, "r")))
        with open_shared(uri) as f:
            return cls(np.frombuffer(f.read(), np.uint8))


KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.int64, U)}


class EliasFano:
    """A monotone sequence of integers up to ``universe``."""

    def __init__(self, store: Store, values: np.ndarray | None = None, universe: int = 0):
        if values is None:  # as it was put into the store
            head, self.bytes, self.ones, self.lows = (store.take() for _ in range(4))
            self.n, self.low_bits = head.tolist()
            return
        n = len(values)
        self.n, self.low_bits = n, max(0, int(universe // max(1, n)).bit_length() - 1)
        v = values.astype(U)
        high = (v >> U(self.low_bits)).astype(np.int64)
        buckets = (int(universe) >> self.low_bits) + 1
        store.put(np.array([self.n, self.low_bits], np.int64))
        bits = np.zeros(n + buckets + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8)))
        self.bytes = store.put(packed)
        ones = ONES[packed].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        self.ones = store.put(np.concatenate(([0], np.cumsum(ones))).astype(np.int64))  # before each 64-bit word
        if self.low_bits:
            low = v & ((U(1) << U(self.low_bits)) - U(1))
            shifts = np.arange(self.low_bits, dtype=U)
            parts = [np.packbits((low[a : a + 65536, None] >> shifts & U(1)).astype(np.uint8).ravel(), bitorder="little") for a in range(0, n, 65536)]
            raw = np.concatenate([*parts, np.zeros(16, np.uint8)])
        else:
            raw = np.zeros(16, np.uint8)
        self.lows = store.put(raw)

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th (from 0) 1 or 0 of the high bits."""
        before = self.ones if bit else np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(before, k, side="right") - 1
        left = k - before[word]
        at, done = word * 8, np.zeros(len(k), bool)
        place = np.zeros(len(k), np.int64)
        for j in range(8):
            b = self.bytes[at + j]
            if not bit:
                b = ~b
            n = ONES[b].astype(np.int64)
            here = ~done & (left < n)
            place[here] = (at[here] + j) * 8 + SELECT[b[here], left[here]]
            done |= here
            left = np.where(done, left, left - n)
        return place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        bit = i * self.low_bits
        at, shift = bit >> 3, (bit & 7).astype(U)
        eight = np.ndarray(shape=(len(self.lows) - 7,), dtype="<u8", buffer=self.lows, strides=(1,))
        out = eight[at] >> shift
        if self.low_bits > 56:
            out |= np.where(shift > 0, self.lows[at + 8].astype(U) << (U(64) - np.maximum(shift, U(1))), U(0))
        return out & ((U(1) << U(self.low_bits)) - U(1))

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, 1) - i).astype(U)
        return high << U(self.low_bits) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index in [first, end) of the smallest value >= x there (end if none), and whether it equals x."""
        high = (x >> U(self.low_bits)).astype(np.int64)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) + 1 - high, 0)
        hi = np.minimum(self._select(high, 0) - high, end)
        at = np.maximum(lo, first)
        want = x & ((U(1) << U(self.low_bits)) - U(1))
        equal = np.zeros(len(x), bool)
        todo = np.flatnonzero(at < hi)
        while len(todo):
            low = self._low(at[todo])
            hit = low >= want[todo]
            equal[todo[hit]] = low[hit] == want[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < hi[todo]]
        return at, equal


def quantised(log10: np.ndarray) -> np.ndarray:
    return (1 + np.clip(np.round((log10 - LOWEST) / -LOWEST * (LEVELS - 1)), 0, LEVELS - 1)).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    """The shares behind codes; 0 where there is none."""
    return np.where(codes > 0, 10.0 ** ((codes.astype(np.float64) - 1) / (LEVELS - 1) * -LOWEST + LOWEST), 0.0)


class Trie:
    """A shard: contexts (hashes, with their counts) -> following words (relative hashes) -> quantised shares.

    The keys of a context's followers fill the range that its pointers give: from the first one's place on, relative hash
    times number of followers. So keys are as even as hashes are, whether a context has one follower or a million."""

    def __init__(self, store: Store):
        self.contexts, self.counts, self.pointer, self.keys, self.codes = EliasFano(store), store.take(), EliasFano(store), EliasFano(store), store.take()

    @staticmethod
    def build(contexts: np.ndarray, counts: np.ndarray, number: np.ndarray, children: np.ndarray, shares: np.ndarray) -> Store:
        """contexts: sorted hashes; number: sorted, each n-gram's context; children: relative hashes, sorted within it."""
        store = Store()
        EliasFano(store, contexts, (1 << 64) - 1)
        store.put(counts)
        pointer = np.searchsorted(number, np.arange(len(contexts) + 1))
        EliasFano(store, pointer, len(number))
        EliasFano(store, _keys(pointer[number], pointer[number + 1], children), max(1, len(number) << CHILD_BITS))
        store.put(quantised(np.log10(shares)))
        return store

    def find(self, contexts: np.ndarray) -> np.ndarray:
        """Number of each context, -1 for unknown ones."""
        at, found = self.contexts.successor(contexts, np.zeros(len(contexts), np.int64), np.full(len(contexts), self.contexts.n))
        return np.where(found, at, -1)

    def lookup(self, number: np.ndarray, size: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Codes of words by relative hash, ``size`` of them after each context of the given number; 0 if not in the trie."""
        out, known = np.zeros(len(child), np.uint16), number >= 0
        here = np.flatnonzero(np.repeat(known, size))
        n, size = number[known], size[known]
        first, end = (np.repeat(self.pointer.access(i).astype(np.int64), size) for i in (n, n + 1))
        at, found = self.keys.successor(_keys(first, end, child[here]), first, end)
        out[here[found]] = self.codes[at[found]]
        return out


def _keys(first: np.ndarray, end: np.ndarray, child: np.ndarray) -> np.ndarray:
    return (first.astype(U) << U(CHILD_BITS)) + child * (end - first).astype(U)


def _grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, text number) of all tokens, ends included."""
    w = Words(raw, off)
    n = len(off) - 1
    at = w.first[1:] + np.arange(n)  # where each text's end goes
    word = np.insert(w.hash, w.first[1:], _END)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.concatenate(([0], at[:-1] + 1))] = _BEGIN
    return word, context, np.repeat(np.arange(n), np.diff(w.first) + 1)


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str], most: int) -> Iterator[pa.Table]:
    """Rows in runs of about ``most`` bytes of text, whatever the size of the batches."""
    held, size = [], 0
    for batch in batches:
        lengths = np.cumsum(np.diff(_buffers(batch.column("text"))[1]))
        a = 0
        while a < batch.num_rows:
            done = int(lengths[a - 1]) if a else 0
            b = min(batch.num_rows, max(a + 1, int(np.searchsorted(lengths, done + most - size, side="right"))))
            held.append(batch.slice(a, b - a).select(columns))
            size, a = size + int(lengths[b - 1]) - done, b
            if size >= most or a < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _probe(share: float, most: int):
    """Words with over half of ``share`` in a task's chunk, with their counts there; the null word has all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, ["text"], most):
            word = _grams(*_buffers(t.column("text")))[0]
            h, n = np.unique(word, return_counts=True)
            on = n > len(word) * share / 2
            yield pa.RecordBatch.from_arrays([pa.array([None, *h[on].view(np.int64).tolist()], pa.int64()), pa.array([len(word), *n[on].tolist()], pa.int64())], names=["h", "n"])

    return run


def _count(words: np.ndarray, most: int):
    """Exact counts of the given sorted hashes; the null word has all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(words), np.int64), 0
        for t in _chunks(batches, ["text"], most):
            word = _grams(*_buffers(t.column("text")))[0]
            at = np.minimum(np.searchsorted(words, word), len(words) - 1)
            total += np.bincount(at[words[at] == word], minlength=len(words))
            n += len(word)
        yield pa.RecordBatch.from_arrays([pa.array([None, *words.view(np.int64).tolist()], pa.int64()), pa.array([n, *total.tolist()], pa.int64())], names=["h", "n"])

    return run


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.num, len(a)))], np.int64).tobytes()
    body = b"".join(a.tobytes() for a in arrays)
    return len(head + body).to_bytes(8, "little") + pa.Codec("zstd").compress(head + body, asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for num, size in head.reshape(-1, 2):
        kind = KINDS[int(num)]
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += int(size) * kind.itemsize
    return out


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


class Grams:
    """The different n-grams of a chunk, by shard, context and word: contexts and words are numbers of ``values``."""

    def __init__(self, values: np.ndarray, number: np.ndarray, first: np.ndarray, hot: np.ndarray, shards: int):
        """values: sorted hashes of the words and _BEGIN; number: each token's; first: which tokens begin a text."""
        self.values, n = values, len(values)
        before = np.empty(len(number), np.int64)
        before[1:] = number[:-1]
        before[first] = np.searchsorted(values, _BEGIN)
        code, which = np.unique(before * n + number, return_inverse=True)
        context, word = code // n, code % n
        key = values[context]
        often = np.isin(values, hot)[context]
        key[often] = mix(key[often] ^ mix(values[word[often]]))
        shard = (mix(key) % U(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
        order = np.argsort(shard, kind="stable")
        self.context, self.word, self.shard = context[order], word[order], shard[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.token = place[which]  # of each token its n-gram

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a shard's run of one context begins, how long it is, and the shard."""
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(self.shard)), bool), (self.shard[1:] != self.shard[:-1]) | (self.context[1:] != self.context[:-1]))))
        return begin, np.diff(np.append(begin, len(self.shard))), self.shard[begin]

    def children(self) -> np.ndarray:
        return mix(self.values[self.word] ^ mix(self.values[self.context])) >> U(64 - CHILD_BITS)


def _read(t: pa.Table) -> tuple:
    """(chunk, doc_id, words, number of each token, first tokens, text of each token) of a chunk of texts. The chunk is
    named by what is in it, so that a task that runs again gives the same name."""
    raw, off = _buffers(t.column("text"))
    word, _, text = _grams(raw, off)
    values, number = np.unique(np.concatenate((word, [_BEGIN])), return_inverse=True)
    first = np.concatenate(([True], text[1:] != text[:-1]))
    ids = t.column("doc_id").to_numpy(zero_copy_only=False) if not t.column("doc_id").null_count else np.array([hash(x) for x in t.column("doc_id").to_pylist()])
    odd = lambda x: (x * (2 * np.arange(len(x), dtype=U) + U(1))).sum(keepdims=True, dtype=U)
    name = mix(odd(word)) + odd(mix(ids.astype(np.int64).view(U)))
    return int(name[0].view(np.int64)), values, number[:-1], first, text


def _sharded(shards: int, hot: np.ndarray, most: int):
    """Rows (shard, chunk, blob): contexts, the length of each one's run, relative hashes of words, training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, ["doc_id", "train", "text"], most):
            chunk, values, number, first, text = _read(t)
            g = Grams(values, number, first, hot, shards)
            train = t.column("train").to_numpy()
            count = np.bincount(g.token[train[text]], minlength=len(g.word))
            begin, size, shard = g.runs()
            child = g.children()
            edge = np.searchsorted(g.shard, np.arange(shards + 1))
            run_edge = np.searchsorted(shard, np.arange(shards + 1))
            rows = {"shard": [], "chunk": [], "blob": []}
            for k in np.unique(shard).tolist():
                a, b, own = edge[k], edge[k + 1], slice(run_edge[k], run_edge[k + 1])
                rows["shard"].append(k)
                rows["chunk"].append(chunk)
                low, high = (child[a:b] & U(0xFFFFFFFF)).astype(np.uint32), (child[a:b] >> U(32)).astype(np.uint8)
                rows["blob"].append(_pack(values[g.context[begin[own]]], _small(size[own]), low, high, _small(count[a:b])))
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())]))

    return run


def _sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    return codes[begin], np.add.reduceat(counts[order], begin) if len(begin) else counts[:0]


def build_shard(blobs: list[bytes], often: dict[int, int]) -> tuple[Store, int]:
    """The trie of the training counts in a shard's blobs, and how many contexts it has that are its own."""
    contexts = [np.zeros(0, U)]
    for b in blobs:
        v, size, _, _, count = _unpack(b)
        if len(count):
            contexts.append(v[np.add.reduceat(count.astype(np.int64), np.cumsum(size, dtype=np.int64) - size) > 0])
    values = np.unique(np.concatenate(contexts))
    keys, counts, held = np.zeros(0, U), np.zeros(0, np.int64), 0
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for b in [*blobs, None]:
        if b is not None:
            v, size, low, high, count = _unpack(b)
            on = count > 0
            number = np.repeat(np.searchsorted(values, v), size)[on].astype(U)
            waiting.append((number << U(CHILD_BITS) | high[on].astype(U) << U(32) | low[on].astype(U), count[on].astype(np.int64)))
            held += len(number)
        if held >= MERGE or b is None:
            keys, counts = _sums(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)]))
            waiting, held = [], 0
    if len(keys) >= MOST:
        raise ValueError("a shard has too many n-grams: raise spark.sql.shuffle.partitions")
    own = (keys >> U(CHILD_BITS)).astype(np.int64)
    total = np.bincount(own, weights=counts, minlength=len(values)).astype(np.int64) if len(values) else np.zeros(0, np.int64)
    cut_ = np.array([int(x) in often for x in values.tolist()], bool)
    total[cut_] = [often[int(x)] for x in values[cut_].tolist()]
    return Trie.build(values, total, own, keys & U((1 << CHILD_BITS) - 1), counts / (total[own] + MU)), int((~cut_).sum())


def _answers(folder: str, often: dict[int, int]):
    """Of a shard's rows: the codes of each chunk's n-grams and the counts of its contexts; one row more for the shard itself."""

    def run(table: pa.Table) -> pa.Table:
        shard, blobs = table.column("shard")[0].as_py(), table.column("blob").to_pylist()
        store, words = build_shard(blobs, often)
        uri = f"{folder}/{shard}-{uuid.uuid4().hex}.trie"
        store.write(uri)
        del store
        trie, out, waiting, asked = Trie(Store.mapped(uri)), [], [], 0
        for i, b in enumerate(blobs):
            waiting.append(_unpack(b)[:4])
            asked += len(waiting[-1][2])
            if asked >= ASKED or i + 1 == len(blobs):
                v, size, low, high = (np.concatenate([x[k] for x in waiting]) for k in range(4))
                number = trie.find(v)
                codes = trie.lookup(number, size, high.astype(U) << U(32) | low.astype(U))
                counts = np.where(number >= 0, trie.counts[np.maximum(number, 0)], 0) if len(trie.counts) else np.zeros(len(v), np.int64)
                a = c = 0
                for x in waiting:
                    out.append(_pack(codes[a : a + len(x[2])], _small(counts[c : c + len(x[0])])))
                    a, c = a + len(x[2]), c + len(x[0])
                waiting, asked = [], 0
        n = len(out)
        return pa.table([pa.array([shard] * (n + 1), pa.int32()), pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), pa.array([*out, None], pa.binary()), pa.array([None] * n + [words], pa.int64()), pa.array([None] * n + [uri], pa.string())], names=["shard", "chunk", "blob", "words", "uri"])

    return run


def _texts(most: int):
    """Rows (shard null, chunk, blob): the chunk again, as numbers of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, ["doc_id", "text"], most):
            chunk, values, number, first, text = _read(t)
            ids = t.column("doc_id").to_pylist()
            # numbers by frequency: small ones, which pack well
            order = np.argsort(-np.bincount(number, minlength=len(values)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            blob = _pack(values[order], *(((place[number] >> s) & 255).astype(np.uint8) for s in (0, 8, 16, 24)), np.flatnonzero(first), np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint8))
            yield pa.RecordBatch.from_pydict({"shard": [None], "chunk": [chunk], "blob": [blob]}, pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())]))

    return run


def _scores(shards: int, hot: np.ndarray, counts: np.ndarray, z: float):
    """Of a chunk's texts and the codes of its n-grams: doc_id, tokens, known ones, base and model scores."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("shard").to_pylist(), table.column("blob").to_pylist(), strict=True))
        mine = [b for k, b in rows if k is None]
        got = dict((k, b) for k, b in rows if k is not None)
        by_rank, b0, b1, b2, b3, begin, ids, null = _unpack(mine[0])
        values = np.sort(by_rank)
        place = b0.astype(np.int64) | b1.astype(np.int64) << 8 | b2.astype(np.int64) << 16 | b3.astype(np.int64) << 24
        number = np.searchsorted(values, by_rank)[place]
        first = np.zeros(len(number), bool)
        first[begin] = True
        g = Grams(values, number, first, hot, shards)
        start, _, shard = g.runs()
        answers = [_unpack(got[k]) for k in np.unique(shard).tolist()]  # a missing one is an error, never a 0
        codes, seen = np.concatenate([a[0] for a in answers]), np.concatenate([a[1].astype(np.int64) for a in answers])
        total = np.zeros(len(values), np.int64)
        total[g.context[start]] = seen
        at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
        often = hot[at] == values
        total[often] = counts[at[often]]
        p1 = (total + 1) / z
        model = np.log10(restored(codes) + MU / (total[g.context] + MU) * p1[g.word])
        text, n = np.cumsum(first) - 1, len(ids)
        add = lambda x: np.bincount(text, weights=x, minlength=n)
        out = [add(np.ones(len(number))), add(total[number] > 0), add(np.log10(p1)[number]), add(model[g.token])]
        # copies of the chunk (equal texts under equal ids) have the same name and the same results
        ids = pa.array(ids, mask=null.astype(bool))
        one = pa.table([ids, pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(out[2]), pa.array(out[3])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
        return pa.concat_tables([one] * len(mine))

    return run


def score(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document. ``chunk``: bytes of
    text that a task handles at once."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    train = F.coalesce(fold("doc_id", FOLDS) != HELD, F.lit(False))
    learned = base.where(train).select("doc_id", "text")
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = 1 / (FREQUENT * shards)
    # contexts that may be frequent: fewer than 2 / share of them
    probe = learned.where(F.pmod(F.xxhash64("doc_id", F.lit("probe")), F.lit(PROBE)) == 0).select("text").mapInArrow(_probe(share, chunk), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = {r.h: r.n for r in probe.collect()}  # what a task sends is over half of the share there, so this is bounded
    tokens = found.pop(None, 0)
    words = sorted({int(_END), *(h % (1 << 64) for h, k in found.items() if k > tokens * share / 2)})
    exact = learned.select("text").mapInArrow(_count(np.array(words, U), chunk), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    n = next((r.n for r in exact if r.h is None), 0)
    known = {r.h % (1 << 64): r.n for r in exact if r.h is not None}
    known.setdefault(int(_END), 0)
    known[int(_BEGIN)] = known[int(_END)]  # every text has one of each
    hot, counts = np.array(sorted(known), U), np.array([known[h] for h in sorted(known)], np.int64)

    folder = new_path(spark, "trie")
    blobs = base.withColumn("train", train).mapInArrow(_sharded(shards, hot, chunk), "shard int, chunk long, blob binary")
    answers = cut(blobs.groupBy("shard").applyInArrow(_answers(folder, known), "shard int, chunk long, blob binary, words long, uri string"), "answers")
    v = (answers.agg(F.sum("words")).first()[0] or 0) + sum(c > 0 for h, c in known.items() if h != int(_BEGIN))
    z = float(n + v + 1)
    rows = base.mapInArrow(_texts(chunk), "shard int, chunk long, blob binary").unionByName(answers.where("chunk is not null").select("shard", "chunk", "blob"))
    out = rows.groupBy("chunk").applyInArrow(_scores(shards, hot, counts, z), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
