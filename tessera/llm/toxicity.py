"""Toxicity: noisy-channel deobfuscation, then a lexicon score of the restored text.

Channel: a written token is seen as letters passed through leetspeak, inserted separators, spacing and repetition. Each
token with symbols or digits at letters becomes a character lattice (what every written character may stand for, with a
price); Viterbi decoding under a character trigram language model keeps the likeliest restorations, and the document
counts of words decide between them and the token as written. Doubled letters have a path with one letter, taken where
the word so made is common enough. Runs of single characters ("i d i o t", "s t u p ! d") are cut into words by the
likeliest segmentation, each piece through the lattice. Other tokens have only the identity path and stay.

Score: words and word beginnings whose documents are toxic far beyond chance (a lower confidence bound) make the
lexicon; a document's score is the noisy-or of what it holds, or the rate among documents that hold none of it.

Learning reads every labelled row outside the held-out fold (whole texts, verified near copies of a text with the same
label once); labels meet their texts in a shuffled join, counting is a distributed aggregation, and nothing
counted is cut: the lexicon holds every feature beyond the bounds of evidence, the language model every trigram and every
word of two of these texts, in flat arrays (``Known``), which grow with the vocabulary. The labelled texts and the counts
of words are kept in the shared folder while they are read. Scoring reads each document once, without a shuffle; texts
are scored whole.

Edge cases: null or empty text gets the rate of documents without lexicon words; no labelled rows: every score is 0;
labels without a document and null labels are ignored; repeated label rows count once (toxic if any says so), and all
texts of a repeated doc_id have its label; a null doc_id has no fold (held_out is null) and is never learned from. Very
long tokens are decoded in time and memory proportional to their length. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bitmap import bit_map, marked
from tessera.llm._spark import cut, drop_table, fold
from tessera.llm._text import U, Words, buffers, chunks, shingle_sets
from tessera.llm.ngram_join import sets_of, shared

LEAST_DOCS = 8
LEAST_BOUND = 0.6
PREFIXES = (4, 5)
THRESHOLD = 0.3
NEAR, NEAR_BLOCK = 75, 1024

# Letters that a written character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "x",
}
NOISE = set("._-*~'`^,:;/\\|+=")
SUBSTITUTION, DROPPED, REPEATED, KEPT = -1.5, -1.0, -0.3, -6.0
DOUBLED, UNKNOWN = -2.5, -9.0  # one letter for two; a word that is not among the known ones
BEST, LONGEST, DOUBLES = 3, 20, 6  # paths kept a state; letters of a segment; doubled letters of which all choices are tried

WORD = re.compile(r"[^\W\d_]+")
ONE = r"(?:[^\W_]|[@$!|+(€£¡*#%])"
SPACED = re.compile(rf"(?<!\S)(?:{ONE}[ \t]+){{2,}}{ONE}(?![^\s.,;:!?)\"'])")
DOUBLE = re.compile(r"([^\W\d_])\1")
#: Signs of a disguise: symbols or digits between letters, before one or at the end, or a letter three times in a row.
SIGN = re.compile(r"[^\W\d_][0-9@$!|+(€£¡*#%._\-~'`^]+[^\W_]|[0-9@$!|+(€£¡*#%][^\W\d_]|[^\W\d_][@$€]+$|([^\W\d_])\1\1")
EDGE = " \t\r\n.,;:!?\"'()[]{}<>«»“”"
MEMO = 300_000
BITS = 25  # of the map of labelled ids, whatever their number
COUNTED = 500_000  # different keys that a task counts before it hands the counts on
HASHED = (1 << 61) - 1


def _letters(back: tuple | None) -> str:
    out = []
    while back is not None:
        back, x = back
        out.append(x)
    return "".join(reversed(out))


class Known(Mapping):
    """Words and their counts in flat arrays, sorted by CRC-32 and compared whole: 20 bytes a word and its letters."""

    def __init__(self, words: pa.Array, n: np.ndarray, crc: np.ndarray):
        order = np.argsort(crc, kind="stable")
        raw, off = buffers(words.take(pa.array(order)))
        self.crc, self.n = array("I", crc[order].astype(np.uint32).tobytes()), array("Q", n[order].astype(np.uint64).tobytes())
        self.raw, self.off = raw.tobytes(), array("Q", off.astype(np.uint64).tobytes())

    def get(self, word: str, default: int | None = None) -> int | None:
        b = word.encode()
        c = zlib.crc32(b)
        i = bisect_left(self.crc, c)
        while i < len(self.crc) and self.crc[i] == c:
            if self.raw[self.off[i] : self.off[i + 1]] == b:
                return self.n[i]
            i += 1
        return default

    def __getitem__(self, word: str) -> int:
        n = self.get(word)
        if n is None:
            raise KeyError(word)
        return n

    def __contains__(self, word: object) -> bool:
        return isinstance(word, str) and self.get(word) is not None

    def __iter__(self) -> Iterator[str]:
        return (self.raw[a:b].decode() for a, b in itertools.pairwise(self.off))

    def __len__(self) -> int:
        return len(self.n)

    def values(self) -> array:
        return self.n


@dataclass
class CharModel:
    """Trigram character model with additive smoothing; words are framed by spaces."""

    counts: dict[str, int]
    words: Mapping[str, int] = field(default_factory=dict)
    context: Counter = field(default_factory=Counter)
    letters: int = 1

    def __post_init__(self):
        for g, n in self.counts.items():
            self.context[g[:2]] += n
        self.letters = max(2, len({g[2] for g in self.counts}))
        self.total = sum(self.words.values())
        self.logs: dict[str, float] = {}

    def score(self, two: str, c: str) -> float:
        p = self.logs.get(two + c)
        if p is None:
            if len(self.logs) > MEMO:
                self.logs.clear()
            p = self.logs[two + c] = math.log((self.counts.get(two + c, 0) + 0.05) / (self.context.get(two, 0) + 0.05 * self.letters))
        return p

    def word_score(self, w: str) -> float:
        """Log probability of a word: by its count if it is known, by its letters otherwise."""
        n = self.words.get(w)
        if n:
            return math.log(n / self.total)
        f = f"  {w} "
        return (UNKNOWN if self.words else 0.0) + sum(self.score(f[i : i + 2], f[i + 2]) for i in range(len(w) + 1))

    def shorter(self, w: str) -> list[tuple[float, str]]:
        """The known words that come of a word when doubled letters are written once."""
        found = []
        at = [m.start() for m in DOUBLE.finditer(w)] if self.words else []
        choices = itertools.product((False, True), repeat=len(at)) if len(at) <= DOUBLES else [[True] * len(at)]
        for choice in choices if at else ():
            out = {i for i, c in zip(at, choice, strict=True) if c}
            short = "".join(c for i, c in enumerate(w) if i not in out)
            if out and short in self.words:
                found.append((self.word_score(short) + DOUBLED * len(out), short))
        return found

    def single(self, w: str) -> tuple[float, str]:
        """A word of letters, or the known word that comes of it when doubled letters are written once, if that is likelier."""
        return max([(self.word_score(w), w), *self.shorter(w)])

    def undoubled(self, w: str) -> str:
        """The word of ``single``; the word as written is weighed only where there is another."""
        other = self.shorter(w)
        return max([(self.word_score(w), w), *other])[1] if other else w

    def decode(self, token: str) -> str:
        """The likeliest word behind a token: Viterbi over the lattice, with the last two letters as state."""
        return self.decoded(token)[1]

    def decoded(self, token: str) -> tuple[float, str]:
        """Score and word; a state keeps its BEST paths, of which known words are weighed at the end. Paths are chains of
        back pointers, known by a hash of their letters, so a step costs the same however long the token is."""
        # state -> hash of the letters -> (score, price, (back pointer, letter))
        beams: dict[str, dict[int, tuple[float, float, tuple | None]]] = {"  ": {0: (0.0, 0.0, None)}}
        knows = bool(self.words)
        for i, c in enumerate(token):
            arcs: list[tuple[str, float]] = []
            if c.isalpha():
                arcs.append((c, 0.0))
                if len(token) > 2 and (token[i - 1 : i] == c and (token[i - 2 : i - 1] == c or token[i + 1 : i + 2] == c)):
                    arcs.append(("", REPEATED))
                elif knows and token[i - 1 : i] == c:
                    arcs.append(("", DOUBLED))
            else:
                arcs += [(x, SUBSTITUTION) for x in LEET.get(c, "")]
                if c in NOISE or not i and c in "#%":
                    arcs.append(("", DROPPED))
                if i and token[i - 1] == c:
                    arcs.append(("", REPEATED))
                if not arcs:
                    arcs.append((c, KEPT))
            step: dict[str, dict[int, tuple[float, float, tuple | None]]] = {}
            for two, paths in beams.items():
                for x, price in arcs:
                    more, key = (price + self.score(two, x), two[1] + x) if x else (price, two)
                    into = step.setdefault(key, {})
                    for h, (p, paid, back) in paths.items():
                        g = (h * 1_000_003 + ord(x) + 1) & HASHED if x else h
                        old = into.get(g)
                        if old is None or (p + more, paid + price) > old[:2]:
                            into[g] = (p + more, paid + price, (back, x) if x else back)
            beams = {two: paths if len(paths) <= BEST else dict(sorted(paths.items(), key=lambda a: a[1][:2], reverse=True)[:BEST]) for two, paths in step.items()}
        ends = [(two, p, paid, _letters(back)) for two, paths in beams.items() for p, paid, back in paths.values()]
        if self.words:
            return max((paid + self.word_score(word), word) for _, _, paid, word in ends)
        return max((p + self.score(two, " "), word) for two, p, _, word in ends)

    def restored(self, token: str) -> tuple[str, ...]:
        """The words of a token with signs of disguise, restored if that is likelier than the words as written."""
        score, word = self.decoded(token)
        plain = WORD.findall(token)
        if self.words and plain and all(w in self.words for w in plain):
            if sum(map(self.word_score, plain)) + DROPPED * (len(token) - sum(map(len, plain))) >= score:
                return tuple(plain)
        return tuple(WORD.findall(word))

    def segments(self, run: str) -> tuple[str, ...]:
        """The likeliest words of a run of spaced characters, each of at most LONGEST."""
        best: list[tuple[float, int, str]] = [(0.0, 0, "")]
        for j in range(1, len(run) + 1):
            here = []
            for i in range(max(0, j - LONGEST), j):
                piece = run[i:j]
                if piece.isalpha():
                    p, word = self.single(piece)
                elif any(c.isalpha() for c in piece):
                    p, word = self.decoded(piece)
                else:
                    p, word = KEPT * len(piece), ""
                here.append((best[i][0] + p, i, word))
            best.append(max(here))
        out, j = [], len(run)
        while j:
            _, i, word = best[j]
            out += WORD.findall(word)[::-1]
            j = i
        return tuple(out[::-1])


def token_words(token: str, chars: CharModel | None) -> tuple[str, ...]:
    """The words of one lower-cased token or run of spaced characters, restored where they are disguised."""
    if token.isalpha() and not DOUBLE.search(token):
        return (token,)
    if " " in token:
        run = token.replace(" ", "")
        return chars.segments(run) if chars is not None and any(c.isalpha() for c in run) else tuple(WORD.findall(run))
    t = token.strip(EDGE)
    if chars is not None:
        if SIGN.search(t):
            return chars.restored(t)
        if t.isalpha() and DOUBLE.search(t):
            return (chars.undoubled(t),)
    return (t,) if t.isalpha() else tuple(WORD.findall(t))


def tokens_of(text: str) -> set[str]:
    """Different lower-cased tokens of a text; runs of single characters are one, with spaces inside."""
    low = text.lower()
    tokens = set(low.split())
    if list(map(len, tokens)).count(1) > 1 and sum(len(t) == 1 and t.isalnum() for t in tokens) > 1:
        tokens.update(" ".join(m[0].split()) for m in SPACED.finditer(low))
    return tokens


def words_of(text: str, chars: CharModel | None, memo: dict[str, tuple[str, ...]]) -> set[str]:
    out: set[str] = set()
    if len(memo) > MEMO:
        memo.clear()
    for t in tokens_of(text):
        w = memo.get(t)
        if w is None:
            w = memo[t] = token_words(t, chars)
        out.update(w)
    return out


def features(words: set[str]) -> set[str]:
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in PREFIXES))


@dataclass
class Seen:
    """What of the lexicon a token holds, kept between texts: tokens that hold some of it, and those that hold nothing."""

    hits: dict[str, tuple[str, ...]] = field(default_factory=dict)
    clean: set[str] = field(default_factory=set)


@dataclass
class Model:
    lexicon: dict[str, float]
    base: float
    chars: CharModel | None

    def score(self, text: str, seen: Seen) -> float:
        hits: set[str] = set()
        if len(seen.hits) + len(seen.clean) > MEMO:
            seen.hits.clear()
            seen.clean.clear()
        for t in tokens_of(text) - seen.clean:
            h = seen.hits.get(t)
            if h is None:
                h = tuple(f for w in token_words(t, self.chars) for f in (w, *(w[:n] + "*" for n in PREFIXES if len(w) >= n)) if f in self.lexicon)
                if not h:
                    seen.clean.add(t)
                    continue
                seen.hits[t] = h
            hits.update(h)
        return 1.0 - math.prod(1.0 - self.lexicon[f] for f in sorted(hits)) if hits else self.base


COUNTS = pa.schema([("f", pa.string()), ("n", pa.int64()), ("t", pa.int64())])


def _handed(n: Counter, t: Counter) -> Iterator[pa.RecordBatch]:
    keys = list(n)
    for a in range(0, len(keys), 50_000):
        ks = keys[a : a + 50_000]
        yield pa.RecordBatch.from_pydict({"f": ks, "n": [n[k] for k in ks], "t": [t[k] for k in ks]}, COUNTS)
    n.clear()
    t.clear()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (word as written, documents, 0)."""
    n, t, memo = Counter(), Counter(), {}
    for batch in batches:
        for text in batch.column("text").to_pylist():
            n.update(words_of(text, None, memo))
            if len(n) > COUNTED:
                yield from _handed(n, t)
    yield from _handed(n, t)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (letter trigram of the words, times it stands in them, each word as often as documents have it, 0)."""
    n, t = Counter(), Counter()
    for batch in batches:
        for w, k in zip(batch.column("f").to_pylist(), batch.column("n").to_pylist(), strict=True):
            f = f"  {w} "
            for i in range(len(f) - 2):
                n[f[i : i + 3]] += k
        if len(n) > COUNTED:
            yield from _handed(n, t)
    yield from _handed(n, t)


def _feature_counts(chars: CharModel | None):
    """Per task: (feature, documents, toxic documents); the empty feature stands for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, t, memo = Counter(), Counter(), {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if len(memo) > MEMO:
                    memo.clear()
                own = {""}
                for token in tokens_of(text):
                    f = memo.get(token)
                    if f is None:
                        f = memo[token] = tuple(features(set(token_words(token, chars))))
                    own.update(f)
                n.update(own)
                if toxic:
                    t.update(own)
                if len(n) > COUNTED:
                    yield from _handed(n, t)
        yield from _handed(n, t)

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest shingle hash of each text, which near copies mostly share. Equal texts with the same label leave
    a task only while their doc_id falls, so that a large group of them is few rows and the smallest doc_id is among them."""
    least: dict[tuple[bytes, int], int] = {}
    for batch in batches:
        near = []
        for _, _, raw, off in chunks(batch.column("text")):
            near += [int(s[0].view(np.int64)) if len(s) else 0 for s in shingle_sets(Words(raw, off))]
        keep = []
        for i, text, toxic in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            key = hashlib.blake2b(text.encode(), digest_size=16).digest(), toxic
            keep.append(key not in least or i < least[key])
            if keep[-1]:
                least[key] = i
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], names=[*batch.schema.names, "near"])
        yield out.filter(pa.array(keep, pa.bool_()))


def _first_copies(texts: list[str], labels: list[int]) -> list[int]:
    """Places of the texts without those that have NEAR of their shingles in common with an earlier kept one of the same label."""
    sets, labels, kept = list(sets_of(pa.array(texts, pa.string()))), np.array(labels), []

    def close(rows: list[int]) -> np.ndarray:
        n = np.array([len(sets[i]) for i in rows])
        label = labels[rows]
        return (shared([sets[i] for i in rows]).astype(np.int64) * (100 + NEAR) >= NEAR * (n[:, None] + n)) & (label[:, None] == label)

    for a in range(0, len(sets), NEAR_BLOCK):
        block = list(range(a, min(len(sets), a + NEAR_BLOCK)))
        for b in range(0, len(kept), NEAR_BLOCK):
            old = kept[b : b + NEAR_BLOCK]
            copy = close(old + block)[: len(old), len(old) :].any(axis=0)
            block = [i for i, c in zip(block, copy, strict=True) if not c]
        if not block:
            continue
        among, gone = close(block), np.zeros(len(block), bool)
        for k, i in enumerate(block):
            if not gone[k]:
                kept.append(i)
                gone |= among[k]
    return kept


def _without_copies(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["near", "doc_id", "text", "toxic"]).drop_duplicates(["text", "toxic"]).reset_index(drop=True)
    keep = []
    for rows in pdf.groupby("near").indices.values():
        part = pdf.iloc[rows]
        keep += rows[_first_copies(part["text"].tolist(), part["toxic"].tolist())].tolist() if len(rows) > 1 else rows.tolist()
    return pdf.loc[keep, ["text", "toxic"]]


def distinct(d: DataFrame) -> DataFrame:
    """doc_id, text, toxic -> text, toxic: of verified near copies with the same label the one with the smallest doc_id.
    The smallest shingle hash only says which texts to compare."""
    keyed = d.mapInArrow(_keyed, "doc_id long, text string, toxic int, near long")
    groups = max(64, 2 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keyed.groupBy(F.pmod(F.xxhash64("near"), F.lit(groups))).applyInPandas(_without_copies, "text string, toxic int")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of every labelled row outside the held-out fold. A bit map of the labelled ids spares other
    texts the shuffle; the join decides, and is always by sorting, as the number of labels has no bound."""
    key = F.col("doc_id").cast("long").alias("doc_id")
    known = labels.where(F.col("toxic").isNotNull()).select(key, F.col("toxic").cast("int").alias("toxic")).where(fold("doc_id", 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = bit_map(known.select(F.xxhash64("doc_id").alias("h")), BITS)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = marked(batch.column("h").to_numpy().view(U), marks)
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep, pa.bool_()))

    d = docs.select(key, F.coalesce("text", F.lit("")).alias("text")).where(fold("doc_id", 4) != 2).withColumn("h", F.xxhash64("doc_id"))
    return d.mapInArrow(sieve, "doc_id long, text string").join(known.hint("merge"), "doc_id").select("doc_id", "text", "toxic")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a batch, as words have no line ends: words by lines, their counts and CRC-32."""
    for batch in batches:
        words = batch.column("f").to_pylist()
        if words:
            crc = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
            yield pa.RecordBatch.from_pydict({"f": ["\n".join(words)], "n": [batch.column("n").to_numpy().astype(np.int64).tobytes()], "crc": [crc.tobytes()]})


def known_words(words: DataFrame) -> Known:
    """Of f, n; partition by partition, so that no result of a job holds them all."""
    f, n, crc = [pa.array([], pa.large_string())], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in words.mapInArrow(_packed, "f string, n binary, crc binary").toLocalIterator():
        f.append(pa.array(r.f.split("\n"), pa.large_string()))
        n.append(np.frombuffer(r.n, np.int64))
        crc.append(np.frombuffer(r.crc, np.int64))
    return Known(pa.concat_arrays(f), np.concatenate(n), np.concatenate(crc))


def language_model(d: DataFrame) -> CharModel | None:
    """Trigrams of all words of the texts, and the words that two of them have."""
    shape = "f string, n long, t long"
    words = cut(d.mapInArrow(_word_counts, shape).groupBy("f").agg(F.sum("n").alias("n")), "words")
    try:
        tri = {r.f: r.n for r in words.mapInArrow(_trigrams, shape).groupBy("f").agg(F.sum("n").alias("n")).collect()}
        if not tri:
            return None
        return CharModel(tri, known_words(words.where("n > 1").select("f", "n")))
    finally:
        drop_table(words)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    d = cut(distinct(labelled(docs, labels)), "labelled")
    try:
        chars = language_model(d)
        agg = d.mapInArrow(_feature_counts(chars), "f string, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        share = F.col("t") / F.col("n")
        bound = (share + 1.92 / F.col("n") - 1.96 * F.sqrt((share * (1 - share) + 0.96 / F.col("n")) / F.col("n"))) / (1 + 3.84 / F.col("n"))  # Wilson's lower bound
        rows = agg.where((F.col("f") == "") | ((F.col("n") >= LEAST_DOCS) & (bound >= LEAST_BOUND))).collect()
        lexicon = {r.f: (r.t + 0.5) / (r.n + 1) for r in rows if r.f}
        total = next((r.n for r in rows if not r.f), 0)
        if not total:
            return Model({}, 0.0, chars)
        plain = Model(lexicon, -1.0, chars)

        def none_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, n, t = Seen(), 0, 0
            for batch in batches:
                for text, toxic_ in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    if plain.score(text, seen) < 0:
                        n, t = n + 1, t + bool(toxic_)
            yield pa.RecordBatch.from_pydict({"n": [n], "t": [t]}, pa.schema([("n", pa.int64()), ("t", pa.int64())]))

        rest = d.mapInArrow(none_of, "n long, t long").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
        return Model(lexicon, ((rest.t or 0) + 0.5) / ((rest.n or 0) + 1), chars)
    finally:
        drop_table(d)


def score(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            out = [float(model.score(x.as_py() or "", seen)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
