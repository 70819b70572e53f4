"""Repeated passages, located by Aho-Corasick automata and removed wherever they aren't first.

A window is 20 consecutive words. A word goes if a window covers it whose words also
start earlier: in a document of a smaller identifier, or earlier in the same row.

1. Phrases. Of the 8-word phrases in a window the one of the least hash stands for it, so
   equal windows have equal phrases, and only windows whose phrase occurs twice or more
   in the corpus are looked at any further: about a seventh of the phrases are counted,
   and few windows are left.
2. Confirming. Those windows are counted by hashes of 96 bits, with the least identifier
   that has them, their holder. Shards add up before anything is shuffled, so a window
   that a third of all documents share is one row a shard.
3. Automata. The holder's runs of such windows are passages; the runs of other rows that
   wait for a decision are regions. Both meet in cells by holder; a cell compiles an
   automaton of its passages, cut into phrases of 10 words end to end (a window has one of
   them whole), and streams its regions through it. Each place found is compared with the
   passage word by word, so hashes decide nothing. A holder's many regions are dealt into
   cells that each have its passages; a passage is as long as its document at most.
4. The covered words leave the texts.

Texts are shuffled once, into shards (``shards``); everything else moves hashes, passages
and regions.

Defined cases: null, empty and blank texts have no words and are returned; a text of
fewer than 20 words loses none; a null identifier comes after all others; rows of one
identifier are documents of their own, none earlier than another, so repeated rows get
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.common import discarded, join_on_key, read_table, stored
from evispark.llm.shards import freed, numbers, per_shard, sharded, texts, with_side

WINDOW, PHRASE, PIECE = 20, 8, 10  # words
SHARD_BYTES = 8 << 20
CELL_WORDS = 500_000  # of the passages of a cell
REGION_WORDS = 4_000_000  # of the regions streamed through one
LAST = (1 << 63) - 1  # stands for a null identifier


class Powers:
    """Powers of an odd number modulo 2^64 and their inverses, as many as were asked for so far."""

    def __init__(self, base: np.uint64):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.base, self.inverse, self.up, self.down = base, inverse, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = np.uint64(len(self.up))
            self.up = np.concatenate([self.up, self.up * _power(self.base, size)])
            self.down = np.concatenate([self.down, self.down * _power(self.inverse, size)])
        return self.up[:n], self.down[:n]


def _power(base: np.uint64, n: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), int(n), 1 << 64))


BYTES, FIRST, SECOND = (Powers(np.uint64(x)) for x in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
BLANKS = re.compile(rb"[\x20\x09-\x0d]")
CHUNK = 1 << 20  # bytes of a text hashed at once


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _ranges(terms: np.ndarray, starts, ends, inverse: np.ndarray) -> np.ndarray:
    """Sums of terms from starts to ends, moved to place 0."""
    so_far = np.zeros(len(terms) + 1, dtype=np.uint64)
    np.cumsum(terms, out=so_far[1:])
    return _mixed((so_far[ends] - so_far[starts]) * inverse)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text: a polynomial of its bytes, by sums over the text; the words are those of ``text.split()``."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        if end < len(text):
            blank = BLANKS.search(text, end)
            end = blank.start() if blank else len(text)
        data = np.frombuffer(text, np.uint8, end - at, at)
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = ~BLANK[data]
        turns = np.diff(inside)
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        up, down = BYTES.get(len(data))
        out.append(_ranges((data + np.uint64(1)) * up, starts, ends, down[starts]))
        at = end
    return np.concatenate(out)


def rolled(hashes: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers.get(len(hashes))
    return _ranges(hashes * up, slice(0, n), slice(size, None), down[:n])


def sliding(op: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = op(values[: len(values) - step], values[step:])
        have += step
    return values


WIDTH = WINDOW - PHRASE + 1  # phrases of a window


def window_phrases(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases, and for each window the least of its phrases."""
    phrases = rolled(hashes, PHRASE, FIRST)
    return phrases, sliding(np.minimum, phrases, WIDTH) if len(phrases) >= WIDTH else np.zeros(0, np.uint64)


def chosen_phrases(hashes: np.ndarray) -> np.ndarray:
    """The hash at each place whose phrase stands for some window."""
    phrases, least = window_phrases(hashes)
    if not len(least):
        return least
    around = np.zeros(WIDTH - 1, np.uint64)
    return phrases[sliding(np.maximum, np.concatenate([around, least, around]), WIDTH) == phrases]


def window_keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window, of 64 and 32 bits."""
    return rolled(hashes, WINDOW, FIRST).view(np.int64), (rolled(hashes, WINDOW, SECOND) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _shard_phrases(rows: pa.Table) -> pa.Table:
    found = [np.zeros(0, np.uint64)]
    found += [chosen_phrases(word_hashes(text)) for text in texts(rows)]
    key, n = np.unique(np.concatenate(found), return_counts=True)
    shard = rows.column("shard")[0].as_py()
    return pa.table({"phrase": key.view(np.int64), "shard": np.full(len(key), shard, np.int32), "n": n.astype(np.int32)})


def _shard_windows(rows: pa.Table, side: pa.Table) -> pa.Table:
    """Windows whose phrase recurs: their hashes, the least identifier that has them in the shard, and how often they occur."""
    recurring = np.sort(numbers(side, "phrase").view(np.uint64))
    parts = [np.zeros((3, 0), np.int64)]
    for text, own in zip(texts(rows), numbers(rows, "id").tolist()):
        hashes = word_hashes(text)
        due = _member(window_phrases(hashes)[1], recurring)
        if due.any():
            first, second = (k[due] for k in window_keys(hashes))
            parts.append(np.stack([first, second, np.full(len(first), own, np.int64)]))
    first, second, own = np.concatenate(parts, axis=1)
    order = np.lexsort((own, second, first))
    first, second, own = first[order], second[order], own[order]
    at = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])) if len(first) else np.zeros(0, np.int64)
    shard = rows.column("shard")[0].as_py() if rows.num_rows else 0
    n = np.diff(np.concatenate([at, [len(first)]]))
    return pa.table({"k1": first[at], "k2": second[at].astype(np.int32), "shard": np.full(len(at), shard, np.int32), "least": own[at], "n": n.astype(np.int32)})


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


class Holders:
    """Looks the holder of a window up by its two hashes."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, holder: np.ndarray):
        order = np.argsort(k1, kind="stable")
        self.k1, self.k2, self.holder = k1[order], k2[order], holder[order]
        same = np.flatnonzero(self.k1[1:] != self.k1[:-1]) if len(k1) else np.zeros(0, np.int64)
        self.most = int(np.diff(np.concatenate([[-1], same, [len(k1) - 1]])).max()) if len(k1) else 0

    def find(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each window has a holder, and which."""
        found, holder = np.zeros(len(k1), dtype=bool), np.zeros(len(k1), dtype=np.int64)
        at = np.searchsorted(self.k1, k1)
        for step in range(self.most):
            i = np.minimum(at + step, len(self.k1) - 1)
            hit = (self.k1[i] == k1) & (self.k2[i] == k2)
            found |= hit
            holder[hit] = self.holder[i[hit]]
        return found, holder


def _runs(kind: np.ndarray, holder: np.ndarray):
    """(first, last + 1) of the runs of equal kind and holder, kind 0 left out."""
    cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (holder[1:] != holder[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kind)]):
        if b > a and kind[a]:
            yield a, b


PASSAGE, REGION = 1, 2


def _shard_spans(rows: pa.Table, side: pa.Table) -> pa.Table:
    """Passages and regions of the rows of a shard, with their words."""
    holders = Holders(numbers(side, "k1"), numbers(side, "k2"), numbers(side, "holder"))
    out = []
    if holders.most:
        for text, own, row, shard in zip(texts(rows), numbers(rows, "id").tolist(), numbers(rows, "row").tolist(), numbers(rows, "shard").tolist()):
            k1, k2 = window_keys(word_hashes(text))
            found, holder = holders.find(k1, k2)
            if not found.any():
                continue
            words, first = text.split(), np.zeros(len(k1), dtype=bool)
            first[first_places(k1, k2)] = True
            kind = np.where(found, np.where((holder == own) & first, PASSAGE, REGION), 0)
            for a, b in _runs(kind, np.where(found, holder, 0)):
                out.append((int(holder[a]), int(kind[a]), shard, row, a, b - a + WINDOW - 1, b" ".join(words[a : b + WINDOW - 1])))
    columns = list(zip(*out)) if out else [()] * 7
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
    arrays[6] = arrays[6].cast(pa.string())
    return pa.table(dict(zip(("holder", "kind", "shard", "row", "start", "size", "words"), arrays)))


def first_places(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Where each distinct pair occurs first."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    return order[np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))]


class PhraseAutomaton:
    """Passages cut into phrases of ``PIECE`` words, compiled into one automaton over numbers of words."""

    def __init__(self, passages: list[tuple[int, bytes]]):
        self.number: dict[bytes, int] = {}
        self.words = [self._numbered(text.split()) for _, text in passages]
        places: dict[tuple, dict[int, list[tuple[int, int]]]] = {}  # by phrase and holder
        for p, (holder, _) in enumerate(passages):
            words = self.words[p].tolist()
            for offset in range(0, len(words) - PIECE + 1, PIECE):
                places.setdefault(tuple(words[offset : offset + PIECE]), {}).setdefault(holder, []).append((p, offset))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, found in places.items():
            self.automaton.add_word(phrase, found)
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def _numbered(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], dtype=np.int64)

    def covered(self, holder: int, text: bytes) -> np.ndarray:
        """Which words of a region lie in a window of one of the holder's passages."""
        words = text.split()
        region = np.fromiter((self.number.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        cover = np.zeros(len(words), dtype=bool)
        if self.empty:
            return cover
        seen = set()
        for end, found in self.automaton.iter(tuple(region.tolist())):
            for p, offset in found.get(holder, ()):
                shift = end - PIECE + 1 - offset
                if (p, shift) in seen:
                    continue
                seen.add((p, shift))
                a, b = max(0, shift), min(len(region), shift + len(self.words[p]))
                equal = np.concatenate([[False], region[a:b] == self.words[p][a - shift : b - shift], [False]])
                turns = np.flatnonzero(equal[1:] != equal[:-1]).reshape(-1, 2)
                for i, j in turns[turns[:, 1] - turns[:, 0] >= WINDOW]:
                    cover[a + i : a + j] = True
        return cover


def _match_cells(batches):
    """Streams (cell, kind, holder, shard, row, start, words), sorted by cell and kind: passages, then regions."""
    cell, passages, automaton = None, [], None
    for batch in batches:
        found = []
        columns = (batch.column(c).to_pylist() for c in ("cell", "kind", "holder", "shard", "row", "start", "words"))
        for of, kind, holder, shard, row, start, words in zip(*columns):
            if of != cell:
                cell, passages, automaton = of, [], None
            if kind == PASSAGE:
                passages.append((holder, words.encode("utf-8", "surrogatepass")))
                continue
            automaton = automaton or PhraseAutomaton(passages)
            cover = np.concatenate([[False], automaton.covered(holder, words.encode("utf-8", "surrogatepass")), [False]])
            for a, b in np.flatnonzero(cover[1:] != cover[:-1]).reshape(-1, 2).tolist():
                found.append((shard, row, start + a, start + b))
        if found:
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found), types)], names=["shard", "row", "a", "b"])


def locate(spans: DataFrame) -> DataFrame:
    """(shard, row, a, b): the words of each row that windows of passages of smaller or equal places cover."""
    words = spans.filter(F.col("kind") == PASSAGE).agg(F.sum("size")).first()[0] or 0
    groups = max(1, ceil(words / CELL_WORDS))
    dealt = spans.withColumn("group", F.pmod(F.xxhash64("holder"), F.lit(groups)).cast("int"))
    size = F.sum(F.when(F.col("kind") == REGION, F.col("size")).otherwise(0))
    sizes = dealt.groupBy("group").agg(F.count("*").alias("n"), F.ceil(F.greatest(size, F.lit(1)) / F.lit(REGION_WORDS)).cast("int").alias("cells"))
    own = F.array(F.pmod(F.xxhash64("row", "start"), F.col("cells")).cast("int"))
    every = F.sequence(F.lit(0), F.col("cells") - 1)
    cells = join_on_key(dealt, sizes, "group", spans.count()).withColumn("part", F.explode(F.when(F.col("kind") == PASSAGE, every).otherwise(own)))
    rows = cells.select(F.struct("group", "part").alias("of"), "kind", "holder", "shard", "row", "start", "words")
    rows = rows.withColumn("cell", F.concat_ws(":", "of.group", "of.part")).drop("of").repartition("cell").sortWithinPartitions("cell", "kind")
    return rows.mapInArrow(_match_cells, "shard int, row long, a long, b long")


def _shard_kept(with_text: bool):
    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        row, a, b = (numbers(side, c) for c in ("row", "a", "b"))
        order = np.argsort(row, kind="stable")
        row, a, b = row[order], a[order], b[order]
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for text, own in zip(texts(rows), numbers(rows, "row").tolist()):
            words = text.split()
            keep = np.ones(len(words), dtype=bool)
            for i in range(*np.searchsorted(row, [own, own + 1]).tolist()):
                keep[a[i] : b[i]] = False
            kept = b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k])
            n_words.append(len(words))
            n_removed.append(len(words) - int(keep.sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(kept)
        out = {"doc_id": rows.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept_texts, pa.binary()).cast(pa.string())} if with_text else {}))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The identifier as ``doc_id``, n_words, n_removed, the digest of the kept words and, if asked, the kept words as ``kept``."""
    spark = docs.sparkSession
    own = F.col(f"`{id_col}`").cast("long")
    rows = sharded(docs, [own.alias("doc_id"), F.coalesce(own, F.lit(LAST)).alias("id")], F.col(f"`{text_col}`"), shard_bytes)
    narrow = rows.select("shard", "id", "row", "text")
    phrases = per_shard(narrow.select("shard", "text"), _shard_phrases, "phrase long, shard int, n int")
    of = Window.partitionBy("phrase")  # a row a shard at most
    due = stored(phrases.withColumn("of", F.sum("n").over(of)).filter("of > 1").select("phrase", "shard"), "phrases")
    freed(spark)
    windows = with_side(narrow.select("shard", "id", "text"), due, _shard_windows, "k1 long, k2 int, shard int, least long, n int")
    of = Window.partitionBy("k1", "k2")  # a row a shard at most
    held = windows.withColumns({"holder": F.min("least").over(of), "of": F.sum("n").over(of)}).filter("of > 1")
    side = held.select("k1", "k2", "shard", "holder")
    spans = stored(with_side(narrow, side, _shard_spans, "holder long, kind int, shard int, row long, start long, size long, words string"), "spans")
    discarded(due)
    del phrases, due, windows, held, side
    freed(spark)
    located = stored(locate(spans), "located")
    discarded(spans)
    kept = ", kept string" if with_text else ""
    return with_side(rows.select("shard", "doc_id", "row", "text"), located, _shard_kept(with_text), f"doc_id long, n_words long, n_removed long, kept_sha256 string{kept}")


def op11_repeated_passages(spark, sf_dir) -> DataFrame:
    """Words of every document that repeat an earlier passage, removed."""
    return remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
