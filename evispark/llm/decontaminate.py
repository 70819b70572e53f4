"""Benchmark decontamination: CGK embeddings, bit sampling and exact edit verification.

Texts and items are sequences of lower-cased words. A document leaks an item when some
passage of it lies within k edits of words of the item, k being a share of the item's
words. The steps over each piece of documents:

1. Gate. By the q-gram lemma a passage within k edits of an item of m words holds the
   grams of q words of at least m - q + 1 - k*q places of the item, so documents with
   fewer can't leak it. The gate is exact; it only saves embeddings. It also gives the
   places where an item-sized window may start: where a shared gram puts the item's start.
   Distinct grams of a document meet items, whatever the number of their places, and only
   ``ROWS_AT_ONCE`` such rows at a time.
2. CGK. A walk over the window repeats or advances by a random function of step and word;
   edit distance becomes Hamming distance between the words that the walks show.
3. Bit sampling. Of each of R independent walks a few steps are sampled; a window that
   shows the same words there as some item of its size is a candidate for that item.
4. Verification. The exact edit distance to the best passage around the window decides.

R is chosen for each class of sizes (by powers of two) from a draw over all items of the
class: the least power of two, up to ``MOST_REPEATS``, at which simulated leaks with the
full number of edits reach the target recall. Where none does, every window of the gate
is verified. The items' tables are broadcast in blocks of at most about ``block_items``
items, one pass over the documents a block, so their size is bounded whatever the table's;
a Python worker builds a block's index once.

Defined cases: null and empty texts, and texts or items without a word, leak nothing;
items of fewer than 1 / share words must occur exactly; items of the same words are
looked for once, and found under each identifier; repeated documents give equal rows; empty tables give an
empty result; other columns are ignored or carried as asked.
"""

from __future__ import annotations

import random
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm.common import filter_text, hash_share, map_text, read_table

WORD = re.compile(r"[^\W_]+")
SAMPLED = 3  # steps sampled of each walk
LONGEST_GRAM = 3
MOST_REPEATS = 512
ROWS_AT_ONCE = 1 << 20
DRAWN = 50  # items of a class of sizes on which repeats are tried


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def size_class(size: int) -> int:
    return int(size).bit_length()


class LeakIndex:
    """Grams, walks' samples and words of one block of items.

    ``repeats`` has the number of walks by class of sizes, or one for all; with none,
    windows are not sampled and all of them are verified.
    """

    def __init__(self, items: list[tuple[int, str]], share: float, repeats: dict[int, int] | int, seed: int = 11):
        ids: dict[tuple[str, ...], list[int]] = {}
        for i, t in items:
            ids.setdefault(tuple(words_of(t)), []).append(i)
        ids.pop((), None)
        self.words, self.ids = list(ids), list(ids.values())
        self.vocabulary: dict[str, int] = {}
        self.codes = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], dtype=np.int64) for ws in self.words]
        self.sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.edits = np.floor(self.sizes * share + 1e-9).astype(np.int64)
        # Of edits + 1 equal parts of an item one survives, so grams that long always share one.
        self.q = np.minimum(LONGEST_GRAM, np.maximum(1, self.sizes // (self.edits + 1)))
        self.least = np.maximum(1, self.sizes - self.q + 1 - self.edits * self.q)
        self.base = len(self.vocabulary) + 1
        self.grams = {int(q): self._grams(int(q)) for q in np.unique(self.q)}
        self.repeats, self.seed = repeats, seed
        self.samples: dict[int, np.ndarray] = {}
        self.table: dict[tuple[int, int, int], list[int]] = {}
        groups: dict[int, list[int]] = {}
        for item, size in enumerate(self.sizes.tolist()):
            groups.setdefault(self._repeats(size), []).append(item)
        for repeats, mine in groups.items():
            if repeats:
                for item, row in zip(mine, self.signatures([self.codes[i] for i in mine]).tolist()):
                    for r, s in enumerate(row):
                        self.table.setdefault((int(self.sizes[item]), r, s), []).append(item)

    def _repeats(self, size: int) -> int:
        return self.repeats if isinstance(self.repeats, int) else self.repeats.get(size_class(size), 0)

    def _keys(self, codes: np.ndarray, q: int) -> np.ndarray:
        n = max(0, len(codes) - q + 1)
        key = np.zeros(n, dtype=np.int64)
        for j in range(q):
            key = key * self.base + codes[j : j + n]
        return key

    def _grams(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, and for each the range of its (item, offset) rows."""
        mine = np.flatnonzero(self.q == q)
        keys = [self._keys(self.codes[i], q) for i in mine]
        item = np.repeat(mine, [len(k) for k in keys])
        offset = np.concatenate([np.arange(len(k)) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        distinct, first = np.unique(keys[order], return_index=True)
        return distinct, np.append(first, len(keys)), item[order], offset[order]

    def _sampled(self, size: int) -> np.ndarray:
        """[repeat, SAMPLED]: the steps sampled of walks over windows of this size."""
        if size not in self.samples:
            rng = np.random.default_rng([self.seed, size])
            self.samples[size] = np.sort(rng.integers(0, 3 * size, (self._repeats(size), SAMPLED)), axis=1)
        return self.samples[size]

    def signatures(self, windows: list[np.ndarray]) -> np.ndarray:
        """[window, repeat]: hash of the words shown at the sampled steps, for windows with equally many repeats."""
        repeats = self._repeats(len(windows[0]))
        sizes = np.array([len(w) for w in windows], dtype=np.int64)
        padded = np.full((len(windows), int(sizes.max()) + 1), -1, dtype=np.int64)
        for i, w in enumerate(windows):
            padded[i, : len(w)] = w
        steps = np.stack([self._sampled(int(s)) for s in sizes])
        at = np.zeros((len(windows), repeats), dtype=np.int64)
        out = np.zeros(at.shape, dtype=np.uint64)
        salt = _mix(np.arange(1, repeats + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for t in range(int(steps.max()) + 1):
            shown = np.take_along_axis(padded, at, axis=1)
            for s in range(SAMPLED):
                hit = steps[:, :, s] == t
                out = np.where(hit, out * np.uint64(0x9E3779B97F4A7C15) + (shown + 2).astype(np.uint64), out)
            bit = _mix((shown + 2).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + salt + np.uint64(t * 0x9E3779B9)) >> np.uint64(63)
            at = np.minimum(at + bit.astype(np.int64), sizes[:, None])
        return out

    def gate(self, codes: np.ndarray, owner: np.ndarray):
        """Lists of (document, item, places where the item may start, places of shared grams), for pairs that share grams enough.

        All items of a document that have grams of one length come in one list. ``codes`` has a 0 between documents; ``owner`` is in order.
        """
        for q, (distinct, first, item, offset) in self.grams.items():
            n = max(0, len(codes) - q + 1)
            live = np.ones(n, dtype=bool)
            for j in range(q):
                live &= codes[j : j + n] > 0
            place = np.flatnonzero(live)
            key = np.zeros(len(place), dtype=np.int64)
            for j in range(q):
                key = key * self.base + codes[place + j]
            at = np.minimum(np.searchsorted(distinct, key), len(distinct) - 1)
            hit = distinct[at] == key
            place, at = place[hit], at[hit]
            if not len(place):
                continue
            # Distinct grams of each document, and the range of their places.
            order = np.lexsort((place, at, owner[place]))
            place, at, of = place[order], at[order], owner[place[order]]
            begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
            end = np.append(begin[1:], len(place))
            gram, doc = at[begin], of[begin]
            counts = first[gram + 1] - first[gram]
            total = np.cumsum(counts)
            turns = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc))  # where the next document's grams begin
            a = 0
            while a < len(doc):
                most = total[a] - counts[a] + ROWS_AT_ONCE
                fits = turns[(turns > a) & (total[turns - 1] <= most)]
                b = int(fits[-1] if len(fits) else turns[turns > a][0])
                size = counts[a:b]
                row = np.repeat(first[gram[a:b]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                shown = np.repeat(np.arange(a, b), size)
                kinds, back, shared = np.unique(doc[shown] * len(self.ids) + item[row], return_inverse=True, return_counts=True)
                order, ends, found = np.argsort(back, kind="stable"), np.cumsum(shared), []
                for k in np.flatnonzero(shared >= self.least[kinds % len(self.ids)]).tolist():
                    mine = order[ends[k] - shared[k] : ends[k]]
                    spots = [place[begin[g] : end[g]] for g in shown[mine].tolist()]
                    starts = np.concatenate([x - o for x, o in zip(spots, offset[row[mine]].tolist())])
                    found.append((int(kinds[k] // len(self.ids)), int(kinds[k] % len(self.ids)), np.unique(starts), np.unique(np.concatenate(spots))))
                yield found
                a = b

    def verify(self, item: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair of an item and the words around a window: the least edits to any passage, and where that begins and ends.

        One dynamic programme for all pairs: row i holds the distances of the item's first
        i words to passages that end at each word, ``begin`` where those start.
        """
        sizes = self.sizes[item]
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        own = np.full((len(item), int(sizes.max())), -2, dtype=np.int64)
        text = np.full((len(item), int(lengths.max())), -3, dtype=np.int64)
        for c, (i, t) in enumerate(zip(item.tolist(), texts)):
            own[c, : len(self.codes[i])] = self.codes[i]
            text[c, : len(t)] = t
        place = np.arange(text.shape[1] + 1)[None, :]
        row = np.zeros((len(item), text.shape[1] + 1), dtype=np.int64)
        begin = np.broadcast_to(place, row.shape).copy()
        for i in range(own.shape[1]):
            swap, drop = row[:, :-1] + (text != own[:, i : i + 1]), row[:, 1:] + 1
            best = np.concatenate([row[:, :1] + 1, np.minimum(swap, drop)], axis=1)
            origin = np.concatenate([begin[:, :1], np.where(swap <= drop, begin[:, :-1], begin[:, 1:])], axis=1)
            lead = np.minimum.accumulate(best - place, axis=1)  # words of the text left out
            source = np.maximum.accumulate(np.where(best - place == lead, place, 0), axis=1)
            live = (i < sizes)[:, None]
            row = np.where(live, lead + place, row)
            begin = np.where(live, np.take_along_axis(origin, source, axis=1), begin)
        row = np.where(place <= lengths[:, None], row, 1 << 40)
        end = row.argmin(axis=1)
        at = np.arange(len(item))
        return row[at, end], begin[at, end], end

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items it leaks: item, edits, size and the passage's place in code points."""
        out: list[list[dict]] = [[] for _ in texts]
        if not self.ids:
            return out
        lists = [words_of(t) for t in texts]
        get = self.vocabulary.get
        parts = [np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws)) for ws in lists]
        gap = np.zeros(1, dtype=np.int64)
        codes = np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap
        sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        waiting: dict[int, list[tuple[int, int, int]]] = {}  # (document, start, item) by number of repeats
        passed: set[tuple[int, int]] = set()
        for found in self.gate(codes, np.repeat(np.arange(len(parts)), sizes)):
            passed.update((doc, item) for doc, item, _, _ in found)
            for doc, item, starts, places in found:
                m, k = int(self.sizes[item]), int(self.edits[item])
                near = np.searchsorted(places, starts + m + 2 * k) - np.searchsorted(places, starts - k)
                due = waiting.setdefault(self._repeats(m), [])
                for start in np.unique(np.maximum(starts[near >= self.least[item]] - first[doc], 0)).tolist():
                    due.append((doc, start, item))
                    if len(due) == 256:
                        self._confirm(due, parts, best, passed)
                        due.clear()
        for due in waiting.values():
            self._confirm(due, parts, best, passed)
        spans: dict[int, list[tuple[int, int]]] = {}
        for (doc, item), (edits, begin, end) in sorted(best.items()):
            if doc not in spans:  # lower-casing may change lengths, so places are those of the lower-cased text
                spans[doc] = [m.span() for m in WORD.finditer(texts[doc].lower())]
            place = spans[doc]
            if end > begin:
                same = {"edits": edits, "item_words": int(self.sizes[item]), "start": place[begin][0], "end": place[end - 1][1]}
                out[doc] += [{"item_id": i} | same for i in self.ids[item]]
        return out

    def _confirm(self, due: list[tuple[int, int, int]], parts: list[np.ndarray], best: dict, passed: set) -> None:
        """Sample the walks of windows, where their size has any, and verify the candidates that passed the gate; ``best`` gets (edits, begin, end) by document and item."""
        open_ = lambda doc, item: (doc, item) in passed and best.get((doc, item), (1,))[0] > 0
        pairs = dict.fromkeys(x for x in due if open_(x[0], x[2]))
        if pairs and self._repeats(int(self.sizes[due[0][2]])):
            where = list(dict.fromkeys((doc, start, int(self.sizes[item])) for doc, start, item in pairs))
            windows = [parts[doc][start : start + m] for doc, start, m in where]
            windows = [np.concatenate([w, np.zeros(m - len(w), dtype=np.int64)]) for w, (_, _, m) in zip(windows, where)]
            pairs = {}
            for (doc, start, m), row in zip(where, self.signatures(windows).tolist()):
                for r, s in enumerate(row):
                    pairs.update(((doc, start, item), None) for item in self.table.get((m, r, s), ()) if open_(doc, item))
        some = list(pairs)
        for c in range(0, len(some), 256):
            part = some[c : c + 256]
            item = np.array([i for _, _, i in part], dtype=np.int64)
            low = [max(0, start - int(self.edits[i])) for _, start, i in part]
            around = [parts[doc][x : start + int(self.sizes[i] + 2 * self.edits[i])] for x, (doc, start, i) in zip(low, part)]
            for (doc, _, i), x, edits, begin, end in zip(part, low, *(v.tolist() for v in self.verify(item, around))):
                if edits <= self.edits[i]:
                    best[doc, i] = min(best.get((doc, i), (1 << 60,)), (edits, x + begin, x + end))


def simulated_recall(items: list[tuple[int, str]], share: float, repeats: dict[int, int] | int, tries: int = 200, seed: int = 5) -> float:
    """Share of simulated leaks found: copies of items with the full number of random word edits, among other words."""
    rng = random.Random(seed)
    index = LeakIndex(items, share, repeats)
    if not index.ids:
        return 1.0
    every = [w for ws in index.words for w in ws]
    texts, wanted = [], []
    for _ in range(tries):
        item = rng.randrange(len(index.ids))
        words = list(index.words[item])
        for _ in range(int(index.edits[item])):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 2)] = [] if kind == 1 and len(words) > 1 else [rng.choice(every)]
        filler = lambda: rng.choices(every, k=rng.randrange(30))
        texts.append(" ".join([*filler(), *words, *filler()]))
        wanted.append(index.ids[item][0])
    found = index.leaks(texts)
    return sum(any(x["item_id"] == w for x in row) for row, w in zip(found, wanted)) / tries


def choose_repeats(drawn: dict[int, list[tuple[int, str]]], share: float, target: float, most: int = MOST_REPEATS) -> dict[int, int]:
    """By class of sizes the least number of walks, a power of two, that reaches the target on the items drawn; 0 where ``most`` does not."""
    chosen = {}
    for of, items in sorted(drawn.items()):
        repeats = 8
        while repeats <= most and simulated_recall(items, share, repeats) < target:
            repeats *= 2
        chosen[of] = repeats if repeats <= most else 0
    return chosen


LEAKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("edits", T.IntegerType()),
            T.StructField("item_words", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str] | None = None,
    share: float = 0.2,
    target_recall: float = 0.99,
    block_items: int = 20_000,
    text_col: str = "text",
) -> DataFrame:
    """The kept columns and ``leaks``: an array of (item_id, edits, item_words, start, end), empty for clean documents."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() != "leaks"]
    out = docs
    for b, block in enumerate(_blocks(items, share, target_recall, block_items)):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        name = "leaks" if b == 0 else "__more"

        def make(shared=shared, name=name):
            index = _index(shared)
            return lambda texts: {name: index.leaks(texts)}

        carried = list(dict.fromkeys([*keep, text_col])) + ["leaks"] * bool(b)
        out = map_text(out, make, [T.StructField(name, LEAKS)], carried, text_col)
        if b:
            out = out.withColumn("leaks", F.concat("leaks", "__more")).drop("__more")
    return out.select(*keep, "leaks")


_BUILT: dict[str, LeakIndex] = {}


def _index(shared) -> LeakIndex:
    """The index of a block, which a Python worker keeps from task to task."""
    key, *rest = shared.value
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = LeakIndex(*rest)
    return _BUILT[key]


def _with_class(batches):
    for batch in batches:
        classes = [size_class(len(words_of(t))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(classes, pa.int32())], names=["item_id", "text", "size_class"])


def _blocks(items: DataFrame, share: float, target_recall: float, block_items: int):
    """Blocks of about ``block_items`` items, with what LeakIndex needs, one at a time."""
    clean = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    sized = clean.mapInArrow(_with_class, "item_id long, text string, size_class int")
    counts = {r[0]: r[1] for r in sized.groupBy("size_class").count().collect() if r[0]}  # a row a class, 32 at most
    blocks = max(1, -(-sum(counts.values()) // block_items))
    share_of = F.create_map(*[F.lit(x) for c, n in sorted(counts.items()) for x in (c, DRAWN / n)]) if counts else F.lit(None).cast("map<int,double>")
    drawn: dict[int, list[tuple[int, str]]] = {c: [] for c in counts}
    for r in sized.filter(hash_share("text", "drawn") < F.element_at(share_of, F.col("size_class"))).orderBy("item_id", "text").collect():  # about DRAWN a class
        drawn[r["size_class"]].append((r["item_id"], r["text"]))
    repeats = choose_repeats({c: own for c, own in drawn.items() if own}, share, target_recall)
    for b in range(blocks):
        mine = clean.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        yield uuid.uuid4().hex, [(r[0], r[1]) for r in mine.toLocalIterator()], share, repeats


def decontaminate(docs: DataFrame, items: DataFrame, share: float = 0.2, target_recall: float = 0.99, block_items: int = 20_000, text_col: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns."""
    out = docs
    for block in _blocks(items, share, target_recall, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            index = _index(shared)
            return lambda texts: [not found for found in index.leaks(texts)]

        out = filter_text(out, make, text_col)
    return out


def op5_decontaminate(spark, sf_dir) -> DataFrame:
    """Every (document, benchmark item) of which the document holds a passage within a fifth of the item's words of it."""
    found = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
