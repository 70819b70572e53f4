"""Byte-level BPE: encoding by speculation and verification, and decoding.

Each distinct pre-token is cut greedily into the longest tokens. A cut is the encoding
exactly when every two adjacent tokens are compatible, that is, when no merge would
have joined pieces across their boundary before the pieces were used up on their own
side. The test is vectorised over all new pairs: for the pieces on the right edge of
the left token and on the left edge of the right token, the merge of the two pieces
must not come before either is merged within its own token. Only words with an
incompatible pair are merged step by step.

Defined cases: null and empty texts have no ids and decode to an empty text; a special
token's string in a text is that token; bytes that aren't UTF-8 decode to replacement
characters; repeated rows are encoded alike; an empty table gives an empty result;
other columns are ignored or carried as asked.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evispark.llm.common import map_text, read_table
from evispark.llm.pretokens import Vocabulary, WordEncoder

VOCABULARY = "byte_bpe_50k.json"
NEVER = np.iinfo(np.int32).max


class SpeculativeBpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, path: str):
        vocab = Vocabulary(path)
        self.tokens, self.special = vocab.tokens, vocab.special
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(vocab.merges)}
        self.product = [c for _, _, c in vocab.merges]
        self.byte_id = {t[0]: i for i, t in enumerate(self.tokens) if len(t) == 1}
        if len(self.byte_id) < 256:
            raise ValueError(f"{path} lacks {256 - len(self.byte_id)} of the 256 single bytes")
        self._edges(vocab)
        self.longest = max(map(len, self.by_bytes), default=0)
        keys = np.array([a << 32 | b for a, b, _ in vocab.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], order.astype(np.int32)
        self.pair_ok: dict[int, bool] = {}

    def _edges(self, vocab: Vocabulary) -> None:
        """For each token its pieces on the left and right edge, from the whole token inwards, with the rank at which each is merged away."""
        split: dict[int, tuple[int, int, int]] = {}
        for r, (a, b, c) in enumerate(vocab.merges):
            split.setdefault(c, (a, b, r))
        own = {i: [i] for i in self.byte_id.values()}
        for c in split:  # a token whose own bytes encode otherwise is never proposed
            ids = self.merge(self.tokens[c])
            if ids == [c]:
                own[c] = ids
        self.by_bytes = {self.tokens[i]: i for i in own}
        spines = []
        for side in (0, 1):
            chains = []
            for i in range(len(self.tokens)):
                piece, until, chain = i, NEVER, []
                while True:
                    chain.append((piece, until))
                    if piece not in split:
                        break
                    until = split[piece][2]
                    piece = split[piece][side]
                chains.append(chain)
            depth = max(map(len, chains), default=1)
            table = np.full((len(chains), depth, 2), -1, dtype=np.int32)
            for i, chain in enumerate(chains):
                table[i, : len(chain)] = chain
            spines.append(table)
        self.left, self.right = spines

    def merge(self, word: bytes) -> list[int]:
        """The encoding by merging the pair of least rank, leftmost first, until none is left."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 256:
            return self._merge_long(ids)
        get = self.rank.get
        ranks = [get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [self.product[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, in time near linear in the word."""
        n, get = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get((a, b))) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = self.product[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (new := get((ids[left], ids[right]))) is not None:
                    heappush(heap, (new, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy cut into the longest tokens."""
        ids, at, get = [], 0, self.by_bytes.get
        while at < len(word):
            for end in range(min(len(word), at + self.longest), at, -1):
                token = get(word[at:end])
                if token is not None:
                    ids.append(token)
                    at = end
                    break
        return ids

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens: whether the two bytes strings together encode to just these two."""
        ok = np.ones(len(a), dtype=bool)
        for i in range(self.right.shape[1]):
            for j in range(self.left.shape[1]):
                live = np.flatnonzero(ok & (self.right[a, i, 0] >= 0) & (self.left[b, j, 0] >= 0))
                if not len(live):
                    continue
                (x, x_until), (y, y_until) = self.right[a[live], i].T, self.left[b[live], j].T
                key = x.astype(np.int64) << 32 | y
                at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
                rank = np.where(self.merge_keys[at] == key, self.merge_ranks[at], NEVER)
                # at equal ranks the leftmost pair goes first: the left token's own, but this one before the right token's
                ok[live[(rank < x_until) & (rank <= y_until) & (rank < NEVER)]] = False
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        if len(self.pair_ok) > 500_000:
            self.pair_ok = {}
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        proposed = [self.propose(w) for w in data]
        lengths = np.fromiter(map(len, proposed), dtype=np.int64, count=len(proposed))
        flat = np.fromiter((i for ids in proposed for i in ids), dtype=np.int64, count=int(lengths.sum()))
        word = np.repeat(np.arange(len(proposed)), lengths)
        inner = np.flatnonzero(word[1:] == word[:-1])
        keys, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        new = np.array([k for k in keys.tolist() if k not in self.pair_ok], dtype=np.int64)
        self.pair_ok.update(zip(new.tolist(), self.compatible(new >> 32, new & 0xFFFFFFFF).tolist()))
        good = np.fromiter((self.pair_ok[k] for k in keys.tolist()), dtype=bool, count=len(keys))
        for i in np.unique(word[inner[~good[back]]]).tolist():
            proposed[i] = self.merge(data[i])
        return proposed

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(path: str) -> tuple[SpeculativeBpe, WordEncoder]:
    """One codec for each Python worker, which keeps its caches from task to task."""
    codec = SpeculativeBpe(path)
    return codec, WordEncoder(path, public_tokenizers.PATTERN, codec.special, codec.encode_words)


def encode(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns and ``ids`` (array of int)."""
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        _, words = _codec(path)
        return lambda texts: {"ids": words.encode(texts)}

    return map_text(docs, make, [T.StructField("ids", T.ArrayType(T.IntegerType()))], keep, text_col)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of the column ``ids``; null ids give an empty text."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        codec, _ = _codec(path)
        for batch in batches:
            column = batch.column("ids")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).cumsum().tolist()
            texts = [codec.decode(flat[a:b].tolist()) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns, n_tokens, ids_sha256 and decoded_sha256: texts encoded and decoded in one pass, of which only the digests leave the task."""
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        codec, words = _codec(path)
        name = [str(i) for i in range(len(codec.tokens))]
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

        def run(texts):
            lists = [ids.tolist() for ids in words.encode(texts)]
            return {
                "n_tokens": [len(ids) for ids in lists],
                "ids_sha256": [sha(",".join(map(name.__getitem__, ids))) for ids in lists],
                "decoded_sha256": [sha(codec.decode(ids)) for ids in lists],
            }

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_text(docs, make, fields, keep, text_col)


def round_trip(docs: DataFrame, keep: list[str], path: str | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns, ``ids`` and ``n_tokens`` of every text (null counts as empty), each of which is decoded again.

    Raises ValueError for a text that does not decode to itself, so that no row is lost
    unseen; with byte-level vocabularies that hold all bytes there is none.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        codec, words = _codec(path)

        def run(texts):
            arrays = words.encode(texts)
            for ids, text in zip(arrays, texts):
                if codec.decode(ids.tolist()) != (text or ""):
                    raise ValueError(f"a text of {len(text or '')} characters does not decode to itself: {(text or '')[:60]!r}")
            return {"ids": arrays, "n_tokens": [len(ids) for ids in arrays]}

        return run

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    return map_text(docs, make, fields, keep, text_col)


def op3_bpe(spark, sf_dir) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return digests(read_table(spark, sf_dir, "documents"))
