"""Token counts under a unigram model, with forward scores shared along a trie.

A pre-token is a word of non-space characters behind the mark for a space. Distinct
pre-tokens are inserted in a trie; a node's forward score, the best log probability of
its prefix over all cuts into pieces, is computed once, when the node is made, from the
scores of its ancestors, whatever number of pre-tokens share the prefix. The node at
which a pre-token ends stores its token count. Equal scores go to fewer tokens.

Pieces come from a public vocabulary; their log probabilities follow Zipf's law by rank,
as the file holds ranks only. A character that no piece covers costs one token a UTF-8
byte. The trie and the counts stay in the Python worker, up to a bound of nodes.

Defined cases: null, empty and blank texts have no token; repeated rows are counted
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain
from math import log

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evispark.llm.common import map_text, read_table

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
MOST_NODES = 600_000


def piece_scores(path: str) -> dict[str, float]:
    """Log probability by piece: Zipf's law over the order of the file; control, unknown and byte pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = sum(1 / (r + 2.7) for r in range(len(pieces)))
    return {p: -log((r + 2.7) * total) for r, p in enumerate(pieces)}


class PieceTrie:
    """Forward scores and token counts of prefixes; node 0 is the empty prefix."""

    def __init__(self, scores: dict[str, float], most_nodes: int = MOST_NODES):
        self.scores, self.most_nodes = scores, most_nodes
        self.longest = max(map(len, scores), default=1)
        self.byte_score = min(scores.values(), default=0.0) - 10.0
        self.tails: dict[str, list[int]] = {}  # lengths of pieces by their last character
        for piece in scores:
            self.tails.setdefault(piece[-1], []).append(len(piece))
        self.tails = {c: sorted(set(n)) for c, n in self.tails.items()}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def _grow(self, word: str, j: int, path: list[int]) -> int:
        """A new node for the first ``j`` characters, scored from its ancestors on the path."""
        bytes_here = len(word[j - 1].encode("utf-8", "surrogatepass"))
        before = path[j - 1]
        score, tokens = self.best[before] + bytes_here * self.byte_score, self.tokens[before] + bytes_here
        for n in self.tails.get(word[j - 1], ()):
            if n > j:
                break
            own = self.scores.get(word[j - n : j])
            if own is not None:
                s, t = self.best[path[j - n]] + own, self.tokens[path[j - n]] + 1
                if s > score or (s == score and t < tokens):
                    score, tokens = s, t
        self.best.append(score)
        self.tokens.append(tokens)
        return len(self.best) - 1

    def insert(self, word: str) -> int:
        """The token count of a word's pre-token, which its terminal keeps."""
        node, path, child = 0, [0], self.child
        marked = SPACE + word
        for j, c in enumerate(marked, start=1):
            key = node << 21 | ord(c)
            below = child.get(key)
            if below is None:
                below = child[key] = self._grow(marked, j, path)
            node = below
            path.append(node)
        self.terminal[word] = self.tokens[node]
        return self.tokens[node]

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.best) > self.most_nodes:
            self.clear()
        lists = [WORD.findall(t) if t else [] for t in texts]
        for word in sorted(set(chain.from_iterable(lists)).difference(self.terminal)):
            self.insert(word)
        get = self.terminal.__getitem__
        return [sum(map(get, words)) for words in lists]


@lru_cache(maxsize=2)
def _trie(path: str) -> PieceTrie:
    return PieceTrie(piece_scores(path))


def count_tokens(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns, ``n_pretokens`` and ``n_tokens``."""
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        trie = _trie(path)
        return lambda texts: {"n_tokens": trie.count(texts), "n_pretokens": [len(WORD.findall(t)) if t else 0 for t in texts]}

    return map_text(docs, make, [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())], keep, text_col)


def op10_token_counts(spark, sf_dir) -> DataFrame:
    """Pre-tokens and tokens of every document."""
    return count_tokens(read_table(spark, sf_dir, "documents"))
