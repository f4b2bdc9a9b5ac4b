"""Token counts by a linear longest-match automaton over a piece vocabulary.

The vocabulary is a trie.  When a word can't go on from a node, the longest piece on
the path is popped and matching goes on at the failure link, which stands for the rest
of the path; how many pieces a failure pops is counted when the automaton is built.  A
word is then read once, character by character, and only numbers are added up.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import _path
from .common import narrowed, slices

VOCABULARY = "piece_bpe_32k.model"
#: Stands before the first character of a word, as in the vocabulary file.
WORD_START = "▁"


class LongestMatch:
    """Greedy longest-match-first piece counts of single words."""

    #: Words whose counts are kept, and how long they may be.
    MEMO, LONGEST = 500_000, 64

    def __init__(self, pieces: Iterable[str]):
        self.child: list[dict[str, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                nxt = self.child[at].get(c)
                if nxt is None:
                    nxt = self.child[at][c] = len(self.child)
                    self.child.append({})
                    is_piece.append(False)
                at = nxt
            is_piece[at] = at != 0
        n = len(self.child)
        #: Where matching goes on after a failure (-1: no piece fits), and the pieces that it pops.
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque((0, c, v) for c, v in self.child[0].items())
        while queue:
            u, c, v = queue.popleft()
            if is_piece[v]:
                self.fail[v], self.popped[v] = 0, 1
            elif u:
                z, count = self.fail[u], self.popped[u]
                while z > 0 and c not in self.child[z]:
                    z, count = self.fail[z], count + self.popped[z]
                if z >= 0 and c in self.child[z]:
                    self.fail[v], self.popped[v] = self.child[z][c], count
            queue.extend((v, d, w) for d, w in self.child[v].items())
        #: Pieces that the end of a word pops at each node; -1: the rest is no sequence of pieces.
        self.ended = [0] * n
        for v in self._by_depth():
            if v:
                f = self.fail[v]
                self.ended[v] = -1 if f < 0 or self.ended[f] < 0 else self.popped[v] + self.ended[f]
        self.memo: dict[str, int] = {}

    def _by_depth(self) -> Iterator[int]:
        queue = deque([0])
        while queue:
            v = queue.popleft()
            yield v
            queue.extend(self.child[v].values())

    def count(self, word: str) -> int:
        """Pieces of one word; 0 if it is no sequence of pieces (then it is one unknown token)."""
        child, fail, popped = self.child, self.fail, self.popped
        at, total = 0, 0
        for c in word:
            while True:
                nxt = child[at].get(c)
                if nxt is not None:
                    at = nxt
                    break
                total += popped[at]
                at = fail[at] if at else -1
                if at < 0:
                    return 0
        rest = self.ended[at]
        return 0 if rest < 0 else total + rest

    def counts(self, text: str) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text; words end at ASCII white space."""
        memo, words, tokens, unknown = self.memo, 0, 0, 0
        for word in text.translate(_BREAKS).split(" "):
            if word:
                n = memo.get(word)
                if n is None:
                    n = self.count(WORD_START + word)
                    if len(memo) < self.MEMO and len(word) <= self.LONGEST:
                        memo[word] = n
                words += 1
                tokens += n or 1
                unknown += not n
        return words, tokens, unknown


_BREAKS = dict.fromkeys(range(9, 14), " ")


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return LongestMatch(model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, n_words, n_tokens, n_unknown`` (long) for every row.

    Words are runs without ASCII white space; a word that no sequence of pieces spells is
    one unknown token.  Null and empty texts have 0 of each; repeated rows stay; other
    columns are not read.  ``vocabulary`` is a path, or a name among the public ones.
    """
    rows = narrowed(documents, id_column, text_column)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = automaton(_path(vocabulary))
        for batch in batches:
            for part in slices(batch, 1):
                n = [pieces.counts(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([x[k] for x in n], pa.int64()) for k in range(3)]], names=[id_column, "n_words", "n_tokens", "n_unknown"])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_words long, n_tokens long, n_unknown long")
