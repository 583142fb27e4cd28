"""Token counts under a unigram model, over a trie of the distinct pre-tokens.

A pre-token is a word with a leading mark. The best segmentation of every prefix (its forward score and its number of
tokens) depends on the prefix alone, so the worker keeps one trie: each distinct pre-token is inserted once, a new node
gets its forward score from its ancestors, shared prefixes are never scored again, and the node where a pre-token ends
stores its count. A document's count is then the sum over its words. No shuffle: every task works on its own rows, with
a trie of at most MAX_NODES nodes and a word more (it starts anew when full, which changes no result).

The model is a list of pieces with log probabilities. A character that no piece covers counts as its UTF-8 bytes, one
token each, at UNKNOWN per byte. Among segmentations of equal score the one with fewer tokens counts.

Defined cases: null, empty or blank texts have no tokens; very long texts are counted whole; among segmentations that tie
the one with fewer tokens counts; a null id stays null; repeated rows count each; an empty table gives an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN = -25.0
MAX_NODES = 800_000
SHORT = (1, 2)
_models: dict[str, Trie] = {}


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file in file order; the r-th of them has log probability -ln(r + 2), a rank law."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return {piece: -math.log(r + 2) for r, piece in enumerate(usable)}


class Trie:
    """Forward scores by prefix. A node is a number; `child` maps node * 2**21 + character to the next node."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        # Lengths of the pieces of three characters and more by their last three: few places to look from each character.
        by_end: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > 2:
                by_end.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {end: (*SHORT, *sorted(n)) for end, n in by_end.items()}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]
        self.counts: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The number of tokens of a pre-token."""
        text, at, path = MARK + word, 0, [0]
        score, tokens, pieces, lengths, child = self.score, self.tokens, self.pieces, self.lengths, self.child
        for end, c in enumerate(text, 1):
            edge = (at << 21) | ord(c)
            before, at = at, child.get(edge, 0)
            if not at:
                n = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                best, fewest = score[before] + n * UNKNOWN, tokens[before] + n
                for size in lengths.get(text[end - 3 : end] if end > 2 else "", SHORT):
                    if size <= end and (p := pieces.get(text[end - size : end])) is not None:
                        start = path[end - size]
                        s = score[start] + p
                        if s > best or (s == best and tokens[start] < fewest - 1):
                            best, fewest = s, tokens[start] + 1
                at = child[edge] = len(score)
                score.append(best)
                tokens.append(fewest)
            path.append(at)
        n = self.counts[word] = tokens[at]
        return n

    def count(self, words: list[str]) -> int:
        known, total = self.counts, 0
        for w in words:
            n = known.get(w)
            if n is None:
                if len(self.score) >= MAX_NODES or len(w) > 1000:
                    n = self._alone(w)
                else:
                    n = self.insert(w)
            total += n
        return total

    def _alone(self, word: str) -> int:
        """As insert(), without keeping anything: for huge words, and when the trie is full until the next text."""
        text = MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            c = text[end - 1]
            n = len(c.encode("utf-8", "surrogatepass"))
            top = (best[-1][0] + n * UNKNOWN, best[-1][1] - n)
            for size in self.lengths.get(text[max(0, end - 3) : end], SHORT):
                start = end - size
                if start >= 0 and (p := self.pieces.get(text[start:end])) is not None:
                    top = max(top, (best[start][0] + p, best[start][1] - 1))
            best.append(top)
        return -best[-1][1]


def _trie(path: str) -> Trie:
    if path not in _models:
        _models[path] = Trie(load_pieces(path))
    return _models[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_words and n_tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        trie = _trie(path)
        for b in batches:
            n_words, n_tokens = [], []
            for text in b.column(1):
                if len(trie.score) >= MAX_NODES:
                    trie.clear()
                words = [w.decode("utf-8", "surrogatepass") for w in text.as_py().encode("utf-8", "surrogatepass").split()] if text.is_valid else []
                n_words.append(len(words))
                n_tokens.append(trie.count(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
