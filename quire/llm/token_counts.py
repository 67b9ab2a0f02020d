"""Token counts of texts under a unigram model, by dynamic programming over a trie.

The model: the pieces of a public vocabulary file, the r-th of which (from 1)
has probability proportional to 1 / (r + 1); a character no piece covers costs
one byte token for each of its UTF-8 bytes. A pre-token is a white-space word
behind a word mark; its count is that of its best segmentation (fewest tokens
among equals). The distinct pre-tokens of a batch are visited in sorted order,
which is depth-first order over their trie: the forward scores of the branch
being visited are kept, so those of a shared prefix are computed once, and a
terminal stores its count for all its occurrences.

Defined results: a null or empty text has no pre-tokens and no tokens; rows
with equal or null doc_id are counted one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_text, text_slices
from .tokens import tokenizer_path

MARK = "▁"
#: Pre-tokens a worker remembers before it starts afresh.
MEMO_WORDS = 800_000
#: Scores are whole numbers of this part of a nat, so sums are exact.
UNIT = 1e-6


def piece_scores(path: str) -> dict[str, int]:
    """Piece -> log probability in UNITs; control, unknown and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    total = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    return {p: round((-math.log(r + 2) - total) / UNIT) for r, p in enumerate(pieces)}


class Counter:
    def __init__(self, scores: dict[str, int]):
        # Every end of a piece, with the piece's score or None: looking backwards
        # from a place, no piece starts further off than the first end not in here.
        self.ends: dict[str, int | None] = {p[i:]: None for p in scores for i in range(1, len(p))}
        self.ends.update(scores)
        self.byte = min(scores.values(), default=0) - round(10 / UNIT)
        self.counts: dict[bytes, int] = {}

    def learn(self, words: set[bytes]) -> None:
        """Counts of all ``words``, sharing the forward scores of common prefixes."""
        if len(self.counts) + len(words) > MEMO_WORDS:
            self.counts.clear()
        new = sorted(MARK + w.decode() for w in words if w not in self.counts)
        best, count, last = [0], [0], ""
        get = self.ends.get
        for word in new:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            del best[same + 1:], count[same + 1:]
            for d in range(same + 1, len(word) + 1):
                size = len(word[d - 1].encode())
                top, n = best[d - 1] + size * self.byte, count[d - 1] + size
                for at in range(d - 1, -1, -1):
                    s = get(word[at:d], 0)
                    if s == 0:  # no piece ends like this (scores are below 0)
                        break
                    if s is not None:
                        s += best[at]
                        if s > top or s == top and count[at] + 1 < n:
                            top, n = s, count[at] + 1
                best.append(top)
                count.append(n)
            self.counts[word[1:].encode()] = count[-1]
            last = word

    def text(self, words: list[bytes]) -> int:
        return sum(map(self.counts.__getitem__, words))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(piece_scores(path))
    return _COUNTERS[path]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n_words, n_tokens = [], []
            for _, texts in text_slices(batch):
                cut = [t.split() for t in texts]
                c.learn(set().union(*cut))
                n_words += map(len, cut)
                n_tokens += map(c.text, cut)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             names=["doc_id", "n_pretokens", "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row."""
    return id_text(docs).mapInArrow(_counted(path), "doc_id long, n_pretokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
