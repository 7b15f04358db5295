"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary's matches in a word; dynamic programming carries the best score and the
number of pieces. Ties are settled as the tokenizer does: at each place the first candidate with the highest score
stays, and candidates come with the longest match first; a character that is no piece itself costs the lowest score less
ten and counts its UTF-8 bytes. Words start at blanks and carry the blank as their mark, so texts fall into words that
are counted alone.

The vocabulary is that of a sentencepiece file (pieces and scores), used as a unigram model. The piece that stands for
unknown characters is never matched in a text. Defined cases: a null or
empty text has no tokens. A text of any length is counted whole. Repeated rows and null ids are counted each. An empty
table gives an empty result. Rows keep their number and order of columns doc_id, n_tokens; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Words

MARK = "▁"
UNKNOWN_COST = 10.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not p.is_unknown(i)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_COST
        self.words = Words(lambda word: self.best(MARK + word)[1])

    def best(self, word: str) -> tuple[float, int]:
        """The score of the best way to part the word into pieces, and its number of pieces."""
        scores, counts = [0.0], [0]
        at, score, count, single = 0, None, 0, False

        def close(until: int) -> None:
            # the places without more matches get what their own character costs, if that is no piece
            nonlocal at, score, count, single
            while at < until:
                if not single:
                    alone = scores[at] + self.unknown
                    if score is None or alone > score:
                        score, count = alone, counts[at] + len(word[at].encode())
                scores.append(score)
                counts.append(count)
                at, score, count, single = at + 1, None, 0, False

        for end, (length, value) in self.automaton.iter(word):
            if end != at:
                close(end)
            start = end + 1 - length
            found = value + scores[start]
            if score is None or found > score:
                score, count = found, counts[start] + 1
            if length == 1:
                single = True
        close(len(word))
        return scores[-1], counts[-1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            words = words[1:]
        return sum(map(self.words.__getitem__, words))


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of each row."""
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.count(t.as_py()) for t in batch.column(1)], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")
