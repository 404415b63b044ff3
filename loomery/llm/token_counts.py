"""Token counts of a unigram vocabulary by count-only Viterbi.

Aho-Corasick lists, for each end position in a word, the vocabulary pieces that
end there, longest first; dynamic programming carries the best score and the
number of pieces on that path, nothing else. Ties go, as in the tokenizer, to the
piece that starts earliest; a character without a piece of its own costs the
lowest score less ten and joins a neighbouring unknown. Words are white-space
chunks with a word-begin mark, and repeat, so counts are kept in a bounded memory.

Defined cases: null and empty texts count 0; texts are counted whole; repeated
rows are counted alike; an empty table gives an empty result; extra columns pass
through, ``n_tokens`` and ``n_words`` are replaced if present.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loomery.llm.columns import map_texts, named

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
_MEMORY = 500_000
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@cache
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces of a public sentencepiece file with Zipf log-probabilities by their rank; control and byte pieces stay out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = sum(1 / (r + 2) for r in range(len(pieces)))
    return tuple((p, -math.log((r + 2) * total)) for r, p in enumerate(pieces))


class PieceCounter(dict):
    """Maps a white-space chunk to the number of pieces on its best path."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        n = len(word)
        best, pieces, loose = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        matches: list[list] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(word):
            matches[end + 1].append(match)
        for end in range(1, n + 1):
            top = None
            for length, score in matches[end]:
                score += best[end - length]
                if top is None or score > top:
                    top, pieces[end] = score, pieces[end - length] + 1
            if word[end - 1] not in self.singles:
                score = self.unknown + best[end - 1]
                if top is None or score > top:
                    top, pieces[end], loose[end] = score, pieces[end - 1] + (not loose[end - 1]), True
            best[end] = top
        return pieces[n]

    def __missing__(self, chunk: str) -> int:
        if len(self) >= _MEMORY:
            self.clear()
        out = self.count(MARK + chunk)
        if len(chunk) < 64:
            self[chunk] = out
        return out


@cache
def piece_counter(path: str) -> PieceCounter:
    """One counter for each worker process."""
    return PieceCounter(vocabulary(path))


def count_text(counter: PieceCounter, text: str | None) -> tuple[int, int]:
    """Pieces and words of one text."""
    words = [w for w in _SPACE.split(text or "") if w] if re.search("[\x1c-\x1f]", text or "") else (text or "").split()
    return sum(map(counter.__getitem__, words)), len(words)


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``n_words``; the text column itself is dropped. ``path`` must be readable on executors."""
    keep = [c for c in docs.columns if not named(c, text, "n_tokens", "n_words")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in batches:
            counts = [count_text(counter, t) for t in batch.column(len(keep)).to_pylist()]
            new = [pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=[*batch.schema.names[: len(keep)], "new_0", "new_1"])

    return map_texts(docs, keep, text, {"n_tokens": "long", "n_words": "long"}, run)
