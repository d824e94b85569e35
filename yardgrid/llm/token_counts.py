"""Numbers of tokens under a unigram vocabulary, without making the tokens.

Words start at a space (written as U+2581, one is put before the text) and no piece spans two of
them, so the count of a text is the sum over its words. In a word an Aho-Corasick automaton lists
all vocabulary pieces by their ends and dynamic programming carries the best score and its number of
pieces. Ties go to the earlier start; a character that no single-character piece covers costs ten
less than the smallest score and becomes one piece for each of its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardgrid.llm.common import value_udf

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# Words remembered by a task, and the longest of them.
REMEMBERED, LONGEST = 500_000, 48

Vocabulary = list[tuple[str, float]]


def load_vocabulary(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def word_counter(vocabulary: Vocabulary) -> Callable[[str], int]:
    """A function from a word to its number of pieces."""
    automaton = ahocorasick.Automaton()
    for piece, score in vocabulary:
        if piece:
            automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
    matches = automaton.iter
    singles = {piece for piece, _ in vocabulary if len(piece) == 1}

    def count(word: str) -> int:
        # Matches come by their ends and, at one end, longest first: the earliest start wins ties.
        best, pieces = [0.0, *[-math.inf] * len(word)], [0] * (len(word) + 1)
        if singles.issuperset(word):
            for end, (length, score) in matches(word):
                candidate = best[end + 1 - length] + score
                if candidate > best[end + 1]:
                    best[end + 1] = candidate
                    pieces[end + 1] = pieces[end + 1 - length] + 1
            return pieces[-1]
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, match in matches(word):
            ends[end].append(match)
        for end, character in enumerate(word):
            for length, score in ends[end]:
                candidate = best[end + 1 - length] + score
                if candidate > best[end + 1]:
                    best[end + 1] = candidate
                    pieces[end + 1] = pieces[end + 1 - length] + 1
            if character not in singles and best[end] + unknown > best[end + 1]:
                best[end + 1] = best[end] + unknown
                pieces[end + 1] = pieces[end] + len(character.encode("utf-8", "surrogatepass"))
        return pieces[-1]

    return count


class _Memory(dict):
    """Counts of the words seen by a task; started anew when it is full."""

    def __init__(self, count: Callable[[str], int]) -> None:
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        number = self.count(SPACE + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = number
        return number


def text_counter(vocabulary: Vocabulary) -> Callable[[str], int]:
    """A function from a text to its number of tokens; an empty text has none."""
    memory = _Memory(word_counter(vocabulary))

    def count(text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        return sum(map(memory.__getitem__, words[1:] if words[0] == "" else words))

    return count


@cache
def _file_counter(path: str) -> Callable[[str], int]:
    """The counter of a file; kept by a worker from task to task."""
    return text_counter(load_vocabulary(path))


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each whole text.

    ``path`` names a vocabulary file present on every machine. Null and empty texts count 0;
    repeated rows are counted each. Nothing is shuffled.
    """
    count = value_udf("bigint", lambda: _file_counter(path))
    return df.withColumn(out, count(F.coalesce(F.col(text), F.lit(""))))
