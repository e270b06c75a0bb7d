"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates the pieces that end at each character; dynamic programming carries the
best score and its piece count. The tie rules are those of the unigram tokenizer of the ``tokenizers`` library:
starts are tried in ascending order and a later one wins only with a strictly higher score; a character without
a one-character piece costs the lowest score less 10; neighbouring unknown characters fuse into one unknown
piece, which falls back to bytes where the vocabulary has all byte pieces.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
UNK_PENALTY = 10.0


class UnigramCounter:
    """Counts pieces. Texts are cut where no piece can span the cut, and counts of short cuts are remembered."""

    def __init__(self, pieces: list[str], scores: list[float], unk_id: int = 0, remember: int = 400_000):
        self.vocab = {p: i for i, p in enumerate(pieces)}
        self.unk = pieces[unk_id]
        self.unk_score = min(scores) - UNK_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.vocab for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.vocab.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), scores[i], i == unk_id))
        self.automaton.make_automaton()
        # Without a piece that goes on to a space after another character, the best path breaks before every run of spaces.
        crosses = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.vocab) or SPACE not in self.vocab
        self.cut = (lambda text: [text]) if crosses else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        counter, most = self, remember

        class Remembered(dict):
            def __missing__(self, part: str) -> int:
                n = counter.viterbi(part)[1]
                if len(part) <= 48:
                    if len(self) >= most:
                        self.clear()
                    self[part] = n
                return n

        self.remembered = Remembered()

    def viterbi(self, text: str) -> tuple[float, int]:
        """Best score of ``text`` (spaces already marked) and its number of pieces."""
        n, has_one = len(text), [False] * len(text)
        ends: list[list] = [[] for _ in range(n)]
        for end, hit in self.automaton.iter(text):  # at one end, longer pieces first: starts ascend
            ends[end].append(hit)
            if hit[0] == 1:
                has_one[end] = True
        # state of the best path to each position: score, pieces before the open unknown run, that run's start (-1: none)
        score, count, run = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n + 1):
            best, start, unknown = None, end - 1, False
            for length, s, is_unk in ends[end - 1]:
                x = score[end - length] + s
                if best is None or x > best:
                    best, start, unknown = x, end - length, is_unk
            if not has_one[end - 1]:
                x = score[end - 1] + self.unk_score
                if best is None or x > best:
                    best, start, unknown = x, end - 1, True
            score[end] = best
            if unknown:
                run[end] = run[start] if run[start] >= 0 else start
                count[end] = count[start]
            else:
                count[end] = count[start] + self._closed(text, run[start], start) + 1
        return score[n], count[n] + self._closed(text, run[n], n)

    def _closed(self, text: str, start: int, end: int) -> int:
        if start < 0:
            return 0
        part = text[start:end]
        return 1 if part in self.vocab or not self.bytes else len(part.encode())

    def count(self, text: str | None) -> int:
        """Pieces of a whole text; none for null and the empty text."""
        if not text:
            return 0
        return sum(map(self.remembered.__getitem__, self.cut(SPACE + text.replace(" ", SPACE))))


def vocabulary(path: str, most: int = 1_000_000) -> tuple[list[str], list[float]]:
    """Pieces and scores of a sentencepiece model file, at most ``most`` (the bound of what is broadcast)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > most:
        raise ValueError(f"{n} pieces; at most {most} are broadcast")
    return [model.id_to_piece(i) for i in range(n)], [float(model.get_score(i)) for i in range(n)]


_counters: dict[str, UnigramCounter] = {}


def token_count(spark: SparkSession, text: Column, model_path: str) -> Column:
    """The number of tokens of ``text`` as a column. The vocabulary file is read on the driver and broadcast."""
    pieces = spark.sparkContext.broadcast(vocabulary(model_path))
    key = uuid.uuid4().hex

    @F.pandas_udf("bigint")
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _counters:  # one automaton for a worker's life
            _counters[key] = UnigramCounter(*pieces.value)
        count = _counters[key].count
        for part in texts:
            yield pd.Series([count(t) for t in part], dtype="int64")

    return counts(text)


def token_counts(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with a count of tokens. Null and empty texts have 0; all rows and other columns stay.

    A column named like ``out`` is replaced. Work and memory are per row; nothing is shuffled.
    """
    return docs.withColumn(out, token_count(docs.sparkSession, F.col(text), model_path))
