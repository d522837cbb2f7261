"""Operator 7, token counts: a Viterbi search that carries only scores and piece counts.

The vocabulary's normal pieces and their scores form a unigram model.  A text is read as the
tokenizer reads it: a space in front, every space as U+2581.  An Aho-Corasick automaton lists
all pieces that end at each place; the best way to each place is kept as its score and its
number of pieces.  Tie rules are the tokenizer's: a later candidate for a place wins only with
a strictly higher score, and candidates come in order of their start, so the longest comes
first.  A character without a piece costs 10 below the least score and counts as its bytes.

No piece has U+2581 after another character, so the search splits there without changing any
count; equal stretches are searched once.  If a vocabulary breaks that rule, texts are searched
whole.

Defined results: null texts have a null count, empty texts 0 pieces; each row is counted;
extra columns are passed through; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.fertility import TOKENIZERS

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCounter(dict):
    """stretch of text -> number of pieces; emptied when it holds too many stretches."""

    LIMIT = 600_000

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.splits = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)

    def best(self, text: str) -> int:
        score, count = [0.0], [0]
        found = self.automaton.iter(text) if len(self.automaton) else iter(())
        match = next(found, None)
        single, unknown = self.single, self.unknown
        for end, char in enumerate(text):
            high, n = None, 0
            while match is not None and match[0] == end:
                length, own = match[1]
                x = score[end + 1 - length] + own
                if high is None or x > high:
                    high, n = x, count[end + 1 - length] + 1
                match = next(found, None)
            if char not in single:
                x = score[end] + unknown
                if high is None or x > high:
                    high, n = x, count[end] + len(char.encode("utf-8"))
            score.append(high)
            count.append(n)
        return count[-1]

    def __missing__(self, stretch: str) -> int:
        n = self.best(stretch)
        if len(stretch) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[stretch] = n
        return n

    def pieces_of(self, text: str) -> int:
        if not text:
            return 0
        line = SPACE + text.replace(" ", SPACE)
        return sum(map(self.__getitem__, STRETCH.findall(line))) if self.splits else self.best(line)


def normal_pieces(model: bytes) -> list[tuple[str, float]]:
    """The pieces that match text: all but control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


def token_counts(docs: DataFrame, text_col: str = "text", tokenizers: str = TOKENIZERS, out: str = "n_tokens") -> DataFrame:
    """docs with one more column, the number of pieces of each text."""
    with open(f"{tokenizers}/piece_bpe_32k.model", "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PieceCounter(normal_pieces(model.value))
        for texts in batches:
            yield pd.Series([None if t is None else counter.pieces_of(t) for t in texts], dtype="Int64")

    return docs.withColumn(out, counted(F.col(text_col)))


def op7_viterbi(docs: DataFrame) -> DataFrame:
    return token_counts(docs.select("doc_id", "text"), out="__n").select("doc_id", F.col("__n").alias("n_tokens"), F.char_length("text").cast("long").alias("n_chars"))
