"""Operator 1, quality rules: how well public vocabularies fit a text.

Each word (a run of characters other than space and U+0009-U+000D), however long, is encoded
whole and on its own by two public vocabularies: pieces with byte fallback, and byte-level BPE.  Per document this
gives characters per token (both vocabularies), the share of byte-fallback tokens and the
entropy of the token distribution.  A document is rejected if a measure leaves the band of
its language, or of its main script where the language has no band.

Defined results: null and empty texts have no words and fail the base rule; a document of
any length is measured whole; rows are judged one by one, so ties, repeated rows and extra
columns change nothing (a column named as the output is replaced); an empty table gives an
empty table.  Both encoders take time nearly in proportion to a word's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import SEPARATORS

TOKENIZERS = "/opt/tokenizers"
# Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Band:
    """Bounds inside which a measure is accepted, for texts that pass the base rule."""

    min_chars_per_token: float
    max_chars_per_token: float
    min_chars_per_byte_token: float
    max_byte_share: float
    min_entropy: float


BANDS = {
    "en": Band(1.80, 6.5, 1.70, 0.15, 5.3),
    "fr": Band(1.68, 6.5, 1.50, 0.20, 5.3),
    "de": Band(1.95, 6.5, 1.50, 0.20, 5.3),
    "es": Band(1.72, 6.5, 1.45, 0.20, 5.3),
    "script:latin": Band(1.60, 7.0, 1.30, 0.25, 5.0),
    "script:cyrillic": Band(1.20, 6.0, 0.8, 0.30, 4.8),
    "script:greek": Band(0.60, 6.0, 0.4, 0.80, 4.5),
    "script:arabic": Band(0.60, 6.0, 0.4, 0.80, 4.5),
    "script:indic": Band(0.25, 6.0, 0.2, 1.00, 4.5),
    "script:cjk": Band(0.30, 6.0, 0.25, 0.95, 4.8),
    "script:other": Band(0.25, 6.0, 0.2, 1.00, 4.5),
}

# The blocks of each script, first and last code point; what lies in none of them above U+024F is "other".
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "cyrillic": ((0x400, 0x52F),),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "indic": ((0x900, 0xDFF),),
    "cjk": ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, n_byte_tokens long, n_bpe_tokens long, token_entropy double, script string"
)


def vocabulary_bytes(folder: str) -> tuple[bytes, bytes]:
    """The two vocabulary files (under 2 MB), read once on the driver and sent to the tasks."""
    out = []
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken"):
        with open(f"{folder}/{name}", "rb") as f:
            out.append(f.read())
    return out[0], out[1]


class WordTokens(dict):
    """word -> number, with the word's tokens; emptied when it holds too many words."""

    LIMIT = 600_000

    def __init__(self, pieces: bytes, ranks: bytes) -> None:
        import base64

        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        # One pattern for a whole word: the vocabulary's own split at letters, digits and others.
        split = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("words", pat_str=split, mergeable_ranks=table, special_tokens={})
        n = self.pieces.vocab_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(n)], dtype=bool)
        # Words are encoded many at a time, joined by spaces; these tokens begin a word.
        self.begins = np.array([self.pieces.id_to_piece(i).startswith("\u2581") for i in range(n)], dtype=bool)
        self.bpe_begins = np.zeros(max(table.values()) + 1, dtype=bool)
        self.bpe_begins[[i for token, i in table.items() if token.startswith(b" ")]] = True
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.tokens = np.zeros(1 << 16, dtype=np.int32)  # of all words, one after the other
        self.ends = np.zeros(1 << 14, dtype=np.int64)  # of each word's tokens
        self.n_bpe = np.zeros(1 << 14, dtype=np.int64)

    @staticmethod
    def room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        return array if used + more <= len(array) else np.concatenate([array, np.zeros(max(more, len(array)), dtype=array.dtype)])

    def learn(self, words: list[bytes]) -> None:
        """Number the new words and encode them."""
        texts = [w.decode("utf-8") for w in words]
        flat, n_pieces, n_bpe = self.together(texts)
        if flat is None:
            pieces = [self.pieces.encode(w) for w in texts]
            flat, n_pieces = np.fromiter((t for p in pieces for t in p), dtype=np.int32), [len(p) for p in pieces]
            n_bpe = [len(self.bpe.encode_ordinary(" " + w)) for w in texts]
        at, end = len(self), int(self.ends[len(self) - 1]) if self else 0
        self.tokens = self.room(self.tokens, end, len(flat))
        self.tokens[end : end + len(flat)] = flat
        self.ends, self.n_bpe = self.room(self.ends, at, len(words)), self.room(self.n_bpe, at, len(words))
        self.ends[at : at + len(words)] = end + np.cumsum(n_pieces)
        self.n_bpe[at : at + len(words)] = n_bpe
        self.update(zip(words, range(at, at + len(words))))

    def together(self, texts: list[str]) -> tuple:
        """Tokens and counts of all words from one call; none if a word blurs where words begin."""
        line = " ".join(texts)
        flat = np.array(self.pieces.encode(line), dtype=np.int32)
        bpe = np.array(self.bpe.encode_ordinary(" " + line), dtype=np.int32)
        first, bpe_first = np.flatnonzero(self.begins[flat]), np.flatnonzero(self.bpe_begins[bpe])
        if len(first) != len(texts) or len(bpe_first) != len(texts) or first[0] or bpe_first[0]:
            return None, None, None
        return flat, np.diff(first, append=len(flat)), np.diff(bpe_first, append=len(bpe))

    def tokens_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' tokens, one word after the other, and how many each has."""
        ends = self.ends[ids]
        starts = np.where(ids > 0, self.ends[ids - 1], 0)
        n = ends - starts
        return self.tokens[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)
    _, window, counts = np.unique((pair[:-1].astype(np.int64) << 32) | ids[2:], return_inverse=True, return_counts=True)
    twice = counts[window] >= 2
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def dup_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(SEPARATORS)]
    return len(lines) - len(set(lines))


def main_script(text: str) -> str:
    """The script that most characters belong to; the first of SCRIPTS of those with equally many."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = {name: sum(int(np.count_nonzero((points >= a) & (points <= b))) for a, b in blocks) for name, blocks in SCRIPTS.items()}
    found["other"] = int(np.count_nonzero(points >= 0x250)) - sum(n for name, n in found.items() if name != "latin")
    found["other"] -= int(np.count_nonzero((points >= 0x1E00) & (points <= 0x1EFF)))
    return max(found, key=lambda name: found[name])


def measure(text: str | None, vocab: WordTokens) -> tuple:
    if not text:
        return (0, 0, 0, 0, 0, 0, 0, 0, 0.0, "latin")
    if len(vocab) > vocab.LIMIT:
        vocab.reset()
    words = text.encode("utf-8").split()  # bytes split at the six separators only
    if new := [w for w in dict.fromkeys(words) if w not in vocab]:
        vocab.learn(new)
    ids = np.fromiter(map(vocab.__getitem__, words), dtype=np.int64, count=len(words))
    used, times = np.unique(ids, return_counts=True)
    tokens, lengths = vocab.tokens_of(used)
    n_tokens = int((lengths * times).sum())
    n_bytes, entropy = 0, 0.0
    if n_tokens:
        tally = np.bincount(tokens, weights=np.repeat(times, lengths))
        n_bytes = int(tally[vocab.is_byte[: len(tally)]].sum())
        tally = tally[tally > 0]
        entropy = float(np.log2(n_tokens) - (tally * np.log2(tally)).sum() / n_tokens)
    n_bpe = int((vocab.n_bpe[used] * times).sum())
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SEPARATORS),
        sum(text.count(c) for c in SYMBOLS),
        dup_lines(text),
        repeat_words(ids),
        n_tokens,
        n_bytes,
        n_bpe,
        max(0.0, entropy),
        main_script(text),
    )


def measures_of(text: Column, files: object) -> Column:
    """A struct column with MEASURES; only the text travels to Python."""

    @F.pandas_udf(MEASURES)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab = WordTokens(*files.value)
        names = [field.split()[0] for field in MEASURES.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure(t, vocab) for t in texts], columns=names)

    return measured(text)


def within(band: Band, m: str) -> Column:
    chars, tokens = F.col(f"{m}.word_chars"), F.greatest(F.col(f"{m}.n_tokens"), F.lit(1))
    bpe = F.greatest(F.col(f"{m}.n_bpe_tokens"), F.lit(1))
    return (
        (chars / tokens).between(band.min_chars_per_token, band.max_chars_per_token)
        & (chars / bpe >= band.min_chars_per_byte_token)
        & (F.col(f"{m}.n_byte_tokens") / tokens <= band.max_byte_share)
        & (F.col(f"{m}.token_entropy") >= band.min_entropy)
    )


def fertility(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str | None = "lang",
    tokenizers: str = TOKENIZERS,
    bands: dict[str, Band] | None = None,
    out: str = "__fertility",
) -> DataFrame:
    """docs with one more column, a struct: the measures, base_failed and kept."""
    bands = bands or BANDS
    files = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(tokenizers))
    raw = docs.withColumn(out, measures_of(F.col(text_col), files))
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    fits = F.when(F.lit(False), True)
    for name, band in sorted(bands.items(), key=lambda x: x[0].startswith("script:")):
        same = F.col(f"{out}.script") == name[7:] if name.startswith("script:") else lang == name
        fits = fits.when(same, within(band, out))
    fits = fits.otherwise(True)
    failed = (F.col(f"{out}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{out}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{out}.n_words")
    )
    verdict = F.struct(f"{out}.*", failed.alias("base_failed"), (~failed & fits).alias("kept"))
    return raw.withColumn(out, verdict)


def op1_fertility(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, the verdicts and the method's measures."""
    m = "__fertility"
    return fertility(docs.select("doc_id", "text", "lang")).select(
        "doc_id",
        *(f"{m}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        f"{m}.base_failed",
        f"{m}.kept",
        f"{m}.n_tokens",
        F.round(F.col(f"{m}.word_chars") / F.greatest(F.col(f"{m}.n_tokens"), F.lit(1)), 6).alias("chars_per_token"),
        F.round(F.col(f"{m}.word_chars") / F.greatest(F.col(f"{m}.n_bpe_tokens"), F.lit(1)), 6).alias("chars_per_bpe_token"),
        F.round(F.col(f"{m}.n_byte_tokens") / F.greatest(F.col(f"{m}.n_tokens"), F.lit(1)), 6).alias("byte_share"),
        F.round(f"{m}.token_entropy", 6).alias("token_entropy"),
    )
