import random

from tokenizers import Tokenizer, models

from sparkloom.llm.common import read
from sparkloom.llm.fertility import TOKENIZERS
from sparkloom.llm.viterbi import SPACE, PieceCounter, normal_pieces, op7_viterbi

SF = "/root/testdata/sf0.001"


def model():
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        return f.read()


def reference(pieces):
    vocab = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *pieces]
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


def test_against_the_tokenizer(spark):
    pieces = normal_pieces(model())
    ref = reference(pieces)
    docs = read(spark, SF, "documents")
    out = {r.doc_id: r.n_tokens for r in op7_viterbi(docs).collect()}
    for r in docs.collect():
        assert out[r.doc_id] == len(ref.encode(SPACE + r.text.replace(" ", SPACE)).ids)


def test_ties_unknowns_and_whole_search():
    rng = random.Random(3)
    pieces = [(p, -float(rng.randrange(1, 4))) for p in ["a", "b", "ab", "ba", "aab", "abb", SPACE, SPACE + "a", SPACE * 2, SPACE + "ab", "é"]]
    ref, own = reference(pieces), PieceCounter(pieces)
    broken = PieceCounter([*pieces, ("b" + SPACE + "a", -1.0)])
    ref2 = reference([*pieces, ("b" + SPACE + "a", -1.0)])
    assert own.splits and not broken.splits
    for _ in range(1500):
        text = "".join(rng.choice("aaabbb  é你\n") for _ in range(rng.randrange(1, 30)))
        line = SPACE + text.replace(" ", SPACE)
        assert own.pieces_of(text) == len(ref.encode(line).ids), text
        assert broken.pieces_of(text) == len(ref2.encode(line).ids), text


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "x" * 100000), (4, "x"), (None, "a b"), (5, "\U0001f600")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_tokens int")
    out = {(r.doc_id, r.n_chars): r.n_tokens for r in op7_viterbi(docs).collect()}
    assert out[1, None] is None and out[2, 0] == 0 and out[5, 1] >= 2 and len(out) == 7
    assert op7_viterbi(docs.limit(0)).count() == 0
