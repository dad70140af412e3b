"""op5_token_files and op8_packing against the tokenizers library's encode as it comes."""

import random
import zlib
from array import array

import public_tokenizers as P
import pytest
from derivanta.llm import chunk_tokens, queries
from tokenizers import Tokenizer

END, START = "<|endoftext|>", "<|startoftext|>"
TEXTS = ["a <|endoftext|> b", END, f"{START}{END}", f" {END} ", f"A{START}b\n {END}  c's", f"é́{END}́ x", "<|EndOfText|> <|endoftext|", f"x\t{END}\n\n{END} 12 y", None, "", "plain words"]
_rng = random.Random(4)
TEXTS += ["".join(_rng.choices([END, START, " ", "  ", "\n", "Word", "é", "'s", "<|", "12"], k=40)) for _ in range(60)]


def library_ids(name, end):
    t = Tokenizer.from_file(P.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in TEXTS]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec(name):
    codec = chunk_tokens.library_codec(P.path(name), P.PATTERN, added=True)
    assert [list(array("I", codec.encode(x or ""))) for x in TEXTS] == [ids[:-1] for ids in library_ids(name, 0)]


def test_queries(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda ids: zlib.crc32(array("I", ids).tobytes())
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.op5_token_files(spark, str(tmp_path)).collect()}
    assert got == {i: (len(ids), crc(ids)) for i, ids in enumerate(library_ids("word_bpe_49k.json", 1))}
    got = {r.doc_id: (r.length, r.ids_crc32) for r in queries.op8_packing(spark, str(tmp_path)).collect()}
    assert got == {i: (len(ids), crc(ids)) for i, ids in enumerate(library_ids("byte_bpe_50k.json", 0))}


def test_codec_on_odd_texts():
    parts = ["a", "the", " ", "  ", "\n", "\r\n", "'s", "'re", "'", "é", "İ", "ß", "Σ", "σς", "é", "中", "😀", "1", "½", "٣", ".", "!?", END, START, "<|", "\x85", "\x1c", "\xa0", "　", "\x00", "ÿ", "ing", "ſ", "ﬁ", "ʰ", "ͅ", "ǅ", "_", "word,"]
    odd = ["".join(_rng.choices(parts, k=_rng.randint(0, 40))) for _ in range(4000)] + ["x" * 20_000, "Word. " * 5_000]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        codec, library = chunk_tokens.library_codec(P.path(name), P.PATTERN), Tokenizer.from_file(P.path(name))
        assert [list(array("I", codec.encode(x))) for x in odd] == [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]


def test_long_white_space():
    codec = chunk_tokens.library_codec(P.path("byte_bpe_50k.json"), P.PATTERN)
    text = f"a{' ' * 1_000_000}{END}" + "\n" * 300_000
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    short = lambda n: list(array("I", codec.encode(f"a{' ' * n}{END}")))
    assert [short(n) for n in (1, 2, 999)] == [library.encode(f"a{' ' * n}{END}").ids for n in (1, 2, 999)]
    ids = array("I", codec.encode(text))
    assert library.decode(list(ids), skip_special_tokens=False) == text and ids.count(50256) == 1
