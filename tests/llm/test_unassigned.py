import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from derivanta.llm.chunk_tokens import library_codec


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_on_code_points_without_a_character(name):
    """Texts of any code points, a third of them unassigned or private, beside letters, digits and apostrophes."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    codec, library = library_codec(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    odd = [i for i in points if unicodedata.category(chr(i)) in ("Cn", "Co")]
    assigned = [i for i in points if unicodedata.category(chr(i)) not in ("Cn", "Co")]
    rng = random.Random(17)
    draw = [lambda: chr(rng.choice(odd)), lambda: rng.choice("'s ab1é. \n-'t"), lambda: chr(rng.choice(assigned))]
    texts = ["".join(rng.choice(draw)() for _ in range(rng.randint(1, 12))) for _ in range(20_000)] + ["\U00012561'", "\U0003f0cca", "\U0003e90d's"]
    wrong = [t for t in texts if np.frombuffer(codec.encode(t), "<u4").tolist() != library.encode(t, add_special_tokens=False).ids]
    assert wrong == []


def test_a_column_at_once_gives_the_same(spark):
    """Distinct chunks of many texts against one text at a time: odd letters, marks, tokens in texts, nulls, slices."""
    import pyarrow as pa

    codec = library_codec(public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN)
    rng = random.Random(4)
    words = ["plain", "Plain,", "Été", "İstanbul", "ſ", "\x01", "a\x01b", "x" * 300, "don't", "end.", "..", ",", "", "\n", "a\nb", "ŉa", "ǅ", "<|endoftext|>", "<end_of_text>", "½", "１", "e\u0301", "A\u030a.", "12,"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(500)] + ["", " ", "  a  ", None]
    column = pa.array(texts)
    for part in (column, column.slice(100, 50), column.slice(503), pa.array([], pa.string())):
        assert codec.encode_column(part) == [codec.encode(t or "") for t in part.to_pylist()]
