"""Token ids of whole texts.

A text is cut at spaces where a tokenizer is sure to cut as well, so its ids are those of its
chunks in order, and a worker keeps the ids of recent chunks and pre-tokens in tables of bounded
size. Files of the tokenizers library go through tiktoken's merging routine.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .arrow_text import raw_bytes

_LONE = re.compile(r"(?<=\S) (?=\S)")
_LONG = 64
_STOPS = (",", ".", ";", ":", "!", "?")


class Memo(dict):
    """make(key), kept for the last limit to 2 * limit distinct keys used; long keys aren't kept."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > _LONG:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def spare_collector() -> None:
    """Tables of hundreds of thousands of entries make each full pass of the cycle collector dear;
    the codecs make no cycles, so a worker that holds them runs it seldom."""
    gc.set_threshold(200_000, 50, 100)


class Beside(KeyError):
    """A chunk with white space at an end, or none in it: the cut beside it was unsafe."""


class ChunkCodec:
    """encode(text) -> little-endian unsigned 32-bit ids; pieces(chunk) are those of a chunk by itself.

    keep: the space before a word belongs to its token, so a cut is safe only at a space
    between two characters that are no white space. Otherwise white space is dropped.
    """

    def __init__(self, pieces: Callable[[str], bytes], keep: bool, limit: int = 250_000):
        self.pieces, self.keep = pieces, keep
        self.known = Memo(self._spaced if keep else pieces, limit)

    def _spaced(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Beside
        return self.pieces(" " + chunk)

    def encode(self, text: str) -> bytes:
        parts = text.split(" ")
        get = self.known.__getitem__
        if not self.keep:
            return b"".join(map(get, parts))
        if len(parts) == 1:
            return self.pieces(text)
        try:
            if not parts[0] or parts[0][-1].isspace():
                raise Beside
            return b"".join([self.pieces(parts[0]), *map(get, parts[1:])])
        except Beside:
            parts = _LONE.split(text)
            last = [self.pieces(" " + parts[-1])] if len(parts) > 1 else []
            return b"".join([self.pieces(parts[0]), *map(get, parts[1:-1]), *last])


def _byte_letters() -> dict[int, str]:
    """The usual printable letter for each byte in byte-level vocabularies: bytes that print stand
    for themselves, the others get the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: Stands for the end of a word in the byte strings of tokens; no UTF-8 text holds this byte.
_WORD_END = b"\xff"
#: Ends a word within a row of words.
_MARK = "\x01"
#: Words of composed Latin letters, whose lower case is one letter each, and a stop or none.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[,.;:!?]?$"
_STOPPED = "[,.;:!?]$"


def _ranks(model: dict) -> dict[bytes, int]:
    """Byte string of each token that merges can reach -> its id. Ids must rise in the order of the
    merges, so that an id is its merge's rank as well."""
    if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"]:
        raise ValueError("the file's model isn't of a known kind")
    suffix, vocab = model["end_of_word_suffix"] or "", model["vocab"]
    byte_of = {letter: bytes([b]) for b, letter in _byte_letters().items()}

    def raw(token: str) -> bytes:
        ends = suffix and token.endswith(suffix)
        return b"".join(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + (_WORD_END if ends else b"")

    ranks = {raw(x): vocab[x] for letter in byte_of for x in {letter, letter + suffix}}
    last = max(ranks.values())
    for merge in model["merges"]:
        token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
        if vocab[token] <= last:
            raise ValueError("the file's ids don't rise with its merges")
        last = ranks[raw(token)] = vocab[token]
    return ranks


class TextCodec:
    """encode(text) -> little-endian unsigned 32-bit ids, for vocabularies whose tokens hold the
    white space too: a text goes through the merges as a whole."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, tokens: dict[str, int]):
        import tiktoken

        self.coding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=tokens)
        self.find, self.tokens, self.cut = regex.compile(pattern).findall, tokens, _cutter(tokens)

    def encode_column(self, column: pa.Array) -> list[bytes]:
        return [self.encode(t or "") for t in column.to_pylist()]

    def encode(self, text: str) -> bytes:
        try:
            return self.coding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:  # its search gives up on very long runs of white space
            out = array("I")
            for i, part in enumerate(self.cut(text)):
                if i % 2:
                    out.append(self.tokens[part])
                else:
                    for piece in self.find(part):
                        out.extend(self.coding._encode_single_piece(piece))
            return out.tobytes()


class WordCodec:
    """encode(text) -> little-endian unsigned 32-bit ids, for vocabularies that mark the end of a word and
    drop white space. A text is cut at spaces, which no token of the file spans; the ids of
    recent chunks are kept in a table of bounded size. encode_column does the same for many texts:
    each distinct chunk of theirs is encoded once, those of plain letters all in one call.

    Chunks that hold code points without a character go to the library itself (whole): the
    classes of such points differ from one regular expression engine to the next."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, tokens: dict[str, int], normalize: Callable[[str], str] | None, lower: bool, whole: Callable[[str], list[int]], limit: int = 250_000):
        import tiktoken

        self.coding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.find, self.normalize, self.lower = regex.compile(pattern).findall, normalize, lower
        self.tokens, self.cut, self.mark = tokens, _cutter(tokens), os.path.commonprefix([*tokens])
        self.words, self.known, self.whole = Memo(self._word, 100_000), Memo(self._chunk, limit), whole
        # With another mark for the end of a word, one that a text may hold but a plain word doesn't.
        marked = {k[: -len(_WORD_END)] + _MARK.encode() if k.endswith(_WORD_END) else k: v for k, v in ranks.items() if k != _MARK.encode()}
        self.row = tiktoken.Encoding("row", pat_str=rf"[^{_MARK}]+{_MARK}", mergeable_ranks=marked, special_tokens={})
        self.ends = np.zeros(max(marked.values()) + 1, bool)
        self.ends[[v for k, v in marked.items() if k.endswith(_MARK.encode())]] = True

    def _word(self, word: str) -> bytes:
        return array("I", self.coding._encode_single_piece(word.encode() + _WORD_END)).tobytes()

    def _pieces(self, part: str) -> bytes:
        if self.normalize is not None:
            part = part.lower() if self.lower and (part.isascii() or max(part) < "\u0250") else self.normalize(part)
        if part.isalpha():
            return self.words[part]
        if part[-1:] in _STOPS and part[:-1].isalpha():
            return self.words[part[:-1]] + self.words[part[-1]]
        return b"".join([self.words[w] for w in self.find(part)])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and any(unicodedata.category(c) in ("Cn", "Co") for c in chunk):
            return array("I", self.whole(chunk)).tobytes()
        if self.tokens and self.mark in chunk:
            return b"".join([array("I", [self.tokens[x]]).tobytes() if i % 2 else self._pieces(x) for i, x in enumerate(self.cut(chunk))])
        return self._pieces(chunk)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, text.split(" ")))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """encode of each text; null is empty."""
        if not len(column):
            return []
        split = pc.split_pattern(pc.fill_null(column, ""), " ")
        chunks = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()).dictionary_encode()
        coded = self._distinct(chunks.dictionary)
        # As many bytes as 2^31 at most: a task gets a few MB of text at a time, or one longer text.
        data, at = raw_bytes(coded.take(chunks.indices))
        bounds = at[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _distinct(self, chunks: pa.Array) -> pa.Array:
        """The ids of each of some distinct chunks, as bytes."""
        plain = pc.match_substring_regex(chunks, _PLAIN) if self.lower or self.normalize is None else pa.array(np.zeros(len(chunks), bool))
        if self.tokens:
            plain = pc.and_(plain, pc.invert(pc.match_substring(chunks, self.mark)))
        plain = plain.to_numpy(zero_copy_only=False)
        letters = chunks.filter(pa.array(plain))
        ids, cuts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(letters):
            stops = pc.match_substring_regex(letters, _STOPPED).to_numpy(zero_copy_only=False)
            if self.lower:
                letters = pc.utf8_lower(letters)
            pieces = pc.replace_substring_regex(letters, "^(.*[^,.;:!?])([,.;:!?]?)$", f"\\1{_MARK}\\2")
            pieces = pc.binary_join_element_wise(pieces, pc.if_else(pa.array(stops), _MARK, ""), "")
            text = raw_bytes(pieces)[0].decode()
            ids = self.row.encode_to_numpy(text).astype(np.uint32, copy=False)
            # The last piece of each chunk ends it.
            cuts = (np.flatnonzero(self.ends[ids]) + 1)[np.cumsum(1 + stops) - 1]
        get = self.known.__getitem__
        rest = [get(c) for c in chunks.filter(pa.array(~plain)).to_pylist()]
        made = pa.Array.from_buffers(pa.large_binary(), int(plain.sum()), [None, pa.py_buffer(np.append(0, 4 * cuts).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])
        both = pa.concat_arrays([made, pa.array(rest, pa.large_binary())])
        order = np.empty(len(chunks), np.int64)
        order[np.flatnonzero(plain)] = np.arange(plain.sum())
        order[np.flatnonzero(~plain)] = np.arange(plain.sum(), len(chunks))
        return both.take(pa.array(order))


def _cutter(tokens: dict[str, int]) -> Callable[[str], list[str]]:
    """Cuts a text at the strings of added tokens: every second part is one. At one place the longest counts."""
    if not tokens:
        return lambda text: [text]
    return re.compile("(" + "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + ")").split


def library_codec(path: str, default_pattern: str, added: bool = True) -> TextCodec | WordCodec:
    """For byte-level BPE files of the tokenizers library: the ids that its encode gives.

    The file's vocabulary and merges go to tiktoken's merging routine, several times as fast;
    the library's own normaliser is used, and the file's pattern or the default one.
    added: as in the library's encode, an added token's string in a text is that token; otherwise
    (its encode_special_tokens) it is ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    split = [s for s in steps if s["type"] == "Split"]
    if steps[-1]["type"] != "ByteLevel" or steps[-1]["add_prefix_space"] or any(not s["invert"] or s["behavior"] != "Removed" for s in split) or len(split) > 1:
        raise ValueError("the file's pre-tokenizer isn't of a known kind")
    for t in spec["added_tokens"]:
        if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] or re.search(r"\s", t["content"]):
            raise ValueError("one of the file's added tokens isn't of a known kind")
    tokens = {t["content"]: t["id"] for t in spec["added_tokens"]} if added else {}
    ranks, ends = _ranks(spec["model"]), bool(spec["model"]["end_of_word_suffix"])
    if bool(split) != ends or not ends and spec["normalizer"]:
        raise ValueError("the file's normaliser isn't of a known kind")
    if not ends:
        return TextCodec(ranks, default_pattern, tokens)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = not added
    normalizer = library.normalizer
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    # Of a chunk of letters that are all composed these three are lower case, but for white space, which is dropped.
    return WordCodec(ranks, split[0]["pattern"]["Regex"], tokens, normalizer and normalizer.normalize_str, kinds == ["NFC", "Replace", "Lowercase"], lambda chunk: library.encode(chunk, add_special_tokens=False).ids)


@lru_cache(maxsize=4)
def cached_library_codec(path: str, default_pattern: str, added: bool = True) -> TextCodec | WordCodec:
    """One per worker process."""
    spare_collector()
    return library_codec(path, default_pattern, added)
