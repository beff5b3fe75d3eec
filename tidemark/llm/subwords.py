"""Public tokenizers inside tasks: loading, and encoding of whole texts."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc

#: Characters encoded at once, about.
BLOCK_CHARS = 1 << 15

_CUT = re.compile(r"\S[ \n](?=\S)")
_BEYOND = re.compile("[^\x00-\u024f]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizers library's object for a .json file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=4)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def blocks(text: str, chars: int = BLOCK_CHARS) -> Iterator[str]:
    """A text cut before single spaces and line feeds between two characters that are no white space, every ``chars`` characters or so.

    Byte-level vocabularies cut there whatever stands around: no word pattern holds white
    space after another character, and a single white space before a word never joins the
    text before it. Encoding the blocks one by one gives the ids of the whole text.
    """
    at = 0
    while len(text) - at > chars and (cut := _CUT.search(text, at + chars)):
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The ranks of a plain byte-level .json vocabulary whose merges stand in the order of their ids; None for any other."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    model, cut = given["model"], given["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and not given["normalizer"] and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges"))
    if not plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
        return None
    vocabulary, alphabet = model["vocab"], byte_alphabet()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary[x + y] for x, y in pairs]
    if sorted(made) != made or len(vocabulary) != len(made) + 256 or set("".join(vocabulary)) - set(alphabet):
        return None
    return {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items()}


class TextEncoder:
    """Token ids of whole texts by a byte-level .json vocabulary, as the tokenizers library gives them.

    Blocks of characters up to U+024F, which every Unicode version puts in the same classes, are encoded from
    the vocabulary's ranks, several times faster; the library encodes the others, and all of a text that holds
    one of its special strings.
    """

    def __init__(self, path: str):
        self._library = tokenizer(path)
        special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        ranks = byte_ranks(path)
        self._fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            self._fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> list[int]:
        return self._library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self._fast is None or (self._special and self._special.search(text)):
            return self._whole(text)
        out: list[int] = []
        for block in blocks(text):
            # a longer block has no place to cut, such as one endless word
            plain = len(block) <= 2 * BLOCK_CHARS and (block.isascii() or not _BEYOND.search(block))
            found = self._fast.encode_ordinary(block) if plain else self._whole(block)
            out += found
        return out


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder for all tasks of a worker."""
    return TextEncoder(path)


def slices(texts: pa.Array, chars: int):
    """A column of texts in consecutive parts of about ``chars`` bytes, one text at least: (begin, end, texts), null as empty.

    Only one part at a time is turned into Python strings.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin, held = 0, 0
    for i, size in enumerate([*sizes, chars]):
        if i > begin and (held + size > chars or i == len(sizes)):
            yield begin, i, [t or "" for t in texts.slice(begin, i - begin).to_pylist()]
            begin, held = i, 0
        held += size
