"""Public tokenizers, and fast paths that give the same ids and pieces.

A text takes a fast path only if all its characters are in a set for which
the equality is plain (printable ASCII, common white space and precomposed
Latin-1 letters) and it holds no special token's string; every other text
goes through the ``tokenizers`` library itself.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

#: Where the files are; None: the installed ``public_tokenizers``.
DEFAULT_DIR: str | None = None

PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")


def path(name: str, folder: str | None = DEFAULT_DIR) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def library(name: str, folder: str | None = DEFAULT_DIR):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(name, folder))
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=8)
def specials(name: str, folder: str | None = DEFAULT_DIR) -> tuple[str, ...]:
    return tuple(t.content for t in library(name, folder).get_added_tokens_decoder().values())


@lru_cache(maxsize=8)
def ranks(name: str, folder: str | None = DEFAULT_DIR):
    """The byte-level vocabulary of ``name`` (.json) by its table of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path(name.replace(".json", ".tiktoken"), folder)) as f:
        table = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def id_bytes(text: str, name: str = "byte_bpe_50k.json", folder: str | None = DEFAULT_DIR) -> bytes:
    """Ids of a whole text, little-endian unsigned 32-bit."""
    if PLAIN.fullmatch(text) and not any(s in text for s in specials(name, folder)):
        return bytes(ranks(name, folder)._core_bpe.encode_to_tiktoken_buffer(text, set()))
    import numpy as np

    return np.array(library(name, folder).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


#: The word-level pre-tokens of word_bpe_49k.json, for plain text only.
WORD_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def pre_tokens(text: str, name: str = "word_bpe_49k.json", folder: str | None = DEFAULT_DIR) -> list[str]:
    """Pre-tokens of a whole text, before mapping to byte letters; special
    tokens come as their own strings."""
    special = [s for s in specials(name, folder) if s in text]
    if not special and PLAIN.fullmatch(text):
        return WORD_PIECES.findall(text.lower())
    tok = library(name, folder)
    out: list[str] = []
    parts = re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]
    for part in parts:
        if part in special:
            out.append(part)
        elif part:
            clean = tok.normalizer.normalize_str(part)
            out += [clean[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(clean)]
    return out


def piece_counts(pre: list[str], name: str = "word_bpe_49k.json", folder: str | None = DEFAULT_DIR) -> list[int]:
    """Pieces of each pre-token."""
    tok = library(name, folder)
    out: list[int] = []
    for at in range(0, len(pre), 4096):
        out += [len(e) for e in tok.encode_batch(pre[at : at + 4096], add_special_tokens=False)]
    return out
