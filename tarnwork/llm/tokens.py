"""Byte-level BPE ids from a public vocabulary file.

Both public libraries give the same ids for the same vocabulary; the rank file's reader is several times faster than
the JSON file's on words it has not met, so it is the one used here. A test holds the two against each other.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

END_OF_TEXT = 50256
#: The strings that the JSON vocabulary has an id of their own for.
SPECIAL = {"<|endoftext|>": END_OF_TEXT}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = True) -> Callable[[str], list[int]]:
    """A function from a text to its list of ids.

    ``special``: the strings of special tokens in a text get the tokens' ids, as the JSON vocabulary's own reader has
    it. Without it they are ordinary text, so that no text holds such an id.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    found = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    quick = found.encode_ordinary if not special else lambda text: found.encode(text, allowed_special="all")

    def whole(text: str) -> list[int]:
        try:
            return quick(text)
        except ValueError:  # runs of a hundred thousand spaces and more are beyond the reader's own splitting
            return _by_words(found, text, special)

    return whole


def _by_words(found, text: str, special: bool) -> list[int]:
    """The same ids, with the text split into words here."""
    import regex

    ids: list[int] = []
    parts = regex.split("(" + "|".join(map(regex.escape, SPECIAL)) + ")", text) if special else [text]
    for i, part in enumerate(parts):
        if i % 2:
            ids.append(SPECIAL[part])
            continue
        for word in regex.finditer(found._pat_str, part):
            ids += found._encode_single_piece(word[0])
    return ids
