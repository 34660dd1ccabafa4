"""Token ids of whole texts with a public byte-level BPE vocabulary.

The ids are those of the ``tokenizers`` file; the rank file of the same
vocabulary gives them several times faster, and a text that holds a special token
or that its regex engine refuses goes through ``tokenizers``. Vocabulary files are read on each worker,
where they are installed, and kept for its life; they are a parameter.
"""

from __future__ import annotations

import base64
import functools

import numpy as np

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Ends each document.
END = 1


@functools.cache
def rank_encoder(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def json_encoder(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def special(name: str) -> tuple[str, ...]:
    """Texts that the file names as tokens of their own."""
    return tuple(t.content for t in json_encoder(name).get_added_tokens_decoder().values())


def plain_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids straight from ``tokenizers``."""
    return np.array(json_encoder(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)


def ids(text: str, vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> np.ndarray:
    """Ids of a text and the ending id, as little-endian unsigned 32-bit numbers."""
    if ranks is None or any(t in text for t in special(vocabulary)):
        found = plain_ids(text, vocabulary)
    else:
        try:
            found = np.array(rank_encoder(ranks).encode_ordinary(text), np.uint32)
        except BaseException as e:  # the regex engine's panic is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            found = plain_ids(text, vocabulary)
    return np.append(found, np.uint32(END)).astype("<u4")
