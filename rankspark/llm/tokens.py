"""Token ids of the public byte-level BPE vocabulary, for packing and token counts.

tiktoken reads the same vocabulary as ranks and gives the same ids as the tokenizers file
byte_bpe_50k.json, at about four times the speed. That file's added tokens, such as
<|endoftext|>, are matched in a text as tokenizers does by default, or on request are
ordinary text.
"""

from __future__ import annotations

import base64
import json

from .common import worker_cache

VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256


def id_bytes(vocabulary: str = VOCABULARY) -> int:
    """Bytes that hold any id of the vocabulary: 2, or 4 from 65536 ids on."""
    def most():
        import public_tokenizers

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            return max(END_OF_TEXT, *(int(line.split()[1]) for line in lines))

    return 2 if worker_cache(f"most:{vocabulary}", most) < 1 << 16 else 4


def encoder(vocabulary: str = VOCABULARY, added: bool = True):
    """A function from text to the bytes of its little-endian unsigned 32-bit ids. added:
    whether the tokenizers file's added tokens are matched in the text."""

    def make():
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {}
        if added:
            with open(public_tokenizers.path(vocabulary.rsplit(".", 1)[0] + ".json"), encoding="utf-8") as file:
                special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        coding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        allowed = set(special)
        return lambda text: coding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4").tobytes()

    return worker_cache(f"encoder:{vocabulary}:{added}", make)
