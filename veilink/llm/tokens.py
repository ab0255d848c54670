"""Token ids of whole texts, as the ``tokenizers`` library gives them for a byte-level BPE file.

Texts in plain Latin script go through ``tiktoken`` over the same vocabulary, which is several times faster and
gives the same ids; all other texts, whose white space or letter classes the two libraries' Unicode tables might
see differently, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np

#: Texts with other characters than these are left to ``tokenizers``.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")


class ByteBpe:
    """``encode`` one text to uint32 ids; ``path`` is a tokenizers JSON file."""

    def __init__(self, path: str):
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.exact = tokenizers.Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = None
        if pre and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"] and not spec["post_processor"]:
            self.fast = _same_ranks(spec["model"]["vocab"], set(self.special))

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _same_ranks(vocab: dict[str, int], special: set[str]):
    """A tiktoken encoder whose ranks are this vocabulary's ids, or None where ids aren't ranks of merges."""
    import public_tokenizers
    import tiktoken

    ranks_file = os.path.join(os.path.dirname(public_tokenizers.path("byte_bpe_50k.json")), "byte_bpe_50k.tiktoken")
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    table = byte_letters()
    if {"".join(table[b] for b in piece): i for piece, i in ranks.items()} != {p: i for p, i in vocab.items() if p not in special}:
        return None
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 as itself, others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
