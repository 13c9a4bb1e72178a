"""Token ids of public vocabularies, loaded once in each Python worker."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters whose Unicode classes are old enough for every regex engine to agree on them; texts of others go to the library.
SETTLED = re.compile("[\x00-\x1b\x20-\x84\x86-ɏ‐-‧‰-⁞]*").fullmatch


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


@lru_cache(maxsize=4)
def _ranks(name: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class IdEncoder:
    """The ids that ``tokenizers`` gives for a byte-level vocabulary, special strings in texts included.

    Texts of settled characters take the same vocabulary's rank table, which is
    several times faster and gives the same ids; all others take the library.
    """

    def __init__(self, name: str = "byte_bpe_50k.json"):
        self.tokenizer = library(name)
        ranks = name.removesuffix(".json") + ".tiktoken"
        try:
            self.fast = _ranks(ranks)
        except (OSError, ImportError):
            self.fast = None
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or not SETTLED(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if any(s in text for s in self.special):
            found, at = [], 0
            for m in re.finditer("|".join(map(re.escape, self.special)), text):
                found += [*self.fast.encode_ordinary(text[at : m.start()]), self.special[m[0]]]
                at = m.end()
            return np.asarray(found + self.fast.encode_ordinary(text[at:]), dtype=np.uint32)
        return np.asarray(self.fast.encode_ordinary(text), dtype=np.uint32)
