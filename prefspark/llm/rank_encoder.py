"""Ids of a byte-level BPE file of the ``tokenizers`` library, by ``tiktoken`` wherever both agree.

Both libraries split a text by one pattern and merge each piece. They agree on a text if

- the file is plain byte-level BPE: no normaliser, no added space, merges in the order of their
  tokens' ids, and each token is what its own bytes are merged to. Then a pair of parts that
  spells a token is that token's own merge: what lies inside the token's span was merged as
  if the token stood alone.
- both regular-expression engines put each of its characters in the same class of the pattern
  (letter, number, white space, other). Each character that is met is put to both, once.
- it holds no added token's string, unless those are ordinary text.

Any other text goes through ``tokenizers`` whole.
"""

from __future__ import annotations

import functools
import json as jsonlib
import re
from collections.abc import Iterable

import numpy as np
import public_tokenizers

LONGEST_RUN = 50_000  # characters of white space, or without any, that the faster library is given


def byte_alphabet() -> dict[str, int]:
    """Byte of each character that stands for one in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}


def vocabulary(json: str) -> list[bytes | None]:
    """Bytes of each id of a byte-level file; None for added tokens and gaps."""
    model = jsonlib.loads(json)["model"]["vocab"]
    alphabet = byte_alphabet()
    out: list[bytes | None] = [None] * (1 + max(model.values()))
    for token, i in model.items():
        if all(c in alphabet for c in token):
            out[i] = bytes(map(alphabet.__getitem__, token))
    return out


def is_plain(json: str) -> bool:
    """Whether the two libraries merge alike by this file; a second's work, done on the driver."""
    from tokenizers import Tokenizer

    spec = jsonlib.loads(json)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return False
    vocab, alphabet = model["vocab"], byte_alphabet()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    added = {t["content"] for t in spec.get("added_tokens", [])}
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or not set(alphabet) <= set(vocab):
        return False
    if len(vocab.keys() - added) != 256 + len(merges):
        return False
    merged = Tokenizer.from_str(json).model
    return all([t.id for t in merged.tokenize(a + b)] == [i] for (a, b), i in zip(merges, made, strict=True))


class RankEncoder:
    """Encoder of one file; ``plain`` says that ``is_plain`` holds, ``specials_as_text`` that added tokens' strings are ordinary text."""

    def __init__(self, json: str, plain: bool, specials_as_text: bool):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(json)
        self.library.encode_special_tokens = specials_as_text
        self.n_ids = self.library.get_vocab_size(with_added_tokens=True)
        self.added = [] if specials_as_text else [t["content"] for t in jsonlib.loads(json).get("added_tokens", [])]
        # With specials as text, only a token that isn't special is still cut out of texts.
        self.added += [t["content"] for t in jsonlib.loads(json).get("added_tokens", []) if specials_as_text and not t.get("special")]
        self.plain = plain
        self.alike: set[str] = set()
        self.unlike: set[str] = set()
        if plain:
            ranks = {b: i for i, b in enumerate(vocabulary(json)) if b is not None}
            ranks = {b: i for b, i in ranks.items() if b.decode("utf-8", "replace") not in self.added}
            self.ranks = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            single = {bytes([b]): b for b in range(256)}
            self.classes = [tiktoken.Encoding("class", pat_str=p, mergeable_ranks=single, special_tokens={}) for p in (r"\p{L}", r"\p{N}", r"\s")]

    def _class_here(self, c: str) -> int:
        """Class of a character by what the split of ``tokenizers`` joins it to."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        return next((k for k, other in enumerate(("a", "1")) if len(split(other + c)) == 1), 3 if len(split("!" + c)) == 1 else 2)

    def _class_there(self, c: str) -> int:
        return next((k for k, enc in enumerate(self.classes) if enc.encode_ordinary(c)), 3)

    def _agrees(self, text: str) -> bool:
        if any(token in text for token in self.added):
            return False
        met = set(text)
        for c in met - self.alike - self.unlike:
            (self.alike if self._class_here(c) == self._class_there(c) else self.unlike).add(c)
        return met.isdisjoint(self.unlike)

    def _short_runs(self, text: str) -> bool:
        """Whether no run of white space or of anything else is so long that a pattern's engine might give up on it."""
        return len(text) <= LONGEST_RUN or max(m.end() - m.start() for m in re.finditer(r"\s+|\S+", text)) <= LONGEST_RUN

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        out = []
        for text in texts:
            if self.plain and self._short_runs(text) and self._agrees(text):
                out.append(self.ranks.encode_to_numpy(text, disallowed_special=()))
            else:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
        return out


@functools.lru_cache(maxsize=2)
def encoder(json: str, plain: bool, specials_as_text: bool) -> RankEncoder:
    """The Python worker's encoder; what it has learned serves the worker's later tasks, too."""
    return RankEncoder(json, plain, specials_as_text)
