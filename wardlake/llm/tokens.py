"""Token ids of whole texts for a tokenizer file, as its library gives them.

A byte-level BPE file (.json) whose ids are its merge ranks is run by the faster of the two
libraries that read it; that both agree is checked on probes when the file is opened, and by
``tests/llm`` on whole tables. Texts that hold a special string or a very long run of blanks,
and all other files, go to the file's own library.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np

#: How byte-level files split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The faster library's split goes back over a run of blanks and fails from about a million on.
BLANK_RUN = re.compile(r"\s{100000}")
PROBES = ("", " ", "a", "it's  DON'T\n\n x", "Größe 123,45 — naïve\t 　ok", "日本語 🙂")


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _visible_bytes() -> dict[str, int]:
    """Byte-level files write printable Latin-1 as itself and the other bytes from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``encode(text)`` gives the ids of a whole text as an array of unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.specials: list[str] = []
        self.ranks = None
        if path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            self._compile(json.load(f))

    def _compile(self, spec: dict) -> None:
        pre = spec.get("pre_tokenizer") or {}
        if (spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel"
                or not pre.get("use_regex") or pre.get("add_prefix_space")
                or spec.get("normalizer")):
            return
        import tiktoken

        of = _visible_bytes()
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        ranks = {bytes(of[c] for c in word): i for word, i in spec["model"]["vocab"].items()
                 if word not in self.specials}
        own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        if all(own.encode_ordinary(p) == self._by_library(p) for p in PROBES):
            self.ranks = own

    def _by_library(self, text: str) -> list[int]:
        if hasattr(self.library, "encode_as_ids"):
            return self.library.encode_as_ids(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        if (self.ranks is None or any(s in text for s in self.specials)
                or BLANK_RUN.search(text)):
            return np.array(self._by_library(text), "<u4")
        try:
            return self.ranks.encode_to_numpy(text).astype("<u4", copy=False)
        except ValueError:  # its splitter gave up
            return np.array(self._by_library(text), "<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
