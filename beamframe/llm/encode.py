"""Token ids of a public byte-level BPE vocabulary, many texts at a time.

``tokenizers`` defines the ids. Where its vocabulary ranks merges by id (checked
when it is loaded), the same merges run in ``tiktoken``, which takes a third of the
time. Texts that could be split differently there (characters from U+0600 on, whose
Unicode classes vary between versions, or the special token's string) and texts
with runs of spaces that its regex engine refuses go through ``tokenizers``.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pyarrow as pa

from beamframe.llm.common import raw

#: How byte-level BPE splits a text before merging. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The first UTF-8 byte of U+0600.
LATER = 0xD8


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable bytes are themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.special = [t["content"] for t in held["added_tokens"]]
        self.fast = None
        vocab = {k: v for k, v in held["model"]["vocab"].items() if k not in self.special}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in held["model"]["merges"]]
        if held["normalizer"] is None and held["pre_tokenizer"]["type"] == "ByteLevel" and [vocab.get(m) for m in merges] == list(range(256, 256 + len(merges))) and len(vocab) == 256 + len(merges):
            import tiktoken

            letters = _byte_letters()
            self.fast = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks={bytes(letters[c] for c in k): v for k, v in vocab.items()}, special_tokens={})

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        data, off = raw(texts)
        late = np.zeros(len(off) - 1, bool)
        late[np.searchsorted(off, np.flatnonzero(data >= LATER), side="right") - 1] = True
        out = []
        for t, other in zip(texts.to_pylist(), late.tolist(), strict=True):
            t = t or ""
            ids = None
            if not (other or self.fast is None or any(s in t for s in self.special)):
                try:
                    ids = self.fast.encode_to_numpy(t, disallowed_special=())
                except ValueError:  # "Max stack size exceeded" on a run of about a million spaces
                    ids = None
            out.append(np.array(self.slow.encode(t, add_special_tokens=False).ids, np.uint32) if ids is None else ids)
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each worker process: functions are unpickled anew for each task, ``sys`` stays."""
    held = sys.__dict__.setdefault("_token_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
