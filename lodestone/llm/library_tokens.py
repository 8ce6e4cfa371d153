"""Encoding with the ``tokenizers`` library, piece by piece where that is exact.

Some vocabularies drop all white space before they cut a text into words; then
the ids of a text are those of its pieces between white space end to end, and a
worker has the library encode each distinct piece once (``pieces``). With other
vocabularies the library encodes each text whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .pieces import PieceMemo
from .words import Block


#: Pieces that a worker keeps, at most; the library is slower than the look-up in memory.
MAX_PIECES = 3_000_000


def drops_space(path: str) -> bool:
    """Whether the vocabulary's words never span white space and white space itself is removed."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    collapses = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
    words_only = bool(cuts) and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
    no_space_added = not any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
    return collapses and words_only and no_space_added and r"[^\s" in cuts[0].get("pattern", {}).get("Regex", "")


class LibraryEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = PieceMemo(self.library, MAX_PIECES) if drops_space(path) else None

    def library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, ids of each row)."""
        if self.memo is not None:
            return self.memo.encode(block)
        raw, at = block.data.tobytes(), block.offsets.tolist()
        encoded = self.library([raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])])
        return np.frombuffer(b"".join(encoded), "<u4"), np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """This worker's encoder for the vocabulary file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]
