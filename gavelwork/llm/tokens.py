"""Token ids of texts as raw bytes, exactly as the tokenizers library gives them.

A tokenizer that drops white space and splits words before its merges encodes every run of
non-space characters on its own, and runs of plain Latin text by pieces of letters, digits and
symbols. Texts are split a few megabytes at a time, each distinct run is encoded once and kept
in a bounded cache, and the ids of the texts are put together from those of their runs. For
tokenizers that ``check_split`` does not know, whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import pyarrow as pa

from gavelwork.llm.words import Cache, split

#: Pieces whose ids a worker process keeps.
CACHE_ENTRIES = 300_000

# Characters for which lower-casing is one to one, composition changes nothing and the classes are fixed.
_PLAIN = re.compile("[!-~¡-įı-ȳ]+")
_PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ȳ]+"
    "|[0-9²³¹¼-¾]"
    "|[^a-zªµºÀ-ÖØ-öø-ȳ0-9²³¹¼-¾]+"
)
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of texts under one tokenizer file; ``dtype`` is the narrowest that holds every id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_run = check_split(path)
        self.pieces, self.others = Cache(self._piece, CACHE_ENTRIES), Cache(self._whole, CACHE_ENTRIES // 8)

        self.form = {2: "<%dH", 4: "<%dI"}[self.dtype.itemsize]
        if self.by_run:
            from tokenizers.pre_tokenizers import ByteLevel

            level = ByteLevel(add_prefix_space=False, use_regex=False)
            plain = [c for c in map(chr, range(0x234)) if _PLAIN.fullmatch(c) and not c.isspace()]
            self.shown = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in plain})

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(self.form % len(ids), *ids)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of plain characters: only the merges are left to do."""
        if not piece.isascii():
            piece = piece.translate(self.shown)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(self.form % len(ids), *ids)

    def _run(self, run: str) -> bytes:
        if run.isascii():  # most runs are a word or a word and one mark
            if run.isalpha():
                return self.pieces[run.lower()]
            if run[:-1].isalpha() and run[-1] in ".,;:!?":
                return self.pieces[run[:-1].lower()] + self.pieces[run[-1]]
        if "<|" in run or not _PLAIN.fullmatch(run):
            return self.others[run]
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(run.lower())))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts: bounds of each text and all ids one after another."""
        if not self.by_run:
            parts = [self._whole(t) if t else b"" for t in texts.to_pylist()]
            bounds = np.cumsum([0, *map(len, parts)]) // self.dtype.itemsize
            return bounds, np.frombuffer(b"".join(parts), self.dtype)
        bounds, codes, words = split(texts)
        parts = [self._run(w) for w in words]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        starts = np.cumsum(lengths) - lengths
        each = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(starts[codes] - ends[:-1], each) + np.arange(ends[-1])
        return ends[bounds], np.frombuffer(b"".join(parts), self.dtype)[at]


def check_split(path: str) -> bool:
    """True if the tokenizer file lower-cases, drops white space and splits as assumed here."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normal = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    plain = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"])
    return (
        normal == ["NFC", "Replace", "Lowercase"]
        and first.get("pattern", {}).get("Regex") == _SPLIT and first.get("invert") is True
        and first.get("behavior") == "Removed" and plain
        and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        and not spec.get("truncation") and not spec.get("post_processor")
    )


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; its caches serve all tasks that run in it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
