"""Exact, cached encoding with the tokenizers library.

Both supported pre-tokenizers never join across a white-space boundary between two visible characters, so a
text's ids are the concatenated ids of its chunks, and a chunk seen before need not be encoded again. Texts with
white space beyond the six ASCII characters, or with one of the tokenizer's added tokens, are encoded whole. Added
tokens (such as an end-of-text mark) inside a text get their own ids, as the library gives them; ``protect`` has them
encoded as plain text instead.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

#: Characters that some library counts as white space, besides space, \\t, \\n, \\v, \\f and \\r.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
#: Words, how a tokenizer takes white space: "spaces" keeps one space before a word with it, "words" drops all.
_CONTROL = re.compile("[\x1c-\x1f]")
_CHUNKS = {"spaces": re.compile(r" ?[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+(?![^ \t\n\v\f\r])|[ \t\n\v\f\r]"), "words": re.compile(r"[^ \t\n\v\f\r]+")}
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|]*)")
#: How byte-level vocabularies write bytes: visible characters stand for themselves, others for those from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_open: dict[tuple, Encoder] = {}


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes.

    ``chunks`` is "spaces" (a byte-level vocabulary whose words take one space before them), "words" (the same,
    lower-cased, white space dropped) or "" (whole texts, right for any tokenizer). The chunk cache of a worker is
    bounded by ``cache`` entries of at most 64 characters.
    """

    def __init__(self, path: str, chunks: str, cache: int = 1_200_000, protect: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = protect
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lead = os.path.commonprefix(added)  # every text that lacks it is free of added tokens
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.lead = "" if self.lead.lower() != self.lead.upper() else self.lead
        self.chunks, self.limit, self.known, self.lower = _CHUNKS.get(chunks), cache, {}, chunks == "words"

    def _ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 64):
            out += [_bytes(e.ids) for e in self.tokenizer.encode_batch(texts[i : i + 64], add_special_tokens=False)]
        return out

    def _learn(self, new: list[str]) -> None:
        """Add the ids of unseen chunks to the cache.

        Latin letters with plain punctuation behind them, if any, are what either pre-tokenizer makes one or two
        pieces of; these go to the tokenizer's model directly, which saves its normalisation and bookkeeping.
        """
        known, rest, model = self.known, [], self.tokenizer.model
        for p in new:
            m = _PLAIN.fullmatch(p)
            if m is None:
                rest.append(p)
                continue
            word, tail = m.groups()
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._piece(model, word)
            if tail:
                end = known.get(tail)
                if end is None:
                    end = known[tail] = self._piece(model, tail)
                known[p] = ids + end
        if rest:
            known.update(zip(rest, self._ids(rest), strict=True))

    def _piece(self, model, piece: str) -> bytes:
        if self.lower:
            piece = piece.lower()
        return _bytes([t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(_VISIBLE))])

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))

    def encode_many(self, texts: Iterable[str | None], slice_chars: int = 1 << 18) -> Iterator[bytes]:
        """The ids of each text, in order; null counts as empty. Works on slices of texts together."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= slice_chars:
                yield from self._slice(held)
                held, size = [], 0
        yield from self._slice(held)

    def _slice(self, texts: list[str]) -> Iterator[bytes]:
        if self.chunks is None:
            yield from self._ids(texts) if texts else ()
            return
        whole = [bool((_CONTROL if t.isascii() else _ODD).search(t)) or self.lead in t and bool(self.added.search(t)) for t in texts]
        pieces = [[] if w else self.chunks.findall(t) for t, w in zip(texts, whole, strict=True)]
        distinct = set().union(*pieces)
        new = list(distinct.difference(self.known))
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(distinct)
        known = self.known
        self._learn(new)
        for text, w, own in zip(texts, whole, pieces, strict=True):
            yield self._ids([text])[0] if w else b"".join(map(known.__getitem__, own))
        for p in new:
            if len(p) > 64:
                known.pop(p, None)


def encoder(path: str, chunks: str, cache: int = 1_200_000, protect: bool = False) -> Encoder:
    """The worker's encoder of a vocabulary file; opened once a process. An entry of its cache takes about 200 bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, chunks, protect)
    if key not in _open:
        _open[key] = Encoder(path, chunks, cache, protect)
    return _open[key]


def id_bytes(path: str) -> int:
    """Bytes that hold any id of a vocabulary file: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab().values(), default=0) < 1 << 16 else 4


def public_path(name: str) -> str:
    """Where the public vocabulary files of this machine lie."""
    import public_tokenizers

    return public_tokenizers.path(name)
