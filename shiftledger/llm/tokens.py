"""Token ids of whole texts with a public tokenizer, by way of a memo of white-space separated pieces.

Both kinds of tokenizer used here split a text at white space before they merge, so the ids of a text are those of its
pieces in order; most pieces come again and again. A piece that ends with punctuation after an ASCII letter or digit
is its word and its punctuation. What cannot be cut with certainty is encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a memo holds before it starts anew: some 80 MB.
WORDS = 400_000
_SPACED = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]")
#: Texts without these have single spaces and line ends between words, and nothing else.
_RUNS = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: An optional space and letters of ASCII or Latin-1: one word to either tokenizer, and the same in composed form.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: The last byte of a word as a byte that no lowered word has elsewhere: capitals for letters, below 64 for others.
_LAST = [bytes([b - 32 if 97 <= b < 123 else b & 63 if b >= 128 else b]) for b in range(256)]
#: Longer words are left to the library, whose time grows less with their length.
_LONG = 1000
_CLOSING = ".,!?;:|#$%&*"
#: Bytes of text that are cut and assembled at once.
BATCH = 3 << 20


class _Memo(dict):
    """Bytes of ids by piece; a piece that is new is encoded."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self[piece] = self.encode(piece)
        return out


def _bytes(strings: pa.Array) -> list[bytes]:
    return strings.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def _merger(path: str, ends_words: bool):
    """A function from the bytes of a word to its ids, or none if the vocabulary does not allow it.

    tiktoken merges by the ranks of byte strings. That gives what merging by the file's pairs gives when every merge
    makes the next id, which is checked. A vocabulary with entries that end a word has each of them under the bytes of
    its word with the last one replaced, see _LAST.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    single = 512 if suffix else 256
    if made != list(range(single, single + len(made))) or bool(suffix) != ends_words:
        return None
    back = {chr(b): b for b in _SHOWN} | {chr(c): b for b, c in _BYTE_LEVEL.items()}
    ranks = {}
    for text, i in vocabulary.items():
        ends = bool(suffix) and text.endswith(suffix)
        text = text[: -len(suffix)] if ends else text
        if i >= single + len(made) or not all(c in back for c in text):
            continue
        raw = bytes(map(back.__getitem__, text))
        if ends_words:
            # other words are encoded as a whole: keep those of small letters and of bytes from 128 on
            if not all(97 <= b < 123 or b >= 128 for b in raw):
                continue
            if ends and raw[-1] >= 192:  # no character ends with such a byte
                continue
            raw = raw[:-1] + _LAST[raw[-1]] if ends else raw
        if raw in ranks:
            return None
        ranks[raw] = i
    if not all(bytes([b]) in ranks for b in ([*range(97, 123), *range(65, 91)] if ends_words else range(256))):
        return None
    return tiktoken.Encoding("ranks", pat_str="x", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Encoder:
    """ids(texts) gives the ids of each text as bytes of `kind`, little-endian."""

    def __init__(self, path: str, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            normalizer = json.load(file).get("normalizer")
        # a tokenizer that normalizes white space drops it and lowers; the other kind keeps it before the word
        self.drops_space = normalizer is not None
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1
        self.kind = np.dtype("<u2" if self.size <= 65_536 else "<u4")
        self.code = "H" if self.size <= 65_536 else "I"
        self.merged = _merger(path, self.drops_space)
        self.tokenize = self.tokenizer.model.tokenize
        self.words = _Memo(self._word, words)

    def _whole(self, piece: bytes) -> bytes:
        return array(self.code, self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids).tobytes()

    def _word(self, piece: bytes) -> bytes:
        """A single word, lowered where letters are, needs no normalizing and no cutting: the merges alone are asked for."""
        if piece.isalpha() or (piece[:1] == b" " and piece[1:].isalpha()):  # ASCII letters, lowered before
            low = piece
        elif _WORD.fullmatch(piece):
            low = piece.decode().lower().encode() if self.drops_space else piece
        else:
            return self._whole(piece)
        if self.merged is not None and len(low) < _LONG:
            word = low[:-1] + _LAST[low[-1]] if self.drops_space else low
            return array(self.code, self.merged(word)).tobytes()
        return array(self.code, [t.id for t in self.tokenize(low.decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()

    def _parts(self, pieces: pa.Array) -> list[bytes]:
        """Ids of distinct pieces."""
        low = pc.ascii_lower(pieces) if self.drops_space else pieces
        word = pc.ascii_rtrim(low, characters=_CLOSING)
        word = pc.if_else(pc.match_substring_regex(word, "[0-9A-Za-z]$"), word, low)
        distinct = word.dictionary_encode()
        known = list(map(self.words.__getitem__, _bytes(distinct.dictionary)))
        parts = [known[code] for code in distinct.indices.to_numpy().tolist()]
        sizes = pc.binary_length(word).to_numpy()
        ended = np.flatnonzero(pc.binary_length(low).to_numpy() > sizes)
        for i, size, piece in zip(ended.tolist(), sizes[ended].tolist(), _bytes(low.take(ended)), strict=True):
            parts[i] += self.words[piece[size:]]
        if self.drops_space:  # perhaps special tokens, which are not lowered
            for i in np.flatnonzero(pc.match_substring(pieces, "<|").to_numpy(zero_copy_only=False)).tolist():
                parts[i] = self._whole(pieces[i].as_py().encode())
        return parts

    def _marked(self, text: bytes) -> bytes | None:
        """The text with a mark at every place where it may be cut; none if it cannot be told."""
        if self.drops_space:
            return text
        if b"<|" in text:  # a special token ends the white space before it
            return None
        if (b"\xc2" in text or b"\xe1" in text or b"\xe2" in text or b"\xe3" in text) and _WIDE.search(text):
            return None
        if b"\0" in text:
            return None
        if any(run in text for run in _RUNS):
            return b"\0".join(_SPACED.findall(text))
        return text.replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0")

    def _assembled(self, texts: list[bytes]) -> list[bytes]:
        """Ids of marked texts: every distinct piece is looked up once, then pieces become ids by position."""
        column = pa.array(texts, pa.large_string())
        cut = pc.ascii_split_whitespace(column) if self.drops_space else pc.split_pattern(column, "\0")
        pieces = cut.flatten().dictionary_encode()
        codes = pieces.indices.to_numpy()
        parts = self._parts(pieces.dictionary)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        known = np.frombuffer(b"".join(parts), self.kind)
        length = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(length)))
        place = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], length)
        place += np.arange(len(place))
        ids = known[place].tobytes()
        bounds = (ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()] * self.kind.itemsize).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        marked, at, held = [], [], 0
        for text in texts:
            cut = self._marked(text)
            if cut is None:
                out.append(self._whole(text))
                continue
            marked.append(cut)
            at.append(len(out))
            out.append(b"")
            held += len(text)
            if held >= BATCH:
                self._fill(out, at, marked)
                marked, at, held = [], [], 0
        self._fill(out, at, marked)
        return out

    def _fill(self, out: list[bytes], at: list[int], marked: list[bytes]) -> None:
        if marked:
            for i, ids in zip(at, self._assembled(marked), strict=True):
                out[i] = ids


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """The encoder of this worker process. Its memo lasts for a task: idle workers hold none."""
    held = sys.modules.setdefault("_llm_encoders", types.ModuleType("_llm_encoders"))
    if path not in vars(held):
        setattr(held, path, Encoder(path))
    encode = vars(held)[path]
    try:
        yield encode
    finally:
        encode.words.clear()


def vocabulary_path(name: str) -> str:
    return public_tokenizers.path(name)
