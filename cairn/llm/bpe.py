"""Token ids of public tokenizers, for Arrow arrays of texts.

The ids are those of the ``tokenizers`` library. Texts of plain letters, digits and signs with single
white space are cut into the pre-tokenizer's pieces by byte class in numpy; each distinct piece of a
block is looked up once, and the library's model encodes the pieces that a worker has not met yet. Any
other text, and any that holds one of the vocabulary's added tokens, goes to the library.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .wordvec import LOWER, piece_hashes, text_bytes

#: Texts that the byte classes do not cover: other characters than ASCII and the precomposed letters up
#: to U+024F, quotes (contractions), and control characters.
_ODD = "[^\\t\\n\\r\\x20-\\x26\\x28-\\x7e\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{132}-\\x{13e}\\x{141}-\\x{148}\\x{14a}-\\x{17e}\\x{180}-\\x{1c3}\\x{1cd}-\\x{1f0}\\x{1f4}-\\x{24f}]"
_DOUBLE = "[\\t\\n\\r ][\\t\\n\\r ]"
SPACE, OTHER_SPACE, LETTER, DIGIT, SIGN = range(1, 6)
_CLASS = np.full(256, SIGN, np.uint8)
_CLASS[32] = SPACE
_CLASS[[9, 10, 13]] = OTHER_SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
_CLASS[48:58] = DIGIT
#: Pieces kept for each worker.
KEPT = 300_000
#: Bytes handled at once.
BLOCK = 2 << 20


#: Longer texts are encoded in parts of about so many characters.
LONG = 2 << 20
#: A letter or digit of any script before white space or a sign: a piece always begins after it.
_GAP = re.compile(r"[^\W_](?=[ \t\n\r.,;:!?()\u3001\u3002\uff0c\uff01\uff1f\uff1a\uff1b])")


def cut_long(text: str) -> list[str]:
    """Parts that begin where every vocabulary's pre-tokenizer begins a piece; only a run of letters without an end stays whole."""
    out, at = [], 0
    while len(text) - at > LONG:
        m = _GAP.search(text, at + LONG)
        if not m or m.end() == len(text):
            break
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def tokenizer_path(name: str) -> str:
    """Path of a vocabulary file; the folder is the parameter CAIRN_TOKENIZERS or the installed package's."""
    folder = os.environ.get("CAIRN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level models use for bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """words: the vocabulary's pre-tokenizer drops white space, lower-cases, and takes digits one by one."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.model._resize_cache(0)  # pieces are kept here instead
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = f"(?i){'|'.join(added)}" if added else None
        self.words = name.startswith("word_")
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts, by the library alone."""
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in made]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pieces; those not kept are encoded by the library's model."""
        got = list(map(self.known.get, pieces))
        new = [i for i, g in enumerate(got) if g is None]
        if len(self.known) + len(new) > KEPT:  # the pieces met first are the frequent ones
            self.known = dict(islice(self.known.items(), KEPT // 2))
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for i in new:
            text = pieces[i].decode().lower().encode() if self.words else pieces[i]
            made = tokenize(text.decode("latin-1").translate(letters))
            self.known[pieces[i]] = got[i] = struct.pack(f"<{len(made)}I", *[t.id for t in made])
        return got

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without odd characters or double white space, and where each text's begin, with the end."""
        data, off = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        kind = _CLASS[data]
        start = np.empty(len(data), bool)
        start[0] = True
        begin = off[:-1][np.diff(off) > 0]
        if self.words:
            np.not_equal(kind[1:], kind[:-1], out=start[1:])
            start |= kind == DIGIT
            start[begin] = True
            start &= kind > OTHER_SPACE
            data = LOWER[data]
            piece = kind > OTHER_SPACE
        else:
            np.not_equal(kind[1:], kind[:-1], out=start[1:])
            start[1:] &= kind[:-1] != SPACE
            start |= kind <= OTHER_SPACE
            start[begin] = True
            piece = None
        starts = np.flatnonzero(start)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        ends = np.append(starts[1:], len(data))
        if self.words:  # white space after a piece is not part of it
            ends -= kind[ends - 1] <= OTHER_SPACE
        h = piece_hashes(data, starts, piece)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        coded = self._pieces([raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())])
        size = np.array([len(c) for c in coded]) // 4
        ids = np.frombuffer(b"".join(coded), "<u4")
        at = np.cumsum(size) - size
        n = size[which]
        done = np.cumsum(n)
        place = np.arange(done[-1]) + np.repeat(at[which] - (done - n), n)
        total = np.append(0, done)
        return ids[place], total[np.searchsorted(starts, off)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text; a null is an empty text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        long = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 2 * LONG)
        if len(long):  # cut where any pre-tokenizer parts words, so that memory does not follow the text
            parts = [cut_long(t) if len(t) > LONG else [t] for t in texts.to_pylist()]
            coded = iter([ids for t in parts for i in range(0, len(t), 8) for ids in self._encode(pa.array(t[i : i + 8], pa.large_string()))])
            return [b"".join(next(coded) for _ in t) for t in parts]
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> list[bytes]:
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.match_substring_regex(texts, _DOUBLE))
        if self.added:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.added))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        if odd.any():
            rows = np.flatnonzero(odd)
            for i, ids in zip(rows.tolist(), self.library(texts.take(pa.array(rows)).to_pylist())):
                out[i] = ids
        rows = np.flatnonzero(~odd)
        size = pc.binary_length(texts).to_numpy()[rows]
        block = np.cumsum(size) // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                ids, first = self._plain(texts.take(pa.array(rows[a:b])))
                raw = ids.tobytes()
                for i, x, y in zip(rows[a:b].tolist(), first.tolist(), first[1:].tolist()):
                    out[i] = raw[4 * x : 4 * y]
        return out


_open: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if name not in _open:
        _open[name] = Encoder(name)
    return _open[name]
