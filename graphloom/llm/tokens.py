"""Whole texts to token ids with the tokenizers library, encoding each distinct space-separated piece once."""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import held

#: Pieces that a worker remembers (some 60 MB); others are encoded each time.
REMEMBERED = 250_000
#: White space other than blank and newline: a text that has any is encoded in one call.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_OTHER_SPACE_WIDE = '\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000'
#: A newline, Latin letters, and marks that are a pre-token of their own after letters.
_PLAIN = re.compile(r"(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01ba\u01bc-\u01bf\u01c4-\u024f]+)([.,!?;:#$%&*()]*)")


class _Pieces(dict):
    """Ids of pieces of texts, encoded when first asked for.

    A piece that starts with a newline stands for itself; others follow a blank. A run of Latin letters is one
    pre-token, whose ids the tokenizer's model gives at once; a newline before it and marks after it are others. All else
    goes through the whole tokenizer."""

    def __init__(self, tokenizer, keeps_space: bool, dtype: np.dtype):
        super().__init__()
        self.tokenizer, self.tokenize, self.keeps_space = tokenizer, tokenizer.model.tokenize, keeps_space
        self.pack = "H" if dtype.itemsize == 2 else "I"
        self.marks: dict[str, bytes] = {"": b""}
        # The library's byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        letters = {b: chr(256 + i) for i, b in enumerate(others)} | {b: chr(b) for b in plain}
        self.letters = "".join(letters[b] for b in range(256))

    def whole(self, text: str) -> bytes:
        return array(self.pack, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def mark(self, text: str) -> bytes:
        if text not in self.marks:
            ids = self.whole(text)
            if len(self.marks) >= 1000:
                return ids
            self.marks[text] = ids
        return self.marks[text]

    def letters_only(self, stem: str, blank: bool) -> bytes:
        if not stem.isascii():
            stem = charmap_decode(stem.encode(), "strict", self.letters)[0]
        if blank:
            stem = "\u0120" + stem
        return array(self.pack, [t.id for t in self.tokenize(stem)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        plain = (piece.isascii() and piece.isalpha()) or _PLAIN.fullmatch(piece)
        if plain is True:
            lower = piece if self.keeps_space else piece.lower()
            ids = self.letters_only(piece, True) if self.keeps_space else self[lower] if lower != piece else self.letters_only(piece, False)
        elif plain:
            newline, stem, after = plain.groups()
            if not self.keeps_space:
                newline, lower = "", stem.lower()
                ids = self.letters_only(stem, False) if lower == piece else self[lower]
            elif newline:
                ids = self.mark(newline) + self.letters_only(stem, False)
            else:
                ids = self[stem] if after else self.letters_only(stem, True)
            if after:
                ids += self.mark(after)
        else:
            ids = self.whole(piece if piece[:1] == "\n" or not self.keeps_space else " " + piece)
        if len(self) < REMEMBERED:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian bytes (uint16 where the vocabulary fits, else uint32), as the library gives
    them: a text that holds the string of a special token is encoded in one call.

    A blank or newline always starts a pre-token of these tokenizers, so the ids of a text are those of its pieces.
    Runs of white space are exceptions for a tokenizer that keeps white space; such texts are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.keeps_space = bool(self.encode_whole([" "])[0])
        self.known = _Pieces(self.tokenizer, self.keeps_space, self.dtype)

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _is_plain(self, text: str) -> bool:
        """Whether the ids of the text are those of its pieces."""
        if any(token in text for token in self.special):
            return False
        if not self.keeps_space:
            return True
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[-1:] in (" ", "\n"):
            return False
        return not any(c in text for c in _OTHER_SPACE) and (text.isascii() or not any(c in text for c in _OTHER_SPACE_WIDE))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Equal pieces of all texts are looked up once, and their ids gathered."""
        plain = [self._is_plain(text) for text in texts]
        column = pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string())
        found = iter(self._gathered(column) if len(column) else ())
        return [next(found) if p else self.known.whole(t) for t, p in zip(texts, plain, strict=True)]

    def _gathered(self, column: pa.Array) -> list[bytes]:
        # A piece holds its own white space: "\nword", or " word" as "word".
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n" if self.keeps_space else " "), " ")
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        pieces = coded.dictionary.to_pylist()
        if self.keeps_space:
            # The first piece of a text has no blank before it.
            first = [pieces[i] for i in at[edges[:-1]].tolist()]
            at[edges[:-1]] = len(pieces) + np.arange(len(first))
            ids = [*map(self.known.__getitem__, pieces), *map(self.known.whole, first)]
        else:
            ids = list(map(self.known.__getitem__, pieces))
        table = np.frombuffer(b"".join(ids), self.dtype)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        out = table[np.repeat(starts[at] - ends + lengths, lengths) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], ends])[edges].tolist()
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, for functions that are ``lean`` and keep ``path``."""
    return held(path, lambda: Encoder(path))
