"""Token ids of whole texts, with a per-process memory of pieces that recur."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Their sum is what the memories of a Python worker hold at most; when full they serve what they hold and take no more.
WORDS, PIECES, LONGEST = 800_000, 600_000, 48
#: Of a lower-cased text's bytes: white space, letters (and what may be one), others.
_CLASSES = bytes(0 if b in b" \t\n\v\f\r" else 1 if 97 <= b <= 122 or b >= 128 else 2 for b in range(256))
# a text with one of these is encoded in one go: an added token, or a mark that could join the letter before it;
# only texts with a byte that can begin one are searched
#: Byte-level alphabets write printable Latin-1 bytes as they are and the others as letters from U+0100 on.
_PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN_BYTES)}
#: An apostrophe, or the first byte of a character beyond Latin letters (U+00C0 to U+02BF but the signs of times and division and the dotted capital i), which may be
#: punctuation that goes with ASCII punctuation, or white space.
_MARKS = bytes(b == ord("'") or b == 0xC2 or b >= 0xCB for b in range(256))
_PAIRS = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")
#: The alphabet's letter of each byte; the space that parts pieces stays.
_LETTERS = np.array([32 if b == 32 else _BYTE_LETTERS.get(b, b) for b in range(256)], "<u4")
#: Pieces that the model is given at once.
_LOT = 256
_HARMLESS = bytes(b for b in range(256) if b not in b"\xcc\xcd\xe0\xe1\xe2\xe3\xef\xf0\xf1\xf2\xf3\xf4")
_WHOLE = re.compile(rb"<\||[\xcc\xcd]|\xe1\xaa|\xe1\xb7|\xe2\x83|\xef\xb8|\xe1\x85|\xe1\x86|\xe1\x87|\xe3\x82\x99|\xe3\x82\x9a|\xe0[\xa4-\xbf]|[\xf0-\xf4]")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to ``encode(text, add_special_tokens=False).ids``.

    The tokenizer drops white space and encodes runs of letters, single digits and runs of other characters each on
    their own, so texts are cut into runs of white space, of letters and of others, whose ids are remembered. Words with
    an apostrophe (contractions) or with characters beyond Latin letters are kept whole, texts with added tokens or combining marks are not cut at all.
    """

    def __init__(self, path: str, words: int = WORDS, pieces: int = PIECES) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.most = words + pieces
        self.tokenizer = Tokenizer.from_file(path)
        #: the file's model alone, for pieces that are normalised and cut already
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        #: whether an id ends a piece: the last one of each, and no other, has the suffix
        vocab = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        self.closing[[i for token, i in vocab.items() if token.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Lets go of the remembered words; the tokenizer stays."""
        self.words.clear()
        self.pieces.clear()

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes], at_once: int = 2000, most: int = 4 << 20) -> list[bytes]:
        """Ids of each text; texts are UTF-8, and at most ``at_once`` of them, of about ``most`` bytes, are cut into pieces at a time."""
        out, lot, size = [], [], 0
        for t in texts:
            if lot and (len(lot) == at_once or size + len(t) > most):
                out += self._some(lot)
                lot, size = [], 0
            lot.append(t)
            size += len(t)
        return out + self._some(lot) if lot else out

    def _some(self, texts: list[bytes]) -> list[bytes]:
        whole = [k for k, t in enumerate(texts) if (b"<|" in t or t.translate(None, _HARMLESS)) and _WHOLE.search(t)]
        found = dict(zip(whole, self._plain([texts[k].decode() for k in whole])))
        texts = [b"" if k in found else t for k, t in enumerate(texts)]
        data = b"\n".join(texts).lower()
        starts = _run_starts(data)
        # each distinct run of these texts is looked up once; the places of runs are numbers
        offsets = np.append(starts, np.int32(len(data)))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ids = self._ids(_slices(coded.dictionary))
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        place = coded.indices.to_numpy()
        counts = sizes.take(place)
        ends = np.zeros(len(counts) + 1, np.int32)  # a text has fewer ids than the 2^31 bytes that it may have
        np.cumsum(counts, out=ends[1:])
        # from an id's place in the texts to that in the distinct runs
        moved = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes).take(place) - ends[:-1], counts)
        moved += np.arange(ends[-1], dtype=np.int32)
        ids = np.frombuffer(b"".join(ids), "<u4").take(moved).tobytes()
        upto = np.cumsum([len(t) + 1 for t in texts]) - 1
        at = [0, *(ends.take(np.searchsorted(starts, upto)).astype(np.int64) << 2).tolist()]
        return [found[k] if k in found else ids[a:b] for k, (a, b) in enumerate(zip(at, at[1:]))]

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, which differ from each other; those with an apostrophe are whole words."""
        ids = list(map(self.pieces.get, pieces))
        missed = [k for k, x in enumerate(ids) if x is None]
        made = self._new_pieces([pieces[k] for k in missed if pieces[k] not in self.words])
        for k in missed:
            ids[k] = made[pieces[k]] if pieces[k] in made else self.words[pieces[k]]
        room = max(0, self.most - len(self.pieces) - len(self.words))
        for p, x in list(made.items())[:room]:
            if len(p) <= LONGEST:
                (self.words if b"'" in p else self.pieces)[p] = x
        return ids

    def _new_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Letters that the normaliser leaves as they are go to the model itself, whose alphabet writes a byte as a letter."""
        bare, other = [], []
        for p in pieces:
            if p.isalpha():
                bare.append(p)
            else:
                letters = p.decode()
                (bare if letters.isalpha() and letters == letters.lower() and is_normalized("NFC", letters) else other).append(p)
        made = dict(zip(other, self._plain([p.decode() for p in other])))
        lots = [bare[at : at + _LOT] for at in range(0, len(bare), _LOT)]
        texts = [_LETTERS.take(np.frombuffer(b" ".join(lot), np.uint8)).tobytes().decode("utf-32-le") for lot in lots]
        for lot, e in zip(lots, self.bare.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(self.closing.take(ids)) + 4).tolist()
            ids = ids.tobytes()
            made.update(zip(lot, [ids[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        return made


def _run_starts(data: bytes) -> np.ndarray:
    """Where runs of bytes of a class begin; a word with a mark that could join its neighbours is one run."""
    kinds = np.frombuffer(data.translate(_CLASSES), np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1]).astype(np.int32)
    marks = np.flatnonzero(np.frombuffer(data.translate(_MARKS), bool))
    pairs = [m.start() for p in _PAIRS if p in data for m in re.finditer(p, data)]
    if not len(marks) and not pairs:
        return starts
    marks = np.concatenate([marks, pairs]).astype(np.int64)
    space = kinds.take(starts) == 0
    word = np.cumsum(space)
    quoted = np.zeros(word[-1] + 1, bool)
    quoted[word[np.searchsorted(starts, marks, side="right") - 1]] = True
    inner = quoted.take(word) & ~space
    inner[1:] &= ~space[:-1]
    inner[0] = False
    return starts[~inner]


def _slices(values: pa.StringArray) -> list[bytes]:
    at = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset).tolist()
    data = values.buffers()[2].to_pybytes() if at[-1] else b""
    return [data[a:b] for a, b in zip(at, at[1:])]


@lru_cache(maxsize=2)
def encoder(path: str, words: int = WORDS, pieces: int = PIECES) -> Encoder:
    return Encoder(path, words, pieces)
