"""Words of whole texts, each told apart once for a batch, and their token ids by a tokenizers file with word ends."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: All white space of Unicode; no piece of a word-end tokenizer crosses it.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
RUN = re.compile(f"[^{WHITE}]+")
#: What str.split() takes for white space and WHITE doesn't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Bytes of texts whose words are looked up together.
TOGETHER = 4_000_000
#: Entries kept for good and entries kept until as many are gathered: a bound on a worker's memory, not on its input.
WARM, RECENT = 500_000, 200_000
#: Words of several pre-tokens that are tokenised as one text.
JOINED = 512
#: Fixed pattern of pre-tokens, of printable ASCII in small letters.
ASCII_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Special tokens are told by case, so no letter of what may be one is made small.
MAYBE_SPECIAL = re.compile(rb"<\|[^|]*[A-Z]")


def _bytes_of(signs: str) -> np.ndarray:
    """For each byte, whether it is one of the ASCII signs."""
    return np.isin(np.arange(256), [*signs.encode()])


_BLANK, _LETTER = _bytes_of("\t\n\x0b\x0c\r "), _bytes_of("".join(chr(c) for c in range(128) if chr(c).isalnum()))
_SIGN = _bytes_of("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "|"))  # | is within special tokens
_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[_BLANK] = 0x20
_SMALL[ord("A") : ord("Z") + 1] += 0x20


def _white(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space."""
    white = _BLANK[raw]
    lead = np.flatnonzero(_LEAD[raw])
    lead = lead[lead + 1 < len(raw)]
    one, two, three = (raw[np.minimum(lead + k, len(raw) - 1)].astype(np.int32) for k in range(3))
    pair = one == 0xC2
    point = np.where(pair, (one & 31) << 6 | two & 63, (one & 15) << 12 | (two & 63) << 6 | three & 63)
    wide = np.isin(point, [ord(c) for c in WHITE if not c.isascii()])
    for k in range(3):
        white[lead[wide & (~pair | (k < 2))] + k] = True
    return white


def parted(texts: pa.Array, small: bool = False) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of texts (nulls: none) one after another, each distinct one once in the dictionary, and where each text's end.

    A word is what starts at white space after other signs, or at an ASCII sign (but |) after an ASCII letter or digit: no
    pre-token of either tokenizer crosses such places, and each word is parted alone as it is within its text. small: A-Z
    become small letters and ASCII's white space blanks.
    """
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    bounds = offsets - offsets[0]
    white = _white(raw)
    starts = _SIGN[raw]
    starts[1:] &= _LETTER[raw[:-1]]
    starts[1:] |= white[1:] & ~white[:-1]
    starts[bounds[:-1][bounds[:-1] < len(raw)]] = True
    at = np.flatnonzero(starts).astype(np.int32)
    if small and not MAYBE_SPECIAL.search(raw):
        raw = _SMALL[raw]
    words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(at, np.int32(len(raw)))), pa.py_buffer(raw)])
    return np.searchsorted(at, bounds[1:]), words.dictionary_encode()


def spread(own: list[bytes], words: pa.DictionaryArray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (<u4) of words one after another, from those of each of their dictionary (own), and where each text's end."""
    sizes = np.fromiter(map(len, own), np.int32, len(own)) >> 2
    first, at = np.cumsum(sizes, dtype=np.int32) - sizes, words.indices.to_numpy()
    n = sizes[at]
    after = np.cumsum(n, dtype=np.int32)
    total = int(after[-1]) if len(after) else 0
    ids = np.frombuffer(b"".join(own), "<u4")[np.repeat(first[at] - after + n, n) + np.arange(total, dtype=np.int32)]
    return ids, np.append(np.int32(0), after)[ends]


def gathered(batches: Iterable[pa.RecordBatch], size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches put together up to some `size` bytes each, so that a word is looked up once for more texts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class Encoder:
    """Ids (little-endian unsigned 32-bit) of words: kept for good, or until as many are gathered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.warm: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}

    def _known(self, run: str) -> bytes | None:
        return self.recent.get(run) if (ids := self.warm.get(run)) is None else ids

    def _keep(self, run: str, ids: bytes) -> bytes:
        (self.warm if len(self.warm) < WARM else self.recent)[run] = ids
        return ids

    def _part(self, part: str) -> bytes:
        """Ids of a pre-token of printable ASCII in small letters: its bytes stand for themselves."""
        return self._keep(part, _packed([t.id for t in self.model.model.tokenize(part)])) if (ids := self._known(part)) is None else ids

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters: one text for all, cut where words end; else by their places, if a letter's small form isn't one."""
        ids = np.array(self.model.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or (len(cuts) and cuts[-1] != len(ids)):
            return self._several(words)
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[s:e] for s, e in zip(at, at[1:], strict=False)]

    def _several(self, words: list[str]) -> list[bytes]:
        """Ids of any words without special tokens: one text for all, cut by the places that the library tells of each token."""
        got = self.model.encode(" ".join(words), add_special_tokens=False)
        after = np.cumsum([len(w) + 1 for w in words])  # each word and its blank
        cuts = np.searchsorted([s for s, _ in got.offsets], after)
        raw, at = _packed(got.ids), [0, *(4 * cuts).tolist()]
        return [raw[s:e] for s, e in zip(at, at[1:], strict=False)]

    def _any(self, run: str) -> bytes:
        return _packed(self.model.encode(run, add_special_tokens=False).ids)

    def _fill(self, words: set[str]) -> None:
        """Makes each of words known."""
        letters, others = [], []
        for w in words:
            if not w.isascii():
                (letters if w.lower().isalpha() else others).append(w)
            elif w.isalpha():  # the normaliser only lower-cases it, and it is one pre-token
                self._keep(w, self._part(w.lower()))
            elif w.isprintable() and "<|" not in w:
                self._keep(w, b"".join(map(self._part, ASCII_PART.findall(w.lower()))))
            else:
                self._keep(w, self._any(w))
        special = [w for w in others if "<|" in w]
        for w in special:
            self._keep(w, self._any(w))
        for own, ids_of in ((letters, self._plain), ([w for w in others if "<|" not in w], self._several)):
            for i in range(0, len(own), JOINED):
                part = own[i : i + JOINED]
                for w, ids in zip(part, ids_of(part), strict=True):
                    self._keep(w, ids)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        if len(self.recent) > RECENT:
            self.recent.clear()
        warm, recent = self.warm.get, self.recent.get
        out = list(map(warm, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        self._fill({words[k] for k in missing}.difference(self.recent))
        for k in missing:
            out[k] = recent(words[k]) if (ids := warm(words[k])) is None else ids
        return out

    def texts(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text; null ones have none."""
        ends, words = parted(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), small=True)
        ids, ends = spread(self.words(pc.ascii_ltrim(words.dictionary, " ").to_pylist()), words, ends)
        raw, at = ids.tobytes(), [0, *(4 * ends.astype(np.int64)).tolist()]
        return [raw[s:e] for s, e in zip(at, at[1:], strict=False)]


def runs_of(text: str) -> list[str]:
    """The runs of a text between white space."""
    return RUN.findall(text) if any(c in text for c in _SEPARATORS) else text.split()


def _packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """This process's encoder: what one task has learnt serves the next."""
    return Encoder(path)
