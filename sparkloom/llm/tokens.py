"""Token ids of whole texts by a tokenizers file, with a bounded memory of pieces."""

from __future__ import annotations

import gc
import os

import numpy as np
import pyarrow as pa

from .common import worker_cache


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Pieces that a worker remembers: about 180 bytes each.
MOST_WORDS = 700_000

#: Kinds of bytes; ODD makes its whole word one that only the library can cut.
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: The endings that the pre-tokenizer's pattern names (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters of two bytes that are looked at here, from and to: all are in NFC whatever they are,
#: and lower-case one by one, but for one that lower-cases to two characters (fixed values).
FIRST_WIDE, LAST_WIDE, SPLITS_IN_LOWER_CASE = 0xA1, 0x17F, 0x130


def _kind(character: str) -> int:
    if character.isspace():
        return SPACE
    if character.isalpha():
        return LETTER
    return NUMBER if character.isnumeric() else OTHER


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind and lower case of each ASCII byte, and of each character of two bytes from C2 80 on."""
    kind, lower = np.full(256, ODD, np.uint8), np.arange(256, dtype=np.uint8)
    for b in range(0x21, 0x7F):
        if chr(b) != "<":  # with which added tokens begin
            kind[b], lower[b] = _kind(chr(b)), ord(chr(b).lower())
    kind[list(b" \t\n\r\x0b\x0c")] = SPACE
    wide_kind = np.full(256, ODD, np.uint8)
    wide_lower = np.zeros((256, 2), np.uint8)
    for at in range(256):
        code = 0x80 + at
        wide_lower[at] = list(chr(code).encode())
        if FIRST_WIDE <= code <= LAST_WIDE and code != SPLITS_IN_LOWER_CASE:
            wide_kind[at], wide_lower[at] = _kind(chr(code)), list(chr(code).lower().encode())
    return kind, lower, wide_kind, wide_lower


_KIND, _LOWER, _WIDE_KIND, _WIDE_LOWER = _tables()


def wide_kinds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, both of a character of two bytes alike, and where such ones begin."""
    kind = _KIND[raw]
    wide = np.nonzero((raw[:-1] >= 0xC2) & (raw[:-1] <= 0xC5))[0]
    kind[wide] = kind[wide + 1] = _WIDE_KIND[_wide_at(raw, wide)]
    return kind, wide


def _wide_at(raw: np.ndarray, wide: np.ndarray) -> np.ndarray:
    return (raw[wide].astype(np.int64) - 0xC2) * 64 + (raw[wide + 1] & 63)


def pieces_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts UTF-8 bytes as the word-end vocabulary's pre-tokenizer does: runs of letters, single
    numbers, runs of other signs, and endings after an apostrophe. Returns where each piece begins,
    its kind, and the bytes in lower case. White space makes pieces of its own; a word with a
    character of kind ODD stays whole and as it is."""
    n = len(raw)
    (kind, wide), low = wide_kinds(raw), _LOWER[raw]
    low[wide], low[wide + 1] = _WIDE_LOWER[_wide_at(raw, wide)].T
    odd = np.nonzero(kind == ODD)[0]
    if len(odd):
        space = np.concatenate([[True], kind == SPACE, [True]])
        starts, ends = np.nonzero(space[:-1] & ~space[1:])[0], np.nonzero(~space[:-1] & space[1:])[0]
        words = np.unique(np.searchsorted(starts, odd, side="right") - 1)
        change = np.zeros(n + 1, np.int8)
        change[starts[words]] = 1
        change[ends[words]] -= 1
        whole = np.cumsum(change[:-1], dtype=np.int8).view(bool)
        kind[whole], low[whole] = ODD, raw[whole]
    begins = np.empty(n + 1, bool)
    begins[0] = begins[n] = True
    begins[1:n] = kind[1:] != kind[:-1]
    number = kind == NUMBER
    number[wide + 1] = False
    begins[:n] |= number
    marks = np.nonzero((raw == ord("'")) & (kind == OTHER) & begins[:n])[0]
    if len(marks):
        padded = np.append(low, [0, 0])
        letter = np.append(kind == LETTER, [False, False])
        one, two = padded[marks + 1], padded[np.minimum(marks + 2, n + 1)]
        for ending in ENDINGS:
            own = letter[marks + 1] & (one == ord(ending[0]))
            if len(ending) == 2:
                own &= two == ord(ending[1])
            at = marks[own]
            begins[at + 1] = False
            begins[at + 1 + len(ending)] = True
    at = np.nonzero(begins[:n])[0]
    return at, kind[at], low


class WordEncoder:
    """Encodes by `tokenizers`, as the library would encode each whole text, once per distinct piece.

    The pre-tokenizer of the word-end BPE file never joins what ASCII white space parts, and
    neither NFC nor per-character lower case looks across it, so a text's ids are those of its
    pieces in order. Added tokens hold no white space and begin with a sign that makes their word
    odd; the library gets odd words whole. Longer pieces are forgotten when `most_words` are held.
    """

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_words = most_words
        self.known: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def ids(self, texts: list[str]) -> list[bytes]:
        """By the library, text by text."""
        out = []
        for at in range(0, len(texts), 4096):
            got = self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in got]
        return out

    def learn_letters(self, words: list[bytes]) -> None:
        """Pieces of letters: many in one text, told apart by the tokens that end a word."""
        for at in range(0, len(words), 2048):
            part = words[at : at + 2048]
            raw = self.ids([b" ".join(part).decode()])[0]
            last = np.nonzero(self.ends[np.frombuffer(raw, "<u4")])[0] + 1
            if len(last) == len(part) and 4 * last[-1] == len(raw):
                stops = (4 * last).tolist()
                self.known.update([(w, raw[a:b]) for w, a, b in zip(part, [0, *stops], stops)])
            else:
                self.learn_whole(part)

    def learn_whole(self, words: list[bytes]) -> None:
        self.known.update(zip(words, self.ids([w.decode("utf-8", "replace") for w in words])))

    def learn(self, letters: list[bytes], others: list[bytes]) -> None:
        """New pieces."""
        self.learn_letters(letters)
        self.learn_whole(others)

    def _room(self, words: list[bytes]) -> None:
        """Forgets longer pieces, other than `words`, when `most_words` are held."""
        if len(self.known) + len(words) > self.most_words:
            known = self.known
            self.known = {w: v for w, v in known.items() if len(w) < 6}
            if len(self.known) > self.most_words // 2:
                self.known = {}
            self.known.update([(w, known[w]) for w in words if w in known])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text's end."""
        running = gc.isenabled()
        gc.disable()  # all that is made here goes by its reference count
        try:
            return self._encode(texts)
        finally:
            if running:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        at, kind, low = pieces_of(joined)
        long, word = np.diff(np.append(at, len(joined))), kind != SPACE
        low = low[np.repeat(word, long)]  # without white space
        at, kind = at[word], kind[word]
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        offsets = np.append(0, np.cumsum(long[word])).astype(np.int32)
        every = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        code, words = np.asarray(every.indices), every.dictionary.to_pylist()
        kind_of = np.zeros(len(words), np.uint8)
        kind_of[code] = kind
        self._room(words)
        known = self.known
        letters, others = [], []
        for w, k in zip(words, kind_of.tolist()):
            if w not in known:
                (letters if k == LETTER else others).append(w)
        self.learn(letters, others)
        bodies = [known[w] for w in words]
        flat = np.frombuffer(b"".join(bodies), "<u4")
        size = np.array([len(b) // 4 for b in bodies], np.int64)
        first = np.cumsum(size) - size
        n = size[code]
        upto = np.cumsum(n)
        ids = flat[np.repeat(first[code] - (upto - n), n) + np.arange(int(upto[-1]))]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        last = np.searchsorted(at, ends)  # pieces that begin before a text's end
        return ids, np.concatenate([[0], upto])[last]

    def encode_ended(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with end_id after each text."""
        ids, ends = self.encode(texts)
        return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def encoder(path: str, most_words: int = MOST_WORDS) -> WordEncoder:
    """One for each Python worker."""
    cache = worker_cache("words")
    if path not in cache:
        cache[path] = WordEncoder(path)
    cache[path].most_words = most_words
    return cache[path]
