"""Byte-level BPE by corpus-level merge replay, and its decoding.

The distinct pieces of a task's documents become one array of symbols. An inverted index has, for
each band of merge ranks, the positions of the pairs that it joins. Bands are replayed from the
lowest; a step joins in each piece the places of its lowest rank, touches their two neighbours
alone, and enters their new pairs in the index, so that each piece sees its merges in rank order.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import gathered, slices, texts_of, to_bytes, worker_cache
from .tokens import ENDINGS, LETTER, ODD, OTHER, SPACE, wide_kinds

#: The public tokenizers' pattern (fixed value): what `spans_of` is written for.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bands of merge ranks; pieces that a worker remembers; bytes of text that are encoded at a time.
BANDS, MOST_PIECES, SLICE = 192, 700_000, 8 << 20


def spans_of(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of `SPLIT` begin in the UTF-8 bytes of documents on end, which begin at
    `starts`, and their kinds. White space up to the next, with the word after it, is one match of
    kind ODD where it holds a character whose kind is not known here: it has to be cut by the
    pattern itself. A document's first byte always begins a match."""
    n = len(raw)
    kind, _ = wide_kinds(raw)
    kind[raw == ord("<")] = OTHER
    first = np.zeros(n + 1, bool)
    first[starts[starts < n]] = first[n] = True
    begins = np.ones(n + 1, bool)
    begins[1:n] = first[1:n] | (kind[1:] != kind[:-1])
    space = kind == SPACE
    after = np.nonzero(~first[1:n] & space[:-1] & ~space[1:])[0] + 1  # where white space ends in something
    begins[after - 1] = True
    begins[after[raw[after - 1] == ord(" ")]] = False
    marks = np.nonzero((raw == ord("'")) & (kind == OTHER) & begins[:n])[0]
    if len(marks):
        padded, letter = np.append(raw, [0, 0]), np.append(kind == LETTER, [False, False])
        letter[:n] &= ~first[:n]
        for ending in ENDINGS:
            own = letter[marks + 1] & (padded[marks + 1] == ord(ending[0]))
            if len(ending) == 2:
                own &= letter[np.minimum(marks + 2, n + 1)] & (padded[np.minimum(marks + 2, n + 1)] == ord(ending[1]))
            begins[marks[own] + 1] = False
            begins[marks[own] + 1 + len(ending)] = True
    odd = np.nonzero(kind == ODD)[0]
    if len(odd):
        cut = np.nonzero(first[:n] | np.append(False, space[1:] & ~space[:-1] & (kind[:-1] != ODD)))[0]
        of = np.unique(np.searchsorted(cut, odd, side="right") - 1)
        change = np.zeros(n + 1, np.int8)
        change[cut[of]] = 1
        change[np.append(cut, n)[of + 1]] -= 1
        whole = np.cumsum(change[:-1], dtype=np.int8).view(bool)
        begins[:n] &= ~whole
        begins[cut[of]] = True
        kind[cut[of]] = ODD
    at = np.nonzero(begins[:n])[0]
    return at, kind[at]


class MergeReplay:
    """Encodes pieces of text by the ranks of a tiktoken file."""

    def __init__(self, path: str, pattern: str = SPLIT, most_pieces: int = MOST_PIECES):
        import regex

        self.cut, self.by_arrays = regex.compile(pattern).findall, pattern == SPLIT
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # which tokens join to one, and its rank: sorted by pair
        pairs = [(x << 32 | y, r) for t, r in ranks.items() for k in range(1, len(t)) if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None]
        pairs.sort()
        self.pairs, self.joined = np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32)
        top = max(ranks.values()) + 1
        token = [b""] * top
        for t, r in ranks.items():
            token[r] = t
        self.bytes, self.size = np.frombuffer(b"".join(token), np.uint8), np.array([len(t) for t in token], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.decimal = [b"%d," % r for r in range(top)]
        edges = np.unique((top * (np.arange(BANDS + 1) / BANDS) ** 2).astype(np.int64))
        self.band = (np.searchsorted(edges, np.arange(top), side="right") - 1).astype(np.int32)
        self.known: dict[bytes, bytes] = {}
        self.most_pieces = most_pieces

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that joins tokens a and b, -1 if none does."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], -1)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces on end and how many each has, all merges replayed over all
        pieces together."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        text = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(text)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        ids = self.byte[text]
        edge = np.append(piece[1:] != piece[:-1], True) if n else np.zeros(0, bool)
        after = np.where(edge, -1, np.arange(1, n + 1)).astype(np.int32)
        before = np.where(np.append(True, edge[:-1]), -1, np.arange(-1, n - 1)).astype(np.int32) if n else after
        rank = np.full(n, -1, np.int32)  # of the pair that begins at a position
        inner = np.nonzero(~edge)[0]
        rank[inner] = self.ranks_of(ids[inner], ids[inner + 1])
        index: list[list[np.ndarray]] = [[] for _ in range(int(self.band[-1]) + 1)]
        alive = np.ones(n, bool)

        def enter(at: np.ndarray) -> int:
            """Puts positions into the index; returns the lowest band that got any."""
            at = at[rank[at] >= 0]
            if not len(at):
                return len(index)
            band = self.band[rank[at]]
            order = np.argsort(band, kind="stable")
            at, band = at[order], band[order]
            starts = np.nonzero(np.append(True, band[1:] != band[:-1]))[0]
            for b, part in zip(band[starts].tolist(), np.split(at, starts[1:])):
                index[b].append(part)
            return int(band[0])

        enter(inner)
        low = 0
        while low < len(index):
            if not index[low]:
                low += 1
                continue
            at = np.unique(np.concatenate(index[low]))
            index[low] = []
            at = at[(rank[at] >= 0) & alive[at]]
            at = at[self.band[rank[at]] == low]
            if not len(at):
                continue
            r, own = rank[at], piece[at]
            heads = np.nonzero(np.append(True, own[1:] != own[:-1]))[0]
            of = np.cumsum(np.append(True, own[1:] != own[:-1])) - 1
            least = r == np.minimum.reduceat(r, heads)[of]
            later, i = at[~least], at[least]
            # of places that overlap, the first, the third, …
            follows = np.append(False, after[i[:-1]] == i[1:])
            nth = np.arange(len(i)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(i))))
            later, i = np.append(later, i[nth % 2 == 1]), i[nth % 2 == 0]
            while True:
                r, j = rank[i], after[i]
                end, left = after[j], before[i]
                touch = np.append(False, (j[:-1] == left[1:]) & (left[1:] >= 0))  # joins side by side
                right_id = np.where(np.append(touch[1:], False), r, ids[end])
                left_id = np.where(touch, r, ids[left])
                left_at = np.where(touch, np.append(-1, i[:-1]), left)
                new_right = np.where(end >= 0, self.ranks_of(r, right_id), -1)
                new_left = np.where(left >= 0, self.ranks_of(left_id, r), -1)
                several = np.append(piece[i[1:]] == piece[i[:-1]], False) | np.append(False, piece[i[1:]] == piece[i[:-1]])
                lower = several & (((new_right >= 0) & (new_right < r)) | ((new_left >= 0) & (new_left < r)))
                if not lower.any():
                    break
                # a join brings up a lower rank: such pieces make their first join alone
                hold = np.isin(piece[i], piece[i[lower]]) & np.append(False, piece[i[1:]] == piece[i[:-1]])
                later, i = np.append(later, i[hold]), i[~hold]
            ids[i] = r
            alive[j] = False
            rank[j] = -1
            after[i] = end
            some = end >= 0
            before[end[some]] = i[some]
            rank[i] = new_right
            some = left >= 0
            rank[left_at[some]] = new_left[some]
            enter(later)
            low = min(low, enter(np.append(i, left_at[some])))
        return ids[alive], np.bincount(piece[alive], minlength=len(pieces))

    def _learn(self, new: list[bytes], odd: list[bytes]) -> dict[bytes, list[bytes]]:
        """Pieces not known yet; returns the pieces of each odd match."""
        cut = {w: [p.encode() for p in self.cut(w.decode("utf-8", "replace"))] for w in odd}
        new = list(dict.fromkeys([*new, *(p for ps in cut.values() for p in ps if p not in self.known)]))
        ids, counts = self.replay(new)
        raw, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
        self.known.update([(p, raw[a:b]) for p, a, b in zip(new, [0, *ends], ends)])
        return cut

    def encode(self, texts: list[bytes], lines: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The ids of whole texts on end, where each text's end, and, with `lines`, each text's
        decimal ids joined by commas."""
        running = gc.isenabled()
        gc.disable()  # all that is made here goes by its reference count
        try:
            return self._encode(texts, lines)
        finally:
            if running:
                gc.enable()

    def _encode(self, texts: list[bytes], lines: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        sizes = np.array([len(t) for t in texts], np.int64)
        joined, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes)
        if not len(joined):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), [b""] * len(texts)
        if self.by_arrays:
            at, kind = spans_of(joined, ends - sizes)
        else:
            at = (ends - sizes)[sizes > 0]
            kind = np.full(len(at), ODD, np.uint8)
        offsets = np.append(at, len(joined)).astype(np.int32)
        every = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        code, words = np.asarray(every.indices), every.dictionary.to_pylist()
        kind_of = np.zeros(len(words), np.uint8)
        kind_of[code] = kind
        if len(self.known) + len(words) > self.most_pieces:  # longer pieces are forgotten
            self.known = {p: x for p, x in self.known.items() if len(p) < 6}
            if len(self.known) > self.most_pieces // 2:
                self.known = {}
        known, odd = self.known, (kind_of == ODD).tolist()
        cut = self._learn([w for w, o in zip(words, odd) if not o and w not in known], [w for w, o in zip(words, odd) if o])
        bodies = [b"".join([known[p] for p in cut[w]]) if o else known[w] for w, o in zip(words, odd)]
        flat, n = np.frombuffer(b"".join(bodies), "<i4"), np.array([len(b) // 4 for b in bodies], np.int64)
        first, size = np.cumsum(n) - n, n[code]
        upto = np.cumsum(size)
        ids = flat[np.repeat(first[code] - (upto - size), size) + np.arange(int(upto[-1]))]
        last = np.searchsorted(at, ends)  # matches that begin before a text's end
        out: list[bytes] = []
        if lines:
            decimal, plain, stops = self.decimal, flat.tolist(), np.cumsum(n).tolist()
            text = [b"".join([decimal[x] for x in plain[a:b]]) for a, b in zip([0, *stops], stops)]
            codes = code.tolist()
            out = [b"".join([text[c] for c in codes[a:b]])[:-1] for a, b in zip([0, *last.tolist()], last.tolist())]
        return ids, np.append(0, upto)[last], out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        size = self.size[ids]
        upto = np.cumsum(size)
        return self.bytes[np.repeat((self.first[ids] - (upto - size)).astype(np.int32), size) + np.arange(int(upto[-1]), dtype=np.int32)]


def pattern_of() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def replay_of(path: str, pattern: str) -> MergeReplay:
    """One for each Python worker."""
    cache = worker_cache("pieces")
    if (path, pattern) not in cache:
        cache[path, pattern] = MergeReplay(path, pattern)
    return cache[path, pattern]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null encodes as an empty text."""
    pattern = pattern or pattern_of()

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = replay_of(ranks_path, pattern)
        for part in gathered(batches, SLICE):
            ids, ends, _ = bpe.encode(to_bytes(part.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, ids); null ids give no bytes."""
    pattern = pattern or pattern_of()

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = replay_of(ranks_path, pattern)
        for part in slices(batches):
            out = [bpe.decode(np.array(ids or [], np.int64)).tobytes() for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def roundtrip_digests(docs: DataFrame, ranks_path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    No shuffle: a task's documents are its corpus, so nothing grows but the number of tasks. A
    null or empty text has no tokens and the digests of no bytes; repeated rows repeat the answer.
    Special tokens in a text are ordinary text. A very long text is one slice, some 60 bytes of
    memory for each of its own.
    """
    pattern = pattern or pattern_of()

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = replay_of(ranks_path, pattern)
        for part in gathered(batches, SLICE):
            ids, ends, lines = bpe.encode(to_bytes(part.column(1)), lines=True)
            decoded = [hashlib.sha256(bpe.decode(ids[a:b]).data).hexdigest() for a, b in zip([0, *ends.tolist()], ends.tolist())]
            cols = [part.column(0), pa.array(np.diff(ends, prepend=0)), pa.array([hashlib.sha256(x).hexdigest() for x in lines]), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
