"""Exact byte-level BPE by dynamic programming over prefixes, and its inverse.

For every prefix of a piece of text the BPE encoding ends in one certain token. That token is a suffix of
the prefix and forms a valid pair with the last token of what precedes it; both tests are local. So one
pass stores the last token of each prefix: an automaton over the vocabulary gives the tokens that end at a
position, longest first, and the first compatible one is kept. Back-pointers from the end give the ids.

A pair of tokens is valid if no merge that crosses their border would have come before the merges that
made the two tokens. `pair_ok` walks the two merge trees along the border; results are memoised.

Vocabulary files are JSON files of the tokenizers library with a byte-level pre-tokenizer. Their path is a
parameter; in a cluster it must exist on every executor, as the library itself does.

A null text is encoded as an empty text; empty texts give no ids; null ids stay null. Texts of any length are
encoded whole, a piece at a time; any number of special tokens is cut out in one pass. Repeated rows give
repeated results; an empty table gives an empty one. Only the id and the text are read, so other columns, also
such with the names of results, change nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import common

#: Words whose ids a Python worker remembers, in each of two generations.
CACHE_WORDS = 160_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: White space of Unicode (property White_Space): fixed values.
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that Unicode 16.0 added (first and last code points): fixed values. The tokenizers library
#: knows them, the interpreter's tables (15.1) may not.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point, as of Unicode 16.0."""
    import unicodedata

    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[list(WHITE_SPACE)] = SPACE
    return out


def split_points(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start that the byte-level pattern splits off.

    points: code points of the texts, one after another; begins: where each (non-empty) text begins.
    A piece is an optional space and a run of letters, numbers or other characters, or a run of white space
    without the last character before a run, or one of the contractions 's 't 're 've 'm 'll 'd.
    """
    n = len(points)
    kind = _classes()[points]
    fresh = np.zeros(n, bool)
    fresh[begins] = True
    turn = fresh.copy()
    turn[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(turn)
    end = np.append(run[1:], n)
    what = kind[run]
    last = np.zeros(len(run), bool)  # of its text
    last[:-1] = fresh[run[1:]]
    last[-1] = True
    start = np.zeros(n + 1, bool)
    space = what == SPACE
    start[run[space]] = True
    start[end[space & ~last] - 1] = True
    word = run[~space]
    glued = (points[word - 1] == 0x20) & (word > 0) & ~fresh[word]
    start[word[~glued]] = True
    # contractions: a lone apostrophe that nothing is glued to, and then letters
    marks = run[(what == OTHER) & (end - run == 1) & (points[run] == 0x27) & ~last]
    marks = marks[(kind[marks + 1] == LETTER) & ~((marks > 0) & (points[marks - 1] == 0x20) & ~fresh[marks])]
    if len(marks):
        padded = np.append(points, [0, 0, 0])
        ends_text = np.append(fresh, [True, True, True])
        a, b = padded[marks + 1], np.where(ends_text[marks + 2], 0, padded[marks + 2])
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        hit = marks[one | two]
        start[hit + 1] = False
        start[hit + 1 + np.where(one, 1, 2)[one | two]] = True
    return np.flatnonzero(start[:n])


#: Packers of up to 15 ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


class Encoder:
    """Ids of byte-level BPE for one vocabulary file."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        vocab = spec["model"]["vocab"]
        raw = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()}
        added = spec.get("added_tokens", ())
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("special tokens that strip or need whole words are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        # of special tokens that begin at the same place the longest counts
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._special_ids = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        self.tokens: list[bytes] = [raw.get(i, b"") for i in range(max([*raw, *self.special.values()]) + 1)]
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            self.merge.setdefault(pair, made)
            if made not in self.parts:
                self.parts[made], self.rank[made] = pair, k
        self._pairs: dict[int, bool] = {}
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self.cache_words = cache_words
        # tokens that merges can't reach as a whole must not be matched
        self.automaton = ahocorasick.Automaton()
        for i, t in raw.items():
            if t and (i not in self.parts or self.pair_ok(*self.parts[i], of=i)):
                self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()

    def pair_ok(self, left: int, right: int, of: int | None = None) -> bool:
        """Whether left and right stay apart when their joined bytes are encoded.

        of: the token that the two make; then, whether no other crossing merge comes before that one.
        """
        rank, parts, merge = self.rank, self.parts, self.merge
        # The least rank at which a crossing merge is too late: a side is already part of a longer token.
        limit = rank[of] if of is not None else len(merge)
        if of is not None:
            # the first merge of the border is by the two themselves; start one level below
            a, b = left, right
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, left = ra, parts[a][1]
            else:
                limit, right = rb + 1, parts[b][0]
        while True:
            made = merge.get((left, right))
            if made is not None and rank[made] < limit:
                return False
            ra, rb = rank.get(left, -1), rank.get(right, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the later merge is undone first; of equal ones the right one, which comes later
                limit, left = ra, parts[left][1]
            else:
                limit, right = rb + 1, parts[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: the last token of each prefix, then back from the end."""
        n = len(piece)
        last, size = [0] * (n + 1), [0] * (n + 1)
        pairs, done = self._pairs, 0
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if end == done:
                continue
            if end != length:
                before = last[end - length]
                key = before << 20 | token
                ok = pairs.get(key)
                if ok is None:
                    ok = pairs[key] = self.pair_ok(before, token)
                if not ok:
                    continue
            last[end], size[end], done = token, length, end
        if len(pairs) > 400_000:
            pairs.clear()
        ids, at = [], n
        while at:
            if not size[at]:
                raise ValueError("the vocabulary lacks a byte")
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _packed(self, piece: bytes) -> bytes:
        """Ids of a piece as little-endian 32-bit integers, remembered."""
        found = self._new.get(piece)
        if found is not None:
            return found
        found = self._old.get(piece)
        if found is None:
            ids = self.encode_piece(piece)
            found = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self._new) >= self.cache_words:
                self._old, self._new = self._new, {}
            self._new[piece] = found
        return found

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        if self._specials is None or not any(map(self._specials.search, texts)):
            return self._plain(texts)
        # special tokens cut a text into parts; the parts of all texts are encoded at once
        parts = [self._specials.split(t) for t in texts]  # plain and special parts take turns
        plain = iter(self._plain([p for cut in parts for p in cut[::2]]))
        return [b"".join(self._special_ids[p] if k % 2 else next(plain) for k, p in enumerate(cut)) for cut in parts]

    def _plain(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        full = [k for k, t in enumerate(texts) if t]
        if not full:
            return out
        joined = "".join(texts[k] for k in full)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begins = np.zeros(len(full), np.int64)
        np.cumsum([len(texts[k]) for k in full[:-1]], out=begins[1:])
        start = split_points(points, begins)
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int8)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        raw = joined.encode()
        cut = np.append(at[start], len(raw)).tolist()
        first = np.append(np.searchsorted(start, begins), len(start)).tolist()
        pieces = [raw[a:b] for a, b in zip(cut, cut[1:])]
        known = dict.fromkeys(pieces)  # a piece is looked up once for all texts
        for piece in known:
            known[piece] = self._packed(piece)
        found = list(map(known.__getitem__, pieces))
        for k, lo, hi in zip(full, first, first[1:]):
            out[k] = b"".join(found[lo:hi])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, special ones included, as UTF-8; what is not valid becomes U+FFFD."""
        joined = b"".join(map(self.tokens.__getitem__, ids.tolist()))
        try:
            joined.decode()
        except UnicodeDecodeError:
            return joined.decode("utf-8", "replace").encode()
        return joined


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, list[bytes]]]:
    """Ids (first column) and packed token ids of batches of (id, text), a bounded number of texts at once."""
    enc = encoder(path)
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for part in common.chunks(rows, lambda r: len(r[1] or ""), 1 << 20):
            yield [r[0] for r in part], enc.encode_packed([r[1] or "" for r in part])


def roundtrip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids_sha256, decoded_sha256) of every row of docs (doc_id, text)."""

    def run(batches):
        enc = encoder(vocabulary)
        for ids, packed in encode_batches(batches, vocabulary):
            decoded = [enc.decode(np.frombuffer(p, "<u4")) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([len(d) for d in decoded], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""

    def run(batches):
        for ids, packed in encode_batches(batches, vocabulary):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32()))], [id_column, "ids"])

    return docs.selectExpr(f"cast(`{id_column}` as long) `{id_column}`", f"`{text_column}`").mapInArrow(run, f"`{id_column}` long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id") -> DataFrame:
    """(id, text) of rows (id, ids); null ids give a null text."""

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            texts = [None if ids is None else enc.decode(np.array(ids, np.uint32)).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    return encoded.selectExpr(f"cast(`{id_column}` as long) `{id_column}`", "ids").mapInArrow(run, f"`{id_column}` long, text string")
