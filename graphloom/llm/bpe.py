"""Exact byte-level BPE ids by encoding each distinct chunk of a batch once.

A byte-level pre-tokenizer never lets a token span a single space that stands
between two visible characters, so a text may be cut before such spaces and the
pieces encoded apart.  Pieces repeat a lot: they are dictionary-encoded by Arrow
and only those a worker has not met lately go through the tokenizer.
"""

from __future__ import annotations

import json
import os

import numpy as np

from graphloom.llm.text import Texts, dictionary, ragged

#: Pieces that a worker remembers; bytes encoded at a time.
REMEMBERED, JOINED = 300_000, 1 << 18
#: Fixed value: how byte-level pre-tokenizers split text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_points() -> dict[str, int]:
    """The byte of each character in which byte-level vocabularies are written.

    Printable Latin-1 characters stand for themselves, the other bytes for the
    characters from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def resolve(name: str) -> str:
    """A path as given, or a file of the installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces, and the first piece of each text (n + 1).

    A piece starts at each text and before each space whose left neighbour ends
    a character in U+0021-U+007E or U+00C0-U+07FF and whose right neighbour
    starts one: none of these is white space in Unicode.
    """
    data, offs = texts.data, texts.offs
    n = len(data)
    here = np.zeros(n + 1, bool)
    if n >= 3:
        ascii_ = (data > 0x20) & (data < 0x7F)
        lead = (data >= 0xC3) & (data < 0xE0)
        left = ascii_[:-2].copy()
        left[1:] |= lead[:-3] & (data[1:-2] >= 0x80)
        here[1:-2] = (data[1:-1] == 0x20) & left & (ascii_[2:] | lead[2:])
        # a neighbour must be of the same text
        for edge in (offs[:-1], offs[1:] - 1):
            here[edge[(edge >= 0) & (edge < n)]] = False
    full = offs[1:] > offs[:-1]
    here[offs[:-1][full]] = True
    here[n] = False
    starts = np.flatnonzero(here)
    return starts, np.searchsorted(starts, offs)


class Encoder:
    """Ids of whole texts, with a bounded memory of pieces.

    Byte-level vocabularies whose ids follow the merges are encoded by tiktoken, many
    pieces in one string: token byte lengths tell the pieces apart again.  Pieces
    with a special token's string, and other vocabularies, go through ``tokenizers``.
    """

    def __init__(self, tokenizer: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = resolve(tokenizer)
        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        points = byte_points()
        vocab = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = [x.encode() for x in special]
        raw = {t: bytes(points[c] for c in t) for t in vocab if t not in special}
        self.bytes_of = np.zeros(max([*vocab.values(), *special.values()]) + 1, np.int64)
        for t, b in raw.items():
            self.bytes_of[vocab[t]] = len(b)
        for t, i in special.items():
            self.bytes_of[i] = len(t.encode())
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.fast = None
        if all(vocab.get(m) == 256 + i for i, m in enumerate(merges)):
            import tiktoken

            self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks={b: vocab[t] for t, b in raw.items()}, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.at, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        plain, odd = [], []
        for p in pieces:
            last = p[-1]
            safe = self.fast is not None and p[0] == 0x20 and (0x20 < last < 0x7F or len(p) > 2 and last >= 0x80 and 0xC3 <= p[-2] < 0xE0)
            (plain if safe and not (b"<|" in p and any(x in p for x in self.special)) else odd).append(p)
        ids, counts = [], []
        lo = 0
        while lo < len(plain):
            hi, size = lo, 0
            while hi < len(plain) and size < JOINED:
                size += len(plain[hi])
                hi += 1
            got = np.array(self.fast.encode_ordinary(b"".join(plain[lo:hi]).decode()), np.uint32)
            ends = np.cumsum([len(p) for p in plain[lo:hi]])
            upto = np.cumsum(self.bytes_of[got])
            last = np.searchsorted(upto, ends)
            if not np.array_equal(upto[last], ends):
                raise ValueError("a token spans two pieces")
            ids.append(got)
            counts.append(np.diff(np.concatenate([[-1], last])))
            lo = hi
        for lo in range(0, len(odd), 4096):
            for got in self.tok.encode_batch([p.decode() for p in odd[lo : lo + 4096]], add_special_tokens=False):
                ids.append(np.array(got.ids, np.uint32))
                counts.append(np.array([len(got.ids)]))
        if not counts:
            return
        n = np.concatenate(counts)
        base = len(self.n)
        self.known.update(zip([*plain, *odd], range(base, base + len(n)), strict=True))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, *ids])

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text, n + 1)."""
        starts, first = cuts(texts)
        if len(self.known) > REMEMBERED or len(self.ids) > 4 * REMEMBERED:
            self.forget()
        index, uniq = dictionary(texts.data, np.diff(np.append(starts, len(texts.data))))
        pieces = uniq.to_pylist()
        known = self.known
        self._learn([p for p in pieces if p not in known])
        slot = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        at, n = self.at[slot], self.n[slot]
        ids = self.ids[ragged(at[index], n[index])]
        before = np.concatenate([[0], np.cumsum(n[index])])
        return ids, before[first]

    def spans(self, texts: Texts, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in code points of the whole batch.

        A token of a part of a character spans that character.
        """
        ends = np.cumsum(self.bytes_of[ids])
        starts = ends - self.bytes_of[ids]
        lead = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80, dtype=np.int64)])
        # characters begun up to and including the first byte, and up to the last
        return lead[starts + 1] - 1, lead[ends]
