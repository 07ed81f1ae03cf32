"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs.

Each leaf holds the rank of the pair that starts there, with the place as the tie-break; the root
is then the leftmost pair of lowest rank. A merge changes three leaves, and their paths to the root
are recomputed. Many short pieces are merged side by side as rows of arrays, a long piece alone;
both climb the same tree. Words are remembered by each worker, as texts repeat them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from assaylens.llm.vocab import WHITE, path

NONE = np.int64(1) << np.int64(60)  # no mergeable pair
WIDE = 256  # bytes of a piece; longer ones are merged alone
ROWS = 20_000  # pieces merged side by side
CACHED = 300_000  # words a worker remembers; it then starts anew
CHARS = 2_000_000

# The pattern of the pre-tokenizer.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_WORDS = regex.compile(rf" (?=[^{WHITE}])")
_LOOSE = regex.compile(rf" (?:[{WHITE}]|$)")


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SegmentTreeBpe:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, name: str):
        with open(path(name), encoding="utf-8") as file:
            data = json.load(file)
        vocab, signs = data["model"]["vocab"], byte_signs()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        split = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.specials = regex.compile(f"({split})") if split else None
        self.bytes = {i: bytes(signs[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.of_byte = np.zeros(256, np.int64)
        for sign, byte in signs.items():
            self.of_byte[byte] = vocab[sign]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        keys = np.array([(a << 32) | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        key = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((right >= 0) & (self.keys[at] == key), self.ranks[at] * width + place, NONE)

    def _side_by_side(self, pieces: list[bytes], width: int) -> list[bytes]:
        n, length = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        inside = np.arange(width) < length[:, None]
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :-1][inside] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        places = np.broadcast_to(np.arange(width), (n, width))
        after, before = places + 1, places - 1
        after, before = np.where(after < length[:, None], after, width), before.copy()
        tree = np.full((n, 2 * width), NONE)
        tree[:, width:] = self._leaf(ids[:, :-1], ids[:, 1:], places, width)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at, gone = root % width, after[rows, root % width]
            ids[rows, at] = self.merged[root // width]
            following, previous = after[rows, gone], before[rows, at]
            ids[rows, gone] = -1
            after[rows, at] = following
            inner = following < width
            before[rows[inner], following[inner]] = at[inner]
            tree[rows, width + at] = self._leaf(ids[rows, at], ids[rows, following], at, width)
            tree[rows, width + gone] = NONE
            led = previous >= 0
            tree[rows[led], width + previous[led]] = self._leaf(ids[rows[led], previous[led]], ids[rows[led], at[led]], previous[led], width)
            for leaf in (at, gone, np.where(led, previous, at)):
                node = (leaf + width) >> 1
                while node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node >>= 1
            rows = rows[tree[rows, 1] < NONE]
        kept = ids[:, :-1] >= 0
        flat, ends = ids[:, :-1][kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _alone(self, piece: bytes) -> bytes:
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before, merged = list(range(1, n + 1)), list(range(-1, n - 1)), self.merged
        none = (len(merged), 0)
        tree = [none] * (2 * width)

        def leaf(i: int) -> tuple[int, int]:
            rank = self.rank.get((ids[i], ids[after[i]])) if after[i] < n else None
            return none if rank is None else (rank, i)

        for i in range(n):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            rank, i = tree[1]
            gone = after[i]
            ids[i], ids[gone], after[i] = int(merged[rank]), -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            tree[width + gone] = none
            changed = [gone, i]
            tree[width + i] = leaf(i)
            if before[i] >= 0:
                tree[width + before[i]] = leaf(before[i])
                changed.append(before[i])
            for node in changed:
                node = (node + width) >> 1
                while node:
                    tree[node] = min(tree[2 * node], tree[2 * node + 1])
                    node >>= 1
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > WIDE:
                out[i] = self._alone(piece)
            elif piece:
                classes.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in classes.items():
            step = max(1, min(ROWS, 4 * ROWS // width * 4))
            for at in range(0, len(members), step):
                some = members[at : at + step]
                for i, ids in zip(some, self._side_by_side([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _learn(self, words: list[str], known: dict[str, bytes], lead: str) -> None:
        cut = [PIECE.findall(lead + w) for w in words]
        distinct = list(set().union(*cut))
        ids = dict(zip(distinct, self.merge([p.encode("utf-8", "surrogatepass") for p in distinct]), strict=True))
        for word, pieces in zip(words, cut, strict=True):
            known[word] = b"".join(map(ids.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a special token's string in a text is that token.

        A blank before a sign that isn't white space always starts a piece, so texts are parted
        there, and what lies between is looked up or merged.
        """
        parts: list[list] = []
        for text in texts:
            bits = self.specials.split(text) if self.specials else [text]
            parts.append([b if i % 2 else (_WORDS.split(b) if _LOOSE.search(b) else b.split(" ")) for i, b in enumerate(bits)])
        heads = {p[0] for bits in parts for p in bits[::2]}
        tails: set[str] = set()
        for bits in parts:
            for p in bits[::2]:
                tails.update(p[1:])
        for wanted, known, lead in ((heads, self.plain, ""), (tails, self.spaced, " ")):
            missing = [w for w in wanted if w not in known]
            if len(known) + len(missing) > CACHED:
                known.clear()
                missing = list(wanted)
            self._learn(missing, known, lead)
        out = []
        for bits in parts:
            ids = []
            for i, p in enumerate(bits):
                if i % 2:
                    ids.append(int(self.special[p]).to_bytes(4, "little"))
                else:
                    ids.append(self.plain[p[0]])
                    ids.extend(map(self.spaced.__getitem__, p[1:]))
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement signs."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def encoder(name: str) -> SegmentTreeBpe:
    """One for each worker process."""
    return SegmentTreeBpe(name)


def encoded(rows: DataFrame, name: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of ``rows(doc_id, text)``: ids as bytes, and the text they decode to.

    Null counts as empty and has no ids. Every row is encoded whole; equal texts give equal ids. An
    empty table gives no rows.
    """
    return rows.select("doc_id", "text").mapInArrow(_run(name, False), "doc_id long, ids binary, decoded string")


def digests(rows: DataFrame, name: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of what :func:`encoded` gives."""
    return rows.select("doc_id", "text").mapInArrow(_run(name, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _run(name: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(name)
        for batch in batches:
            docs = batch.column("doc_id").cast(pa.int64())
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            at, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size < CHARS and i + 1 < len(texts):
                    continue
                ids = bpe.encode(texts[at : i + 1])
                decoded = map(bpe.decode, ids)
                own = docs.slice(at, i + 1 - at)
                if digest:
                    sha = [hashlib.sha256(x).hexdigest() for x in ids]
                    back = [hashlib.sha256(t.encode()).hexdigest() for t in decoded]
                    columns = [own, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([own, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
                at, size = i + 1, 0

    return run
