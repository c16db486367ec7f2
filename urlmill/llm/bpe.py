"""Byte-level BPE: encoding by a queue of merge ranks over a doubly linked symbol list, and decoding.

The tokenizer file (JSON with a vocabulary, ranked merges and added tokens) is read on the driver and
sent to the executors; its size is that of a vocabulary, whatever the corpus.

Defined cases: null counts as empty and gives no token; lone surrogates cannot occur in Spark strings;
the added tokens' strings in a text give their ids, as the file's own library does by default; a piece
of any length is merged whole in O(n log n).
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import itemgetter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlmill.llm.common import share

#: Fixed values of the byte-level format: the pattern that cuts text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one generation of the cache, of which there are two; its longest piece, in letters; rows of one frame handed over.
CACHE, LONGEST, FRAME = 100_000, 48, 512
#: A coded stretch of text: ids as int32, ids as text, the bytes that they decode to.
Part = tuple[bytes, str, bytes]
_IDS, _TEXT, _BYTES = map(itemgetter, range(3))


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next code from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    """Encoder and decoder built from the text of a tokenizer file."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        letters = {c: b for b, c in byte_letters().items()}
        vocab = model["model"]["vocab"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.added = {t["content"]: t["id"] for t in model.get("added_tokens") or []}
        self.bytes_of = {i: as_bytes(s) for s, i in vocab.items() if s not in self.added} | {i: s.encode() for s, i in self.added.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.id_of_byte = [vocab[c] for _, c in sorted(byte_letters().items())]
        self.rank_of: list[dict[int, int]] = [{}] * (max(vocab.values()) + 1)  # by first id, the rank of each second id
        self.merged: list[int] = []  # by rank, the id that a merge gives
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if not self.rank_of[vocab[a]]:
                self.rank_of[vocab[a]] = {}
            self.rank_of[vocab[a]].setdefault(vocab[b], rank)
            self.merged.append(vocab[a + b])
        own = self.id_of_byte
        self.rank_of_bytes = {(a, b): rank for a in range(256) for b in range(256) if (rank := self.rank_of[own[a]].get(own[b])) is not None}
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.recent: dict[str, Part] = {}
        self.older: dict[str, Part] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece: merge the pair of lowest rank, leftmost first, until none is left.

        A queue entry is a rank with the pair's place behind it; it is stale if the pair at that place has
        another rank by now, as happens once one of the two symbols was merged.
        """
        ids = list(map(self.id_of_byte.__getitem__, data))
        n = len(ids)
        ranks = [*map(self.rank_of_bytes.get, zip(data, data[1:])), None]  # of the pair that begins at each place
        shift = n.bit_length()
        queue = [rank << shift | i for i, rank in enumerate(ranks) if rank is not None]
        if not queue:
            return ids
        heapify(queue)
        after, before = [*range(1, n + 1), n], list(range(-1, n))
        rank_of, merged, place = self.rank_of, self.merged, (1 << shift) - 1
        while queue:
            entry = heappop(queue)
            i = entry & place
            rank = entry >> shift
            if ranks[i] != rank:
                continue  # stale
            new = ids[i] = merged[rank]
            j = after[i]
            ids[j], ranks[j] = -1, None
            k = after[i] = after[j]
            before[k] = i
            ranks[i] = rank = rank_of[new].get(ids[k]) if k < n else None
            if rank is not None:
                heappush(queue, rank << shift | i)
            h = before[i]
            if h >= 0:
                ranks[h] = rank = rank_of[ids[h]].get(new)
                if rank is not None:
                    heappush(queue, rank << shift | h)
        return [x for x in ids if x >= 0]

    def _part(self, ids: list[int]) -> Part:
        return array("i", ids).tobytes(), ",".join(map(self.text_of.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids))

    def _piece(self, piece: str) -> Part:
        part = self.recent.get(piece) or self.older.get(piece)
        if part is None:
            ids = self.merge(piece.encode())
            part = self._part(ids)
        if len(piece) <= LONGEST:
            if len(self.recent) >= CACHE:  # the common pieces move on, the others are forgotten
                self.older, self.recent = self.recent, {}
            self.recent[piece] = part
        return part

    def _plain(self, text: str) -> list[Part]:
        """A text without added tokens."""
        pieces = self.pieces.findall(text)
        parts = list(map(self.recent.get, pieces))
        for i in [i for i, part in enumerate(parts) if part is None]:
            parts[i] = self._piece(pieces[i])
        return parts

    def parts(self, text: str | None) -> list[Part]:
        """A text as coded parts."""
        text = text or ""
        if self.special is None or not any(t in text for t in self.added):
            return self._plain(text) if text else []
        out, at = [], 0
        for m in self.special.finditer(text):
            if at < m.start():
                out += self._plain(text[at : m.start()])
            out.append(self._part([self.added[m[0]]]))
            at = m.end()
        return out + self._plain(text[at:]) if at < len(text) else out

    def encode(self, text: str | None) -> list[int]:
        return ids_of(self.parts(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def ids_of(parts: list[Part]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_IDS, parts)), np.int32)


def load(path: str) -> str:
    """The text of a tokenizer file, read on the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def digest_ids(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def with_tokens(df: DataFrame, spec: str, text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """``df`` with ``n_tokens``; on request also ``ids`` and the digests of the ids and of the decoded text.

    Columns of these names are replaced.
    """
    shared = share(df.sparkSession, Tokenizer(spec))  # a vocabulary; workers keep it, and its cache, between tasks
    fields = [("n_tokens", T.LongType())] + [("ids", T.ArrayType(T.IntegerType()))] * ids + [(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] * digests

    @F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in fields]))
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in (batch.iloc[at : at + FRAME] for batch in batches for at in range(0, len(batch), FRAME)):
            rows = []
            for t in part:
                got = own.parts(t)
                own_ids = ids_of(got)
                row = [len(own_ids)] + [own_ids] * ids
                if digests:
                    decoded = b"".join(map(_BYTES, got)).decode("utf-8", "replace")
                    row += [hashlib.sha256(",".join(map(_TEXT, got)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append(row)
            yield pd.DataFrame(rows, columns=[n for n, _ in fields])

    names = [n for n, _ in fields]
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, tokens(F.col(text)).alias("__t")).select(*kept, *[F.col(f"__t.{n}").alias(n) for n in names])
