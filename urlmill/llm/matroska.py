"""Media columns: bytes stored as Matroska audio, and Matroska files parsed into packet tables.

The writer stores a payload losslessly as 8-bit PCM: frames go into laced SimpleBlocks, blocks into
clusters, and cues point at the clusters. The parser walks any Matroska file's variable-length EBML
elements (sizes may be unknown) and gives each packet's track, time, duration and byte range. Where a
track's packets are stored without their common first bytes, these are given beside the range; packets
that are stored compressed or encrypted have the range of what is stored, and their track says so.

Defined cases: a null text is an empty one; a payload is padded with zero bytes to a positive multiple of
64; a malformed or cut file gives the packets before the fault and the fault's message; elements that
the parser does not know are skipped; a block group without a reference is a keyframe; a block without
any duration has none; equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format: element numbers.
EBML, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, NUMBER, UID, KIND, CODEC, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
ENCODINGS, ENCODING, COMPRESSION, ALGORITHM, SETTINGS, ENCRYPTION = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255, 0x5035
#: The compression that only leaves out the first bytes.
STRIPPED = 3
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
PARENTS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, ENCODINGS, ENCODING, COMPRESSION, CLUSTER, BLOCK_GROUP, CUES, CUE, CUE_AT}
#: Elements that end a cluster of unknown size.
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
#: Of the files written here: samples a second (8 a millisecond), samples of a frame, frames of a block, blocks of a cluster.
HERTZ, FRAME, LACE, BLOCKS, UNIT = 8000, 512, 8, 16, 64
#: Rows of one frame handed over.
ROWS = 10_000


def number(value: int) -> bytes:
    return value.to_bytes(max((value.bit_length() + 7) // 8, 1), "big")


def vint(value: int) -> bytes:
    """A length in the fewest bytes; a string of ones is kept for unknown lengths."""
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def signed_vint(value: int) -> bytes:
    """A difference of sizes as EBML lacing writes it."""
    n = 1
    while not -((1 << 7 * n - 1) - 1) <= value <= (1 << 7 * n - 1) - 1:
        n += 1
    return (value + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")


def element(which: int, data: bytes) -> bytes:
    return number(which) + vint(len(data)) + data


def laced(frames: list[bytes], track: int, at: int, lacing: int | None = None) -> bytes:
    """A SimpleBlock body. lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML; by default the shortest that fits."""
    if lacing is None:
        lacing = 0 if len(frames) == 1 else 2 if len({len(f) for f in frames}) == 1 else 3
    head = vint(track) + at.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1])
    sizes = [len(f) for f in frames]
    if lacing:
        head += bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3:
        head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1]))
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A Matroska file with one 8-bit PCM track that holds ``payload``."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + element(DOC_VERSION, number(4)) + element(DOC_READ, number(2)))
    info = element(INFO, element(SCALE, number(1_000_000)))
    audio = element(AUDIO, element(RATE, np.array(HERTZ, ">f4").tobytes()) + element(CHANNELS, number(1)) + element(DEPTH, number(8)))
    named = element(NUMBER, number(1)) + element(UID, number(1)) + element(KIND, number(2)) + element(CODEC, b"A_PCM/INT/LIT")
    tracks = element(TRACKS, element(TRACK, named + element(DEFAULT_DURATION, number(FRAME * 10**9 // HERTZ)) + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    for start in range(0, len(payload), FRAME * LACE * BLOCKS):
        end = min(start + FRAME * LACE * BLOCKS, len(payload))
        blocks = [element(TIME, number(start * 1000 // HERTZ))]
        for b in range(start, end, FRAME * LACE):
            frames = [payload[i : min(i + FRAME, end)] for i in range(b, min(b + FRAME * LACE, end), FRAME)]
            blocks.append(element(SIMPLE_BLOCK, laced(frames, 1, (b - start) * 1000 // HERTZ)))
        body.append(element(CLUSTER, b"".join(blocks)))
        place = element(CUE_AT, element(CUE_TRACK, number(1)) + element(CUE_CLUSTER, number(at)))
        cues.append(element(CUE, element(CUE_TIME, number(start * 1000 // HERTZ)) + place))
        at += len(body[-1])
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Packet:
    """A frame: its time and duration in ns, and its byte range in the file."""

    track: int
    time: int
    at: int
    size: int
    lacing: int
    keyframe: bool
    cluster: int
    duration: int | None = None


@dataclass
class Media:
    """What a file holds."""

    packets: list[Packet] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster's first byte in the file
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    fault: str | None = None

    def close_group(self, first: int, duration: int | None, reference: bool) -> None:
        """What a block group says of its packets, from number ``first`` on, wherever in the group it says so."""
        own = self.packets[first:]
        for i, packet in enumerate(own):
            packet.keyframe = not reference
            if duration is not None:
                packet.duration = duration * self.scale // len(own)
                if not self.tracks.get(packet.track, {}).get("default_duration"):
                    packet.time = own[0].time + i * packet.duration


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """The number at ``at`` and the place after it; -1 for an unknown length. keep: with its length marker, as in element numbers."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no number at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"cut number at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if keep:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def _block(media: Media, data: bytes, at: int, end: int, base: int, simple: bool) -> None:
    track, at = _vint(data, at)
    if at + 3 > end:
        raise ValueError(f"cut block at byte {at}")
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    lacing, sizes = flags >> 1 & 3, []
    if lacing:
        count = data[at] + 1
        at += 1
        if lacing == 1:
            for _ in range(count - 1):
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                sizes.append(n + data[at])
                at += 1
        elif lacing == 3 and count > 1:
            n, at = _vint(data, at)
            sizes.append(n)
            for _ in range(count - 2):
                width = 9 - data[at].bit_length()
                n, at = _vint(data, at)
                sizes.append(sizes[-1] + n - ((1 << 7 * width - 1) - 1))
        elif lacing == 2:
            if (end - at) % count:
                raise ValueError(f"uneven lace at byte {at}")
            sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace beyond its block at byte {at}")
    step = media.tracks.get(track, {}).get("default_duration")
    for i, n in enumerate(sizes):
        media.packets.append(Packet(track, (base + relative) * media.scale + i * (step or 0), at, n, lacing, not simple or bool(flags & 0x80), len(media.clusters) - 1, step))
        at += n


def parse(data: bytes) -> Media:
    """All packets of a file, with an explicit stack of open elements."""
    media, base, segment = Media(), 0, 0
    track: dict = {}
    cue = {}
    group: list = []  # of the open block group: its first packet, duration, whether it refers to another
    stack: list[tuple[int, int]] = []  # open parents and their ends
    at = 0

    def close() -> None:
        if stack.pop()[0] == BLOCK_GROUP:
            media.close_group(*group)

    try:
        while at < len(data):
            while stack and at >= stack[-1][1]:
                close()
            start = at
            which, at = _vint(data, at, keep=True)
            size, at = _vint(data, at)
            while which in TOP and stack and stack[-1][0] in (CLUSTER, TRACKS, INFO, CUES):
                close()
            end = (stack[-1][1] if stack else len(data)) if size < 0 else at + size
            if size < 0 and which not in (SEGMENT, CLUSTER):
                raise ValueError(f"unknown length at byte {start}")
            if end > len(data):
                raise ValueError(f"element beyond the file at byte {start}")
            if which in PARENTS:
                stack.append((which, end))
                if which == SEGMENT:
                    segment = at
                elif which == CLUSTER:
                    media.clusters.append(start)
                    base = 0
                elif which == TRACK:
                    track = {}
                elif which == COMPRESSION:
                    track.setdefault("compression", 0)
                elif which == BLOCK_GROUP:
                    group[:] = [len(media.packets), None, False]
                continue
            value = data[at:end] if which not in (SIMPLE_BLOCK, BLOCK) else b""
            whole = int.from_bytes(value, "big") if len(value) <= 8 else 0
            if which == SCALE:
                media.scale = whole
            elif which == NUMBER:
                media.tracks[whole] = track
            elif which == CODEC:
                track["codec"] = value.decode("ascii", "replace")
            elif which == DEFAULT_DURATION:
                track["default_duration"] = whole
            elif which == CHANNELS:
                track["channels"] = whole
            elif which == DEPTH:
                track["depth"] = whole
            elif which == RATE:
                track["rate"] = float(np.frombuffer(value, ">f4" if len(value) == 4 else ">f8")[0])
            elif which == ALGORITHM:
                track["compression"] = whole
            elif which == SETTINGS:
                track["settings"] = value
            elif which == ENCRYPTION:
                track["encrypted"] = True
            elif which == BLOCK_DURATION and group:
                group[1] = whole
            elif which == REFERENCE and group:
                group[2] = True
            elif which == TIME:
                base = whole
            elif which in (SIMPLE_BLOCK, BLOCK):
                _block(media, data, at, end, base, which == SIMPLE_BLOCK)
            elif which == CUE_TIME:
                cue = {"time": whole}
            elif which == CUE_TRACK:
                cue["track"] = whole
            elif which == CUE_CLUSTER:
                media.cues.append((cue.get("time", 0), cue.get("track", 0), segment + whole))
            at = end
    except (ValueError, IndexError) as e:
        media.fault = str(e)
    while stack:
        close()
    return media


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes with zero bytes up to a positive multiple of 64, and their number before."""
    own = (text or "").encode("utf-8", "surrogatepass")
    return own + bytes(max(-(-len(own) // UNIT), 1) * UNIT - len(own)), len(own)


def digest(text: str | None) -> tuple:
    """Store a text's payload as a file, parse the file and describe what is read back."""
    payload, n = payload_of(text)
    stored = write(payload)
    media = parse(stored)
    if media.fault:
        raise ValueError(media.fault)
    back = b"".join(stored[p.at : p.at + p.size] for p in media.packets)
    level = np.frombuffer(back, np.uint8)
    own = media.tracks[1]
    last = media.packets[-1]
    end = last.time // 10**6 + last.size * 1000 // HERTZ
    kind = f"{own['codec']} {own['rate']:.0f}Hz {own['depth']}bit"
    counts = f"packets={len(media.packets)} clusters={len(media.clusters)} cues={len(media.cues)} ms={end}"
    feature = f"{kind} {counts} sum={int(level.sum(dtype=np.int64))} distinct={len(np.unique(level))}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


_DIGEST = {
    "n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(),
    "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType(),
}
DIGEST = T.StructType([T.StructField(n, t) for n, t in _DIGEST.items()])


def with_media(df: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """``df`` with each text's payload as a Matroska file in a binary column; a column of that name is replaced."""

    @F.pandas_udf(T.BinaryType())
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([write(payload_of(t)[0]) for t in batch], dtype=object)

    return df.withColumn(to, stored(F.col(text)))


def with_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the fields of ``DIGEST`` as columns; columns of those names are replaced."""

    @F.pandas_udf(DIGEST)
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([digest(t) for t in batch], columns=DIGEST.names)

    kept = [c for c in df.columns if c not in DIGEST.names]
    return df.select(*kept, described(F.col(text)).alias("__d")).select(*kept, *[F.col(f"__d.{n}").alias(n) for n in DIGEST.names])


#: The columns of a packet table behind the key.
PACKET = "packet long, track long, time_ns long, duration_ns long, first_byte long, bytes long, lacing long, keyframe boolean, cluster long, prefix binary, fault string"


def packets(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row per packet of the files in a binary column; a file with a fault has a last row that names it.

    prefix: the bytes that belong before the byte range. A null file has no row; repeated keys have the
    rows of each of their files; a packet's column that is named as the key begins with ``packet_``.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, data in zip(batch["__key"], batch["__media"]):
                if data is None:
                    continue
                got = parse(bytes(data))
                first = {n: t.get("settings", b"") for n, t in got.tracks.items() if t.get("compression") == STRIPPED}
                rows = [(k, i, p.track, p.time, p.duration, p.at, p.size, p.lacing, p.keyframe, p.cluster, first.get(p.track), None) for i, p in enumerate(got.packets)]
                if got.fault:
                    rows.append((k, len(rows), *[None] * 9, got.fault))
                for at in range(0, len(rows), ROWS):
                    frame = pd.DataFrame(rows[at : at + ROWS], columns=["__key", *names])
                    yield frame.astype(dict.fromkeys(whole, "Int64") | {"keyframe": "boolean"})

    names = [c.split()[0] for c in PACKET.split(", ")]
    whole = [c.split()[0] for c in PACKET.split(", ") if c.endswith(" long")]
    kind = df.schema[key].dataType.simpleString()
    table = df.select(F.col(key).alias("__key"), F.col(media).alias("__media")).mapInPandas(split, f"__key {kind}, {PACKET}")
    return table.select(F.col("__key").alias(key), *[F.col(n).alias(f"packet_{n}" if n.lower() == key.lower() else n) for n in names])
