"""Media columns: Matroska files in binary columns, written and parsed element by element."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Element ids of the format (fixed values).
EBML, EBML_VERSION, EBML_READ, EBML_MAX_ID, EBML_MAX_SIZE, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, BIT_DEPTH, CLUSTER, TIMECODE, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE1, 0xB5, 0x9F, 0x6264, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, FRAME_DURATION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0x23E383
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
LACINGS = ("none", "xiph", "fixed", "ebml")


class Malformed(ValueError):
    """The bytes are not a Matroska file that can be parsed."""


def _vint(n: int, width: int = 0) -> bytes:
    """A number as a variable-length integer, in `width` bytes or as few as hold it."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
        if n < (1 << 7 * width) - 1:
            break
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _number(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, next offset); None stands for an unknown size."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data) or (keep_marker and width > 4):
        raise Malformed(f"cut short at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def _laced(sizes: list[int], lacing: int) -> bytes:
    head = bytes([len(sizes) - 1])
    if lacing == 1:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if lacing == 3:
        out = _vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            step, width = b - a, 1
            while abs(step) >= (1 << 7 * width - 1) - 1:
                width += 1
            out += _vint(step + (1 << 7 * width - 1) - 1, width)
        return head + out
    return head


def write(payload: bytes, rate: int = 8000, frame: int = 512, per_block: int = 8, blocks_per_cluster: int = 8) -> bytes:
    """A file with one track of unsigned 8-bit samples holding `payload`, every byte one sample.

    Frames of `frame` samples are laced `per_block` to a block, the lacing taking turns by cluster; the first
    block of a cluster is its own block group, all others simple blocks. Cues name every cluster.
    """
    start = b"".join([_number(EBML_VERSION, 1), _number(EBML_READ, 1), _number(EBML_MAX_ID, 4), _number(EBML_MAX_SIZE, 8), _element(DOCTYPE, b"matroska"), _number(DOCTYPE_VERSION, 4), _number(DOCTYPE_READ, 2)])
    info = _element(INFO, _number(SCALE, 1_000_000_000 // rate) + _element(DURATION, struct.pack(">d", len(payload))))
    audio = _element(AUDIO, _element(RATE, struct.pack(">d", rate)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    about = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(FRAME_DURATION, frame * (1_000_000_000 // rate))
    track = _element(TRACKS, _element(TRACK, about + _element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, track], [], len(info) + len(track)
    span = frame * per_block
    for c, first in enumerate(range(0, len(payload), span * blocks_per_cluster)):
        parts, kind = [_number(TIMECODE, first)], c % 4
        for b, s in enumerate(range(first, min(len(payload), first + span * blocks_per_cluster), span)):
            sizes = [min(frame, len(payload) - x) for x in range(s, min(len(payload), s + span), frame)]
            lacing = 0 if len(sizes) == 1 else kind
            if lacing == 0 and len(sizes) > 1:
                sizes = [sum(sizes)]
            if lacing == 2 and len(set(sizes)) > 1:
                lacing = 3
            data = payload[s : s + sum(sizes)]
            head = _vint(1) + (s - first).to_bytes(2, "big", signed=True) + bytes([(0x80 if b else 0) | lacing << 1])
            block = head + (_laced(sizes, lacing) if lacing else b"") + data
            parts.append(_element(SIMPLE_BLOCK, block) if b else _element(BLOCK_GROUP, _element(BLOCK, block) + _number(BLOCK_DURATION, len(data))))
        cluster = _element(CLUSTER, b"".join(parts))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, first) + _element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return _element(EBML, start) + _element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What a file holds: packets (track, timestamp in ns, first byte, size, keyframe, lacing, cluster), tracks, cues (time,
    track, cluster's place in its segment) and clusters (place in the segment, first byte, end)."""

    packets: list[tuple[int, int, int, int, bool, str, int]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[list[int]] = field(default_factory=list)
    duration: float | None = None
    scale: int = 1_000_000
    doctype: str = ""


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """A block's (track, relative time, flags, [(first byte, size)])."""
    track, at = _read_vint(data, at)
    if at + 3 > end or track is None:
        raise Malformed("block without head")
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, flags, [(at, end - at)]
    if at >= end:
        raise Malformed("lacing without count")
    n = data[at] + 1
    at += 1
    if lacing == 2:
        if (end - at) % n:
            raise Malformed("fixed lacing does not divide the block")
        size = (end - at) // n
        return track, relative, flags, [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise Malformed("lace size cut short")
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        else:
            before = at
            raw, at = _read_vint(data, at)
            if raw is None:
                raise Malformed("unknown lace size")
            size = raw if not i else sizes[-1] + raw - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(size)
    if (last := end - at - sum(sizes)) < 0 or min(sizes, default=0) < 0:
        raise Malformed("lace sizes exceed the block")
    out = []
    for size in [*sizes, last]:
        out.append((at, size))
        at += size
    return track, relative, flags, out


def read(data: bytes) -> Media:
    """Parse a whole file; clusters and segments of unknown size end where the next element of their level begins.

    Frames of a lace follow each other by their track's default duration, where it names one. An element that is longer than
    the one it is in, or a block outside of clusters, makes the file malformed.
    """
    media, stack, at = Media(), [], 0  # stack: (id, end or None)
    cluster_time, cluster_no, group, track, cue, segment_at = 0, -1, None, {}, {}, 0

    def emit(first: int, end: int, key: bool | None) -> None:
        number, relative, flags, found = _frames(data, first, end)
        keyed, step = bool(flags & 0x80) if key is None else key, media.tracks.get(number, {}).get("frame_ns", 0)
        if cluster_no < 0:
            raise Malformed(f"block at {first} outside of clusters")
        for i, (start, size) in enumerate(found):
            media.packets.append((number, (cluster_time + relative) * media.scale + i * step, start, size, keyed, LACINGS[flags >> 1 & 3], cluster_no))

    def close(kind: int) -> None:
        nonlocal group, track, cue
        if kind == BLOCK_GROUP and group and group.get("block"):
            emit(*group["block"], not group.get("refers"))
        if kind == CLUSTER:
            media.clusters[-1][2] = at
        if kind == TRACK and track:
            media.tracks[track.get("number", 0)] = track
        if kind == CUE_POINT and cue:
            media.cues.append((cue.get("time", 0), cue.get("track", 0), cue.get("cluster", 0)))

    while at < len(data):
        while stack and stack[-1][1] is not None and at >= stack[-1][1]:
            close(stack.pop()[0])
        kind, body = _read_vint(data, at, keep_marker=True)
        size, body = _read_vint(data, body)
        if kind in TOP_LEVEL:
            while stack and stack[-1][1] is None and stack[-1][0] != SEGMENT:
                close(stack.pop()[0])
        end = len(data) if size is None else body + size
        if end > len(data):
            raise Malformed(f"element at {at} is cut short")
        if size is not None and end > next((e for _, e in reversed(stack) if e is not None), end):
            raise Malformed(f"element at {at} is longer than the one it is in")
        if kind in MASTERS:
            stack.append((kind, None if size is None else end))
            if kind == CLUSTER:
                cluster_time, cluster_no = 0, cluster_no + 1
                media.clusters.append([at - segment_at, at, end])
            elif kind == SEGMENT:
                segment_at = body
            elif kind == BLOCK_GROUP:
                group = {}
            elif kind == TRACK:
                track = {}
            elif kind == CUE_POINT:
                cue = {}
            at = body
            continue
        if size is None:
            raise Malformed(f"element at {at} has no size")
        value = int.from_bytes(data[body:end], "big") if size <= 8 else 0
        if kind == TIMECODE:
            cluster_time = value
        elif kind == SIMPLE_BLOCK:
            emit(body, end, None)
        elif kind == BLOCK and group is not None:
            group["block"] = (body, end)
        elif kind == REFERENCE and group is not None:
            group["refers"] = True
        elif kind == SCALE:
            media.scale = value
        elif kind == FRAME_DURATION:
            track["frame_ns"] = value
        elif kind in (RATE, DURATION):
            number = struct.unpack(">d" if size == 8 else ">f", data[body:end])[0] if size in (4, 8) else None
            if kind == RATE:
                track["rate"] = number
            else:
                media.duration = number
        elif kind == DOCTYPE:
            media.doctype = data[body:end].decode("latin-1")
        elif kind in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH):
            track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits"}[kind]] = value
        elif kind == CODEC:
            track["codec"] = data[body:end].decode("latin-1")
        elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            cue[{CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}[kind]] = value
        at = end
    while stack:
        close(stack.pop()[0])
    return media


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, filled with zeros to a positive multiple of 64, and their number before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


MEDIA = "doc_id long, n_bytes long, media binary"


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text stored as samples of a file. Null is empty; equal texts give equal files.

    A row gives a row, repeated ones and null ids too; other columns, whatever their names, are not read. A text is held
    whole by its task, however long; its file must stay below two gigabytes, as a binary value must. An empty table gives
    an empty one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [payload_of(t) for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "n_bytes": [n for _, n in made], "media": [write(p) for p, _ in made]})

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, MEDIA)


PACKETS = "doc_id long, packet int, track int, timestamp_ns long, first_byte long, n_bytes long, keyframe boolean, lacing string, cluster int, cued boolean, error string"


def packets(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """The packet table of binary columns: a row for each packet, or one with an error for bytes that do not parse.

    Null and empty bytes give no row. cued tells whether a cue names the packet's time on its track and the place of its cluster.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, data in zip(b.doc_id, b.media, strict=True):
                if not data:
                    continue
                try:
                    found = read(bytes(data))
                except Malformed as why:
                    out.append((doc_id, None, None, None, None, None, None, None, None, None, str(why)))
                    continue
                cued = {(track, time * found.scale, place) for time, track, place in found.cues}
                out += [(doc_id, i, t, ns, at, n, key_, lacing, c, (t, ns, found.clusters[c][0]) in cued, None) for i, (t, ns, at, n, key_, lacing, c) in enumerate(found.packets)]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PACKETS.split(", ")])
            yield frame.astype({"doc_id": "Int64", "packet": "Int32", "track": "Int32", "timestamp_ns": "Int64", "first_byte": "Int64", "n_bytes": "Int64", "cluster": "Int32", "keyframe": "boolean", "cued": "boolean"})

    return files.select(F.col(key).cast("long").alias("doc_id"), F.col(media).alias("media")).mapInPandas(run, PACKETS)


CUE_TABLE = "doc_id long, cue int, track int, timestamp_ns long, cluster int, first_byte long, n_bytes long, packet int"


def cues(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """The cues of binary columns: the cluster each one's position names, that cluster's bytes, and the packet there of its time.

    A cue whose position is no cluster's has a null cluster and range; bytes that are null or do not parse give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, data in zip(b.doc_id, b.media, strict=True):
                try:
                    found = read(bytes(data)) if data else Media()
                except Malformed:
                    continue
                number = {place: i for i, (place, _, _) in enumerate(found.clusters)}
                packet = {(p[0], p[1], p[6]): i for i, p in reversed(list(enumerate(found.packets)))}
                for i, (time, track, place) in enumerate(found.cues):
                    c, ns = number.get(place), time * found.scale
                    first, end = found.clusters[c][1:] if c is not None else (None, None)
                    out.append((doc_id, i, track, ns, c, first, None if c is None else end - first, packet.get((track, ns, c))))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in CUE_TABLE.split(", ")])
            yield frame.astype({"doc_id": "Int64", "cue": "Int32", "track": "Int32", "timestamp_ns": "Int64", "cluster": "Int32", "first_byte": "Int64", "n_bytes": "Int64", "packet": "Int32"})

    return files.select(F.col(key).cast("long").alias("doc_id"), F.col(media).alias("media")).mapInPandas(run, CUE_TABLE)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(files: DataFrame) -> DataFrame:
    """Parse the stored bytes of to_media() and digest what its packets hold; the feature tells tracks, packets and levels.

    A row gives a row, repeated ones too, and equal bytes give equal values; an empty table gives an empty one. Columns other
    than to_media()'s are not read. Bytes that do not parse raise an error: to_media() wrote them, so they were damaged.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, n, data in zip(b.doc_id, b.n_bytes, b.media, strict=True):
                data = bytes(data)
                found = read(data)
                samples = b"".join(data[at : at + size] for _, _, at, size, *_ in found.packets)
                keys = sum(1 for p in found.packets if p[4])
                clusters = 1 + max(p[6] for p in found.packets)
                feature = f"{found.doctype}:tracks={len(found.tracks)}:clusters={clusters}:packets={len(found.packets)}:keys={keys}:cues={len(found.cues)}:last_ns={found.packets[-1][1]}:mean={np.frombuffer(samples, np.uint8).mean(dtype=np.float64):.6f}"
                out.append((doc_id, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")]).astype({"doc_id": "Int64"})

    return files.select("doc_id", "n_bytes", "media").mapInPandas(run, FEATURES)


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's media columns of `documents`."""
    small_batches(spark)
    return features(to_media(table(spark, sf_dir, "documents")))
