"""Operator 9, media columns: Matroska files as binary columns.

`mux` writes a payload of 8-bit samples as a Matroska file with one track: EBML header, segment
information, one track entry, clusters of simple blocks that take turns among the lacings (none, Xiph, fixed size,
EBML), and cues. `packets` reads any such bytes back: it walks the variable-length elements (of known and
unknown size), clusters, block groups and simple blocks, undoes all four lacings, and lists each frame
with its track, timestamp, flags and byte range. `read_samples` joins a track's ranges again.

One row in, one row out (or one row a packet for `packet_table`), a batch at a time: no shuffle, memory is
that of one Arrow batch of bounded rows and of one file. Null texts count as empty: 64 zero bytes. Broken files
give the packets up to the break, and `error` says why; files whose elements are nested without end count as broken. Repeated rows give repeated results; other
columns are carried along unread.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

UNIT, FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, RATE = 64, 1024, 4, 16, 8000

#: Fixed values of the format: element identifiers (RFC 9559 and RFC 8794).
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
PARENTS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements of a segment's top level: they end a cluster of unknown size.
TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
#: Elements within elements that a reader follows; the format itself needs eight.
DEEPEST = 64


def vint(n: int, width: int = 0) -> bytes:
    """n as a variable-length integer of the least (or given) width; all ones are reserved."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], kind: int) -> bytes:
    """The lacing head and the frames of one block."""
    sizes = [len(x) for x in frames]
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file that holds payload as 8-bit samples of one track; 1 ms is RATE / 1000 samples."""
    head = element(EBML, unsigned(0x4286, 1) + unsigned(0x42F7, 1) + unsigned(0x42F2, 4) + unsigned(0x42F3, 8) + element(0x4282, b"matroska") + unsigned(0x4287, 4) + unsigned(0x4285, 2))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(0x4D80, b"tessera") + element(0x5741, b"tessera"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    step = FRAME * FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for start in range(0, len(payload), step):
        time = start * 1000 // RATE
        blocks = [unsigned(TIMESTAMP, time)]
        for k, low in enumerate(range(start, min(start + step, len(payload)), FRAME * FRAMES_A_BLOCK)):
            piece = payload[low : low + FRAME * FRAMES_A_BLOCK]
            frames = [piece[i : i + FRAME] for i in range(0, len(piece), FRAME)]
            even = len({len(x) for x in frames}) == 1
            kind = NO_LACING if len(frames) == 1 else (FIXED if even else XIPH, XIPH, EBML_LACING)[k % 3]
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", low * 1000 // RATE - time, 0x80 | kind << 1) + laced(frames, kind)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def read_vint(data, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, position after it, and whether all its bits are ones (an unknown size)."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError(f"cut variable-length integer at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    bits = n & (1 << 7 * width) - 1
    return n if keep_marker else bits, at + width, bits == (1 << 7 * width) - 1


def elements(data, at: int, end: int, inside: int = 0):
    """Yields (identifier, start of body, end of body) of every element within at to end."""
    while at < end:
        ident, body, _ = read_vint(data, at, True)
        if inside == CLUSTER and ident in TOP:
            return
        size, body, unknown = read_vint(data, body)
        stop = end if unknown else body + size
        if stop > end:
            raise ValueError(f"element {ident:#x} at byte {at} ends after its parent")
        if unknown and ident == CLUSTER:  # it ends where the next top-level element begins
            stop = body
            for _, _, stop in elements(data, body, end, CLUSTER):
                pass
        yield ident, body, stop
        at = stop


def frame_ranges(data, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, length) of the frames of a block whose frames begin at `at`, with its lacing head."""
    if kind == NO_LACING:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % count:
            raise ValueError(f"fixed lacing of {count} frames doesn't divide {end - at} bytes")
        sizes = [(end - at) // count] * count
    else:
        for k in range(count - 1):
            if kind == XIPH:
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + data[at], at + 1
            else:
                raw, after, _ = read_vint(data, at)
                n = raw if k == 0 else sizes[-1] + raw - ((1 << 7 * (after - at) - 1) - 1)
                at = after
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def packets(data: bytes) -> tuple[list[dict], dict]:
    """Packets (cluster, track, timestamp in ticks, keyframe, lacing, frame, offset, length) and facts of the file."""
    found: list[dict] = []
    facts: dict = {"scale": 1_000_000, "clusters": 0, "cues": [], "tracks": [], "error": None}
    number = lambda a, b: int.from_bytes(data[a:b], "big")

    def block(a: int, b: int, time: int, simple: bool) -> None:
        track, at, _ = read_vint(data, a)
        shift, flags = struct.unpack(">hB", data[at : at + 3])
        kind = flags >> 1 & 3
        for k, (start, length) in enumerate(frame_ranges(data, at + 3, b, kind)):
            found.append({"cluster": facts["clusters"], "track": track, "timestamp": time + shift, "keyframe": simple and flags >= 128, "lacing": kind, "frame": k, "offset": start, "length": length})

    # The open elements, from the outermost: what is left of each, its identifier, its cluster's time. Depth costs no calls.
    try:
        open_ = [[elements(data, 0, len(data)), 0, 0]]
        while open_:
            rest, _, time = open_[-1]
            ident, x, y = next(rest, (None, 0, 0))
            if ident is None:
                open_.pop()
            elif ident == TIMESTAMP:
                open_[-1][2] = number(x, y)
            elif ident == TIMESTAMP_SCALE:
                facts["scale"] = number(x, y)
            elif ident == SIMPLE_BLOCK or ident == BLOCK:
                block(x, y, time, ident == SIMPLE_BLOCK)
            elif ident == TRACK_NUMBER:
                facts["tracks"].append(number(x, y))
            elif ident == CUE_TIME:
                facts["cues"].append([number(x, y), None])
            elif ident == CUE_CLUSTER_POSITION and facts["cues"]:
                facts["cues"][-1][1] = number(x, y)
            elif ident in PARENTS:
                facts["clusters"] += ident == CLUSTER
                if len(open_) > DEEPEST:
                    raise ValueError(f"elements are nested deeper than {DEEPEST}")
                open_.append([elements(data, x, y, ident), ident, 0 if ident == CLUSTER else time])
    except (ValueError, IndexError, struct.error) as e:
        facts["error"] = str(e) or "the file is cut"
    return found, facts


def read_samples(data: bytes, track: int = 1) -> bytes:
    return b"".join(data[p["offset"] : p["offset"] + p["length"]] for p in packets(data)[0] if p["track"] == track)


PACKET = pa.struct([("cluster", pa.int64()), ("track", pa.int64()), ("timestamp", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int64()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
PACKET_DDL = "array<struct<cluster:bigint,track:bigint,timestamp:bigint,keyframe:boolean,lacing:bigint,frame:bigint,offset:bigint,length:bigint>>"


def packet_table(files: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row a packet of the files in the binary column `media`; null and broken files give what they hold."""

    def run(batches):
        for b in batches:
            found = [packets(x or b"")[0] for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(PACKET))], ["key", "packets"])

    kind = files.schema[key].dataType.simpleString()
    listed = files.select(key, media).mapInArrow(run, f"key {kind}, packets {PACKET_DDL}")
    return listed.select(F.col("key").alias(key), F.explode("packets").alias("p")).select(key, "p.*")


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and text's media file: key, n_bytes, media."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            raw = [(x or "").encode() for x in b.column(1).to_pylist()]
            media = [mux(x + bytes(-len(x) % UNIT or UNIT * (not x))) for x in raw]
            yield pa.record_batch([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", key)


DIGEST = "key bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of files with n_bytes and media: what their payloads, read back, amount to."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for data in b.column(2).to_pylist():
                found, facts = packets(data)
                payload = b"".join([data[p["offset"] : p["offset"] + p["length"]] for p in found if p["track"] == 1])
                laces = [0] * 4
                for p in found:
                    laces[p["lacing"]] += 1
                mean = sum(payload) / max(1, len(payload))
                feature = f"packets={len(found)};clusters={facts['clusters']};cues={len(facts['cues'])};lacing={'/'.join(map(str, laces))};ms={len(payload) * 1000 // RATE};mean={mean:.4f};silence={payload.count(0)}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select(key, "n_bytes", "media").mapInArrow(run, DIGEST).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(stored(table(spark, sf_dir, "documents")))
