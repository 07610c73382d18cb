"""Media columns: AVI files of motion-JPEG frames, written and read with numpy.

A payload of 8-bit samples is shown as grey frames of WIDTH samples a row and ROWS rows (the last
frame of a clip may have fewer). A frame is a JPEG image of the lossless process (SOF3, one
component, 8 bits, predictor 1: the sample to the left, for the first of a row the one above, for the
very first 128), so that decoding gives back every sample. The file is RIFF/AVI with stream headers, a movi list
and an idx1 index; reading goes through the index. Every frame is an intra frame; a batch of frames is
decoded in step, one symbol of each frame at a time.

Shots: frames' histograms of BINS bins are compared to the one before; a cut is a difference above the mean
and SPREAD standard deviations of the clip's differences so far that are no cuts, and above LEAST. Each shot is a clip row with start
and end in seconds at RATE frames a second.

Null text: empty, stored as one row of blanks. Any length: what is computed is held for AT_ONCE frames, besides the payload, its
images and its file, each about the text's size. Equal texts
give equal files. Empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTH, ROWS = 192, 8
RATE = 25
#: Frames coded or decoded at once.
AT_ONCE = 512
BINS = 32
SPREAD, LEAST = 3.0, 0.35
PAD = b" "

#: Code lengths by category (bits of a difference), 0 to 8: text differs by categories 4 to 7 mostly.
LENGTHS = (4, 5, 4, 3, 3, 3, 2, 3, 4)


def canonical(lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, list[int], list[int]]:
    """Codes by category as JPEG assigns them; counts by length and categories in the order of codes, as DHT lists them."""
    order = sorted(range(len(lengths)), key=lambda c: (lengths[c], c))
    counts = [lengths.count(n) for n in range(1, 17)]
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    for c in order:
        code <<= lengths[c] - before
        codes[c], before = code, lengths[c]
        code += 1
    return codes, counts, order


CODES, COUNTS, ORDER = canonical()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


TABLE = segment(0xC4, bytes([0, *COUNTS, *ORDER]))
SCAN = segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))  # one component, table 0, predictor 1


def frame_header(width: int, rows: int) -> bytes:
    return b"\xff\xd8" + TABLE + segment(0xC3, struct.pack(">BHHBBBB", 8, rows, width, 1, 1, 0x11, 0)) + SCAN


def encode_frames(samples: np.ndarray, frame_rows: list[int]) -> list[bytes]:
    """JPEG images of consecutive frames; samples has a row of WIDTH for each row of each frame. No frame depends on another."""
    out, at = [], 0
    for i in range(0, len(frame_rows), AT_ONCE):
        part = frame_rows[i : i + AT_ONCE]
        out += encode_some(samples[at : at + sum(part)], part)
        at += sum(part)
    return out


def encode_some(samples: np.ndarray, frame_rows: list[int]) -> list[bytes]:
    prediction = np.empty(samples.shape, np.int16)
    prediction[:, 1:] = samples[:, :-1]
    prediction[1:, 0] = samples[:-1, 0]
    first = np.cumsum([0, *frame_rows[:-1]])
    prediction[first, 0] = 128
    diff = (samples.astype(np.int16) - prediction + 128 & 255) - 128  # modulo 256, -128 to 127
    size = np.abs(diff)
    category = np.frexp(size.astype(np.float32))[1].astype(np.uint32)  # bits of the size
    extra = np.where(diff < 0, diff + (1 << category.astype(np.int64)) - 1, diff).astype(np.uint32)
    value = (CODES[category] << category) | extra
    length = np.array(LENGTHS, np.uint32)[category] + category
    per_frame = np.add.reduceat(length.sum(axis=1, dtype=np.int64), first)
    out_bytes = -(-per_frame // 8)
    base = np.concatenate(([0], np.cumsum(out_bytes)))
    # each symbol's place in bits, frames aligned to bytes
    flat_length = length.ravel().astype(np.int64)
    ends = np.cumsum(flat_length)
    frame_of = np.repeat(np.arange(len(frame_rows)), np.array(frame_rows) * samples.shape[1])
    frame_end = np.cumsum(per_frame)
    at = ends - flat_length - np.concatenate(([0], frame_end[:-1]))[frame_of] + 8 * base[:-1][frame_of]
    # a symbol has at most 12 bits, so it lies within three bytes
    word = value.ravel().astype(np.int64) << (24 - flat_length - (at & 7))
    byte = at >> 3
    n = int(base[-1])
    data = np.zeros(n + 3, np.float64)
    for k in range(3):
        data[:] += np.bincount(byte + k, (word >> (16 - 8 * k)) & 255, n + 3)
    data = data[:n].astype(np.uint8)
    pad = 8 * out_bytes - per_frame  # ones, as JPEG asks
    data[base[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    raw, heads = data.tobytes(), {}
    out = []
    for k, rows in enumerate(frame_rows):
        if rows not in heads:
            heads[rows] = frame_header(samples.shape[1], rows)
        out.append(heads[rows] + raw[base[k] : base[k + 1]].replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return out


def lookup() -> tuple[np.ndarray, np.ndarray]:
    """Category and code length for each 8 bits to come."""
    category, used = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for c, n in enumerate(LENGTHS):
        low = int(CODES[c]) << (8 - n)
        category[low : low + (1 << (8 - n))], used[low : low + (1 << (8 - n))] = c, n
    return category, used


CATEGORY, USED = lookup()


def parse_frame(image: bytes) -> tuple[int, int, bytes]:
    """Rows, width and entropy-coded data of an image; only this module's process and table are decoded."""
    if image[:2] != b"\xff\xd8" or image[-2:] != b"\xff\xd9":
        raise ValueError("not a JPEG image")
    at, rows, width = 2, 0, 0
    while True:
        marker, size = struct.unpack_from(">xBH", image, at)
        body = image[at + 4 : at + 2 + size]
        if marker == 0xC4 and body != TABLE[4:]:
            raise ValueError("unknown Huffman table")
        if marker == 0xC3:
            _, rows, width = struct.unpack_from(">BHH", body)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError("not the lossless process")
        at += 2 + size
        if marker == 0xDA:
            return rows, width, image[at:-2].replace(b"\xff\x00", b"\xff")


def decode_frames(images: list[bytes]) -> list[np.ndarray]:
    """Samples of each image."""
    return [x for i in range(0, len(images), AT_ONCE) for x in decode_some(images[i : i + AT_ONCE])]


def decode_some(images: list[bytes]) -> list[np.ndarray]:
    """Images decoded in step: the k-th symbol of every frame at once."""
    parsed = [parse_frame(x) for x in images]
    if not parsed:
        return []
    width = parsed[0][1]
    order = sorted(range(len(parsed)), key=lambda k: -parsed[k][0])  # longest first: frames that end drop off the tail
    rows = np.array([parsed[k][0] for k in order])
    raw = b"".join(parsed[k][2] + b"\0\0\0\0" for k in order)
    sizes = np.array([len(parsed[k][2]) + 4 for k in order], np.int64)
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # 32 bits from each byte on
    at = 8 * (np.cumsum(sizes) - sizes)
    diffs = np.zeros((int(rows[0]) * width, len(order)), np.int16)
    half = np.array([0, *(1 << c for c in range(8))], np.uint32)
    full = np.array([(1 << c) - 1 for c in range(9)], np.int64)
    live = len(order)
    for step in range(len(diffs)):
        if step % width == 0:
            live = int(np.searchsorted(-rows, -(step // width), "left"))
            at = at[:live]
        bits = words[at >> 3] << (at & 7).astype(np.uint32)
        code = bits >> np.uint32(24)
        category, used = CATEGORY[code], USED[code]
        extra = (bits << used.astype(np.uint32)) >> np.uint32(16) >> (16 - category).astype(np.uint32)
        diffs[step, :live] = np.where(extra < half[category], extra - full[category], extra)
        at = at + used + category
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(order)
    for place, k in enumerate(order):
        d = diffs[: rows[place] * width, place].reshape(-1, width)
        lead = np.cumsum(d[:, 0]) + 128
        d[:, 0] = lead
        out[k] = np.cumsum(d, axis=1, dtype=np.int64).astype(np.uint8)
    return out


def payload_of(text: str) -> bytes:
    raw = text.encode()
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return raw.ljust(size, PAD)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def listed(kind: bytes, *parts: bytes) -> bytes:
    return chunk(b"LIST", kind + b"".join(parts))


def avi(frames: list[bytes], width: int = WIDTH, rows: int = ROWS, rate: int = RATE) -> bytes:
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, rows, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, rows)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, rows, 1, 8, b"MJPG", width * rows, 0, 0, 0, 0)
    index, at = [], 4
    for x in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += 8 + len(x) + len(x) % 2
    body = listed(b"hdrl", chunk(b"avih", main), listed(b"strl", chunk(b"strh", stream), chunk(b"strf", picture)))
    body += listed(b"movi", *(chunk(b"00dc", x) for x in frames)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", b"AVI " + body)


def parse_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames' images, found through the index, and the rate."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    movi, index, rate = 0, b"", float(RATE)
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            rate = 1e6 / struct.unpack_from("<I", data, at + 20)[0]
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        place = movi + offset
        if data[place : place + 4] != name or struct.unpack_from("<I", data, place + 4)[0] != size:
            raise ValueError("index and chunk differ")
        frames.append(data[place + 8 : place + 8 + size])
    return frames, rate


def encode_clips(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload; frames of all of them are coded together."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)
    shapes = []
    for x in payloads:
        full, rest = divmod(len(x) // WIDTH, ROWS)
        shapes.append([ROWS] * full + [rest] * (rest > 0))
    images = iter(encode_frames(samples, [r for s in shapes for r in s]))
    return [avi([next(images) for _ in s]) for s in shapes]


def shots(frames: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and the differences of neighbouring histograms."""
    change, last = np.zeros(max(len(frames) - 1, 0)), np.zeros(BINS)
    for k, x in enumerate(frames):
        own = np.bincount(x.ravel() >> 3, minlength=BINS) / x.size
        if k:
            change[k - 1] = np.abs(own - last).sum() / 2
        last = own
    starts, n, total, squares = [0], 0, 0.0, 0.0
    for k, x in enumerate(change.tolist()):
        mean = total / n if n else 0.0
        if x > max(LEAST, mean + SPREAD * max(squares / n - mean * mean, 0.0) ** 0.5 if n else LEAST):
            starts.append(k + 1)
        else:
            n, total, squares = n + 1, total + x, squares + x * x
    return starts, change


def decode_clips(files: list[bytes]) -> list[tuple[list[np.ndarray], float]]:
    parsed = [parse_avi(x) for x in files]
    images = iter(decode_frames([f for frames, _ in parsed for f in frames]))
    return [([next(images) for _ in frames], rate) for frames, rate in parsed]


MEDIA = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]


def stored(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, the text's size in bytes and its AVI file."""

    def make():
        def compute(texts):
            files = encode_clips([payload_of(x) for x in texts])
            return pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(files, pa.binary())

        return compute

    return common.map_texts(docs, text_col, make, MEDIA, keep)


def decoded(media: DataFrame, id_col: str, fields: list[T.StructField], row) -> DataFrame:
    """id, n_bytes and, for each row of row(file, frames, rate), its values. A null file gives no rows."""
    schema = T.StructType([media.schema[id_col], T.StructField("n_bytes", T.LongType()), *fields])
    source = media.filter(F.col("media").isNotNull()).select(id_col, "n_bytes", "media")

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "media"):
                files = part.column(2).to_pylist()
                columns: list[list] = [[] for _ in schema]
                for name, size, data, (frames, rate) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), files, decode_clips(files), strict=True):
                    for values in row(data, frames, rate):
                        for c, v in zip(columns, (name, size, *values), strict=True):
                            c.append(v)
                types = [part.column(0).type, pa.int64(), *(ARROW[type(f.dataType)] for f in fields)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return source.mapInArrow(run, schema)


ARROW = {T.LongType: pa.int64(), T.StringType: pa.string(), T.DoubleType: pa.float64()}

CLIP_FIELDS = [T.StructField("shot", T.LongType()), T.StructField("first_frame", T.LongType()), T.StructField("n_frames", T.LongType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]


def clips(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each shot of each file, with its time."""

    def row(_, frames, rate):
        starts = shots(frames)[0]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True)):
            yield k, a, b - a, a / rate, b / rate

    return decoded(media, id_col, CLIP_FIELDS, row)


DIGEST_FIELDS = [
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
]


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored bytes hold: digests of the samples read back and of the file, and a feature of frames, shots, mean level and mean change."""

    def row(data, frames, rate):
        digest, size, total = hashlib.sha256(), 0, 0
        for x in frames:
            digest.update(x)
            size, total = size + x.size, total + int(x.sum(dtype=np.int64))
        tail = frames[-1].tobytes()[-16:]  # a frame has a row of samples at least
        starts, change = shots(frames)
        level = total / size
        feature = f"frames={len(frames)};shots={len(starts)};level={level:.4f};change={change.mean() if len(change) else 0:.4f}"
        yield size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature

    return decoded(media, id_col, DIGEST_FIELDS, row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(stored(common.table(spark, sf_dir, "documents"), ["doc_id"]))
