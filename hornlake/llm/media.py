"""Media columns: ISO base media containers (nested boxes) in a binary column.

`wrap` stores a payload as one track of fixed-size 8-bit samples; `walk` reads any such container back: it walks the
nested boxes, decodes the sample tables and movie fragments and returns codec, duration and the byte ranges of
keyframes. Media data is never decoded. Field layouts follow ISO/IEC 14496-12.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, written

#: Bytes of a sample, and what pads the last one.
SAMPLE = 576
PAD = b"\xff"
#: Samples a second, from one keyframe to the next, and to a chunk.
TIMESCALE = 25
GOP = 8
CHUNK = 16
CODEC = b"raw8"
#: Boxes whose content is boxes.
CONTAINERS = (b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf")
TAIL = 32


def pad(data: bytes, unit: int = SAMPLE) -> bytes:
    """data with PAD to a positive multiple of unit."""
    return data + PAD * (max(1, -(-len(data) // unit)) * unit - len(data))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _u32s(values) -> bytes:
    values = list(values)
    return struct.pack(f">{len(values)}I", *values)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def wrap(payload: bytes, sample: int = SAMPLE) -> bytes:
    """A container with payload, a positive multiple of sample bytes, as its media data."""
    n = len(payload) // sample
    chunks = -(-n // CHUNK)
    last = n - CHUNK * (chunks - 1)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(CODEC, bytes(6), struct.pack(">H", 1))
    runs = [(1, CHUNK)] * (chunks > 1) + [(chunks, last)] * (chunks == 1 or last != CHUNK)

    def moov(first: int) -> bytes:
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", _u32s((1, n, 1))),
            _full(b"stss", _u32s((len(range(1, n + 1, GOP)), *range(1, n + 1, GOP)))),
            _full(b"stsc", _u32s((len(runs), *(x for at, per in runs for x in (at, per, 1))))),
            _full(b"stsz", _u32s((sample, n))),
            _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *(first + i * CHUNK * sample for i in range(chunks)))),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">4I2H", 0, 0, TIMESCALE, n, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"meta", bytes(12), b"bytes\0"),
            _box(b"minf", _full(b"nmhd"), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        head = _full(b"mvhd", struct.pack(">4I", 0, 0, TIMESCALE, n), struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        track = _full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, n), bytes(16), MATRIX, bytes(8), flags=3)
        return _box(b"moov", head, _box(b"trak", track, media))

    header = 16 if len(payload) + 8 > 0xFFFFFFFF else 8
    first = len(ftyp) + len(moov(0)) + header
    return ftyp + moov(first) + _box(b"mdat", payload)


@dataclass
class Fragment:
    """Samples of one run of a movie fragment: where each lies, how long it lasts, whether it is a keyframe."""

    samples: list[tuple[int, int, int, bool]] = field(default_factory=list)


@dataclass
class Track:
    codec: str = ""
    id: int = 0
    timescale: int = 0
    stated: int = 0  # duration by the media header
    sizes: tuple[int, int, list[int]] = (0, 0, [])  # fixed size, count, sizes if not fixed
    times: list[tuple[int, int]] = field(default_factory=list)  # (samples, duration of each)
    shifts: list[tuple[int, int]] = field(default_factory=list)  # (samples, composition offset of each)
    edits: list[tuple[int, int]] = field(default_factory=list)  # (duration in the movie's time, first media time; -1 for none)
    keyframes: list[int] | None = None  # None: all samples
    per_chunk: list[tuple[int, int]] = field(default_factory=list)
    chunks: list[int] = field(default_factory=list)
    defaults: tuple[int, int, int] = (0, 0, 0)  # duration, size and flags of fragments' samples
    fragments: list[Fragment] = field(default_factory=list)

    @property
    def duration(self) -> int:
        """What the samples last, by the time table and the fragments; without either what the header states."""
        counted = sum(n * each for n, each in self.times) + sum(s[2] for f in self.fragments for s in f.samples)
        return counted if self.times or self.fragments else self.stated

    @property
    def samples(self) -> int:
        return self.sizes[1] + sum(len(f.samples) for f in self.fragments)

    def size(self, i: int) -> int:
        return self.sizes[0] or self.sizes[2][i]

    def places(self) -> list[tuple[int, int]]:
        """(offset, size) of each sample, those of the sample tables first."""
        found: list[tuple[int, int]] = []
        run = 0
        for c, at in enumerate(self.chunks, 1):
            while run + 1 < len(self.per_chunk) and self.per_chunk[run + 1][0] <= c:
                run += 1
            for _ in range(self.per_chunk[run][1] if self.per_chunk else 0):
                if len(found) == self.sizes[1]:
                    break
                found.append((at, self.size(len(found))))
                at += found[-1][1]
        return found + [(at, size) for f in self.fragments for at, size, _, _ in f.samples]

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        places = self.places()
        own = len(places) - sum(len(f.samples) for f in self.fragments)
        which = range(1, own + 1) if self.keyframes is None else self.keyframes
        return [places[i - 1] for i in which if 0 < i <= own] + [(at, size) for f in self.fragments for at, size, _, key in f.samples if key]

    def presentation(self) -> list[int]:
        """When each sample of the sample tables is shown, in the track's time before edits."""
        spread = lambda runs: (x for n, x in runs for _ in range(n))
        found, now, shifts = [], 0, spread(self.shifts)
        for _, each in zip(range(self.sizes[1]), spread(self.times), strict=False):
            found.append(now + next(shifts, 0))
            now += each
        return found


def boxes(data, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of the boxes side by side in data[start:end]; ends at a broken size."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if start + size > end or start + size < body:
            return
        yield kind, body, start + size
        start += size


def _counted(data, at: int, end: int, width: int, code: str) -> list[tuple]:
    """The rows of a table box: a count, then rows of struct code; no more than the box holds."""
    n = min(struct.unpack_from(">I", data, at + 4)[0], (end - at - 8) // width)
    return [struct.unpack_from(code, data, at + 8 + i * width) for i in range(n)]


def walk(data: bytes) -> tuple[list[Track], list[tuple[int, int]]]:
    """(tracks, (first byte, end) of each media data box); only headers and sample tables are read."""
    tracks: list[Track] = []
    media: list[tuple[int, int]] = []
    for kind, at, stop in boxes(data, 0, len(data)):
        if kind == b"mdat":
            media.append((at, stop))
        elif kind == b"moov":
            _walk_movie(data, at, stop, tracks)
        elif kind == b"moof":
            for inner, low, high in boxes(data, at, stop):
                if inner == b"traf":
                    _walk_fragment(data, low, high, at - 8, tracks)
    return tracks, media


def _walk_movie(data: bytes, start: int, end: int, tracks: list[Track]) -> None:
    defaults: dict[int, tuple[int, int, int]] = {}
    for kind, at, stop in boxes(data, start, end):
        if kind == b"trak":
            tracks.append(Track())
            _walk_track(data, at, stop, tracks[-1])
        elif kind == b"mvex":
            for inner, low, high in boxes(data, at, stop):
                if inner == b"trex" and high - low >= 24:
                    number, _, *own = struct.unpack_from(">5I", data, low + 4)
                    defaults[number] = tuple(own)
    for track in tracks:
        track.defaults = defaults.get(track.id, track.defaults)


#: Sample flags: bit of a sample that is no keyframe.
NO_KEYFRAME = 0x10000


def _walk_fragment(data: bytes, start: int, end: int, moof: int, tracks: list[Track]) -> None:
    """The runs of one track fragment; offsets count from the moof box unless the header names a base."""
    track, base, defaults, after = None, moof, (0, 0, 0), None
    for kind, at, stop in boxes(data, start, end):
        words = (stop - at) // 4
        flags = int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == b"tfhd" and words >= 2:
            number = struct.unpack_from(">I", data, at + 4)[0]
            track = next((t for t in tracks if t.id == number), None)
            if track is None:
                return
            need = 8 + 8 * (flags & 1) + 4 * sum(bool(flags & f) for f in (0x2, 0x8, 0x10, 0x20))
            if stop - at < need:
                return
            place = at + 8
            if flags & 1:
                base, place = struct.unpack_from(">Q", data, place)[0], place + 8
            place += 4 * bool(flags & 0x2)
            own = list(track.defaults)
            for i, flag in enumerate((0x8, 0x10, 0x20)):
                if flags & flag:
                    own[i], place = struct.unpack_from(">I", data, place)[0], place + 4
            defaults = tuple(own)
        elif kind == b"trun" and words >= 2 and track is not None:
            after = _walk_run(data, at, stop, flags, track, base, defaults, after)


def _walk_run(data: bytes, at: int, stop: int, flags: int, track: Track, base: int, defaults: tuple[int, int, int], after: int | None) -> int | None:
    """One run of samples; the place after its last one, from which a run without an offset goes on."""
    n, place = struct.unpack_from(">I", data, at + 4)[0], at + 8
    if stop - place < 4 * (bool(flags & 1) + bool(flags & 4)):
        return after
    offset = base if after is None else after
    if flags & 1:
        offset, place = base + struct.unpack_from(">i", data, place)[0], place + 4
    first = None
    if flags & 4:
        first, place = struct.unpack_from(">I", data, place)[0], place + 4
    fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    if fields:
        n = min(n, (stop - place) // (4 * len(fields)))
    elif n > len(data):
        return after  # more samples without a field than there are bytes
    run = Fragment()
    for i in range(n):
        own = dict(zip((0x100, 0x200, 0x400), defaults, strict=True))
        if i == 0 and first is not None:
            own[0x400] = first
        for f in fields:
            own[f], place = struct.unpack_from(">I", data, place)[0], place + 4
        run.samples.append((offset, own[0x200], own[0x100], not own[0x400] & NO_KEYFRAME))
        offset += own[0x200]
    track.fragments.append(run)
    return offset


def _compact_sizes(data: bytes, at: int, stop: int) -> list[int]:
    """The sizes of an stz2 table, of 4, 8 or 16 bits each."""
    width, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    body = data[at + 12 : stop]
    if width == 4:
        return [x for b in body for x in (b >> 4, b & 15)][:n]
    if width == 8:
        return list(body[:n])
    return [x for (x,) in struct.iter_unpack(">H", body[: len(body) // 2 * 2])][:n] if width == 16 else []


def _walk_track(data: bytes, start: int, end: int, track: Track) -> None:
    for kind, at, stop in boxes(data, start, end):
        room = stop - at
        if kind in CONTAINERS:
            _walk_track(data, at, stop, track)
        elif kind == b"tkhd" and room >= 24:
            track.id = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
        elif kind == b"mdhd" and room >= 24:
            track.timescale, track.stated = struct.unpack_from(">IQ" if data[at] and room >= 32 else ">II", data, at + (20 if data[at] and room >= 32 else 12))
        elif kind == b"stsd" and room >= 16:
            track.codec = data[at + 12 : at + 16].decode("latin-1")
        elif kind == b"stts" and room >= 8:
            track.times = _counted(data, at, stop, 8, ">II")
        elif kind == b"ctts" and room >= 8:
            track.shifts = _counted(data, at, stop, 8, ">Ii")
        elif kind == b"elst" and room >= 8:
            track.edits = [x[:2] for x in (_counted(data, at, stop, 20, ">QqI") if data[at] else _counted(data, at, stop, 12, ">IiI"))]
        elif kind == b"stss" and room >= 8:
            track.keyframes = [x for (x,) in _counted(data, at, stop, 4, ">I")]
        elif kind == b"stsc" and room >= 8:
            track.per_chunk = [(a, b) for a, b, _ in _counted(data, at, stop, 12, ">III")]
        elif kind == b"stsz" and room >= 12:
            fixed, n = struct.unpack_from(">II", data, at + 4)
            track.sizes = (fixed, n, [] if fixed else [x for (x,) in _counted(data, at + 4, stop, 4, ">I")])
            if not fixed:
                track.sizes = (0, len(track.sizes[2]), track.sizes[2])
        elif kind == b"stz2" and room >= 12:
            sizes = _compact_sizes(data, at, stop)
            track.sizes = (0, len(sizes), sizes)
        elif kind == b"stco" and room >= 8:
            track.chunks = [x for (x,) in _counted(data, at, stop, 4, ">I")]
        elif kind == b"co64" and room >= 8:
            track.chunks = [x for (x,) in _counted(data, at, stop, 8, ">Q")]


TRACKS = pa.list_(
    pa.struct([
        ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()),
        ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))),
    ])
)
TRACKS_DDL = "array<struct<codec:string,timescale:long,duration:long,samples:long,keyframes:array<struct<start:long,size:long>>>>"


def typed(tracks: list[Track]) -> list[dict]:
    """What TRACKS holds of the tracks."""
    return [
        {"codec": t.codec, "timescale": t.timescale, "duration": t.duration, "samples": t.samples, "keyframes": [{"start": a, "size": s} for a, s in t.keyframe_ranges()]}
        for t in tracks
    ]


def describe(tracks: list[dict]) -> str:
    """codec, duration and keyframe byte ranges of each track of typed(), as text."""
    ranges = lambda t: ",".join(f"{k['start']}+{k['size']}" for k in t["keyframes"])
    return ";".join(f"{t['codec']}:{t['duration']}/{t['timescale']}:{t['samples']}:{ranges(t)}" for t in tracks)


def _wrap_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = part["text"].to_pylist()
        yield pa.RecordBatch.from_arrays([part["row"], pa.array(map(len, texts), pa.int64()), pa.array((wrap(pad(x)) for x in texts), pa.binary())], ["row", "n_bytes", "media"])


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tracks")}
        for data in batch["media"].to_pylist():
            tracks, media = walk(data)
            digest, size, tail = hashlib.sha256(), 0, b""
            view = memoryview(data)
            for at, stop in media:
                digest.update(view[at:stop])
                size += stop - at
                tail = (tail + data[max(at, stop - TAIL) : stop])[-TAIL:]
            found = typed(tracks)
            for k, v in zip(out, (size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), describe(found), found), strict=True):
                out[k].append(v)
        kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "tracks": TRACKS}
        arrays = [pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()]
        yield pa.RecordBatch.from_arrays([batch["row"], batch["n_bytes"], *arrays], ["row", "n_bytes", *out])


def store_media(docs: DataFrame, *, text_col="text") -> DataFrame:
    """row (struct of the other columns), n_bytes, media: each text's bytes in a container, as a Parquet table.

    Null and empty texts become one sample of padding. Rows of any id, null or repeated, are kept one by one; extra
    columns ride along in row. Empty table: no rows.
    """
    others = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col]).alias("row")
    rows = docs.select(others, as_bytes(F.col(text_col)).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return written(rows.mapInArrow(_wrap_batches, f"row {kind}, n_bytes long, media binary"), "media")


def read_media(stored: DataFrame) -> DataFrame:
    """row, n_bytes and what the stored containers hold: sizes, digests, CRC of the last 32 bytes, feature as text, tracks.

    tracks has codec, time scale, duration, samples and keyframe byte ranges. Broken boxes end the walk of the box that
    holds them; what was read till then counts. Empty table: no rows.
    """
    kind = stored.schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tracks {TRACKS_DDL}"
    return stored.mapInArrow(_read_batches, schema)
