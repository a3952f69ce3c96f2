"""Media columns (5): payloads as MPEG transport streams, and what a reader gets out of them.

A stream has a program association table and a program map table before each random-access point,
and one elementary stream of private data. The payload is cut into units of UNIT bytes, each a
packetised elementary stream packet with a 90 kHz timestamp, in 188-byte transport packets with
continuity counters; the last packet of a unit is filled up by its adaptation field. Beside the stream
stand its units' timestamps and its random-access points, so a part can be read by time.

The reader takes any stream: it finds the packets again after lost bytes, puts tables together from
sections over several packets, follows them to the streams of each program, checks checksums and counters
(a packet sent twice and a marked discontinuity are allowed), and reassembles the units, of stated length or not.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from geolith.llm.common import stored, text_column

PACKET, UNIT = 188, 16_384
#: Units from one random-access point to the next; ticks of the 90 kHz clock between units.
RANDOM_ACCESS, TICKS = 8, 3600
PID_MAP, PID_DATA = 0x1000, 0x0100
#: Fixed by the format: sync byte, private data stream type and id, CRC-32 polynomial.
SYNC, STREAM_TYPE, STREAM_ID, POLYNOMIAL = 0x47, 0x06, 0xBD, 0x04C11DB7
MEDIA = "doc_id long, n_bytes long, media binary, timestamps array<long>, access_offsets array<long>, access_times array<long>"
PARSED = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, timestamps array<long>, random_access array<long>, packets long, errors array<string>"


@lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    """The format's CRC-32: not reflected, starting with ones, without a final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ POLYNOMIAL if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


PAT = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PID_MAP).to_bytes(2, "big"))
PMT = _section(2, 1, (0xE000 | PID_DATA).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | PID_DATA).to_bytes(2, "big") + b"\xf0\x00")
_PLAIN = [bytes([SYNC, PID_DATA >> 8, PID_DATA & 255, 0x10 | c]) for c in range(16)]


def _stamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 14, t >> 22 & 255, 1 | t >> 14 & 254, t >> 7 & 255, 1 | t << 1 & 254])


def _clock(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([t >> 25, t >> 17 & 255, t >> 9 & 255, t >> 1 & 255, (t & 1) << 7 | 0x7E, 0])


def write_indexed(payload: bytes) -> tuple[bytes, list[int], list[int], list[int]]:
    """A payload's transport stream, its units' timestamps, and offset (of the tables before it) and timestamp of each random-access point."""
    out, counter, written, offsets = [], 0, 0, []
    for k, at in enumerate(range(0, len(payload), UNIT)):
        access = k % RANDOM_ACCESS == 0
        if access:
            offsets.append(written * PACKET)
            out += [_table_packet(0, PAT, k // RANDOM_ACCESS), _table_packet(PID_MAP, PMT, k // RANDOM_ACCESS)]
        unit = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * TICKS) + unit
        field = bytes([0x50 if access else 0x10]) + _clock(k * TICKS)
        room = PACKET - 5 - len(field)
        field += b"\xff" * max(0, room - len(pes))
        out.append(bytes([SYNC, 0x40 | PID_DATA >> 8, PID_DATA & 255, 0x30 | counter, len(field)]) + field + pes[:room])
        rest = pes[room:]
        full = len(rest) // 184
        out += [_PLAIN[counter + 1 + i & 15] + rest[184 * i : 184 * i + 184] for i in range(full)]
        counter = counter + 1 + full & 15
        tail = rest[184 * full :]
        if tail:
            gap = 183 - len(tail)
            out.append(bytes([SYNC, PID_DATA >> 8, PID_DATA & 255, 0x30 | counter, gap]) + (b"\x00" + b"\xff" * (gap - 1) if gap else b"") + tail)
            counter = counter + 1 & 15
        written += 2 * access + 1 + full + bool(tail)
    units = -(-len(payload) // UNIT)
    return b"".join(out), [k * TICKS for k in range(units)], offsets, [k * TICKS for k in range(0, units, RANDOM_ACCESS)]


def write_stream(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    return write_indexed(payload)[0]


def packets(media: bytes, errors: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The whole packets of a stream and their offsets. Where no packet begins, it goes on at the next sync byte that has another one a packet behind, or ends the stream."""
    n = len(media) // PACKET
    p = np.frombuffer(media, np.uint8, n * PACKET).reshape(-1, PACKET)
    if (p[:, 0] == SYNC).all():
        if len(media) % PACKET:
            errors.append("cut")
        return p, np.arange(n) * PACKET
    data, starts, at, lost, sure = np.frombuffer(media, np.uint8), [], 0, 0, False
    sync = np.flatnonzero(data == SYNC)
    begins = sync[(sync + PACKET == len(media)) | np.isin(sync + PACKET, sync, assume_unique=True)]
    while at + PACKET <= len(media):
        if data[at] == SYNC and sure:
            starts.append(at)
            at += PACKET
            continue
        k = int(np.searchsorted(begins, at))
        lost += sure or k == len(begins) or int(begins[k]) > at
        if k == len(begins):
            at = len(media)
            break
        at, sure = int(begins[k]), True
        starts.append(at)
        at += PACKET
    if lost:
        errors.append(f"sync: {lost}")
    if at < len(media):
        errors.append("cut")
    offset = np.array(starts, np.int64)
    return data[offset[:, None] + np.arange(PACKET)] if starts else p[:0], offset


#: Of a PID's packets with a payload: the packets, their offsets, where the payload starts, flags of the adaptation field, and whether the counter breaks before.
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def of_pid(p: np.ndarray, offset: np.ndarray, pid: int, errors: list[str]) -> Run:
    """The packets of a PID that have a payload, without those sent twice. A break of the counter is an error unless the packet marks it."""
    own = ((p[:, 1] & 31).astype(np.int32) << 8 | p[:, 2]) == pid
    own &= p[:, 3] & 0x10 > 0
    p, offset = p[own], offset[own]
    adapted = p[:, 3] & 0x20 > 0
    start = np.minimum(np.where(adapted, 5 + p[:, 4].astype(np.int32), 4), PACKET)
    flags = np.where(adapted & (p[:, 4] > 0), p[:, 5], 0)
    c = p[:, 3] & 15
    twice = [i for i in np.flatnonzero(c[1:] == c[:-1]) + 1 if start[i] == start[i - 1] and (p[i, start[i] :] == p[i - 1, start[i] :]).all()]
    if twice:
        p, offset, start, flags = (np.delete(x, twice, axis=0) for x in (p, offset, start, flags))
        c = p[:, 3] & 15
    broken = np.concatenate([[False], (c[1:] - c[:-1]) & 15 != 1]) if len(c) else np.zeros(0, bool)
    if unmarked := int((broken & (flags & 0x80 == 0)).sum()):
        errors.append(f"counter of PID {pid}: {unmarked}")
    return p, offset, start, flags, broken


def sections(run: Run, pid: int, table: int, errors: list[str]) -> dict[int, bytes]:
    """Table's bodies by section number (their first, if repeated), of sections that may begin anywhere in a packet and go over several; those with a wrong checksum are errors."""
    out: dict[int, bytes] = {}
    wrong, held = 0, b""

    def take(data: bytes) -> bytes:
        """What is left after the whole sections of data."""
        nonlocal wrong
        while len(data) >= 3 and data[0] != 0xFF:
            n = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
            if len(data) < n:
                return data
            section, data = data[:n], data[n:]
            if section[0] == table and n >= 12 and section[5] & 1:
                if crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
                    wrong += 1
                else:
                    out.setdefault(section[6], section[3:5] + section[8:-4])
        return b"" if data[:1] == b"\xff" else data

    seen: set[bytes] = set()
    for row, start, broken in zip(run[0], run[2], run[4]):
        data = row[start:].tobytes()
        if broken:
            held = b""
        if row[1] & 0x40 and data:
            pointer = data[0]
            if held:
                take(held + data[1 : 1 + pointer])
            fresh = data[1 + pointer :]
            held = b"" if fresh in seen else take(fresh)
            if not held:
                seen.add(fresh)
        elif held:
            held = take(held + data)
    if wrong or not out:
        errors.append(f"table of PID {pid}")
    return out


def programs(p: np.ndarray, offset: np.ndarray, errors: list[str]) -> dict[int, list[tuple[int, int]]]:
    """Program number -> (stream type, PID) of its streams, in the tables' order."""
    out: dict[int, list[tuple[int, int]]] = {}
    pat = sections(of_pid(p, offset, 0, errors), 0, 0, errors)
    maps: dict[int, list[int]] = {}
    for _, body in sorted(pat.items()):
        for i in range(2, len(body) - 3, 4):
            number, pid = int.from_bytes(body[i : i + 2], "big"), int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF
            if number:
                maps.setdefault(pid, []).append(number)
    for pid, numbers in maps.items():
        run = of_pid(p, offset, pid, errors)
        found: dict[int, bytes] = {}
        if len(numbers) == 1:
            found = {numbers[0]: next(iter(sections(run, pid, 2, errors).values()), b"")}
        else:  # several programs' maps in one PID
            for number in numbers:
                found[number] = _map_of(run, pid, number, errors)
        for number, body in found.items():
            out[number] = []
            at = 6 + (int.from_bytes(body[4:6], "big") & 0xFFF)
            while body and at + 5 <= len(body):
                out[number].append((body[at], int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF))
                at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    return out


def _map_of(run: Run, pid: int, number: int, errors: list[str]) -> bytes:
    """The map of one of several programs: packets whose section begins with its number."""
    p, _, start, _, _ = run
    own = [i for i in range(len(p)) if p[i, 1] & 0x40 and (d := p[i, start[i] :].tobytes()) and int.from_bytes(d[d[0] + 4 : d[0] + 6], "big") == number]
    own = sorted({j for i in own for j in range(i, next((k for k in range(i + 1, len(p)) if p[k, 1] & 0x40), len(p)))})
    part = tuple(x[own] for x in run)
    return next(iter(sections((*part[:4], np.zeros(len(own), bool)), pid, 2, errors).values()), b"")


#: Fixed by the format: ids of streams whose units have no header of their own.
_BARE = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))


def units(run: Run, errors: list[str]) -> tuple[list[bytes], list[int | None], list[int]]:
    """Payloads and timestamps (None without one) of a stream's units, and the offsets of the first packets of those that are random-access points."""
    p, offset, start, flags, broken = run
    first = np.flatnonzero(p[:, 1] & 0x40)
    if not len(first):
        return [], [], []
    stream = p[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(PACKET - start)
    begins = ends - (PACKET - start)
    payload: list[bytes] = []
    stamps: list[int | None] = []
    access: list[int] = []
    for k, i in enumerate(first):
        j = int(first[k + 1]) if k + 1 < len(first) else len(p)
        pes = stream[int(begins[i]) : int(ends[j - 1])]
        size = int.from_bytes(pes[4:6], "big") if len(pes) >= 6 else -1
        ok = pes[:3] == b"\x00\x00\x01" and size in (0, len(pes) - 6) and not broken[i + 1 : j].any()
        bare = ok and pes[3] in _BARE
        if not ok or not bare and (len(pes) < 9 or len(pes) < 9 + pes[8] or pes[7] & 0x80 and pes[8] < 5):
            errors.append(f"unit at {int(offset[i])}")
            continue
        t = pes[9:14]
        stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1 if not bare and pes[7] & 0x80 else None)
        payload.append(pes[6:] if bare else pes[9 + pes[8] :])
        if flags[i] & 0x40:
            access.append(int(offset[i]))
    return payload, stamps, access


def read_stream(media: bytes, program: int | None = None, pid: int | None = None) -> dict:
    """payload, timestamps (a unit's, in ticks, None if it has none), random_access (byte offsets of the units' first packets that are such points), packets, errors, programs.

    Of the first stream of the lowest program, or of the program or PID that is named. Lost bytes, tables with
    wrong checksums and unmarked breaks of a counter are errors; units that a break or a wrong length
    touches are left out. Units of length 0 go on to the next one.
    """
    errors: list[str] = []
    p, offset = packets(media, errors)
    out = {"payload": b"", "timestamps": [], "random_access": [], "packets": len(p), "errors": errors}
    if not len(p):
        return out | {"programs": {}}
    found = out["programs"] = programs(p, offset, errors)
    if pid is None:
        own = found.get(program if program is not None else min((k for k, v in found.items() if v), default=-1), [])
        if not own:
            return out
        pid = own[0][1]
    payload, stamps, access = units(of_pid(p, offset, pid, errors), errors)
    return out | {"payload": b"".join(payload), "timestamps": stamps, "random_access": access}


def read_from(media: bytes, access_offsets: list[int], access_times: list[int], first: int, last: int) -> dict:
    """read_stream of the part from the random-access point at or before time `first` up to the one behind time `last`: nothing else of the stream is parsed."""
    i = max(0, int(np.searchsorted(access_times, first, "right")) - 1)
    j = int(np.searchsorted(access_times, last, "right"))
    return read_stream(media[access_offsets[i] : access_offsets[j] if j < len(access_offsets) else len(media)])


def pad(text: str | None) -> bytes:
    """UTF-8, with bytes 0 up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\x00")


def to_media(docs: DataFrame) -> DataFrame:
    """MEDIA: each row's whole text, null as empty, padded, as a transport stream with its timestamps and random-access points. Equal texts give equal bytes; an empty table gives none."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                n = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                made = [write_indexed(pad(x.as_py())) for x in part.column(1)]
                lists = [pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array([m[0] for m in made], pa.binary()), *lists], ["doc_id", "n_bytes", "media", "timestamps", "access_offsets", "access_times"])

    return text_column(docs, "doc_id", "text").mapInArrow(go, MEDIA)


def from_media(media: DataFrame, payloads: bool = True) -> DataFrame:
    """PARSED from MEDIA, as far as it can be read; payloads=False leaves payload null. A null media is an empty stream."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                raw = [x or b"" for x in part.column(2).to_pylist()]
                got = [read_stream(x) for x in raw]
                cols = [[x["payload"] if payloads else None for x in got], [len(x) for x in raw], [hashlib.sha256(x).hexdigest() for x in raw], *([x[k] for x in got] for k in ("timestamps", "random_access", "packets", "errors"))]
                kinds = (pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "payload", "media_bytes", "media_sha256", "timestamps", "random_access", "packets", "errors"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(go, PARSED)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """DIGEST of stored MEDIA: what is read back, with a feature string of the stream's structure, its times and random-access points, and the payload's bytes.

    points: of each random-access point the stored offset of its tables and its timestamp; index tells whether the
    stored columns are what the stream itself says.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, raw, *index in zip(batch.column(1).to_pylist(), batch.column(2), *(c.to_pylist() for c in batch.columns[3:])):
                raw = raw.as_py()
                x = read_stream(raw)
                data = x["payload"]
                counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                stamps, points = x["timestamps"], " ".join(f"{o}@{t}" for o, t in zip(index[1], index[2]))
                same = stamps == index[0] and [o - 2 * PACKET for o in x["random_access"]] == index[1] and stamps[::RANDOM_ACCESS] == index[2]
                feature = f"packets={x['packets']} units={len(stamps)} last={max(stamps, default=-1)} access={len(x['random_access'])} errors={len(x['errors'])} index={'same' if same else 'differs'} sum={int(counts @ np.arange(256))} kinds={int(np.count_nonzero(counts))} zeros={int(counts[0])} points={points}"
                rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [c.split()[0] for c in DIGEST.split(", ")])

    return media.select("doc_id", "n_bytes", "media", "timestamps", "access_offsets", "access_times").mapInArrow(go, DIGEST)


def media_column(docs: DataFrame) -> DataFrame:
    """Store docs' texts as a media column in the shared folder, read it back and return its digests."""
    return digests(stored(to_media(docs), "media"))
