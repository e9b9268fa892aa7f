"""Media columns as MPEG transport streams (ISO/IEC 13818-1): write, and parse with continuity checks.

A stream has a program association table, a program map table and one elementary stream of private data (8-bit samples)
in PES packets, each with a presentation timestamp and a random-access point. Packets are built and read as
NumPy arrays of 188-byte rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, PAT_PID, PMT_PID, DATA_PID, STREAM_TYPE, STREAM_ID = 188, 0, 0x1000, 0x0100, 0x06, 0xBD
#: Packets of a full PES packet, and the bytes it carries: 184 a packet, less the PES header and the adaptation field.
PES_PACKETS, PES_HEADER, ADAPTATION = 32, 14, 8
PES_BYTES = PES_PACKETS * 184 - PES_HEADER - ADAPTATION
CLOCK = 90_000


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([0x47]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section
    return np.frombuffer(head.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _clock_fields(pts: int, length: int) -> tuple[bytes, bytes]:
    """The adaptation field (random access, PCR) and the PES header (PTS) of an access unit."""
    base = pts & ((1 << 33) - 1)
    pcr = (base << 15 | 0x3F << 9).to_bytes(6, "big")
    stamp = bytes([0x21 | (base >> 29) & 0x0E]) + ((base >> 15 & 0x7FFF) << 1 | 1).to_bytes(2, "big") + ((base & 0x7FFF) << 1 | 1).to_bytes(2, "big")
    return bytes([ADAPTATION - 1, 0x50]) + pcr, b"\x00\x00\x01" + bytes([STREAM_ID]) + (length + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp


def encode(payload: bytes, rate: int = 8000) -> bytes:
    """The transport stream of 8-bit samples at `rate`."""
    data = np.frombuffer(payload, np.uint8)
    units = max(1, -(-len(data) // PES_BYTES))
    rows = [_PAT[None], _PMT[None]]
    sent = 0
    for u in range(units):
        body = data[u * PES_BYTES : (u + 1) * PES_BYTES]
        adaptation, header = _clock_fields(u * PES_BYTES * CLOCK // rate, len(body))
        content = np.concatenate([np.frombuffer(header, np.uint8), body])
        room = 184 - len(adaptation)
        if len(content) < room:  # one packet: its adaptation field takes the stuffing
            adaptation = bytes([ADAPTATION - 1 + room - len(content)]) + adaptation[1:] + b"\xff" * (room - len(content))
            room = len(content)
        rest = len(content) - room
        n = 1 + -(-rest // 184)
        out = np.empty((n, PACKET), np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (sent + np.arange(n)) & 15
        out[0, 3] |= 0x20
        out[0, 4 : 4 + len(adaptation)] = np.frombuffer(adaptation, np.uint8)
        out[0, 4 + len(adaptation) :] = content[:room]
        full = rest // 184
        out[1 : 1 + full, 4:] = content[room : room + full * 184].reshape(full, 184)
        if last := rest % 184:  # the last packet is stuffed by its adaptation field
            gap = 184 - last
            out[-1, 3] |= 0x20
            out[-1, 4] = gap - 1
            if gap > 1:
                out[-1, 5] = 0
                out[-1, 6 : 4 + gap] = 0xFF
            out[-1, 4 + gap :] = content[len(content) - last :]
        sent += n
        rows.append(out)
    return np.concatenate(rows).tobytes()


def _sections(own: np.ndarray) -> tuple[list[bytes], int]:
    """Whole sections with a right check sum in the packets of one table PID, in order, and the faults met.

    A section may span packets and a packet may hold several; a section that loses a packet, or whose fields lead out of
    its packet, is a fault and reading goes on at the next start.
    """
    out, faults, held, counter, before = [], 0, None, None, b""
    for row in own:
        raw = row.tobytes()
        if not raw[3] & 0x10:
            continue
        now, at = raw[3] & 15, 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        if raw == before:
            continue
        before = raw
        if held is not None and counter is not None and now != (counter + 1) & 15:
            held, faults = None, faults + 1
        counter = now
        if at >= PACKET:
            held, faults = None, faults + 1
            continue
        begins: int | None = None
        if raw[1] & 0x40:
            begins, at = at + 1 + raw[at], at + 1
            if begins > PACKET:
                held, faults = None, faults + 1
                continue
        if held is not None:
            held += raw[at : begins if begins is not None else PACKET]
        while True:
            if held is None and begins is not None and begins < PACKET and raw[begins] != 0xFF:
                held, begins = raw[begins:], None
            if held is None or len(held) < 3:
                break
            size = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) < size:
                if begins is None:
                    break  # goes on in the next packet
                held, faults = None, faults + 1
                continue
            section, rest = held[:size], held[size:]
            if size >= 12 and crc32_mpeg(section) == 0:
                out.append(section)
            else:
                faults += 1
            held = rest if begins is None and rest and rest[0] != 0xFF else None
            if held is None and begins is None:
                break
    return out, faults


def _programs(section: bytes) -> list[tuple[int, int]]:
    """(program, PID of its map) of a program association section."""
    if section[0] != 0:
        return []
    pairs = [(int.from_bytes(section[k : k + 2], "big"), int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF) for k in range(8, len(section) - 7, 4)]
    return [p for p in pairs if p[0]]


def _map(section: bytes) -> list[tuple[int, int, int]]:
    """(program, stream type, PID) of a program map section."""
    out = []
    if section[0] == 2 and len(section) >= 16:
        k = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
        while k + 5 <= len(section) - 4:
            out.append((int.from_bytes(section[3:5], "big"), section[k], int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF))
            k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0x0FFF)
    return out


def _elementary(own: np.ndarray) -> dict:
    """Payload, timestamps, random-access points and faults of one elementary stream's packets."""
    has_field, has_data = own[:, 3] & 0x20 > 0, own[:, 3] & 0x10 > 0
    long = has_field & (own[:, 4].astype(np.int32) > 183 - has_data)
    faults = int(long.sum())
    start = np.where(has_field, 5 + own[:, 4].astype(np.int32), 4)
    start = np.where(has_data, np.minimum(start, PACKET), PACKET)
    # a repeated packet has the counter and the data of the one before it; the second repeat is a fault
    data = np.flatnonzero(has_data)
    step = np.diff(own[data, 3].astype(np.int32) & 15, prepend=(own[data[:1], 3].astype(np.int32) & 15) - 1) & 15
    keep = np.ones(len(own), bool)
    repeats = 0
    for k in np.flatnonzero(step[1:] == 0) + 1:
        a, b = own[data[k - 1]], own[data[k]]
        s = int(start[data[k]])
        if s == start[data[k - 1]] and (a[s:] == b[s:]).all() and (a[1] ^ b[1]) & 0x40 == 0:
            keep[data[k]] = False
            repeats += 1
            faults += int(not keep[data[k - 1]])
            step[k] = 1
    jumps = has_field & (own[:, 4] > 0) & (own[:, 5] & 0x80 > 0)  # announced discontinuities
    faults += int(((step != 1) & ~jumps[data]).sum())
    own, start, has_field = own[keep], start[keep], has_field[keep]
    bytes_of = PACKET - start
    flat = own[np.arange(PACKET)[None, :] >= start[:, None]]
    ends = np.cumsum(bytes_of)
    first = np.flatnonzero(own[:, 1] & 0x40)
    random = has_field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    payload, stamps, access = [], [], []
    if len(flat) and (not len(first) or int(ends[first[0]] - bytes_of[first[0]]) > 0):
        faults += 1  # data before the first start of a unit belongs to none
    for k, row in enumerate(first):
        a = int(ends[row] - bytes_of[row])
        b = int(ends[first[k + 1]] - bytes_of[first[k + 1]]) if k + 1 < len(first) else len(flat)
        unit = flat[a:b]
        if len(unit) < 9 or tuple(unit[:3]) != (0, 0, 1):
            faults += 1
            continue
        size = int(unit[4]) << 8 | int(unit[5])
        if size and size != len(unit) - 6:
            faults += 1
        if unit[7] & 0x80 and len(unit) >= 14:
            x = [int(v) for v in unit[9:14]]
            stamps.append((x[0] >> 1 & 7) << 30 | x[1] << 22 | (x[2] >> 1) << 15 | x[3] << 7 | x[4] >> 1)
        else:
            stamps.append(None)
        if random[row]:
            access.append(len(stamps) - 1)
        payload.append(unit[9 + int(unit[8]) : 6 + size if size else len(unit)])
    joined = np.concatenate(payload).tobytes() if payload else b""
    return {"payload": joined, "timestamps": stamps, "random_access": access, "repeats": repeats, "faults": faults}


def parse(stream: bytes | None) -> dict:
    """Programs, elementary streams with their timestamps and random-access points, and faults of a transport stream.

    Every valid section of the association table and of the program maps counts, wherever it stands, and the first that
    names a program or stream decides. Sections may span packets. Legal repeats of a packet are dropped without a fault,
    and a counter may jump where the packet announces a discontinuity. Bytes after the last whole packet, packets without a sync
    byte or flagged as damaged, wrong continuity counters, damaged sections and units are counted as faults; data
    after a fault is kept. Null or empty gives no stream.
    """
    packets = np.frombuffer(stream or b"", np.uint8)
    n = len(packets) // PACKET
    faults = int(len(packets) != n * PACKET)
    packets = packets[: n * PACKET].reshape(n, PACKET)
    good = (packets[:, 0] == 0x47) & (packets[:, 1] & 0x80 == 0)
    faults += int(n - good.sum())
    packets = packets[good]
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    programs: dict[int, int] = {}
    sections, bad = _sections(packets[pids == PAT_PID])
    faults += bad
    for section in sections:
        for program, pid in _programs(section):
            programs.setdefault(program, pid)
    streams: dict[int, tuple[int, int]] = {}
    for pid in dict.fromkeys(programs.values()):
        sections, bad = _sections(packets[pids == pid])
        faults += bad
        for section in sections:
            for program, kind, own in _map(section):
                if programs.get(program) == pid:
                    streams.setdefault(own, (program, kind))
    found = []
    for pid, (program, kind) in streams.items():
        one = _elementary(packets[pids == pid])
        faults += one.pop("faults")
        found.append({"program": program, "pid": pid, "type": kind, "units": len(one["timestamps"]), **one})
    return {"programs": len(programs), "packets": n, "faults": faults, "elementary": found}


def padded(text: str | None) -> bytes:
    """UTF-8 of the text with spaces up to a positive multiple of 192 bytes."""
    raw = (text or "").encode()
    return raw.ljust(max(192, -(-len(raw) // 192) * 192))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded bytes as a transport stream.

    Null and empty texts give one unit of spaces, very long ones as many units as they need. Null ids and repeated rows
    are rows like others; other columns are ignored, whatever their names.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def write(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                texts = part["text"].to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return src.mapInArrow(write, f"doc_id {kind}, n_bytes long, media binary")


def parse_media(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """rows with what their stored streams hold: programs, packets, faults and elementary, one entry for each elementary
    stream (program, pid, type, units, payload, timestamps, random_access, repeats).

    Null and empty streams have no entry; a stream that can't be parsed gives its faults, never an error. Columns of rows
    with one of these names give way; equal streams, equal values.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(
        "programs int, packets long, faults long, elementary array<struct<program:int,pid:int,type:int,units:long,payload:binary,timestamps:array<long>,random_access:array<int>,repeats:long>>"
    )
    kept = StructType([f for f in rows.schema.fields if f.name not in added.names])
    fields = to_arrow_schema(added)

    def read(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                found = [parse(x) for x in part[media_col].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in kept.names), *(pa.array([x[f.name] for x in found], f.type) for f in fields)], names=[*kept.names, *added.names]
                )

    return rows.select(*kept.names).mapInArrow(read, StructType(kept.fields + added.fields))
