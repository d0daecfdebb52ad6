"""Media columns: MPEG transport streams written and read with numpy, a document at a time.

The muxer stores a payload as one private elementary stream: program tables, PES packets with
90 kHz presentation timestamps, random-access points with a clock reference. The demuxer takes any
stream of 188-byte packets: it parses the program tables, checks continuity counters, puts the
elementary packets together again and lists timestamps and random-access points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import small_batches, utf8

PACKET, BODY = 188, 184
PAT_PID, PMT_PID, MEDIA_PID = 0, 0x1000, 0x100
PRIVATE_DATA = 0x06
PES_HEADER = 14
UNIT_BYTES = 4096
UNITS_PER_ACCESS = 8
TICKS = 3600
BLOCK_BYTES = 64


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program table sections (most significant bit first, not inverted)."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    packet = b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), dtype=np.uint8)


_PAT = _table_packet(PAT_PID, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, 1, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamps(pts: np.ndarray) -> np.ndarray:
    """The five bytes of each 33-bit timestamp."""
    out = np.empty((len(pts), 5), dtype=np.uint8)
    out[:, 0] = 0x21 | (pts >> 29) & 0x0E
    out[:, 1] = pts >> 22 & 0xFF
    out[:, 2] = 0x01 | pts >> 14 & 0xFE
    out[:, 3] = pts >> 7 & 0xFF
    out[:, 4] = 0x01 | pts << 1 & 0xFE
    return out


def mux(payload: bytes) -> bytes:
    """Store a payload without loss as a transport stream; an empty payload gives the tables alone."""
    data = np.frombuffer(payload, dtype=np.uint8)
    units = -(-len(data) // UNIT_BYTES)
    if not units:
        return _PAT.tobytes() + _PMT.tobytes()
    unit = np.arange(units)
    length = np.minimum(UNIT_BYTES, len(data) - unit * UNIT_BYTES)
    access = unit % UNITS_PER_ACCESS == 0
    pts = unit * TICKS % (1 << 33)
    # The elementary packets: a header, then the bytes of the unit.
    pes = np.zeros((units, PES_HEADER), dtype=np.uint8)
    pes[:, :9] = (0, 0, 1, 0xBD, 0, 0, 0x84, 0x80, 5)
    pes[:, 4], pes[:, 5] = length + 8 >> 8, length + 8 & 0xFF
    pes[:, 9:] = _stamps(pts)
    # An access unit begins with 8 bytes of adaptation field: length, flags, clock reference.
    room_first = np.where(access, BODY - 8, BODY)
    total = length + PES_HEADER
    packets = 1 + -(-np.maximum(0, total - room_first) // BODY)
    first = np.cumsum(packets) - packets + 2 * np.cumsum(access)
    n = int(packets.sum() + 2 * access.sum())
    out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
    tables = first[access] - 2
    out[tables], out[tables + 1] = _PAT, _PMT
    out[tables, 3] = out[tables + 1, 3] = 0x10 | np.arange(len(tables)) % 16
    is_media = np.ones(n, dtype=bool)
    is_media[tables] = is_media[tables + 1] = False
    at = np.flatnonzero(is_media)
    owner = np.repeat(unit, packets)
    nth = at - first[owner]
    begin = nth == 0
    room = np.where(begin, room_first[owner], BODY)
    done = np.where(begin, 0, room_first[owner] + (nth - 1) * BODY)
    fill = np.minimum(room, total[owner] - done)
    stuffing = room - fill
    adapted = (stuffing > 0) | begin & access[owner]
    out[at, 0] = 0x47
    out[at, 1] = np.where(begin, 0x40, 0) | MEDIA_PID >> 8
    out[at, 2] = MEDIA_PID & 0xFF
    out[at, 3] = np.where(adapted, 0x30, 0x10) | np.arange(len(at)) % 16
    out[at[adapted], 4] = (BODY - 1 - fill)[adapted]
    flags = adapted & (fill < BODY - 1)
    out[at[flags], 5] = 0
    clock = at[begin & access[owner]]
    out[clock, 5] = 0x50
    base = pts[access]
    for i, shift in enumerate((25, 17, 9, 1)):
        out[clock, 6 + i] = base >> shift & 0xFF
    out[clock, 10], out[clock, 11] = (base & 1) << 7 | 0x7E, 0
    stream = b"".join(pes[u].tobytes() + payload[u * UNIT_BYTES : (u + 1) * UNIT_BYTES] for u in range(units))
    body = np.zeros((n, PACKET), dtype=bool)
    body[at] = np.arange(PACKET) >= (PACKET - fill)[:, None]
    out[body] = np.frombuffer(stream, dtype=np.uint8)
    return out.tobytes()


def _sections(packets, start, pusi, wanted: int):
    """Whole, valid sections of one table carried on one PID."""
    data = b""
    for packet, s, first in zip(packets, start, pusi):
        body = packet[s:].tobytes()
        if first:
            pointer = body[0] if body else 0
            data += body[1 : 1 + pointer]
            yield from _cut(data, wanted)
            data = body[1 + pointer :]
        elif data:
            data += body
    yield from _cut(data, wanted)


def _cut(data: bytes, wanted: int):
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)
        if len(data) < size:
            return
        if data[0] == wanted and size >= 12 and section_crc(data[:size]) == 0:
            yield data[:size]
        data = data[size:]


def demux(media: bytes) -> dict:
    """Programs, streams, timestamps, random-access points and payload of a transport stream.

    Bytes before the first packet that another sync byte follows are skipped and rows without one
    are dropped; both count as ``sync_errors``. A counter that doesn't follow its predecessor counts
    in ``cc_errors``; a packet sent twice is used once. Scrambled and erroneous packets are left out.
    ``payload`` joins the elementary packets of all streams that the program tables name, by PID.
    """
    out = {"programs": [], "streams": [], "packets": 0, "sync_errors": 0, "cc_errors": 0, "pes": 0, "pts": [], "access": [], "payload": b""}
    raw = np.frombuffer(media, dtype=np.uint8)
    skip = next((int(o) for o in np.flatnonzero(raw[:PACKET] == 0x47) if o + PACKET >= len(raw) or raw[o + PACKET] == 0x47), len(raw))
    rows = raw[skip : skip + (len(raw) - skip) // PACKET * PACKET].reshape(-1, PACKET)
    good = rows[:, 0] == 0x47
    out["sync_errors"] = int(skip > 0) + int((~good).sum())
    rows = rows[good]
    out["packets"] = len(rows)
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    pusi, control, counter = rows[:, 1] & 0x40 > 0, rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    usable = (rows[:, 1] & 0x80 == 0) & (rows[:, 3] & 0xC0 == 0) & (control & 1 > 0)
    adapted = control & 2 > 0
    start = np.where(adapted, 5 + rows[:, 4].astype(np.int32), 4)
    flags = np.where(adapted & (rows[:, 4] > 0), rows[:, 5], 0)
    usable &= start < PACKET
    by_pid = {}
    for p in set(pid.tolist()) - {0x1FFF}:
        at = np.flatnonzero((pid == p) & usable)
        step = (counter[at[1:]].astype(np.int32) - counter[at[:-1]]) & 15
        odd = np.flatnonzero(step != 1)
        if len(odd):
            twice = (step[odd] == 0) & (rows[at[odd + 1], 4:] == rows[at[odd], 4:]).all(axis=1)
            out["cc_errors"] += int((~twice & (flags[at[odd + 1]] & 0x80 == 0)).sum())
            usable[at[odd + 1][twice]] = False
            at = at[usable[at]]
        by_pid[int(p)] = at
    of = lambda p: by_pid.get(p, np.empty(0, dtype=np.int64))
    maps = {}
    for s in _sections(rows[of(PAT_PID)], start[of(PAT_PID)], pusi[of(PAT_PID)], 0):
        for i in range(8, len(s) - 4, 4):
            if number := int.from_bytes(s[i : i + 2], "big"):
                maps[number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    streams = {}
    for number, p in sorted(maps.items()):
        for s in _sections(rows[of(p)], start[of(p)], pusi[of(p)], 2):
            i = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
            while i + 5 <= len(s) - 4:
                streams[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = (number, s[i])
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0x0FFF)
    out["programs"] = sorted(maps.items())
    out["streams"] = [(p, *streams[p]) for p in sorted(streams)]
    kept = []
    for p in sorted(streams):
        at = of(p)
        at = at[np.cumsum(pusi[at]) > 0]
        if not len(at):
            continue
        mask = np.arange(PACKET) >= start[at][:, None]
        data = rows[at][mask].tobytes()
        before = np.cumsum(PACKET - start[at]) - (PACKET - start[at])
        begin = np.flatnonzero(pusi[at])
        ends = np.r_[before[begin[1:]], len(data)]
        for k, s, e in zip(begin, before[begin], ends):
            pes = data[s:e]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                continue
            size = int.from_bytes(pes[4:6], "big")
            pes = pes[: 6 + size] if size else pes
            stamp = -1
            if pes[7] & 0x80 and len(pes) >= PES_HEADER:
                t = pes[9:14]
                stamp = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
            if flags[at[k]] & 0x40:
                out["access"].append(out["pes"])
            out["pts"].append(stamp)
            out["pes"] += 1
            kept.append(pes[9 + pes[8] :])
    out["payload"] = b"".join(kept)
    return out


def _mux_rows(batches):
    for batch in small_batches(batches):
        offsets, data = utf8(batch.column(1))
        media, sizes = [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            text = bytes(data[a:b])
            sizes.append(len(text))
            media.append(mux(text + bytes(-len(text) % BLOCK_BYTES if text else BLOCK_BYTES)))
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every text (null: empty), zero-filled to a positive multiple of 64
    bytes, as a transport stream. Extra columns are ignored; repeated rows give repeated rows."""
    return docs.select("doc_id", "text").mapInArrow(_mux_rows, "doc_id long, n_bytes long, media binary")


_PARSED = "programs array<struct<program:int,pmt_pid:int>>, streams array<struct<pid:int,program:int,type:int>>, packets long, sync_errors long, cc_errors long, pes long, pts array<long>, access array<long>, payload binary"
_ARROW = pa.struct([("programs", pa.list_(pa.struct([("program", pa.int32()), ("pmt_pid", pa.int32())]))), ("streams", pa.list_(pa.struct([("pid", pa.int32()), ("program", pa.int32()), ("type", pa.int32())]))), *((k, pa.int64()) for k in ("packets", "sync_errors", "cc_errors", "pes")), ("pts", pa.list_(pa.int64())), ("access", pa.list_(pa.int64())), ("payload", pa.binary())])


def _demux_rows(batches):
    for batch in small_batches(batches):
        offsets, data = utf8(batch.column(batch.schema.get_field_index("media")))
        rows = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            x = demux(bytes(data[a:b]))
            x["programs"] = [{"program": n, "pmt_pid": p} for n, p in x["programs"]]
            x["streams"] = [{"pid": p, "program": n, "type": t} for p, n, t in x["streams"]]
            rows.append(x)
        yield pa.RecordBatch.from_arrays([*batch.columns, *pa.array(rows, _ARROW).flatten()], names=[*batch.schema.names, *(f.name for f in _ARROW)])


def parse_media(media: DataFrame) -> DataFrame:
    """The columns of ``media`` (one of them the binary ``media``; null: no packets) and what
    :func:`demux` finds in each stream. Columns named like the new ones are replaced; an empty stream has
    no packets; repeated rows give repeated rows, no rows none."""
    media = media.drop(*(f.name for f in _ARROW))
    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(_demux_rows, f"{have}, {_PARSED}")


def media_features(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: digests of the payload read back and of the stored stream, and a feature
    string of tables, packets, counters, timestamps and random-access points. Null texts count as empty;
    equal texts give equal values; texts of any length are taken whole; extra columns are ignored."""
    parsed = parse_media(to_media(docs))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("programs="), F.concat_ws(",", F.transform("programs", lambda p: F.concat_ws(":", p.program.cast("string"), p.pmt_pid.cast("string"))))),
        F.concat(F.lit("streams="), F.concat_ws(",", F.transform("streams", lambda s: F.concat_ws(":", s.pid.cast("string"), s.type.cast("string"))))),
        *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("packets", "sync_errors", "cc_errors", "pes")),
        F.concat(F.lit("pts="), F.concat_ws("..", F.array_min("pts").cast("string"), F.array_max("pts").cast("string"))),
        F.concat(F.lit("access="), F.size("access").cast("string")),
    )
    size = F.octet_length("payload")
    tail = F.expr("substring(payload, greatest(octet_length(payload) - 63, 1), 64)")
    return parsed.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
