"""Ogg pages and Opus headers from ordered packets."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from .checksums import ogg_crc


def lacing(sizes: list[int]) -> bytes:
    return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)


def page(packets: list[bytes], serial: int, number: int, granule: int, last: bool = False) -> bytes:
    """A page of whole packets with its checksum. At most 255 lacing values."""
    table = lacing([len(p) for p in packets])
    if len(table) > 255:
        raise ValueError("over 255 lacing values")
    return _made((2 if number == 0 else 0) | (4 if last else 0), granule, serial, number, table, b"".join(packets))


def _made(flags: int, granule: int, serial: int, number: int, table: bytes, body: bytes) -> bytes:
    made = b"OggS" + struct.pack("<BBqIIIB", 0, flags, granule, serial, number, 0, len(table)) + table + body
    return made[:22] + struct.pack("<I", ogg_crc(made)) + made[26:]


def long_packet(packet: bytes, serial: int, number: int, granule: int, last: bool = False) -> list[bytes]:
    """The pages of one packet that may need over 255 lacing values. Pages on which no packet ends have granule -1."""
    table, out = lacing([len(packet)]), []
    for at in range(0, len(table), 255):
        ends = at + 255 >= len(table)
        flags = (1 if at else 0) | (2 if number + len(out) == 0 else 0) | (4 if last and ends else 0)
        out.append(_made(flags, granule if ends else -1, serial, number + len(out), table[at : at + 255], packet[at * 255 : (at + 255) * 255]))
    return out


def opus_head(channels: int, skip: int, rate: int) -> bytes:
    return b"OpusHead" + struct.pack("<BBHIhB", 1, channels, skip, rate, 0, 0)


def opus_tags(vendor: str, tags: dict[str, str]) -> bytes:
    text = [vendor.encode(), *(f"{k}={v}".encode() for k, v in tags.items())]
    sized = [struct.pack("<I", len(t)) + t for t in text]
    return b"OpusTags" + sized[0] + struct.pack("<I", len(sized) - 1) + b"".join(sized[1:])


def parse(data: bytes) -> list[tuple[int, int, int, list[bytes]]]:
    """serial, number, granule and the packets that end on each page; ValueError for a wrong checksum or a lost part of a packet."""
    out, at, parts = [], 0, {}
    while at < len(data):
        if data[at : at + 4] != b"OggS":
            raise ValueError("no page")
        _, flags, granule, serial, number, crc, n = struct.unpack_from("<BBqIIIB", data, at + 4)
        table = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(table)
        if ogg_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise ValueError("a page's checksum is wrong")
        if (flags & 1) != (serial in parts):
            raise ValueError("a continued packet lacks a part")
        packets, size, body = [], 0, at + 27 + n
        for v in table:
            size += v
            if v < 255:
                packets.append(b"".join([*parts.pop(serial, []), data[body : body + size]]))
                body, size = body + size, 0
        if n and table[-1] == 255:
            parts.setdefault(serial, []).append(data[body : body + size])
        out.append((serial, number, granule, packets))
        at = end
    if parts:
        raise ValueError("a continued packet lacks a part")
    return out


def paged(packets: DataFrame, stream: str, order: str, page_no: str, packet: str, granule: str) -> DataFrame:
    """stream, page, bytes: pages from packets whose (first) page is known. A page's packets are together; a stream's pages are not."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        serial, number, at = int(pdf[stream].iloc[0]) & 0xFFFFFFFF, int(pdf[page_no].iloc[0]), int(pdf[granule].iloc[-1])
        whole = [bytes(p) for p in pdf[packet]]
        made = long_packet(whole[0], serial, number, at) if len(whole) == 1 else [page(whole, serial, number, at)]
        return pd.DataFrame([(pdf[stream].iloc[0], number + k, x) for k, x in enumerate(made)], columns=["stream", "page", "bytes"])

    return packets.groupBy(stream, page_no).applyInPandas(run, "stream long, page long, bytes binary")
