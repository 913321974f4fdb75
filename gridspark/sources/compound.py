"""Streams of compound files, the container of older embedded objects: a helper for one file's bytes."""

from __future__ import annotations

import struct
import uuid

#: Bounds of what one file may hold.
MOST_ENTRIES, MOST_STREAM = 256, 16 << 20

_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA  # this and above number no sector


def _chained(table: list[int], start: int, most: int) -> list[int]:
    """The sectors of a chain; one that meets itself ends there."""
    out, seen = [], set()
    while start < min(len(table), _END) and start not in seen and len(out) < most:
        seen.add(start)
        out.append(start)
        start = table[start]
    return out


def streams_of(data: bytes) -> tuple[str | None, list[tuple[str, bytes]]] | None:
    """(class id of the root, named streams), None if the bytes are no compound file.

    Only the first MOST_ENTRIES entries count, storages included; streams that
    are longer than MOST_STREAM or have no name are left out.
    """
    data = bytes(data)
    try:
        if data[:8] != _MAGIC:
            return None
        shift, small_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12):
            return None
        size, small = 1 << shift, 1 << small_shift
        directory, _, cutoff, small_table, _, more, n_more = struct.unpack_from("<7I", data, 48)
        numbers = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
        sector = lambda n: data[(n + 1) * size : (n + 2) * size]
        most = len(data) // size + 1
        lists = list(struct.unpack_from("<109I", data, 76))
        for _ in range(min(n_more, most)):
            if more >= _END or not (entries := numbers(sector(more))):
                break
            lists += entries[:-1]
            more = entries[-1]
        table = [x for n in lists if n < min(_END, most) for x in numbers(sector(n))]
        joined = lambda start: b"".join(map(sector, _chained(table, start, most)))
        entries = joined(directory)[: MOST_ENTRIES * 128]
        small_numbers, store, root, out = numbers(joined(small_table)), b"", None, []
        for at in range(0, len(entries) - 127, 128):
            length, kind = struct.unpack_from("<HB", entries, at + 64)
            name = entries[at : at + min(max(length - 2, 0), 62)].decode("utf-16-le", "replace")
            start, full = struct.unpack_from("<IQ", entries, at + 116)
            full &= 0xFFFFFFFF if shift == 9 else (1 << 64) - 1
            if kind == 5:
                given = uuid.UUID(bytes_le=entries[at + 80 : at + 96])
                root, store = (None if given.int == 0 else str(given)), joined(start)
            elif kind == 2 and name and full <= MOST_STREAM:
                if full < cutoff:
                    body = b"".join(store[n * small : (n + 1) * small] for n in _chained(small_numbers, start, len(store) // small + 1))
                else:
                    body = joined(start)
                out.append((name, body[:full]))
        return root, out
    except (struct.error, ValueError, IndexError):
        return None
