"""ZIP packages by ranges: the end record and the directory first, then only the members that
are asked for. Nothing here knows Spark; a package is a function that reads a range.

Every budget is tested before what it bounds is read or kept in memory. A package that is
not quite in order is refused, since another reader could see other members in it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

MIB = 1 << 20
#: Bytes of a directory that are read at once.
STEP = 1 << 16
# Signatures and layouts of the records (sizes include the signatures).
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_REST, END64_REST, LOCATOR_REST = struct.Struct("<4H2LH"), struct.Struct("<Q2H2L4Q"), struct.Struct("<LQL")
CENTRAL_REST, LOCAL_REST = struct.Struct("<6H3L5H2L"), struct.Struct("<5H3L2H")
LONGEST_COMMENT = 65_535
COMPOUND = bytes.fromhex("D0CF11E0A1B11AE1")
FULL16, FULL32 = 0xFFFF, 0xFFFF_FFFF

Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Limits:
    """Budgets of one archive, tested before anything is unpacked."""

    entries: int = 4096
    archive_bytes: int = 256 * MIB
    expanded_bytes: int = 512 * MIB
    entry_bytes: int = 128 * MIB
    ratio: float = 1000.0
    directory_bytes: int = 16 * MIB


class Refused(Exception):
    """What is wrong with a package, with a finding's code and the member's name."""

    def __init__(self, code: str, message: str, name: str | None = None):
        super().__init__(message)
        self.code, self.message, self.name = code, message, name


def disordered(what: str) -> Refused:
    return Refused("PKG002", f"not a readable ZIP package: {what}")


@dataclass(frozen=True)
class Entry:
    name: str
    part: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    at: int

    @property
    def is_dir(self) -> bool:
        return self.name.endswith("/")


def part_name(name: str, is_dir: bool = False) -> str | None:
    """The compared form of a member's name, or None if it is unsafe: percent escapes decoded,
    A-Z in lower case, no drive, no leading slash, no empty or dotted segment."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", name):
        return None
    try:
        plain = unquote_to_bytes(name).decode()
    except UnicodeDecodeError:
        return None
    plain = plain.removesuffix("/") if is_dir else plain
    if re.search(r"[\0\\]", plain) or re.match("[A-Za-z]:/", plain) or any(s in ("", ".", "..") for s in plain.split("/")):
        return None
    return re.sub("[A-Z]+", lambda m: m[0].lower(), plain)


def exactly(read: Read, at: int, n: int, what: str) -> bytes:
    data = read(at, n) if at >= 0 else b""
    if len(data) != n:
        raise disordered(f"{what} is cut short")
    return data


def directory_place(read: Read, size: int) -> tuple[int, int, int]:
    """(start, bytes, entries) of the directory, as the records at the end of the file say."""
    low = max(0, size - LONGEST_COMMENT - 4 - END_REST.size)
    tail = exactly(read, low, size - low, "the file")
    found = tail.rfind(END)
    body = tail[found + 4 : found + 4 + END_REST.size]
    if found < 0 or len(body) < END_REST.size:
        if read(0, len(COMPOUND)) == COMPOUND:
            raise disordered("an OLE compound file, so an encrypted document or one of an old binary format")
        raise disordered("no end record")
    disk, first_disk, here, count, length, start, comment = END_REST.unpack(body)
    over = size - (low + found + 4 + END_REST.size + comment)
    if over:
        raise disordered(f"{over} byte(s) after the end record" if over > 0 else "the comment of the end record is cut short")
    if disk or first_disk:
        raise disordered("it spans several disks")
    end = low + found  # where the directory must stop
    mark = 4 + LOCATOR_REST.size
    if end >= mark and read(end - mark, 4) == LOCATOR:
        on, record, disks = LOCATOR_REST.unpack(exactly(read, end - mark + 4, LOCATOR_REST.size, "the ZIP64 locator"))
        end = end - mark - 4 - END64_REST.size
        if on or disks != 1:
            raise disordered("its ZIP64 records span several disks")
        if record != end:
            raise disordered("the ZIP64 end record is not where its locator says, or is extended")
        if exactly(read, end, 4, "the ZIP64 end record") != END64:
            raise disordered("no ZIP64 end record")
        wide = END64_REST.unpack(exactly(read, end + 4, END64_REST.size, "the ZIP64 end record"))
        if wide[0] != END64_REST.size - 8:
            raise disordered("the ZIP64 end record is extended")
        if wide[3] or wide[4]:
            raise disordered("its ZIP64 records span several disks")
        narrow = ((here, FULL16), (count, FULL16), (length, FULL32), (start, FULL32))
        if any(x not in (full, y) for (x, full), y in zip(narrow, wide[5:])):
            raise disordered("its two end records disagree")
        here, count, length, start = wide[5:]
    if here != count:
        raise disordered("its entry counts disagree")
    if start + length != end or (not length and (count or start)):
        raise disordered("the directory is not where the end record says")
    return start, length, count


def _wide(fields: list[int], extra: bytes) -> list[int]:
    """size, packed size and place with those that are too large taken from the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4)) if at + 4 + n <= len(extra) else iter(())
            try:
                return [next(values) if x == FULL32 else x for x in fields]
            except StopIteration:
                raise disordered("a ZIP64 field is cut short") from None
        at += 4 + n
    return fields


def directory(read: Read, size: int, limits: Limits = Limits()) -> Iterator[Entry]:
    """The entries in their order, each once all budgets up to it are met."""
    if size > limits.archive_bytes:
        raise Refused("PKG007", f"the archive has {size} bytes, more than {limits.archive_bytes}")
    start, length, count = directory_place(read, size)
    if count > limits.entries:
        raise Refused("PKG007", f"the archive has {count} entries, more than {limits.entries}")
    if length > limits.directory_bytes:
        raise Refused("PKG007", f"the directory has {length} bytes, more than {limits.directory_bytes}")
    held, at, seen, total, parts = b"", start, 0, 0, {}

    def take(n: int) -> bytes:
        nonlocal held, at
        while len(held) < n:
            step = min(STEP, start + length - at)
            if not step:
                raise disordered("an entry goes beyond the directory")
            held += exactly(read, at, step, "the directory")
            at += step
        out, held = held[:n], held[n:]
        return out

    while held or at < start + length:
        if take(4) != CENTRAL:
            raise disordered("an entry of the directory has no signature")
        head = CENTRAL_REST.unpack(take(CENTRAL_REST.size))
        flags, method, crc, packed, expanded = head[2], head[3], head[6], head[7], head[8]
        seen += 1
        if seen > min(count, limits.entries):
            raise disordered("the directory has more entries than the end record says")
        raw, extra, _ = take(head[9]), take(head[10]), take(head[11])
        try:
            name = raw.decode("utf-8" if flags & 0x800 else "cp437")
        except UnicodeDecodeError:
            raise disordered("a member's name can't be decoded") from None
        expanded, packed, place = _wide([expanded, packed, head[15]], extra)
        if head[12]:
            raise disordered("a member is on another disk")
        if place >= start:
            raise disordered("a member starts inside the directory")
        part = part_name(name, name.endswith("/"))
        if part is None:
            raise Refused("PKG008", f"unsafe member name {name!r}", name)
        if part in parts:
            raise Refused("PKG008", f"member names {parts[part]!r} and {name!r} are the same part", name)
        parts[part] = name
        total += expanded
        if expanded > limits.entry_bytes:
            raise Refused("PKG007", f"{name} expands to {expanded} bytes, more than {limits.entry_bytes}", name)
        if total > limits.expanded_bytes:
            raise Refused("PKG007", f"the members up to {name} expand to {total} bytes, more than {limits.expanded_bytes}", name)
        if expanded > limits.ratio * packed:
            raise Refused("PKG007", f"{name} expands more than {limits.ratio:g} times", name)
        yield Entry(name, part, method, flags, crc, packed, expanded, place)
    if seen != count:
        raise disordered(f"the directory has {seen} entries, the end record says {count}")


def member(read: Read, e: Entry) -> bytes:
    """The bytes of a member, tested against the directory's size and checksum."""
    head = exactly(read, e.at, 4 + LOCAL_REST.size, e.name)
    if head[:4] != LOCAL:
        raise Refused("PKG001", f"{e.name} is corrupt: no local record", e.name)
    if e.flags & 1:
        raise Refused("PKG002", f"{e.name} is encrypted", e.name)
    local = LOCAL_REST.unpack(head[4:])
    name = exactly(read, e.at + len(head), local[8], e.name)
    if name.decode("utf-8" if e.flags & 0x800 else "cp437", "replace") != e.name:
        raise Refused("PKG001", f"{e.name} is corrupt: its local record has another name", e.name)
    packed = exactly(read, e.at + len(head) + local[8] + local[9], e.packed, e.name)
    if e.method == 0:
        data = packed
    elif e.method == 8:
        inflate = zlib.decompressobj(-15)
        try:
            data = inflate.decompress(packed, e.size + 1)  # no more than it says
        except zlib.error as error:
            raise Refused("PKG001", f"{e.name} is corrupt: {error}", e.name) from None
    else:
        raise Refused("PKG002", f"{e.name} is packed by a method ({e.method}) that isn't read", e.name)
    if len(data) != e.size or zlib.crc32(data) != e.crc:
        raise Refused("PKG001", f"{e.name} is corrupt: its size or checksum is wrong", e.name)
    return data
