"""Compound files: sectors, allocation chains, directory and streams, read without trusting any declared length, and a writer for tests and rendered tables.

Every fault is recorded, none raises: a chain that loops or leaves the file ends there. Each byte of a file belongs to one class.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT_MARK, DIFAT_MARK, NONE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC, 0xFFFFFFFF
STORAGE, STREAM, ROOT = 1, 2, 5
#: Caps of a file's sectors, directory entries and table sectors; their own values are allowed.
MAX_SECTORS, MAX_ENTRIES, MAX_DIFAT = 1 << 20, 1 << 16, 256
#: Classes of bytes, the first that claims a sector has it.
CLASSES = ("header", "difat", "fat", "minifat", "directory", "ministream", "stream", "free", "unaccounted")


@dataclass
class Entry:
    path: str
    kind: int
    start: int
    size: int


@dataclass
class Compound:
    error: str | None = None
    version: int = 0
    sector_size: int = 0
    sectors: int = 0
    entries: list[Entry] = field(default_factory=list)
    faults: list[tuple[str, str]] = field(default_factory=list)
    accounting: dict[str, int] = field(default_factory=dict)
    streams: dict[str, bytes] = field(default_factory=dict)
    long_difat: bool = False

    def get(self, path: str) -> bytes | None:
        """A stream by its path; names are compared without case."""
        return self.streams.get(path.lower())


def chain(table: list[int], start: int, limit: int) -> tuple[list[int], str | None]:
    """Sectors from ``start`` on, and the fault that ended the chain early."""
    out: list[int] = []
    seen: set[int] = set()
    at = start
    while at != END:
        if at >= limit or at >= len(table):
            return out, "out_of_range"
        if at in seen:
            return out, "cycle"
        seen.add(at)
        out.append(at)
        at = table[at]
    return out, None


def read(raw: bytes) -> Compound:
    """The compound file in ``raw``; ``error`` says why there is none."""
    if len(raw) < 512 or raw[:8] != MAGIC:
        return Compound(error="no_header")
    version, order, shift, mini_shift = struct.unpack_from("<4H", raw, 26)
    n_fat, first_dir, _, cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<I", raw, 44) + struct.unpack_from("<7I", raw, 48)
    if order != 0xFFFE or version not in (3, 4) or not (9 <= shift <= 12 if version == 3 else shift == 12) or mini_shift != 6 or cutoff != 4096:
        return Compound(error="bad_header", version=version)
    size = 1 << shift
    count = max(0, -(-len(raw) // size) - 1)
    out = Compound(version=version, sector_size=size, sectors=count)
    if count > MAX_SECTORS or n_difat > MAX_DIFAT:
        out.error = "sector_cap" if count > MAX_SECTORS else "difat_cap"
        return out
    claims: dict[int, str] = {}
    sector = lambda k: raw[(k + 1) * size : (k + 2) * size]

    def claim(sectors: list[int], name: str) -> None:
        for k in sectors:
            if claims.setdefault(k, name) != name:
                out.faults.append((name, "shared_sector"))
                return

    def numbers(k: int) -> list[int]:
        data = sector(k)
        return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))

    fat_at = list(struct.unpack_from("<109I", raw, 76))
    at, visited = first_difat, []
    while at not in (END, FREE) and len(visited) < MAX_DIFAT:
        if at >= count or at in visited:
            out.faults.append(("difat", "out_of_range" if at >= count else "cycle"))
            break
        visited.append(at)
        *more, at = numbers(at) or [END]
        fat_at += more
    out.long_difat = bool(visited)
    fat_at = [k for k in fat_at if k < FAT_MARK - 1][:n_fat]
    if any(k >= count for k in fat_at):
        out.faults.append(("fat", "out_of_range"))
    fat_at = [k for k in fat_at if k < count]
    fat = [x for k in fat_at for x in numbers(k)]

    def follow(start: int, name: str) -> list[int]:
        found, fault = chain(fat, start, count) if start not in (END, FREE) else ([], None)
        if fault:
            out.faults.append((name, fault))
        return found

    mini_at, dir_at = follow(first_mini, "minifat"), follow(first_dir, "directory")
    for sectors, name in ((visited, "difat"), (fat_at, "fat"), (mini_at, "minifat"), (dir_at, "directory")):
        claim(sectors, name)
    minifat = [x for k in mini_at for x in numbers(k)]
    table = b"".join(map(sector, dir_at))
    slots = len(table) // 128
    if slots > MAX_ENTRIES:
        out.error = "entry_cap"
        return out

    def slot(k: int) -> tuple[str, int, int, int, int, int, int]:
        e = table[128 * k : 128 * k + 128]
        length, kind = struct.unpack_from("<HB", e, 64)
        left, right, child = struct.unpack_from("<3I", e, 68)
        start, low, high = struct.unpack_from("<3I", e, 116)
        return e[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, low if version == 3 else low | high << 32

    if not slots:
        out.error = "no_directory"
        return out
    root = slot(0)
    small = b"".join(map(sector, found := follow(root[5], "ministream")))[: root[6]]
    claim(found, "ministream")
    seen = {0}
    todo = [(root[4], "")]
    while todo:
        k, above = todo.pop()
        if k == NONE:
            continue
        if k >= slots or k in seen:
            out.faults.append((above or "/", "out_of_range" if k >= slots else "cycle"))
            continue
        seen.add(k)
        name, kind, left, right, child, start, n = slot(k)
        path = f"{above}/{name}" if above else name
        todo += [(left, above), (right, above)]
        out.entries.append(Entry(path, kind, start, n if kind == STREAM else 0))
        if kind == STORAGE:
            todo.append((child, path))
    out.entries.sort(key=lambda e: e.path.encode())
    for e in out.entries:
        if e.kind != STREAM:
            continue
        if 0 < e.size < cutoff:
            found, fault = chain(minifat, e.start, -(-len(small) // 64))
            data = b"".join(small[64 * k : 64 * k + 64] for k in found)
        else:
            found, fault = chain(fat, e.start, count) if e.size else ([], None)
            claim(found, "stream")
            data = b"".join(map(sector, found))
        if fault or len(data) < e.size:
            out.faults.append((e.path, fault or "short"))
        out.streams[e.path.lower()] = data[: e.size]
    out.accounting = dict.fromkeys(CLASSES, 0) | {"header": min(size, len(raw))}
    for k in range(count):
        out.accounting[claims.get(k, "free" if k < len(fat) and fat[k] == FREE else "unaccounted")] += len(sector(k))
    return out


def write(tree: dict) -> bytes:
    """A version 3 file of nested dicts (storages) and bytes (streams)."""
    slots: list[dict] = [{"name": "Root Entry", "kind": ROOT, "child": NONE, "left": NONE, "right": NONE, "data": b""}]

    def add(children: dict) -> int:
        at = []
        for name in sorted(children, key=lambda n: (len(n), n.upper())):
            value = children[name]
            slots.append({"name": name, "kind": STORAGE if isinstance(value, dict) else STREAM, "child": NONE, "left": NONE, "right": NONE, "data": b"" if isinstance(value, dict) else value})
            at.append(len(slots) - 1)
            if isinstance(value, dict):
                slots[at[-1]]["child"] = add(value)

        def middle(lo: int, hi: int) -> int:
            if lo >= hi:
                return NONE
            mid = (lo + hi) // 2
            slots[at[mid]] |= {"left": middle(lo, mid), "right": middle(mid + 1, hi)}
            return at[mid]

        return middle(0, len(at))

    slots[0]["child"] = add(tree)
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        if not data:
            return END
        first, n = len(sectors), -(-len(data) // 512)
        sectors.extend(data[512 * k : 512 * k + 512].ljust(512, b"\0") for k in range(n))
        fat.extend([*range(first + 1, first + n), END])
        return first

    small, minifat = b"", []
    for s in slots[1:]:
        data = s["data"]
        s["size"] = len(data)
        if 0 < len(data) < 4096:
            s["start"], n = len(minifat), -(-len(data) // 64)
            minifat += [*range(s["start"] + 1, s["start"] + n), END]
            small += data.ljust(64 * n, b"\0")
        else:
            s["start"] = put(data) if s["kind"] == STREAM else 0
    slots[0] |= {"start": put(small), "size": len(small)}
    first_mini = put(b"".join(struct.pack("<I", x) for x in minifat))
    n_mini = -(-len(minifat) * 4 // 512)
    table = b""
    for s in slots:
        name = s["name"].encode("utf-16-le") + b"\0\0"
        table += name.ljust(64, b"\0") + struct.pack("<HBBIII", len(name), s["kind"], 1, s["left"], s["right"], s["child"]) + bytes(36) + struct.pack("<IQ", s["start"], s["size"])
    first_dir = put(table)
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat:
        n_fat += 1
    if n_fat > 109:
        raise ValueError("too large for this writer")
    fat_at = list(range(len(sectors), len(sectors) + n_fat))
    fat += [FAT_MARK] * n_fat
    fat += [FREE] * (n_fat * 128 - len(fat))
    head = MAGIC + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, n_fat, first_dir, 0, 4096, first_mini, n_mini, END, 0)
    return head + struct.pack("<109I", *fat_at, *[FREE] * (109 - n_fat)) + b"".join(sectors) + struct.pack(f"<{len(fat)}I", *fat)
