"""Binary formats: shards (metadata objects), containers of chunks, and cached chunk ranges.

The layouts are fixed; the identifying byte strings are a parameter (Format), so that a store's own can be given.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from ..functions import kernels as K

RECORD, FOOTER = 48, 200
WITH_VERIFICATION, WITH_METADATA = 1 << 31, 1 << 30
NEVER = (1 << 64) - 1
BOOKEND = b"\xff" * 32 + bytes(16)


@dataclass(frozen=True)
class Format:
    """The identifiers of a store's objects: application (14 bytes), shard magic (17), container, hash section, boundary section (7 each)."""

    application: bytes = b"CairnMetadata\0"
    magic: bytes = hashlib.sha256(b"cairn shard").digest()[:17]
    container: bytes = b"CRNBLOB"
    hashes: bytes = b"CRNHASH"
    bounds: bytes = b"CRNBNDS"


DEFAULT = Format()


@dataclass
class Term:
    container: bytes
    unpacked: int
    chunk_start: int
    chunk_end: int
    flags: int = 0


@dataclass
class FileBlock:
    file: bytes
    terms: list[Term]
    verification: list[bytes] | None = None
    sha256: bytes | None = None


@dataclass
class Chunk:
    hash: bytes
    start: int
    size: int
    flags: int = 0


@dataclass
class ContainerBlock:
    container: bytes
    chunks: list[Chunk]
    unpacked: int
    on_disk: int = 0
    flags: int = 0


@dataclass
class Footer:
    created: int
    expiry: int = NEVER
    key: bytes = bytes(32)
    stored_on_disk: int = 0
    materialized: int = 0
    stored: int = 0

    @property
    def keyed(self) -> bool:
        return any(self.key)

    def expired(self, now: int) -> bool:
        return self.expiry <= now


@dataclass
class Shard:
    files: list[FileBlock] = field(default_factory=list)
    containers: list[ContainerBlock] = field(default_factory=list)
    footer: Footer | None = None


def wire_sha(h: bytes) -> bytes:
    """A digest with each 8 bytes turned round."""
    return b"".join(h[i : i + 8][::-1] for i in range(0, 32, 8))


def new_footer(s: Shard, created: int) -> Footer:
    return Footer(created, stored_on_disk=sum(c.on_disk for c in s.containers), stored=sum(c.unpacked for c in s.containers), materialized=sum(t.unpacked for f in s.files for t in f.terms))


def encoded_size(s: Shard, with_footer: bool) -> int:
    files = sum(1 + len(f.terms) + len(f.verification or ()) + (f.sha256 is not None) for f in s.files)
    return RECORD * (3 + files + sum(1 + len(c.chunks) for c in s.containers)) + FOOTER * with_footer


def encode_shard(s: Shard, with_footer: bool = False, fmt: Format = DEFAULT) -> bytes:
    out = [fmt.application, b"\0", fmt.magic, struct.pack("<QQ", 2, FOOTER if with_footer else 0)]
    for f in s.files:
        flags = WITH_VERIFICATION * (f.verification is not None) | WITH_METADATA * (f.sha256 is not None)
        out.append(f.file + struct.pack("<II8x", flags, len(f.terms)))
        out += [t.container + struct.pack("<IIII", t.flags, t.unpacked, t.chunk_start, t.chunk_end) for t in f.terms]
        out += [v + bytes(16) for v in f.verification or ()]
        out += [wire_sha(f.sha256) + bytes(16)] if f.sha256 is not None else []
    out.append(BOOKEND)
    middle = sum(map(len, out))
    for c in s.containers:
        out.append(c.container + struct.pack("<IIII", c.flags, len(c.chunks), c.unpacked, c.on_disk))
        out += [k.hash + struct.pack("<IIII", k.start, k.size, k.flags, 0) for k in c.chunks]
    out.append(BOOKEND)
    if with_footer:
        end, f = sum(map(len, out)), s.footer or new_footer(s, 0)
        out.append(struct.pack("<9Q", 1, RECORD, middle, end, 0, end, 0, end, 0) + f.key + struct.pack("<QQ48x4Q", f.created, f.expiry, f.stored_on_disk, f.materialized, f.stored, end))
    return b"".join(out)


def shard_name(s: Shard, fmt: Format = DEFAULT) -> str:
    """SHA-256 of the bytes without a footer."""
    return hashlib.sha256(encode_shard(s, False, fmt)).hexdigest()


def decode_shard(data: bytes, footer: str = "auto", fmt: Format = DEFAULT, on_container=None) -> Shard:
    """footer: required, forbidden, or auto (as the header says). on_container is called with each container block as it is
    read. Lists grow as entries arrive: declared counts are not trusted."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the shard ends early")
        at += n
        return data[at - n : at]

    head = take(RECORD)
    version, size = struct.unpack("<QQ", head[32:])
    if head[15:32] != fmt.magic or version != 2:
        raise ValueError("not a shard of version 2")
    has = size == FOOTER
    if size not in (0, FOOTER) and size < FOOTER or footer == "required" and not has or footer == "forbidden" and size:
        raise ValueError(f"footer of {size} bytes where it is {footer}")
    s = Shard()
    while (rec := take(RECORD)) != BOOKEND:
        flags, n = struct.unpack("<II", rec[32:40])
        if flags & ~(WITH_VERIFICATION | WITH_METADATA):
            raise ValueError(f"unknown file flags {flags:#x}")
        f = FileBlock(rec[:32], [])
        for _ in range(n):
            r = take(RECORD)
            flag, unpacked, a, b = struct.unpack("<IIII", r[32:])
            f.terms.append(Term(r[:32], unpacked, a, b, flag))
        if flags & WITH_VERIFICATION:
            f.verification = [take(RECORD)[:32] for _ in range(n)]
        if flags & WITH_METADATA:
            f.sha256 = wire_sha(take(RECORD)[:32])
        s.files.append(f)
    while (rec := take(RECORD)) != BOOKEND:
        flags, n, unpacked, on_disk = struct.unpack("<IIII", rec[32:])
        c = ContainerBlock(rec[:32], [], unpacked, on_disk, flags)
        for _ in range(n):
            r = take(RECORD)
            start, size_, flag, _ = struct.unpack("<IIII", r[32:])
            c.chunks.append(Chunk(r[:32], start, size_, flag))
        if on_container:
            on_container(c)
        s.containers.append(c)
    if has or size > FOOTER:
        raw = take(FOOTER)
        if struct.unpack("<Q", raw[:8]) != (1,):
            raise ValueError("not a footer of version 1")
        created, expiry, disk, materialized, stored, _ = struct.unpack("<QQ48x4Q", raw[104:])
        s.footer = Footer(created, expiry, raw[72:104], disk, materialized, stored)
    return s


def validate_shard(s: Shard) -> list[str]:
    """What is wrong with a shard; empty for a valid one. Containers that it does not describe are not judged."""
    bad, described = [], {}
    for c in s.containers:
        if c.container in described:
            bad.append("duplicate container")
        described[c.container] = c.chunks
        if c.flags:
            bad.append("reserved container flags")
        at = 0
        for k in c.chunks:
            if k.start != at:
                bad.append("chunk offsets are not contiguous")
            if k.flags & ~(1 << 31):
                bad.append("reserved chunk flags")
            at += k.size
        if at != c.unpacked:
            bad.append("container total")
    for f in s.files:
        if f.verification is not None and len(f.verification) != len(f.terms):
            bad.append("verification count")
        for t in f.terms:
            if t.flags:
                bad.append("reserved term flags")
            if t.chunk_start >= t.chunk_end:
                bad.append("empty term")
            elif t.container in described:
                chunks = described[t.container]
                if t.chunk_end > len(chunks):
                    bad.append("term beyond its container")
                elif sum(k.size for k in chunks[t.chunk_start : t.chunk_end]) != t.unpacked:
                    bad.append("term bytes")
    return bad


# Containers

HEADER = 8
RETEST = 32


def chunk_header(packed: int, scheme: int, size: int) -> bytes:
    return b"\0" + packed.to_bytes(3, "little") + bytes([scheme]) + size.to_bytes(3, "little")


def parse_header(b: bytes) -> tuple[int, int, int]:
    """Packed size, scheme, unpacked size."""
    if len(b) < HEADER or b[0]:
        raise ValueError("not a chunk header of version 0")
    size = int.from_bytes(b[5:8], "little")
    if size > K.MAX_CHUNK:
        raise ValueError(f"chunk of {size} bytes")
    return int.from_bytes(b[1:4], "little"), b[4], size


def encode_container(chunks: list[bytes], starts: frozenset[int] = frozenset({0}), footer: bool = True, nonce: bytes = bytes(4), fmt: Format = DEFAULT) -> tuple[bytes, bytes, list[int], list[bytes]]:
    """Bytes, hash, packed ends and chunk hashes. starts: indexes at which a file begins; a compression choice holds for 32
    chunks and not beyond a file's start."""
    if len(chunks) > K.MAX_CHUNKS or sum(map(len, chunks)) > K.MAX_CONTAINER:
        raise ValueError("a container holds at most 8192 chunks and 64 MiB")
    out, ends, unpacked, scheme, since = [], [], [], K.LZ4, RETEST
    for i, c in enumerate(chunks):
        if i in starts or since >= RETEST:
            scheme, since = K.choose_scheme(c), 0
        since += 1
        body, used = K.pack(c, scheme)
        out += [chunk_header(len(body), used, len(c)), body]
        ends.append((ends[-1] if ends else 0) + HEADER + len(body))
        unpacked.append((unpacked[-1] if unpacked else 0) + len(c))
    hashes = K.chunk_hashes(chunks)
    root = K.merkle_root([(h, len(c)) for h, c in zip(hashes, chunks, strict=True)])
    if footer:
        n = struct.pack("<I", len(chunks))
        main = fmt.container + b"\1" + root
        names = fmt.hashes + b"\0" + n + b"".join(hashes)
        bounds = fmt.bounds + b"\1" + n + struct.pack(f"<{len(ends)}I", *ends) + struct.pack(f"<{len(ends)}I", *unpacked)
        size = len(main) + len(names) + len(bounds) + 28
        tail = main + names + bounds + n + struct.pack("<II", size - 40, size - 40 - len(names)) + nonce + bytes(12)
        out.append(tail + struct.pack("<I", len(tail)))
    return b"".join(out), root, ends, hashes


def read_offsets(data: bytes, fmt: Format = DEFAULT) -> list[int] | None:
    """Packed ends from the footer, without reading chunks; None where there is no footer."""
    if len(data) < 96:
        return None
    size = struct.unpack("<I", data[-4:])[0]
    if size < 92 or size + 4 > len(data) or (size - 92) % 40 or (n := (size - 92) // 40) > K.MAX_CHUNKS:
        return None
    tail = data[len(data) - size - 4 :]
    if tail[:8] != fmt.container + b"\1" or tail[40:48] != fmt.hashes + b"\0" or struct.unpack("<I", tail[48:52])[0] != n:
        return None
    at = 52 + 32 * n
    if tail[at : at + 8] != fmt.bounds + b"\1" or struct.unpack("<I", tail[at + 8 : at + 12])[0] != n:
        return None
    ends = list(struct.unpack(f"<{n}I", tail[at + 12 : at + 12 + 4 * n]))
    if any(b < a + HEADER for a, b in zip([0, *ends], ends, strict=False)) or (ends[-1] if ends else 0) != len(data) - size - 4:
        return None
    return ends


def scan_offsets(data: bytes, fmt: Format = DEFAULT) -> list[int]:
    """Packed ends by going from header to header."""
    ends, at = [], 0
    while at < len(data) and data[at : at + 7] != fmt.container:
        packed, _, _ = parse_header(data[at : at + HEADER])
        at += HEADER + packed
        if at > len(data):
            raise ValueError("the container ends within a chunk")
        ends.append(at)
    return ends


def offsets(data: bytes, fmt: Format = DEFAULT) -> list[int]:
    found = read_offsets(data, fmt)
    return scan_offsets(data, fmt) if found is None else found


def packed_range(ends: list[int], start: int, end: int) -> tuple[int, int]:
    """Inclusive bytes of chunks [start, end)."""
    if not 0 <= start < end <= len(ends):
        raise ValueError(f"no chunks [{start}, {end}) of {len(ends)}")
    return (ends[start - 1] if start else 0), ends[end - 1] - 1


def decode_chunks(data: bytes, fmt: Format = DEFAULT) -> list[bytes]:
    """Chunks of a container, or of any byte range of one that begins and ends with chunks."""
    out, at = [], 0
    while at < len(data) and data[at : at + 7] != fmt.container:
        packed, scheme, size = parse_header(data[at : at + HEADER])
        body = data[at + HEADER : at + HEADER + packed]
        if len(body) != packed:
            raise ValueError("the container ends within a chunk")
        out.append(K.unpack(body, size, scheme))
        at += HEADER + packed
    return out


def validate_container(data: bytes, claimed: bytes, fmt: Format = DEFAULT) -> list[str]:
    """What is wrong with a container; empty for a valid one. A container without a footer is judged by its chunks."""
    try:
        chunks = decode_chunks(data, fmt)
    except Exception as e:
        return [str(e)]
    bad = []
    if not chunks or len(chunks) > K.MAX_CHUNKS or sum(map(len, chunks)) > K.MAX_CONTAINER or not all(chunks):
        bad.append("limits")
    hashes = K.chunk_hashes(chunks)
    if K.merkle_root([(h, len(c)) for h, c in zip(hashes, chunks, strict=True)]) != claimed:
        bad.append("hash")
    ends = scan_offsets(data, fmt)
    tail = data[ends[-1] if ends else 0 :]
    if tail:
        n = len(chunks)
        if read_offsets(data, fmt) != ends or tail[8:40] != claimed:
            bad.append("footer")
        elif tail[52 : 52 + 32 * n] != b"".join(hashes):
            bad.append("footer hashes")
        elif any(tail[-16:-4]):
            bad.append("reserved bytes")
    return bad


# Cached ranges of decoded chunks


def encode_cache(chunks: list[bytes]) -> bytes:
    ends = [0]
    for c in chunks:
        ends.append(ends[-1] + len(c))
    head, data = struct.pack(f"<{len(ends) + 1}I", len(ends), *ends), b"".join(chunks)
    return head + data + struct.pack("<I", zlib.crc32(head, zlib.crc32(data)))


def decode_cache(raw: bytes, chunk_start: int, chunk_end: int) -> list[bytes]:
    """The chunks of an entry whose name says [chunk_start, chunk_end)."""
    n = chunk_end - chunk_start + 1
    head = 4 + 4 * n
    if not 0 <= chunk_start < chunk_end <= K.MAX_CHUNKS or len(raw) < head + 4 or struct.unpack("<I", raw[:4])[0] != n:
        raise ValueError("not a complete cache entry")
    ends = struct.unpack(f"<{n}I", raw[4:head])
    data = raw[head:-4]
    if len(data) != ends[-1]:
        raise ValueError("not a complete cache entry")
    if zlib.crc32(raw[:head], zlib.crc32(data)) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("checksum")
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
