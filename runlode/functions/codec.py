"""The canonical binary form and the identities made from it.

Numbers are little-endian, byte strings and texts carry a 64-bit length, optional fields a flag byte,
digests are 32 bare bytes. ``namespace`` names the tags that start each identity.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from runlode.functions.blake3 import blake3_many

NAMESPACE = "runlode"


class Encoder:
    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def pack(self, form: str, value) -> Encoder:
        self.parts.append(struct.pack("<" + form, value))
        return self

    def u8(self, v: int) -> Encoder:
        return self.pack("B", v)

    def flag(self, v: bool) -> Encoder:
        return self.u8(int(v))

    def u16(self, v: int) -> Encoder:
        return self.pack("H", v)

    def u32(self, v: int) -> Encoder:
        return self.pack("I", v)

    def u64(self, v: int) -> Encoder:
        return self.pack("Q", v)

    def i64(self, v: int) -> Encoder:
        return self.pack("q", v)

    def f32(self, v: float) -> Encoder:
        return self.pack("f", v)

    def f64(self, v: float) -> Encoder:
        return self.pack("d", v)

    def f32s(self, vs) -> Encoder:
        self.parts.append(struct.pack(f"<{len(vs)}f", *vs))
        return self

    def raw(self, v: bytes) -> Encoder:
        self.parts.append(v)
        return self

    def data(self, v: bytes) -> Encoder:
        return self.u64(len(v)).raw(v)

    def text(self, v: str) -> Encoder:
        return self.data(v.encode())

    def digest(self, v: bytes) -> Encoder:
        if len(v) != 32:
            raise ValueError("a digest has 32 bytes")
        return self.raw(v)

    def maybe_digest(self, v: bytes | None) -> Encoder:
        return self.u8(0) if v is None else self.u8(1).digest(v)

    def maybe_u64(self, v: int | None) -> Encoder:
        return self.u8(0) if v is None else self.u8(1).u64(v)

    def done(self) -> bytes:
        return b"".join(self.parts)


class Decoder:
    """Reads what Encoder wrote; ValueError on anything it would not have written."""

    def __init__(self, data: bytes):
        self.rest, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n > len(self.rest) - self.at:
            raise ValueError("the data end early")
        self.at += n
        return self.rest[self.at - n : self.at]

    def unpack(self, form: str):
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def u8(self) -> int:
        return self.unpack("B")

    def flag(self) -> bool:
        if (v := self.u8()) > 1:
            raise ValueError("a flag is 0 or 1")
        return bool(v)

    def u16(self) -> int:
        return self.unpack("H")

    def u32(self) -> int:
        return self.unpack("I")

    def u64(self) -> int:
        return self.unpack("Q")

    def i64(self) -> int:
        return self.unpack("q")

    def f32(self) -> float:
        return self.unpack("f")

    def f64(self) -> float:
        return self.unpack("d")

    def f32s(self, n: int) -> tuple[float, ...]:
        return struct.unpack(f"<{n}f", self.take(4 * n))

    def data(self) -> bytes:
        return self.take(self.u64())

    def text(self) -> str:
        return self.data().decode()

    def digest(self) -> bytes:
        return self.take(32)

    def maybe_digest(self) -> bytes | None:
        return self.digest() if self.flag() else None

    def maybe_u64(self) -> int | None:
        return self.u64() if self.flag() else None

    def end(self) -> None:
        if self.at != len(self.rest):
            raise ValueError("data are left over")


def spec_bytes(form: str, data: bytes, namespace: str = NAMESPACE) -> bytes:
    return Encoder().text(f"{namespace}.spec.v1").text(form).data(data).done()


def params_bytes(data: bytes, namespace: str = NAMESPACE) -> bytes:
    return Encoder().text(f"{namespace}.params.v1").data(data).done()


def search_bytes(root_seed: int, segments: int | None, form: str, generator: str, generator_params: bytes, params: bytes, namespace: str = NAMESPACE) -> bytes:
    if segments == 0:
        raise ValueError("segments must not be 0")
    return Encoder().text(f"{namespace}.run-config.v1").u64(root_seed).maybe_u64(segments).text(form).text(generator).data(generator_params).raw(params_bytes(params, namespace)).done()


@dataclass(frozen=True)
class TaskIdentity:
    spec: bytes
    params: bytes
    seed: int
    environment: bytes
    input_state: bytes | None = None

    def encoded(self, namespace: str = NAMESPACE) -> bytes:
        return Encoder().text(f"{namespace}.task.v1").digest(self.spec).digest(self.params).u64(self.seed).digest(self.environment).maybe_digest(self.input_state).done()

    def key(self, namespace: str = NAMESPACE) -> bytes:
        return blake3_many([self.encoded(namespace)])[0]


def environment_bytes(components: list[tuple[str, str, bytes]], namespace: str = NAMESPACE) -> bytes:
    """components: (name, version, digest), at least one, put in order; names are unique."""
    names = [c[0] for c in components]
    if not components or len(set(names)) != len(names):
        raise ValueError("an environment has at least one component, each named once")
    out = Encoder().text(f"{namespace}.environment.v1").u64(len(components))
    for name, version, digest in sorted(components):
        out.text(name).text(version).digest(digest)
    return out.done()


def grid_bytes(width: int, height: int, channels: int, values, namespace: str = NAMESPACE) -> bytes:
    """A grid in cell-major order; as many values as its extents say."""
    if len(values) != width * height * channels or not values:
        raise ValueError("the values do not fill the grid")
    return Encoder().text(f"{namespace}.grid.v1").u32(width).u32(height).u32(channels).f32s(values).done()


def grid_from(data: bytes, namespace: str = NAMESPACE) -> tuple[int, int, int, tuple[float, ...]]:
    d = Decoder(data)
    if d.text() != f"{namespace}.grid.v1":
        raise ValueError("not a grid")
    width, height, channels = d.u32(), d.u32(), d.u32()
    values = d.f32s(width * height * channels)
    d.end()
    return width, height, channels, values


def continuation_bytes(step: int, grid: bytes) -> bytes:
    """What a segment hands to the next: the absolute step, then the grid."""
    return Encoder().u64(step).raw(grid).done()


def continuation_from(data: bytes, namespace: str = NAMESPACE) -> tuple[int, tuple[int, int, int, tuple[float, ...]]]:
    return Decoder(data).u64(), grid_from(data[8:], namespace)
