"""Resource caps of a parse. Every cap allows its own value; one more is a hit, recorded and never silent."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields


@dataclass(frozen=True)
class Limits:
    max_input_bytes: int = 64 << 20
    max_depth: int = 16
    max_parts: int = 1000
    max_header_bytes: int = 256 << 10
    max_decoded_part_bytes: int = 32 << 20
    max_decoded_total_bytes: int = 128 << 20
    max_container_depth: int = 64

    def stamp(self) -> str:
        """The text that keys hash, so results under different limits never share a key."""
        return ",".join(f"{f.name}={v}" for f, v in zip(fields(self), astuple(self), strict=True))


#: Which limit a recorded cap reason belongs to.
CAPS = {"size_cap": "max_decoded_part_bytes", "total_size_cap": "max_decoded_total_bytes", "depth_cap": "max_depth", "part_count_cap": "max_parts", "header_bytes_cap": "max_header_bytes"}
