"""Settings of a store, with their presets and JSON form."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

MIB = 1 << 20


@dataclass(frozen=True)
class MetaConfig:
    """Block sizes, raised to 4096 and cut to a power of two."""

    root_size: int = 56
    meta_block_size: int = 4096
    data_block_size: int = 4096
    block_ptr_format: str = "micro_group"

    def __post_init__(self):
        object.__setattr__(self, "root_size", 56)
        for name in ("meta_block_size", "data_block_size"):
            object.__setattr__(self, name, 1 << (max(getattr(self, name), 4096).bit_length() - 1))


@dataclass(frozen=True)
class RuntimeConfig:
    segment_buffer_size: int = 100 * MIB
    upload_chunk_size: int = 16 * MIB
    data_cache_blocks: int = 1024
    dirty_bytes: int = 8 * MIB
    dirty_blocks: int = 32
    flush_interval_ms: int = 5000
    node_cache_blocks: int | None = 1024

    @classmethod
    def middle(cls) -> RuntimeConfig:
        return cls(256 * MIB, 16 * MIB, 65536, 256 * MIB, 65536, 5000, None)

    @classmethod
    def large(cls) -> RuntimeConfig:
        return cls(1024 * MIB, 16 * MIB, 256000, 1024 * MIB, 256000, 5000, None)

    def max_dirty_blocks(self, block_size: int) -> int:
        return max(self.dirty_bytes // block_size, self.dirty_blocks)


@dataclass(frozen=True)
class NodeCacheConfig:
    """directory, capacity and mode, parsed from LocalDisk,dir,capacity,mode; anything else is Disabled."""

    directory: str = ""
    capacity: int = 0
    mode: str = "Disabled"

    @classmethod
    def parse(cls, text: str) -> NodeCacheConfig:
        parts = text.split(",")
        if len(parts) == 4 and parts[0] == "LocalDisk" and all(parts) and parts[2].isascii() and parts[2].isdigit() and parts[3] in ("ReuseCache", "ReuseSpace", "Recreate"):
            return cls(parts[1], int(parts[2]), parts[3])
        return cls()


@dataclass(frozen=True)
class StoreConfig:
    meta: MetaConfig = field(default_factory=MetaConfig)
    runtime: RuntimeConfig = field(default_factory=RuntimeConfig)
    node_cache: NodeCacheConfig = field(default_factory=NodeCacheConfig)

    def to_json(self, pretty: bool = False) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2 if pretty else None)

    @classmethod
    def from_json(cls, text: str) -> StoreConfig:
        try:
            d = json.loads(text)
            return cls(MetaConfig(**d["meta"]), RuntimeConfig(**d["runtime"]), NodeCacheConfig(**d["node_cache"]))
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError(f"not a store configuration: {e}") from e
