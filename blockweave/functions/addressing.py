"""Block ranges, block pointers and the packed metadata words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the pointer formats.
STAGING = 0x4000_0000_0000_0000
ZERO_BLOCK = 0x3FFF_FFFF_0000_0000
DUMMY = 0x3FFF_FFFF_FFFF_FFFF
INVALID = 0
LOCATION_SHIFT = 62
SEGMENT_SHIFT = 32
SEGMENT_LIMIT = 1 << 30
FLAT_LIMIT = 1 << 32
UNIT_SHIFT = 12
UNIT_LIMIT = 1 << 18
INDEX_SHIFT = 14
GROUP_SHIFT = 4
GROUP_MASK = (1 << 14) - 1
FORMATS = {"nop": 0, "flat": 1, "micro_group": 2}
#: Fixed values of the metadata word and of segment summaries.
ROOT_SIZE = 56
LEAST_BLOCK = 4096
SUMMARY_HEADER = 208
SUMMARY_ENTRY = 16
SUMMARY_ALIGN = 4096


def _long(x) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")


def block_ranges(offset: Column, length: Column, block_size: int) -> Column:
    """array<struct<blk_idx, off, len>> of the blocks a byte range touches; empty for length 0."""
    offset, length, size = _long(offset), _long(length), F.lit(block_size).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    last = offset + length
    blocks = F.sequence(div(offset, size), div(last - 1, size))
    parts = F.transform(blocks, lambda b: F.struct(b.alias("blk_idx"), F.greatest(offset - b * size, F.lit(0)).alias("off"), (F.least(last, (b + 1) * size) - F.greatest(offset, b * size)).alias("len")))
    return F.when(length > 0, parts).otherwise(F.array().cast("array<struct<blk_idx:bigint,off:bigint,len:bigint>>"))


def _shift(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits)


def encode_flat(segid: Column, offset: Column) -> Column:
    """Pointer of a byte offset in a segment; null out of range."""
    segid, offset = _long(segid), _long(offset)
    fits = segid.between(0, SEGMENT_LIMIT - 1) & offset.between(0, FLAT_LIMIT - 1)
    return F.when(fits, F.lit(STAGING).bitwiseOR(_shift(segid, SEGMENT_SHIFT)).bitwiseOR(offset))


def encode_micro_group(segid: Column, offset: Column, seq: Column) -> Column:
    """Pointer of a 4 KiB unit and the group of 16 blocks that seq falls in; null out of range."""
    segid, offset, seq = _long(segid), _long(offset), _long(seq)
    unit, group = F.shiftright(offset, UNIT_SHIFT), F.shiftright(seq, GROUP_SHIFT)
    fits = segid.between(0, SEGMENT_LIMIT - 1) & unit.between(0, UNIT_LIMIT - 1) & group.between(0, GROUP_MASK)
    return F.when(fits, F.lit(STAGING).bitwiseOR(_shift(segid, SEGMENT_SHIFT)).bitwiseOR(_shift(unit, INDEX_SHIFT)).bitwiseOR(group))


def decode_segid(ptr: Column) -> Column:
    return F.shiftrightunsigned(ptr, SEGMENT_SHIFT).bitwiseAND(SEGMENT_LIMIT - 1)


def decode_flat_offset(ptr: Column) -> Column:
    return ptr.bitwiseAND(FLAT_LIMIT - 1)


def decode_unit_offset(ptr: Column) -> Column:
    return _shift(F.shiftrightunsigned(ptr, INDEX_SHIFT).bitwiseAND(UNIT_LIMIT - 1), UNIT_SHIFT)


def decode_group(ptr: Column) -> Column:
    return ptr.bitwiseAND(GROUP_MASK)


def encode(segid: Column, offset: Column, seq: Column, form: str) -> Column:
    return encode_flat(segid, offset) if form == "flat" else encode_micro_group(segid, offset, seq)


def decode_offset(ptr: Column, form: str) -> Column:
    return decode_flat_offset(ptr) if form == "flat" else decode_unit_offset(ptr)


def is_on_staging(ptr: Column) -> Column:
    return F.shiftrightunsigned(ptr, LOCATION_SHIFT) == 1


def pointer_kind(ptr: Column) -> Column:
    return F.when(ptr == DUMMY, "dummy").when(ptr == INVALID, "invalid").when(ptr == ZERO_BLOCK, "zero").when(is_on_staging(ptr), "staging").otherwise("unknown")


def display(ptr: Column, form: str = "micro_group") -> Column:
    """The pointer as text."""
    staging = F.format_string("[Staging: id %d - offset %d - group %d]", decode_segid(ptr), decode_offset(ptr, form), decode_group(ptr))
    return F.when(ptr == DUMMY, "[Dummy]").when(ptr == INVALID, "[Invalid]").when(ptr == ZERO_BLOCK, "[Zero Block]").when(is_on_staging(ptr), staging).otherwise(F.concat(F.lit("[Unkown: 0x"), F.lower(F.hex(ptr)), F.lit("]")))


def block_shift(size: Column) -> Column:
    """log2 of a block size after it is raised to the least size and cut to a power of two."""
    return F.length(F.bin(F.greatest(_long(size), F.lit(LEAST_BLOCK)))) - 1


def pack_meta_config(meta_size: Column, data_size: Column, form: Column) -> Column:
    return F.lit((ROOT_SIZE // 8) << 24).cast("long").bitwiseOR(_shift(_long(block_shift(meta_size)), 16)).bitwiseOR(_shift(_long(block_shift(data_size)), 8)).bitwiseOR(_long(form))


def unpack_meta_config(word: Column) -> dict[str, Column]:
    byte = lambda n: F.shiftright(_long(word), n).bitwiseAND(0xFF)
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), byte(n).cast("int"))
    return {"root_size": byte(24) * 8, "meta_block_size": power(16), "data_block_size": power(8), "format": byte(0)}


def pack_map_data(form: Column) -> Column:
    return _long(form).bitwiseAND(0xFF)


def unpack_map_data(word: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in FORMATS]), (_long(word).bitwiseAND(0xFF) + 1).cast("int"))


def summary_bytes(n_blocks: Column) -> Column:
    """Bytes of a segment's summary, aligned."""
    return F.call_function("div", _long(n_blocks) * SUMMARY_ENTRY + SUMMARY_HEADER + SUMMARY_ALIGN - 1, F.lit(SUMMARY_ALIGN)) * SUMMARY_ALIGN


def zeros(n: Column) -> Column:
    return F.call_function("rpad", F.lit(b""), n.cast("int"), F.lit(b"\x00"))


def is_all_zeros(data: Column) -> Column:
    return data == zeros(F.octet_length(data))
