"""Texts that show inodes, stats, segments and settings. The wording is fixed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .modes import octal


def time_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _times(atime: Column, ctime: Column, mtime: Column) -> Column:
    return F.format_string("  access time: %s\n  change time: %s\n  modify time: %s", *map(time_text, (atime, ctime, mtime)))


def _long(c: Column) -> Column:
    return c.cast("long")


def stat_text(ino, size, uid, gid, mode, nlink, atime, ctime, mtime) -> Column:
    blocks = F.call_function("div", _long(size) + 511, F.lit(512))
    head = F.format_string("==== dump Stat ino: %d ====\n  file size: %d, blocks: %d\n  uid: %d, gid: %d, mode: 0o%s, nlink: %d, dev: 0, rdev: 0\n", _long(ino), _long(size), blocks, _long(uid), _long(gid), octal(mode), _long(nlink))
    return F.concat(head, _times(atime, ctime, mtime))


def inode_text(ino, dirty, checksum, timestamp, size, uid, gid, mode, flags, nlink, atime, ctime, mtime, config, last_seq, last_cno, ondisk_cno) -> Column:
    """checksum and timestamp are null for an inode that was never written; config is config_text()'s struct of four."""
    show = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    blocks = F.call_function("div", _long(size) + 511, F.lit(512))
    head = F.format_string("==== dump Inode ino: %d attr dirty: %s ====\n  ondisk checksum: %s, ondisk timestamp: %s\n  file size: %d, blocks: %d\n  uid: %d, gid: %d, mode: 0o%s, flags: %d, nlink: %d\n", _long(ino), dirty.cast("string"), show(checksum), show(timestamp), _long(size), blocks, _long(uid), _long(gid), octal(mode), _long(flags), _long(nlink))
    root, meta, data, form = config
    tail = F.format_string("\n  format: %s, root size: %d, meta block size: %d, data block size: %d\n  last seq: %d, last cno: %d, last ondisk cno: %d", form, _long(root), _long(meta), _long(data), _long(last_seq), _long(last_cno), _long(ondisk_cno))
    return F.concat(head, _times(atime, ctime, mtime), tail)


def config_text(root_size, meta_block_size, data_block_size, form) -> Column:
    return F.format_string("root size: %d, meta block size: %d, data block size: %d, block ptr format: %s", _long(root_size), _long(meta_block_size), _long(data_block_size), form)


def segment_text(ino, cno, next_segment, magic, checksum, n_bytes, flags, meta_shift, data_shift, n_meta, n_data) -> Column:
    hexed = lambda c: F.lower(F.hex(_long(c)))
    return F.format_string(
        "==== dump Segment Summary ====\n  ino: %d, cno: %d, next segment: %d\n  magic 0x%s, checksum: 0x%s\n  bytes: %d, flags: 0x%s\n  meta block shift: %d, data block shift: %d\n  meta block count: %d, data block count: %d",
        *map(_long, (ino, cno, next_segment)), hexed(magic), hexed(checksum), _long(n_bytes), hexed(flags), *map(_long, (meta_shift, data_shift, n_meta, n_data)),
    )
