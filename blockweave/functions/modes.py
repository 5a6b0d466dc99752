"""File modes and open flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the mode word.
S_IFMT, S_IFREG, S_IFDIR = 0o170000, 0o100000, 0o040000
FILE_MODE, DIRECTORY_MODE = S_IFREG | 0o644, S_IFDIR | 0o755
#: Fixed values of open flags, in the order in which they are shown.
O_ACCMODE = 0o3
FLAGS = {
    "O_APPEND": 0o2000,
    "O_ASYNC": 0o20000,
    "O_CLOEXEC": 0o2000000,
    "O_CREAT": 0o100,
    "O_DIRECT": 0o40000,
    "O_DIRECTORY": 0o200000,
    "O_DSYNC": 0o10000,
    "O_EXCL": 0o200,
    "O_LARGEFILE": 0o100000,
    "O_NOATIME": 0o1000000,
    "O_NOCTTY": 0o400,
    "O_NOFOLLOW": 0o400000,
    "O_NONBLOCK": 0o4000,
    "O_PATH": 0o10000000,
    "O_SYNC": 0o4010000,
    "O_TRUNC": 0o1000,
}


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(FLAGS[name]) == FLAGS[name]


def access(flags: Column) -> Column:
    return F.element_at(F.array(F.lit("O_RDONLY"), F.lit("O_WRONLY"), F.lit("O_RDWR"), F.lit("")), flags.bitwiseAND(O_ACCMODE).cast("int") + 1)


def show_flags(flags: Column) -> Column:
    return F.concat_ws(" | ", access(flags), *[F.when(has_flag(flags, n), n) for n in FLAGS])


def flushes_each_write(flags: Column) -> Column:
    return has_flag(flags, "O_DIRECT") | has_flag(flags, "O_SYNC") | has_flag(flags, "O_DSYNC")


def chmod(mode: Column, new: Column) -> Column:
    """The type bits of mode with the other bits of new."""
    return mode.bitwiseAND(S_IFMT).bitwiseOR(new.bitwiseAND(~S_IFMT & 0xFFFFFFFF))


def with_mode(mode: Column, new: Column) -> Column:
    """new where it names a file type, else its permissions on mode's type."""
    return F.when(new.bitwiseAND(S_IFMT) > 0, new).otherwise(chmod(mode, new))


def is_regular(mode: Column) -> Column:
    return mode.bitwiseAND(S_IFREG) == S_IFREG


def is_directory(mode: Column) -> Column:
    return mode.bitwiseAND(S_IFDIR) == S_IFDIR


def octal(number: Column) -> Column:
    return F.conv(number.cast("string"), 10, 8)


def show_mode(mode: Column) -> Column:
    return F.concat(F.when(is_regular(mode), "S_IFREG").otherwise(""), F.when(is_directory(mode), "S_IFDIR").otherwise(""), F.lit(" | 0o"), octal(mode.bitwiseAND(~S_IFMT & 0xFFFFFFFF)))
