"""Object names, locations and the log's key codec."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INODE_NAME = "inode"


def segment_name(segid: Column) -> Column:
    return F.format_string("%010d", segid.cast("long"))


def log_key(root: str, segid: Column, seq: Column, offset: Column, length: Column) -> Column:
    return F.concat_ws("/", F.lit(root), segment_name(segid), F.concat_ws("_", seq, offset, length))


def parse_log_name(name: Column) -> Column:
    """struct<seq, offset, len> of the last part of a log key; null if it is malformed."""
    parts = F.split(name, "_", -1)
    number = lambda i: F.when(F.get(parts, i).rlike(r"^\+?[0-9]+$"), F.get(parts, i).try_cast("long"))
    values = [number(i) for i in range(3)]
    valid = (F.size(parts) == 3) & values[0].isNotNull() & values[1].isNotNull() & values[2].isNotNull()
    return F.when(valid, F.struct(values[0].alias("seq"), values[1].alias("offset"), values[2].alias("len")))


#: Fixed messages of the three errors of a location.
NO_SCHEME = "S3 Uri must start with s3:// or S3://"
NO_KEY = "Missing key from S3 Uri"
INCOMPLETE = "Incomplete S3 Uri"


def parse_location(uri: Column) -> dict[str, Column]:
    """bucket, key and error of an s3 location."""
    scheme = uri.startswith("s3://") | uri.startswith("S3://")
    rest = F.substring(uri, 6, 1 << 30)
    slash = F.instr(rest, "/")
    key = F.when(slash > 0, rest.substr(slash + 1, F.length(rest)))
    error = F.when(~scheme, NO_SCHEME).when(slash == 0, INCOMPLETE).when(key == "", NO_KEY)
    return {"bucket": F.when(error.isNull(), rest.substr(F.lit(1), slash - 1)), "key": F.when(error.isNull(), key), "error": error}


def split_directory(path: Column) -> dict[str, Column]:
    """directory and file name, cut at the last slash."""
    name = F.substring_index(path, "/", -1)
    cut = F.length(path) - F.length(name) - 1
    return {"directory": F.when(cut >= 0, path.substr(F.lit(1), cut)).otherwise(""), "name": name}


def staging_root(root: str, key: str) -> tuple[str, str]:
    """Location of a file's root and of its inode, for a root location and a key."""
    if not root.startswith("s3://"):
        raise ValueError(f"not a staging root: {root}")
    at = f"{root}{'' if root.endswith('/') else '/'}{key}"
    return at, f"{at}/{INODE_NAME}"


def staging_path(bucket: str, key: str, root: str = "", inode: str = INODE_NAME) -> tuple[str, str]:
    """The same for a bucket, with one slash trimmed where the parts meet."""
    parts = [p for p in (root.removesuffix("/"), key.removeprefix("/")) if p]
    at = f"s3://{bucket}/{'/'.join(parts)}"
    return at, f"{at}/{inode}"


def derive(locations: tuple[str, str], old: str, new: str) -> tuple[str, str]:
    return locations[0].replace(old, new), locations[1].replace(old, new)
