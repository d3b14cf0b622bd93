"""Table shapes and status codes."""

from __future__ import annotations

from pyspark.sql import types as T

# Manifest (snapshot) columns, in this order on every write.
MANIFEST_COLUMNS = ["dir", "name", "path", "mod_ms", "algo", "hash", "size"]

MANIFEST_SCHEMA = T.StructType([
    T.StructField("dir", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("mod_ms", T.LongType(), True),
    T.StructField("algo", T.StringType(), True),
    T.StructField("hash", T.StringType(), True),
    T.StructField("size", T.LongType(), True),
])

DIRS_SCHEMA = T.StructType([
    T.StructField("dir", T.StringType(), False),
    T.StructField("subdir", T.StringType(), False),
])


class Status:
    """Event codes.  Fixed values shared with the manifest tool's log format.

    ``ok`` is written without the trailing pad the terminal log uses.
    """

    PANIC = "PNC"      # read error
    DAMAGE = "DMG"     # same mtime, different hash
    BAD_INDEX = "ERX"  # manifest seal does not verify
    OLD = "old"        # replaced by an older version
    UPDATE = "upd"     # modified
    NEW = "new"
    OK = "ok"
    DELETED = "del"
    IGNORED = "ign"
    INFO = "msg"
    INDEX_UPDATE = "xup"  # internal, never reported

    ERROR_OR_WARNING = (PANIC, DAMAGE, BAD_INDEX, OLD)
    VERBOSE = (OK, IGNORED)
    FAILING = (DAMAGE, PANIC)


HASH_ALGOS = ("md5", "sha512")
