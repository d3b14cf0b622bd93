"""lakeaudit: content integrity and duplicate space as Spark DataFrame jobs.

A manifest is a table of objects ``(dir, name, path, mod_ms, algo, hash, size)``.
Audits are joins of two manifests, duplicate detection is a group-by on the
hash, ignore rules are a join against ancestor directories.  Every operator
takes and returns DataFrames; nothing is collected to the driver except
scalars and rule tables whose size is checked first.
"""

from lakeaudit.session import get_spark, checkpoint_dir, conf_int  # noqa: F401
from lakeaudit.schema import MANIFEST_COLUMNS, Status  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "conf_int", "MANIFEST_COLUMNS", "Status"]
