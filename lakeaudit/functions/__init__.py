"""Scalar Column functions: paths, digests, sizes, globs, status predicates."""

from lakeaudit.functions.paths import (  # noqa: F401
    ancestors, base_name, component_pairs, depth, join_path, parent_dir, relativize,
)
from lakeaudit.functions.hashing import (  # noqa: F401
    check_algo, content_hash, pick_hash, row_fingerprint,
)
from lakeaudit.functions.sizes import format_size, parse_size  # noqa: F401
from lakeaudit.functions.glob import glob_regex, glob_to_regex  # noqa: F401
from lakeaudit.functions.status import is_error_or_warning, is_verbose  # noqa: F401
