"""Path algebra as Column expressions.

Paths are relative to a manifest root and use ``/``; the root itself is the
empty string.  All functions are built-in expressions, so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parent_dir(path) -> Column:
    """Directory part of ``path``; ``''`` for a top-level name."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def base_name(path) -> Column:
    """Last component of ``path``."""
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def join_path(dir_, name) -> Column:
    """Clean key (X7): ``dir/name``, or ``name`` when ``dir`` is the root.

    ``.`` as a directory is the root as well.
    """
    d = _c(dir_)
    d = (F.when(d.isin("", "."), F.lit(None))
         .when(d.endswith("/"), F.regexp_replace(d, "/+$", ""))  # rare: only then a regex
         .otherwise(d))
    return F.concat_ws("/", d, _c(name))


def join_dirs(*parts) -> Column:
    """Join directory parts with ``/``, skipping empty ones (``''`` is the root)."""
    cols = [_c(p) for p in parts]
    return F.concat_ws("/", *[F.when(c != "", c) for c in cols])


def path_parts(path) -> Column:
    return F.split(_c(path), "/")


def depth(path) -> Column:
    """Number of components: a name in the scan root has depth 1."""
    return F.when(_c(path) == "", F.lit(0)).otherwise(F.size(path_parts(path)))


def ancestors(dir_) -> Column:
    """All ancestor directories of ``dir_``, itself included, root excluded.

    ``a/b/c`` -> ``[a, a/b, a/b/c]`` with their depth; ``''`` -> ``[]``.
    """
    parts = path_parts(dir_)
    n = F.when(_c(dir_) == "", F.lit(0)).otherwise(F.size(parts))
    return F.when(n == 0, F.array().cast("array<struct<anc:string,depth:int>>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("anc"), i.alias("depth")),
        )
    )


def component_pairs(path) -> Column:
    """Every (entry, ancestor directory) pair along ``path`` (ignore join input).

    For ``c1/../ck`` and each prefix entry ``j`` (1..k) named ``cj`` and each
    directory ``i`` (0..j-1) above it, one struct:
    ``anc`` = ``c1/../ci`` (``''`` for the scan root), ``entry`` = ``cj``,
    ``rel`` = ``c(i+1)/../cj`` (the entry relative to ``anc``), ``own`` = ``i == j-1``
    (the rule file sits in the entry's own directory), ``j`` and ``entry_path``.
    """
    parts = path_parts(path)
    k = F.size(parts)
    return F.flatten(F.transform(
        F.sequence(F.lit(1), k),
        lambda j: F.transform(
            F.sequence(F.lit(0), j - 1),
            lambda i: F.struct(
                F.array_join(F.slice(parts, 1, i), "/").alias("anc"),
                F.element_at(parts, j).alias("entry"),
                F.array_join(F.slice(parts, i + 1, j - i), "/").alias("rel"),
                (i == j - 1).alias("own"),
                j.alias("j"),
                F.array_join(F.slice(parts, 1, j), "/").alias("entry_path"),
            ),
        ),
    ))


def own_pairs(path) -> Column:
    """As ``component_pairs``, for the last component of ``path`` only: one
    struct per directory above it."""
    parts = path_parts(path)
    k = F.size(parts)
    return F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.struct(
            F.array_join(F.slice(parts, 1, i), "/").alias("anc"),
            F.element_at(parts, -1).alias("entry"),
            F.array_join(F.slice(parts, i + 1, k - i), "/").alias("rel"),
            (i == k - 1).alias("own"),
            k.alias("j"),
            _c(path).alias("entry_path"),
        ),
    )


def relativize(path, root: str) -> Column:
    """Path relative to ``root`` (F6); null when ``path`` is not below it.

    The test is on ``root + '/'``, so ``data2/x`` is not below ``data``.
    ``root`` itself maps to ``.``.
    """
    p = _c(path)
    root = root.strip("/")
    if root in ("", "."):
        return p
    prefix = root + "/"
    return (
        F.when(p == F.lit(root), F.lit("."))
        .when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 30))
        .otherwise(F.lit(None).cast("string"))
    )
