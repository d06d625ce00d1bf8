"""What the operators of this folder share: cuts of the lineage, scratch tables, partition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from assaylake.sources.scratch import cut, new_folder, shared_dir, written

__all__ = ["blocks_for", "cut", "new_folder", "shared_dir", "unused", "written"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for added columns: the given ones, each with as many _ after it as keep it apart from the columns of df, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def blocks_for(rows: int, per_block: int) -> int:
    """How many blocks of about per_block rows; it grows with the table, at every size alike."""
    return max(1, -(-rows // per_block))
