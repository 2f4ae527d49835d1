"""A2: choose the capacity file of a release manifest.

Manifest rows: ``release_ord, release, file_ord, filename, url``.  Walk the
releases in order; within a release the first file matching tier 1
(``_capacity_by_{region_token}{_and_month}{_and_system_size}``), else tier 2
(``_capacity_by_`` and the region token, or ``_capacity_by_{region}``), else
tier 3 (``_capacity_by_`` and the region); stop at the first release with any
match.  One filter and one ``min_by`` aggregate over the manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def region_token(region: str, boundaries_version: str) -> str:
    return f"{boundaries_version}_GSP" if region == "gsp" else region


def choose_release(manifest: DataFrame, region: str = "gsp", include_history: bool = True,
                   by_system_size: bool = False, boundaries_version: str = "20250101") -> DataFrame:
    """Zero or one row: ``release, filename, url, tier``."""
    tok = region_token(region, boundaries_version)
    # Fragments of the release files' names.
    target = f"_capacity_by_{tok}" + ("_and_month" if include_history else "") + (
        "_and_system_size" if by_system_size else ""
    )
    f = F.col("filename")
    cap = f.contains("_capacity_by_")
    tier = (
        F.when(f.contains(target), 1)
        .when(cap & (f.contains(tok) | f.contains(f"_capacity_by_{region}")), 2)
        .when(cap & f.contains(region), 3)
    )
    m = manifest.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    best = m.groupBy().agg(
        F.min_by(F.struct("release", "filename", "url", "tier"),
                 F.struct("release_ord", "tier", "file_ord")).alias("_b")
    )
    return best.filter(F.col("_b").isNotNull()).select("_b.*")
