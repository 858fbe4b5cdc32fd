"""Splits and folds by site, so that pages of one site stay together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOLDOUT_SHARE = 0.25


def site_hash01(site: Column) -> Column:
    """The first 32 bits of the site's md5, from 0 to 1."""
    return F.conv(F.substring(F.md5(site), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def split_of(site: Column) -> Column:
    return F.when(site_hash01(site) < HOLDOUT_SHARE, "holdout").otherwise("dev")


def fold_of(site: Column, k: int) -> Column:
    return F.pmod(F.floor(site_hash01(site) * k), F.lit(k)).cast("int")
