"""Re-audits as a stream: findings arrive with each audit of a site, and what changed leaves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "site string, audit long, slug string, change string"


def _diff(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps a site's last audit; a later one is compared with it, an earlier one is late and left out."""
    rows = pd.concat(list(batches))
    last, known = state.get if state.exists else (-1, "")
    before = set(filter(None, known.split(",")))
    out = []
    for audit, group in sorted(rows.groupby("audit")):
        if audit <= last:
            continue
        now = set(group["slug"].dropna())
        out += [(key[0], audit, s, "raised") for s in sorted(now - before)] + [(key[0], audit, s, "resolved") for s in sorted(before - now)]
        last, before = audit, now
    state.update((int(last), ",".join(sorted(before))))
    yield pd.DataFrame(out, columns=["site", "audit", "slug", "change"])


def changes(findings: DataFrame) -> DataFrame:
    """(site, audit, slug, change) from a stream of (site, audit, slug): an audit without findings comes as one null slug."""
    return findings.groupBy("site").applyInPandasWithState(_diff, CHANGES, "audit long, slugs string", "append", GroupStateTimeout.NoTimeout)


def severity_windows(findings: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings by severity in windows of event time (a column ts), closed once the watermark has passed."""
    return findings.withWatermark("ts", late).groupBy(F.window("ts", width), "severity").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "severity", "n")
