"""What changed between full snapshots of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many deliveries their list goes to every task; beyond, rows are joined with it by number.
BROADCAST_DELIVERIES = 200_000


def snapshot_changes(rows: DataFrame, snapshot: str, key: list[str], content: str, version: str, broadcast: int = BROADCAST_DELIVERIES) -> DataFrame:
    """Keys added, removed or changed between consecutive snapshots.

    One shuffle on the key serves the choice of a row per snapshot and key, the lag over the
    hashes, and the gaps in the snapshot index. Result: the snapshot number of the later
    delivery, the key, and `change` in added, removed, changed.

    - Within a snapshot the row with the latest `version` holds; null is earliest, and among
      equal versions the largest content. Repeated rows count once.
    - Content is compared null-safe: null to null is no change.
    - Rows with a null snapshot number or a null in the key have no identity and are left out.
    - One snapshot or an empty table gives no rows. Further columns are not read.
    - Any number of deliveries; only their count comes to the driver.
    """
    present = rows.where(F.col(snapshot).isNotNull())
    numbers = present.select(snapshot).distinct()
    order = Window.orderBy(snapshot)  # over the distinct numbers alone
    listed = numbers.select(F.col(snapshot).alias("_no"), F.lag(snapshot).over(order).alias("_prior"), F.lead(snapshot).over(order).alias("_later"))
    listed = F.broadcast(listed) if numbers.count() <= broadcast else listed
    for k in key:
        present = present.where(F.col(k).isNotNull())
    by_key = Window.partitionBy(*key).orderBy("_no")
    state = (
        present.select(*key, F.col(snapshot).alias("_no"), F.struct(F.col(version).alias("v"), F.col(content).alias("h")).alias("_row"))
        .repartition(*key)
        .groupBy(*key, "_no")
        .agg(F.max("_row").alias("_row"))
        .select(*key, "_no", F.col("_row.h").alias("_h"))
        .withColumns({"_before": F.lag("_no").over(by_key), "_old": F.lag("_h").over(by_key), "_after": F.lead("_no").over(by_key)})
        .join(listed, "_no")
    )
    no, before, after, prior, later = (F.col(c) for c in ("_no", "_before", "_after", "_prior", "_later"))
    new = prior.isNotNull() & ~before.eqNullSafe(prior)
    changed = before.eqNullSafe(prior) & prior.isNotNull() & ~F.col("_old").eqNullSafe(F.col("_h"))
    gone = later.isNotNull() & ~after.eqNullSafe(later)
    event = lambda at, what: F.struct(at.alias("at"), F.lit(what).alias("change"))
    events = F.filter(F.array(F.when(new, event(no, "added")), F.when(changed, event(no, "changed")), F.when(gone, event(later, "removed"))), lambda e: e.isNotNull())
    return state.select(*key, F.explode(events).alias("e")).select(F.col("e.at").alias(snapshot), *key, F.col("e.change").alias("change"))
