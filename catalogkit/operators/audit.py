"""Completeness, coverage, attribution, snapshot and source audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from catalogkit.functions.empty import has_value, is_unset
from catalogkit.operators.merge import Roles, attribution_conflict
from catalogkit.operators.ordered import one_per_key

KEY_FIELDS = ("title", "cover", "date", "owner")


def annotate_completeness(items: DataFrame, fields: Sequence[str] = KEY_FIELDS) -> DataFrame:
    """Adds ``missing_fields`` (in the order of ``fields``) and ``incomplete``."""
    gone = F.array(*[F.when(~has_value(F.col(f), items.schema[f].dataType), F.lit(f)) for f in fields])
    return items.withColumn("missing_fields", F.array_compact(gone)).withColumn("incomplete", F.size("missing_fields") > 0)


def assert_complete(items: DataFrame, fields: Sequence[str] = KEY_FIELDS) -> None:
    """Raises if a row lacks a key field.  Runs one aggregation."""
    n = annotate_completeness(items, fields).where("incomplete").count()
    if n:
        raise ValueError(f"{n} incomplete rows")


def validate_index(entities: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, key) of entities without a name and items without a code."""
    nameless = entities.where(is_unset(F.col("name"), entities.schema["name"].dataType)).select(F.lit("entity_without_name").alias("kind"), F.lit(None).cast("string").alias("key"))
    codeless = items.where(is_unset(F.col("code"), items.schema["code"].dataType)).select(F.lit("item_without_code").alias("kind"), F.col("owner").alias("key"))
    return nameless.unionByName(codeless)


def field_report(items: DataFrame, code: str, fields: Sequence[str], cut: int = 40, needed: Sequence[str] = KEY_FIELDS) -> DataFrame:
    """(field, present, preview, verdict) of one item: verdict is ok, gap, or missing for a gap in a needed field.

    An unknown code raises an error, which takes one small job."""
    row = items.where(F.upper("code") == code.strip().upper())
    if row.isEmpty():
        raise LookupError(f"no item {code.strip().upper()}")
    return field_reports(row, fields, cut, needed).drop("code")


def field_reports(items: DataFrame, fields: Sequence[str], cut: int = 40, needed: Sequence[str] = KEY_FIELDS) -> DataFrame:
    """(code, field, present, preview, verdict) of every item: previews are cut, arrays are counted."""
    parts = []
    for f in fields:
        kind = items.schema[f].dataType
        text = F.size(f).cast("string") if kind.typeName() in ("array", "map") else F.substring(F.col(f).cast("string"), 1, cut)
        has = has_value(F.col(f), kind)
        parts.append(F.struct(F.lit(f).alias("field"), has.alias("present"), text.alias("preview"), F.when(has, "ok").otherwise("missing" if f in needed else "gap").alias("verdict")))
    return items.select(F.upper("code").alias("code"), F.explode(F.array(*parts)).alias("r")).select("code", "r.*")


def field_coverage(items: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, present, total, pct) in one pass; pct is floored, 0 for an empty table."""
    counts = items.agg(F.count("*").alias("total"), *[F.count_if(has_value(F.col(f), items.schema[f].dataType)).alias(f) for f in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in fields]))
    out = counts.select("total", rows.alias("r")).select("r.field", "r.present", "total")
    return out.withColumn("pct", F.when(F.col("total") > 0, F.floor(100 * F.col("present") / F.col("total"))).otherwise(0).cast("long"))


def low_coverage(coverage: DataFrame, threshold: int) -> DataFrame:
    return coverage.where(F.col("pct") < threshold)


def missing_histogram(annotated: DataFrame) -> DataFrame:
    """(field, n) over the incomplete rows."""
    return annotated.select(F.explode("missing_fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def items_per_owner(items: DataFrame, owner: str = "owner") -> DataFrame:
    return items.groupBy(F.col(owner).alias("owner")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "owner")


def sweep_snapshots(old: DataFrame, new: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(key, class, owner, source, cast) of every key whose rows differ or that one side lacks.

    Of rows that share a key the smallest counts.  An old owner or source that changed is restored; a cast filled where there was none, without the
    owner in it, is reverted.  class: error, noise, cast_reverted, attrib_restored or kept."""
    k, columns = roles.key, [c for c in new.columns if c != roles.key and c in old.columns]
    old, new = (one_per_key(rows.select(k, *columns), [k]) for rows in (old, new))
    o = old.select(k, F.lit(True).alias("o__"), *[F.col(c).alias(f"o_{c}") for c in columns])
    n = new.select(k, F.lit(True).alias("n__"), *[F.col(c).alias(f"n_{c}") for c in columns])
    both = o.join(n, k, "full")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    rows = both.where(F.col("o__").isNull() | F.col("n__").isNull() | differs)
    kept = {c: F.col(f"n_{c}") for c in columns}
    restored = F.lit(False)
    for c in (roles.owner, roles.source):
        if c in columns:
            back = (F.coalesce(f"o_{c}", F.lit("")) != "") & ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
            kept[c] = F.when(back, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
            restored = restored | back
    reverted = F.lit(False)
    if roles.cast in columns:
        had = F.size(F.coalesce(f"o_{roles.cast}", F.array().cast("array<string>"))) > 0
        filled = F.size(F.coalesce(f"n_{roles.cast}", F.array().cast("array<string>"))) > 0
        reverted = ~had & filled & ~F.coalesce(F.exists(f"n_{roles.cast}", lambda x: roles.name(x) == roles.name(kept[roles.owner])), F.lit(False))
        kept[roles.cast] = F.when(reverted, F.col(f"o_{roles.cast}")).otherwise(F.col(f"n_{roles.cast}"))
    same = F.lit(True)
    for c in columns:
        same = same & kept[c].eqNullSafe(F.col(f"o_{c}"))
    label = (
        F.when(F.col("o__").isNull() | F.col("n__").isNull(), "error").when(reverted, "cast_reverted")
        .when(same, "noise").when(restored, "attrib_restored").otherwise("kept")
    )
    return rows.select(k, label.alias("class"), *[kept[c].alias(c) for c in (roles.owner, roles.source, roles.cast) if c in columns])


def fix_attribution(items: DataFrame, trusted: Sequence[str], force: bool = False, roles: Roles = Roles()) -> DataFrame:
    """Adds ``outcome`` (ok, fixed, protected, flagged) and sets owner and source of fixed rows.

    A cast of one name other than the owner is the fix; rows from trusted sources stay as they are unless
    ``force``, and a larger cast is only flagged."""
    found = items.withColumn("__c", attribution_conflict(F.col(roles.owner), F.col(roles.cast), roles))
    safe = F.coalesce(F.col(roles.source).isin(*trusted), F.lit(False))
    outcome = (
        F.when(~F.col("__c.conflict"), "ok").when(F.col("__c.suggested").isNull(), "flagged")
        .when(safe & F.lit(not force), "protected").otherwise("fixed")
    )
    found = found.withColumn("outcome", outcome)
    fixed = F.col("outcome") == "fixed"
    source = F.when(fixed & safe, "user_correction").when(fixed & F.coalesce(F.col(roles.source).isin("pending", ""), F.lit(True)), "attribution_fix").otherwise(F.col(roles.source))
    swap = {roles.owner: F.when(fixed, F.col("__c.suggested")).otherwise(F.col(roles.owner)), roles.source: source}
    return found.select(*[swap.get(c, F.col(c)).alias(c) for c in items.columns], "outcome")


def attribution_audit(items: DataFrame, observed: DataFrame, placeholders: Sequence[str] = (), roles: Roles = Roles()) -> DataFrame:
    """(key, stored, observed, status): no_data, placeholder, conflict or ok."""
    o = observed.groupBy(roles.key).agg(F.min(roles.owner).alias("observed"))
    joined = items.select(roles.key, F.col(roles.owner).alias("stored")).join(o, roles.key, "left")
    status = (
        F.when(F.coalesce("observed", F.lit("")) == "", "no_data").when(F.col("observed").isin(*placeholders or [""]), "placeholder")
        .when(roles.name(F.col("stored")) == roles.name(F.col("observed")), "ok").otherwise("conflict")
    )
    return joined.withColumn("status", status)


def reconcile(storage: DataFrame, items: DataFrame) -> DataFrame:
    """(file_name) of the stored files that no item's ``code`` + .json names."""
    return storage.select("file_name").join(items.select(F.concat("code", F.lit(".json")).alias("file_name")), "file_name", "left_anti")


def compare_sources(observations: DataFrame, fields: Sequence[str], key: str = "code") -> DataFrame:
    """(key, field, by_source, conflict): each source's value per field; blank counts as a value, arrays are joined."""
    text = lambda f: F.array_join(f, ",") if observations.schema[f].dataType.typeName() == "array" else F.coalesce(F.col(f).cast("string"), F.lit(""))
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in fields]))
    long = observations.select(key, "source", rows.alias("r")).select(key, "source", "r.field", F.coalesce("r.value", F.lit("")).alias("value"))
    return long.groupBy(key, "field").agg(
        F.array_sort(F.collect_list(F.concat_ws("=", "source", "value"))).alias("by_source"), (F.count_distinct("value") > 1).alias("conflict")
    )


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def event_counts(rows: DataFrame, events: str) -> DataFrame:
    """(event, n) over an array column such as ``filled``, ``changed_keys`` or ``events``."""
    return rows.select(F.explode(events).alias("event")).groupBy("event").agg(F.count("*").alias("n"))


def run_summary(result: DataFrame, flags: Sequence[str]) -> DataFrame:
    """One row: how many rows, and how many with each boolean flag."""
    return result.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def share_of_total(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds each row's share of the sum; ``counts`` is a short table of totals."""
    return counts.withColumn("share", F.round(F.col(n) / F.sum(n).over(Window.partitionBy(F.lit(1))), 6))


def counted(result: DataFrame, write: Callable[[DataFrame], None], flags: Sequence[str] = (), events: str | None = None, fields: Sequence[str] = ()) -> dict[str, int]:
    """Writes ``result`` by ``write``, in one job, and returns what it counted on the way: ``rows``, the rows with each boolean
    of ``flags``, and for each of ``fields`` the rows whose array ``events`` holds it (as ``field:name``).

    ``write`` runs one action on the whole table it is given.  Nulls count as false."""
    seen = Observation()
    wanted = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f)).alias(f) for f in flags]]
    wanted += [F.count_if(F.array_contains(events, f)).alias(f"field:{f}") for f in fields]
    write(result.observe(seen, *wanted))
    return seen.get
