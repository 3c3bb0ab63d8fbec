"""Joins: last-wins enrichment, latest rows, cascading lookups, merges, diffs and keyed upserts.

Build sides are reduced to one row per key before they are joined, by groupings that combine before
they shuffle; which side is broadcast is left to Spark, which knows the sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import numbered_in_order


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the largest order per key (nulls lowest), all columns."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    best = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select("_row.*")


def first_wins(rows: DataFrame, keys: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    """The row that came first per key; ``order`` must be an explicit arrival order."""
    named = rows.select("*", *[(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)])
    best = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return named.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(best).select("_row.*")


def enrich_last_wins(left: DataFrame, right: DataFrame, key: str, order: Sequence[str], override: Sequence[str]) -> DataFrame:
    """Left rows with the last right row of their key; non-empty right values replace the named columns.

    Adds ``joined``, whether a right row was found.
    """
    r = latest(right, [key], order).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in override])
    out = left.join(r, F.col(key) == F.col("_key"), "left")
    filled = {c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("").cast(r.schema[f"_{c}"].dataType)) if r.schema[f"_{c}"].dataType.typeName() == "string" else F.col(f"_{c}"), F.col(c)) for c in override}
    return out.withColumns(filled | {"joined": F.col("_key").isNotNull()}).select(*left.columns, "joined")


def cascade_lookup(
    left: DataFrame, right: DataFrame, tiers: Sequence[Sequence[str]], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Left rows with the newest right row of the first tier of keys that finds one.

    Each tier is an equi-join with a right side of one row per key; ``tier`` numbers the one used.
    """
    out = left
    for n, keys in enumerate(tiers):
        best = F.max_by(F.struct(*values), F.struct(*order)).alias(f"_v{n}")
        side = right.dropna(subset=list(keys)).groupBy(*[F.col(k).alias(f"_t{n}_{k}") for k in keys]).agg(best)
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(k) == F.col(f"_t{n}_{k}"))
        out = out.join(side, on, "left").drop(*[f"_t{n}_{k}" for k in keys])
    found = F.coalesce(*[F.col(f"_v{n}") for n in range(len(tiers))])
    tier = F
    for n in range(len(tiers)):
        tier = tier.when(F.col(f"_v{n}").isNotNull(), n)
    return out.select(*left.columns, *[found[v].alias(v) for v in values], tier.alias("tier"))


def either_key(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], id: str, name: str) -> DataFrame:
    """Largest right id that agrees with the left row on any of the key pairs.

    One equi-join per pair instead of a condition with OR, which would compare all rows.
    """
    out = left
    for n, (a, b) in enumerate(pairs):
        side = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias(f"_b{n}")).agg(F.max(id).alias(f"_i{n}"))
        out = out.join(side, F.col(a) == F.col(f"_b{n}"), "left").drop(f"_b{n}")
    found = [F.col(f"_i{n}") for n in range(len(pairs))]
    return out.select(*left.columns, (F.greatest(*found) if len(found) > 1 else found[0]).alias(name))


def nonempty(df: DataFrame, c: str, prefix: str = "") -> Column:
    """Not null, no blank text, no empty collection; zero and false are values."""
    kind, x = df.schema[c].dataType.typeName(), F.col(prefix + c)
    if kind == "string":
        return F.coalesce(F.trim(x) != "", F.lit(False))
    if kind in ("array", "map"):
        return F.coalesce(F.size(x) > 0, F.lit(False))
    return x.isNotNull()


def coalescing_merge(existing: DataFrame, fresh: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Full outer join on the key: non-empty fresh values win, except in the ``keep`` columns of known rows.

    Map columns are merged entry by entry.  Both sides must have one row per key.  Adds ``origin``:
    existing, fresh or both.
    """
    columns = [c for c in existing.columns if c != key]
    e = existing.select(F.col(key).alias("e_key"), *[F.col(c).alias(f"e_{c}") for c in columns])
    f = fresh.select(F.col(key).alias("f_key"), *[F.col(c).alias(f"f_{c}") for c in columns])
    out = e.join(f, F.col("e_key") == F.col("f_key"), "full")

    def value(c: str) -> Column:
        old, new = F.col(f"e_{c}"), F.col(f"f_{c}")
        if c in keep:
            return F.when(nonempty(existing, c, "e_"), old).otherwise(new)
        if existing.schema[c].dataType.typeName() == "map":
            both = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
            return F.when(old.isNotNull() & new.isNotNull(), both).otherwise(F.coalesce(new, old))
        return F.when(nonempty(existing, c, "f_"), new).otherwise(old)

    origin = F.when(F.col("f_key").isNull(), "existing").when(F.col("e_key").isNull(), "fresh").otherwise("both")
    return out.select(F.coalesce("e_key", "f_key").alias(key), *[value(c).alias(c) for c in columns], origin.alias("origin"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, changed_columns) of rows added, removed or changed; equal rows are left out."""
    columns = [c for c in before.columns if c != key]
    b = before.select(F.col(key).alias("b_key"), F.struct(*columns).alias("b_row"))
    a = after.select(F.col(key).alias("a_key"), F.struct(*columns).alias("a_row"))
    both = b.join(a, F.col("b_key") == F.col("a_key"), "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b_row.{c}").eqNullSafe(F.col(f"a_row.{c}")), F.lit(c)) for c in sorted(columns)]))
    out = both.select(
        F.coalesce("b_key", "a_key").alias(key),
        F.when(F.col("b_key").isNull(), "added").when(F.col("a_key").isNull(), "removed").otherwise("changed").alias("change"),
        F.when(F.col("b_key").isNotNull() & F.col("a_key").isNotNull(), changed).otherwise(F.array().cast("array<string>")).alias("changed_columns"),
    )
    return out.where((F.col("change") != "changed") | (F.size("changed_columns") > 0))


def unapproved_removals(before: DataFrame, after: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows of the old snapshot that are gone without an allowance that has a reason."""
    ok = allowed.where(F.trim(F.coalesce("reason", F.lit(""))) != "").select(key)
    return before.join(after.select(key), key, "left_anti").join(ok, key, "left_anti")


def upsert(snapshot: DataFrame, batch: DataFrame, keys: Sequence[str], compared: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The snapshot after a batch, with ``status`` of each row: inserted, updated, skipped or kept.

    A batch row equal to its snapshot row on the compared columns (nulls equal) is skipped.  Several
    batch rows with a key count as one, the last in the batch's arrival ``order`` (columns of the batch;
    ties, and a batch without an order, go by all columns); keys match null-safely.
    """
    columns = snapshot.columns
    ordered = batch.select(*[F.col(o).alias(f"_o{n}") for n, o in enumerate(order)], *columns)
    newest = latest(ordered, keys, [*[f"_o{n}" for n in range(len(order))], *[c for c in columns if c not in keys]]).select(*columns)
    s = snapshot.select(*[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("s_there"))
    b = newest.select(*[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("b_there"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"s_{k}").eqNullSafe(F.col(f"b_{k}"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"s_{c}").eqNullSafe(F.col(f"b_{c}"))
    status = F.when(F.col("b_there").isNull(), "kept").when(F.col("s_there").isNull(), "inserted").when(same, "skipped").otherwise("updated")
    take = F.col("status").isin("inserted", "updated")
    out = s.join(b, on, "full").withColumn("status", status)
    return out.select(*[F.when(take, F.col(f"b_{c}")).otherwise(F.col(f"s_{c}")).alias(c) for c in columns], "status")


def applied_in_order(snapshot: DataFrame, batch: DataFrame, keys: Sequence[str], compared: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The batch rows with the ``status`` each has when they are applied one by one in arrival order.

    A row meets what the row of its key before it left, the first one the snapshot's row: inserted,
    updated, or skipped when the compared columns are equal (nulls equal).
    """
    s = snapshot.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.struct(*compared).alias("_stored"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"s_{k}"))
    now = F.struct(*compared)
    out = batch.join(s, on, "left").withColumn("_now", now)
    before = F.coalesce(F.lag("_now").over(Window.partitionBy(*keys).orderBy(*order)), F.col("_stored"))
    out = out.withColumn("_before", before)
    status = F.when(F.col("_before").isNull(), "inserted").when(F.col("_before").eqNullSafe(F.col("_now")), "skipped").otherwise("updated")
    return out.withColumn("status", status).select(*batch.columns, "status")


def resolved_keys(batch: DataFrame, snapshot: DataFrame, tiers: Sequence[Sequence[str]], key: str, name: str = "stored_key") -> DataFrame:
    """The batch rows with the key of the stored row they stand for, and the ``tier`` that found it.

    Tiers of columns are tried in turn, such as the hash, the address, then title and day; of several
    stored rows the largest key counts.  Rows that no tier finds have no stored key.
    """
    right = snapshot.select(F.col(key).alias(name), *dict.fromkeys(c for t in tiers for c in t))
    return cascade_lookup(batch, right, tiers, [name], [name])


def add_missing(known: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Rows of ``more`` whose key is not known yet, each key once."""
    return more.join(known.select(key), key, "left_anti").dropDuplicates([key])


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str, template: str = "") -> DataFrame:
    """Adds a running number by a total order, formatted if there is a template; no task gets all rows."""
    out = numbered_in_order(rows, order, name)
    return out.withColumn(name, F.format_string(template, name)) if template else out


def tagged_by_packs(rows: DataFrame, text: Column, packs: Mapping[str, Sequence[str]]) -> Column:
    """Array of structs (pack, terms) of the packs with a term in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    all_packs = F.array(*[F.struct(F.lit(p).alias("pack"), F.array(*[F.lit(t) for t in terms]).alias("terms")) for p, terms in packs.items()])
    hit = F.transform(all_packs, lambda p: F.struct(p["pack"].alias("pack"), F.filter(p["terms"], lambda t: F.contains(low, F.lower(t))).alias("terms")))
    return F.filter(hit, lambda p: F.size(p["terms"]) > 0)


def vanished(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, before): groups of ``old`` without a row in ``new``, with their rows; both are reduced to keys first."""
    counts = old.groupBy(key).agg(F.count(F.lit(1)).alias("before"))
    return counts.join(new.select(key).distinct(), key, "left_anti")
