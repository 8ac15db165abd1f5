"""Merges of new rows into kept ones: each gives the new state as a DataFrame; audits are joins of the same inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import ranked


def _both(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new rows side by side, by keys that are equal or both null: structs ``_o`` and ``_n``."""
    k = [F.struct(*(F.col(c) for c in keys)).alias("_k")]
    a = old.select(*k, F.struct(*old.columns).alias("_o"))
    b = new.select(*k, F.struct(*new.columns).alias("_n"))
    return a.join(b, "_k", "full")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], policy: dict[str, str] | str = "coalesce") -> DataFrame:
    """Updates rows with equal keys and adds the others. A column's policy: ``coalesce`` (a new value unless null), ``overwrite`` or ``keep``."""
    of = lambda c: policy if isinstance(policy, str) else policy.get(c, "coalesce")
    out = []
    for c in old.columns:
        o, n = F.col(f"_o.{c}"), F.col(f"_n.{c}") if c in new.columns else None
        if n is None or c in keys:
            value = o if n is None else F.coalesce(n, o)
        elif of(c) == "coalesce":
            value = F.coalesce(n, o)
        elif of(c) == "overwrite":
            value = F.when(F.col("_n").isNotNull(), n).otherwise(o)
        else:
            value = F.when(F.col("_o").isNotNull(), o).otherwise(n)
        out.append(value.alias(c))
    return _both(old, new, keys).select(*out)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds rows whose keys aren't there yet; of several new rows with equal keys the least stays."""
    new = new.groupBy(*keys).agg(F.min(F.struct(*(c for c in new.columns if c not in keys), F.lit(0))).alias("_n")).select(*(F.col(c) if c in keys else F.col(f"_n.{c}").alias(c) for c in new.columns))
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns), allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, parent: str, keys: Sequence[str]) -> DataFrame:
    """For each parent in ``new``, its children are replaced by those of ``new``; others stay."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.dropDuplicates([parent, *keys]).select(*old.columns))


def delete(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns)


def unmatched(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The audit of new rows that meet no kept row."""
    return new.join(old.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns)


def changed(old: DataFrame, new: DataFrame, key: str, hash: str) -> DataFrame:
    """Keys whose hash differs, a null hash included."""
    pair = old.select(key, F.col(hash).alias("_old")).join(new.select(key, F.col(hash).alias("_new")), key)
    return pair.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(key)


def entries(rows: DataFrame, json: str, key: str = "key", value: str = "value") -> DataFrame:
    """The entries of JSON objects, a row each, values as text; what isn't an object has none."""
    found = F.try_variant_get(F.try_parse_json(json), "$", "map<string, string>")
    return rows.select(*(c for c in rows.columns if c != json), F.explode(found).alias(key, value))


def compared(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: in old only, in new only, or in both."""
    side = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "old").otherwise("both")
    return _both(old, new, keys).select("_k.*", side.alias("found_in"))


def statistics(old: DataFrame, new: DataFrame, keys: Sequence[str], differs: Column | None = None) -> DataFrame:
    """One row: rows read, matched, unmatched and updated (``differs`` over structs _o and _n)."""
    both = _both(old, new, keys).filter("_n is not null")
    there = F.col("_o").isNotNull()
    update = there if differs is None else there & differs
    return both.agg(F.count("*").alias("n_rows"), F.count(F.when(there, 1)).alias("n_matched"), F.count(F.when(~there, 1)).alias("n_unmatched"), F.count(F.when(update, 1)).alias("n_updated"))


def numbered_slugs(rows: DataFrame, base: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """Rows with a slug of their own: the base where it is free, else the base and a number above all that go with it.

    First of all each free base goes to its first row by ``order``. The other rows' numbers begin above those that taken
    slugs, and bases just given away, bear after their base; so no two slugs are equal, whatever bases end with numbers.
    A null base gives a null slug. ``taken``: a column slug.
    """
    known = rows.sparkSession.createDataFrame([], "slug string") if taken is None else taken.select("slug")
    out = ranked(rows, [base], [F.col(order)], "_nth")
    gone = known.filter("slug is not null").select(F.col("slug").alias("_b")).distinct().withColumn("_gone", F.lit(1))
    out = out.join(gone, F.col(base) == F.col("_b"), "left").drop("_b")
    bases = rows.filter(F.col(base).isNotNull()).select(F.col(base).alias("slug")).distinct()
    all_taken = known.filter("slug is not null").union(bases)
    number = F.regexp_extract("slug", "-([0-9]+)$", 1).try_cast("bigint")
    top = all_taken.filter(number.isNotNull()).groupBy(F.regexp_replace("slug", "-[0-9]+$", "").alias("_stem")).agg(F.max(number).alias("_top"))
    out = out.join(top, F.col(base) == F.col("_stem"), "left").drop("_stem")
    nth = F.col("_nth") - F.when(F.col("_gone").isNull(), 1).otherwise(0)
    slug = F.when(nth == 0, F.col(base)).otherwise(F.concat(base, F.lit("-"), (F.coalesce("_top", F.lit(0)) + nth).cast("string")))
    return out.withColumn("slug", slug).drop("_nth", "_gone", "_top")


def copied(rows: DataFrame, id: str, **changes: Column) -> DataFrame:
    """Rows to be inserted anew, with what they are copies of: ``changes`` set columns, the id goes to copied_from_id."""
    return rows.withColumn("copied_from_id", F.col(id)).drop(id).withColumns(changes)


def inserted_or_existing(inserted: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, and the existing ones whose keys are not among them, with ``found``."""
    return inserted.withColumn("found", F.lit("inserted")).unionByName(unmatched(existing, inserted, keys).withColumn("found", F.lit("existing")))


def bulk_load(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Writes a fresh table, in folders by ``by`` columns if any; what stood there goes."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)
