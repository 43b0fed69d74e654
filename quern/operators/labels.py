"""Label maps as tables: raw labels to classes, codes and their aliases, dense ids.

types: (defect_type, iso_code, train_class_id), a row for each class.  aliases: (defect_type, iso_code).
mapping: (source, raw_label, defect_type), a null class for a normal label.  policies: (source, unmapped: fail or skip).
These are configuration: thousands of rows at most (checked), so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast; an error if it is no small table."""
    if (n := df.limit(MOST + 1).count()) > MOST:
        raise ValueError(f"a label map of more than {MOST} rows: {n}")
    return F.broadcast(df)


def map_labels(rows: DataFrame, mapping: DataFrame, policies: DataFrame, source: str = "source", raw: str = "raw_label") -> DataFrame:
    """``rows`` with defect_type and is_normal; a label that is not mapped is null, or an error where its source's policy is fail."""
    known = mapping.select(F.col("source").alias("_s"), F.col("raw_label").alias("_r"), F.col("defect_type").alias("_t"), F.lit(True).alias("_known"))
    rules = policies.select(F.col("source").alias("_p"), F.col("unmapped").alias("_unmapped"))
    out = rows.join(small(known), (F.col(source) == F.col("_s")) & (F.col(raw) == F.col("_r")), "left").join(small(rules), F.col(source) == F.col("_p"), "left")
    lost = F.col("_known").isNull() & (F.coalesce("_unmapped", F.lit("fail")) == "fail")
    message = F.concat(F.lit("label without a class: "), F.coalesce(F.col(source), F.lit("null")), F.lit("/"), F.coalesce(F.col(raw), F.lit("null")))
    kind = F.when(lost, F.raise_error(message).cast("string")).otherwise(F.col("_t"))
    return out.select(*rows.columns, kind.alias("defect_type"), (F.col("_known").isNotNull() & F.col("_t").isNull()).alias("is_normal"))


def codes(types: DataFrame, aliases: DataFrame, with_aliases: bool = True) -> DataFrame:
    """(iso_code): all codes that the map knows."""
    out = types.select("iso_code")
    return (out.union(aliases.select("iso_code")) if with_aliases else out).distinct()


def classes_of_codes(rows: DataFrame, code: str, types: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` with defect_type, aliases resolved too; an unknown code is an error.  Of several classes of a code the least."""
    every = types.select("iso_code", "defect_type").union(aliases.select("iso_code", "defect_type")).groupBy("iso_code").agg(F.min("defect_type").alias("defect_type"))
    every = every.select(F.col("iso_code").alias("_c"), F.col("defect_type").alias("_t"))
    kind = F.coalesce("_t", F.raise_error(F.concat(F.lit("unknown code: "), F.coalesce(F.col(code), F.lit("null")))).cast("string"))
    return rows.join(small(every), F.col(code) == F.col("_c"), "left").select(*rows.columns, kind.alias("defect_type"))


def dense_ids(types: DataFrame, space: list[str]) -> DataFrame:
    """(defect_type, dense_id): 0, 1, ... in the order of train_class_id among the classes of a space."""
    mine = types.where(F.col("defect_type").isin(space))
    before = small(mine.select(F.col("train_class_id").alias("_i")))
    # The number of classes with a smaller id; no window over one partition.
    return mine.join(before, F.col("_i") < F.col("train_class_id"), "left").groupBy("defect_type").agg(F.count("_i").cast("int").alias("dense_id"))


def codes_of_types(joined: Column, types: DataFrame) -> Column:
    """The codes, joined by ;, of classes joined by ; in the same order; an unknown class is an error."""
    found = {r["defect_type"]: r["iso_code"] for r in types.select("defect_type", "iso_code").limit(MOST).collect()}  # configuration
    table = F.create_map(*[F.lit(x) for kv in found.items() for x in kv]) if found else F.create_map().cast("map<string,string>")
    each = F.filter(F.split(F.coalesce(joined, F.lit("")), ";"), lambda x: x != "")
    code = lambda x: F.coalesce(F.element_at(table, x), F.raise_error(F.concat(F.lit("unknown class: "), x)).cast("string"))
    return F.array_join(F.transform(each, code), ";")
