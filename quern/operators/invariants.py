"""What must hold between the tables of a snapshot, as rows (check, key); and nested records made into these tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalars import order_key
from quern.operators.checks import orphans, repeated, several, violations
from quern.operators.labels import small
from quern.sources.catalog import DEFECTS, IMAGES

PIXELS = ("bbox_x1_px", "bbox_y1_px", "bbox_x2_px", "bbox_y2_px", "area_px", "major_axis_px", "minor_axis_px", "equiv_diameter_px")
MILLIMETRES = ("major_axis_mm", "equiv_diameter_mm")
BOX = ("bbox_x1_px", "bbox_y1_px", "bbox_x2_px", "bbox_y2_px")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def image_faults(images: DataFrame, defects: DataFrame, types: DataFrame, version: int, files: DataFrame | None = None, share: float = 0.01, seed: str = "faults") -> DataFrame:
    """(check, key), empty if all hold.

    IV1 repeated or orphaned keys; IV2 counts of defects; IV3 joined types, unknown types, codes that are not the type's; IV4 geometry without
    localisation; IV5 millimetres without a scale; IV6 evaluation if and only if without client; IV7 groups over splits; IV8 groups over
    clients, wrong group sizes; IV9 a subset outside evaluation; IV10 boxes out of the picture; IV11 versions; IV12 digests of a seeded
    sample (max(1, share of the images)) of ``files`` (image_id, sha256) that differ or are not there; SCHEMA columns out of order.
    """
    m, a = images, defects
    key = lambda df, cond, c="image_id": df.where(cond).select(c)
    per = a.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"), F.array_join(F.array_sort(F.collect_set("defect_type")), ";").alias("_t"))
    mc = m.join(per, "image_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    code = a.select("ann_id", "defect_type", "iso_code").where("defect_type is not null").join(small(types.select("defect_type", F.col("iso_code").alias("_c"))), "defect_type", "left")
    with_image = a.join(m.select("image_id", "has_localization", "px_per_mm", "width_px", "height_px"), "image_id")
    some = lambda cols: F.greatest(*[F.col(c).isNotNull().cast("int") for c in cols]) == 1
    size = m.groupBy("group_id").agg(F.count(F.lit(1)).alias("_g"))
    x1, y1, x2, y2 = (F.col(c) for c in BOX)
    box = (x1 < 0) | (y1 < 0) | (x1 >= x2) | (y1 >= y2) | (x2 > F.col("width_px")) | (y2 > F.col("height_px"))
    sub = F.col("eval_subset").isNotNull() & (F.col("eval_subset") != "")
    found = {
        "IV1 image": repeated(m, "image_id"), "IV1 defect": repeated(a, "ann_id"), "IV1 orphan": orphans(a, "image_id", m, "image_id"),
        "IV2": key(mc, (F.col("n_defects") != F.col("_n")) | (F.col("has_defect") != (F.col("_n") > 0))),
        "IV3 types": key(mc, F.coalesce("defect_types", F.lit("")) != F.coalesce("_t", F.lit(""))), "IV3 unknown": code.where("_c is null").select("defect_type").distinct(),
        "IV3 code": code.where(F.col("_c").isNotNull() & ~F.col("_c").eqNullSafe(F.col("iso_code"))).select("ann_id"),
        "IV4": key(with_image, ~_yes(F.col("has_localization")) & some(PIXELS), "ann_id"), "IV5": key(with_image, F.col("px_per_mm").isNull() & some(MILLIMETRES), "ann_id"),
        "IV6": key(m, _yes(F.col("split") == "eval") != (F.col("client").isNull() | _yes(F.col("client") == ""))),
        "IV7": several(m, "group_id", F.col("split")), "IV8 client": several(m, "group_id", F.col("client")), "IV8 size": key(m.join(size, "group_id"), F.col("group_size") != F.col("_g")),
        "IV9": key(m, sub & ~_yes(F.col("split") == "eval")), "IV10": key(with_image, x1.isNotNull() & box, "ann_id"), "IV11": key(m, ~F.col("label_map_version").eqNullSafe(F.lit(version))),
    }
    if files is not None:
        n = max(1, int(m.count() * share))
        sample = m.select("image_id", "sha256").orderBy(order_key(seed, F.col("image_id")), "image_id").limit(n)
        there = files.select("image_id", F.col("sha256").alias("_f"))
        found["IV12"] = sample.join(there, "image_id", "left").where(~F.col("sha256").eqNullSafe(F.col("_f"))).select("image_id")
    if a.columns != list(DEFECTS) or m.columns != list(IMAGES):
        found["SCHEMA"] = m.sparkSession.createDataFrame([("columns",)], "k string")
    return violations(found)


def record_tables(records: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(images, defects) of nested records, columns in order; a record with reject_reason makes none.

    A record has the image's own columns and ``defects``, an array of structs (seq, src_label_raw, defect_type, iso_code and what else the
    defect table has).  Grouping and split columns are null until they are made.
    """
    kept = records.where("reject_reason is null")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform("defects", lambda x: x[c]))), ";")
    n = F.coalesce(F.size("defects"), F.lit(0))
    made = {"has_defect": n > 0, "n_defects": n.cast("long"), "defect_types": joined("defect_type"), "iso_codes": joined("iso_code"), "src_labels_raw": joined("src_label_raw"), "label_map_version": F.lit(version).cast("long")}
    empty = ("phash_hex", "group_id", "group_size", "strata_key", "split", "client", "eval_subset")
    image = lambda c, kind: made[c] if c in made else F.lit(None) if c in empty or c not in records.columns else F.col(c)
    images = kept.select([F.coalesce(image(c, k), F.lit("")).cast(k).alias(c) if c in ("defect_types", "iso_codes", "src_labels_raw") else image(c, k).cast(k).alias(c) for c, k in IMAGES.items()])
    each = kept.select("image_id", F.explode("defects").alias("d"))
    fields = records.schema["defects"].dataType.elementType.names
    own = {"ann_id": F.concat("image_id", F.lit("#"), F.col("d.seq").cast("string")), "image_id": F.col("image_id")}
    defects = each.select([(own[c] if c in own else F.col(f"d.{c}") if c in fields else F.lit(None)).cast(k).alias(c) for c, k in DEFECTS.items()])
    return images, defects


def side_faults(images: DataFrame, defects: DataFrame, side_images: DataFrame, side_defects: DataFrame, side_regions: DataFrame, raw_source: str, matches: list[str], materials: list[str], kinds: list[str], frames: list[str], tile_frame: str, same_frame: str) -> DataFrame:
    """(check, key) between a snapshot and its three side tables: same keys on both sides, values in their domains, columns that belong together.

    raw_source, matches, materials, kinds and frames are the domains; tile_frame the frame of regions that are usable, same_frame the match of
    pictures whose raw coordinates hold.
    """
    raw = [f"raw_bbox_{c}_px" for c in ("x1", "y1", "x2", "y2")]
    def both(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
        x, y = a.select(c).distinct(), b.select(c).distinct()
        return x.join(y, c, "left_anti").union(y.join(x, c, "left_anti"))
    i, d, r = side_images, side_defects, side_regions
    text = lambda c: F.coalesce(c, F.lit(""))
    at = lambda df, cond, c: df.where(_yes(cond)).select(c)
    uncovered = ~_yes(F.col("covered"))
    value = (text("source_zip") != "") | (text("material_source") != "") | (text("frame_match") != "") | F.col("orig_width_px").isNotNull() | F.col("orig_height_px").isNotNull()
    nulls = sum((F.col(c).isNull().cast("int") for c in raw), F.lit(0))
    absorbed = text("raw_source") == raw_source
    j = d.join(i.select("image_id", "frame_match"), "image_id", "left").join(defects.select("ann_id", F.col("image_id").alias("_image"), *BOX, "geom_valid"), "ann_id", "left")
    same = F.lit(True)
    for a, b in zip(BOX, raw):
        same &= _yes(F.col(a) == F.col(b))
    empty = F.col("bbox_x1_px").isNull() & F.col("bbox_y1_px").isNull() & F.col("bbox_x2_px").isNull() & F.col("bbox_y2_px").isNull() & ~F.coalesce("geom_valid", F.lit(True))
    return violations({
        "image keys": both(i, images, "image_id"), "frame_match": at(i, (text("frame_match") != "") & ~F.col("frame_match").isin(matches), "image_id"), "uncovered value": at(i, uncovered & value, "image_id"),
        "covered frame": at(i, ~uncovered & (text("frame_match") == ""), "image_id"), "material": at(i, ~uncovered & ~text("material_source").isin(materials), "image_id"),
        "defect keys": both(d, defects, "ann_id"), "clip_kind": at(d, ~text("clip_kind").isin(kinds), "ann_id"), "raw_source": at(d, ~text("raw_source").isin(raw_source, ""), "ann_id"),
        "raw box": at(d, (absorbed & (nulls > 0)) | (~absorbed & (nulls < 4)), "ann_id"), "clip": at(d, _yes(F.col("clip_applied")) != (text("clip_kind") != "none"), "ann_id"),
        "raw frame": at(j, absorbed & (text("frame_match") != same_frame), "ann_id"), "defect image": at(j, F.col("_image").isNotNull() & (F.col("_image") != F.col("image_id")), "ann_id"),
        "unclipped": at(j, absorbed & (F.col("clip_kind") == "none") & ~(same | empty), "ann_id"),
        "frame": at(r, ~text("frame").isin(frames), "region_id"), "usable": at(r, _yes(F.col("usable_in_tile_frame")) != (text("frame") == tile_frame), "region_id"),
        "vertices": at(r, F.coalesce(F.size(F.from_json("polygon_json", "array<array<double>>")), F.lit(-1)) != F.col("n_vertices"), "region_id"),
        "region of defect": at(r.join(images.select("image_id", "has_defect"), "image_id"), F.col("has_defect"), "region_id"),
    })
