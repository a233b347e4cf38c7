"""Do granules share one spatial grid? Four sources, the first that says something decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from .criteria import NOT_OPENED, Archive, say
from .facts import ID


def tiff_lattice(tiffs: DataFrame) -> DataFrame:
    """(collection_id, status, note) from pixel sizes, projections and origins of tiles.

    scale, where there is one, is a tile's whole pixel size, px its first length; a missing one is a value of its own. Origins are compared in one projection only, with the first one seen; lattices of several projections are named in
    order. Collections without tiles have no row.
    """
    t = tiffs.withColumn("crs", F.coalesce("crs", F.lit("")))
    tied = t.where("x0 IS NOT NULL")
    first = tied.groupBy(ID, "crs").agg(F.min_by(F.struct("x0", "y0"), F.struct("gi", "x0", "y0")).alias("o"), F.count_distinct("x0", "y0").alias("origins"))
    scale = F.struct(F.col("scale") if "scale" in tiffs.columns else F.col("px"))
    sizes = t.groupBy(ID, scale.alias("scale")).agg(F.max("px").alias("px"))
    px = sizes.groupBy(ID).agg(F.count("*").alias("sizes"), F.max("px").alias("px"))
    away = lambda c: F.abs(F.col(c) - F.col(f"o.{c}") - F.col("px") * F.rint((F.col(c) - F.col(f"o.{c}")) / F.col("px"))) >= 1e-6
    off = tied.drop("px").join(first, [ID, "crs"]).join(px, ID).groupBy(ID, "crs", "origins").agg(F.bool_or(away("x0") | away("y0")).alias("off"))
    found = off.groupBy(ID).agg(F.count("*").alias("n_crs"), F.bool_or(F.col("crs") == "").alias("nameless"), F.min(F.when(F.col("off"), F.col("crs"))).alias("bad"), F.sum("origins").alias("origins"))
    c = F.col
    all_ = px.join(found, ID, "left")
    status = F.when(c("sizes") > 1, "no").when(c("n_crs").isNull() | c("nameless"), "unknown").when(c("bad").isNotNull(), "no").when((c("n_crs") > 1) | (c("origins") > 1), "partial").otherwise("yes")
    note = (
        F.when(c("sizes") > 1, "pixel sizes differ")
        .when(c("n_crs").isNull(), "no tiepoint")
        .when(c("nameless"), "no projection named")
        .when(c("bad").isNotNull(), say("origins off the lattice in ", c("bad")))
        .otherwise(say(c("n_crs"), " projections, ", c("origins"), " origins"))
    )
    return all_.select(ID, status.alias("status"), note.alias("note"))


def varying_extent(a: Archive) -> DataFrame:
    """(collection_id, status no, note) where an array's first two shapes differ by whole factors: mixed resolutions."""
    varied = a.sums.where("n_records >= 2 AND differs.shape AND lo = hi").select(ID, "name", "rank")
    kinds = a.kinds.groupBy(ID, "name", "shape").agg(F.min("seen").alias("seen")).join(varied, [ID, "name"])
    order = Window.partitionBy(ID, "name").orderBy("seen")
    first_two = kinds.withColumn("_r", F.row_number().over(order)).where("_r <= 2").groupBy(ID, "name", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "shape"))), lambda x: x["shape"]).alias("values"))
    ratio = F.filter(F.zip_with(F.col("values")[0], F.col("values")[1], lambda x, y: F.when((F.least(x, y) > 0) & (x != y), F.greatest(x, y) / F.least(x, y))), lambda r: r.isNotNull())
    shapes = first_two.where(F.size("values") == 2).withColumn("ratio", ratio)
    hit = shapes.where((F.size("ratio") > 0) & F.forall("ratio", lambda r: (F.abs(r - F.rint(r)) < 1e-9) & (r >= 2)))
    first = hit.join(a.counts.where("n_opened >= 2").select(ID), ID).groupBy(ID).agg(F.min(F.struct("rank", "name", "values")).alias("x"))
    return first.select(ID, F.lit("no").alias("status"), say(F.col("x.name"), " has shapes ", s.shape_text(F.col("x.values")[0]), " and ", s.shape_text(F.col("x.values")[1])).alias("note"))


def coordinate_grid(coords: DataFrame) -> DataFrame:
    """(collection_id, status, note) from origins, steps and lengths of spatial coordinates; no row without any.

    Arrays are taken in order of name; an array's spacing is compared before its length, and that before its origin.
    """
    c = coords.where(F.lower(s.leaf(F.col("name"))).isin(s.SPATIAL_LEAVES) & F.col("first_v").isNotNull())
    c = c.withColumn("o", F.round("first_v", 9)).withColumn("st", F.round("step_v", 9))
    lead = c.groupBy(ID, "name").agg(F.min_by("o", F.struct("gi", "granule_id")).alias("o0"), F.min_by("st", F.struct("gi", "granule_id")).alias("st0"))
    cells = F.abs(F.try_divide(F.col("o") - F.col("o0"), F.col("st0")))
    part = c.join(lead, [ID, "name"]).groupBy(ID, "name").agg(
        F.count("*").alias("records"), *((F.min(v) != F.max(v)).alias(name) for v, name in (("st", "steps"), ("n", "lengths"), ("o", "origins"))),
        F.bool_and(F.coalesce(F.abs(cells - F.rint(cells)) < 1e-4, F.lit(False))).alias("whole"),
    )
    kind = F.when(F.col("records") < 2, None).when(F.col("steps"), "spacing").when(F.col("lengths"), "length").when(F.col("origins"), F.when(F.col("whole"), "whole cells").otherwise("part of a cell"))
    found = part.withColumn("kind", kind).groupBy(ID).agg(F.max("records").alias("records"), F.min(F.when(F.col("kind").isNotNull(), F.struct("name", "kind"))).alias("first"), F.bool_and(F.when(F.col("kind").isNotNull(), F.col("kind") == "whole cells")).alias("shifted"))
    r, x = F.col("records"), F.col("first")
    status = F.when(r < 2, "unknown").when(x.isNull(), "yes").when(F.col("shifted"), "partial").otherwise("no")
    note = F.when(r < 2, "coordinates of one granule only").when(x.isNull(), say("same coordinates in ", r, " granules")).otherwise(say(x["name"], " differs by ", x["kind"]))
    return found.select(ID, status.alias("status"), note.alias("note"))


def attribute_grid(a: Archive) -> DataFrame:
    """(collection_id, status, note) from grid attributes, or from the processing level where there are none."""
    swath = F.coalesce(F.col("level").isin(s.SWATH_LEVELS), F.lit(False))
    bare = F.when(swath, "no").otherwise("unknown")
    none = F.when(swath, "swath geometry").otherwise("grid not seen")
    base = a.counts.select(ID)
    base = base.join(a.levels, ID, "left") if a.levels is not None else base.withColumn("level", F.lit(None).cast("string"))
    if a.attributes is None:
        return base.select(ID, bare.alias("status"), none.alias("note"))
    keys = a.attributes.groupBy(ID, "key").agg(F.count_distinct("value").alias("n"))
    found = keys.groupBy(ID).agg(F.count_if(F.col("key").isin(s.LOCATING_ATTRIBUTES)).alias("locating"), F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("key")))), ",").alias("varying"))
    j = base.join(found, ID, "left")
    status = F.when(F.col("keys").isNull() | (F.col("locating") == 0), bare).when(F.col("varying") == "", "yes").otherwise("no")
    note = F.when(F.col("keys").isNull(), none).when(F.col("locating") == 0, say(none, "; ", F.col("keys"), " gives no origin or cell")).when(F.col("varying") == "", say("shared ", F.col("keys"))).otherwise(say("differing ", F.col("varying")))
    return j.select(ID, status.alias("status"), note.alias("note"))


def grid_verdict(a: Archive) -> DataFrame:
    """Tiles decide where there are any, then extents, then coordinates, then attributes."""
    out = a.counts.select(ID, "n_opened")
    names = []
    for name, found in (("tiff", a.tiffs is not None and tiff_lattice(a.tiffs)), ("extent", varying_extent(a)), ("coord", a.coords is not None and coordinate_grid(a.coords)), ("attr", attribute_grid(a))):
        if found is not False:
            out = out.join(found.select(ID, F.struct("status", "note").alias(name)), ID, "left")
            names.append(name)
    best = F.coalesce(*names)
    closed = F.col("n_opened") == 0
    return out.select(ID, F.when(closed, "unmeasured").otherwise(best["status"]).alias("status"), F.when(closed, NOT_OPENED).otherwise(best["note"]).alias("note"))
