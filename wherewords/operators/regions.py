"""Regions: country dimension, bounding boxes, place names in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherewords.functions import scalars
from wherewords.session import stage


def region_dim(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Regions that have a bounding box, with an integer woeid."""
    return regions.join(boxes, "country").withColumn("woeid", scalars.int_key(F.col("woeid")))


def _inside(box: Column | None = None) -> Column:
    def edge(name: str) -> Column:
        return F.col(name) if box is None else box[name]

    return F.col("lon").between(edge("lon_min"), edge("lon_max")) & F.col("lat").between(
        edge("lat_min"), edge("lat_max")
    )


def _cell(value: Column, cell_deg: float) -> Column:
    return F.floor(value / cell_deg).cast("int")


def box_cells(boxes: DataFrame, cell_deg: float = 20.0) -> DataFrame:
    """Each box once per grid cell that it touches."""

    def span(low: str, high: str) -> Column:
        return F.sequence(_cell(F.col(low), cell_deg), _cell(F.col(high), cell_deg))

    by_lon = boxes.withColumn("_cell_lon", F.explode(span("lon_min", "lon_max")))
    return by_lon.withColumn("_cell_lat", F.explode(span("lat_min", "lat_max")))


def crowded_leaves(sample: DataFrame, most: int, cell_deg: float = 20.0, levels: int = 6) -> DataFrame:
    """Leaves of a quadtree over the grid cells with more than ``most`` points of ``sample``
    (lon, lat), for :func:`tag_region`.

    (_fine_lon, _fine_lat, _level, _leaf_lon, _leaf_lat, _salts): each finest cell with points,
    and the leaf it lies in, the largest one with at most ``most`` points. A finest cell with more,
    as of points at one spot, is dealt to several salts.
    """
    size = cell_deg / 2**levels
    fine = sample.groupBy(_cell(F.col("lon"), size).alias("_fine_lon"), _cell(F.col("lat"), size).alias("_fine_lat")).agg(F.count("*").alias("_n"))
    level, deepest = F.lit(levels), F.col("_n")
    for n in reversed(range(levels)):
        # A row per finest cell, however many points it holds.
        window = Window.partitionBy(F.shiftright("_fine_lon", levels - n), F.shiftright("_fine_lat", levels - n))
        fine = fine.withColumn(f"_n{n}", F.sum("_n").over(window))
        level = F.when(F.col(f"_n{n}") <= most, n).otherwise(level)
    leaves = fine.withColumn("_level", level).withColumn(
        "_salts", F.when(deepest > most, F.ceil(deepest / F.lit(most))).otherwise(1).cast("int")
    )
    shift = F.lit(levels) - F.col("_level")
    return leaves.filter("_level > 0 OR _salts > 1").select(
        "_fine_lon", "_fine_lat", "_level", F.expr(f"shiftright(_fine_lon, {levels} - _level)").alias("_leaf_lon"),
        F.expr(f"shiftright(_fine_lat, {levels} - _level)").alias("_leaf_lat"), "_salts",
    )


def _in_leaves(points: DataFrame, cells: DataFrame, leaves: DataFrame, cell_deg: float, levels: int) -> tuple[DataFrame, DataFrame]:
    """Points and box cells under the keys of the quadtree; what no leaf covers keeps its cell."""
    leaves = stage(leaves, "leaves")
    size = cell_deg / 2**levels
    at = {"_fine_lon": _cell(F.col("lon"), size), "_fine_lat": _cell(F.col("lat"), size)}
    salt = F.pmod(F.xxhash64(*points.columns), F.coalesce("_salts", F.lit(1))).cast("int")
    located = points.withColumns(at).join(leaves, ["_fine_lon", "_fine_lat"], "left").withColumns({
        "_salt": salt, "_level": F.coalesce("_level", F.lit(0)),
        "_cell_lon": F.coalesce("_leaf_lon", _cell(F.col("lon"), cell_deg)), "_cell_lat": F.coalesce("_leaf_lat", _cell(F.col("lat"), cell_deg)),
    })
    each = leaves.groupBy("_level", "_leaf_lon", "_leaf_lat").agg(F.max("_salts").alias("_salts")).withColumns({
        "_cell_lon": F.expr("shiftright(_leaf_lon, _level)"), "_cell_lat": F.expr("shiftright(_leaf_lat, _level)"),
        "_size": F.lit(cell_deg) / F.pow(F.lit(2.0), F.col("_level")),
    })
    touching = (
        (F.col("lon_max") >= F.col("_leaf_lon") * F.col("_size")) & (F.col("lon_min") <= (F.col("_leaf_lon") + 1) * F.col("_size"))
        & (F.col("lat_max") >= F.col("_leaf_lat") * F.col("_size")) & (F.col("lat_min") <= (F.col("_leaf_lat") + 1) * F.col("_size"))
    )
    in_leaf = cells.join(each, ["_cell_lon", "_cell_lat"]).filter(touching).withColumns({"_cell_lon": F.col("_leaf_lon"), "_cell_lat": F.col("_leaf_lat")})
    in_leaf = in_leaf.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).select(*cells.columns, "_level", "_salt")
    whole = cells.withColumns({"_level": F.lit(0), "_salt": F.lit(0)})
    # A cell whose only leaf is itself, dealt to salts, is listed once.
    return located, whole.unionAll(in_leaf).distinct()


def tag_region(
    points: DataFrame,
    boxes: DataFrame,
    multi: str = "all",
    cell_deg: float = 20.0,
    out: str = "country",
    leaves: DataFrame | None = None,
    levels: int = 6,
) -> DataFrame:
    """Points inside a bounding box (edges included) with the box's country.

    A range join as an equi join: boxes are listed per grid cell, a point looks
    only at the boxes of its own cell and checks the edges. ``multi="all"``
    gives a row per matching box; ``"smallest"`` the smallest matching box, ties
    by name, from one list per cell, so that points are never regrouped. Works
    on streams, too.

    ``leaves`` of :func:`crowded_leaves`, with the same ``cell_deg`` and ``levels``, cut crowded
    cells into several keys; without it, a stream has all points of a city in one key.
    """
    cells = box_cells(boxes, cell_deg)
    at = ["_cell_lon", "_cell_lat"]
    if leaves is None:
        located = points.withColumns(
            {
                "_cell_lon": _cell(F.col("lon"), cell_deg),
                "_cell_lat": _cell(F.col("lat"), cell_deg),
            }
        )
    else:
        at = [*at, "_level", "_salt"]
        located, cells = _in_leaves(points, cells, leaves, cell_deg, levels)
    keep = [F.col(c) for c in points.columns]
    if multi == "all":
        edges = cells.select(
            *at, F.col("country").alias("_name"),
            "lon_min", "lat_min", "lon_max", "lat_max",
        )
        found = located.join(edges, at).filter(_inside())
        return found.select(*keep, F.col("_name").alias(out))
    if multi != "smallest":
        raise ValueError("multi is 'all' or 'smallest'")
    area = (F.col("lon_max") - F.col("lon_min")) * (F.col("lat_max") - F.col("lat_min"))
    lists = cells.groupBy(*at).agg(
        F.array_sort(
            F.collect_list(
                F.struct(area.alias("area"), "country", "lon_min", "lat_min", "lon_max", "lat_max")
            )
        ).alias("_boxes")
    )
    first = F.get(F.filter("_boxes", lambda b: _inside(b)), F.lit(0))
    found = located.join(lists, at).withColumn(out, first["country"])
    return found.filter(F.col(out).isNotNull()).select(*keep, out)


# Share of the texts in which the words of place names are counted.
ANCHOR_SAMPLE = 0.05


def extract_places(
    df: DataFrame, gazetteer: DataFrame, key: str, words: Column, max_words: int | None = None
) -> DataFrame:
    """(key, place, n): the gazetteer's lower-case place names among the words of a text, names
    of up to ``max_words`` words if given. Only texts with a place have rows.

    A name is looked for where its anchor is, the word of it that the texts hold least often;
    the words around it are compared there. So a row per word at most goes into the join.
    How often is counted in a twentieth of the texts: it decides on the work, not on the result.
    """
    names = gazetteer.select("place").filter(F.col("place") != "").distinct().withColumn("_names", F.split("place", " "))
    if max_words is not None:
        names = names.filter(F.size("_names") <= max_words)
    names = stage(names, "place-names")
    parts = names.select("place", "_names", F.posexplode("_names").alias("_at", "_word"))

    def words_of(rows: DataFrame) -> DataFrame:
        return rows.select(key, words.alias("_words")).select(key, "_words", F.posexplode_outer("_words").alias("_pos", "_word"))

    known = stage(parts.select("_word").distinct(), "place-words")
    often = words_of(df.sample(ANCHOR_SAMPLE, seed=1)).select("_word").join(known, "_word").groupBy("_word").agg(F.count("*").alias("_often"))
    anchors = stage(
        parts.join(often, "_word", "left")
        .groupBy("place", "_names").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("often"), -F.length("_word"), "_at", "_word")).alias("_first"))
        .select("place", "_names", F.col("_first._at").alias("_at"), F.col("_first._word").alias("_word")),
        "place-anchors",
    )
    begin = F.col("_pos") - F.col("_at")
    fits = (begin >= 0) & (F.slice("_words", F.greatest(begin, F.lit(0)) + 1, F.size("_names")) == F.col("_names"))
    # Outer, as from a plain explode a filter is inferred that splits the texts a second time.
    return words_of(df).join(anchors, "_word").filter(fits).groupBy(key, "place").agg(F.count("*").alias("n"))


def place_list(mentions: DataFrame, key: str) -> DataFrame:
    """The places of each text as a sorted array (no longer than its text)."""
    return mentions.groupBy(key).agg(F.array_sort(F.collect_list("place")).alias("places"))
