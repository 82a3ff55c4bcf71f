"""Where observations lie: partition ids, routing of boxes, balance, and which hits a lost partition would take along."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrachron.operators.ranks import at_ranks
from terrachron.plans.tables import written


def _grid_cell(v: Column, low: float, span: float, cell_deg: float) -> Column:
    return F.least(F.floor((v + low) / cell_deg), F.lit(math.ceil(span / cell_deg) - 1)).cast("long")


def grid_partition(cell_deg: float, n: int) -> Column:
    """CRC-32 of "row:column" modulo n; the last row and column take their upper edge."""
    cell = F.concat_ws(":", _grid_cell(F.col("lat"), 90, 180, cell_deg).cast("string"), _grid_cell(F.col("lon"), 180, 360, cell_deg).cast("string"))
    return F.crc32(cell.cast("binary")) % n


def grid_route(cell_deg: float, n: int, south: float, north: float, west: float, east: float) -> list[int]:
    """Partitions that can hold points of a box; all, once every partition is met."""
    at = lambda v, low, span: min(math.floor((v + low) / cell_deg), math.ceil(span / cell_deg) - 1)
    met: set[int] = set()
    for row in range(at(south, 90, 180), at(north, 90, 180) + 1):
        for column in range(at(west, 180, 360), at(east, 180, 360) + 1):
            met.add(zlib.crc32(f"{row}:{column}".encode()) % n)
            if len(met) == n:
                return sorted(met)
    return sorted(met)


@dataclass(frozen=True)
class Split:
    """A node of a KD tree: ``column`` < ``value`` goes left. Leaves are partition ids."""

    column: str
    value: float
    left: Split | int
    right: Split | int


def kd_tree(obs: DataFrame, n: int, accuracy: int = 1000, exact: bool = False) -> Split | int:
    """Alternating splits at quantiles, in proportion to the partitions on each side; ``exact``: at values found by rank, else by sketches.

    Each level of the tree is one aggregation over the data (a quantile sketch per node), so
    there are log2(n) scans of two columns and only cuts come to the driver.
    """
    cuts: dict[int, float] = {}

    def built(node: int, parts: int, first: int, depth: int) -> Split | int:
        if parts == 1 or node not in cuts:
            return first if parts == 1 else -node - 1  # a node of the next level, by its number
        left = parts // 2
        return Split(("lat", "lon")[depth % 2], cuts[node], built(2 * node, left, first, depth + 1), built(2 * node + 1, parts - left, first + left, depth + 1))

    def open_nodes(node: int, parts: int) -> list[tuple[int, int]]:
        if parts == 1:
            return []
        return [(node, parts)] if node not in cuts else open_nodes(2 * node, parts // 2) + open_nodes(2 * node + 1, parts - parts // 2)

    depth = 0
    while todo := open_nodes(1, n):
        at = kd_partition(built(1, n, 0, 0))
        column = ("lat", "lon")[depth % 2]
        if exact:
            own = obs.select(at.alias("node"), F.col(column).alias("v"))
            kinds = sorted({(parts // 2) / parts for _, parts in todo})  # two at most: sizes of a level differ by one
            told = {(r.node, r.slot): r.v for r in at_ranks(own, "node", "v", F.array(*[F.floor(F.col("n") * share) for share in kinds])).collect()}
            for node, parts in todo:
                cuts[node] = told.get((-node - 1, kinds.index((parts // 2) / parts)), 0.0)
            depth += 1
            continue
        row = obs.agg(*[F.approx_percentile(F.when(at == -node - 1, F.col(column)), (parts // 2) / parts, accuracy).alias(str(node)) for node, parts in todo]).first()
        for node, _ in todo:
            cuts[node] = row[str(node)] if row[str(node)] is not None else 0.0
        depth += 1
    return built(1, n, 0, 0)


def kd_partition(tree: Split | int) -> Column:
    if not isinstance(tree, Split):
        return F.lit(tree)
    return F.when(F.col(tree.column) < tree.value, kd_partition(tree.left)).otherwise(kd_partition(tree.right))


def kd_route(tree: Split | int, south: float, north: float, west: float, east: float) -> list[int]:
    """Partitions that can hold points of a box: literals for partition pruning."""
    if not isinstance(tree, Split):
        return [tree]
    low, high = (south, north) if tree.column == "lat" else (west, east)
    return (kd_route(tree.left, south, north, west, east) if low < tree.value else []) + (kd_route(tree.right, south, north, west, east) if high >= tree.value else [])


def write_partitions(obs: DataFrame, pid: Column, path: str, files: int = 8) -> None:
    """Parquet by partition id (:func:`kd_partition` or :func:`grid_partition`), in time order; each id is dealt to ``files`` tasks, so a crowded one isn't one task."""
    dealt = obs.withColumn("pid", pid.cast("int")).withColumn("_deal", F.pmod(F.xxhash64("observation_id"), F.lit(files)))
    dealt.repartition("pid", "_deal").drop("_deal").sortWithinPartitions("pid", "ts").write.partitionBy("pid").parquet(path)


def read_box(table: DataFrame, pids: list[int], south: float, north: float, west: float, east: float) -> DataFrame:
    """Rows of a box from a table of :func:`write_partitions`; only the partitions of :func:`kd_route` or :func:`grid_route` are opened."""
    return table.where(F.col("pid").isin(pids) & F.col("lat").between(south, north) & F.col("lon").between(west, east)).drop("pid")


#: Levels of a quadtree at most, and cells that a tree kept beside a table may have.
DEPTH, MOST_CELLS = 16, 1_000_000
_STEP = 4


def _half(v: Column) -> Column:
    """A number of 16 bits with a zero before each bit."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def z_order(lat: Column, lon: Column) -> Column:
    """Number of a place's cell at level DEPTH; leaving out its last 2 k bits gives the cell k levels up."""
    number = lambda v, low, span: F.greatest(F.least(F.floor((v - low) / span * float(1 << DEPTH)).cast("long"), F.lit((1 << DEPTH) - 1)), F.lit(0).cast("long"))
    return F.shiftleft(_half(number(lat, -90.0, 180.0)), 1).bitwiseOR(_half(number(lon, -180.0, 360.0)))


def quadtree(obs: DataFrame, capacity: int) -> DataFrame:
    """level, code, n: the cells of a quadtree in which no cell holds more than ``capacity`` rows, unless it is of level DEPTH; empty cells have no row.

    Rows are counted once, in the smallest cells; those counts make those of the levels above. A cell is split while
    it holds more than ``capacity``, so a leaf is one that doesn't and whose parent does.
    """
    counts = obs.select(F.lit(DEPTH).alias("level"), z_order(F.col("lat"), F.col("lon")).alias("code")).groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))
    tables = [written(counts, "quadtree")]
    for base in range(DEPTH, 0, -_STEP):  # _STEP levels come from one, so the rows that are counted again get fewer fast
        up = F.explode(F.array(*[F.struct(F.lit(base - k).alias("level"), F.shiftright("code", 2 * k).alias("code")) for k in range(1, _STEP + 1)]))
        above = tables[-1].where(F.col("level") == base).select(up.alias("_c"), "n").groupBy("_c.level", "_c.code").agg(F.sum("n").alias("n"))
        tables.append(written(above, "quadtree"))
    cells = reduce(DataFrame.unionByName, tables)
    full = cells.where(F.col("n") > capacity).select((F.col("level") + 1).alias("_level"), F.col("code").alias("_up"))
    split = cells.join(full, (F.col("level") == F.col("_level")) & (F.shiftright("code", 2) == F.col("_up"))).drop("_level", "_up")
    return cells.where((F.col("level") == 0) & (F.col("n") <= capacity)).unionByName(split.where((F.col("n") <= capacity) | (F.col("level") == DEPTH)))


def _first() -> Column:
    """Number of the first smallest cell in a cell."""
    return (F.col("code") * F.pow(F.lit(4.0), F.lit(DEPTH) - F.col("level"))).cast("long")


def write_quadtree(obs: DataFrame, path: str, capacity: int) -> None:
    """Parquet with a folder for each leaf of :func:`quadtree`, in order of time, and the tree with its leaves' bounds in ``_tree`` beside them."""
    leaves = written(quadtree(obs, capacity), "quadtree-leaves")
    if leaves.count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells: choose a larger capacity")
    table = leaves.select(_first().alias("first"), "level", "code", "n").orderBy("first").toPandas()  # at most MOST_CELLS rows
    starts = obs.sparkSession.sparkContext.broadcast(table["first"].to_numpy("int64"))

    @F.pandas_udf("int")
    def leaf(code: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts.value, code.to_numpy(), "right") - 1).astype("int32")

    numbered = obs.withColumn("leaf", leaf(z_order(F.col("lat"), F.col("lon"))))
    numbered.repartition("leaf").sortWithinPartitions("leaf", "ts").write.partitionBy("leaf").parquet(path)
    bounds = obs.sparkSession.read.parquet(path).groupBy("leaf").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.count(F.lit(1)).alias("n"))
    table["leaf"] = range(len(table))
    tree = obs.sparkSession.createDataFrame(table[["leaf", "level", "code"]]).withColumns({"leaf": F.col("leaf").cast("int"), "level": F.col("level").cast("int")})
    tree.join(bounds, "leaf").coalesce(1).write.parquet(f"{path}/_tree")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """leaf, level, code, south, north, west, east, n of a table of :func:`write_quadtree`."""
    return spark.read.parquet(f"{path}/_tree")


def read_quadtree(spark: SparkSession, path: str, south: float, north: float, west: float, east: float) -> DataFrame:
    """Rows of a box; only folders of leaves whose rows' bounds meet it are opened, by the tree that lies with the table."""
    met = read_tree(spark, path).where((F.col("south") <= north) & (F.col("north") >= south) & (F.col("west") <= east) & (F.col("east") >= west))
    leaves = [r.leaf for r in met.select("leaf").collect()]
    return spark.read.parquet(path).where(F.col("leaf").isin(leaves) & F.col("lat").between(south, north) & F.col("lon").between(west, east)).drop("leaf")


def even_partitions(leaves: DataFrame, n: int) -> DataFrame:
    """Leaves with ``pid``: runs of them in z-order of about the same number of rows each, 0 to n - 1."""
    total = leaves.agg(F.sum("n").alias("_all"))  # one row
    before = F.sum("n").over(Window.orderBy("first")) - F.col("n")  # a row a leaf
    return leaves.withColumn("first", _first()).withColumn("_before", before).join(F.broadcast(total)).withColumn("pid", F.floor((F.col("_before") + F.col("n") / 2) * n / F.col("_all")).cast("long")).drop("first", "_before", "_all")


def partition_sizes(obs: DataFrame, pid: Column, n: int) -> DataFrame:
    """pid, n for all partitions, empty ones too."""
    counted = obs.groupBy(pid.cast("long").alias("pid")).agg(F.count("*").alias("n"))
    return obs.sparkSession.range(n).withColumnRenamed("id", "pid").join(counted, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).alias("n"))


def imbalance(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), F.count_if(F.col("n") == 0).alias("empty"), (F.max("n") / F.avg("n")).alias("imbalance"))


def without_node(hits: DataFrame, pid: Column, nodes: int, lost: int, copies: int) -> DataFrame:
    """One row: n, survive: hits left when node ``lost`` of ``nodes`` is gone and each partition lies on ``copies`` nodes in a row."""
    gone = F.lit(copies <= 1) & (pid % nodes == lost)
    return hits.agg(F.count("*").alias("n"), F.count_if(~gone).alias("survive"))
