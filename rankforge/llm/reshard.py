"""Reshard by minimum-cost flow: move the fewest bytes, then rewrite what changed."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankforge.session import shared_dir

# A block is what moves as a whole: a hash range of one old shard. At least so
# many for each old shard, and more when a block would exceed the bytes.
BLOCKS_PER_SHARD = 256
BLOCK_BYTES = 64 << 20
# Up to so many blocks the plan is broadcast.
BROADCAST_BLOCKS = 100_000
# Bytes of one output file, give or take a block; with more than so many files, more.
FILE_BYTES = 16 << 20
MOST_FILES = 20_000


@dataclass(frozen=True)
class Transfer:
    """``size`` bytes of old shard ``source`` belong to new shard ``target``."""

    source: int
    target: int
    size: int


def solve_flow(
    supplies: Sequence[int], capacities: Sequence[int], cost: Sequence[Sequence[int]]
) -> list[Transfer]:
    """Minimum-cost flow from old shards to new ones, by shortest augmenting paths.

    The capacities must hold all supplies. The graph has one node a shard.
    """
    if sum(capacities) < sum(supplies):
        raise ValueError("the capacities are smaller than the shards")
    m, n = len(supplies), len(capacities)
    source, sink = m + n, m + n + 1
    graph: list[list[list[int]]] = [[] for _ in range(m + n + 2)]  # to, room, cost, back

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    total = sum(supplies)
    for i, supply in enumerate(supplies):
        edge(source, i, supply, 0)
        for j in range(n):
            edge(i, m + j, total, cost[i][j])
    for j, room in enumerate(capacities):
        edge(m + j, sink, room, 0)

    potential = [0] * len(graph)
    left = total
    while left:
        distance = [math.inf] * len(graph)
        distance[source] = 0
        came: list[tuple[int, int] | None] = [None] * len(graph)
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > distance[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                nd = d + price + potential[a] - potential[b]
                if room and nd < distance[b]:
                    distance[b], came[b] = nd, (a, k)
                    heapq.heappush(queue, (nd, b))
        potential = [p + d if d < math.inf else p for p, d in zip(potential, distance)]
        path, node = [], sink
        while node != source:
            path.append(came[node])
            node = came[node][0]
        pushed = min(left, *(graph[a][k][1] for a, k in path))
        for a, k in path:
            b, _, _, back = graph[a][k]
            graph[a][k][1] -= pushed
            graph[b][back][1] += pushed
        left -= pushed
    return [
        Transfer(i, b - m, graph[b][back][1])
        for i in range(m)
        for b, _, _, back in graph[i]
        if b < source and graph[b][back][1]
    ]


def moving_cost(olds: int, news: int) -> list[list[int]]:
    """One a byte that leaves its shard, nothing for a byte that stays."""
    return [[int(i != j) for j in range(news)] for i in range(olds)]


def assign_blocks(
    blocks: Sequence[tuple[int, int, int, int]], transfers: Sequence[Transfer]
) -> dict[tuple[int, int], int]:
    """New shard of each ``(old shard, block, bytes, rows)``.

    Each old shard's blocks, largest first, go where most of the planned bytes
    are missing still, so a shard is off its plan by about its smallest blocks.
    """
    by_old: dict[int, list[tuple[int, int]]] = {}
    for old, block, size, _ in blocks:
        by_old.setdefault(old, []).append((-size, block))
    # What a new shard gets from earlier old shards beyond its plan is made up for.
    over: dict[int, int] = {}
    target = {}
    for old in sorted(by_old):
        plan = [(t.size - over.pop(t.target, 0), t.target) for t in transfers if t.source == old]
        room = [(-size, new) for size, new in plan]
        heapq.heapify(room)
        for size, block in sorted(by_old[old]):
            missing, new = heapq.heappop(room)
            target[old, block] = new
            heapq.heappush(room, (missing - size, new))
        for missing, new in room:
            over[new] = over.get(new, 0) + missing
    return target


def reshard(
    docs: DataFrame,
    old_shard: str,
    new_shards: int,
    capacities: Sequence[int] | None = None,
    path: str | None = None,
    text: str = "text",
    blocks_per_shard: int = BLOCKS_PER_SHARD,
    file_bytes: int = FILE_BYTES,
) -> str:
    """Write the rows into shards ``0..new_shards-1`` with sizes near the capacities.

    ``old_shard`` names a column with the present shard, 0 and up; a row with
    null or less lies in none and has to move. A row weighs the UTF-8 bytes of
    its text (null: none) plus 1, whatever its length; texts are not looked at
    otherwise. Without capacities the shards get equal bytes. The flow is solved
    on one number per shard, and the shards are cut into blocks by a hash of the
    row. Identical rows, which share a block, are cut out of a block that they
    make too large, and dealt out by number.

    Returns the folder of Parquet files with partition column ``shard``, then
    ``slot`` (gapless from 0 in each shard), ``moved``, and ``row``, the struct
    of the row as it was, null fields and clashing names included. Equal rows
    keep their number of copies. No rows give an empty folder of that schema.
    A task writes one file, of ``file_bytes`` or a block more.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "shards")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    columns = [F.col(f"`{c}`") for c in docs.columns]
    as_text = [c.cast("string") for c in columns]
    keyed = docs.select(
        F.when(F.col(old_shard).cast("int") >= 0, F.col(old_shard).cast("int")).alias("__old"),
        size.alias("__size"),
        F.xxhash64(*as_text).alias("__hash"),
        # With the one above, tells rows apart; nulls leave a hash as it is, so they are named.
        F.xxhash64(F.lit(7), *[c.isNull() for c in columns], *as_text).alias("__same"),
        F.struct(*columns).alias("row"),
    )
    sizes = {r[0]: r[1] for r in keyed.groupBy("__old").agg(F.sum("__size")).collect()}
    olds = max((o for o in sizes if o is not None), default=-1) + 1
    if None in sizes:  # one more source, from which every byte moves
        nowhere = max(olds, new_shards)
        sizes[nowhere], olds = sizes.pop(None), nowhere + 1
        keyed = keyed.withColumn("__old", F.coalesce("__old", F.lit(nowhere)))
    supplies = [sizes.get(i, 0) for i in range(olds)]
    total = sum(supplies)
    if capacities is None:
        capacities = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    transfers = solve_flow(supplies, capacities, moving_cost(olds, new_shards))

    count = max(blocks_per_shard, math.ceil(max(supplies, default=0) / BLOCK_BYTES))
    keyed = keyed.withColumn("__block", F.pmod("__hash", F.lit(count)).cast("int"))
    # One row a block: olds * count, the bytes of all divided by BLOCK_BYTES at most.
    blocks = {
        (r[0], r[1]): (r[2], r[3])
        for r in keyed.groupBy("__old", "__block")
        .agg(F.sum("__size"), F.count(F.lit(1)))
        .collect()
    }
    quota = {old: max(1, supplies[old] // count) for old in range(olds)}
    heavy = _heavy_rows(keyed, [k for k, v in blocks.items() if v[0] > 2 * quota[k[0]]], quota)
    pieces, number = [], count
    for old, block, first, second, each, copies in heavy:
        left_bytes, left_rows = blocks[old, block]
        blocks[old, block] = (left_bytes - each * copies, left_rows - copies)
        share = max(1, quota[old] // each)
        for at in range(0, copies, share):
            n = min(share, copies - at)
            blocks[old, number] = (each * n, n)
            pieces.append((old, number, first, second, n))
            number += 1

    listed = [(old, block, *v) for (old, block), v in sorted(blocks.items()) if v[1]]
    target = assign_blocks(listed, transfers)
    file_bytes = max(file_bytes, total // MOST_FILES)
    filled = [0] * new_shards  # rows of each new shard so far
    current: list[list[int]] = [[] for _ in range(new_shards)]  # its file: number, bytes, first row
    plan, files = {}, 0
    for old, block, held, rows in listed:
        new = target[old, block]
        if not current[new] or current[new][1] >= file_bytes:
            current[new] = [files, 0, filled[new]]
            files += 1
        plan[old, block] = (new, current[new][0], current[new][2], filled[new])
        current[new][1] += held
        filled[new] += rows

    where = "shard int, __file int, __start long, __at long"
    planned = spark.createDataFrame(
        [(*k, *v) for k, v in plan.items() if k[1] < count], f"__old int, __block int, {where}"
    )
    if len(plan) <= BROADCAST_BLOCKS:  # beyond, blocks are joined by a shuffle
        planned = F.broadcast(planned)
    placed = ["shard", "__file", "__start", "__at", "__old", "__hash", "row"]
    if not pieces:
        dealt = keyed.join(planned, ["__old", "__block"]).select(*placed)
        dealt = dealt.repartitionById(max(1, files), F.col("__file"))
    else:
        key = ["__old", "__hash", "__same"]
        cut = F.broadcast(  # fewer than blocks
            spark.createDataFrame(
                sorted({(o, f, s) for o, _, f, s, _ in pieces}), "__old int, __hash long, __same long"
            )
        )
        rest = keyed.join(cut, key, "left_anti").join(planned, ["__old", "__block"])
        # One of the identical rows goes to each file that gets some, and is repeated there.
        one = keyed.join(cut, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
        shares = spark.createDataFrame(
            [(o, f, s, n, *plan[o, block]) for o, block, f, s, n in pieces],
            f"__old int, __hash long, __same long, __n int, {where}",
        )
        dealt = (
            rest.select(*placed, F.lit(1).alias("__n"))
            .unionAll(one.join(F.broadcast(shares), key).select(*placed, "__n"))
            .repartitionById(max(1, files), F.col("__file"))
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), "__n")))
        )
    order = Window.partitionBy("__file").orderBy("__at", "__hash")
    (
        dealt.select(
            "shard",
            (F.col("__start") + F.row_number().over(order) - 1).alias("slot"),
            (F.col("__old") != F.col("shard")).alias("moved"),
            "row",
        )
        .write.partitionBy("shard")
        .parquet(path)
    )
    return path


def _heavy_rows(
    keyed: DataFrame, blocks: Sequence[tuple[int, int]], quota: dict[int, int]
) -> list[tuple[int, int, int, int, int, int]]:
    """``old, block, hash, same, size, copies`` of rows whose copies exceed the quota.

    Only ``blocks`` are searched. The bytes of all divided by the quota bound the list.
    """
    if not blocks:
        return []
    spark = keyed.sparkSession
    large = spark.createDataFrame(
        [(old, block, quota[old]) for old, block in blocks], "__old int, __block int, __quota long"
    )
    found = (
        keyed.drop("row")
        .join(F.broadcast(large), ["__old", "__block"])
        .groupBy("__old", "__block", "__hash", "__same", "__quota", "__size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where((F.col("copies") > 1) & (F.col("copies") * F.col("__size") > F.col("__quota")))
    )
    columns = ("__old", "__block", "__hash", "__same", "__size", "copies")
    return sorted(tuple(r) for r in found.select(*columns).collect())


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """``shard, slot, moved, row`` of what ``reshard`` wrote of ``docs``."""
    from pyspark.sql.types import StructType

    row = StructType(docs.schema.fields)
    schema = (
        StructType()
        .add("slot", "long")
        .add("moved", "boolean")
        .add("row", row)
        .add("shard", "integer")
    )
    return spark.read.schema(schema).parquet(path)


def rewrite_affected(
    spark: SparkSession, path: str, capacities: Sequence[int], docs: DataFrame, text: str = "text"
) -> tuple[str, list[int]]:
    """Bring a written layout to new capacities; touch only shards that change.

    Returns the folder of the shards that give or get rows, and their numbers:
    the others stay in ``path`` as they are. A shard whose bytes fit its new
    capacity and that gets nothing is not rewritten.
    """
    held = read_shards(spark, path, docs)
    size = F.coalesce(F.octet_length(F.col("row")[text]), F.lit(0)).cast("long") + 1
    sizes = {r[0]: r[1] for r in held.groupBy("shard").agg(F.sum(size)).collect()}
    olds = max(len(capacities), max(sizes, default=-1) + 1)
    supplies = [sizes.get(i, 0) for i in range(olds)]
    transfers = solve_flow(supplies, capacities, moving_cost(olds, len(capacities)))
    affected = sorted({s for t in transfers if t.source != t.target for s in (t.source, t.target)})
    out = shared_dir(spark, "shards")
    part = held.where(F.col("shard").isin(affected))
    names, own = docs.columns, "__shard"
    while own in names:
        own += "_"
    rows = part.select(F.col("shard").alias(own), *[F.col("row")[c].alias(c) for c in names])
    wanted = [0] * len(capacities)
    for t in transfers:
        if t.source in affected or t.target in affected:
            wanted[t.target] += t.size
    return reshard(rows, own, len(capacities), wanted, out, text), affected
