"""Boards: user collections as two tables.

boards: board_id, name, created_at, updated_at (epoch ms).
board_items: board_id, pos, item_id (plus any payload columns).
A user's boards never have to fit one task: items are merged per (board, item).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.operators.merge import difference
from vitrine.operators.ranking import bucket_rank, first_per_key, seq_bucket

# The board that always exists, and default names.
FAVORITES = "favorites"
FAVORITES_NAME = "Favorites"
DEFAULT_NAME = "Untitled board"


@dataclass
class Boards:
    boards: DataFrame
    items: DataFrame


def with_favorites(boards: DataFrame) -> DataFrame:
    """Add an empty Favorites board when there is none."""
    blank = boards.sparkSession.createDataFrame(
        [(FAVORITES, FAVORITES_NAME, 0, 0)], "board_id string, name string, created_at bigint, updated_at bigint"
    )
    missing = blank.join(boards.filter(F.col("board_id") == FAVORITES).select("board_id"), "board_id", "left_anti")
    return boards.unionByName(missing)


def order_boards() -> list[Column]:
    """Favorites first, then the latest change."""
    return [(F.col("board_id") == FAVORITES).desc(), F.col("updated_at").desc(), F.col("board_id").asc()]


def merge_boards(a: Boards, b: Boards, width: int = 1 << 20) -> Boards:
    """Union of two board lists: boards by id, items by item id, a's items first."""
    sides = a.boards.withColumn("side", F.lit(0)).unionByName(b.boards.withColumn("side", F.lit(1)))

    def of(side: int, col: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(col)))

    per_board = sides.groupBy("board_id").agg(
        of(0, "name").alias("name_a"), of(1, "name").alias("name_b"),
        of(0, "created_at").alias("created_a"), of(1, "created_at").alias("created_b"),
        of(0, "updated_at").alias("updated_a"), of(1, "updated_at").alias("updated_b"),
    )
    both = F.col("updated_a").isNotNull() & F.col("updated_b").isNotNull()
    newer_b = F.col("updated_a").isNull() | (both & (F.col("updated_b") > F.col("updated_a")))
    # a creation time of 0 on the first side is no information
    created = F.least(F.coalesce(F.nullif("created_a", F.lit(0).cast("bigint")), F.col("created_b")), F.col("created_b"))
    boards = per_board.select(
        "board_id",
        F.when(F.col("board_id") == FAVORITES, FAVORITES_NAME).when(newer_b, F.col("name_b")).otherwise(F.col("name_a")).alias("name"),
        F.when(both, created).otherwise(F.coalesce("created_a", "created_b")).alias("created_at"),
        F.greatest("updated_a", "updated_b").alias("updated_at"),
    )
    pooled = a.items.withColumn("side", F.lit(0)).unionByName(b.items.withColumn("side", F.lit(1)))
    once = first_per_key(pooled, ["board_id", "item_id"], [F.col("side").asc(), F.col("pos").asc()])
    placed = bucket_rank(
        once.withColumnRenamed("pos", "_pos"), ["board_id"], [F.col("side"), seq_bucket(F.col("_pos"), width)],
        [F.col("side").asc(), F.col("_pos").asc()], rank="_rank",
    )
    items = placed.withColumn("pos", F.col("_rank") - 1).drop("side", "_pos", "_rank")
    return Boards(with_favorites(boards), items)


def merge_canvases(a: DataFrame, b: DataFrame) -> DataFrame:
    """Newest whole document per id; on a tie the first list wins. Order by ``updated_at desc`` to show."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    return first_per_key(both, ["id"], [F.col("updated_at").desc(), F.col("side").asc()]).drop("side")


def add_items(board_items: DataFrame, new: DataFrame) -> DataFrame:
    """Append unseen items. ``new``: board_id, pos, item_id; its positions follow the existing ones.

    The flag ``added`` marks new rows: count it for the number added.
    """
    fresh = first_per_key(new, ["board_id", "item_id"], [F.col("pos").asc()])
    fresh = fresh.join(board_items.select("board_id", "item_id"), ["board_id", "item_id"], "left_anti")
    ends = board_items.groupBy("board_id").agg((F.max("pos") + 1).alias("_end"))
    shifted = fresh.join(ends, "board_id", "left").withColumn("pos", F.col("pos") + F.coalesce("_end", F.lit(0))).drop("_end")
    return board_items.withColumn("added", F.lit(False)).unionByName(shifted.withColumn("added", F.lit(True)))


def upsert_items(board_items: DataFrame, new: DataFrame, payload: list[str]) -> DataFrame:
    """Replace items in place or append them; ``mode`` says updated, added or kept."""
    keys = ["board_id", "item_id"]
    right = new.select(*keys, F.col("pos").alias("_new_pos"), *[F.col(c).alias(f"_new_{c}") for c in payload])
    ends = board_items.groupBy("board_id").agg((F.max("pos") + 1).alias("_end"))
    joined = board_items.join(right, keys, "full_outer").join(ends, "board_id", "left")
    hit, old = F.col("_new_pos").isNotNull(), F.col("pos").isNotNull()
    return joined.select(
        *keys,
        F.coalesce("pos", F.col("_new_pos") + F.coalesce("_end", F.lit(0))).alias("pos"),
        *[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in payload],
        F.when(hit & old, "updated").when(hit, "added").otherwise("kept").alias("mode"),
    )


def remove_items(board_items: DataFrame, removed: DataFrame) -> DataFrame:
    return difference(board_items, removed, ["board_id", "item_id"])


def toggle_favorites(events: DataFrame, user: str, item: str, ts: str, tie: str) -> DataFrame:
    """Favorites after a log of toggles, latest first by ``at``: an odd number of toggles leaves the item in."""
    counted = events.groupBy(user, item).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))).alias("_last")
    )
    return counted.filter(F.col("_n") % 2 == 1).select(user, item, F.col("_last.ts").alias("at"), F.col("_last.tie").alias("tie"))


def board_counts(boards: DataFrame, board_items: DataFrame) -> DataFrame:
    """Items per board, empty boards included."""
    counts = board_items.groupBy("board_id").agg(F.count(F.lit(1)).alias("n_items"))
    return boards.join(counts, "board_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def favorite_items(items: DataFrame, board_items: DataFrame) -> DataFrame:
    """Items that are on the Favorites board."""
    favorites = board_items.filter(F.col("board_id") == FAVORITES).select("item_id")
    return items.join(favorites, items["id"] == favorites["item_id"], "left_semi")


def snapshot_time(path: Column) -> Column:
    """Epoch milliseconds in the file name of a snapshot; null when it has none."""
    return F.nullif(F.regexp_extract(path, r"/(\d+)\.json$", 1), F.lit("")).try_cast("bigint")


def latest_snapshot(snapshots: DataFrame, user: str = "user", path: str = "path") -> DataFrame:
    """Newest snapshot per user by the time in its file name."""
    timed = snapshots.withColumn("updated_at", snapshot_time(F.col(path))).filter(F.col("updated_at") > 0)
    best = timed.groupBy(user).agg(F.max_by(path, F.struct("updated_at", path)).alias(path), F.max("updated_at").alias("updated_at"))
    return best


def apply_board_ops(ops: DataFrame) -> Boards:
    """Boards after a log of operations, by aggregates over the log.

    ops: seq (order), ts (epoch ms), op, board_id, name, item_id. Operations: create, rename,
    remove (not of Favorites), add, remove_item, upsert_item. Operations on a board that does
    not exist at their time do nothing.
    """
    favorite = F.col("board_id") == FAVORITES
    log = ops.filter(~((F.col("op") == "remove") & favorite))
    # the life of a board starts with the first create after its last removal
    removed = log.groupBy("board_id").agg(F.coalesce(F.max(F.when(F.col("op") == "remove", F.col("seq"))), F.lit(-1)).alias("_removed"))
    alive = log.join(removed, "board_id").filter(F.col("seq") > F.col("_removed"))
    is_create = F.col("op") == "create"
    births = alive.groupBy("board_id").agg(
        F.min(F.when(is_create, F.struct("seq", "ts", "name"))).alias("_birth")
    )
    births = births.filter(F.col("_birth").isNotNull() | favorite)
    born = births.select(
        "board_id",
        F.when(favorite, F.lit(-1)).otherwise(F.col("_birth.seq")).alias("_born"),
        F.when(favorite, F.lit(0)).otherwise(F.col("_birth.ts")).cast("bigint").alias("created_at"),
        F.when(favorite, F.lit(FAVORITES_NAME)).otherwise(F.coalesce(F.nullif(F.trim("_birth.name"), F.lit("")), F.lit(DEFAULT_NAME))).alias("_first_name"),
    )
    live = alive.join(born, "board_id").filter(F.col("seq") > F.col("_born"))
    item_ops = live.filter(F.col("op").isin("add", "upsert_item", "remove_item"))
    dropped = item_ops.groupBy("board_id", "item_id").agg(
        F.coalesce(F.max(F.when(F.col("op") == "remove_item", F.col("seq"))), F.lit(-1)).alias("_dropped")
    )
    adds = item_ops.filter(F.col("op") != "remove_item").join(dropped, ["board_id", "item_id"]).filter(F.col("seq") > F.col("_dropped"))
    # a repeated add changes nothing, so the first one since the last removal gives the place
    items = adds.groupBy("board_id", "item_id").agg(F.min(F.struct("seq", "ts")).alias("_added"))
    items = items.select("board_id", "item_id", F.col("_added.seq").alias("pos"), F.col("_added.ts").alias("added_at"))
    renamed = F.when((F.col("op") == "rename") & (F.trim("name") != ""), F.struct("seq", F.trim("name").alias("name")))
    touched = F.when(F.col("op").isin("rename", "remove_item", "upsert_item"), F.col("ts"))
    changes = live.groupBy("board_id").agg(F.max(renamed).alias("_name"), F.max(touched).alias("_touched"))
    added = items.groupBy("board_id").agg(F.max("added_at").alias("_last_add"))
    boards = (
        born.join(changes, "board_id", "left")
        .join(added, "board_id", "left")
        .select(
            "board_id",
            F.coalesce("_name.name", "_first_name").alias("name"),
            "created_at",
            F.greatest("created_at", "_touched", "_last_add").alias("updated_at"),
        )
    )
    return Boards(with_favorites(boards), items.drop("added_at"))
