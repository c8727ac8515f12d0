"""Navigation between records and collections, visibility, and the queries of small applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 10


def member_values(rows: DataFrame, member: Column, values: list[str]) -> DataFrame:
    """Rows with ``member``; a record of another collection answers as absent, its values null."""
    return rows.withColumns({"member": member, **{v: F.when(member, F.col(v)) for v in values}})


def resolve(index: DataFrame, records: DataFrame, anchor: str, key: str) -> DataFrame:
    """Each index entry with the record that it points to; an entry without a record is an error."""
    missing = F.raise_error(F.concat(F.lit("record missing: "), F.coalesce(F.col(anchor).cast("string"), F.lit("null"))))
    joined = index.join(records.withColumn("_found", F.lit(True)), F.col(anchor) == F.col(key), "left")
    return joined.filter(F.coalesce(F.col("_found"), missing.cast("boolean"))).drop("_found")


def follow(holders: DataFrame, children: DataFrame, pivot: str, child_pivot: str) -> DataFrame:
    """The children of the collections that the holders hold."""
    return children.join(holders.select(F.col(pivot).alias("_pivot")).distinct(), F.col(child_pivot) == F.col("_pivot"), "left_semi")


def nest(holders: DataFrame, children: DataFrame, pivot: str, child_pivot: str, to: str) -> DataFrame:
    """Holders with their children as an array of structs; empty if there are none."""
    inner = [c for c in children.columns if c != child_pivot]
    gathered = children.groupBy(child_pivot).agg(F.array_sort(F.collect_list(F.struct(*inner))).alias(to))
    joined = holders.join(gathered, F.col(pivot) == F.col(child_pivot), "left").drop(child_pivot)
    return joined.withColumn(to, F.coalesce(to, F.array().cast(gathered.schema[to].dataType)))


def visible_to(tenant: int) -> Column:
    """Condition on (kind, tenants, tenant): public, listed, or the owner's."""
    kind = F.coalesce("kind", F.lit("owner"))
    return (kind == "public") | ((kind == "tenants") & F.array_contains("tenants", tenant)) | ((kind == "owner") & (F.col("tenant") == tenant))


def profile(customers: DataFrame, nations: DataFrame, who: int) -> DataFrame:
    one = customers.filter(F.col("c_custkey") == who)
    return one.join(nations, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_name", "n_name")


def order_page(orders: DataFrame, who: int, page: int, size: int = PAGE) -> DataFrame:
    rows = orders.filter(F.col("o_custkey") == who).orderBy("o_orderdate", "o_orderkey")
    return (rows.offset(page * size) if page else rows).limit(size)


def order_detail(orders: DataFrame, items: DataFrame, products: DataFrame, who: int, size: int = PAGE) -> DataFrame:
    """The items of a customer's first order, by name."""
    first = order_page(orders, who, 0, 1).select("o_orderkey")
    own = items.join(first, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey")
    named = own.join(products.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    return named.orderBy("p_name", "l_linenumber", "l_partkey").limit(size).select("l_orderkey", "l_linenumber", "p_name")


def checkout(events: DataFrame) -> DataFrame:
    """By user, the orders that purchases append and the items that clicks and views append."""
    count = lambda *kinds: F.count(F.when(F.col("event_type").isin(*kinds), 1))
    return events.groupBy("user_id").agg(count("purchase").alias("n_orders"), count("click", "view").alias("n_items"))


def session_refresh(events: DataFrame) -> DataFrame:
    """By user, how often a token was rotated, and whether one was presented again, which revokes the session.

    A signup presents the token; one that follows another signup directly presents a used token.
    """
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    told = events.withColumn("_again", before == "signup").filter("event_type = 'signup'")
    counts = told.groupBy("user_id").agg(
        F.count(F.when(~F.coalesce("_again", F.lit(False)), 1)).alias("n_rotations"), F.coalesce(F.bool_or("_again"), F.lit(False)).alias("revoked")
    )
    users = events.select("user_id").distinct()
    return users.join(counts, "user_id", "left").select("user_id", F.coalesce("n_rotations", F.lit(0)).cast("long").alias("n_rotations"), F.coalesce("revoked", F.lit(False)).alias("revoked"))


def offline_replay(events: DataFrame) -> DataFrame:
    """Queued saves (clicks) that the node takes in order: those older than its own version (the last purchase) conflict and go."""
    node = events.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("_u")).agg(F.max("ts").alias("_node"))
    queued = events.filter("event_type = 'click'").join(node, F.col("user_id") == F.col("_u"), "left")
    taken = queued.filter(F.col("_node").isNull() | (F.col("ts") > F.col("_node")))
    return taken.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_replayed"), F.max_by("value", "ts").alias("last_value"))


def drain(queue: DataFrame, owner: str, order: list[str], fault: Column, conflict: Column) -> DataFrame:
    """The queue with the ``outcome`` of one drain: first in, first out, up to the owner's first transport fault.

    What comes before that is sent, or dropped where the node refuses it as a conflict; the
    entry that met the fault and all behind it are kept. The place of the fault is an
    aggregate by owner, so that no owner's queue is gathered.
    """
    place = F.struct(*order)
    stops = queue.filter(fault).groupBy(F.col(owner).alias("_owner")).agg(F.min(place).alias("_stop"))
    joined = queue.join(stops, F.col(owner).eqNullSafe(F.col("_owner")), "left")
    outcome = F.when(place >= F.col("_stop"), "kept").when(F.coalesce(conflict, F.lit(False)), "dropped").otherwise("sent")
    return joined.withColumn("outcome", outcome).drop("_owner", "_stop")
