"""Sharding through fixed virtual slots (operator 10).

Records are hashed into ``n_slots`` virtual slots, a number that never changes.
Bytes are summed per slot, and a versioned table maps slots to shards: heavy
slots first, each to the shard with the fewest bytes.  Growing edits the table:
every shard gives slots up to its surplus to the new shards and no other slot
moves, so a rebalance rewrites the moved slots' records only.

The law that holds is ``bytes``: shard sizes are near equal.  A slot's records
are numbered within the slot and the slots' counts are summed up within a shard,
so positions are gapless without a sort of a whole shard.  DataFrame functions
only; the only tables gathered in one task have ``n_slots`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociweave.llm.common import cut_lineage, doc_frame, each_copy

N_SLOTS = 4096


def slot_of(n_slots: int = N_SLOTS) -> Column:
    """A record's virtual slot, from its id, its text checksum (so that null ids spread) and
    its number among equal rows (so that repeated rows do)."""
    return F.pmod(F.xxhash64("doc_id", "text_crc32", "size") + F.col("copy"), F.lit(n_slots)).cast("int")


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot); size is the text's UTF-8 bytes plus 1, 1 for null.

    Rows that agree in all three are counted first and then numbered from their count, so
    no task sorts or holds the rows of one id.
    """
    d = doc_frame(docs).select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    sized = d.select("doc_id", (F.octet_length("b") + 1).cast("long").alias("size"), F.crc32("b").alias("text_crc32"))
    counted = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    return each_copy(counted, "n", "copy").withColumn("virtual_slot", slot_of(n_slots)).drop("n", "copy")


def slot_loads(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(virtual_slot, bytes, n_rows) of all slots, empty ones too."""
    loads = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    slots = rows.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return slots.join(loads, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def first_map(loads: DataFrame, n_shards: int = 8) -> DataFrame:
    """(version, virtual_slot, shard, bytes, n_rows): version 1 of the slot map."""
    deal = """
    aggregate(heavy,
      named_struct('load', array_repeat(0L, {n}), 'dealt', cast(array() as array<struct<virtual_slot:int,shard:int,bytes:bigint,n_rows:bigint>>)),
      (a, x) -> named_struct(
        'load', transform(a.load, (v, i) -> if(i + 1 = array_position(a.load, array_min(a.load)), v + x.bytes, v)),
        'dealt', concat(a.dealt, array(named_struct('virtual_slot', x.virtual_slot, 'shard', cast(array_position(a.load, array_min(a.load)) - 1 as int), 'bytes', x.bytes, 'n_rows', x.n_rows)))),
      a -> a.dealt)
    """.format(n=int(n_shards))
    heavy = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes", "n_rows"))).alias("heavy")
    return loads.agg(heavy).select(F.inline(F.expr(deal))).withColumn("version", F.lit(1))


def grown_map(slot_map: DataFrame, n_new: int = 1) -> DataFrame:
    """The next version of a slot map, with ``n_new`` more shards.

    Each old shard hands over its lightest slots while their bytes fit in the surplus
    over the new mean; they are dealt to the new shards in turn.  Other slots stay.
    """
    of_shard = Window.partitionBy("shard")
    light = of_shard.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    n_old = F.max("shard").over(Window.partitionBy("version")) + 1
    mean = F.sum("bytes").over(Window.partitionBy("version")) / (n_old + n_new)
    marked = slot_map.select("*", n_old.alias("n_old"), (F.sum("bytes").over(light) <= F.sum("bytes").over(of_shard) - mean).alias("moves"))
    turn = F.row_number().over(Window.partitionBy("moves").orderBy("bytes", "virtual_slot"))
    new = F.when(F.col("moves"), F.col("n_old") + turn % n_new).otherwise(F.col("shard")).cast("int")
    return marked.select("virtual_slot", new.alias("shard"), "bytes", "n_rows", (F.col("version") + 1).alias("version"))


def latest_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version (version, virtual_slot, shard) of a stored slot map, none if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    stored = spark.read.schema("virtual_slot int, shard int, bytes long, n_rows long, version int").parquet(path)
    return stored.filter(F.col("version") == stored.agg(F.max("version")).first()[0]).select("version", "virtual_slot", "shard")


def kept_map(loads: DataFrame, n_shards: int, path: str) -> DataFrame:
    """The slot map for these loads: the stored one at ``path``, edited if there are more shards
    than it knows, or a first one; a new version is appended to the stored table.

    A version is a folder, written once; readers see whole versions.  Fewer shards than
    the stored map has are refused, since slots are only ever given to new shards.
    """
    spark = loads.sparkSession
    stored = latest_map(spark, path)
    if stored is None:
        new = first_map(loads, n_shards)
    else:
        known = stored.agg(F.max("shard")).first()[0] + 1
        if known > n_shards:
            raise ValueError(f"the stored slot map has {known} shards")
        current = stored.join(loads, "virtual_slot")
        if known == n_shards:
            return current
        new = grown_map(current, n_shards - known)
    new = cut_lineage(new.select("virtual_slot", "shard", "bytes", "n_rows", "version"))
    new.write.mode("append").partitionBy("version").parquet(path)
    return new


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard and their gapless position in it under a slot map.

    The map has one row per virtual slot, a bounded table, and is broadcast.
    """
    before = F.sum("n_rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(F.broadcast(starts), "virtual_slot").withColumn("slot", (F.col("before") + within - 1).cast("long")).drop("before")


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) of every document.

    Null texts have size 1 and the checksum of no bytes; null ids spread by checksum, and
    rows that repeat id and text by their number, so shards stay near equal.  Equal texts
    have equal size and checksum; no law asks for them in one shard.  Fewer rows than
    shards leave shards empty; an empty table gives an empty result.

    With ``map_path`` the slot map is a stored table of versions (``kept_map``): later runs place
    by it, new records included, and a run with more shards edits it, so that records move
    only into the new shards.  Without it the map is made for this table.
    """
    rows = cut_lineage(records(docs, n_slots))
    loads = slot_loads(rows, n_slots)
    slot_map = kept_map(loads, n_shards, map_path) if map_path else cut_lineage(first_map(loads, n_shards))
    return place(rows, slot_map).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
