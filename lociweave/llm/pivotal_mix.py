"""Mixing sources to target weights by pivotal dependent rounding (operator 6).

A source's target is its share of all words by weight, capped at ``max_repeat``
times the source's own words, with the excess shared out again by weight.  A
document of the source is wanted target / size-of-source times: the whole part
is taken outright, and the fractions are rounded together.  Two fractions meet,
words move at random from one to the other until one of them is 0 or 1, and the
other goes on; a bucket of about ``fan_in`` documents leaves one fraction, the
leftovers of ``fan_in`` buckets meet on the next level, and so on up a reduction
tree until a source has one fraction, which is drawn.

A transfer keeps the words of the pair, so a source's words stay at its target up
to its last fraction.  In a bucket the longest document comes first and takes part
until it is settled, so short documents are the ones left over.  What drawing the last
fraction adds or lacks is made up by turning over documents of the source that were
settled the other way, taken at random, as long as each fits into what is still to be
made up; since the draw is as likely to add as to lack, every document keeps its chance.
Where a source's other documents have too few words for that, the last fraction goes to
the nearer side.

Rows that repeat id, source and text are one row with a count until they are dealt to
buckets, each with its number, so neither null nor repeated ids pile up.  Buckets are
cut by source and hash, so a source with a third of all rows has many buckets like any
other, and no task sees more than a bucket at once.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.llm.common import cut_lineage, doc_frame, each_copy
from lociweave.operators.ordered import row_numbers

#: A word is a run of characters other than blank, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

#: Two fractions exchange words: either a gains what x loses, or x gains what a loses, until
#: one of them is 0 or 1.  The chances of the two ways keep every expected fraction.
_FOLD = """
aggregate(
  slice(items, 2, size(items)),
  named_struct('doc_id', items[0].doc_id, 'text_key', items[0].text_key, 'copy', items[0].copy, 'size', items[0].size, 'p', items[0].p,
               'done', cast(array() as array<struct<doc_id:bigint,text_key:bigint,copy:bigint,size:bigint,take:int>>)),
  (a, x) -> transform(
    array(named_struct('rise', least(1D - a.p, x.p * x.size / a.size), 'fall', least(a.p, (1D - x.p) * x.size / a.size))),
    m -> transform(array(if(x.u * (m.rise + m.fall) < m.fall,
      named_struct('a_p', a.p + m.rise, 'x_p', x.p - m.rise * a.size / x.size, 'a_done', 1D - a.p <= x.p * x.size / a.size, 'a_take', 1),
      named_struct('a_p', a.p - m.fall, 'x_p', x.p + m.fall * a.size / x.size, 'a_done', a.p <= (1D - x.p) * x.size / a.size, 'a_take', 0))),
      t -> named_struct(
        'doc_id', if(t.a_done, x.doc_id, a.doc_id),
        'text_key', if(t.a_done, x.text_key, a.text_key),
        'copy', if(t.a_done, x.copy, a.copy),
        'size', if(t.a_done, x.size, a.size),
        'p', greatest(0D, least(1D, if(t.a_done, t.x_p, t.a_p))),
        'done', concat(a.done, array(if(t.a_done,
          named_struct('doc_id', a.doc_id, 'text_key', a.text_key, 'copy', a.copy, 'size', a.size, 'take', t.a_take),
          named_struct('doc_id', x.doc_id, 'text_key', x.text_key, 'copy', x.copy, 'size', x.size, 'take', 1 - t.a_take))))))[0])[0])
"""


def _uniform(*cols):
    """A number in [0, 1) decided by the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, size, n): equal rows with their number; size is the number
    of words, 0 for null texts, and text_key a hash of the text."""
    d = doc_frame(docs, "doc_id", "text", "source")
    rows = d.select("doc_id", "source", F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.groupBy("doc_id", "source", "text_key").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: float = 3.0) -> DataFrame:
    """(source, source_size, units, target): the capped shares of all words of (source,
    size, n) rows; units are documents with words.

    Sources in code point order, null last, weigh ``weights`` in turn.  The fixed point
    of capping and resharing is target = min(cap, level * weight): with sources ordered
    by cap / weight, the level is that of the first source that it does not cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("n"))), F.lit(0)).alias("units"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    listed = totals.select("source", "source_size", "units", weight.alias("weight"), (F.col("source_size") * max_repeat).alias("cap"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto, onward, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(onward)
    placed = listed.withColumn("level", level).withColumn("free", F.col("cap") >= F.col("level") * F.col("weight"))
    common = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(every)
    return placed.select("source", "source_size", "units", F.least("cap", F.coalesce(common, F.lit(0.0)) * F.col("weight")).alias("target"))


#: Words of the documents that may be turned over, as a multiple of what is to be made up.
SPARE = 8

#: Of candidates in random order, those that fit into what is still to be made up.
_FILL = """
aggregate(items, named_struct('left', need, 'turned', cast(array() as array<struct<doc_id:bigint,text_key:bigint,copy:bigint>>)),
  (a, x) -> if(x.size <= a.left,
    named_struct('left', a.left - x.size, 'turned', array_append(a.turned, named_struct('doc_id', x.doc_id, 'text_key', x.text_key, 'copy', x.copy))), a), a -> a.turned)
"""


def last_draw(decided: DataFrame, left: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, text_key, copy, size, take, off): the last fraction of each source
    drawn, and by how many words that misses.

    The draw is random where both sides of the other documents have twice the words to
    make up either outcome, else it goes to the nearer side.
    """
    sides = decided.groupBy(F.col("source").alias("src")).agg(*[F.sum(F.when(F.col("take") == k, F.col("size"))).alias(f"words{k}") for k in (0, 1)])
    adds, lacks = (1 - F.col("p")) * F.col("size"), F.col("p") * F.col("size")
    spare = (F.coalesce("words1", F.lit(0)) >= 2 * adds) & (F.coalesce("words0", F.lit(0)) >= 2 * lacks)
    take = F.when(spare, _uniform("doc_id", "text_key", "copy", F.lit(seed), F.lit(-1)) < F.col("p")).otherwise(F.col("p") >= 0.5).cast("int")
    drawn = left.join(sides, F.col("source").eqNullSafe(F.col("src")), "left").withColumn("take", take)
    return drawn.select("source", "doc_id", "text_key", "copy", "size", "take", ((F.col("take") - F.col("p")) * F.col("size")).alias("off"), *[F.coalesce(f"words{k}", F.lit(0)).alias(f"words{k}") for k in (0, 1)])


def turned_over(decided: DataFrame, drawn: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, text_key, copy) of the settled documents that change sides.

    Candidates are a random part of the side that has too much, of about SPARE times the
    words to make up, so their number is bounded by the longest document of the source
    whatever the number of documents; one fold over them takes what fits.
    """
    need = drawn.filter(F.abs("off") >= 1).select(F.col("source").alias("src"), F.abs("off").alias("need"), (F.col("off") > 0).cast("int").alias("side"), F.when(F.col("off") > 0, F.col("words1")).otherwise(F.col("words0")).alias("words"))
    on = F.col("source").eqNullSafe(F.col("src")) & (F.col("take") == F.col("side")) & (F.col("size") <= F.col("need"))
    order = _uniform("doc_id", "text_key", "copy", F.lit(seed), F.lit(-2))
    some = decided.join(need, on).withColumn("order", order).filter(F.col("order") * F.col("words") < SPARE * F.col("need"))
    listed = some.groupBy("source", "need").agg(F.array_sort(F.collect_list(F.struct("order", "doc_id", "text_key", "copy", "size"))).alias("items"))
    return listed.select("source", F.inline(F.expr(_FILL)))


def copies(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: float = 3.0, fan_in: int = 256, seed: int = 17) -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, copies): one row per document;
    rows that repeat are rounded one by one."""
    rows = cut_lineage(sized(docs))
    targets = cut_lineage(source_targets(rows, weights, max_repeat))
    share = targets.filter("units > 0").select(F.col("source").alias("src"), (F.col("target") / F.col("source_size")).alias("share"), F.ceil(F.col("units") / F.lit(fan_in)).alias("buckets"))
    widest = share.agg(F.max("buckets")).first()[0] or 0
    each = each_copy(rows, "n", "copy").select("doc_id", "source", "text_key", "size", (F.col("copy") + 1).alias("copy"))
    units = (
        each.filter("size > 0")
        .join(share, F.col("source").eqNullSafe(F.col("src")))
        .select("source", F.pmod(F.xxhash64("doc_id", "text_key", "copy", F.lit(seed)), F.col("buckets")).alias("node"), "size", "doc_id", "text_key", "copy", (F.col("share") - F.floor("share")).alias("p"), _uniform("doc_id", "text_key", "copy", F.lit(seed), F.lit(0)).alias("u"))
    )
    decided, level = None, 0
    while True:
        level += 1
        items = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("at"), "u", "doc_id", "text_key", "copy", "size", "p"))).alias("items")
        folded = cut_lineage(units.groupBy("source", "node").agg(items).select("source", "node", F.expr(_FOLD).alias("f")))
        done = folded.select("source", F.inline("f.done"))
        decided = done if decided is None else decided.unionByName(done)
        left = folded.select("source", "node", "f.doc_id", "f.text_key", "f.copy", "f.size", "f.p")
        if widest <= 1:
            break
        widest = -(-widest // fan_in)
        units = left.select("source", F.floor(F.col("node") / F.lit(fan_in)).alias("node"), "size", "doc_id", "text_key", "copy", "p", _uniform("doc_id", "text_key", "copy", F.lit(seed), F.lit(level)).alias("u"))
    drawn = cut_lineage(last_draw(decided, left, seed))
    key = ("source", "doc_id", "text_key", "copy")
    turned = cut_lineage(turned_over(decided, drawn, seed)).select(*[F.col(c).alias(f"_{c}") for c in key])
    on = F.col("copy") == F.col("_copy")
    for c in key[:-1]:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    settled = decided.join(turned, on, "left").select(*key, "size", F.when(F.col("_copy").isNull(), F.col("take")).otherwise(1 - F.col("take")).alias("take"))
    wordless = each.filter("size = 0").select(*key, "size", F.lit(0).alias("take"))
    taken = settled.unionByName(drawn.select(*key, "size", "take")).unionByName(wordless)
    t = targets.select(F.col("source").alias("src"), "source_size", "target")
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.nullif("source_size", F.lit(0))) + F.col("take")).otherwise(0)
    return taken.join(t, F.col("source").eqNullSafe(F.col("src"))).select("doc_id", "source", "text_key", "size", "source_size", F.col("target").cast("double").alias("target"), whole.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every document.

    taken is copies * size.  Documents without words are in no mix: 0 copies.  Rows that
    repeat a doc_id are rounded one by one.  Null sources are a source; null ids are
    allowed; an empty table gives an empty result.  The draws are hashes, so reruns agree.
    """
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, each repeated as often as the mix takes it, with their columns.

    Rows that repeat id, source and text share their copies evenly; they alone are
    numbered, by ranges, so that no task holds all rows of one id.  Documents without
    words are left out; an empty table gives an empty result.
    """
    per = copies(docs, **options).groupBy(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_src"), F.col("text_key").alias("__mix_key")).agg(F.sum("copies").alias("__mix_copies"), F.count(F.lit(1)).alias("__mix_rows"))
    per = cut_lineage(per.filter("__mix_copies > 0"))
    own = docs.withColumn("__mix_doc", F.col("doc_id").cast("long")).withColumn("__mix_source", F.col("source").cast("string")).withColumn("__mix_text", F.xxhash64(F.col("text").cast("string")))
    on = F.col("__mix_doc").eqNullSafe(F.col("__mix_id")) & F.col("__mix_source").eqNullSafe(F.col("__mix_src")) & (F.col("__mix_text") == F.col("__mix_key"))
    once = own.join(per.filter("__mix_rows = 1"), on).withColumn("__mix_times", F.col("__mix_copies"))
    repeated = per.filter("__mix_rows > 1")
    if not repeated.isEmpty():
        many = own.join(repeated, on).withColumn("__mix_row", F.monotonically_increasing_id())
        placed = row_numbers(many, ["__mix_text", "__mix_row"], "__mix_place", ["__mix_id", "__mix_src", "__mix_key"])
        times = F.floor(F.col("__mix_copies") / F.col("__mix_rows")) + F.when(F.col("__mix_place") <= F.col("__mix_copies") % F.col("__mix_rows"), 1).otherwise(0)
        once = once.unionByName(placed.withColumn("__mix_times", times).drop("__mix_row", "__mix_place"))
    dealt = once.filter("__mix_times > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times").cast("int"))))
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns])
