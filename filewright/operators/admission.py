"""Plans are admitted in the order of their requests, and one plan alone may hold an item.

A request is accepted if no earlier accepted plan holds one of its items, so acceptance depends on
acceptance. All requests that are the first undecided one for each of their items are accepted
together, whoever shares an item with them is refused, and so on until none is undecided: as many
rounds as the longest chain of requests that wait for each other, each a few aggregates. An item that
one undecided request alone wants keeps nobody waiting and leaves the rounds. No pair of requests is
ever formed, however many want the same item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.session import written


def shared(wants: DataFrame) -> DataFrame:
    """``(seq, key, first)``: the rows of ``wants(seq, key)`` whose key several seqs want, and the first of these."""
    first = wants.groupBy("key").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return written(wants.join(first, "key").select("seq", "key", "first"), "admission-shared")


def refused(contested: DataFrame) -> DataFrame:
    """``(seq)`` that get none when each key goes to one seq, first come first served.

    ``contested`` are the :func:`shared` rows of distinct wants. A seq is refused if one of its keys is
    held by a smaller seq that is not.
    """
    out = []
    while True:
        leads = contested.groupBy("seq").agg(F.bool_and(F.col("seq") == F.col("first")).alias("leads")).where("leads").select("seq")
        leads = written(leads, "admission-leads")
        lost = contested.where("seq > first").select("seq", "first").join(leads.withColumnRenamed("seq", "first"), "first", "left_semi").select("seq").distinct()
        out.append(written(lost, "admission-refused"))
        left = contested.select("seq", "key").join(leads.unionByName(out[-1]), "seq", "left_anti")
        contested = shared(written(left, "admission-wants"))
        if contested.isEmpty():
            return reduce(DataFrame.unionByName, out)


def admitted(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """``(seq, request_id, status, plan, n_items)`` of every row of ``requests(seq, request_id, ids)``.

    ``listing(id, item)`` holds the candidates that are there now. In this order: a request whose
    request_id an earlier accepted one had is ``repeated`` if it names the same ids and a
    ``request conflict`` otherwise, plan being that one; one that names an id that is not listed is
    ``stale``; one without ids is ``empty``; one with an item of an earlier accepted plan is a
    ``conflict``, plan being the first such; the others are ``accepted``, plan being their own seq.
    seq is unique and orders the requests; request_id may be null. ids may repeat and be null, which
    counts as empty. An empty table gives no rows; other columns are ignored.
    """
    ids = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("ids", F.array().cast(requests.schema["ids"].dataType)))))
    asked = requests.select("seq", "request_id", ids.alias("ids"))
    named = asked.select("seq", F.explode("ids").alias("id")).join(listing.select("id", "item"), "id", "left")
    checked = named.groupBy("seq").agg(F.count_if(F.col("item").isNull()).alias("unlisted"), F.collect_set("item").alias("items"))  # no more than the ids of a row
    told = asked.select("seq", "request_id").join(checked, "seq", "left").select("seq", "request_id", F.coalesce("unlisted", F.lit(0)).alias("unlisted"), "items", F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"))
    told = written(told, "admission-requests")
    open_ = told.where("unlisted = 0 and n_items > 0")
    items = open_.select("seq", F.explode("items").alias("item")).select("seq", F.struct(F.lit(0).alias("sort"), F.col("item").cast("string").alias("value")).alias("key"))
    requested = open_.where("request_id is not null").select("seq", F.struct(F.lit(1).alias("sort"), F.col("request_id").cast("string").alias("value")).alias("key"))
    contested = shared(items.unionByName(requested))
    lost = written(refused(contested), "admission-lost")

    # whoever lost an item shares it with its holder, so both are among the contested rows
    wanted = contested.where("key.sort = 0").select("seq", "key").join(lost.withColumn("lost", F.lit(True)), "seq", "left")
    holders = wanted.where("lost is null").select("key", F.col("seq").alias("holder"))
    held = wanted.where("lost").select("seq", "key").join(holders, "key").groupBy("seq").agg(F.min("holder").alias("holder"))
    decided = told.drop("items").join(lost.join(held, "seq", "left").withColumn("lost", F.lit(True)), "seq", "left")
    decided = written(decided.withColumn("accepted", F.expr("unlisted = 0 and n_items > 0 and lost is null")), "admission-decided")

    prior = decided.where("accepted and request_id is not null").select("request_id", F.col("seq").alias("prior"))
    others = written(decided.where("not accepted").join(prior, "request_id", "left").withColumn("prior", F.expr("if(prior < seq, prior, null)")), "admission-others")
    # the ids of a request and of the one before it, for those that came again
    came = others.where("prior is not null").select("seq", F.explode(F.array("seq", "prior")).alias("member"))
    selections = asked.select(F.col("seq").alias("member"), F.unhex(F.sha2(F.to_json("ids"), 256)).alias("selection"))
    same = came.join(selections, "member").groupBy("seq").agg((F.min("selection") == F.max("selection")).alias("same"))
    status = (
        F.when(F.col("same"), "repeated").when(F.col("prior").isNotNull(), "request conflict")
        .when(F.col("unlisted") > 0, "stale").when(F.col("n_items") == 0, "empty").otherwise("conflict")
    )
    plan = F.when(F.col("prior").isNotNull(), F.col("prior")).when((F.col("unlisted") == 0) & (F.col("n_items") > 0), F.col("holder"))
    rest = others.join(same, "seq", "left").select("seq", "request_id", status.alias("status"), plan.alias("plan"), "n_items")
    return decided.where("accepted").select("seq", "request_id", F.lit("accepted").alias("status"), F.col("seq").alias("plan"), "n_items").unionByName(rest)
