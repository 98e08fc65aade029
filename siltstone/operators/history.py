"""Commands against versioned rows, what they leave behind, and states as of a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import transitions


def versioned(commands: DataFrame, first: int = 1) -> DataFrame:
    """commands with outcome (EDITED, or CONFLICT if they expect another version) and version, the key's after the command.

    commands: key, seq, expected. A key's commands go through a task in order of seq, sorted by Spark; the task holds the
    version alone, so a key may have any number of them. Commands without key or seq are left out.
    """
    schema = commands.select("*", F.lit("").alias("outcome"), F.lit(0).cast("long").alias("version")).schema
    names = schema.names
    rows = commands.filter("key IS NOT NULL AND seq IS NOT NULL")
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, version = None, first
        for b in batches:
            outcomes, versions = [], []
            for key, expected in zip(b.column(names.index("key")).to_pylist(), b.column(names.index("expected")).to_pylist(), strict=True):
                if key != now:
                    now, version = key, first
                hit = expected == version
                version += hit
                outcomes.append("EDITED" if hit else "CONFLICT")
                versions.append(version)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(outcomes), pa.array(versions, pa.int64())], names=names)

    return rows.mapInArrow(run, schema)


def revisions(states: DataFrame, facts: list[str]) -> DataFrame:
    """key, version, valid_from, valid_to (null: still), before and after: a row for each state that a key has had.

    states: key, version, at and facts, each version of a key once. A later version holds from its time on, or from its
    predecessor's if that is later, so intervals don't overlap.
    """
    by = Window.partitionBy("key").orderBy("version")
    start = F.max("at").over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = states.select("key", "version", start.alias("valid_from"), F.struct(*facts).alias("after"))
    return rows.select("key", "version", "valid_from", F.lead("valid_from").over(by).alias("valid_to"), F.lag("after").over(by).alias("before"), "after")


def as_of(history: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, at and more) with version and the state then (null before the first): the last that holds from ``at`` or before.

    One window over both tables in the order of time; no row meets more than one other.
    """
    more = [c for c in asked.columns if c not in ("key", "at")]
    states = history.select("key", F.col("valid_from").alias("at"), F.lit(0).alias("_kind"), "version", F.struct("version", "after").alias("_state"), F.lit(None).cast(asked.select(F.struct(*asked.columns).alias("x")).schema["x"].dataType).alias("_asked"))
    wanted = asked.select("key", "at", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("version"), F.lit(None).cast(states.schema["_state"].dataType).alias("_state"), F.struct(*asked.columns).alias("_asked"))
    upto = Window.partitionBy("key").orderBy("at", "_kind", "version").rowsBetween(Window.unboundedPreceding, 0)
    found = states.unionByName(wanted).withColumn("_now", F.last("_state", ignorenulls=True).over(upto)).filter("_kind = 1")
    return found.select("_asked.key", "_asked.at", *[f"_asked.{c}" for c in more], "_now.version", F.col("_now.after").alias("state"))


def decided(commands: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What decisions leave: commands with outcome, new reviews, their first revisions, and items in their new state.

    commands: member, command_key, digest, seq, item_id, decision, at. items: item_id, open_member, version. A review
    begins at version 1 and is current; its item is closed and a version further. Commands that repeat an applied one have
    its answer and change nothing.
    """
    answered = transitions.decide(commands, items)
    reviews = answered.filter("outcome = 'APPLIED'").select(F.concat_ws("/", F.col("member").cast("string"), "command_key").alias("review_id"), "item_id", F.col("member").alias("reviewer"), "decision", "at", F.lit(1).cast("long").alias("version"), F.lit(True).alias("is_current"))
    own = revisions(reviews.withColumn("key", F.col("review_id")), ["item_id", "reviewer", "decision", "is_current"])
    done = reviews.select("item_id", F.lit(1).alias("_done"))
    closed = items.join(done, "item_id", "left").withColumns({"version": F.col("version") + F.coalesce("_done", F.lit(0)), "open_member": F.when(F.col("_done").isNull(), F.col("open_member"))}).drop("_done")
    return answered, reviews, own, closed


#: What a change of an item is refused for, in the order of the checks.
REFUSALS = ("NOT_FOUND", "STALE_VERSION", "CURRENTLY_OPEN", "INVALIDATION_REQUIRES_CATEGORY_CHANGE", "CATEGORY_NOT_FOUND", "CATEGORY_NOT_ACTIVE", "ITEM_NOT_ACTIVE", "CONFIRMATION_REQUIRED", "INVALIDATION_NOT_APPLICABLE", "NO_CHANGES", "SOURCE_CONFLICT")


def patched(changes: DataFrame, items: DataFrame, categories: DataFrame, reviews: DataFrame, facts: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What changes of items leave: changes with outcome, items, and the revisions of the reviews that they invalidate.

    changes, one an item: item_id, expected (version), confirm, new_reviewer and ``facts`` (null: keep), category_id,
    source and record_id among them. A review falls with its item's category, if that is confirmed; the item is then open
    to the new reviewer. A source and record that another item has, or that another change gives, is refused.
    """
    cur = reviews.filter("is_current").select("item_id", F.struct("review_id", "reviewer", "decision", "is_current", "version").alias("_review"))
    known = items.select("item_id", F.struct(*[c for c in items.columns if c != "item_id"]).alias("_old"))
    own = categories.select("category_id", F.col("active").alias("_category_active"))
    rows = changes.join(known, "item_id", "left").join(cur, "item_id", "left").join(own, "category_id", "left")
    old = lambda c: F.col(f"_old.{c}")
    new = {f: F.coalesce(F.col(f), old(f)) for f in facts}
    moved = F.col("category_id").isNotNull() & ~F.col("category_id").eqNullSafe(old("category_id"))
    controls = F.coalesce(F.col("confirm"), F.lit(False)) | F.col("new_reviewer").isNotNull()
    reviewed = F.col("_review").isNotNull()
    same = F.lit(True)
    for f in facts:
        same = same & new[f].eqNullSafe(old(f))
    checks = [
        F.col("_old").isNull(), ~F.col("expected").eqNullSafe(old("version")), old("open_member").isNotNull(), controls & ~moved, moved & F.col("_category_active").isNull(), moved & ~F.col("_category_active"),
        moved & reviewed & ~old("active"), moved & reviewed & ~(F.coalesce(F.col("confirm"), F.lit(False)) & F.col("new_reviewer").isNotNull()), moved & ~reviewed & controls, same,
    ]
    refused = F.coalesce(*[F.when(c, code) for c, code in zip(checks, REFUSALS, strict=False)])
    rows = rows.withColumns({"outcome": refused, "_invalidates": moved & reviewed} | {f"_new_{f}": x for f, x in new.items()})
    # a source and record belong to one item: whoever has them keeps them, of several changes none gets them
    takes = rows.filter("outcome IS NULL").select("item_id", F.col("_new_source").alias("source"), F.col("_new_record_id").alias("record_id"))
    held = items.select("item_id", "source", "record_id").unionByName(takes).distinct().groupBy("source", "record_id").agg(F.count_distinct("item_id").alias("_n")).filter("_n > 1").select(F.col("source").alias("_new_source"), F.col("record_id").alias("_new_record_id"), F.lit(True).alias("_taken"))
    renamed = ~(F.col("_new_source").eqNullSafe(old("source")) & F.col("_new_record_id").eqNullSafe(old("record_id")))
    rows = rows.join(held, ["_new_source", "_new_record_id"], "left")
    rows = rows.withColumn("outcome", F.coalesce("outcome", F.when(renamed & F.coalesce("_taken", F.lit(False)), REFUSALS[-1]), F.lit("PATCHED")))
    went = rows.filter("outcome = 'PATCHED'")
    fresh = went.select("item_id", *[f"_new_{f}" for f in facts], F.when(F.col("_invalidates"), F.col("new_reviewer")).alias("_opener"), F.lit(True).alias("_hit"))
    joined = items.join(fresh, "item_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    value = {f: F.when(hit, F.col(f"_new_{f}")).otherwise(F.col(f)) for f in facts} | {"version": F.col("version") + hit.cast("int"), "open_member": F.coalesce("_opener", "open_member")}
    after = joined.select(*[value[c].alias(c) if c in value else F.col(c) for c in items.columns])
    fell = went.filter("_invalidates").select("item_id", "_review")
    changed = F.col("_review").withField("is_current", F.lit(False)).withField("version", F.col("_review.version") + 1)
    return rows.select(*changes.columns, "outcome"), after, fell.select("item_id", F.col("_review.review_id").alias("review_id"), F.col("_review").alias("before"), changed.alias("after"))


def compare_and_set(requests: DataFrame, states: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """requests with outcome and inserted: commits of staged imports, each against its scope's state, in order of seq.

    requests: seq, digest (of the staged import), scope, expected (the state's fingerprint that it was staged against),
    expires_at, blocked, skip (whether to leave out blocked rows), new (rows). states: scope, fingerprint. log: digest,
    inserted, of commits gone by. A digest that has been committed, before or by an earlier request, is REPEATED with the
    result that it had then. Of the others EXPIRED, BLOCKED, STALE (its scope's state isn't the expected one, or an earlier
    request has changed it), NO_VALID_ROWS and COMMITTED; only a commit that inserts rows changes its scope's state.
    """
    rows = requests.join(log.select("digest", F.col("inserted").alias("_logged")), "digest", "left").join(states.select("scope", F.col("fingerprint").alias("_now")), "scope", "left")
    early = F.when(F.col("expires_at") <= now, "EXPIRED").when((F.col("blocked") > 0) & ~F.col("skip"), "BLOCKED").when(~F.col("_now").eqNullSafe(F.col("expected")), "STALE").when(F.col("skip") & (F.col("new") == 0), "NO_VALID_ROWS")
    rows = rows.withColumn("_early", early).withColumn("_fit", F.col("_logged").isNull() & F.col("_early").isNull())
    # only the first change of a scope's state can go through, and what goes before it
    changes = F.min(F.when(F.col("_fit") & (F.col("new") > 0), F.col("seq")))
    first = rows.groupBy("scope").agg(changes.alias("_change"))
    rows = rows.join(first, "scope", "left")
    rows = rows.withColumn("_went", F.col("_fit") & (F.col("_change").isNull() | (F.col("seq") <= F.col("_change"))))
    done = rows.filter("_went").groupBy("digest").agg(F.min_by(F.struct("seq", F.col("new").alias("inserted")), "seq").alias("_done"))
    rows = rows.join(done, "digest", "left")
    repeated = F.col("_logged").isNotNull() | (F.col("_done.seq") < F.col("seq"))
    outcome = F.when(repeated, "REPEATED").when(F.col("_went"), "COMMITTED").when((F.col("_early") == "NO_VALID_ROWS") & (F.col("seq") > F.col("_change")), "STALE").otherwise(F.coalesce("_early", F.lit("STALE")))
    rows = rows.withColumn("outcome", outcome)
    kept = F.when(F.col("outcome") == "REPEATED", F.coalesce("_logged", F.col("_done.inserted"))).when(F.col("outcome") == "COMMITTED", F.col("new"))
    return rows.select(*requests.columns, "outcome", F.coalesce(kept, F.lit(0)).cast("long").alias("inserted"))
