"""Records of runs, and undoing chosen buckets of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators import plan
from tonearm.operators.filters import LIST, trimmed

LIFETIME = "24 hours"
ORPHANS = "Other destinations"
APPLIED, UNDONE = "applied", "undone"
#: What tells an action apart: its id counts within its user's actions only.
ACT = ["user_id", "action_id"]
ACT_LIST, ACT_BUCKET = [*ACT, "playlist_id"], [*ACT, "bucket"]


def expires(created: str = "created_at") -> Column:
    return F.col(created) + F.expr(f"interval {LIFETIME}")


def seconds_left(as_of: Column, expires_at: str = "expires_at") -> Column:
    """Whole seconds, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.unix_micros(F.col(expires_at).cast("timestamp")) / 1e6 - F.unix_micros(as_of.cast("timestamp")) / 1e6))


def status(given: str = "status") -> Column:
    """A bucket's status as it is stored: anything unknown counts as applied."""
    return F.when(F.col(given) == UNDONE, UNDONE).otherwise(APPLIED)


# ---- stored records ----


def _text(value: Column, path: str) -> Column:
    """A field of a record if it is a string."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def _array(value: Column, path: str, of: str = "variant") -> Column:
    return F.try_variant_get(value, path, f"array<{of}>")


def parse(raw: DataFrame, json: str = "raw", user: str = "user_id") -> DataFrame:
    """Rows whose JSON is a record of their user's, with action_id, created_at, expires_at and the whole record as column action.

    The record is a variant: fields that nobody here knows stay in it.  Anything else is left out.
    """
    # as the output of a generator: a projection would be put into each condition below, and the text read again for each
    rows = raw.drop("action").select("*", F.explode(F.array(F.try_parse_json(json))).alias("action"))
    a = F.col("action")
    named = (F.coalesce(_text(a, "$.id"), F.lit("")) != "") & _text(a, "$.userId").eqNullSafe(F.col(user)) & _text(a, "$.createdAt").isNotNull() & _text(a, "$.expiresAt").isNotNull()
    good = rows.where(named & _array(a, "$.destinations").isNotNull() & _array(a, "$.buckets").isNotNull())
    return good.withColumns({"action_id": _text(a, "$.id"), "created_at": F.try_variant_get(a, "$.createdAt", "timestamp"), "expires_at": F.try_variant_get(a, "$.expiresAt", "timestamp")})


def places_of(parsed: DataFrame) -> DataFrame:
    """(user_id, action_id, place, playlist_id, name, expected, bucket_order, baseline): the lists that records name, in order."""
    rows = parsed.select(*ACT, F.posexplode(_array(F.col("action"), "$.destinations")).alias("place", "d"))
    d = F.col("d")
    return rows.select(*ACT, "place", _text(d, "$.playlistId").alias("playlist_id"), _text(d, "$.playlistName").alias("name"), _text(d, "$.expectedSnapshotId").alias("expected"), _array(d, "$.bucketOrder", "string").alias("bucket_order"), _array(d, "$.baselineUris", "string").alias("baseline"))


def buckets_of(parsed: DataFrame) -> DataFrame:
    """(user_id, action_id, bucket_ordinal from 1, bucket, playlist_id, name, uris, n, tracks, status): the buckets of records, in order."""
    rows = parsed.select(*ACT, F.posexplode(_array(F.col("action"), "$.buckets")).alias("at", "b"))
    b, uris = F.col("b"), F.coalesce(_array(F.col("b"), "$.trackUris", "string"), F.array().cast("array<string>"))
    return rows.select(*ACT, (F.col("at") + 1).alias("bucket_ordinal"), _text(b, "$.bucket").alias("bucket"), _text(b, "$.playlistId").alias("playlist_id"), _text(b, "$.playlistName").alias("name"), uris.alias("uris"), F.size(uris).cast("bigint").alias("n"), F.try_variant_get(b, "$.tracks", "variant").alias("tracks"), _text(b, "$.status").alias("given")).withColumn("status", status("given")).drop("given")


def listed(rows: DataFrame, keys: list[str], array: str) -> DataFrame:
    """(keys, position, uri): a recorded array of uris as rows."""
    return rows.select(*keys, F.posexplode(array).alias("position", "uri"))


def _with(value: Column, **new: Column) -> Column:
    """A record with some fields set, which are not null; as it is if it is no record.  Each argument is worked out once."""
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    pairs = [x for name, c in new.items() for x in (F.lit(name), c.cast("variant"))]
    return F.coalesce(F.to_variant_object(F.map_concat(F.map_filter(fields, lambda k, _: ~k.isin(*new)), F.create_map(*pairs))), value)


def stored_again(parsed: DataFrame, after: DataFrame, snapshots: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(user_id, action_id, expires_at, action): records with new states of buckets and snapshots of lists; all else as it was.

    after: user_id, action_id, bucket_ordinal, status.  snapshots: user_id, action_id, place, expected.  keep writes a table and
    reads it back: the new states and then the new snapshots, so that nothing else is on the disks when records are joined with them.
    """
    by_place = lambda at, value: F.map_from_entries(F.collect_list(F.struct(F.col(at).cast("int"), F.coalesce(value, F.lit("")))))
    states = after.groupBy(*ACT).agg(by_place("bucket_ordinal", "status").alias("states"))
    seen = snapshots.groupBy(*ACT).agg(by_place("place", "expected").alias("seen"))
    if keep:
        states, seen = keep(states), keep(seen)
    rows = parsed.join(states, ACT, "left").join(seen, ACT, "left")
    a = F.col("action")
    one = lambda x, name, new: F.when(new.isNotNull(), _with(x, **{name: new})).otherwise(x)
    lists = F.transform(_array(a, "$.destinations"), lambda d, i: one(d, "expectedSnapshotId", F.try_element_at("seen", i)))
    held = F.transform(_array(a, "$.buckets"), lambda b, i: one(b, "status", F.try_element_at("states", i + 1)))
    # parse() leaves records with both arrays only
    return rows.select(*ACT, "expires_at", _with(a, destinations=lists, buckets=held).alias("action"))


def latest(actions: DataFrame, as_of: Column) -> DataFrame:
    """The latest action of each user if it is good and not expired; an older one never takes its place."""
    cols = [c for c in actions.columns if c not in ("user_id", "created_at")]
    last = actions.groupBy("user_id").agg(F.max(F.struct("created_at", *cols)).alias("r")).select("user_id", "r.*")
    return last.where((F.col("expires_at") > as_of) & F.col("valid"))


def live(actions: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, action_id) of the actions that can still be undone."""
    return actions.where(F.col("expires_at") > as_of).select(*ACT)


# ---- recording ----

def destinations(buckets: DataFrame, keys: list[str] = LIST) -> DataFrame:
    """(keys, place, bucket_order): one row for each list that was written, its buckets in order.

    place is that of the list's first bucket; it orders the lists of an action.
    """
    told = F.array_sort(F.collect_list(F.struct("bucket_ordinal", "bucket")))
    grouped = buckets.groupBy(*keys).agg(F.min("bucket_ordinal").alias("place"), told.alias("r"))
    return grouped.select(*keys, "place", F.transform("r", lambda x: x["bucket"]).alias("bucket_order"))


def uris(rows: DataFrame, keys: list[str], name: str, value: str = "uri") -> DataFrame:
    """(keys, name): the uris, or other values, of some rows in order."""
    told = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", value))).alias("r"))
    return told.select(*keys, F.transform("r", lambda x: x[value]).alias(name))


#: A track as a record keeps it.
TRACKS = "array<struct<id:string,name:string,artists:array<string>,albumName:string,url:string>>"


def record(written: DataFrame, headers: DataFrame, baseline: DataFrame, candidates: DataFrame, snapshots: DataFrame, created_at: Column) -> DataFrame:
    """(user_id, run, action, warning): the action of each user and run with a successful write; its JSON is to_json(action).

    written: user_id, run (any name of a run of the user's), playlist_id, bucket, bucket_ordinal and status of the successful
    writes.  headers: user_id, playlist_id, name.  baseline: user_id, playlist_id, position, uri of what the lists held before.
    candidates: user_id, bucket, position, uri and, for the tracks of buckets, summary.  snapshots: user_id, playlist_id,
    actual after the writes.  created_at: over the columns of written.  A list whose snapshot is not known leaves its run
    without an action and with a warning that names it.
    """
    run = ["user_id", "run"]
    written = written.withColumn("created_at", created_at).select(*run, "playlist_id", "bucket", "bucket_ordinal", "status", "created_at")
    held = destinations(written, [*run, "playlist_id"]).join(headers.select(*LIST, "name"), LIST, "left").join(snapshots.select(*LIST, "actual"), LIST, "left").join(uris(baseline, LIST, "baseline"), LIST, "left")
    none = F.array().cast("array<string>")
    text = lambda c: F.col(c).cast("string")
    place = F.struct(text("playlist_id").alias("playlistId"), F.col("name").alias("playlistName"), F.coalesce("baseline", none).alias("baselineUris"), F.col("actual").alias("expectedSnapshotId"), F.col("bucket_order").alias("bucketOrder"))
    lost = F.min(F.when(F.col("actual").isNull(), F.struct("place", text("playlist_id").alias("id"))))["id"]
    lists = held.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("place", place.alias("d")))).alias("places"), lost.alias("lost"))
    given = candidates if "summary" in candidates.columns else candidates.withColumn("summary", F.lit(None).cast(TRACKS[6:-1]))
    each = F.array_sort(F.collect_list(F.struct("position", "uri", "summary")))
    found = given.groupBy("user_id", "bucket").agg(each.alias("r")).select("user_id", "bucket", F.transform("r", lambda x: x["uri"]).alias("uris"), F.filter(F.transform("r", lambda x: x["summary"]), lambda x: x.isNotNull()).alias("tracks"))
    tracks = written.join(headers.select(*LIST, "name"), LIST, "left").join(found, ["user_id", "bucket"], "left")
    bucket = F.struct(F.col("bucket"), text("playlist_id").alias("playlistId"), F.col("name").alias("playlistName"), F.coalesce("uris", none).alias("trackUris"), F.coalesce("tracks", F.array().cast(TRACKS)).alias("tracks"), status().alias("status"))
    whole = tracks.groupBy(*run).agg(F.min("created_at").alias("created_at"), F.array_sort(F.collect_list(F.struct("bucket_ordinal", bucket.alias("b")))).alias("buckets"))
    rows = whole.join(lists, run).withColumn("expires_at", expires())
    number = F.sha2(F.concat_ws("|", F.lit("action"), text("user_id"), text("run"), F.unix_micros("created_at").cast("string")), 256)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    action = F.struct(number.alias("id"), text("user_id").alias("userId"), iso("created_at").alias("createdAt"), iso("expires_at").alias("expiresAt"), F.transform("places", lambda x: x["d"]).alias("destinations"), F.transform("buckets", lambda x: x["b"]).alias("buckets"))
    return rows.select(*run, F.when(F.col("lost").isNull(), action).alias("action"), F.concat(F.lit("no action was recorded: the final snapshot is not known of list "), "lost").alias("warning"))


def update(actions: DataFrame, as_of: Column) -> DataFrame:
    """actions to be stored again: their expiry stays as it was, and seconds_left tells for how long they are kept, 1 at least."""
    return actions.withColumn("seconds_left", seconds_left(as_of).cast("bigint"))


# ---- undoing ----

def request_ok() -> Column:
    """An undo request names something, nothing blank, nothing twice (after trimming white space of every kind)."""
    names = F.transform("buckets", lambda b: trimmed(b))
    good = (F.size("buckets") > 0) & F.forall(names, lambda b: F.coalesce(b, F.lit("")) != "") & (F.size(F.array_distinct(names)) == F.size("buckets"))
    return F.coalesce(good, F.lit(False))


def asked(requested: DataFrame, can: DataFrame) -> DataFrame:
    """(user_id, action_id, bucket) of good requests (user_id, action_id, buckets) for actions in can; one request an action."""
    rows = requested.where(request_ok()).select(*ACT, F.explode(F.transform("buckets", lambda b: trimmed(b))).alias("bucket"))
    return rows.join(can.select(*ACT), ACT, "left_semi")


def unknown(wanted: DataFrame, buckets: DataFrame) -> DataFrame:
    return wanted.join(buckets.select(*ACT_BUCKET), ACT_BUCKET, "left_anti")


def already_undone(wanted: DataFrame, buckets: DataFrame) -> DataFrame:
    return wanted.join(buckets.where(F.col("status") == UNDONE).select(*ACT_BUCKET), ACT_BUCKET, "left_semi")


def misplaced(wanted: DataFrame, buckets: DataFrame, places: DataFrame) -> DataFrame:
    """(user_id, action_id, bucket, playlist_id): buckets asked for whose list the action does not name."""
    found = wanted.join(buckets.select(*ACT_BUCKET, "playlist_id"), ACT_BUCKET)
    return found.join(places.select(*ACT_LIST), ACT_LIST, "left_anti").select(*ACT_BUCKET, "playlist_id")


def selection(wanted: DataFrame, buckets: DataFrame, places: DataFrame) -> DataFrame:
    """Action buckets that were asked for, of requests where each is known, applied and in a list that the action names."""
    named = places.select(*ACT_LIST).distinct().withColumn("named", F.lit(True))
    known = buckets.withColumn("known", F.lit(True))
    found = wanted.select(*ACT_BUCKET).distinct().join(known, ACT_BUCKET, "left").join(named, ACT_LIST, "left")
    bad = F.col("known").isNull() | F.col("named").isNull() | F.col("status").eqNullSafe(UNDONE)
    refused = F.max(bad).over(Window.partitionBy(*ACT))
    return found.withColumn("refused", refused).where(~F.col("refused")).select(*buckets.columns)


def conflicts(chosen: DataFrame, places: DataFrame, current: DataFrame) -> DataFrame:
    """(user_id, action_id, playlist_id, name, expected, actual, buckets): lists to be rebuilt that changed since, and what was asked of them.

    places: user_id, action_id, playlist_id, name, expected.  current: user_id, playlist_id, actual.
    """
    told = F.array_sort(F.collect_list(F.struct("bucket_ordinal", "bucket")))
    lists = chosen.groupBy(*ACT_LIST).agg(told.alias("r")).select(*ACT_LIST, F.transform("r", lambda x: x["bucket"]).alias("buckets"))
    rows = lists.join(places.select(*ACT_LIST, "name", "expected"), ACT_LIST).join(current.select(*LIST, "actual"), LIST, "left")
    return rows.where(~F.col("actual").eqNullSafe(F.col("expected"))).select(*ACT_LIST, "name", "expected", "actual", "buckets")


def rewritten(chosen: DataFrame, conflicting: DataFrame) -> DataFrame:
    """(user_id, action_id, playlist_id) of the lists to write: one conflict voids all writes of its action, and no other's."""
    return chosen.select(*ACT_LIST).distinct().join(conflicting.select(*ACT).distinct(), ACT, "left_anti")


def rebuild(chosen: DataFrame, conflicting: DataFrame, buckets: DataFrame, baseline: DataFrame, recorded: DataFrame) -> DataFrame:
    """(user_id, action_id, playlist_id, position, uri) of the lists to write: the recorded baseline and the buckets that stay.

    baseline: user_id, action_id, playlist_id, position, uri.  recorded: user_id, action_id, bucket, position, uri.  A list that becomes
    empty has no rows here: replace clears it.
    """
    lists = rewritten(chosen, conflicting)
    stay = buckets.where(F.col("status") == APPLIED).join(chosen.select(*ACT_BUCKET), ACT_BUCKET, "left_anti").join(lists, ACT_LIST, "left_semi")
    more = recorded.select(*ACT_BUCKET, "position", "uri").join(stay.select(*ACT_BUCKET, "bucket_ordinal", "playlist_id"), ACT_BUCKET)
    a = baseline.join(lists, ACT_LIST, "left_semi").select(*ACT_LIST, F.lit(0).alias("bucket_ordinal"), "position", "uri")
    at = F.row_number().over(Window.partitionBy(*ACT_LIST).orderBy("bucket_ordinal", "position")) - 1
    return a.unionByName(more.select(*ACT_LIST, "bucket_ordinal", "position", "uri")).select(*ACT_LIST, at.alias("position"), "uri")


def transition(buckets: DataFrame, chosen: DataFrame, conflicting: DataFrame, receipts: DataFrame) -> DataFrame:
    """Action buckets with their new status: undone where asked for, not voided, and the write was confirmed."""
    confirmed = rewritten(chosen, conflicting).join(receipts.where("ok").select(*LIST), LIST, "left_semi")
    done = chosen.join(confirmed, ACT_LIST, "left_semi").select(*ACT_BUCKET, F.lit(True).alias("now"))
    return buckets.join(done, ACT_BUCKET, "left").withColumn("status", F.when(F.col("now"), UNDONE).otherwise(F.col("status"))).drop("now")


def new_snapshots(places: DataFrame, chosen: DataFrame, conflicting: DataFrame, receipts: DataFrame) -> DataFrame:
    """places with expected as it is after an undo: the snapshot of the write where one was confirmed, else as before.

    receipts: user_id, playlist_id, ok, snapshot.
    """
    confirmed = rewritten(chosen, conflicting).join(receipts.where("ok").select(*LIST, "snapshot"), LIST)
    return places.join(confirmed, ACT_LIST, "left").withColumn("expected", F.coalesce("snapshot", "expected")).drop("snapshot")


#: What becomes of a request, in the order in which it is looked at.
INVALID, NOT_FOUND, UNKNOWN, AGAIN, MISPLACED, CONFLICT = "invalid request", "action not found", "unknown bucket", "already undone", "missing destination", "conflict"


def outcomes(requested: DataFrame, can: DataFrame, buckets: DataFrame, places: DataFrame, chosen: DataFrame, conflicting: DataFrame, after: DataFrame) -> DataFrame:
    """(user_id, action_id, outcome) of each request: why nothing is written, or complete, or partial if a bucket asked for is still applied."""
    wanted = asked(requested, can)
    reasons = [(1, UNKNOWN, unknown(wanted, buckets)), (2, AGAIN, already_undone(wanted, buckets)), (3, MISPLACED, misplaced(wanted, buckets, places)), (4, CONFLICT, conflicting)]
    left = after.where(F.col("status") == APPLIED).join(chosen.select(*ACT_BUCKET), ACT_BUCKET, "left_semi")
    told = None
    for rank, name, rows in [*reasons, (5, "partial", left)]:
        one = rows.select(*ACT, F.lit(rank).alias("rank"), F.lit(name).alias("told"))
        told = one if told is None else told.unionByName(one)
    first = told.groupBy(*ACT).agg(F.min(F.struct("rank", "told"))["told"].alias("told"))
    rows = requested.select(*ACT, request_ok().alias("good")).join(can.select(*ACT, F.lit(True).alias("there")), ACT, "left").join(first, ACT, "left")
    return rows.select(*ACT, F.when(~F.col("good"), INVALID).when(F.col("there").isNull(), NOT_FOUND).otherwise(F.coalesce("told", F.lit("complete"))).alias("outcome"))


def plan_undo(requested: DataFrame, parsed: DataFrame, current: DataFrame, receipts: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """All steps of undoing, from requests (user_id, action_id, buckets) and records as parse() gives them.

    Everything to be written comes from the record: its baseline and uris, not what lists or candidates hold now.  An action whose
    record is missing, another user's or expired writes nothing, nor does one that lacks the list of a bucket asked for.
    """
    can, buckets, places = live(parsed, as_of), buckets_of(parsed), places_of(parsed)
    chosen = selection(asked(requested, can), buckets, places)
    changed = conflicts(chosen, places, current)
    after, seen = transition(buckets, chosen, changed, receipts), new_snapshots(places, chosen, changed, receipts)
    rebuilt = rebuild(chosen, changed, buckets, listed(places, ACT_LIST, "baseline"), listed(buckets, ACT_BUCKET, "uris"))
    told = outcomes(requested, can, buckets, places, chosen, changed, after)
    return {"chosen": chosen, "conflicts": changed, "lists": rewritten(chosen, changed), "rebuilt": rebuilt, "buckets": after, "snapshots": seen, "totals": undo_totals(after), "outcomes": told, "records": stored_again(parsed, after, seen)}


def undo_stored(wanted: DataFrame, parsed: DataFrame, buckets: DataFrame, places: DataFrame, current: DataFrame, receipts: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The records of plan_undo() alone, from buckets_of() and places_of() the parsed ones, which may lack tracks and baselines.

    keep writes a table and reads it back: what was chosen and what changed since, which several steps read, and last the new
    states and the new snapshots, which alone are read with the records.
    """
    chosen = keep(selection(wanted, buckets, places))
    changed = keep(conflicts(chosen, places, current))
    return stored_again(parsed, transition(buckets, chosen, changed, receipts), new_snapshots(places, chosen, changed, receipts), keep)


def undo_totals(after: DataFrame) -> DataFrame:
    """(user_id, action_id, applied, undone, tracks_undone) of each action."""
    gone = F.col("status") == UNDONE
    return after.groupBy(*ACT).agg(F.count_if(~gone).alias("applied"), F.count_if(gone).alias("undone"), F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("tracks_undone"))


def groups(places: DataFrame, buckets: DataFrame) -> DataFrame:
    """(user_id, action_id, group_no, place, at, bucket): the buckets under their lists, lists and buckets in the order of the action.

    places: user_id, action_id, playlist_id, name, place, bucket_order.  Buckets whose list is not among them come last, under ORPHANS.
    """
    number = F.row_number().over(Window.partitionBy(*ACT).orderBy("place"))
    numbered = places.withColumn("group_no", number)
    named = numbered.select(*ACT, "group_no", F.col("name").alias("place"), F.posexplode("bucket_order").alias("at", "bucket"))
    known = named.join(buckets.select(*ACT_BUCKET), ACT_BUCKET, "left_semi")
    last = numbered.groupBy(*ACT).agg(F.max("group_no").alias("groups"))
    orphans = buckets.join(places.select(*ACT_LIST), ACT_LIST, "left_anti").join(last, ACT, "left")
    at = F.row_number().over(Window.partitionBy(*ACT).orderBy("bucket_ordinal")) - 1
    more = orphans.select(*ACT, (F.coalesce("groups", F.lit(0)) + 1).alias("group_no"), F.lit(ORPHANS).alias("place"), at.alias("at"), "bucket")
    return known.select(*ACT, "group_no", "place", "at", "bucket").unionByName(more)


def undone_names(buckets: DataFrame) -> DataFrame:
    return buckets.where(F.col("status") == UNDONE).groupBy(*ACT).agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))


def copies_of(written: DataFrame) -> DataFrame:
    """Writes on the copies of their lists instead of the lists themselves."""
    return written.withColumn("playlist_id", plan.list_id("copy", *LIST))
