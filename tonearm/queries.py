"""The registered queries of the library operators."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm import schemas, tables
from tonearm.fixtures import Library, by_user
from tonearm.operators import actions, batches, cache, classify, filters, keywords, match, plan, positions, requests, upkeep
from tonearm.operators.filters import LIST
from tonearm.sources import artists, chains, pages, store
from tonearm.streaming import latest as streamed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Library(spark, sf_dir))
    return f


def sharing(f: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
    """For queries that read the items more than once: they are put in order once."""

    @functools.wraps(f)
    def run(lib: Library) -> DataFrame:
        lib.share_items()
        return f(lib)

    return query(run)


def classifying(f: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
    """For queries that read the items and the buckets of all of them: both are put in order once."""

    @functools.wraps(f)
    def run(lib: Library) -> DataFrame:
        lib.share_classified()
        return f(lib)

    return query(run)


def _joined(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


def _n(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


@query
def sortable_items(lib: Library) -> DataFrame:
    return lib.items().where(filters.sortable(F.col("track"))).select(*LIST, _n("position"), F.col("track.id").alias("track_id"))


@query
def copyable_uris(lib: Library) -> DataFrame:
    return filters.copyable_uris(lib.items()).select(*LIST, _joined("uris"))


@query
def track_summary(lib: Library) -> DataFrame:
    rows = lib.items().where(filters.sortable(F.col("track"))).select(*LIST, "position", filters.summary(F.col("track")).alias("s"))
    return rows.select(*LIST, _n("position"), "s.id", "s.name", F.array_join("s.artists", ",").alias("artists"), "s.album", "s.url")


@query
def playlist_item_count(lib: Library) -> DataFrame:
    n = lib.items().groupBy(*LIST).agg(F.count("*").alias("n"))
    rows = lib.playlists().join(n, LIST, "left")
    rows = rows.withColumn("items_total", F.when(F.col("playlist_id") % 3 != 0, F.col("n"))).withColumn("tracks_total", F.when(F.col("playlist_id") % 5 != 0, F.col("n")))
    return rows.select(*LIST, filters.item_count(rows).alias("n_items"))


@query
def normalize_genre(lib: Library) -> DataFrame:
    return classify.normalize(lib.artist_genres(), lib.rules()).select("genre", "bucket")


@query
def artist_bucket(lib: Library) -> DataFrame:
    return lib.dim().select("artist_id", "bucket")


@query
def track_bucket(lib: Library) -> DataFrame:
    return lib.assigned().select(*LIST, _n("position"), "track_id", "bucket")


@query
def bucket_counts(lib: Library) -> DataFrame:
    return lib.assigned().groupBy("bucket").agg(F.count("*").alias("n"))


@query
def library_buckets(lib: Library) -> DataFrame:
    _, buckets = classify.classify_library(lib.items(), lib.artist_genres(), lib.rules())
    return buckets.select("user_id", "bucket", "n", _n("first_position"))


@query
def bucket_map(lib: Library) -> DataFrame:
    rows = lib.buckets().join(classify.bucket_tracks(lib.source_assigned()), ["user_id", "bucket"])
    return rows.select("user_id", "bucket", "n", _n("first_position"), _joined("track_ids"), _n("bucket_ordinal"))


@query
def distinct_artists(lib: Library) -> DataFrame:
    return classify.first_seen_artists(lib.items()).select("user_id", "artist_id", F.col("seen.playlist_id").alias("playlist_id"), F.col("seen.position").cast("bigint").alias("position"), F.col("seen.artist_pos").cast("bigint").alias("artist_pos"))


def _wanted(lib: Library) -> DataFrame:
    return classify.first_seen_artists(lib.items()).select("artist_id").distinct()


@query
def fresh_artists(lib: Library) -> DataFrame:
    return cache.fresh(_wanted(lib), lib.cached(), lib.as_of).select("artist_id", _joined("genres"))


@query
def missing_artists(lib: Library) -> DataFrame:
    wanted = _wanted(lib)
    return cache.missing(wanted, cache.fresh(wanted, lib.cached(), lib.as_of))


@query
def cache_upsert_latest(lib: Library) -> DataFrame:
    log = lib.table("events").select(F.col("user_id").alias("artist_id"), F.col("ts").alias("fetched_at"), F.col("value").alias("payload"))
    return cache.upsert_latest(log, "artist_id", "fetched_at", ["payload"])


@query
def effective_genres(lib: Library) -> DataFrame:
    wanted = _wanted(lib)
    fresh = cache.fresh(wanted, lib.cached(), lib.as_of)
    return cache.effective(fresh, lib.fetched(cache.missing(wanted, fresh))).select("artist_id", _joined("genres"))


@query
def artist_request_batches(lib: Library) -> DataFrame:
    seen = classify.first_seen_artists(lib.items())
    rows = cache.missing(seen, cache.fresh(seen, lib.cached(), lib.as_of))
    return filters.batches(rows, ["user_id"], ["seen"], "artist_id", 50).select("user_id", _n("batch_no"), _joined("values"))


@query
def validate_playlists(lib: Library) -> DataFrame:
    return match.validate(lib.playlists()).select(*LIST, F.coalesce("reason", F.lit("valid")).alias("verdict"))


@query
def editable_playlists(lib: Library) -> DataFrame:
    return lib.playlists().select(*LIST, filters.editable().alias("editable"), (~filters.editable() & (F.col("ordinal") != 1)).alias("unavailable"))


@query
def not_found_ids(lib: Library) -> DataFrame:
    lists = lib.playlists()
    asked = lists.select("user_id", F.explode(F.array("playlist_id", F.col("playlist_id") + 1)).alias("playlist_id"))
    return match.not_found(asked, lists).select(*LIST, "reason")


@query
def selected_playlists(lib: Library) -> DataFrame:
    lists = lib.playlists()
    asked = lists.where("playlist_id % 3 = 0").select("user_id", F.explode(F.array("playlist_id", "playlist_id")).alias("playlist_id"))
    rows = match.selected(asked, lists).join(lib.sources().select("user_id", F.col("playlist_id").alias("source_id")), "user_id")
    return filters.without_source(rows).select(*LIST, _n("ordinal"))


@query
def genre_profile(lib: Library) -> DataFrame:
    return match.genre_profile(lib.assigned()).select(*LIST, "bucket", "n", F.round("share", 9).alias("share"))


@query
def bucket_match_scores(lib: Library) -> DataFrame:
    return lib.scores().select("user_id", "bucket", "playlist_id", F.round("score", 9).alias("score"))


@query
def best_match(lib: Library) -> DataFrame:
    return lib.matched().select("user_id", "bucket", "playlist_id", F.round("score", 9).alias("score"))


@query
def unmatched_buckets(lib: Library) -> DataFrame:
    matched = lib.matched()
    return match.unmatched(lib.buckets(), matched).select("user_id", "bucket", "n")


@query
def replay_safe(lib: Library) -> DataFrame:
    return lib.safety()


@query
def plan_auto_create(lib: Library) -> DataFrame:
    return plan.auto_create(lib.source_assigned(), lib.buckets()).select("user_id", "bucket", "list_id", _n("position"), "uri")


@classifying
def plan_safe_copy(lib: Library) -> DataFrame:
    return plan.safe_copy(lib.matched(), lib.source_assigned(), lib.buckets(), lib.items()).select(*LIST, _n("position"), "uri")


@query
def copy_names(lib: Library) -> DataFrame:
    return lib.copies().select("user_id", F.col("playlist_id").alias("list_id"), F.col("name").alias("copy_name"), "owner_id", "collaborative", "public")


@classifying
def plan_direct(lib: Library) -> DataFrame:
    return plan.direct(lib.matched(), lib.source_assigned(), lib.buckets(), lib.safety()).select(*LIST, _n("position"), "uri")


@query
def plan_backup(lib: Library) -> DataFrame:
    return plan.backup(lib.sources(), lib.items()).select("user_id", "name", "list_id", _n("position"), "uri")


@query
def backup_status(lib: Library) -> DataFrame:
    return lib.backups().select(*LIST, "list_id", "name", _n("tracks_copied"), "status")


@sharing
def run_outcomes(lib: Library) -> DataFrame:
    return lib.runs().select(*LIST, _n("n_sortable"), "outcome")


@sharing
def valid_destinations(lib: Library) -> DataFrame:
    return lib.validated()[0].select(*LIST, "name", _n("ordinal"))


@sharing
def excluded_playlists(lib: Library) -> DataFrame:
    return lib.validated()[1].select(*LIST, "name", "reason", _n("place"))


@query
def refresh_artist_cache(lib: Library) -> DataFrame:
    asked = classify.item_artists(lib.items()).select("artist_id")
    _, _, after = cache.refresh(asked, lib.cached(), lib.fetched(asked), lib.as_of)
    return after.select("artist_id", _joined("genres"), "last_fetched_at")


def _own_folder(lib: Library) -> str:
    return f"{tables.shared_dir(lib.spark)}/tonearm-{lib.spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _artist_table(lib: Library) -> tuple[artists.ArtistTable, DataFrame]:
    """The artist table on disk after a run over all items, and the genres that the run uses."""
    kept = artists.ArtistTable(lib.spark, _own_folder(lib))
    kept.upsert(lib.cached())
    return kept, kept.refresh(classify.item_artists(lib.items()).select("artist_id"), lib.fetched, lib.as_of)


@query
def artist_table(lib: Library) -> DataFrame:
    return _artist_table(lib)[0].rows().select("artist_id", _joined("genres"), "last_fetched_at")


@query
def artist_table_genres(lib: Library) -> DataFrame:
    return _artist_table(lib)[1].select("artist_id", _joined("genres"))


@classifying
def append_lists(lib: Library) -> DataFrame:
    return pages.append_items(lib.items(), _appended(lib)).select(*LIST, _n("position"), F.col("track").alias("uri"))


def _appended(lib: Library) -> DataFrame:
    matched = lib.matched()
    more = lib.candidates().join(matched.select("user_id", "bucket", "playlist_id"), ["user_id", "bucket"])
    at = F.row_number().over(Window.partitionBy(*LIST).orderBy("bucket_ordinal", "position")) - 1
    return more.select(*LIST, at.alias("rank"), F.col("uri").alias("track"))


@classifying
def write_batches(lib: Library) -> DataFrame:
    rows = plan.safe_copy(lib.matched(), lib.source_assigned(), lib.buckets(), lib.items())
    return filters.batches(rows, LIST, ["position"], "uri", 5).select(*LIST, _n("batch_no"), _joined("values"))


def _ledger(lib: Library) -> DataFrame:
    matched = lib.matched()  # first: it classifies all items, of which the sources' buckets are a part
    return plan.ledger(lib.buckets(), matched, lib.receipts())


@query
def result_ledger(lib: Library) -> DataFrame:
    return _ledger(lib).select("user_id", "bucket", "playlist_id", "n", "status", _n("tracks_added"), "reason", _n("result_ordinal"))


@classifying
def direct_ledger(lib: Library) -> DataFrame:
    matched = lib.matched()
    rows = plan.ledger(lib.buckets(), matched, lib.receipts(), by_user(plan.refused(lib.safety())))
    return rows.select("user_id", "bucket", "playlist_id", "n", "status", _n("tracks_added"), "reason", _n("result_ordinal"))


@query
def ledger_totals(lib: Library) -> DataFrame:
    return plan.ledger_totals(_ledger(lib)).select("user_id", _n("succeeded"), _n("failed"), _n("tracks_added"))


@query
def unique_copies(lib: Library) -> DataFrame:
    return plan.unique_copies(_ledger(lib))


ACT = actions.ACT


@classifying
def action_destinations(lib: Library) -> DataFrame:
    base = actions.uris(lib.baseline(), actions.ACT_LIST, "baseline")
    rows = lib.places().join(base, actions.ACT_LIST, "left")
    return rows.select(*ACT, "playlist_id", _n("place"), _joined("bucket_order"), F.coalesce(F.array_join("baseline", ","), F.lit("")).alias("baseline"), "expected")


def _flat(lists: Column, buckets: Column, track: Callable[[Column], Column]) -> list[Column]:
    d = F.transform(lists, lambda d: F.concat_ws(":", d["playlistId"], d["playlistName"], d["expectedSnapshotId"], F.array_join(d["bucketOrder"], "+"), F.array_join(d["baselineUris"], "+")))
    b = F.transform(buckets, lambda b: F.concat_ws(":", b["bucket"], b["playlistId"], b["playlistName"], b["status"], F.array_join(b["trackUris"], "+"), F.array_join(F.transform(b["tracks"], track), "+")))
    return [F.array_join(d, ";").alias("destinations"), F.array_join(b, ";").alias("buckets")]


def _track(t: Column) -> Column:
    return F.concat_ws("/", t["id"], t["name"], F.array_join(t["artists"], ","), t["albumName"], t["url"])


@classifying
def record_action(lib: Library) -> DataFrame:
    a = F.col("action")
    rows = lib.recorded()
    times = [F.to_timestamp(a[c]).alias(n) for c, n in (("createdAt", "created_at"), ("expiresAt", "expires_at"))]
    return rows.select("user_id", "run", a["id"].alias("action_id"), *times, *_flat(a["destinations"], a["buckets"], _track), "warning")


def _stored(lib: Library) -> DataFrame:
    """Records as a store gives them, each with a field that only its writer knows; read again."""
    rows = lib.recorded().where("action is not null")
    told = F.to_json(F.struct("action.*", F.struct(F.col("user_id").alias("of")).alias("client")))
    return actions.parse(rows.select(F.col("user_id").cast("string").alias("user_id"), "run", told.alias("raw")))


@classifying
def update_action(lib: Library) -> DataFrame:
    rows = actions.update(_stored(lib).select(F.col("user_id").cast("bigint").alias("user_id"), "run", "action_id", "expires_at"), lib.as_of)
    return rows


@classifying
def undo_records(lib: Library) -> DataFrame:
    """Undoing from stored records alone, and the records as they are stored again: new states and snapshots, all else kept."""
    # each table goes as soon as nothing that comes reads it
    stored = _stored(lib).drop("run", "raw")
    lib.forget(*lib.RECORDED)
    stored = tables.write(stored, "zstd")
    lib.forget()
    kept: list[DataFrame] = []

    def keep(rows: DataFrame) -> DataFrame:
        kept.append(tables.write(rows, "zstd"))
        return by_user(kept[-1])

    # what the steps of undoing look at; only the records themselves hold tracks and baselines
    slim = actions.buckets_of(stored).drop("uris", "tracks", "name"), actions.places_of(stored).drop("baseline", "bucket_order")
    buckets, lists = map(keep, slim)
    stored = by_user(stored)
    asked = buckets.where((F.col("bucket_ordinal") + F.col("user_id").cast("bigint")) % 2 == 0).groupBy(*ACT).agg(F.collect_list("bucket").alias("buckets"))
    current = lists.select(*LIST, F.when(F.substring("playlist_id", 1, 1) == "1", "changed").otherwise(F.col("expected")).alias("actual"))
    receipts = lists.select(*LIST, (F.col("user_id").cast("bigint") % 11 != 0).alias("ok"), F.concat(F.lit("n"), F.substring("playlist_id", 1, 8)).alias("snapshot"))
    can = actions.live(stored, lib.as_of)
    again = actions.undo_stored(actions.asked(asked, can), stored, buckets, lists, current, receipts, keep)
    tables.discard(*kept[:-2])  # all but the new states and snapshots
    read = actions.parse(again.select("user_id", F.to_json("action").alias("raw")))
    shape = "struct<destinations:array<struct<playlistId:string,playlistName:string,expectedSnapshotId:string,bucketOrder:array<string>,baselineUris:array<string>>>,buckets:array<struct<bucket:string,playlistId:string,playlistName:string,status:string,trackUris:array<string>,tracks:" + actions.TRACKS + ">>,client:struct<of:bigint>>"
    read = read.select("user_id", "action_id", "expires_at", F.explode(F.array(F.try_variant_get("action", "$", shape))).alias("a"))
    a = F.col("a")
    return read.select(F.col("user_id").cast("bigint").alias("user_id"), "action_id", *_flat(a["destinations"], a["buckets"], _track), a["client"]["of"].alias("client_of"), "expires_at")


@query
def latest_action(lib: Library) -> DataFrame:
    last = actions.latest(lib.action_log(), F.expr("timestamp '2024-01-29 12:00:00'"))
    return last.select("user_id", "action_id", actions.seconds_left(F.expr("timestamp '2024-01-29 12:00:00'")).cast("bigint").alias("seconds_left"))


@query
def latest_action_state(lib: Library) -> DataFrame:
    """The latest action of each user from a stream of all saved actions, if it is good and not expired."""
    path = _own_folder(lib)
    streamed.run(lib.action_stream(), path)
    last = streamed.latest(lib.spark, path).where(F.col("live") & (F.col("expires_at") > lib.as_of) & (F.col("action_id").cast("bigint") % 10 != 0))
    return last.select("user_id", _n("action_id"), "payload", actions.seconds_left(lib.as_of).cast("bigint").alias("seconds_left"))


def _rebuilt(lib: Library) -> DataFrame:
    return actions.rebuild(lib.chosen(), lib.conflicts(), lib.action_buckets(), lib.baseline(), lib.recorded_uris())


@query
def undo_unknown_buckets(lib: Library) -> DataFrame:
    return actions.unknown(lib.wanted(), lib.action_buckets())


@query
def undo_already_undone(lib: Library) -> DataFrame:
    return actions.already_undone(lib.wanted(), lib.action_buckets())


@query
def undo_missing_destinations(lib: Library) -> DataFrame:
    return actions.misplaced(lib.wanted(), lib.action_buckets(), lib.places())


@query
def undo_outcomes(lib: Library) -> DataFrame:
    return actions.outcomes(lib.undo_requests(), lib.live(), lib.action_buckets(), lib.places(), lib.chosen(), lib.conflicts(), lib.after_undo())


@query
def undo_conflicts(lib: Library) -> DataFrame:
    return lib.conflicts().select(*ACT, "playlist_id", "name", "expected", "actual", _joined("buckets"))


@query
def undo_snapshots(lib: Library) -> DataFrame:
    return actions.new_snapshots(lib.places(), lib.chosen(), lib.conflicts(), lib.undo_receipts()).select(*ACT, "playlist_id", "expected")


@classifying
def undo_rebuild(lib: Library) -> DataFrame:
    return _rebuilt(lib).select(*ACT, "playlist_id", _n("position"), "uri")


@classifying
def replace_lists(lib: Library) -> DataFrame:
    """All lists after an undo: those that are written hold what the undo leaves, maybe nothing."""
    now = lib.items().select("user_id", F.col("playlist_id").cast("string").alias("playlist_id"), (F.col("position") - 1).alias("position"), F.col("track.uri").alias("uri"))
    return pages.replace_items(now, actions.rewritten(lib.chosen(), lib.conflicts()), _rebuilt(lib).drop("action_id")).select(*LIST, _n("position"), "uri")


@query
def undo_transition(lib: Library) -> DataFrame:
    return lib.after_undo().select(*ACT, "bucket", "status")


@query
def undo_totals(lib: Library) -> DataFrame:
    return actions.undo_totals(lib.after_undo()).select(*ACT, _n("applied"), _n("undone"), _n("tracks_undone"))


@query
def undo_groups(lib: Library) -> DataFrame:
    return actions.groups(lib.places(), lib.action_buckets()).select(*ACT, _n("group_no"), "place", _n("at"), "bucket")


@query
def undone_bucket_names(lib: Library) -> DataFrame:
    return actions.undone_names(lib.after_undo()).select(*ACT, _joined("buckets"))


@classifying
def stored_lists(lib: Library) -> DataFrame:
    """A versioned store: all lists are put in, buckets are appended, an undo replaces and clears, some writers come too late."""
    kept = _committed(lib)
    return kept.items().select(F.col("user_id").cast("bigint").alias("user_id"), "playlist_id", "position", "uri")


@classifying
def stored_heads(lib: Library) -> DataFrame:
    return _committed(lib).heads().select(F.col("user_id").cast("bigint").alias("user_id"), "playlist_id", "snapshot", _n("n_items"))


def _committed(lib: Library) -> store.ListStore:
    kept = store.ListStore(lib.spark, _own_folder(lib))
    text = [F.col(k).cast("string").alias(k) for k in LIST]
    now = lib.items().select(*LIST, (F.col("position") - 1).alias("position"), F.col("track.uri").alias("uri"))
    kept.replace(lib.playlists().select(*text), now)
    seen = kept.heads(1).select(*LIST, F.when(F.col("playlist_id").cast("bigint") % 5 == 0, "stale").otherwise(F.col("snapshot")).alias("expected"))
    more = _appended(lib).select(*text, F.col("rank").alias("position"), F.col("track").alias("uri"))
    kept.append(more, seen)
    # an undo of direct runs: one late list voids its action
    lists = lib.chosen().where("run = 'direct'").select(*text, "action_id").distinct()
    expected = kept.heads(2).select(*LIST, F.when(F.col("playlist_id").cast("bigint") % 7 == 0, "stale").otherwise(F.col("snapshot")).alias("expected"))
    # rebuilt as if nothing had changed: the store itself tells who is late
    rows = actions.rebuild(lib.chosen().where("run = 'direct'"), lib.chosen().where("false"), lib.action_buckets(), lib.baseline(), lib.recorded_uris())
    kept.replace(lists.join(expected, LIST, "left"), rows.select(*text, "position", "uri"), ["user_id", "action_id"])
    return kept


# ---- landed pages ----


def _item_pages(lib: Library) -> tuple[DataFrame, DataFrame]:
    return chains.records(lib.item_lines(), schemas.ITEM_PAGE)


@query
def page_verdicts(lib: Library) -> DataFrame:
    return chains.verdicts(_item_pages(lib)[0]).select(*LIST, "n_pages", _n("n_repeated"), "n_items", "verdict")


@query
def broken_pages(lib: Library) -> DataFrame:
    return _item_pages(lib)[1]


@query
def scanned_items(lib: Library) -> DataFrame:
    """Items of the lists whose chains are whole, null items too."""
    rows = pages.items_of(chains.complete(tables.write(_item_pages(lib)[0])))
    return rows.select(*LIST, "position", F.col("track.id").alias("track_id"), F.size("track.artists").alias("n_artists"), F.coalesce(filters.sortable(F.col("track")), F.lit(False)).alias("sortable"))


@query
def scanned_liked(lib: Library) -> DataFrame:
    rows = pages.liked_of(chains.complete(tables.write(chains.records(lib.liked_lines(), schemas.LIKED_PAGE)[0])))
    return rows.where(filters.sortable(F.col("track"))).select("user_id", "playlist_id", "position", F.col("track.id").alias("track_id"))


@query
def scanned_headers(lib: Library) -> DataFrame:
    rows = pages.headers_of(chains.once(chains.records(lib.header_lines(), schemas.PLAYLIST_PAGE)[0]))
    return rows.select(*LIST, "ordinal", "name", "owner_id", "collaborative", "snapshot_id")


@query
def scanned_artists(lib: Library) -> DataFrame:
    return pages.artists_of(chains.records(lib.artist_lines(), schemas.ARTIST_BATCH)[0]).select("artist_id", _joined("genres"))


# ---- writes in batches, and counts kept up to date ----


@classifying
def write_progress(lib: Library) -> DataFrame:
    """How far the copies of lists have come, from the receipts of their batches: some writes failed, some were broken off."""
    matched = lib.matched()
    rows = tables.write(batches.cut(plan.safe_copy(matched, lib.source_assigned(), lib.buckets(), lib.items()), matched, 2))
    turn, second = (F.col("playlist_id") + F.col("user_id")) % 7, F.col("batch_no") == 1
    times = F.when(second & (turn == 1), 3).when(second & (turn == 2), 4).when((F.col("batch_no") > 1) & turn.isin(0, 2, 3) | (F.col("batch_no") > 0) & (turn == 4), 0).otherwise(1)
    tried = rows.select(*batches.BATCH, turn.alias("turn"), F.explode(F.slice(F.array(*(F.lit(i) for i in range(1, 5))), 1, times)).alias("attempt"))
    bad = second & ((turn == 0) | (turn == 2) | (turn == 3) | ((turn == 1) & (F.col("attempt") < 3)))
    receipts = tried.select(*batches.BATCH, "attempt", (~bad).alias("ok"), (bad & (turn != 0)).alias("limited"), F.lit(None).cast("bigint").alias("retry_after_ms"), F.concat(F.lit("b"), "batch_no").alias("snapshot"), F.when(bad, F.when(turn == 0, "broken").otherwise("limited")).alias("error"))
    return batches.progress(rows, receipts).select(*LIST, "n_batches", "done", "n_written", "status", "next_batch", _n("attempt"), "wait_ms", "snapshot", "error")


@classifying
def profile_upkeep(lib: Library) -> DataFrame:
    """Profiles after buckets were appended and first items left, from the profiles before and these changes."""
    before = lib.kept_assigned()
    held = lib.items().groupBy(*LIST).agg(F.count("*").alias("held"))
    more = lib.candidates().join(lib.matched().select("user_id", "bucket", "playlist_id"), ["user_id", "bucket"]).withColumnRenamed("position", "from")
    rank = F.row_number().over(Window.partitionBy(*LIST).orderBy("bucket_ordinal", "from"))
    added = tables.write(more.join(held, LIST).select(*LIST, (F.col("held") + rank).alias("position"), "bucket"))
    first = (F.col("playlist_id") % 3 == 0) & (F.col("position") == 1)
    now = lambda lists: before.where(~first).select(*LIST, "position", "bucket").unionByName(added).join(lists, LIST, "left_semi")
    after = upkeep.changed(upkeep.counted(before), added, before.where(first).select(*LIST, "position", "bucket"), now)
    return upkeep.profile(after).select(*LIST, "bucket", "n", _n("first_position"), F.round("share", 9).alias("share"))


# ---- long lists and many keywords ----


def _long_lists(lib: Library) -> DataFrame:
    """Every line item in one of a few long lists or many short ones, numbered; lists of over 5,000 items by chunks."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    name = F.when(F.col("l_orderkey") % 10 == 0, F.concat(F.lit("order "), "l_orderkey")).otherwise(F.concat(F.lit("all "), "l_returnflag"))
    return positions.number(lib.table("lineitem").select(name.alias("list"), *order), ["list"], order, most=5000)


@query
def long_list_positions(lib: Library) -> DataFrame:
    return _long_lists(lib).select("list", "position", "l_orderkey", "l_linenumber", "l_partkey")


@query
def long_list_segments(lib: Library) -> DataFrame:
    return positions.segments(_long_lists(lib), ["list"], "l_partkey", 100).select("list", "segment", _joined("values"))


@query
def keyword_matches(lib: Library) -> DataFrame:
    """Which pieces of part names and types stand in which names: thousands of keywords, met by grams."""
    parts = lib.table("part")
    pieces = F.array(F.substring("p_name", 2, 6), F.substring("p_type", 1, 4), F.substring("p_brand", -2, 2))
    met = keywords.matches(parts, parts.select(F.explode(pieces).alias("keyword")), "p_name")
    return met.groupBy("text").agg(F.count("*").alias("n"), F.min("keyword").alias("first"), F.max("keyword").alias("last"))


@query
def normalize_by_grams(lib: Library) -> DataFrame:
    return keywords.normalize(lib.artist_genres(), lib.rules()).select("genre", "bucket")


@query
def request_issues(lib: Library) -> DataFrame:
    rows = requests.with_issues(lib.requests())
    return rows.select("user_id", F.array_join(F.transform("issues", lambda x: F.concat_ws(": ", x["path"], x["message"])), "; ").alias("issues"))


@query
def request_defaults(lib: Library) -> DataFrame:
    return requests.with_issues(lib.requests()).where(F.size("issues") == 0).select("user_id", requests.write_mode().alias("write_mode"))


@query
def undo_request_gate(lib: Library) -> DataFrame:
    k = F.col("c_custkey")
    names = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("Pop"), F.lit(" Pop\u00a0"))).when(k % 5 == 2, F.array(F.lit(" \t"), F.lit("Pop"))).otherwise(F.array(F.lit("Pop"), F.col("c_mktsegment")))
    return lib.table("customer").select(k.alias("user_id"), names.alias("buckets")).select("user_id", actions.request_ok().alias("ok"))


def _profiles(lib: Library) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    images = F.when(k % 4 != 0, F.array(F.struct(F.concat(F.lit("img/"), k).alias("url")))).otherwise(F.array().cast("array<struct<url:string>>"))
    users = lib.table("customer").select(F.struct(k.alias("id"), F.when(k % 3 != 0, F.col("c_name")).alias("display_name"), images.alias("images")).alias("u"))
    new = users.select(filters.profile(F.col("u")).alias("p")).select("p.*", F.lit(None).cast("string").alias("country")).where("user_id % 2 = 0")
    stored = lib.table("customer").where(k % 5 != 0).select(k.alias("user_id"), F.lit("old").alias("display_name"), F.lit("old.png").alias("picture_url"), F.lit("XX").alias("country"))
    return stored, new


@query
def user_profile_upsert(lib: Library) -> DataFrame:
    return cache.upsert_profiles(*_profiles(lib), ("country",))


@query
def public_users(lib: Library) -> DataFrame:
    return filters.public_user(cache.upsert_profiles(*_profiles(lib), ("country",)))
