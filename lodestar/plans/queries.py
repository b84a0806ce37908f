"""The library's operators as queries over whole tables, with the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.collection import Collection
from lodestar.functions import vectors as vec
from lodestar.operators import changes, metadata, search, visibility
from lodestar.plans import fixtures as fx
from lodestar.sources.datasource import register
from lodestar.sources.files import Files, mounted, shared_dir
from lodestar.sources.log import CRASH_POINTS, Crash, crash_at
from lodestar.sources.manifest import Manifest
from lodestar.sources.memtable import Memtable
from lodestar.sources.segments import SegmentStore
from lodestar.types import METADATA, Metric, Mode, tagged_column, tagged_literal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
K = 10


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A folder for what a query writes, in the folder that the cluster shares."""
    return Files.fresh(shared_dir(spark), "lodestar-query")


def mounted_scratch(spark: SparkSession) -> str:
    """The same, made, for formats whose files are read and written without Spark."""
    folder = scratch(spark)
    Files(spark, folder).make_folder(folder)
    return mounted(folder)


# -- scores ----------------------------------------------------------------------------------------------------------

for _name, _column, _sql in (
    ("vec_dot", lambda q: vec.dot("values", q), fx.dot("v", "q")),
    ("vec_cosine", lambda q: vec.cosine("values", q), fx.cosine("v", "q")),
    ("vec_sq_euclidean", lambda q: vec.squared_euclidean("values", q), fx.squared("v", "q")),
    ("vec_norm", lambda q: vec.l2_norm("values"), fx.norm("v")),
):
    query(_name, f"WITH {fx.SCALED}, {fx.QUERY} SELECT id, {_sql} AS score FROM e, q0")(
        lambda spark, sf, column=_column: fx.scaled(spark, sf).select("id", column(fx.first_vector(spark, sf)).alias("score"))
    )


@query("vec_zero_cosine", f"WITH {fx.ZEROED}, {fx.QUERY} SELECT id, {fx.cosine('v', 'q')} AS score FROM e, q0")
def vec_zero_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return fx.zeroed(spark, sf).select("id", vec.cosine("values", fx.first_vector(spark, sf)).alias("score"))


@query("vec_dimension_check", f"WITH {fx.OPS} SELECT seq, coalesce(len(v) = 64, false) AS fits FROM o")
def vec_dimension_check(spark: SparkSession, sf: str) -> DataFrame:
    return fx.ops(spark, sf).select("seq", vec.has_dimensions("values", fx.DIMENSIONS).alias("fits"))


@query("metric_codec", "SELECT * FROM (VALUES ('cosine', 0, 'cosine'), ('dot_product', 1, 'dot_product'), ('euclidean', 2, 'euclidean')) t(metric, code, back)")
def metric_codec(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(m.value, m.code, Metric.from_code(m.code).value) for m in Metric], "metric string, code int, back string")


# -- search ----------------------------------------------------------------------------------------------------------


def _top(rows: str, metric: str, limit: str = f"WHERE rank <= {K}", extra: str = "", where: str = ", q0") -> str:
    return (
        f"WITH {rows}, {fx.QUERY}{extra}, r AS (SELECT id, {fx.score('q', 'v', metric)} AS score FROM e {where}) "
        f"SELECT CAST(rank AS INT) AS rank, id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM r) {limit}"
    )


def _search(rows: DataFrame, spark: SparkSession, sf: str, metric: Metric, k: int | None = K) -> DataFrame:
    return search.top_k(rows, fx.first_vector(spark, sf), k, fx.DIMENSIONS, metric)


@query("topk_cosine", _top(fx.SCALED, "cosine"))
def topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _search(fx.scaled(spark, sf), spark, sf, Metric.cosine)


@query("topk_dot", _top(fx.SCALED, "dot_product"))
def topk_dot(spark: SparkSession, sf: str) -> DataFrame:
    return _search(fx.scaled(spark, sf), spark, sf, Metric.dot_product)


@query("topk_euclidean", _top(fx.SCALED, "euclidean"))
def topk_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    return _search(fx.scaled(spark, sf), spark, sf, Metric.euclidean)


@query("topk_ties", _top(fx.TIED, "dot_product"))
def topk_ties(spark: SparkSession, sf: str) -> DataFrame:
    return _search(fx.tied(spark, sf), spark, sf, Metric.dot_product)


@query("topk_zero_vectors", _top(fx.ZEROED, "cosine"))
def topk_zero_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _search(fx.zeroed(spark, sf), spark, sf, Metric.cosine)


@query("topk_k_gt_n", _top(fx.SCALED, "dot_product", ""))
def topk_k_gt_n(spark: SparkSession, sf: str) -> DataFrame:
    """More asked for than there are rows: all of them, ranked by a range sort."""
    return _search(fx.scaled(spark, sf), spark, sf, Metric.dot_product, None)


@query("topk_full_sort", _top(fx.SCALED, "euclidean", ""))
def topk_full_sort(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked(search.scored(fx.scaled(spark, sf), fx.first_vector(spark, sf), fx.DIMENSIONS, Metric.euclidean))


_NONE = "SELECT CAST(0 AS INT) AS rank, CAST(0 AS BIGINT) AS id, CAST(0 AS FLOAT) AS score WHERE false"


@query("topk_k_zero", _NONE)
def topk_k_zero(spark: SparkSession, sf: str) -> DataFrame:
    return _search(fx.vectors(spark, sf), spark, sf, Metric.cosine, 0)


@query("topk_bad_dims", _NONE)
def topk_bad_dims(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(fx.vectors(spark, sf), fx.first_vector(spark, sf)[:-1], K, fx.DIMENSIONS)


def _batch_sql(metric: str) -> str:
    return (
        f"WITH {fx.SCALED}, r AS (SELECT a.id AS query_id, e.id, {fx.score('a.v', 'e.v', metric)} AS score FROM e a, e WHERE a.id % 100 = 0) "
        f"SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= {K}"
    )


for _metric in Metric:
    query(f"batch_topk_{_metric.value}", _batch_sql(_metric.value))(
        lambda spark, sf, metric=_metric: search.batch_top_k(
            fx.scaled(spark, sf), fx.scaled(spark, sf).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("values").alias("q")), K, fx.DIMENSIONS, metric
        )
    )


# -- filtered search -------------------------------------------------------------------------------------------------


def _filtered(spark: SparkSession, sf: str, *wanted: tuple, k: int | None = K) -> DataFrame:
    return search.filtered_top_k(fx.scaled(spark, sf), fx.metadata(spark, sf), wanted, fx.first_vector(spark, sf), k, fx.DIMENSIONS, Metric.dot_product)


def _filtered_sql(where: str) -> str:
    return _top(fx.SCALED, "dot_product", extra=f", {fx.META}", where=f"JOIN m USING (id), q0 WHERE {where}")


@query("filtered_single", _filtered_sql("lang = 'en'"))
def filtered_single(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, ("lang", "en"))


@query("filtered_and", _filtered_sql("lang = 'en' AND label = 3 AND long_doc"))
def filtered_and(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, ("lang", "en"), ("label", 3), ("long_doc", True))


@query("filtered_typed", _NONE)
def filtered_typed(spark: SparkSession, sf: str) -> DataFrame:
    """A label is an int64: the string "3" matches none."""
    return _filtered(spark, sf, ("label", "3"))


@query("filtered_missing", _NONE)
def filtered_missing(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, ("no such field", 1))


@query("filtered_empty_pred", _top(fx.SCALED, "dot_product"))
def filtered_empty_pred(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf)


@query("filtered_all", _filtered_sql("lang = 'de'").replace(f"WHERE rank <= {K}", ""))
def filtered_all(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, ("lang", "de"), k=None)


@query("postfilter_equiv", _filtered_sql("lang = 'en' AND long_doc"))
def postfilter_equiv(spark: SparkSession, sf: str) -> DataFrame:
    return search.post_filtered_top_k(fx.scaled(spark, sf), fx.metadata(spark, sf), [("lang", "en"), ("long_doc", True)], fx.first_vector(spark, sf), K, fx.DIMENSIONS, Metric.dot_product)


@query("indexed_topk", _filtered_sql("lang = 'en' AND long_doc"))
def indexed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the inverted index: intersected posting lists are the candidates."""
    found = metadata.lookup_all(metadata.build_index(fx.metadata(spark, sf)), [("lang", "en"), ("long_doc", True)])
    return search.candidates_top_k(fx.scaled(spark, sf), found, fx.first_vector(spark, sf), K, fx.DIMENSIONS, Metric.dot_product)


# -- metadata and index ----------------------------------------------------------------------------------------------


def _shown(index: DataFrame) -> DataFrame:
    """An index with its keys as text: doubles, which are halves of whole numbers, as their doubles."""
    v = F.col("value")
    payload = F.coalesce(v["i"].cast("string"), v["s"], v["b"].cast("string"), (v["d"] * 2).cast("bigint").cast("string"))
    return index.select("id", "field", v["t"].alias("kind"), payload.alias("payload"))


_INDEX = f"WITH {fx.META}, {fx.KEYS}"


@query("eq_index_build", f"{_INDEX} SELECT id, field, kind, payload FROM k")
def eq_index_build(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(metadata.build_index(fx.metadata(spark, sf)))


@query("eq_index_lookup", f"{_INDEX} SELECT id FROM k WHERE field = 'lang' AND kind = 'string' AND payload = 'fr'")
def eq_index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.lookup(metadata.build_index(fx.metadata(spark, sf)), "lang", "fr")


@query("eq_index_remove", f"{_INDEX} SELECT id, field, kind, payload FROM k WHERE id NOT IN (SELECT id FROM m WHERE label = 3)")
def eq_index_remove(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.metadata(spark, sf)
    return _shown(metadata.index_remove(metadata.build_index(rows), rows.where(metadata.matches("metadata", [("label", 3)]))))


@query(
    "eq_index_update",
    f"{_INDEX} SELECT id, field, kind, payload FROM k WHERE id NOT IN (SELECT id FROM m WHERE label = 3) UNION ALL SELECT id, 'label', 'string', 'three' FROM m WHERE label = 3",
)
def eq_index_update(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.metadata(spark, sf)
    old = rows.where(metadata.matches("metadata", [("label", 3)]))
    return _shown(metadata.index_update(metadata.build_index(rows), old, old.select("id", metadata.literal_map({"label": "three"}).alias("metadata"))))


@query("eq_index_size", f"{_INDEX} SELECT field, kind, payload, count(*) AS n FROM k GROUP BY ALL")
def eq_index_size(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(metadata.build_index(fx.metadata(spark, sf))).groupBy("field", "kind", "payload").agg(F.count("*").alias("n"))


@query(
    "typed_no_collision",
    "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'int64' ELSE 'string' END AS kind FROM embeddings WHERE label = 3",
)
def typed_no_collision(spark: SparkSession, sf: str) -> DataFrame:
    index = metadata.build_index(fx.mixed_types(spark, sf))
    number, text = metadata.lookup(index, "x", 3), metadata.lookup(index, "x", "3")
    return number.select("id", F.lit("int64").alias("kind")).unionByName(text.select("id", F.lit("string").alias("kind")))


@query("metadata_wrong_type", "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN CAST(label AS BIGINT) END AS x FROM embeddings")
def metadata_wrong_type(spark: SparkSession, sf: str) -> DataFrame:
    return fx.mixed_types(spark, sf).select("id", metadata.read_field("metadata", "x", "int64").alias("x"))


_LISTS = f"{_INDEX}, p AS (SELECT field, kind, payload, list_sort(list(DISTINCT id)) AS ids FROM k GROUP BY ALL)"


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    lists = metadata.postings(metadata.build_index(fx.metadata(spark, sf)))
    return _shown(lists.withColumn("id", F.col("ids"))).withColumnRenamed("id", "ids")


def _rows(lists: DataFrame) -> DataFrame:
    return lists.select("field", "kind", "payload", F.posexplode("ids").alias("at", "id"))


_LIST_ROWS = "SELECT field, kind, payload, CAST(unnest(range(0, len(ids))) AS INT) AS at, unnest(ids) AS id FROM p"


@query("posting_lists", f"{_LISTS} {_LIST_ROWS}")
def posting_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_postings(spark, sf))


@query("posting_insert", f"{_LISTS}, p2 AS (SELECT field, kind, payload, list_sort(list_distinct(list_append(ids, 7::BIGINT))) AS ids FROM p) {_LIST_ROWS.replace('FROM p', 'FROM p2')}")
def posting_insert(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_postings(spark, sf).withColumn("ids", metadata.posting_insert(F.col("ids"), F.lit(7).cast("bigint"))))


@query("posting_erase", f"{_LISTS}, p2 AS (SELECT field, kind, payload, list_filter(ids, lambda x: x <> 7) AS ids FROM p) {_LIST_ROWS.replace('FROM p', 'FROM p2')}")
def posting_erase(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_postings(spark, sf).withColumn("ids", metadata.posting_erase(F.col("ids"), F.lit(7).cast("bigint"))))


@query("posting_contains", f"{_LISTS} SELECT field, kind, payload, list_contains(ids, 7) AS has, len(ids) AS n, len(ids) = 0 AS is_empty FROM p")
def posting_contains(spark: SparkSession, sf: str) -> DataFrame:
    lists = _postings(spark, sf)
    return lists.select("field", "kind", "payload", metadata.posting_contains(F.col("ids"), F.lit(7).cast("bigint")).alias("has"), F.size("ids").cast("long").alias("n"), (F.size("ids") == 0).alias("is_empty"))


@query("posting_intersect", f"{_LISTS} SELECT a.payload, unnest(list_sort(list_intersect(a.ids, b.ids))) AS id FROM p a, p b WHERE a.field = 'label' AND b.field = 'lang' AND b.payload = 'en'")
def posting_intersect(spark: SparkSession, sf: str) -> DataFrame:
    lists = _postings(spark, sf)
    english = lists.where("field = 'lang' AND payload = 'en'").select(F.col("ids").alias("english"))
    labels = lists.where("field = 'label'")
    return labels.crossJoin(F.broadcast(english)).select("payload", F.explode(metadata.posting_intersect(F.col("ids"), F.col("english"))).alias("id"))


@query("posting_intersect_all", f"WITH {fx.META} SELECT id FROM m WHERE lang = 'en' AND label = 3 AND long_doc")
def posting_intersect_all(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.lookup_all(metadata.build_index(fx.metadata(spark, sf)), [("lang", "en"), ("label", 3), ("long_doc", True)])


@query("posting_intersect_none", "SELECT CAST(0 AS BIGINT) AS id WHERE false")
def posting_intersect_none(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.lookup_all(metadata.build_index(fx.metadata(spark, sf)), [])


# -- visibility ------------------------------------------------------------------------------------------------------

_LIVE = f"WITH {fx.ALL_VERSIONS}, {fx.NEWEST}"


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.versions(fx.segments(spark, sf), fx.pending(spark, sf))


@query("newest_wins", f"{_LIVE} SELECT id, v AS values FROM l")
def newest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.newest_wins(_versions(spark, sf))


@query("newest_wins_by_rank", f"{_LIVE} SELECT id, v AS values FROM l")
def newest_wins_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.newest_wins_by_rank(_versions(spark, sf))


@query("live_count", f"{_LIVE} SELECT count(*) AS n FROM l")
def live_count(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.live_count(_versions(spark, sf))


@query("live_scan", f"WITH {fx.VERSIONS} SELECT id, g AS generation FROM s WHERE NOT gone")
def live_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A scan that skips tombstones, without regard to versions."""
    return visibility.versions(fx.segments(spark, sf)).where("NOT is_deleted").select("id", "generation")


@query("point_get", f"{_LIVE} SELECT id, v AS values FROM l WHERE id = 21")
def point_get(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.point_get(_versions(spark, sf), 21)


@query("point_get_removed", f"{_LIVE} SELECT id, v AS values FROM l WHERE id = 7")
def point_get_removed(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.point_get(_versions(spark, sf), 7)


@query("tombstone_hides", f"{_LIVE} SELECT DISTINCT id FROM s WHERE id NOT IN (SELECT id FROM l)")
def tombstone_hides(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.newest(_versions(spark, sf)).where("is_deleted").select("id")


@query("compact_merge", f"WITH {fx.VERSIONS}, {fx.NEWEST} SELECT id, false AS is_deleted, v AS values FROM l")
def compact_merge(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.compacted(visibility.versions(fx.segments(spark, sf)))


@query("lsm_topk", _top(f"{fx.ALL_VERSIONS}, {fx.NEWEST}, e AS (SELECT id, v FROM l)", "dot_product"))
def lsm_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _search(visibility.newest_wins(_versions(spark, sf)), spark, sf, Metric.dot_product)


# -- changes ---------------------------------------------------------------------------------------------------------


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return changes.statuses(fx.ops(spark, sf), fx.DIMENSIONS)


@query("dml_status", f"WITH {fx.OPS} SELECT seq, op, id, status FROM j")
def dml_status(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("seq", "op", "id", "status")


@query(
    "dml_final_state",
    f"WITH {fx.OPS} SELECT id, op = 'remove' AS is_deleted, v AS values FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM j WHERE status = 'ok') WHERE r = 1",
)
def dml_final_state(spark: SparkSession, sf: str) -> DataFrame:
    return changes.final_versions(_judged(spark, sf))


@query(
    "dml_metadata_state",
    f"WITH {fx.OPS} SELECT id, CASE WHEN op = 'insert' THEN even END AS even FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM j WHERE status = 'ok' AND op <> 'update') WHERE r = 1",
)
def dml_metadata_state(spark: SparkSession, sf: str) -> DataFrame:
    return changes.final_metadata(_judged(spark, sf)).select("id", metadata.read_field("metadata", "even", "bool").alias("even"))


@query("dml_duplicate_ids", "SELECT vec_id AS id, count(*) AS n FROM (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) GROUP BY 1 HAVING count(*) > 1")
def dml_duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The uniqueness check of an id index, over segments."""
    first, second, _ = fx.segments(spark, sf)
    return first.select("id").unionByName(second.select("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


_REPLAY = f"""WITH {fx.OPS},
w AS (SELECT seq + 1 AS lsn, op, id, v FROM o WHERE v IS NULL OR len(v) = 64),
x AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY id ORDER BY lsn) <> 'remove', false) AS live FROM w),
y AS (SELECT id, last(op ORDER BY lsn) AS op, last(v ORDER BY lsn) FILTER (op = 'update' OR (op = 'insert' AND NOT live)) AS v FROM x GROUP BY id)"""


@query("wal_replay_state", f"{_REPLAY} SELECT id, op = 'remove' AS is_deleted, CASE WHEN op <> 'remove' THEN v END AS values FROM y")
def wal_replay_state(spark: SparkSession, sf: str) -> DataFrame:
    return changes.replayed(fx.log(spark, sf), fx.DIMENSIONS)


@query("wal_next_lsn", f"{_REPLAY} SELECT max(lsn) + 1 AS next_lsn FROM w")
def wal_next_lsn(spark: SparkSession, sf: str) -> DataFrame:
    return changes.next_lsn(fx.log(spark, sf))


@query("wal_stops_at_error", f"WITH {fx.OPS} SELECT min(seq) + 1 AS lsn FROM o WHERE v IS NOT NULL AND len(v) <> 64")
def wal_stops_at_error(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.ops(spark, sf).select((F.col("seq") + 1).alias("lsn"), F.when(F.col("op") == "remove", "delete").otherwise(F.col("op")).alias("op"), "id", "values")
    return changes.first_error(rows, fx.DIMENSIONS)


# -- storage ---------------------------------------------------------------------------------------------------------


def _written(spark: SparkSession, sf: str, compact: bool = False) -> SegmentStore:
    store = SegmentStore(spark, fx.DIMENSIONS)
    store.open(scratch(spark))
    for rows in fx.segments(spark, sf):
        store.write(rows)
    if compact:
        store.compact()
    return store


@query("memtable_flush_order", "SELECT id, rank() OVER (ORDER BY id) - 1 AS at FROM (SELECT vec_id AS id FROM embeddings)")
def memtable_flush_order(spark: SparkSession, sf: str) -> DataFrame:
    """A flushed segment holds its rows in order of the id, over all of its files; rows that share an id share the first one's place."""
    store = SegmentStore(spark, fx.DIMENSIONS)
    store.open(scratch(spark))
    store.write(fx.segments(spark, sf)[0].repartitionByRange(F.asc_nulls_last("id")))
    return store.positions(store.manifest.segments[0]).select("id", F.min("at").over(Window.partitionBy("id")).alias("at"))


@query("segment_roundtrip", f"WITH {fx.VERSIONS} SELECT id, g AS generation, gone AS is_deleted, v AS values FROM s")
def segment_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.versions(_written(spark, sf).segments("fail")).select("id", "generation", "is_deleted", "values")


@query("segment_compaction", f"WITH {fx.VERSIONS}, {fx.NEWEST} SELECT id, false AS is_deleted, v AS values FROM l")
def segment_compaction(spark: SparkSession, sf: str) -> DataFrame:
    store = _written(spark, sf, compact=True)
    assert store.manifest.segments == ["segment-000004.vec"], store.manifest.segments
    return store.segments("fail")[0]


@query("manifest_reopen", f"WITH {fx.VERSIONS}, {fx.NEWEST} SELECT id, v AS values FROM l")
def manifest_reopen(spark: SparkSession, sf: str) -> DataFrame:
    """Another store on the same folder sees what the manifest lists."""
    store = SegmentStore(spark, fx.DIMENSIONS)
    store.open(_written(spark, sf).folder)
    return store.visible()


@query("manifest_list", "SELECT * FROM (VALUES (0, 'segment-000001.vec'), (1, 'segment-000002.vec'), (2, 'segment-000003.vec')) t(position, segment_name)")
def manifest_list(spark: SparkSession, sf: str) -> DataFrame:
    store, again = _written(spark, sf), Manifest()
    again.load(Files(spark, store.folder), store.folder)
    return spark.createDataFrame(list(enumerate(again.segments)), "position int, segment_name string")


@query("batch_apply", f"WITH {fx.OPS} SELECT id, v AS values FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM j WHERE status = 'ok') WHERE r = 1 AND op <> 'remove'")
def batch_apply(spark: SparkSession, sf: str) -> DataFrame:
    """A collection after a batch of operations, from its segments."""
    found = Collection(spark, fx.DIMENSIONS, Metric.dot_product)
    found.open_lsm(scratch(spark))
    found.apply(fx.ops(spark, sf))
    return found.live()


_SLOTS = "SELECT CAST(rank() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS pos, vec_id AS id, vec_id % 7 = 0 AS is_deleted, embedding AS values FROM embeddings"


def _legacy(spark: SparkSession, sf: str) -> Collection:
    """A legacy collection: such a one lives on the driver, as its format is one file."""
    found = Collection(spark, fx.DIMENSIONS, Metric.dot_product, Mode.legacy)
    for row in fx.vectors(spark, sf).orderBy("id").toLocalIterator():
        found.insert(row["id"], list(row["values"]))
        if row["id"] % 7 == 0:
            found.remove(row["id"])
    return found


@query("snapshot_roundtrip", _SLOTS)
def snapshot_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    folder = mounted_scratch(spark)
    _legacy(spark, sf).save(f"{folder}/all.snapshot")
    again = Collection(spark, 1, Metric.cosine, Mode.legacy)
    again.load(f"{folder}/all.snapshot")
    return again.physical()


@query("checkpoint_recover", "SELECT vec_id AS id, embedding AS values FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT 7, embedding FROM embeddings WHERE vec_id = 7")
def checkpoint_recover(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot, then a log of what came after it: both are read again."""
    folder = mounted_scratch(spark)
    first = _legacy(spark, sf)
    first.enable_log(f"{folder}/log")
    first.checkpoint(f"{folder}/snapshot")
    back = fx.vectors(spark, sf).where("id = 7").first()
    if back:
        first.insert(7, list(back["values"]))
    again = Collection(spark, 1, Metric.cosine, Mode.legacy)
    again.open(f"{folder}/snapshot", f"{folder}/log")
    return again.live()


@query("binary_segment_roundtrip", "SELECT vec_id AS id, vec_id % 7 = 0 AS is_deleted, CASE WHEN vec_id % 7 <> 0 THEN embedding END AS values FROM embeddings")
def binary_segment_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of binary segment files, written by several tasks and read again; what it held before goes."""
    register(spark)
    folder = mounted_scratch(spark)
    rows = fx.vectors(spark, sf)
    gone = F.col("id") % 7 == 0
    writer = lambda df: df.write.format("lodestar-segment").option("dimensions", fx.DIMENSIONS).option("metric", Metric.cosine.code)
    writer(rows.select("id", F.lit(False).alias("is_deleted"), "values")).mode("append").save(folder)
    writer(rows.repartition(4, "id").select("id", gone.alias("is_deleted"), F.when(~gone, F.col("values")).alias("values"))).mode("overwrite").save(folder)
    return spark.read.format("lodestar-segment").load(folder)


# -- single operations, over all rows --------------------------------------------------------------------------------
# Legacy collections and memtables live on the driver, so their rows pass through it; a memtable is bounded by its threshold.

_LABEL = "CAST(label AS BIGINT) AS label"


@query(
    "set_metadata_batch",
    "SELECT vec_id AS id, CASE WHEN vec_id % 3 <> 0 THEN CAST(label AS BIGINT) END AS label, CASE WHEN vec_id % 3 = 0 THEN true END AS third FROM embeddings WHERE vec_id % 5 <> 0 AND (label IS NOT NULL OR vec_id % 3 = 0)",
)
def set_metadata_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Setting metadata replaces all of it; an empty map clears it."""
    rows = fx.table(spark, sf, "embeddings")
    none, nothing = F.lit(None).cast("array<float>"), metadata.typed_map({"x": tagged_column("bool", F.lit(None).cast("boolean"))}).cast(METADATA)
    ops = None
    for n, (op, every, told) in enumerate((
        ("insert", 1, metadata.typed_map({"label": tagged_column("int64", F.col("label").cast("long"))}).cast(METADATA)),
        ("set_metadata", 3, metadata.typed_map({"third": tagged_column("bool", F.lit(True))}).cast(METADATA)),
        ("set_metadata", 5, nothing),
    )):
        part = rows.where(F.col("vec_id") % every == 0).select(
            (F.lit(n * 1_000_000_000).cast("long") + F.col("vec_id")).alias("seq"), F.lit(op).alias("op"), F.col("vec_id").alias("id"), (F.col("embedding") if n == 0 else none).alias("values"), told.alias("metadata")
        )
        ops = part if ops is None else ops.unionByName(part)
    found = Collection(spark, fx.DIMENSIONS)
    found.open_lsm(scratch(spark))
    found.apply(ops)
    return found.metadata_table().select("id", metadata.read_field("metadata", "label", "int64").alias("label"), metadata.read_field("metadata", "third", "bool").alias("third"))


def _each(spark: SparkSession, sf: str) -> list[tuple[int, list[float], int | None]]:
    """Id, vector and label of all rows, in order of the id."""
    rows = fx.table(spark, sf, "embeddings").select("vec_id", "embedding", "label").orderBy("vec_id")
    return [(r["vec_id"], list(r["embedding"]), r["label"]) for r in rows.toLocalIterator()]


@query(
    "metadata_of_live_ids",
    f"SELECT vec_id AS id, vec_id % 7 <> 0 AS live, CASE WHEN vec_id % 7 <> 0 AND vec_id % 3 <> 0 THEN label END AS label, vec_id % 7 <> 0 AND vec_id % 3 = 0 AS third, vec_id % 7 = 0 AS missed FROM (SELECT vec_id, {_LABEL} FROM embeddings)",
)
def metadata_of_live_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata by single calls: inserted, replaced for every third, gone with every seventh, which then can't be set."""
    c, out = Collection(spark, fx.DIMENSIONS, mode=Mode.legacy), []
    for id, values, label in _each(spark, sf):
        c.insert(id, values, {} if label is None else {"label": int(label)})
        if id % 3 == 0:
            c.set_metadata(id, {"third": True})
        if id % 7 == 0:
            c.remove(id)
        told = c.get_metadata(id)
        out.append((id, told is not None, (told or {}).get("label"), (told or {}).get("third", False), c.set_metadata(id, told or {}).value == "not_found"))
    return spark.createDataFrame(out, "id bigint, live boolean, label bigint, third boolean, missed boolean")


@query(
    "legacy_update",
    "SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'not_found' WHEN vec_id % 11 = 0 THEN 'dimension_mismatch' ELSE 'ok' END AS status, CASE WHEN vec_id % 11 = 0 THEN embedding ELSE list_transform(embedding, lambda x: x * 2::FLOAT) END AS values "
    "FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'dimension_mismatch' ELSE 'not_found' END, NULL FROM embeddings WHERE vec_id % 7 = 0",
)
def legacy_update(spark: SparkSession, sf: str) -> DataFrame:
    """Updates of live and of removed rows, some too short; then what each id holds."""
    c, out = _legacy(spark, sf), []
    for id, values, _ in _each(spark, sf):
        status = c.update(id, [2 * x for x in (values[:-1] if id % 11 == 0 else values)])
        out.append((id, status.value, c.get(id)))
    return spark.createDataFrame(out, "id bigint, status string, values array<float>")


@query("legacy_positions", f"SELECT pos, id, is_deleted, values, (SELECT count(*) FROM embeddings) AS slots, (SELECT count(*) FROM embeddings WHERE vec_id % 7 <> 0) AS live, 64 AS dimensions FROM ({_SLOTS})")
def legacy_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Slot by slot: id, flag, vector; and the sizes."""
    c = _legacy(spark, sf)
    rows = [(p, c.id_at(p), c.is_deleted_at(p), c.values_at(p), c.physical_size(), c.size(), c.dimensions) for p in range(c.physical_size())]
    return spark.createDataFrame(rows, "pos bigint, id bigint, is_deleted boolean, values array<float>, slots bigint, live bigint, dimensions int")


_ABSENT = 1_000_000_000


@query("memtable_entries", f"SELECT vec_id AS id, vec_id % 7 = 0 AS is_deleted, vec_id % 7 = 0 AS removed, CASE WHEN vec_id % 7 <> 0 THEN embedding END AS values FROM embeddings UNION ALL SELECT {_ABSENT}, true, false, NULL")
def memtable_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A remove needs an entry, a tombstone does not."""
    table = Memtable(fx.DIMENSIONS, 1)
    for id, values, _ in _each(spark, sf):
        table.put(id, values)
    removed = {id for id in [*(i for i, _, _ in table if i % 7 == 0), _ABSENT] if table.remove(id).value == "ok"}
    table.tombstone(_ABSENT)
    return spark.createDataFrame([(i, *table.find(i)[:1], i in removed, table.get(i)) for i, _, _ in table], "id bigint, is_deleted boolean, removed boolean, values array<float>")


@query("store_put_remove", f"SELECT vec_id AS id, vec_id % 7 = 0 AS is_deleted, CASE WHEN vec_id % 7 <> 0 THEN embedding END AS values, 'ok' AS status FROM embeddings UNION ALL SELECT {_ABSENT}, true, NULL, 'ok'")
def store_put_remove(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and tombstones put into a store, and the segment that it flushes. To remove an id that was never there is ok."""
    rows = _each(spark, sf)
    store = SegmentStore(spark, fx.DIMENSIONS, flush_threshold_rows=len(rows) + 2)
    store.open(scratch(spark))
    for id, values, _ in rows:
        store.put(id, values)
    statuses = {store.remove(id) for id in [*(i for i, _, _ in rows if i % 7 == 0), _ABSENT]} | {store.flush()}
    return store.read(store.manifest.segments[0]).withColumn("status", F.lit(", ".join(sorted(s.value for s in statuses))))


@query("auto_flush", "SELECT vec_id AS id, false AS is_deleted, embedding AS values, 'segment-000001.vec' AS segments FROM embeddings")
def auto_flush(spark: SparkSession, sf: str) -> DataFrame:
    """The insert that fills the buffer writes it as a segment."""
    rows, folder = _each(spark, sf), scratch(spark)
    c = Collection(spark, fx.DIMENSIONS, flush_threshold_rows=max(1, len(rows)))
    c.open_lsm(folder)
    for id, values, _ in rows:
        c.insert(id, values)
    store = SegmentStore(spark, fx.DIMENSIONS)
    store.open(folder)
    return store.newest().withColumn("segments", F.lit(", ".join(c.segments)))


@query("facade_flush", "SELECT vec_id AS id, embedding AS values, 'segment-000001.vec' AS segments FROM embeddings")
def facade_flush(spark: SparkSession, sf: str) -> DataFrame:
    rows = _each(spark, sf)
    c = Collection(spark, fx.DIMENSIONS, flush_threshold_rows=len(rows) + 1)
    c.open_lsm(scratch(spark))
    for id, values, _ in rows:
        c.insert(id, values)
    assert c.segments == []
    c.flush()
    return c.live().withColumn("segments", F.lit(", ".join(c.segments)))


@query("facade_compact", f"WITH {fx.OPS} SELECT id, v AS values, 'segment-000003.vec' AS segments FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM j WHERE status = 'ok') WHERE r = 1 AND op <> 'remove'")
def facade_compact(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches make two segments, and compaction one of these."""
    c, ops = Collection(spark, fx.DIMENSIONS, Metric.dot_product), fx.ops(spark, sf)
    c.open_lsm(scratch(spark))
    for part in (ops.where("seq < 2000000000"), ops.where("seq >= 2000000000")):
        c.apply(part)
    assert len(c.segments) == 2, c.segments
    c.compact()
    return c.live().withColumn("segments", F.lit(", ".join(c.segments)))


@query("newest_rows_of_memtable", f"WITH {fx.VERSIONS}, {fx.NEWEST} SELECT id, CASE WHEN id % 2 = 0 THEN NULL ELSE v END AS values FROM (SELECT vec_id AS id FROM embeddings) LEFT JOIN l USING (id)")
def newest_rows_of_memtable(spark: SparkSession, sf: str) -> DataFrame:
    """Each id as a store shows it that has tombstones of even ids in its memtable, over three segments."""
    store = _written(spark, sf)
    rows = _each(spark, sf)
    store.memtable.flush_threshold_rows = len(rows) + 1
    for id, _, _ in rows:
        if id % 2 == 0:
            store.remove(id)
    shown = store.visible(store.memtable.frame(spark))
    return fx.vectors(spark, sf).select("id").join(shown, "id", "left")


@query(
    "crash_recovery",
    "SELECT point, CAST(n - lost AS BIGINT) AS n FROM (SELECT count(*) AS n FROM embeddings), (VALUES ('before_log_append', 1), ('after_log_append_before_flush', 1), ('after_log_flush', 0), ('after_memory_apply', 0), ('after_checkpoint_snapshot', 0), ('after_checkpoint_before_truncate', 0)) t(point, lost)",
)
def crash_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that are there again after a crash at each point: an operation is logged, and on disk, before it changes anything."""
    rows, out = _each(spark, sf), []
    for point in CRASH_POINTS:
        folder = mounted_scratch(spark)
        c = Collection(spark, fx.DIMENSIONS, mode=Mode.legacy)
        for id, values, _ in rows[:-1]:
            c.insert(id, values)
        c.enable_log(f"{folder}/log")
        c.checkpoint(f"{folder}/snapshot")
        c._crash = crash_at(point)
        try:
            c.insert(rows[-1][0], rows[-1][1])
            c.checkpoint(f"{folder}/snapshot")
        except Crash:
            pass
        again = Collection(spark, fx.DIMENSIONS, mode=Mode.legacy)
        again.open(f"{folder}/snapshot", f"{folder}/log")
        out.append((point, again.size()))
    return spark.createDataFrame(out, "point string, n bigint")


@query("typed_literals", "SELECT * FROM (VALUES ('int64', '42'), ('double', '42.0'), ('string', '42'), ('bool', 'true')) t(kind, payload)")
def typed_literals(spark: SparkSession, sf: str) -> DataFrame:
    values = F.array(*[tagged_literal(v) for v in (42, 42.0, "42", True)])
    rows = spark.range(1).select(F.explode(values).alias("v")).distinct()
    return rows.select(F.col("v.t").alias("kind"), F.coalesce(F.col("v.i").cast("string"), F.col("v.d").cast("string"), F.col("v.s"), F.col("v.b").cast("string")).alias("payload"))
