"""Registered queries of the record engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import predicates as P
from ..operators.ordering import columns
from ..functions.values import POS
from ..sources.store import Store, with_positions
from .engines import Facade, FilterEngine, Result, SearchEngine, SortEngine

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose unique long key stands for row order: positions that need not be contiguous need no job."""
    return table(spark, sf_dir, name).withColumn(POS, F.col(key))


def engine(cls, frame: DataFrame, **options):
    """An engine over rows with positions, without a count."""
    store = Store()
    store.frame, store.count = frame, None
    return cls(store=store, **options)


def plain(result: Result) -> DataFrame:
    """A result as a set of rows."""
    return result.rows.drop(POS)


def ranked(result: Result, key: str) -> DataFrame:
    """The key and each row's place, from 1, which shows an order to an unordered comparison."""
    placed, _ = with_positions(result.rows, order=columns(result.order))
    return placed.select(key, (F.col(POS) + 1).alias("place"))


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = engine(FilterEngine, by_key(spark, sf_dir, "orders", "o_orderkey"))
    found = orders.filter([{"field": "o_orderstatus", "values": ["F", "O"]}, {"field": "o_orderpriority", "exclude": ["5-LOW"]}])
    return engine(SortEngine, found.rows).sort([{"field": "o_totalprice", "direction": "desc"}]).frame()


ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
PART = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"


def _filtered(spark, sf_dir, name, key, *criteria, change=None):
    frame = by_key(spark, sf_dir, name, key)
    return plain(engine(FilterEngine, change(frame) if change else frame).filter(list(criteria)))


def _with_nulls(frame: DataFrame) -> DataFrame:
    return frame.withColumn("size", F.when(F.col("p_size") % 7 != 0, F.col("p_size")))


_NULLS = "(select *, case when p_size % 7 <> 0 then p_size end as size from part)"


@query(f"select {ORDERS} from orders where o_orderstatus in ('F', 'O')")
def filter_in(spark, sf_dir):
    return _filtered(spark, sf_dir, "orders", "o_orderkey", {"field": "o_orderstatus", "values": ["F", "O"]})


@query(f"select * from {_NULLS} where size is null or size not in (1, 2, 3)")
def filter_exclude_keeps_null(spark, sf_dir):
    return _filtered(spark, sf_dir, "part", "p_partkey", {"field": "size", "exclude": [1, 2, 3]}, change=_with_nulls)


@query(f"select {PART} from part where p_size in (1, 3)")
def filter_in_exclude_same_field(spark, sf_dir):
    return _filtered(spark, sf_dir, "part", "p_partkey", {"field": "p_size", "values": [1, 2, 3], "exclude": [2]})


@query(f"select {ORDERS} from orders where o_orderstatus in ('F') and o_orderpriority in ('1-URGENT', '2-HIGH')")
def filter_multi_field(spark, sf_dir):
    return _filtered(spark, sf_dir, "orders", "o_orderkey", {"field": "o_orderstatus", "values": ["F"]}, {"field": "o_orderpriority", "values": ["1-URGENT", "2-HIGH"]})


@query(f"select {PART} from part where p_size in (2, 3) and p_size not in (3)")
def filter_same_field_merge(spark, sf_dir):
    return _filtered(spark, sf_dir, "part", "p_partkey", {"field": "p_size", "values": [1, 2, 3]}, {"field": "p_size", "values": [2, 3, 4]}, {"field": "p_size", "exclude": [3]})


@query(f"select {PART} from part where false")
def filter_unsatisfiable(spark, sf_dir):
    return _filtered(spark, sf_dir, "part", "p_partkey", {"field": "p_size", "values": []})


@query(f"select {PART} from part")
def filter_empty_criteria(spark, sf_dir):
    return _filtered(spark, sf_dir, "part", "p_partkey")


@query(f"select * from {_NULLS} where size in (1, 2) or size is null")
def filter_values_null(spark, sf_dir):
    return _filtered(spark, sf_dir, "part", "p_partkey", {"field": "size", "values": [1, 2, None]}, change=_with_nulls)


@query(f"select * from {_NULLS} where size is not null and size not in (1, 2)")
def filter_exclude_null(spark, sf_dir):
    return _filtered(spark, sf_dir, "part", "p_partkey", {"field": "size", "exclude": [1, 2, None]}, change=_with_nulls)


@query(f"select {PART} from part where p_size in (5)")
def filter_strict_types(spark, sf_dir):
    return _filtered(spark, sf_dir, "part", "p_partkey", {"field": "p_size", "values": ["1", True, 5.0, 2.5, "abc"]})


@query(f"select {PART} from part where false")
def filter_unknown_field(spark, sf_dir):
    return _filtered(spark, sf_dir, "part", "p_partkey", {"field": "no_such_field", "values": [1]}, {"field": "nor.this", "exclude": [1]})


@query(f"select {PART} from part where p_size in (1, 5)")
def filter_float_column(spark, sf_dir):
    return _filtered(spark, sf_dir, "part", "p_partkey", {"field": "tenth", "values": [0.1, 0.5]}, change=lambda part: part.withColumn("tenth", (F.col("p_size") / 10).cast("float"))).drop("tenth")


@query("select label, count(*) as n from embeddings where label not in (0) or label is null group by label")
def filter_embeddings_label(spark, sf_dir):
    return _filtered(spark, sf_dir, "embeddings", "vec_id", {"field": "label", "exclude": [0]}).groupBy("label").agg(F.count("*").alias("n"))


def _nested_orders(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_linestatus", "l_linenumber")).alias("lines"))
    return by_key(spark, sf_dir, "orders", "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def _nested(spark, sf_dir, *criteria):
    orders = engine(FilterEngine, _nested_orders(spark, sf_dir), nested_fields=["lines.l_returnflag", "lines.l_linestatus"])
    return orders.filter(list(criteria)).rows.select("o_orderkey")


def _line(test: str) -> str:
    return f"exists (select 1 from lineitem where l_orderkey = o_orderkey and {test})"


@query(f"select o_orderkey from orders where {_line("l_returnflag in ('R')")}")
def nested_in(spark, sf_dir):
    return _nested(spark, sf_dir, {"field": "lines.l_returnflag", "values": ["R"]})


@query(f"select o_orderkey from orders where not {_line("l_returnflag in ('R')")}")
def nested_exclude(spark, sf_dir):
    return _nested(spark, sf_dir, {"field": "lines.l_returnflag", "exclude": ["R"]})


@query(f"select o_orderkey from orders where {_line("l_returnflag in ('A')")} and not {_line("l_returnflag in ('R')")}")
def nested_in_exclude(spark, sf_dir):
    return _nested(spark, sf_dir, {"field": "lines.l_returnflag", "values": ["A"], "exclude": ["R"]})


@query(f"select o_orderkey from orders where {_line("l_returnflag in ('A')")} and {_line("l_linestatus in ('O')")}")
def nested_two_paths(spark, sf_dir):
    return _nested(spark, sf_dir, {"field": "lines.l_returnflag", "values": ["A"]}, {"field": "lines.l_linestatus", "values": ["O"]})


def _search(spark, sf_dir, name, key, *args, fields=(), gram_index=False, **window):
    return engine(SearchEngine, by_key(spark, sf_dir, name, key), fields=fields, silent=True, gram_index=gram_index).search(*args, **window)


_FIELDS = ["p_name", "p_brand", "p_type"]
_HITS = "(select *, case when contains(lower(p_name), 're') then 0 when contains(lower(p_brand), 're') then 1 when contains(lower(p_type), 're') then 2 end as hit from part)"


@query(f"select {PART} from part where contains(lower(p_name), 're')")
def search_field(spark, sf_dir):
    return plain(_search(spark, sf_dir, "part", "p_partkey", "p_name", "  RE ", fields=_FIELDS))


@query(f"select p_partkey, row_number() over (order by hit, p_partkey) as place from {_HITS} where hit is not null")
def search_all_fields(spark, sf_dir):
    return ranked(_search(spark, sf_dir, "part", "p_partkey", "re", fields=_FIELDS), "p_partkey")


@query(f"select p_partkey from {_HITS} where hit is not null order by hit, p_partkey limit 10 offset 20")
def search_all_fields_page(spark, sf_dir):
    return _search(spark, sf_dir, "part", "p_partkey", "re", fields=_FIELDS, limit=10, offset=20).frame().select("p_partkey")


@query(f"select {PART} from part where contains(lower(p_name), 're') or contains(lower(p_brand), 're') or contains(lower(p_type), 're')")
def search_default_fields(spark, sf_dir):
    return plain(_search(spark, sf_dir, "part", "p_partkey", "re"))


@query(f"select {PART} from part")
def search_short_query(spark, sf_dir):
    return plain(_search(spark, sf_dir, "part", "p_partkey", "   ", fields=_FIELDS))


@query(f"select {PART} from part where false")
def search_limit_zero(spark, sf_dir):
    return plain(_search(spark, sf_dir, "part", "p_partkey", "re", fields=_FIELDS, limit=0))


@query(f"select {PART} from part where false")
def search_unconfigured_field(spark, sf_dir):
    return plain(_search(spark, sf_dir, "part", "p_partkey", "p_type", "re", fields=["p_name"]))


@query("select doc_id from documents where contains(lower(text), 'é')")
def search_documents_utf8(spark, sf_dir):
    return plain(_search(spark, sf_dir, "documents", "doc_id", "text", "É", fields=["text"])).select("doc_id")


@query("select page_id from pages where contains(lower(html), '<title>') and contains(lower(url), 'http')")
def search_pages(spark, sf_dir):
    pages = engine(SearchEngine, by_key(spark, sf_dir, "pages", "page_id"), fields=["html", "url"])
    return plain(engine(SearchEngine, pages.search("html", "<title>").rows, fields=["url"]).search("url", "HTTP")).select("page_id")


@query("select distinct conv_id from conversations where contains(lower(text), 'the')")
def search_nested(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    return plain(engine(SearchEngine, turns.withColumn(POS, F.col("conv_id")), nested_fields=["turns.text"]).search("turns.text", "The")).select("conv_id")


@query(f"select {PART} from part where contains(lower(p_name), 're') and contains(lower(p_name), 'red')")
def search_narrowing(spark, sf_dir):
    part = engine(SearchEngine, by_key(spark, sf_dir, "part", "p_partkey"), fields=_FIELDS, filter_by_previous_result=True)
    part.search("p_name", "re")
    return plain(part.search("p_name", "red"))


@query(f"select {PART} from part where contains(lower(p_name), 'ma') and contains(lower(p_type), 'small')")
def search_narrowing_across_fields(spark, sf_dir):
    part = engine(SearchEngine, by_key(spark, sf_dir, "part", "p_partkey"), fields=_FIELDS, filter_by_previous_result=True)
    part.search("p_name", "ma")
    return plain(part.search("p_type", "small"))


@query(f"select {PART} from part where contains(lower(p_name), 're')")
def search_gram_index_two_letters(spark, sf_dir):
    return plain(_search(spark, sf_dir, "part", "p_partkey", "p_name", "RE", fields=_FIELDS, gram_index=True))


def _sorted(spark, sf_dir, name, key, by, fields=()):
    return ranked(engine(SortEngine, by_key(spark, sf_dir, name, key), fields=fields).sort(by), key)


@query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as place from orders")
def sort_asc(spark, sf_dir):
    return _sorted(spark, sf_dir, "orders", "o_orderkey", [{"field": "o_totalprice"}])


@query("select p_partkey, row_number() over (order by p_size desc, p_partkey desc) as place from part")
def sort_desc_ties(spark, sf_dir):
    return _sorted(spark, sf_dir, "part", "p_partkey", [{"field": "p_size", "direction": "desc"}], ["p_size"])


@query("select p_partkey, row_number() over (order by p_brand desc nulls first, p_partkey) as place from part")
def sort_desc_unconfigured(spark, sf_dir):
    return _sorted(spark, sf_dir, "part", "p_partkey", [{"field": "p_brand", "direction": "desc"}])


@query("select p_partkey, row_number() over (order by p_brand, p_size desc, p_partkey) as place from part")
def sort_multi(spark, sf_dir):
    return _sorted(spark, sf_dir, "part", "p_partkey", [{"field": "p_brand"}, {"field": "p_size", "direction": "desc"}])


@query("select p_partkey, row_number() over (order by p_brand desc, p_size, p_partkey desc) as place from part")
def sort_multi_configured(spark, sf_dir):
    return _sorted(spark, sf_dir, "part", "p_partkey", [{"field": "p_brand", "direction": "desc"}, {"field": "p_size"}], ["p_brand"])


@query(f"select p_partkey, row_number() over (order by coalesce(size, 0), p_partkey) as place from {_NULLS}")
def sort_numeric_null_as_zero(spark, sf_dir):
    return ranked(engine(SortEngine, _with_nulls(by_key(spark, sf_dir, "part", "p_partkey"))).sort([{"field": "size"}]), "p_partkey")


@query("select event_id, user_id, value from events where event_type in ('click', 'view') order by value desc, event_id desc limit 100")
def sort_top_events(spark, sf_dir):
    events = engine(FilterEngine, by_key(spark, sf_dir, "events", "event_id")).filter([{"field": "event_type", "values": ["click", "view"]}])
    return engine(SortEngine, events.rows).sort([{"field": "value", "direction": "desc"}]).frame().limit(100).select("event_id", "user_id", "value")


def _store(spark, sf_dir, name, keys) -> Store:
    return Store(table(spark, sf_dir, name), keys)


@query("select n_nationkey, n_name, n_regionkey, n_nationkey as place from nation union all select 100, 'ATLANTIS', 0, 25 union all select 101, 'LEMURIA', 1, 26")
def mutate_add(spark, sf_dir):
    store = _store(spark, sf_dir, "nation", ["n_nationkey"])
    store.add([{"n_nationkey": 100, "n_name": "ATLANTIS", "n_regionkey": 0}, {"n_nationkey": 101, "n_name": "LEMURIA", "n_regionkey": 1}])
    return store.frame.withColumnRenamed(POS, "place")


@query("select n_nationkey, case when n_nationkey = 7 then 'RENAMED' else n_name end as n_name, case when n_nationkey = 7 then 4 else n_regionkey end as n_regionkey from nation")
def mutate_update(spark, sf_dir):
    store = _store(spark, sf_dir, "nation", ["n_nationkey"])
    store.update("n_nationkey", {"n_nationkey": 7, "n_name": "RENAMED", "n_regionkey": 4})
    return store.rows()


@query("select n_nationkey, n_name, n_regionkey, case when n_nationkey = 24 then 3 else n_nationkey end as place from nation where n_nationkey <> 3")
def mutate_delete_one_position(spark, sf_dir):
    store = _store(spark, sf_dir, "nation", ["n_nationkey"])
    store.delete("n_nationkey", 3)
    return store.frame.withColumnRenamed(POS, "place")


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier where s_suppkey not in (1, 5, 9, 7)")
def mutate_delete_many(spark, sf_dir):
    store = _store(spark, sf_dir, "supplier", ["s_suppkey"])
    store.delete("s_suppkey", [1, 5, 9, 5, 7, -1])
    return store.rows()


@query("select s_suppkey, case s_suppkey when n - 1 then 1 when n - 2 then 5 when n - 3 then 9 when n - 4 then 7 else s_suppkey end as place from supplier, (select count(*) as n from supplier) where s_suppkey not in (1, 5, 9, 7)")
def mutate_delete_many_positions(spark, sf_dir):
    store = _store(spark, sf_dir, "supplier", ["s_suppkey"])
    store.delete("s_suppkey", [1, 5, 9, 5, 7, -1])
    return store.frame.select("s_suppkey", F.col(POS).alias("place"))


@query("select r_regionkey, r_name from region")
def mutate_replace(spark, sf_dir):
    store = _store(spark, sf_dir, "nation", ["n_nationkey"])
    store.clear()
    store.replace(table(spark, sf_dir, "region"), ["r_regionkey"])
    return store.rows()


def _sequence(spark, sf_dir, fields, *steps):
    found = engine(FilterEngine, by_key(spark, sf_dir, "orders", "o_orderkey"), fields=fields, filter_by_previous_result=True)
    for criteria in steps:
        out = found.filter(criteria)
    return plain(out)


@query(f"select {ORDERS} from orders where false")
def filter_seq_widen(spark, sf_dir):
    return _sequence(spark, sf_dir, [], [{"field": "o_orderstatus", "values": ["F"]}], [{"field": "o_orderstatus", "values": ["F", "O"]}])


@query(f"select {ORDERS} from orders where o_orderstatus in ('F')")
def filter_seq_back(spark, sf_dir):
    one = {"field": "o_orderstatus", "values": ["F"]}
    return _sequence(spark, sf_dir, [], [one, {"field": "o_orderpriority", "values": ["5-LOW"]}], [one])


@query(f"select {ORDERS} from orders where o_orderkey not in (1, 4, 5)")
def filter_seq_exclude_grow(spark, sf_dir):
    return _sequence(spark, sf_dir, ["o_orderkey"], [{"field": "o_orderkey", "exclude": [1, 4]}], [{"field": "o_orderkey", "exclude": [1, 4, 5]}])


def _facade(spark, sf_dir, **options) -> Facade:
    facade = Facade(search={"fields": _FIELDS, "silent": True}, sort={"fields": ["p_size"]}, **options)
    facade.store.frame, facade.store.count = by_key(spark, sf_dir, "part", "p_partkey"), None
    return facade


@query("select p_partkey, row_number() over (order by p_retailprice desc, p_partkey desc) as place from part where contains(lower(p_name), 're') and p_size in (1, 2, 3, 4, 5)")
def facade_pipeline(spark, sf_dir):
    return ranked(_facade(spark, sf_dir).search("p_name", "re").filter([{"field": "p_size", "values": [1, 2, 3, 4, 5]}]).sort([{"field": "p_retailprice", "direction": "desc"}]), "p_partkey")


@query(f"select {PART} from part where contains(lower(p_name), 're') and p_size not in (1, 2)")
def facade_previous_result(spark, sf_dir):
    facade = _facade(spark, sf_dir, filter_by_previous_result=True)
    facade.search("p_name", "re")
    return plain(facade.filter([{"field": "p_size", "exclude": [1, 2]}]))


@query(f"select {PART} from part where contains(lower(p_name), 'red')")
def search_gram_table(spark, sf_dir):
    from ..operators import text as X

    part = by_key(spark, sf_dir, "part", "p_partkey")
    near = part.join(X.gram_candidates(X.grams(part, "p_name"), "red"), POS, "left_semi")
    return near.where(X.matches(near, "p_name", "red")).drop(POS)
