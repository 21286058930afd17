"""The registered queries of the table engine and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgrid import over, sharded
from strandgrid.functions import signatures, text
from strandgrid.functions.vector import squared_distance
from strandgrid.operators import writes
from strandgrid.operators import aggregates as agg
from strandgrid.plans.errors import QueryError
from strandgrid.plans.expr import field as f
from strandgrid.plans.query import Query
from strandgrid.plans.schema import TableSchema, default_of, evolved, shaped
from strandgrid.sources.access import Users
from strandgrid.sources.files import scratch, temporary
from strandgrid.sources.queues import Queues
from strandgrid.sources.store import Store
from strandgrid.sources.tables import partition, place, shard_of
from strandgrid.streaming.sinks import save_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "documents": "doc_id", "embeddings": "vec_id", "events": "event_id", "nation": "n_nationkey", "lineitem": "l_orderkey"}
KNOWN = {"documents": {"search": {"text": "words"}}, "embeddings": {"vectors": {"embedding"}}}
SHARDS = 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> Query:
    return over(read(spark, sf_dir, name), KEYS[name], **KNOWN.get(name, {}))


def query(sql: str | None = None):
    """Register a query over (t, d): t(name) is a Query on a table, d(name) its DataFrame."""

    def put(make):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(lambda n: table(spark, sf_dir, n), lambda n: read(spark, sf_dir, n))
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return put


# --- flagship -----------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
          WHERE o_totalprice > 1000 AND lower(o_orderpriority) = '1-urgent'
          ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 100""")
def flagship(t, d):
    q = t("orders").where((f("o_totalprice") > 1000.0) & (f("o_orderpriority") == "1-urgent"))
    return q.order_by_descending("o_totalprice").take(100).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


# --- comparisons --------------------------------------------------------------------------------------------------

LINE = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE "


def lines(t, node):
    return t("lineitem").where(node).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query(LINE + "l_linenumber = 3")
def where_eq(t, d):
    return lines(t, f("l_linenumber") == 3)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def where_eq_ci_string(t, d):
    return t("customer").where(f("c_mktsegment") == "bUiLdInG").select("c_custkey", "c_mktsegment")


@query(LINE + "l_quantity < 10")
def where_lt(t, d):
    return lines(t, f("l_quantity") < 10.0)


@query(LINE + "l_quantity <= 10")
def where_le(t, d):
    return lines(t, f("l_quantity") <= 10.0)


@query(LINE + "l_quantity > 40")
def where_gt(t, d):
    return lines(t, f("l_quantity") > 40.0)


@query(LINE + "l_quantity >= 40")
def where_ge(t, d):
    return lines(t, f("l_quantity") >= 40.0)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-15 00:00:00'")
def where_lt_date(t, d):
    return t("orders").where(f("o_orderdate") < dt.datetime(1997, 6, 15)).select("o_orderkey", "o_orderdate")


@query(LINE + "(l_quantity > 30 AND l_linenumber = 2) OR (l_quantity < 5 AND l_linenumber <> 1)")
def where_and_or(t, d):
    return lines(t, ((f("l_quantity") > 30.0) & (f("l_linenumber") == 2)) | ((f("l_quantity") < 5.0) & (f("l_linenumber") != 1)))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <> -994.28 AND c_acctbal < 0")
def where_ne_negative(t, d):
    return t("customer").where(f("c_acctbal") != -994.28).where(f("c_acctbal") < 0.0).select("c_custkey", "c_acctbal")


NULLED = "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, nullif(c_nationkey, 3) AS nat, c_acctbal FROM customer"


def nulled(d):
    df = d("customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.nullif("c_nationkey", F.lit(3)).alias("nat"), "c_acctbal")
    return over(df, "c_custkey")


@query(f"SELECT c_custkey, seg FROM ({NULLED}) WHERE lower(seg) IS DISTINCT FROM 'machinery'")
def where_ne_keeps_null(t, d):
    return nulled(d).where(f("seg") != "Machinery").select("c_custkey", "seg")


@query(f"SELECT c_custkey, nat FROM ({NULLED}) WHERE nat IS DISTINCT FROM 5")
def where_ne_int_keeps_null(t, d):
    return nulled(d).where(f("nat") != 5).select("c_custkey", "nat")


@query(f"SELECT c_custkey FROM ({NULLED}) WHERE nat IS NULL")
def where_eq_null(t, d):
    return nulled(d).where(f("nat") == None).select("c_custkey")  # noqa: E711


@query(f"SELECT c_custkey, seg FROM ({NULLED}) WHERE seg IS NOT NULL")
def where_ne_null(t, d):
    return nulled(d).where(f("seg") != None).select("c_custkey", "seg")  # noqa: E711


@query(f"SELECT c_custkey FROM ({NULLED}) WHERE seg IS NULL")
def empty_string_is_null(t, d):
    df = d("customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("").alias("seg"))
    return over(df, "c_custkey").where(f("seg") == "").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderdate < TIMESTAMP '1996-01-01' AND lower(o_orderstatus) = 'o'")
def multiple_where(t, d):
    return t("orders").where(f("o_totalprice") > 100000.0).where(f("o_orderdate") < dt.datetime(1996, 1, 1)).where(f("o_orderstatus") == "o").get_ids()


# --- between ------------------------------------------------------------------------------------------------------


def _between(boundaries):
    return lambda t, d: t("lineitem").between("l_quantity", 10.0, 20.0, boundaries).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


for _name, _mode, _low, _high in (("between_ii", "both_inclusive", ">=", "<="), ("between_ie", "from_inclusive", ">=", "<"), ("between_ei", "to_inclusive", ">", "<="), ("between_ee", "both_exclusive", ">", "<")):
    _made = _between(_mode)
    _made.__name__ = _name
    query(LINE + f"l_quantity {_low} 10 AND l_quantity {_high} 20")(_made)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def between_date(t, d):
    return t("orders").between("o_orderdate", dt.datetime(1996, 1, 1), dt.datetime(1997, 1, 1), "from_inclusive").select("o_orderkey", "o_orderdate")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN -500 AND -10.5")
def between_negative(t, d):
    return t("customer").between("c_acctbal", -500.0, -10.5).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderdate > TIMESTAMP '1994-05-01' AND o_orderdate <= TIMESTAMP '1997-05-01'")
def multiple_between(t, d):
    return t("orders").between("o_totalprice", 1000.0, 200000.0).between("o_orderdate", dt.datetime(1994, 5, 1), dt.datetime(1997, 5, 1), "to_inclusive").get_ids()


# --- membership ---------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 7, 49)")
def intersect_int(t, d):
    return t("part").intersect("p_size", {1, 5, 7, 49}).select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '5-low')")
def intersect_string_ci(t, d):
    return t("orders").intersect("o_orderpriority", ["1-Urgent", "5-LOW"]).select("o_orderkey", "o_orderpriority")


@query(f"SELECT c_custkey, seg FROM ({NULLED}) WHERE seg IS NULL OR lower(seg) = 'household'")
def intersect_with_null(t, d):
    return nulled(d).intersect("seg", [None, "household"]).select("c_custkey", "seg")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_join_via_ids(t, d):
    return t("orders").intersect("o_custkey", t("customer").where(f("c_acctbal") > 5000.0).get_ids()).get_ids()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 3 = 1 AND o_custkey < 9000")
def intersect_large_semi(t, d):
    return t("orders").intersect("o_custkey", range(1, 9000, 3)).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12) AND lower(o_orderstatus) IN ('o', 'f')")
def multiple_intersect(t, d):
    return t("orders").intersect("o_custkey", range(1, 13)).intersect("o_orderstatus", ["O", "F"]).get_ids()


# --- or -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 300000 OR o_custkey = 7) AND o_orderstatus = 'O'")
def or_run(t, d):
    return t("orders").where(f("o_totalprice") > 300000.0).or_().where(f("o_custkey") == 7).where(f("o_orderstatus") == "O").get_ids()


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 1 OR o_custkey = 2 OR o_custkey = 3")
def or_chain(t, d):
    return t("orders").where(f("o_custkey") == 1).or_().where(f("o_custkey") == 2).or_().where(f("o_custkey") == 3).get_ids()


@query("""SELECT o_orderkey FROM orders WHERE (o_totalprice BETWEEN 1000 AND 20000 OR o_custkey IN (5, 6, 7))
          AND (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR lower(o_orderpriority) = '2-high')""")
def or_mixed_kinds(t, d):
    q = t("orders").between("o_totalprice", 1000.0, 20000.0).or_().intersect("o_custkey", [5, 6, 7])
    return q.intersect("o_custkey", t("customer").where(f("c_acctbal") < 0.0).get_ids()).or_().where(f("o_orderpriority") == "2-high").get_ids()


# --- order and limits ---------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 50")
def order_asc(t, d):
    return t("orders").order_by("o_totalprice").take(50).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 50")
def order_desc(t, d):
    return t("orders").order_by_descending("o_orderdate").take(50).select("o_orderkey", "o_orderdate")


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 40")
def order_string(t, d):
    return t("part").order_by("p_name").take(40).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 25 OFFSET 100")
def order_skip_take(t, d):
    return t("orders").where(f("o_orderstatus") != "F").order_by("o_totalprice").take(25).skip(100).select("o_orderkey", "o_totalprice")


@query(f"SELECT c_custkey, nat FROM ({NULLED}) ORDER BY nat NULLS FIRST, c_custkey LIMIT 120")
def order_nulls(t, d):
    return nulled(d).order_by("nat").take(120).select("c_custkey", "nat")


@query(f"SELECT c_custkey, nat FROM ({NULLED}) ORDER BY nat DESC NULLS LAST, c_custkey DESC OFFSET 1300")
def order_nulls_desc(t, d):
    return nulled(d).order_by_descending("nat").skip(1300).select("c_custkey", "nat")


@query("SELECT o_orderkey FROM orders LIMIT 0")
def take_zero(t, d):
    return t("orders").order_by("o_totalprice").take(0).select("o_orderkey")


# --- projection and counts ----------------------------------------------------------------------------------------


@query("SELECT * FROM orders WHERE o_custkey = 10")
def select_entity(t, d):
    return t("orders").where(f("o_custkey") == 10).select_entity()


@query("SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_totalprice > 400000")
def select_cols(t, d):
    return t("orders").where(f("o_totalprice") > 400000.0).select("o_orderkey", price="o_totalprice")


@query("SELECT count(*) AS count FROM orders")
def count_all(t, d):
    return t("orders").count()


@query("SELECT count(*) AS count FROM orders WHERE o_totalprice < 50000")
def count_where(t, d):
    return t("orders").where(f("o_totalprice") < 50000.0).count()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 350000")
def get_ids(t, d):
    return t("orders").where(f("o_totalprice") > 350000.0).get_ids()


@query("SELECT count(*) FILTER (WHERE o_totalprice > 0) AS n_ids, count(*) FILTER (WHERE o_totalprice > 0) = count(*) AS all_ids FROM orders")
def get_ids_flag(t, d):
    return t("orders").where(f("o_totalprice") > 0.0).all_ids()


@query("SELECT count(*) AS total, 100 AS searched_percentile FROM orders WHERE o_totalprice < 250000")
def total_statistics(t, d):
    return t("orders").where(f("o_totalprice") < 250000.0).order_by("o_totalprice").take(5).statistics()


# --- groups -------------------------------------------------------------------------------------------------------


@query("SELECT l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY 1")
def group_count(t, d):
    return t("lineitem").group_by("l_linenumber").select(key=agg.key(), n=agg.count())


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 2) for n in names})


@query("SELECT l_linenumber AS key, round(sum(l_quantity), 2) AS s, sum(l_linenumber)::BIGINT AS s_int FROM lineitem GROUP BY 1")
def group_sum(t, d):
    return rounded(t("lineitem").group_by("l_linenumber").select(key=agg.key(), s=agg.sum_("l_quantity"), s_int=agg.sum_("l_linenumber")), "s")


@query("SELECT c_nationkey AS key, min(c_acctbal) AS low FROM customer GROUP BY 1")
def group_min(t, d):
    return t("customer").group_by("c_nationkey").select(key=agg.key(), low=agg.min_("c_acctbal"))


@query("SELECT c_nationkey AS key, max(c_acctbal) AS high FROM customer GROUP BY 1")
def group_max(t, d):
    return t("customer").group_by("c_nationkey").select(key=agg.key(), high=agg.max_("c_acctbal"))


@query("SELECT c_nationkey AS key, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY 1")
def group_avg(t, d):
    return rounded(t("customer").group_by("c_nationkey").select(key=agg.key(), mean=agg.average("c_acctbal")), "mean")


@query("SELECT l_linenumber AS key, count(DISTINCT l_quantity) AS quantities, count(DISTINCT l_shipdate) AS days FROM lineitem GROUP BY 1")
def group_count_distinct(t, d):
    return t("lineitem").group_by("l_linenumber").select(key=agg.key(), quantities=agg.count_distinct("l_quantity"), days=agg.count_distinct("l_shipdate"))


@query("SELECT l_linenumber AS key, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1")
def group_dates(t, d):
    return t("lineitem").group_by("l_linenumber").select(key=agg.key(), first=agg.min_("l_shipdate"), last=agg.max_("l_shipdate"))


@query("""SELECT l_linenumber AS key, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem
          WHERE l_quantity BETWEEN 5 AND 25 AND lower(l_returnflag) = 'r' GROUP BY 1""")
def group_where(t, d):
    q = t("lineitem").between("l_quantity", 5.0, 25.0).where(f("l_returnflag") == "r")
    return rounded(q.group_by("l_linenumber").select(key=agg.key(), revenue=agg.sum_("l_extendedprice"), n=agg.count()), "revenue")


@query("SELECT l_linenumber AS key, count(*) AS n FROM lineitem WHERE l_quantity > 1000000 GROUP BY 1")
def group_empty(t, d):
    return t("lineitem").where(f("l_quantity") > 1000000.0).group_by("l_linenumber").select(key=agg.key(), n=agg.count())


@query("SELECT p_size AS key, sum(p_retailprice::DECIMAL(12,2))::DECIMAL(22,2) AS s, max(p_partkey) AS top FROM part GROUP BY 1")
def group_decimal_long(t, d):
    df = d("part").withColumn("price", F.col("p_retailprice").cast("decimal(12,2)"))
    return over(df, "p_partkey").group_by("p_size").select(key=agg.key(), s=agg.sum_("price"), top=agg.max_("p_partkey"))


# --- text search --------------------------------------------------------------------------------------------------

_SPACES = "\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_SEPARATORS = "".join("\\" + c if c.isascii() else c for c in text.SEPARATORS).replace("'", "''")


def tokens_sql(column: str, mode: str = "words") -> str:
    plain = f"list_filter(string_split_regex(lower({column}), '[{_SPACES}]+'), lambda x: x <> '')"
    if mode == "spaces":
        return f"list_distinct({plain})"
    parts = f"list_transform(string_split_regex(lower({column}), '[ {_SEPARATORS}]+'), lambda x: regexp_replace(x, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g'))"
    return f"list_distinct(list_concat({plain}, list_filter({parts}, lambda x: x <> '')))"


def all_words_sql(column: str, words: str, mode: str = "words") -> str:
    return " AND ".join(f"list_contains({tokens_sql(column, mode)}, '{w}')" for w in words.lower().split())


@query("SELECT doc_id FROM documents WHERE " + all_words_sql("text", "with that"))
def search_and(t, d):
    return t("documents").search("text", "With THAT").get_ids()


@query("SELECT doc_id FROM documents WHERE " + all_words_sql("text", "the was.", "spaces"))
def search_spaces_only(t, d):
    return over(d("documents"), "doc_id", search={"text": "spaces"}).search("text", "the was.").get_ids()


@query("SELECT doc_id FROM documents WHERE " + all_words_sql("text", "the. of"))
def search_special_char(t, d):
    return t("documents").search("text", "the. of").get_ids()


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({tokens_sql('text')}, lambda x: starts_with(x, 'ther'))) > 0 AND len(list_filter({tokens_sql('text')}, lambda x: starts_with(x, 'wh'))) > 0")
def search_partial(t, d):
    return t("documents").search_partial("text", "ther WH").get_ids()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 3000 AND o_orderkey < 8000 AND " + all_words_sql("o_orderpriority", "urgent"))
def search_steps(t, d):
    q = over(d("orders"), "o_orderkey", search={"o_orderpriority": "words"})
    return q.search("o_orderpriority", "Urgent", 3, 5).get_ids()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 2000 AND o_orderkey < 11000 AND o_orderpriority ILIKE '%not%spec%'")
def search_partial_steps(t, d):
    q = over(d("orders"), "o_orderkey", search={"o_orderpriority": "words"})
    return q.search_partial("o_orderpriority", "no SPECI", 2, 9).get_ids()


@query(f"SELECT doc_id FROM documents WHERE ({all_words_sql('text', 'with this')}) OR ({all_words_sql('text', 'la y')})")
def search_or(t, d):
    return t("documents").search("text", "with this").or_().search("text", "la y").get_ids()


@query(f"SELECT doc_id, len({tokens_sql('text')}) AS n_tokens FROM documents")
def token_sets(t, d):
    return d("documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("SELECT (max(doc_id) // 1000)::BIGINT AS last_step FROM documents")
def last_step(t, d):
    return t("documents").last_step()


#: The signatures' hashes of every distinct token, over UTF-16 code units, and the bits of each document.
_UNITS = "flatten(list_transform(string_split(token, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)] ELSE [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] END))::UHUGEINT[]"
_WRAP = "18446744073709551616::UHUGEINT"
_BITS = f"""tokens AS (SELECT doc_id, unnest({tokens_sql("text")}) AS token FROM documents),
hashes AS (SELECT token, [list_reduce(u, lambda h, c: (xor(h, c) * {signatures.FNV_PRIME}) % 4294967296::UHUGEINT, {signatures.FNV_BASIS}::UHUGEINT),
                          list_reduce(u, lambda h, c: (h * {signatures.DJB2_FACTOR} + c) % {_WRAP}, {signatures.DJB2_BASIS}::UHUGEINT),
                          list_reduce(u, lambda h, c: (c + h * {signatures.SDBM_FACTOR}) % {_WRAP}, 0::UHUGEINT)] AS h
           FROM (SELECT token, {_UNITS} AS u FROM (SELECT DISTINCT token FROM tokens))),
bits AS (SELECT DISTINCT doc_id, b FROM (SELECT doc_id, unnest(list_transform(h, lambda x: (x % BITS)::BIGINT)) AS b FROM tokens JOIN hashes USING (token)))"""


def _bits_sql(bits: int) -> str:
    return _BITS.replace("BITS", str(bits))


def _positions_sql(words: str, bits: int) -> str:
    return ", ".join(str(b) for b in sorted({int(b) for b in signatures.positions(words.split(), bits).ravel()}))


def _found_sql(words: str, bits: int) -> str:
    own = _positions_sql(words, bits)
    return f"SELECT doc_id FROM bits WHERE b IN ({own}) GROUP BY doc_id HAVING count(*) = {own.count(',') + 1}"


@query(f"WITH {_bits_sql(1024)} {_found_sql('with that', 1024)}")
def search_bitfunnel(t, d):
    q = t("documents")
    return Query(q.source, q.schema, signature_index=("text", 1024)).search_bitfunnel("text", "With that").get_ids()


@query(f"""WITH {_bits_sql(512)}, found AS ({_found_sql("with", 512)}),
sizes AS (SELECT doc_id // 1024 AS batch, count(*) AS n FROM found GROUP BY 1)
SELECT doc_id FROM found WHERE (SELECT coalesce(sum(n), 0) FROM sizes WHERE batch < doc_id // 1024) < 50""")
def search_bitfunnel_stop_count(t, d):
    q = t("documents")
    return Query(q.source, q.schema, signature_index=("text", 512)).search_bitfunnel("text", "with", stop_count=50).get_ids()


@query("SELECT doc_id, 100 AS searched_percentile FROM documents WHERE " + all_words_sql("text", "with that"))
def search_time_limited(t, d):
    found, percent = t("documents").search_time_limited("text", "with that", 60_000)
    return found.get_ids().withColumn("searched_percentile", F.lit(percent))


@query(f"WITH {_bits_sql(1024)} SELECT round((SELECT count(*) FROM bits) / 1024.0 / (SELECT count(*) FROM documents WHERE text IS NOT NULL), 9) AS ratio")
def bitfunnel_ratio(t, d):
    share = signatures.share_of_bits(signatures.signature(F.col("text"), 1024), 1024)
    return d("documents").agg(F.round(F.avg(share), 9).alias("ratio"))


# --- vectors ------------------------------------------------------------------------------------------------------

PROBE = [round(0.01 * ((7 * k) % 23 - 11), 2) for k in range(64)]
_PROBE = "[" + ", ".join(f"{x}::FLOAT" for x in PROBE) + "]"
_DISTANCE = f"list_sum(list_transform(list_zip(embedding, {_PROBE}), lambda p: (p[1] - p[2])::DOUBLE * (p[1] - p[2])::DOUBLE))::FLOAT::DOUBLE"


@query(f"SELECT vec_id FROM embeddings ORDER BY {_DISTANCE}, vec_id LIMIT 10")
def knn(t, d):
    return t("embeddings").search_neighbours("embedding", PROBE, 10).get_ids()


@query(f"SELECT vec_id FROM (SELECT vec_id, label FROM embeddings ORDER BY {_DISTANCE}, vec_id LIMIT 40) WHERE label = 3")
def knn_post_filter(t, d):
    return t("embeddings").where(f("label") == 3).search_neighbours("embedding", PROBE, 40).get_ids()


@query(f"SELECT vec_id, label FROM embeddings WHERE label = 7 OR vec_id IN (SELECT vec_id FROM embeddings ORDER BY {_DISTANCE}, vec_id LIMIT 12)")
def knn_or_where(t, d):
    return t("embeddings").search_neighbours("embedding", PROBE, 12).or_().where(f("label") == 7).select("vec_id", "label")


@query(f"SELECT vec_id, {_DISTANCE} AS distance FROM embeddings ORDER BY {_DISTANCE}, vec_id LIMIT 15")
def knn_statistics(t, d):
    return t("embeddings").search_neighbours("embedding", PROBE, 15).distances()


@query(f"""SELECT (vec_id % {SHARDS} + 1)::INT AS Sid, vec_id FROM embeddings
           QUALIFY row_number() OVER (PARTITION BY vec_id % {SHARDS} ORDER BY {_DISTANCE}, vec_id) <= 5""")
def dist_knn_per_shard(t, d):
    return dist(d, "embeddings").search_neighbours("embedding", PROBE, 5).get_ids()


@query(f"SELECT vec_id, {_DISTANCE} AS squared, round(sqrt({_DISTANCE}), 6) AS l2 FROM embeddings")
def vector_distance(t, d):
    squared = squared_distance(F.col("embedding"), PROBE)
    return d("embeddings").select("vec_id", squared.alias("squared"), F.round(F.sqrt(squared), 6).alias("l2"))


# --- writes, as rows before to rows after -------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN 1.5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def update_column(t, d):
    orders = d("orders")
    changes = orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit(1.5).alias("v")).unionByName(orders.sparkSession.range(1).select(F.lit(-5).cast("long").alias("o_orderkey"), F.lit(9.0).alias("v")))
    return writes.updated(orders, "o_totalprice", changes, TableSchema("o_orderkey"))


@query("SELECT o_orderkey, o_custkey, CASE o_orderkey WHEN 1 THEN 'X' WHEN 2 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_values(t, d):
    orders = d("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return writes.updated(orders, "o_orderstatus", {1: "X", 2: "", 10**9: "Y"}, TableSchema("o_orderkey"))


@query("SELECT * FROM orders WHERE o_orderkey NOT IN (3, 4, 5) AND o_orderkey % 2 = 1")
def delete_ids(t, d):
    kept = writes.deleted(d("orders"), [3, 4, 5, 10**9], TableSchema("o_orderkey"))
    return writes.deleted(kept, d("orders").where("o_orderkey % 2 = 0").select("o_orderkey"), TableSchema("o_orderkey"))


@query("""SELECT c_custkey + 1 AS c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_name END AS c_name FROM customer
          UNION ALL SELECT (SELECT max(c_custkey) + 1 FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier""")
def save_upsert(t, d):
    before = d("customer").select((F.col("c_custkey") + 1).alias("c_custkey"), "c_name")
    old = before.where("(c_custkey - 1) % 10 = 0").select("c_custkey", F.lit("changed").alias("c_name"), F.col("c_custkey").alias("_position"))
    new = d("supplier").select(F.lit(0).cast("long").alias("c_custkey"), F.col("s_name").alias("c_name"), (F.col("s_suppkey") + 10**6).alias("_position"))
    return writes.saved(before, old.unionByName(new), TableSchema("c_custkey"))


@query("SELECT o_custkey + 1 AS key, min_by(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def save_first_wins(t, d):
    items = d("orders").select((F.col("o_custkey") + 1).alias("key"), "o_orderkey", F.col("o_orderkey").alias("_position"))
    return writes.saved(items.select("key", "o_orderkey").limit(0), items, TableSchema("key"))


@query("SELECT n_nationkey + 1 AS id, CASE WHEN n_nationkey = 4 THEN n_regionkey + 5 ELSE n_regionkey END::INT AS n_regionkey FROM nation")
def atomic_increment(t, d):
    before = d("nation").select((F.col("n_nationkey") + 1).alias("id"), "n_regionkey")
    q = over(before, "id").where(f("id") == 5)
    return writes.incremented(before, q.matches(), {"n_regionkey": 5}, {"id": 5, "n_regionkey": 5}, TableSchema("id"))[0]


@query("""SELECT n_nationkey + 1 AS id, n_regionkey, (CASE WHEN n_nationkey = 2 THEN n_regionkey + 1 ELSE n_regionkey END)::INT AS n FROM nation
          UNION ALL SELECT 26, 7, 1""")
def atomic_increment_guarded(t, d):
    spec = TableSchema("id")
    df = d("nation").select((F.col("n_nationkey") + 1).alias("id"), "n_regionkey", F.col("n_regionkey").alias("n"))
    one = lambda x, i: over(x, "id").where(f("id") == i).matches()
    region = df.where("id = 3").first()["n"]
    df, _ = writes.incremented(df, one(df, 3), {"n": 1}, {}, spec, only_if=region)
    df, _ = writes.incremented(df, one(df, 4), {"n": 1}, {}, spec, only_if=-99)
    return writes.incremented(df, one(df, 1000), {"n": 1}, {"n_regionkey": 7, "n": 1}, spec)[0]


# --- partitions, shards, schemas ----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def partition_read(t, d):
    return partition(d("orders"), "o_orderstatus", "F", "o_orderkey").where(f("o_totalprice") > 200000.0).select("o_orderkey", "o_orderstatus")


@query(f"SELECT (o_orderkey % {SHARDS} + 1)::INT AS Sid, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 20")
def dist_partition_read(t, d):
    df = d("orders").withColumn("Sid", shard_of(F.col("o_orderkey"), SHARDS))
    return partition(df, "o_orderstatus", "O", "o_orderkey", shard="Sid").order_by("o_totalprice").take(20).select("Sid", "o_orderkey", "o_totalprice")


def dist(d, name: str) -> Query:
    df = d(name).withColumn("Sid", shard_of(F.col(KEYS[name]), SHARDS))
    return sharded(df, "Sid", KEYS[name], **KNOWN.get(name, {}))


@query("SELECT count(*) AS count FROM orders WHERE o_totalprice > 100000")
def dist_count(t, d):
    return dist(d, "orders").where(f("o_totalprice") > 100000.0).count()


@query("SELECT c_nationkey AS key, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY 1")
def dist_group_merge(t, d):
    return rounded(dist(d, "customer").group_by("c_nationkey").select(key=agg.key(), n=agg.count(), low=agg.min_("c_acctbal"), high=agg.max_("c_acctbal"), mean=agg.average("c_acctbal")), "mean")


@query(f"SELECT (o_orderkey % {SHARDS} + 1)::INT AS Sid, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 30")
def dist_order_take(t, d):
    return dist(d, "orders").order_by_descending("o_totalprice").take(30).select("Sid", "o_orderkey", "o_totalprice")


@query(f"SELECT (o_orderkey % {SHARDS} + 1)::INT AS Sid, o_orderkey FROM orders WHERE o_orderkey % {SHARDS} + 1 IN (1, 3) AND o_totalprice < 30000")
def dist_intersect_ids(t, d):
    q = dist(d, "orders")
    return q.where(f("o_totalprice") < 200000.0).intersect_ids(q.intersect("Sid", [1, 3]).where(f("o_totalprice") < 30000.0).get_ids()).get_ids()


@query(f"SELECT max(o_orderkey) // 1000 AS last_step, count(DISTINCT o_orderkey % {SHARDS}) AS shards FROM orders")
def dist_last_step(t, d):
    q = dist(d, "orders")
    return q.last_step().crossJoin(q.source.agg(F.count_distinct("Sid").alias("shards")))  # one row each


@query("""SELECT c_custkey, c_name, NULL::DOUBLE AS c_acctbal, 0::INT AS c_nationkey FROM customer WHERE c_custkey < 100
          UNION ALL SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer WHERE c_custkey >= 100""")
def schema_evolution(t, d):
    old = d("customer").where("c_custkey < 100").select("c_custkey", "c_name")
    new = d("customer").where("c_custkey >= 100").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    schema = evolved(old.schema, new.schema)
    rows = reduce(DataFrame.unionByName, [shaped(x, schema) for x in (old, new)])
    return rows.withColumn("c_nationkey", F.coalesce("c_nationkey", default_of(schema["c_nationkey"].dataType)))


# --- the store: writes and reads through versions -----------------------------------------------------------------


def new_store(spark: SparkSession) -> Store:
    """An empty store in the shared folder, which goes with the application."""
    return Store(spark, temporary(spark, scratch(spark, "store")))


def stored(df: DataFrame, key: str):
    """A store in the shared folder with ``df`` as its table "t"."""
    store = new_store(df.sparkSession)
    t = store.table("t").knowing(key=key)
    t.save_batch(df)
    return store, t


def supplier(d) -> DataFrame:
    return d("supplier").select((F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))


@query("""SELECT s_suppkey + 1 AS id, CASE s_suppkey WHEN 1 THEN NULL ELSE s_name END AS name, CASE s_suppkey WHEN 2 THEN 99 ELSE s_nationkey END::INT AS nation
          FROM supplier WHERE s_suppkey NOT IN (3, 4) UNION ALL SELECT max(s_suppkey) + 2, 'new', 7 FROM supplier""")
def store_save_update_delete(t, d):
    _, table_ = stored(supplier(d), "id")
    table_.update("name", {2: ""})
    table_.update("nation", {3: 99, 10**9: 1})
    table_.delete([4, 5, 10**9])
    table_.save({"name": "new", "nation": 7})
    return table_.dataframe()


@query("""SELECT 't' AS tab, s_suppkey + 1 AS id, CASE s_suppkey WHEN 0 THEN 'x' ELSE s_name END AS name FROM supplier WHERE s_suppkey <> 5
          UNION ALL SELECT 'u', n_nationkey + 1, n_name FROM nation""")
def store_transaction(t, d):
    store, a = stored(supplier(d), "id")
    b = store.table("u").knowing(key="id")
    with store.transaction() as tx:
        tx.update(a, "name", {1: "x"})
        tx.delete(a, [6])
        tx.save_batch(b, d("nation").select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.col("n_name").alias("name")))
    return a.dataframe().select(F.lit("t").alias("tab"), "id", "name").unionByName(b.dataframe().select(F.lit("u").alias("tab"), "id", "name"))


@query("SELECT s_suppkey + 1 AS id, s_name AS name, CASE s_suppkey WHEN 7 THEN s_nationkey + 3 ELSE s_nationkey END::INT AS nation FROM supplier")
def store_increment_replicate(t, d):
    store, table_ = stored(supplier(d), "id")
    table_.atomic_increment(table_.query().where(f("id") == 8), {"nation": 3}, {})
    copy = scratch(store.spark, "copy")
    store.replicate(copy)
    temporary(store.spark, copy)
    table_.delete([1, 2, 3])
    return Store(store.spark, copy).table("t").dataframe()


@query("SELECT s_suppkey + 1 AS id, s_name AS name FROM supplier WHERE s_nationkey % 2 = 1 AND s_suppkey > 10")
def store_partition(t, d):
    df = supplier(d)
    store = new_store(df.sparkSession)
    for p in (0, 1):
        store.partitioned_table("t", str(p)).knowing(key="id").save_batch(df.where(F.col("nation") % 2 == p))
    return store.partitioned_table("t", "1").knowing(key="id").query().where(f("id") > 11).select("id", "name")


def nations(d) -> list[dict]:
    """The smallest table as dictionaries, for calls that take rows from the driver."""
    return [{"id": r["n_nationkey"] + 1, "name": r["n_name"], "region": r["n_regionkey"]} for r in d("nation").orderBy("n_nationkey").collect()]


NATION = "id int, name string, region int"


def stored_nations(d, size: int = 10):
    store = new_store(d("nation").sparkSession)
    t = store.table("n").knowing(key="id", search={"name": "words"})
    t.save_in_batches(nations(d), size, T.StructType.fromDDL(NATION))
    return store, t


@query("SELECT n_nationkey + 1 AS id, n_name AS name, n_regionkey AS region FROM nation")
def store_save_in_batches(t, d):
    return stored_nations(d, 7)[1].dataframe()


@query("SELECT n_nationkey + 1 AS id, CASE WHEN n_regionkey = 2 THEN n_name ELSE 'nation ' || n_nationkey END AS name FROM nation")
def store_update_in_batches(t, d):
    _, table_ = stored_nations(d)
    table_.update_in_batches("name", {r["id"]: f"nation {r['id'] - 1}" for r in nations(d) if r["region"] != 2} | {999: "x"}, 6)
    return table_.dataframe().select("id", "name")


@query("SELECT n_nationkey + 1 AS id FROM nation WHERE n_regionkey NOT IN (1, 3)")
def store_delete_in_batches(t, d):
    _, table_ = stored_nations(d)
    table_.delete_in_batches([r["id"] for r in nations(d) if r["region"] in (1, 3)] + [999], 4)
    return table_.query().get_ids()


@query("SELECT n_nationkey + 1 AS id, (n_regionkey + CASE WHEN n_nationkey = 4 THEN 5 ELSE 0 END)::INT AS region, (n_nationkey + CASE WHEN n_nationkey = 4 THEN 7 ELSE 0 END)::INT AS code FROM nation UNION ALL SELECT 100, 1, 2")
def atomic_increment_two_columns(t, d):
    store = new_store(d("nation").sparkSession)
    table_ = store.table("n").knowing(key="id")
    table_.save_batch(d("nation").select((F.col("n_nationkey") + 1).alias("id"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("code")))
    one = lambda i: table_.query().where(f("id") == i)
    table_.atomic_increment(one(5), {"region": 5, "code": 7}, {})
    table_.atomic_increment(one(100), {"region": 5, "code": 7}, {"id": 100, "region": 1, "code": 2})
    return table_.dataframe()


def together(*jobs: Callable[[], object]) -> None:
    """Run some writes at the same time; the first error of any is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(j) for j in jobs]:
            done.result()


@query("SELECT n_nationkey + 1 AS id, (n_regionkey + CASE WHEN n_nationkey = 4 THEN 20 ELSE 0 END)::INT AS region FROM nation")
def store_parallel_increment(t, d):
    store, table_ = stored_nations(d, 100)
    reused = table_.query().where(f("id") == 5)
    elsewhere = lambda: Store(store.spark, store.root).table("n").knowing(key="id")
    together(*[lambda: table_.atomic_increment(reused, {"region": 5}, {})] * 2, *[lambda: elsewhere().atomic_increment(reused, {"region": 5}, {})] * 2)
    return table_.dataframe().select("id", "region")


@query("""SELECT 'n' || n_regionkey AS tab, n_nationkey + 1 AS id FROM nation WHERE n_regionkey < 3
          UNION ALL SELECT 'all', row_number() OVER () FROM nation WHERE n_regionkey < 3""")
def store_parallel_tables(t, d):
    """Writers of three tables, which all add rows to a fourth one too."""
    store, _ = stored_nations(d, 100)
    own = {k: [r for r in nations(d) if r["region"] == k] for k in range(3)}
    new = lambda name: Store(store.spark, store.root).table(name).knowing(key="id")
    schema = T.StructType.fromDDL(NATION)
    together(*[lambda k=k: new(f"n{k}").save_batch(own[k], schema) for k in own], *[lambda k=k: new("all").save_batch([r | {"id": 0} for r in own[k]], schema) for k in own])
    return reduce(DataFrame.unionByName, [store.table(n).dataframe().select(F.lit(n).alias("tab"), "id") for n in ("n0", "n1", "n2", "all")])


@query("SELECT n_nationkey AS key, n_name AS name, (n_nationkey + 1)::INT AS place FROM nation")
def queue_put_get(t, d):
    queues = Queues()
    for r in d("nation").orderBy("n_nationkey").collect():
        queues.put("nation", (r["n_nationkey"], r["n_name"]))
    rows = [(*item, k) for k, item in enumerate(queues.get_all("nation"), 1)] + [(-1, "left", k) for k, _ in enumerate(queues.get_all("nation"))]
    return d("nation").sparkSession.createDataFrame(rows, "key int, name string, place int")


@query("SELECT 'peeked' AS how, n_nationkey AS key FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'drained', n_nationkey FROM nation WHERE n_regionkey = 1")
def queue_named(t, d):
    queues = Queues()
    for k in (0, 1):
        queues.replace_named("nation", "of a region", [r["n_nationkey"] for r in d("nation").where(F.col("n_regionkey") == k).collect()])
    rows = [(how, key) for how, drop in (("peeked", False), ("drained", True), ("left", False)) for key in queues.get_named("nation", "of a region", delete=drop)]
    return d("nation").sparkSession.createDataFrame(rows, "how string, key int")


@query("""SELECT 'urgent' AS step, count(*) AS n FROM orders WHERE lower(o_orderpriority) = '1-urgent'
          UNION ALL SELECT 'open', count(*) FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND o_orderstatus = 'O'
          UNION ALL SELECT 'dear', count(*) FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND o_totalprice > 200000""")
def intermediate_results(t, d):
    """One query, extended in two ways and used again."""
    urgent = t("orders").where(f("o_orderpriority") == "1-urgent")
    steps = {"urgent": urgent, "open": urgent.where(f("o_orderstatus") == "O"), "dear": urgent.where(f("o_totalprice") > 200000.0)}
    return reduce(DataFrame.unionByName, [q.count().select(F.lit(name).alias("step"), F.col("count").alias("n")) for name, q in steps.items()])


@query("SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_regionkey <> 0")
def select_in_batches(t, d):
    batches = list(t("nation").where(f("n_regionkey") != 0).in_batches("n_nationkey", "n_name", size=6))
    assert all(len(b) == 6 for b in batches[:-1])
    return d("nation").sparkSession.createDataFrame([tuple(r) for b in batches for r in b], "key int, name string")


def described(store: Store, name: str) -> list[tuple]:
    return [(i["kind"], i["column"], i.get("value")) for i in store.indexes(name)]


@query("SELECT 'property' AS kind, 'region' AS column_name, NULL::VARCHAR AS value, 25 AS cached UNION ALL SELECT 'group', 'region', 'id', 25")
def index_definitions(t, d):
    store, table_ = stored_nations(d)
    table_.create_property_index("region")
    table_.create_group_index("region", "id")
    cached = table_.cached()
    n = cached.count()
    cached.unpersist()
    return store.spark.createDataFrame([(*i, n) for i in described(Store(store.spark, store.root), "n")], "kind string, column_name string, value string, cached int")


@query("SELECT n_regionkey AS key, count(*) AS n, (max(n_nationkey) + 1)::INT AS top FROM nation GROUP BY 1")
def group_index_strict(t, d):
    _, table_ = stored_nations(d)
    table_.create_group_index("region", "id")
    return table_.query(strict=True).group_by("region").select(key=agg.key(), n=agg.count(), top=agg.max_("id"))


@query("SELECT 'group' AS kind, 'region' AS column_name")
def index_removal(t, d):
    store, table_ = stored_nations(d)
    table_.create_property_index("region")
    table_.create_group_index("region", "id")
    for _ in range(2):
        table_.remove_index("property", "region")
    return store.spark.createDataFrame([i[:2] for i in described(store, "n")], "kind string, column_name string")


@query(f"WITH {_bits_sql(256)}, found AS ({_found_sql('with', 256)}) SELECT doc_id, lang FROM found JOIN documents USING (doc_id) WHERE lang = 'en'")
def search_bitfunnel_stored(t, d):
    """The signatures are written with the table once; the search reads them and no text."""
    store = new_store(d("documents").sparkSession)
    table_ = store.table("documents").knowing(key="doc_id", search={"text": "words"})
    table_.save_batch(d("documents").select((F.col("doc_id") + 1).alias("doc_id"), "text", "lang"))
    table_.create_bitfunnel_index("text", 256)
    found = table_.query().search_bitfunnel("text", "with").where(f("lang") == "en").select("doc_id", "lang")
    return found.withColumn("doc_id", F.col("doc_id") - 1)


@query("SELECT * FROM (VALUES ('n', 'id', 'int'), ('n', 'name', 'string'), ('n', 'region', 'int'), ('s', 'id', 'bigint'), ('s', 'name', 'string'), ('s', 'nation', 'int')) v(tab, column_name, kind)")
def table_definitions(t, d):
    store, _ = stored_nations(d)
    store.table("s").knowing(key="id").save_batch(supplier(d))
    rows = [(n, c.name, c.dataType.simpleString()) for n in store.tables() for c in store.definition(n)]
    return store.spark.createDataFrame(rows, "tab string, column_name string, kind string")


@query("SELECT n_nationkey + 1 AS id, CASE WHEN n_nationkey = 0 THEN 'kept' ELSE n_name END AS name FROM nation")
def store_reopened(t, d):
    store, table_ = stored_nations(d)
    table_.update("name", {1: "kept"})
    return Store(store.spark, store.root).table("n").knowing(key="id").dataframe().select("id", "name")


@query(f"SELECT (o_orderkey % {SHARDS} + 1)::INT AS Sid, count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM orders GROUP BY 1")
def placement(t, d):
    rows = d("orders").select(F.lit(0).alias("Sid"), F.lit(0).alias("Id"), "o_orderkey")
    return place(rows, SHARDS, position="o_orderkey").groupBy("Sid").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))


@query("SELECT c_custkey + 1 AS id, c_nationkey AS nation FROM customer")
def stream_save(t, d):
    """A stream of files into a store, each micro-batch one commit."""
    spark = d("customer").sparkSession
    source = scratch(spark, "stream")
    d("customer").select((F.col("c_custkey") + 1).alias("id"), F.col("c_nationkey").alias("nation")).repartition(4).write.parquet(source)
    temporary(spark, source)
    store = new_store(spark)
    table_ = store.table("c").knowing(key="id")
    stream = spark.readStream.schema("id long, nation int").option("maxFilesPerTrigger", 2).parquet(source)
    save_stream(stream, table_, f"{store.root}/_stream", "customers").awaitTermination()
    return table_.dataframe()


def refused(call: Callable[[], object]) -> bool:
    try:
        call()
    except (QueryError, PySparkException):
        return True
    return False


def told(d, rows: list[tuple[str, bool]]) -> DataFrame:
    return d("nation").sparkSession.createDataFrame(rows, "what string, refused boolean")


@query("SELECT * FROM (VALUES ('F8 order with null', true), ('P1 expression', true), ('A8 other aggregate', true), ('V3 other dimension', true), ('V1 no neighbours', true), ('O3 skip without order', true), ('F12 or at the end', true), ('plain', false)) v(what, refused)")
def refused_shapes(t, d):
    orders, vectors = t("orders"), t("embeddings")
    shapes = {
        "F8 order with null": lambda: orders.where(f("o_totalprice") < None),
        "P1 expression": lambda: orders.select(F.col("o_totalprice") + 1),
        "A8 other aggregate": lambda: t("lineitem").group_by("l_linenumber").select(key=agg.key(), n=agg.Aggregate("median", "l_quantity")),
        "V3 other dimension": lambda: vectors.search_neighbours("embedding", [1.0, 2.0], 3).get_ids().collect(),
        "V1 no neighbours": lambda: vectors.search_neighbours("embedding", PROBE, 0),
        "O3 skip without order": lambda: orders.skip(3),
        "F12 or at the end": lambda: orders.where(f("o_custkey") == 1).or_().get_ids(),
        "plain": lambda: orders.where(f("o_totalprice") < 1000.0).get_ids(),
    }
    return told(d, [(name, refused(make)) for name, make in shapes.items()])


@query("SELECT * FROM (VALUES ('25 of 25', false), ('25 of 24', true)) v(what, refused) UNION ALL SELECT 'rows kept: ' || count(*), false FROM nation")
def write_batch_limit(t, d):
    store = new_store(d("nation").sparkSession)
    save = lambda most: Store(store.spark, store.root, most_rows=most).table("n").knowing(key="id").save_batch(nations(d), T.StructType.fromDDL(NATION))
    rows = [(f"25 of {most}", refused(lambda most=most: save(most))) for most in (25, 24)]
    return told(d, [*rows, (f"rows kept: {store.table('n').dataframe().count()}", False)])


@query("SELECT * FROM (VALUES ('within', false), ('beyond', true)) v(what, refused) UNION ALL SELECT n_name, false FROM nation")
def result_size_limit(t, d):
    q = t("nation")
    size = 4 * 25 + sum(len(r["n_name"]) for r in d("nation").collect())
    limits = [("within", size), ("beyond", size - 1)]
    rows = [(name, refused(lambda most=most: q.fetched("n_nationkey", "n_name", most_bytes=most))) for name, most in limits]
    return told(d, rows + [(r["n_name"], False) for r in q.fetched("n_name")])


@query("SELECT * FROM (VALUES ('up', false), ('down', true)) v(what, refused)")
def store_status(t, d):
    store, _ = stored_nations(d)
    return told(d, [("up", not store.status(20_000)[1]), ("down", not Store(store.spark, store.root + "-elsewhere").status(20_000)[1])])


@query("""SELECT * FROM (VALUES ('reader query', false), ('reader save', true), ('reader copy', true), ('writer query', false), ('writer save', false), ('writer copy', true),
          ('admin query', false), ('admin save', false), ('admin copy', false), ('wrong password', true), ('nobody', true)) v(what, refused)""")
def users_and_roles(t, d):
    store, _ = stored_nations(d)
    users = Users({r: (f"secret {r}", r) for r in ("reader", "writer", "admin")})
    copy = scratch(store.spark, "copy")
    rows = []
    for role in ("reader", "writer", "admin"):
        own = users.opened(store, role, f"secret {role}")
        table_ = lambda own=own: own.table("n").knowing(key="id")
        rows.append((f"{role} query", refused(lambda: table_().query().count().first())))
        rows.append((f"{role} save", refused(lambda: table_().save({"name": role, "region": 1}))))
        rows.append((f"{role} copy", refused(lambda own=own: own.replicate(copy))))
    temporary(store.spark, copy)
    rows += [("wrong password", refused(lambda: users.opened(store, "admin", "x"))), ("nobody", refused(lambda: users.opened(store, "x", "x")))]
    return told(d, rows)
