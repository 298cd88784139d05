"""A procurement graph over star-schema tables: suppliers, customers, orders and their lines.

Suppliers are companies, customers are buying organisations, orders are tenders. The supplier of an order's dearest
line is its winner, the other suppliers are bidders. A supplier's industry is its most frequent part brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import store
from ..operators.views import Graph
from ..session import scratch

AS_OF = "2001-08-02"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
CLOSING_DAYS = 45  # from a tender's date to its closing date


def _entity(df: DataFrame, kind: str, uid, name, attributes: dict) -> DataFrame:
    pairs = [x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))]
    values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(
        uid.alias("uid"), F.lit(kind).alias("kind"), name.alias("name"), X.canonical(name).alias("canonical_name"), values.alias("attributes"),
        F.lit("star").alias("source"), F.lit(1.0).alias("confidence"), F.lit(AS_OF).alias("created_at"), F.lit(AS_OF).alias("updated_at"),
    )


def _relation(df: DataFrame, kind: str, source, target, attributes: dict | None = None, valid_from=None) -> DataFrame:
    pairs = [x for k, v in (attributes or {}).items() for x in (F.lit(k), v.cast("string"))]
    values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    none = F.lit(None).cast("string")
    return df.select(
        X.relation_id(source, F.lit(kind), target).alias("id"), source.alias("source_uid"), target.alias("target_uid"), F.lit(kind).alias("kind"),
        F.lit(1.0).alias("confidence"), F.lit("star").alias("source"), values.alias("attributes"), (valid_from if valid_from is not None else none).alias("valid_from"),
        none.alias("valid_to"), F.lit(AS_OF).alias("created_at"),
    )


def graph(spark: SparkSession, folder: str) -> Graph:
    """The graph of the tables region, nation, customer, supplier, part, orders and lineitem under ``folder``."""
    t = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in TABLES}
    key = lambda prefix, c: X.uid(prefix, F.col(c) + 1)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    tender = t["orders"].select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", day.alias("day"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), CLOSING_DAYS), "yyyy-MM-dd").alias("closing"))
    lines = t["lineitem"].select("l_orderkey", "l_suppkey", "l_extendedprice", "l_partkey", "l_linenumber", "l_quantity")
    # An order's lines are few, so its suppliers and its winning line come from one aggregation.
    best = F.min(F.struct((-F.col("l_extendedprice")).alias("p"), F.col("l_suppkey").alias("s"), "l_partkey", "l_linenumber", "l_quantity")).alias("best")
    offers = lines.groupBy("l_orderkey").agg(best, F.collect_set("l_suppkey").alias("suppliers"))
    awards = offers.select("l_orderkey", F.col("best.s").alias("l_suppkey"), (-F.col("best.p")).alias("price"))
    bids = offers.select("l_orderkey", F.explode(F.filter("suppliers", lambda s: s != F.col("best.s"))).alias("l_suppkey"))
    brand = t["lineitem"].select("l_suppkey", "l_partkey").join(t["part"].select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    brand = brand.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n")).groupBy("l_suppkey").agg(F.min(F.struct((-F.col("n")).alias("n"), "p_brand")).alias("b")).select("l_suppkey", F.col("b.p_brand").alias("brand"))
    brands = t["part"].select("p_brand").distinct()
    industry = lambda c: F.concat(F.lit("IND-"), F.lpad(F.regexp_extract(c, r"(\d+)$", 1), 8, "0"))
    place = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))  # both of fixed size
    home = t["supplier"].join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    entities = [
        _entity(home, "company", key("CMP", "s_suppkey"), F.col("s_name"), {"city": F.col("n_name"), "province": F.col("r_name")}),
        _entity(t["customer"].join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")), "organization", key("ORG", "c_custkey"), F.col("c_name"), {"city": F.col("n_name"), "province": F.col("r_name"), "segment": F.col("c_mktsegment")}),
        _entity(tender, "tender", key("TEN", "o_orderkey"), F.concat(F.lit("Tender "), F.col("o_orderkey").cast("string")), {"value": F.col("o_totalprice"), "valid_from": F.col("day"), "closing_date": F.col("closing"), "category": F.col("o_orderpriority")}),
        _entity(t["nation"], "city", key("CTY", "n_nationkey"), F.col("n_name"), {}),
        _entity(t["region"], "province", key("PRV", "r_regionkey"), F.col("r_name"), {}),
        _entity(brands, "industry", industry(F.col("p_brand")), F.col("p_brand"), {}),
    ]
    relations = [
        _relation(tender, "issued_by", key("TEN", "o_orderkey"), key("ORG", "o_custkey"), valid_from=F.col("day")),
        _relation(awards, "awarded_to", key("CMP", "l_suppkey"), key("TEN", "l_orderkey"), {"contract_value": F.col("price")}),
        _relation(bids, "submitted_bid", key("CMP", "l_suppkey"), key("TEN", "l_orderkey")),
        _relation(brand, "in_industry", key("CMP", "l_suppkey"), industry(F.col("brand"))),
        _relation(home, "in_city", key("CMP", "s_suppkey"), key("CTY", "n_nationkey")),
        _relation(home, "in_province", key("CMP", "s_suppkey"), key("PRV", "r_regionkey")),
    ]
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return Graph(union(entities), union(relations), AS_OF)


def signs(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> str:
    """When the files of the tables were written, and their bytes."""
    out = []
    for n in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength()) if fs.exists(at) else None)
    return str(out)


_KEPT: dict[tuple, tuple[str, Graph]] = {}


def kept(spark: SparkSession, folder: str) -> Graph:
    """``graph``, written once to the shared folder with both tables partitioned by kind, and read from there ever after:
    all queries of a session on one folder are queries on one stored graph, whose views are stored as well. A graph is
    stored anew when a table's files have changed or the stored ones are gone."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    now = signs(spark, folder)
    key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), folder)
    if key in _KEPT and _KEPT[key][0] == now:
        at = jvm.org.apache.hadoop.fs.Path(_KEPT[key][1].entities.inputFiles()[0])
        if at.getFileSystem(conf).exists(at):
            return _KEPT[key][1]
    at = scratch(spark, "graph")
    store.save(graph(spark, folder), at)
    _KEPT[key] = (now, store.read(spark, at, AS_OF, kept=True))
    return _KEPT[key][1]
