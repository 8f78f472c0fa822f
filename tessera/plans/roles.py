"""Domain roles on the driver's star-schema tables.

code = customer; dimensions = nation (substrate) and region (finish_applied, reached
through the customer's nation); ordered steps = orders (ordered by order date, then
key); step -> material links = lineitem; material = part in a supplier's variant (NULL for
every fourth supplier, which exercises the NULL-safe material key); composition = (part,
variant, supplier) with min discount / max tax (in percent) as low / high; chemical = supplier, with a JSON
hazard text built from its nation and a hazard level bucketed from the account balance.

``ROLE_SQL`` is the same mapping as DuckDB CTEs for the oracle queries.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class LazyTables(Mapping):
    """Tables that are opened when they are first asked for."""

    def __init__(self, makers: dict):
        self.makers, self.opened = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.makers[name]()
        return self.opened[name]

    def __contains__(self, name) -> bool:
        return name in self.makers

    def __iter__(self):
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def _null(t: str = "string"):
    return F.lit(None).cast(t)


def hazard_level(acctbal) -> F.Column:
    """Level 1-5 in steps of 2000 of account balance; negative balance -> NULL."""
    return F.when(acctbal < 0, _null("int")).otherwise(
        F.least(F.lit(5), F.floor(acctbal / 2000) + 1).cast("int"))


def variant(suppkey) -> F.Column:
    """A line's material variant: its supplier, or none for every fourth supplier."""
    return F.when(suppkey % 4 != 0, F.concat(F.lit("V"), suppkey.cast("string")))


def domain_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The domain tables (natural keys) derived from the driver tables, each opened when used.

    A material is a part in one supplier's variant (or without variant, for every fourth
    supplier), so a code reaches the chemicals of its own line items and not of all suppliers
    of their parts."""
    def t(name):
        return read(spark, sf_dir, name)

    def lines():
        return t("lineitem").select(F.col("l_orderkey").alias("sft_code"), F.col("l_partkey").alias("base_spec"),
                                    variant(F.col("l_suppkey")).alias("variant"), F.col("l_suppkey").alias("cas"),
                                    "l_discount", "l_tax")

    def substrates():
        return t("nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("description"),
                                  _null().alias("source_doc"), F.lit("").alias("program"))

    def finish_applied():
        return t("region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("description"),
                                  _null().alias("source_doc"), F.lit("").alias("program"),
                                  F.concat(F.lower("r_name"), F.lit(" spec,, general")).alias("associated_specs"))

    def finish_codes():
        customer, nation = t("customer"), t("nation")
        return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(
            F.col("c_custkey").alias("code"), F.lit("").alias("program"), F.col("c_nationkey").alias("substrate_code"),
            F.col("n_regionkey").alias("finish_applied_code"), F.col("c_custkey").alias("seq_id"),
            F.col("c_name").alias("description"), F.col("c_mktsegment").alias("notes"), _null().alias("source_doc"),
            F.when(F.col("c_custkey") % 3 != 0, F.concat(F.col("c_mktsegment"), F.lit(" , "), F.col("c_name")))
            .alias("associated_specs"))

    def sft_steps():
        return t("orders").select(
            F.col("o_orderkey").alias("sft_code"), F.col("o_orderstatus").alias("parent_group"),
            F.col("o_orderpriority").alias("description"), _null().alias("associated_specs"),
            _null().alias("source_doc"), F.col("o_orderdate").cast("date").cast("string").alias("last_review"),
            _null().alias("notes"))

    def finish_code_steps():
        return t("orders").select(
            F.col("o_custkey").alias("finish_code"), F.lit("").alias("program"), F.col("o_orderkey").alias("sft_code"),
            F.col("o_orderdate").cast("date").alias("step_order"))

    def materials():
        part = t("part").select("p_partkey", F.col("p_name").alias("description"), F.col("p_type").alias("notes"))
        keys = lines().select("base_spec", "variant").distinct()
        return keys.join(part, keys["base_spec"] == part["p_partkey"]).drop("p_partkey")

    def sft_material_links():
        return lines().select("sft_code", "base_spec", "variant", _null().alias("note"))

    def chemicals():
        supplier, nation = t("supplier"), t("nation")
        flags = F.concat(F.lit('{"ghs":[],"categories":["'), F.col("n_name"), F.lit('"],"signal_word":"'),
                         F.when(F.col("s_acctbal") >= 6000, F.lit("DANGER")).otherwise(F.lit("WARNING")),
                         F.lit('","un_number":"'), F.col("s_suppkey").cast("string"), F.lit('"}'))
        return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
            F.col("s_name").alias("name"), F.col("s_suppkey").alias("cas"), flags.alias("hazard_flags"),
            hazard_level(F.col("s_acctbal")).alias("default_hazard_level"))

    def material_chemicals():
        return (lines().groupBy("base_spec", "variant", "cas")
                .agg((F.round(F.min("l_discount") * 100, 2) + F.lit(0.0)).alias("pct_wt_low"),
                     (F.round(F.max("l_tax") * 100, 2) + F.lit(0.0)).alias("pct_wt_high"))
                .withColumn("notes", _null()))

    def metadata_versions():
        return t("region").select(F.concat(F.lower("r_name"), F.lit(".csv")).alias("source_name"),
                                  F.sha2("r_name", 256).alias("sha256"), F.lit(1).cast("long").alias("rows_loaded"),
                                  F.timestamp_seconds(F.lit(1_700_000_000) + F.col("r_regionkey") * 60)
                                  .alias("loaded_at"))

    return LazyTables({f.__name__: f for f in (substrates, finish_applied, finish_codes, sft_steps, finish_code_steps,
                                               materials, sft_material_links, chemicals, material_chemicals,
                                               metadata_versions)})


ROLE_SQL = r"""
WITH
substrates AS (SELECT n_nationkey AS code, n_name AS description, CAST(NULL AS VARCHAR) AS source_doc,
                      '' AS program FROM nation),
finish_applied AS (SELECT r_regionkey AS code, r_name AS description, CAST(NULL AS VARCHAR) AS source_doc,
                          '' AS program, lower(r_name) || ' spec,, general' AS associated_specs FROM region),
finish_codes AS (SELECT c.c_custkey AS code, '' AS program, c.c_nationkey AS substrate_code,
                        n.n_regionkey AS finish_applied_code, c.c_custkey AS seq_id, c.c_name AS description,
                        c.c_mktsegment AS notes, CAST(NULL AS VARCHAR) AS source_doc,
                        CASE WHEN c.c_custkey % 3 <> 0 THEN c.c_mktsegment || ' , ' || c.c_name END AS associated_specs
                 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
sft_steps AS (SELECT o_orderkey AS sft_code, o_orderstatus AS parent_group, o_orderpriority AS description,
                     CAST(NULL AS VARCHAR) AS associated_specs, CAST(NULL AS VARCHAR) AS source_doc,
                     CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS last_review, CAST(NULL AS VARCHAR) AS notes
              FROM orders),
finish_code_steps AS (SELECT o_custkey AS finish_code, '' AS program, o_orderkey AS sft_code,
                             CAST(o_orderdate AS DATE) AS step_order FROM orders),
lines AS (SELECT l_orderkey AS sft_code, l_partkey AS base_spec,
                 CASE WHEN l_suppkey % 4 <> 0 THEN 'V' || CAST(l_suppkey AS VARCHAR) END AS variant,
                 l_suppkey AS cas, l_discount, l_tax FROM lineitem),
materials AS (SELECT k.base_spec, k.variant, p.p_name AS description, p.p_type AS notes
              FROM (SELECT DISTINCT base_spec, variant FROM lines) k JOIN part p ON k.base_spec = p.p_partkey),
sft_material_links AS (SELECT sft_code, base_spec, variant, CAST(NULL AS VARCHAR) AS note FROM lines),
chemicals AS (SELECT s.s_name AS name, s.s_suppkey AS cas,
                     '{"ghs":[],"categories":["' || n.n_name || '"],"signal_word":"'
                       || CASE WHEN s.s_acctbal >= 6000 THEN 'DANGER' ELSE 'WARNING' END || '","un_number":"'
                       || CAST(s.s_suppkey AS VARCHAR) || '"}' AS hazard_flags,
                     CASE WHEN s.s_acctbal < 0 THEN NULL
                          ELSE CAST(least(5, floor(s.s_acctbal / 2000) + 1) AS INTEGER) END AS default_hazard_level
              FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey),
material_chemicals AS (SELECT base_spec, variant, cas, round(min(l_discount) * 100, 2) + 0.0 AS pct_wt_low,
                              round(max(l_tax) * 100, 2) + 0.0 AS pct_wt_high, CAST(NULL AS VARCHAR) AS notes
                       FROM lines GROUP BY base_spec, variant, cas)
"""
