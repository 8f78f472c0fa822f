"""Registered queries over keyed snapshots written from the driver tables, over whole trees, and of operators that no
other query shows (P6, F8, F9, S21, V2)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import hierarchy as H
from tessera.operators import trees
from tessera.operators.upsert import latest_by_key, list_last_positions
from tessera.plans.registry import register
from tessera.plans.roles import ROLE_SQL, domain_tables, read
from tessera.session import checkpoint_dir
from tessera.sources import snapshots


def _root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex}"


@register("snapshot_upsert", """
WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS d, o_orderstatus <> 'F' AS late
           FROM orders)
SELECT o_custkey, arg_max(o_orderkey, (late, d, o_orderkey)) AS o_orderkey,
       arg_max(o_totalprice, (late, d, o_orderkey)) AS o_totalprice, CAST(min(d) AS VARCHAR) AS first_date
FROM o GROUP BY o_custkey
""")
def q_snapshot_upsert(spark, sf_dir):
    """A snapshot with each customer's last fulfilled order, upserted with all other orders: their last one wins,
    the customer's first date stays, and only buckets that are touched are written again."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus",
                                                  F.col("o_orderdate").cast("date").alias("first_date"))
    done = latest_by_key(orders.filter("o_orderstatus = 'F'").withColumn("_d", F.col("first_date")), ["o_custkey"],
                         ["_d", "o_orderkey"], first_seen="first_date", first_seen_as="first_date")
    first = snapshots.create(done.select("o_custkey", "o_orderkey", "o_totalprice", "first_date"), _root(spark),
                             ["o_custkey"], buckets=8)
    late = orders.filter("o_orderstatus <> 'F'").withColumn("_d", F.col("first_date"))
    return (first.upsert(late, ["_d", "o_orderkey"], created_col="first_date").read()
            .withColumn("first_date", F.col("first_date").cast("string")))


_TREE_SQL = ROLE_SQL + """,
wanted AS (SELECT finish_code AS code FROM finish_code_steps GROUP BY finish_code
           ORDER BY count(*) DESC, finish_code LIMIT 5),
t AS (SELECT fc.code AS finish_code, s.description AS substrate, cs.sft_code, cs.step_order, l.base_spec, l.variant,
             c.name, mc.pct_wt_high
      FROM wanted w JOIN finish_codes fc ON w.code = fc.code
      JOIN substrates s ON fc.substrate_code = s.code AND fc.program = s.program
      JOIN finish_code_steps cs ON fc.code = cs.finish_code AND fc.program = cs.program
      LEFT JOIN (sft_material_links l JOIN materials m ON l.base_spec = m.base_spec
                 AND l.variant IS NOT DISTINCT FROM m.variant) ON cs.sft_code = l.sft_code
      LEFT JOIN (material_chemicals mc JOIN chemicals c ON mc.cas = c.cas) ON l.base_spec = mc.base_spec
                 AND l.variant IS NOT DISTINCT FROM mc.variant)
SELECT finish_code, substrate, sft_code, CAST(step_order AS VARCHAR) AS step_order, base_spec, variant, name, pct_wt_high
FROM t
"""

_KEYS = {"finish_codes": ["code"], "finish_code_steps": ["finish_code", "sft_code"], "sft_steps": ["sft_code"],
         "materials": ["base_spec", "variant"], "chemicals": ["cas"], "material_chemicals": ["base_spec", "variant", "cas"],
         "substrates": ["code"], "finish_applied": ["code"]}


@register("snapshot_trees", _TREE_SQL)
def q_snapshot_trees(spark, sf_dir):
    """P1, Q1 at code grain: the whole trees of the five codes with most steps, looked up in snapshots of the domain
    tables (row groups without the wanted keys are skipped) and written out as rows."""
    t = domain_tables(spark, sf_dir)
    wanted = [r["finish_code"] for r in t["finish_code_steps"].groupBy("finish_code").count()
              .orderBy(F.desc("count"), "finish_code").limit(5).collect()]
    snaps = {n: snapshots.create(t[n], _root(spark), keys, buckets=4).read() for n, keys in _KEYS.items()}
    links = _root(spark)
    t["sft_material_links"].sort("sft_code").write.parquet(links)
    snaps["sft_material_links"] = spark.read.parquet(links)
    trees = H.hierarchy(snaps, wanted)
    steps = trees.select("finish_code", F.col("parsed.substrate.description").alias("substrate"),
                         F.explode("steps").alias("s"))
    mats = steps.select("finish_code", "substrate", "s.sft_code", F.col("s.step_order").cast("string").alias("step_order"),
                        F.explode_outer("s.materials").alias("m"))
    return mats.select("finish_code", "substrate", "sft_code", "step_order", "m.base_spec", "m.variant",
                       F.explode_outer("m.chemicals").alias("c")).select(
        "finish_code", "substrate", "sft_code", "step_order", "base_spec", "variant", "c.name", "c.pct_wt_high")


@register("code_trees", ROLE_SQL + """,
codes AS (SELECT fc.code, s.description AS substrate FROM finish_codes fc
          JOIN substrates s ON fc.substrate_code = s.code AND fc.program = s.program
          JOIN finish_applied fa ON fc.finish_applied_code = fa.code AND fc.program = fa.program),
st AS (SELECT cs.finish_code, cs.step_order, cs.sft_code FROM finish_code_steps cs JOIN sft_steps x USING (sft_code)
       JOIN codes ON cs.finish_code = codes.code),
l AS (SELECT l.sft_code, l.base_spec, l.variant, row_number() OVER (PARTITION BY l.sft_code, l.base_spec, l.variant) AS k
      FROM sft_material_links l JOIN materials m ON l.base_spec = m.base_spec
           AND l.variant IS NOT DISTINCT FROM m.variant),
mt AS (SELECT st.*, l.base_spec, l.variant, l.k FROM st JOIN l USING (sft_code)),
r AS (SELECT code AS finish_code, NULL AS step_order, NULL AS sft_code, NULL AS base_spec, NULL AS variant, NULL AS k,
             NULL AS lv, NULL AS name, 0 AS kind, CAST(code AS VARCHAR) AS line FROM codes
      UNION ALL SELECT finish_code, step_order, sft_code, NULL, NULL, NULL, NULL, NULL, 1,
                       CAST(sft_code AS VARCHAR) || '@' || CAST(step_order AS VARCHAR) FROM st
      UNION ALL SELECT finish_code, step_order, sft_code, base_spec, variant, k, NULL, NULL, 2,
                       CAST(base_spec AS VARCHAR) || '/' || coalesce(variant, '') FROM mt
      UNION ALL SELECT finish_code, step_order, sft_code, mt.base_spec, mt.variant, k,
                       coalesce(-c.default_hazard_level, 2147483647), c.name, 3, c.name || ' ' || CAST(c.cas AS VARCHAR)
      FROM mt JOIN material_chemicals mc ON mt.base_spec = mc.base_spec AND mt.variant IS NOT DISTINCT FROM mc.variant
           JOIN chemicals c ON mc.cas = c.cas)
SELECT finish_code, count(*) FILTER (WHERE kind = 1) AS n_steps, count(*) FILTER (WHERE kind = 2) AS n_materials,
       count(*) FILTER (WHERE kind = 3) AS n_chemicals,
       sha256(string_agg(line || chr(10), '' ORDER BY step_order NULLS FIRST, sft_code NULLS FIRST,
              base_spec NULLS FIRST, variant NULLS FIRST, k NULLS FIRST, lv NULLS FIRST, name NULLS FIRST, kind))
       AS tree_sha
FROM r GROUP BY finish_code
""")
def q_code_trees(spark, sf_dir):
    """Q1, A11 at code grain: every code's whole tree, streamed in the order of its document into a digest."""
    rows = trees.tree_rows(domain_tables(spark, sf_dir))
    kind, text = F.col("kind"), lambda c: F.col(c).cast("string")
    line = (F.when(kind == 0, text("finish_code"))
            .when(kind == 1, F.concat(text("sft_code"), F.lit("@"), text("step_order")))
            .when(kind == 2, F.concat(text("base_spec"), F.lit("/"), F.coalesce("variant", F.lit(""))))
            .otherwise(F.concat("name", F.lit(" "), text("cas"))))
    return trees.tree_digests(rows, line)


@register("requested_links", ROLE_SQL + """
SELECT l.sft_code, count(*) AS n_links, count(DISTINCT l.base_spec) AS n_specs
FROM sft_material_links l
WHERE l.sft_code IN (SELECT sft_code FROM finish_code_steps WHERE finish_code IN
                     (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
GROUP BY l.sft_code
""")
def q_requested_links(spark, sf_dir):
    """The links that a table of requested codes (those of one segment) reaches, by semi joins level by level."""
    codes = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("code"))
    links = H._restrict(domain_tables(spark, sf_dir), codes)["sft_material_links"]
    return links.groupBy("sft_code").agg(F.count(F.lit(1)).alias("n_links"),
                                         F.count_distinct("base_spec").alias("n_specs"))


@register("hazard_errors", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN substring(props, 1, length(props) - 1) ELSE props END AS raw
           FROM events)
SELECT event_id, raw, 'invalid JSON' AS error FROM e WHERE raw IS NOT NULL AND NOT json_valid(raw)
""")
def q_hazard_errors(spark, sf_dir):
    """F8's error form: texts that are no JSON (here every third event's, cut short) with the raw text kept."""
    raw = F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    e = read(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    _, valid = H.parsed_hazard(F.col("raw"))
    return e.filter(~valid).select("event_id", "raw", F.lit("invalid JSON").alias("error"))


@register("json_list_steps", """
WITH l AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, regexp_replace(unnest(a), '^\\s+|\\s+$', '', 'g') AS item, unnest(generate_series(1, len(a))) AS pos
      FROM l)
SELECT doc_id, item, max(pos) AS pos FROM e WHERE item <> '' GROUP BY doc_id, item
""")
def q_json_list_steps(spark, sf_dir):
    """F9's JSON path, W2, W3: each document's words as a JSON array text, blanks keep their place."""
    d = read(spark, sf_dir, "documents").filter("text is not null").select(
        "doc_id", F.to_json(F.split("text", " ")).alias("list"))
    out = list_last_positions(d, "list", ["doc_id"])
    return out.select("doc_id", "item", F.col("pos").cast("long").alias("pos"))


@register("audit_absent_tables", """
SELECT 'orders' AS "table", 'o_custkey' AS "column", 'missing_parent_table' AS issue, CAST(NULL AS BIGINT) AS n,
       'Parent table ''warehouse'' does not exist' AS details
UNION ALL
SELECT 'lineitem', 'l_orderkey', 'orphan_fk', count(*), CAST(count(*) AS VARCHAR)
       || ' rows reference non-existent open_orders.o_orderkey values'
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
""")
def q_audit_absent_tables(spark, sf_dir):
    """An absent parent table is an issue, an absent child table none, and other keys are audited."""
    orders = read(spark, sf_dir, "orders")
    t = {"orders": orders, "open_orders": orders.filter("o_orderstatus = 'O'"),
         "lineitem": read(spark, sf_dir, "lineitem")}
    rules = A.Rules(foreign_keys=[A.ForeignKey("orders", ("o_custkey",), "warehouse", ("w_key",)),
                                  A.ForeignKey("returns", ("r_orderkey",), "orders", ("o_orderkey",)),
                                  A.ForeignKey("lineitem", ("l_orderkey",), "open_orders", ("o_orderkey",))])
    return A.issues(spark, t, rules).select("table", "column", "issue", "n", "details")
