"""Registered queries on the driver tables and their DuckDB oracle SQL.

Every query reads whole tables (or tables Spark derives from them) and returns flat
scalar columns so the oracle can compare values. Lists appear as ';'/',' joined text,
bounded where the group is not (first-k), and timestamps as epoch microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import json_is_valid, short_hash
from tessera.functions.text import SPEC_PREFIXES, boundary
from tessera.operators import audit as A
from tessera.operators import catalogue as C
from tessera.operators import hierarchy as H
from tessera.operators import textjobs as X
from tessera.operators.joins import resolve
from tessera.operators.upsert import latest_by_key, list_last_positions
from tessera.plans.registry import QUERIES, register  # noqa: F401
from tessera.plans.roles import ROLE_SQL, LazyTables, domain_tables, read

# ---------------------------------------------------------------- hierarchy ----

@register("expanded_codes", ROLE_SQL + """
SELECT fc.code, fc.seq_id, fc.description AS finish_description, fc.notes, fc.source_doc, fc.program,
       fc.associated_specs AS finish_code_specs, s.code AS substrate_code, s.description AS substrate_description,
       s.source_doc AS substrate_source_doc, s.program AS substrate_program, fa.code AS finish_applied_code,
       fa.description AS finish_applied_description, fa.source_doc AS finish_applied_source_doc,
       fa.program AS finish_applied_program, fa.associated_specs AS finish_applied_specs
FROM finish_codes fc
JOIN substrates s ON fc.substrate_code = s.code AND fc.program = s.program
JOIN finish_applied fa ON fc.finish_applied_code = fa.code AND fc.program = fa.program
""")
def q_expanded_codes(spark, sf_dir):
    return H.expanded_codes(domain_tables(spark, sf_dir))


@register("code_list", ROLE_SQL + """
SELECT fc.code, fc.description, s.description AS substrate, fa.description AS finish_applied, fc.seq_id,
       fc.source_doc, fc.program
FROM finish_codes fc
JOIN substrates s ON fc.substrate_code = s.code AND fc.program = s.program
JOIN finish_applied fa ON fc.finish_applied_code = fa.code AND fc.program = fa.program
ORDER BY fc.code
""")
def q_code_list(spark, sf_dir):
    return H.code_list(domain_tables(spark, sf_dir))


@register("hierarchy_flat", ROLE_SQL + """
SELECT fc.code AS finish_code, s.code AS substrate_code, s.description AS substrate_desc,
       fa.code AS finish_applied_code, fa.description AS finish_applied_desc, fc.seq_id,
       st.sft_code, st.description AS sft_desc, cs.step_order, m.base_spec, m.variant,
       c.name AS chemical_name, c.cas, c.hazard_flags, mc.pct_wt_low, mc.pct_wt_high
FROM finish_codes fc
JOIN substrates s ON fc.substrate_code = s.code AND fc.program = s.program
JOIN finish_applied fa ON fc.finish_applied_code = fa.code AND fc.program = fa.program
JOIN finish_code_steps cs ON fc.code = cs.finish_code AND fc.program = cs.program
JOIN sft_steps st ON cs.sft_code = st.sft_code
LEFT JOIN sft_material_links l ON st.sft_code = l.sft_code
LEFT JOIN materials m ON l.base_spec = m.base_spec AND l.variant IS NOT DISTINCT FROM m.variant
LEFT JOIN material_chemicals mc ON m.base_spec = mc.base_spec AND m.variant IS NOT DISTINCT FROM mc.variant
LEFT JOIN chemicals c ON mc.cas = c.cas
""")
def q_hierarchy_flat(spark, sf_dir):
    return H.flat_tree(domain_tables(spark, sf_dir))


@register("hierarchy_summary", ROLE_SQL + """,
st AS (SELECT finish_code, count(*) AS n_steps, arg_min(sft_code, (step_order, sft_code)) AS first_step,
              arg_max(sft_code, (step_order, sft_code)) AS last_step
       FROM finish_code_steps GROUP BY finish_code),
cml AS (SELECT cs.finish_code, l.base_spec, l.variant, count(*) AS n
        FROM finish_code_steps cs JOIN sft_material_links l ON cs.sft_code = l.sft_code
        GROUP BY cs.finish_code, l.base_spec, l.variant),
lk AS (SELECT finish_code, CAST(sum(n) AS BIGINT) AS n_links, count(*) AS n_materials FROM cml GROUP BY finish_code),
cm AS (SELECT finish_code, base_spec, variant FROM cml),
cc AS (SELECT DISTINCT cm.finish_code, mc.cas FROM cm JOIN material_chemicals mc
       ON cm.base_spec = mc.base_spec AND cm.variant IS NOT DISTINCT FROM mc.variant),
ch AS (SELECT cc.finish_code, count(*) AS n_chemicals, max(c.default_hazard_level) AS max_level
       FROM cc JOIN chemicals c ON cc.cas = c.cas GROUP BY cc.finish_code)
SELECT fc.code AS finish_code, coalesce(st.n_steps, 0) AS n_steps, st.first_step, st.last_step,
       coalesce(lk.n_links, 0) AS n_links, coalesce(lk.n_materials, 0) AS n_materials,
       coalesce(ch.n_chemicals, 0) AS n_chemicals, ch.max_level
FROM finish_codes fc LEFT JOIN st ON fc.code = st.finish_code LEFT JOIN lk ON fc.code = lk.finish_code
LEFT JOIN ch ON fc.code = ch.finish_code
""")
def q_hierarchy_summary(spark, sf_dir):
    """Per code: step count, first/last step in order, link/material (distinct (base_spec,
    variant)) /chemical counts and the highest hazard level. All partial aggregates (no
    per-code collection)."""
    t = domain_tables(spark, sf_dir)
    cs = t["finish_code_steps"]
    order = F.struct("step_order", "sft_code")
    st = cs.groupBy("finish_code").agg(F.count(F.lit(1)).alias("n_steps"),
                                       F.min_by("sft_code", order).alias("first_step"),
                                       F.max_by("sft_code", order).alias("last_step"))
    # One (code, material) aggregate feeds the link and material counts and the chemicals.
    cml = H.code_material_links(t)
    lk = cml.groupBy("finish_code").agg(F.sum("n_links").alias("n_links"),
                                        F.count(F.lit(1)).alias("n_materials"))
    ch = (H.code_chemicals(t, cml.select("finish_code", "base_spec", "variant")).groupBy("finish_code")
          .agg(F.count(F.lit(1)).alias("n_chemicals"), F.max("default_hazard_level").alias("max_level")))
    fc = t["finish_codes"].select(F.col("code").alias("finish_code"))
    j = fc.join(st, "finish_code", "left").join(lk, "finish_code", "left").join(ch, "finish_code", "left")
    return j.select("finish_code", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), "first_step", "last_step",
                    F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("n_materials", F.lit(0)).alias("n_materials"),
                    F.coalesce("n_chemicals", F.lit(0)).alias("n_chemicals"), "max_level")


@register("hierarchy_steps", ROLE_SQL + """,
ch AS (SELECT mc.base_spec, mc.variant,
              string_agg(c.name, ',' ORDER BY c.default_hazard_level DESC NULLS LAST, c.name) AS names
       FROM material_chemicals mc JOIN chemicals c ON mc.cas = c.cas GROUP BY mc.base_spec, mc.variant),
m AS (SELECT l.sft_code, CAST(l.base_spec AS VARCHAR) || '/' || coalesce(l.variant, '') AS key, l.base_spec, l.variant,
             coalesce(ch.names, '') AS names
      FROM sft_material_links l JOIN materials k ON l.base_spec = k.base_spec AND l.variant IS NOT DISTINCT FROM k.variant
      LEFT JOIN ch ON l.base_spec = ch.base_spec AND l.variant IS NOT DISTINCT FROM ch.variant),
g AS (SELECT sft_code, string_agg(key || '[' || names || ']', ';' ORDER BY base_spec, variant NULLS FIRST) AS materials
      FROM m GROUP BY sft_code)
SELECT cs.finish_code, cs.sft_code, CAST(cs.step_order AS VARCHAR) AS step_order, st.parent_group,
       coalesce(g.materials, '') AS materials
FROM finish_code_steps cs JOIN sft_steps st ON cs.sft_code = st.sft_code LEFT JOIN g ON cs.sft_code = g.sft_code
""")
def q_hierarchy_steps(spark, sf_dir):
    """Q1 at step grain (J5, A11, O3): per (code, step) its materials in order, each with its
    chemicals in order, written out from the nested column; a step without links has none."""
    d = H.step_documents(domain_tables(spark, sf_dir), material=("base_spec", "variant"), chemical=("name",))
    material = F.transform("materials", lambda m: F.concat(
        m["base_spec"].cast("string"), F.lit("/"), F.coalesce(m["variant"], F.lit("")), F.lit("["),
        F.array_join(F.transform(m["chemicals"], lambda c: c["name"]), ","), F.lit("]")))
    return d.select("finish_code", "sft_code", F.col("step_order").cast("string").alias("step_order"), "parent_group",
                    F.array_join(material, ";").alias("materials"))


@register("code_headers", ROLE_SQL + """
SELECT fc.code AS finish_code, s.description AS substrate, fa.description AS finish_applied,
       CASE WHEN fc.associated_specs IS NULL THEN '' ELSE array_to_string(list_filter(list_transform(
            string_split(fc.associated_specs, ','), lambda x: trim(x)), lambda x: x <> ''), '|') END AS direct_specs,
       array_to_string(list_filter(list_transform(string_split(fa.associated_specs, ','), lambda x: trim(x)),
                                   lambda x: x <> ''), '|') AS finish_applied_specs,
       (SELECT CAST(1700000000 + max(r_regionkey) * 60 AS BIGINT) FROM region) AS loaded_s,
       (SELECT sha256(r_name) FROM region WHERE r_regionkey = 0) AS first_sha
FROM finish_codes fc
JOIN substrates s ON fc.substrate_code = s.code AND fc.program = s.program
JOIN finish_applied fa ON fc.finish_applied_code = fa.code AND fc.program = fa.program
""")
def q_code_headers(spark, sf_dir):
    """Q8 and Q9: a code's own and its finish's specifications, and the load behind them."""
    t = domain_tables(spark, sf_dir)
    first = F.concat(F.lower("r_name"), F.lit(".csv"))
    name = read(spark, sf_dir, "region").filter("r_regionkey = 0").select(first).scalar()
    return H.code_headers(t).select(
        "finish_code", F.col("parsed.substrate.description").alias("substrate"),
        F.col("parsed.finish_applied.description").alias("finish_applied"),
        F.array_join("direct_specs", "|").alias("direct_specs"),
        F.array_join("finish_applied_specs", "|").alias("finish_applied_specs"),
        F.unix_seconds("provenance.loaded_at").alias("loaded_s"),
        F.try_element_at("provenance.csv_shas", name).alias("first_sha"))


@register("material_profiles", ROLE_SQL + """
SELECT mc.base_spec, mc.variant, count(*) AS n_chemicals,
       string_agg(c.name, ',' ORDER BY c.default_hazard_level DESC NULLS LAST, c.name) AS chemical_names,
       max(c.default_hazard_level) AS top_level,
       round(sum(mc.pct_wt_high), 2) AS total_high
FROM material_chemicals mc JOIN chemicals c ON mc.cas = c.cas
GROUP BY mc.base_spec, mc.variant
""")
def q_material_profiles(spark, sf_dir):
    """The nested chemical level of the hierarchy (A11, O3) per material: one array per
    material (part in one variant), ordered level desc (NULL last), name asc."""
    t = domain_tables(spark, sf_dir)
    cpm = H.chemicals_per_material(t, ("name", "default_hazard_level", "pct_wt_high"))
    return cpm.select("base_spec", "variant", F.size("chemicals").cast("long").alias("n_chemicals"),
                      F.array_join(F.transform("chemicals", lambda x: x["name"]), ",").alias("chemical_names"),
                      F.col("chemicals")[0]["default_hazard_level"].alias("top_level"),
                      F.round(F.aggregate("chemicals", F.lit(0.0), lambda acc, x: acc + x["pct_wt_high"]), 2)
                      .alias("total_high"))


@register("code_lookup", ROLE_SQL + """,
req AS (SELECT DISTINCT o_orderkey AS requested FROM orders),
avail AS (SELECT string_agg(CAST(code AS VARCHAR), ',' ORDER BY code) AS a
          FROM (SELECT code FROM finish_codes ORDER BY code LIMIT 10)),
e AS (SELECT fc.code, s.description AS substrate, fa.description AS finish_applied
      FROM finish_codes fc JOIN substrates s ON fc.substrate_code = s.code AND fc.program = s.program
      JOIN finish_applied fa ON fc.finish_applied_code = fa.code AND fc.program = fa.program)
SELECT req.requested, CASE WHEN e.code IS NULL THEN 'not_found' ELSE 'found' END AS status,
       e.substrate, e.finish_applied,
       CASE WHEN e.code IS NULL THEN (SELECT a FROM avail) END AS available_codes
FROM req LEFT JOIN e ON req.requested = e.code
""")
def q_code_lookup(spark, sf_dir):
    """P1 + P2 + O2 over a whole request list (every order key presented as a code):
    found codes get their dimension names, unknown ones the first 10 codes."""
    t = domain_tables(spark, sf_dir)
    req = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("requested")).distinct()
    e = H.expanded_codes(t).select("code", F.col("substrate_description").alias("substrate"),
                                   F.col("finish_applied_description").alias("finish_applied"))
    avail = (t["finish_codes"].select("code").orderBy("code").limit(10)
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list("code")), lambda x: x.cast("string")), ",")
                  .alias("a")).scalar())
    j = req.join(e, req["requested"] == e["code"], "left")
    miss = F.col("code").isNull()
    return j.select("requested", F.when(miss, "not_found").otherwise("found").alias("status"), "substrate",
                    "finish_applied", F.when(miss, avail).alias("available_codes"))


@register("hazard_filter", ROLE_SQL + """
SELECT name, cas, hazard_flags, json_valid(hazard_flags) AS hazard_flags_valid,
       json_extract_string(hazard_flags, '$.un_number') AS un_number, default_hazard_level
FROM chemicals WHERE default_hazard_level >= 3
ORDER BY default_hazard_level DESC, name
""")
def q_hazard_filter(spark, sf_dir):
    c = H.chemicals_by_hazard(domain_tables(spark, sf_dir)["chemicals"], 3)
    return c.select("name", "cas", "hazard_flags", "hazard_flags_valid",
                    F.try_variant_get("hazard_flags_parsed", "$.un_number", "string").alias("un_number"),
                    "default_hazard_level")


@register("hazard_view", ROLE_SQL + """
SELECT name, cas, hazard_flags, json_valid(hazard_flags) AS hazard_flags_valid, default_hazard_level
FROM chemicals ORDER BY default_hazard_level DESC NULLS LAST, name
""")
def q_hazard_view(spark, sf_dir):
    c = H.chemicals_by_hazard(domain_tables(spark, sf_dir)["chemicals"], None)
    return c.select("name", "cas", "hazard_flags", "hazard_flags_valid", "default_hazard_level")


@register("code_chemicals", ROLE_SQL + """
SELECT DISTINCT cs.finish_code, c.name, c.cas, c.hazard_flags, c.default_hazard_level
FROM finish_code_steps cs
JOIN sft_material_links l ON cs.sft_code = l.sft_code
JOIN material_chemicals mc ON l.base_spec = mc.base_spec AND l.variant IS NOT DISTINCT FROM mc.variant
JOIN chemicals c ON mc.cas = c.cas
""")
def q_code_chemicals(spark, sf_dir):
    return H.code_chemicals(domain_tables(spark, sf_dir))


TAG = "nation_1"


@register("tag_exposure", ROLE_SQL + f"""
SELECT cs.finish_code, count(DISTINCT c.cas) AS tagged_count
FROM finish_code_steps cs
JOIN sft_material_links l ON cs.sft_code = l.sft_code
JOIN material_chemicals mc ON l.base_spec = mc.base_spec AND l.variant IS NOT DISTINCT FROM mc.variant
JOIN chemicals c ON mc.cas = c.cas
WHERE contains(lower(c.hazard_flags), lower('{TAG}'))
GROUP BY cs.finish_code ORDER BY tagged_count DESC, cs.finish_code
""")
def q_tag_exposure(spark, sf_dir):
    return H.tag_exposure(domain_tables(spark, sf_dir), TAG)


# ---------------------------------------------------------------- catalogue ----

_F4 = "list_filter(list_transform(string_split({c}, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), " \
      "lambda x: x <> '')"


def _doc_steps(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    steps = d.select(F.col("doc_id").alias("sft_code"), F.col("text").alias("associated_specs"),
                     F.col("text").alias("description"))
    code_steps = d.select(F.col("source").alias("finish_code"), F.col("doc_id").alias("sft_code"),
                          F.col("doc_id").alias("step_order"))
    return steps, code_steps


_CATALOGUE_SQL = """
WITH items AS (SELECT DISTINCT doc_id AS step, unnest(""" + _F4.format(c="text") + """) AS spec
               FROM documents WHERE text IS NOT NULL AND text <> ''),
cs AS (SELECT DISTINCT doc_id AS step, source AS code FROM documents),
cat AS (SELECT spec, 'step' AS kind, CAST(step AS VARCHAR) AS value FROM items
        UNION ALL SELECT DISTINCT spec, 'code', CAST(code AS VARCHAR) FROM items JOIN cs USING (step)
        WHERE code IS NOT NULL)
"""


@register("spec_catalogue", _CATALOGUE_SQL + "SELECT spec, kind, value FROM cat")
def q_spec_catalogue(spark, sf_dir):
    """Q4 on documents, complete: comma pieces are the specifications, a document is a step
    and its source the code that uses it."""
    return C.spec_catalogue(*_doc_steps(spark, sf_dir))


@register("spec_usage", _CATALOGUE_SQL + """
SELECT spec, count(*) FILTER (WHERE kind = 'code') AS usage_count, count(*) FILTER (WHERE kind = 'step') AS step_count
FROM cat GROUP BY spec ORDER BY usage_count DESC, spec
""")
def q_spec_usage(spark, sf_dir):
    """Specifications by number of codes that reach them."""
    return C.spec_usage(*_doc_steps(spark, sf_dir))


@register("total_specs", _CATALOGUE_SQL + "SELECT count(DISTINCT spec) AS total_specs FROM cat")
def q_total_specs(spark, sf_dir):
    """Number of distinct specifications."""
    return C.total_specs(_doc_steps(spark, sf_dir)[0])


@register("code_specs", """
WITH s AS (SELECT doc_id, source, text FROM documents
           WHERE text IS NOT NULL AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '')
SELECT source AS code, doc_id AS sft_code, doc_id AS step_order,
       array_to_string(""" + _F4.format(c="text") + """, ',') AS specs,
       CASE WHEN length(text) > 80 THEN substring(text, 1, 77) || '...' ELSE text END AS description
FROM s
""")
def q_code_specs(spark, sf_dir):
    """Q5 per step: the step's specification list and its shortened description."""
    rows = C.code_spec_rows(*_doc_steps(spark, sf_dir))
    return rows.select("code", "sft_code", "step_order", F.array_join("associated_specs_list", ",").alias("specs"),
                       "description")


@register("code_spec_list", """
SELECT DISTINCT source AS code, unnest(""" + _F4.format(c="text") + """) AS spec
FROM documents WHERE text IS NOT NULL
""")
def q_code_spec_list(spark, sf_dir):
    """Q5 per code (U2): the distinct specifications of all its steps, as rows."""
    return C.code_spec_list(C.code_spec_rows(*_doc_steps(spark, sf_dir)))


# -------------------------------------------------------------------- audits ----

def _audit_tables(spark, sf_dir) -> dict[str, DataFrame]:
    """The driver tables and some tables derived from them so that every rule finds something;
    each is opened when a rule asks for it."""
    def raw(name):
        return read(spark, sf_dir, name)

    dom = domain_tables(spark, sf_dir)
    makers = {n: (lambda n=n: raw(n)) for n in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels",
        "pages", "conversations")}
    makers |= {
        "fulfilled_orders": lambda: raw("orders").filter(F.col("o_orderstatus") == "F"),
        "small_parts": lambda: raw("part").filter(F.col("p_size") <= 25),
        "long_documents": lambda: raw("documents").filter(F.col("n_chars") > 1000),
        "documents_labeled": lambda: raw("documents").join(raw("labels"), "doc_id", "left"),
        "composition": lambda: dom["material_chemicals"], "chemicals": lambda: dom["chemicals"],
        "orders_level": lambda: raw("orders").select(
            "o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("int").alias("priority_level")),
        "events_cut": lambda: raw("events").select("event_id", F.when(
            F.col("event_id") % 50 == 0, F.expr("substring(props, 1, length(props) - 1)"))
            .otherwise(F.col("props")).alias("props")),
        "part_code": lambda: raw("part").select("p_partkey", "p_brand", F.lit("Brand#").alias("brand_prefix"), "p_size"),
        "customer_code": lambda: raw("customer").select(
            "c_custkey", "c_name", F.when(F.col("c_custkey") % 7 == 0, F.lit("Client#"))
            .otherwise(F.lit("Customer#")).alias("name_prefix")),
        "supplier_code": lambda: raw("supplier").select("s_suppkey", "s_name", F.lit("Supplier#").alias("name_prefix"))}
    return LazyTables(makers)


FKS = [
    A.ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    A.ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    A.ForeignKey("lineitem", ("l_partkey",), "small_parts", ("p_partkey",)),
    A.ForeignKey("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    A.ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    A.ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    A.ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    A.ForeignKey("labels", ("doc_id",), "long_documents", ("doc_id",)),
    A.ForeignKey("events", ("user_id",), "customer", ("c_custkey",)),
    A.ForeignKey("lineitem", ("l_orderkey",), "fulfilled_orders", ("o_orderkey",)),
]

_PARENT_SQL = {"fulfilled_orders": "(SELECT * FROM orders WHERE o_orderstatus = 'F')",
               "small_parts": "(SELECT * FROM part WHERE p_size <= 25)",
               "long_documents": "(SELECT * FROM documents WHERE n_chars > 1000)"}


def _fk_sql() -> str:
    parts = []
    for fk in FKS:
        c, p = fk.child_cols[0], fk.parent_cols[0]
        parent = _PARENT_SQL.get(fk.parent, fk.parent)
        parts.append(f"SELECT '{fk.child}' AS child_table, '{c}' AS child_column, '{fk.parent}' AS parent_table, "
                     f"'{p}' AS parent_column, count(*) AS orphan_count FROM {fk.child} x "
                     f"WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} y WHERE y.{p} = x.{c})")
    return "\nUNION ALL\n".join(parts)


@register("fk_orphans", _fk_sql())
def q_fk_orphans(spark, sf_dir):
    """V1 counts for every foreign key, zeros included (the audit keeps only > 0)."""
    found = A.orphan_counts(_audit_tables(spark, sf_dir), FKS)
    names = [(fk.child, fk.child_cols[0], fk.parent, fk.parent_cols[0]) for fk in FKS]
    columns = ("child_table", "child_column", "parent_table", "parent_column")
    rules = spark.range(len(FKS)).select(
        F.col("id").cast("int").alias("rule"),
        *[F.get(F.array(*[F.lit(n[k]) for n in names]), F.col("id").cast("int")).alias(c)
          for k, c in enumerate(columns)])
    return (rules.join(found, "rule", "left")
            .select(*columns, F.coalesce("orphan_count", F.lit(0)).cast("long").alias("orphan_count")))


REQUIRED = [
    A.Required("documents_labeled", ("doc_id", "text", "lang", "source", "quality", "toxic")),
    A.Required("orders", ("o_orderkey", "o_custkey", "o_orderdate")),
    A.Required("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
    A.Required("customer", ("c_custkey", "c_name")),
    A.Required("events", ("event_id", "user_id", "props")),
]

_REQ_SRC = {"documents_labeled": "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"}


def _required_sql() -> str:
    parts = []
    for r in REQUIRED:
        src = _REQ_SRC.get(r.table, r.table)
        for c in r.columns:
            parts.append(f"SELECT '{r.table}' AS \"table\", '{c}' AS \"column\", "
                         f"count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("required_nulls", _required_sql())
def q_required_nulls(spark, sf_dir):
    """V3 / A2: NULL counts for every required (table, column), one pass per table."""
    t = _audit_tables(spark, sf_dir)
    out = None
    for r in REQUIRED:
        nc = A.null_counts(t[r.table], r.columns).select(F.lit(r.table).alias("table"), "column",
                                                         F.col("null_count").cast("long").alias("null_count"))
        out = nc if out is None else out.unionByName(nc)
    return out


UNIQUES = [
    A.Unique("lineitem", ("l_orderkey", "l_linenumber")), A.Unique("orders", ("o_orderkey",)),
    A.Unique("customer", ("c_custkey",)), A.Unique("part", ("p_partkey",)), A.Unique("supplier", ("s_suppkey",)),
    A.Unique("documents", ("doc_id",)), A.Unique("events", ("event_id",)), A.Unique("labels", ("doc_id",)),
    A.Unique("conversations", ("conv_id", "turn")), A.Unique("pages", ("page_id",)),
]


def _unique_sql() -> str:
    parts = []
    for u in UNIQUES:
        k = ", ".join(u.key)
        parts.append(f"SELECT '{u.table}' AS \"table\", '{k}' AS key, count(*) AS duplicate_keys, "
                     f"CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT {k}, count(*) AS n FROM {u.table} "
                     f"GROUP BY {k} HAVING count(*) > 1)")
    return "\nUNION ALL\n".join(parts)


@register("unique_keys", _unique_sql())
def q_unique_keys(spark, sf_dir):
    """Duplicated natural keys per table (number of keys and surplus rows), zeros included."""
    found = A.unique_counts(_audit_tables(spark, sf_dir), UNIQUES)
    names = [[u.table for u in UNIQUES], [", ".join(u.key) for u in UNIQUES]]
    rule = F.col("id").cast("int")
    rules = spark.range(len(UNIQUES)).select(
        rule.alias("rule"), *[F.get(F.array(*[F.lit(x) for x in n]), rule).alias(c)
                              for c, n in zip(("table", "key"), names)])
    zero = F.lit(0).cast("long")
    return rules.join(found, "rule", "left").select(
        "table", "key", F.coalesce("duplicate_keys", zero).alias("duplicate_keys"),
        F.coalesce("surplus_rows", zero).alias("surplus_rows"))


ROW_CHECKS = [
    A.range_check("orders_level", "priority_level", 2, 5, ["o_orderkey"]),
    A.range_check("chemicals", "default_hazard_level", 1, 4, ["cas"]),
    A.range_check("lineitem", "l_quantity", 1, 45, ["l_orderkey", "l_linenumber"]),
    A.range_check("composition", "pct_wt_low", 0, 9, ["base_spec", "cas"], issue="check_failed"),
    A.range_check("composition", "pct_wt_high", 0, 7, ["base_spec", "cas"], issue="check_failed"),
    A.inverted_range_check("composition", "pct_wt_low", "pct_wt_high", ["base_spec", "cas"]),
]
FORMAT_CHECKS = [
    A.regex_check("part", "p_brand", r"^Brand#[0-9]{2}$", "invalid_format", "warning", ["p_partkey"]),
    A.regex_check("pages", "url", r"^https://", "insecure_url", "warning", ["page_id"]),
    A.regex_check("chemicals", "hazard_flags", r'^\{"ghs":\[', "invalid_format", "warning", ["cas"]),
    A.json_check("events_cut", "props", ["event_id"]),
    A.json_check("chemicals", "hazard_flags", ["cas"]),
]
SUM_LIMITS = [A.SumLimit("composition", ("base_spec",), "pct_wt_high", 100.0)]
COMPOSITIONS = [
    A.Composition("part_code", "p_brand", ("brand_prefix",), "p_size", ("p_partkey",), 2),
    A.Composition("customer_code", "c_name", ("name_prefix",), "c_custkey", ("c_custkey",), 9),
    A.Composition("supplier_code", "s_name", ("name_prefix",), "s_suppkey", ("s_suppkey",), 9),
]

_AUDIT_CTES = ROLE_SQL + """,
composition AS (SELECT * FROM material_chemicals),
orders_level AS (SELECT o_orderkey, TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS priority_level
                 FROM orders),
events_cut AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN substring(props, 1, length(props) - 1) ELSE props END
                      AS props FROM events)"""

_RANGE_SQL = """
SELECT 'format' AS type, 'error' AS severity, 'orders_level' AS "table", 'priority_level' AS "column",
       'out_of_range' AS issue, CAST(o_orderkey AS VARCHAR) AS row_key
FROM orders_level WHERE priority_level IS NOT NULL AND NOT (priority_level BETWEEN 2 AND 5)
UNION ALL
SELECT 'format', 'error', 'chemicals', 'default_hazard_level', 'out_of_range', CAST(cas AS VARCHAR)
FROM chemicals WHERE default_hazard_level IS NOT NULL AND NOT (default_hazard_level BETWEEN 1 AND 4)
UNION ALL
SELECT 'format', 'error', 'lineitem', 'l_quantity', 'out_of_range',
       CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)
FROM lineitem WHERE l_quantity IS NOT NULL AND NOT (l_quantity BETWEEN 1 AND 45)
UNION ALL
SELECT 'format', 'error', 'composition', 'pct_wt_low', 'check_failed', CAST(base_spec AS VARCHAR) || '|' || CAST(cas AS VARCHAR)
FROM composition WHERE pct_wt_low IS NOT NULL AND NOT (pct_wt_low BETWEEN 0 AND 9)
UNION ALL
SELECT 'format', 'error', 'composition', 'pct_wt_high', 'check_failed', CAST(base_spec AS VARCHAR) || '|' || CAST(cas AS VARCHAR)
FROM composition WHERE pct_wt_high IS NOT NULL AND NOT (pct_wt_high BETWEEN 0 AND 7)
UNION ALL
SELECT 'format', 'error', 'composition', 'pct_wt_low, pct_wt_high', 'invalid_range',
       CAST(base_spec AS VARCHAR) || '|' || CAST(cas AS VARCHAR)
FROM composition WHERE pct_wt_low IS NOT NULL AND pct_wt_high IS NOT NULL AND pct_wt_low > pct_wt_high"""

_FORMAT_SQL = """
SELECT 'format' AS type, 'warning' AS severity, 'part' AS "table", 'p_brand' AS "column",
       'invalid_format' AS issue, CAST(p_partkey AS VARCHAR) AS row_key
FROM part WHERE p_brand IS NOT NULL AND NOT regexp_matches(p_brand, '^Brand#[0-9]{2}$')
UNION ALL
SELECT 'format', 'warning', 'pages', 'url', 'insecure_url', CAST(page_id AS VARCHAR)
FROM pages WHERE url IS NOT NULL AND NOT regexp_matches(url, '^https://')
UNION ALL
SELECT 'format', 'warning', 'chemicals', 'hazard_flags', 'invalid_format', CAST(cas AS VARCHAR)
FROM chemicals WHERE hazard_flags IS NOT NULL AND NOT regexp_matches(hazard_flags, '^\\{"ghs":\\[')
UNION ALL
SELECT 'format', 'error', 'events_cut', 'props', 'invalid_json', CAST(event_id AS VARCHAR)
FROM events_cut WHERE props IS NOT NULL AND NOT json_valid(props)
UNION ALL
SELECT 'format', 'error', 'chemicals', 'hazard_flags', 'invalid_json', CAST(cas AS VARCHAR)
FROM chemicals WHERE hazard_flags IS NOT NULL AND NOT json_valid(hazard_flags)"""

_SUM_SQL = """
SELECT 'format' AS type, 'warning' AS severity, 'composition' AS "table", 'pct_wt_high' AS "column",
       'exceeds_100_percent' AS issue, CAST(base_spec AS VARCHAR) AS row_key
FROM composition WHERE pct_wt_high IS NOT NULL GROUP BY base_spec HAVING sum(pct_wt_high) > 100"""

_COMPOSITION_SQL = """
SELECT 'format' AS type, 'warning' AS severity, 'part_code' AS "table", 'p_brand' AS "column",
       'code_mismatch' AS issue, CAST(p_partkey AS VARCHAR) AS row_key
FROM part WHERE NOT (p_brand = 'Brand#' || CASE WHEN length(CAST(p_size AS VARCHAR)) < 2
                                              THEN lpad(CAST(p_size AS VARCHAR), 2, '0') ELSE CAST(p_size AS VARCHAR) END
                  OR p_brand = 'Brand#' || CAST(p_size AS VARCHAR))
UNION ALL
SELECT 'format', 'warning', 'customer_code', 'c_name', 'code_mismatch', CAST(c_custkey AS VARCHAR)
FROM customer WHERE NOT (c_name = CASE WHEN c_custkey % 7 = 0 THEN 'Client#' ELSE 'Customer#' END || CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 9
                                  THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE CAST(c_custkey AS VARCHAR) END
                  OR c_name = CASE WHEN c_custkey % 7 = 0 THEN 'Client#' ELSE 'Customer#' END || CAST(c_custkey AS VARCHAR))
UNION ALL
SELECT 'format', 'warning', 'supplier_code', 's_name', 'code_mismatch', CAST(s_suppkey AS VARCHAR)
FROM supplier WHERE NOT (s_name = 'Supplier#' || CASE WHEN length(CAST(s_suppkey AS VARCHAR)) < 9
                                  THEN lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE CAST(s_suppkey AS VARCHAR) END
                  OR s_name = 'Supplier#' || CAST(s_suppkey AS VARCHAR))"""

_ISSUE_KEYS = ["type", "severity", "table", "column", "issue", "row_key"]


def _issue_rows(df: DataFrame) -> DataFrame:
    return df.select(*_ISSUE_KEYS)


@register("range_checks", _AUDIT_CTES + _RANGE_SQL)
def q_range_checks(spark, sf_dir):
    """V6, V7, V11 (P11, P12, P15): one issue per offending row."""
    t = _audit_tables(spark, sf_dir)
    out = None
    for df in A.batched_row_check_issues(t, ROW_CHECKS):
        out = df if out is None else out.unionByName(df)
    return _issue_rows(out)


@register("format_checks", _AUDIT_CTES + _FORMAT_SQL)
def q_format_checks(spark, sf_dir):
    """V4, V5 (P13, P14): regex formats and JSON validity, one issue per row."""
    t = _audit_tables(spark, sf_dir)
    out = None
    for df in A.batched_row_check_issues(t, FORMAT_CHECKS):
        out = df if out is None else out.unionByName(df)
    return _issue_rows(out)


@register("sum_over_limit", _AUDIT_CTES + """
SELECT base_spec, round(sum(pct_wt_high), 2) AS total_high FROM composition
WHERE pct_wt_high IS NOT NULL GROUP BY base_spec HAVING sum(pct_wt_high) > 100
""")
def q_sum_over_limit(spark, sf_dir):
    """V8 / A3: materials whose maximum weights add up to more than 100 percent."""
    comp = domain_tables(spark, sf_dir)["material_chemicals"]
    return (comp.filter(F.col("pct_wt_high").isNotNull()).groupBy("base_spec")
            .agg(F.sum("pct_wt_high").alias("_t")).filter(F.col("_t") > 100)
            .select("base_spec", F.round("_t", 2).alias("total_high")))


@register("code_composition", _COMPOSITION_SQL)
def q_code_composition(spark, sf_dir):
    """V9 (F6, F7): codes that equal neither the padded nor the unpadded composition."""
    t = _audit_tables(spark, sf_dir)
    out = None
    for df in A.composition_issues(t, COMPOSITIONS):
        out = df if out is None else out.unionByName(df)
    return _issue_rows(out)


def _all_rules() -> A.Rules:
    return A.Rules(foreign_keys=FKS, required=REQUIRED, unique=UNIQUES, row_checks=ROW_CHECKS + FORMAT_CHECKS,
                   sum_limits=SUM_LIMITS, compositions=COMPOSITIONS)


def _fk_issue_sql() -> str:
    parts = []
    for fk in FKS:
        c, p = fk.child_cols[0], fk.parent_cols[0]
        parent = _PARENT_SQL.get(fk.parent, fk.parent)
        parts.append(f"SELECT 'referential_integrity' AS type, 'error' AS severity, '{fk.child}' AS \"table\", "
                     f"'{c}' AS \"column\", 'orphan_fk' AS issue, CAST(NULL AS VARCHAR) AS row_key FROM {fk.child} x "
                     f"WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} y WHERE y.{p} = x.{c}) "
                     f"HAVING count(*) > 0")
    return "\nUNION ALL\n".join(parts)


def _req_issue_sql() -> str:
    parts = []
    for r in REQUIRED:
        src = _REQ_SRC.get(r.table, r.table)
        for c in r.columns:
            parts.append(f"SELECT 'completeness' AS type, 'error' AS severity, '{r.table}' AS \"table\", "
                         f"'{c}' AS \"column\", 'null_value' AS issue, CAST(NULL AS VARCHAR) AS row_key FROM {src} "
                         f"HAVING count(*) FILTER (WHERE {c} IS NULL) > 0")
    return "\nUNION ALL\n".join(parts)


def _uniq_issue_sql() -> str:
    parts = []
    for u in UNIQUES:
        k = ", ".join(u.key)
        rk = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '<null>')" for c in u.key)
        parts.append(f"SELECT 'uniqueness' AS type, 'error' AS severity, '{u.table}' AS \"table\", '{k}' AS \"column\", "
                     f"'duplicate_key' AS issue, {rk} AS row_key FROM {u.table} GROUP BY {k} HAVING count(*) > 1")
    return "\nUNION ALL\n".join(parts)


_ALL_ISSUES_SQL = _AUDIT_CTES + """,
issues AS (""" + "\nUNION ALL\n".join([_fk_issue_sql(), _req_issue_sql(), _uniq_issue_sql(), _RANGE_SQL,
                                      _FORMAT_SQL, _SUM_SQL, _COMPOSITION_SQL]) + ")"


@register("audit_summary", _ALL_ISSUES_SQL + """
SELECT type, severity, "table", "column", issue, count(*) AS n_issues FROM issues
GROUP BY type, severity, "table", "column", issue
""")
def q_audit_summary(spark, sf_dir):
    """Issues of all rules counted per rule key (counted directly, the issue
    rows themselves are not built)."""
    return A.issue_counts(spark, _audit_tables(spark, sf_dir), _all_rules())


@register("audit_report", _ALL_ISSUES_SQL + """,
c AS (SELECT count(*) FILTER (WHERE severity = 'error') AS error_count,
             count(*) FILTER (WHERE severity = 'warning') AS warning_count FROM issues)
SELECT CASE WHEN error_count > 0 THEN 'errors' WHEN warning_count > 0 THEN 'warnings' ELSE 'pass' END AS status,
       error_count, warning_count,
       CASE WHEN error_count > 0 THEN printf('Validation FAILED: %d error(s), %d warning(s)', error_count, warning_count)
            WHEN warning_count > 0 THEN printf('Validation passed with %d warning(s)', warning_count)
            ELSE 'Validation passed: no errors or warnings' END AS summary
FROM c
""")
def q_audit_report(spark, sf_dir):
    """Status, error and warning counts, summary."""
    return A.report_from_counts(A.issue_counts(spark, _audit_tables(spark, sf_dir), _all_rules()))


# --------------------------------------------------------- ingest semantics ----

@register("upsert_latest", """
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id,
       epoch_us(arg_max(ts, (ts, event_id))) AS ts_us, arg_max(value, (ts, event_id)) AS value,
       arg_max(props, (ts, event_id)) AS props, epoch_us(min(ts)) AS created_us
FROM events GROUP BY user_id, event_type
""")
def q_upsert_latest(spark, sf_dir):
    """The last row per (user_id, event_type) by (ts, event_id); the key's
    first time survives as created."""
    ev = read(spark, sf_dir, "events")
    lw = latest_by_key(ev, ["user_id", "event_type"], ["ts", "event_id"], first_seen="ts", first_seen_as="created")
    return lw.select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
                     "value", "props", F.unix_micros(F.col("created").cast("timestamp")).alias("created_us"))


@register("resolve_strict", """
SELECT l.l_orderkey, l.l_linenumber, 'missing_parent' AS reason, CAST(l.l_orderkey AS VARCHAR) AS row_key
FROM lineitem l LEFT JOIN (SELECT o_orderkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F'
                           GROUP BY o_orderkey) p ON l.l_orderkey = p.o_orderkey
WHERE p.n IS NULL OR p.n > 1
""")
def q_resolve_strict(spark, sf_dir):
    """Line items whose order is not among the fulfilled orders are rejected."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    parent = read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    _, rejects = resolve(li, parent, [("l_orderkey", "o_orderkey")])
    return rejects.select("l_orderkey", "l_linenumber", "reason", "row_key")


@register("resolve_lenient", """
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'A' END AS program, o_custkey FROM orders
           WHERE o_orderstatus <> 'P'
           UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'A' END, o_custkey FROM orders
           WHERE o_orderstatus <> 'P' AND o_orderkey % 10 = 0),
g AS (SELECT o_orderkey, program, count(*) AS n, min(o_custkey) AS o_custkey FROM p GROUP BY o_orderkey, program),
c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 AND l_orderkey % 2 = 0 THEN 'A' END AS program
      FROM lineitem)
SELECT c.l_orderkey, c.l_linenumber, CASE WHEN g.n IS NULL THEN 'missing_parent' WHEN g.n > 1 THEN 'ambiguous_key'
       ELSE 'resolved' END AS outcome, CASE WHEN g.n = 1 THEN g.o_custkey END AS o_custkey
FROM c LEFT JOIN g ON c.l_orderkey = g.o_orderkey AND c.program IS NOT DISTINCT FROM g.program
""")
def q_resolve_lenient(spark, sf_dir):
    """Line items resolve by (order, program), NULL meeting NULL; what finds no or
    several parents becomes a warning and the rest stays with its line number (gaps kept)."""
    program = F.when(F.col("o_orderkey") % 2 == 0, F.lit("A"))
    p = (read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
         .select("o_orderkey", program.alias("program"), "o_custkey"))
    parent = p.unionAll(p.filter("o_orderkey % 10 = 0"))
    child = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(
        (F.col("l_linenumber") % 3 != 0) & (F.col("l_orderkey") % 2 == 0), F.lit("A")).alias("program"))
    resolved, rejects = resolve(child, parent, [("l_orderkey", "o_orderkey"), ("program", "program")],
                                take=[("o_custkey", "o_custkey")], null_safe=["program"])
    kept = resolved.select("l_orderkey", "l_linenumber", F.lit("resolved").alias("outcome"), "o_custkey")
    return kept.unionAll(rejects.select("l_orderkey", "l_linenumber", F.col("reason"),
                                        F.lit(None).cast(kept.schema["o_custkey"].dataType)))


@register("resolve_nullsafe", """
WITH dl AS (SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
cls AS (SELECT lang, quality, count(*) AS class_size FROM dl GROUP BY lang, quality)
SELECT dl.doc_id, dl.lang, dl.quality, cls.class_size
FROM dl JOIN cls ON dl.lang = cls.lang AND dl.quality IS NOT DISTINCT FROM cls.quality
""")
def q_resolve_nullsafe(spark, sf_dir):
    """Each document resolves to its (language, quality) class NULL-safely, so
    unlabeled documents (quality NULL) find the NULL class."""
    dl = (read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
          .select("doc_id", "lang", "quality"))
    cls = dl.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("class_size"))
    resolved, _ = resolve(dl, cls, [("lang", "lang"), ("quality", "quality")], take=[("class_size", "class_size")],
                          null_safe=["quality"])
    return resolved


@register("list_to_steps", """
WITH c AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '[\\[\\]"'']', '', 'g'), ','),
                                    lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS a
      FROM c WHERE t IS NOT NULL),
e AS (SELECT doc_id, unnest(a) AS item, unnest(generate_series(1, len(a))) AS pos FROM l)
SELECT doc_id, item, max(pos) AS pos FROM e GROUP BY doc_id, item
""")
def q_list_to_steps(spark, sf_dir):
    """F9 + W2 + W3: embedded list text -> (row, element, last 1-based position)."""
    d = read(spark, sf_dir, "documents")
    lp = list_last_positions(d, "text", ["doc_id"])
    return lp.select("doc_id", "item", F.col("pos").cast("long").alias("pos"))


@register("json_flags", """
SELECT event_id, json_valid(props) AS props_valid,
       TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events
""")
def q_json_flags(spark, sf_dir):
    """JSON validity flag and one extracted field per row."""
    ev = read(spark, sf_dir, "events")
    return ev.select("event_id", json_is_valid("props").alias("props_valid"),
                     F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@register("manifest_diff", """
WITH cur AS (SELECT doc_id AS name, sha256(text) AS sha FROM documents),
prev AS (SELECT doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN 'xyz' WHEN doc_id % 5 = 1 THEN upper(sha256(text))
                                     ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 7 < 5
         UNION ALL SELECT doc_id + 1000000000, sha256(text) FROM documents WHERE doc_id % 11 = 0)
SELECT coalesce(cur.name, prev.name) AS name,
       CASE WHEN prev.name IS NULL THEN 'new' WHEN cur.name IS NULL THEN 'missing'
            WHEN NOT regexp_matches(prev.sha, '^[0-9a-fA-F]{64}$') THEN 'invalid_expected'
            WHEN cur.sha = prev.sha THEN 'unchanged' ELSE 'changed' END AS state,
       substring(cur.sha, 1, 16) AS sha_short
FROM cur FULL OUTER JOIN prev ON cur.name = prev.name
""")
def q_manifest_diff(spark, sf_dir):
    """S18-S20 (F10): content fingerprints of the current table against an earlier manifest in
    which some names are absent, gone since, not a digest, or in other case: all five states."""
    from tessera.sources.files import manifest_diff
    cur = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("sha"))
    n = F.col("name")
    sha = F.when(n % 5 == 0, F.lit("xyz")).when(n % 5 == 1, F.upper("sha")).otherwise(F.col("sha"))
    prev = cur.filter(n % 7 < 5).select("name", sha.alias("sha")).unionAll(
        cur.filter(n % 11 == 0).select((n + 1000000000).alias("name"), "sha"))
    return manifest_diff(cur, prev).select("name", "state", short_hash("sha").alias("sha_short"))


# ------------------------------------------------------------------ text jobs ----

_ASCII_L, _ASCII_R = boundary("ascii")
_PREFIX_ALT = "|".join(SPEC_PREFIXES)


@register("extract_specs", """
WITH g AS (SELECT doc_id, regexp_replace(text, '\\b(IAW|OR|AND)\\b', '___\\1___', 'g') AS t FROM documents),
h AS (SELECT doc_id, list_concat(regexp_extract_all(t, '\\bP\\d{4,6}\\b', 0, 'i'),
                                 list_filter(regexp_extract_all(t, '\\b(?:""" + _PREFIX_ALT + """)\\b[-\\s]*[A-Za-z0-9-]*', 0, 'i'),
                                             lambda x: NOT (suffix(x, '_') OR suffix(x, '-')))) AS hits FROM g),
c AS (SELECT doc_id, list_transform(hits, lambda x: regexp_replace(upper(x), '\\s+', '', 'g')) AS l FROM h),
d AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS specs FROM c)
SELECT doc_id, array_to_string(specs, ',') AS specs, len(specs) AS n_specs FROM d
""")
def q_extract_specs(spark, sf_dir):
    """X1 + X2 + U3 on every document (ASCII word boundaries, H7)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = X.extract_spec_column(d, "text", "specs", bound="ascii")
    return out.select("doc_id", "specs",
                      F.when(F.col("specs") == "", 0).otherwise(F.size(F.split("specs", ","))).cast("long")
                      .alias("n_specs"))


SEG_ANCHOR = "the"
SEG_STEP = f"{_ASCII_L}[A-Za-z]+tion{_ASCII_R}"


@register("segment_documents", """
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, string_split(t, ' ') AS ws FROM d),
tok AS (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM w),
seg AS (SELECT doc_id, w, i, CAST(sum(CASE WHEN w = '""" + SEG_ANCHOR + """' THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS seg_no FROM tok),
blk AS (SELECT doc_id, seg_no, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE w <> '""" + SEG_ANCHOR + """'), '')
               AS block FROM seg WHERE seg_no > 0 GROUP BY doc_id, seg_no)
SELECT doc_id, seg_no, '""" + SEG_ANCHOR + """' AS finish_code, 't' AS substrate_code, '0' AS finish_applied_code,
       '' AS seq_id,
       CASE WHEN regexp_matches(block, '\\b[A-Za-z]+tion\\b')
            THEN trim(regexp_extract(block, '^(.*?)\\b[A-Za-z]+tion\\b', 1)) ELSE block END AS finish_code_description,
       array_to_string(list_sort(list_distinct(regexp_extract_all(block, '\\b[A-Za-z]+tion\\b'))), ',') AS sft_steps
FROM blk
""")
def q_segment_documents(spark, sf_dir):
    """X4-X7 + U4: documents split at every standalone anchor word; per segment the
    text before the first step word and the sorted unique step words."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    seg = X.segment_documents(d, ["doc_id"], "text", anchor=SEG_ANCHOR, step_pattern=SEG_STEP, clean=True)
    return seg.select("doc_id", F.col("seg_no").cast("long").alias("seg_no"), "finish_code", "substrate_code", "finish_applied_code", "seq_id",
                      "finish_code_description", F.array_join("sft_steps", ",").alias("sft_steps"))


_RTF_SQL = """
WITH r AS (SELECT doc_id, '{\\rtf1\\ansi{\\b head} X' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || ' coat\\''e9 of '
              || lang || ' \\par SFT01023 XSFT0102 sft' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || ' then SFT'
              || lpad(CAST(doc_id * 7 % 10000 AS VARCHAR), 4, '0') || '  0000 none AB'
              || lpad(CAST((doc_id + 1) % 100 AS VARCHAR), 2, '0') || ' ' || source || ' A1B22 SFT0001}' AS rtf
           FROM documents),
d AS (SELECT doc_id, upper(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rtf,
             '\\\\''[0-9a-fA-F]{2}', ' ', 'g'), '\\\\[a-zA-Z]+-?\\d*(?:\\s|)', ' ', 'g'), '[{}\\\\]', ' ', 'g'),
             '\\s+', ' ', 'g'))) AS t FROM r),
w AS (SELECT doc_id, string_split(t, ' ') AS ws FROM d),
tok AS (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM w),
seg AS (SELECT doc_id, w, i, regexp_matches(w, '^([A-Z]{1,2}\\d{2}|0000)$') AS anchor,
               CAST(sum(CASE WHEN regexp_matches(w, '^([A-Z]{1,2}\\d{2}|0000)$') THEN 1 ELSE 0 END)
                    OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS seg_no FROM tok),
blk AS (SELECT doc_id, seg_no, max(w) FILTER (WHERE anchor) AS code,
               coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT anchor), '') AS block
        FROM seg WHERE seg_no > 0 GROUP BY doc_id, seg_no)
SELECT doc_id, seg_no, code AS finish_code,
       CASE WHEN code = '0000' THEN '0' ELSE code[1] END AS substrate_code,
       CASE WHEN code = '0000' OR length(code) = 3 THEN '0' ELSE code[2] END AS finish_applied_code,
       CASE WHEN code = '0000' THEN '00' ELSE right(code, 2) END AS seq_id,
       CASE WHEN regexp_matches(block, '\\bSFT\\d{4}\\b') THEN trim(regexp_extract(block, '^(.*?)\\bSFT\\d{4}\\b', 1))
            ELSE block END AS finish_code_description,
       array_to_string(list_sort(list_distinct(regexp_extract_all(block, '\\bSFT\\d{4}\\b'))), ',') AS sft_steps
FROM blk
"""


@register("rtf_codes", _RTF_SQL)
def q_rtf_codes(spark, sf_dir):
    """An RTF text per document, cleaned and cut into codes with their parts, description
    and steps by the real tokens (SFT01023 and XSFT0102 are no steps, A1B22 is no code)."""
    from tessera.functions.text import clean_rtf

    def two(c, width=2):
        return F.lpad(c.cast("string"), width, "0")

    n = F.col("doc_id")
    rtf = F.concat(F.lit(r"{\rtf1\ansi{\b head} X"), two(n % 100), F.lit(r" coat\'e9 of "), F.col("lang"),
                   F.lit(r" \par SFT01023 XSFT0102 sft"), two(n % 10000, 4), F.lit(" then SFT"), two(n * 7 % 10000, 4),
                   F.lit("  0000 none AB"), two((n + 1) % 100), F.lit(" "), F.col("source"), F.lit(" A1B22 SFT0001}"))
    d = read(spark, sf_dir, "documents").select("doc_id", clean_rtf(rtf).alias("t"))
    seg = X.segment_documents(d, ["doc_id"], "t")
    return seg.select("doc_id", F.col("seg_no").cast("long").alias("seg_no"), "finish_code", "substrate_code",
                      "finish_applied_code", "seq_id", "finish_code_description",
                      F.array_join("sft_steps", ",").alias("sft_steps"))


@register("enrich_lists", """
WITH pieces AS (SELECT doc_id, unnest(""" + _F4.format(c="text") + """) AS e FROM documents),
dict AS (SELECT e AS spec, CASE WHEN count(DISTINCT doc_id) >= 2 THEN e || ' shared' ELSE e END AS "full"
         FROM pieces GROUP BY e),
src AS (SELECT doc_id, text FROM documents
        WHERE text IS NOT NULL AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
ex AS (SELECT doc_id, unnest(string_split(text, ',')) AS raw,
              unnest(generate_series(1, len(string_split(text, ',')))) AS pos FROM src),
j AS (SELECT ex.doc_id, ex.pos, regexp_replace(ex.raw, '^\\s+|\\s+$', '', 'g') AS e, dict."full" AS f
      FROM ex LEFT JOIN dict ON regexp_replace(ex.raw, '^\\s+|\\s+$', '', 'g') = dict.spec),
g AS (SELECT doc_id, string_agg(coalesce(f, e), ',' ORDER BY pos) AS enriched,
             count(*) FILTER (WHERE f IS NOT NULL AND f <> e) AS n_replaced FROM j GROUP BY doc_id)
SELECT g.doc_id, g.n_replaced, sha256(g.enriched) AS enriched_sha
FROM g JOIN documents d ON g.doc_id = d.doc_id WHERE d.text IS DISTINCT FROM g.enriched
""")
def q_enrich_lists(spark, sf_dir):
    """X8 + X9 + X10 (J14): every comma list is enriched with a dictionary derived from
    the documents themselves (a piece found in two or more documents gets the type
    'shared', others '-'); changed rows are reported with a digest of the new text."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    from tessera.functions.columns import split_list
    pieces = d.select("doc_id", F.explode(split_list("text")).alias("specification"))
    types = pieces.groupBy("specification").agg(
        F.when(F.count_distinct("doc_id") >= 2, F.lit("shared")).otherwise(F.lit("-")).alias("Type / Class / Grade"))
    mapping = X.spec_type_map(types)
    enr = X.enrich_lists(d, ["doc_id"], "text", mapping)
    return X.changed_rows(enr).select("doc_id", "n_replaced", F.sha2("enriched", 256).alias("enriched_sha"))


@register("quote_audit", """
WITH l AS (SELECT page_id, regexp_split_to_array(replace(html, '=', chr(10)), '\\r\\n|\\r|\\n') AS ls FROM pages),
e AS (SELECT page_id, unnest(ls) AS line FROM l)
SELECT page_id, count(*) AS n_lines, CAST(sum(length(line) - length(replace(line, '"', ''))) AS BIGINT) AS n_quotes,
       count(*) FILTER (WHERE (length(line) - length(replace(line, '"', ''))) % 2 = 1) AS n_odd_lines
FROM e GROUP BY page_id
""")
def q_quote_audit(spark, sf_dir):
    """X11 per page, row-local: lines, double quotes, and lines with an odd number of quotes (the
    offending lines themselves come from ``odd_quote_lines``). Every ``=`` is made a line end
    here, which splits quoted attributes over lines."""
    d = read(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("="), F.lit("\n")).alias("html"))
    return X.quote_profile(d, ["page_id"], "html")
