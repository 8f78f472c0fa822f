"""Hierarchy assembly: code -> dimensions -> ordered steps -> materials -> chemicals.

Tables are passed as ``dict[str, DataFrame]`` with the natural-key columns of the
published snapshot (see ``tessera.schemas``):

  substrates(code, description, source_doc, program)
  finish_applied(code, description, source_doc, program, associated_specs)
  finish_codes(code, program, substrate_code, finish_applied_code, seq_id, description,
               notes, source_doc, associated_specs)
  finish_code_steps(finish_code, program, sft_code, step_order)
  sft_steps(sft_code, parent_group, description, associated_specs, source_doc, last_review, notes)
  materials(base_spec, variant, description, notes)
  sft_material_links(sft_code, base_spec, variant, note)
  chemicals(name, cas, hazard_flags, default_hazard_level)
  material_chemicals(base_spec, variant, cas, pct_wt_low, pct_wt_high, notes)

The nested document is built bottom-up (H4): chemicals are grouped once per material,
materials once per step, steps once per code, and each level is joined to the next as
one array. Sort keys are placed first in each struct so ``array_sort`` orders the level
(H3) and are then dropped with ``transform``. A lookup for some codes first narrows
every level by semi joins, so it never assembles trees it will not return.

The nested levels carry the fields they are asked for and no others: a struct that is gathered
into an array is shuffled whole, whatever is read of it later.

Flat relational forms (``flat_tree``, ``code_chemicals``, ``tag_exposure``) reduce to
distinct keys before each fan-out join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import split_list, strip_ws

_MAXINT = 2**31 - 1


def _nk(left: DataFrame, right: DataFrame, cols: Sequence[str], null_safe: Sequence[str] = ()) -> Column:
    cond = None
    for c in cols:
        t = left[c].eqNullSafe(right[c]) if c in null_safe else (left[c] == right[c])
        cond = t if cond is None else cond & t
    return cond


def hazard_level_key(level: Column, name: Column) -> Column:
    """O3 sort key: level descending with NULL last, then name ascending."""
    return F.struct(F.coalesce(-level.cast("long"), F.lit(_MAXINT).cast("long")).alias("k1"), name.alias("k2"))


def parsed_hazard(raw: Column) -> tuple[Column, Column]:
    """F8: (the whole document as a VARIANT, or NULL; validity flag). The raw text stays apart."""
    parsed = F.try_parse_json(raw)
    valid = F.when(raw.isNull(), F.lit(None).cast("boolean")).otherwise(parsed.isNotNull())
    return parsed, valid


def in_order(arr: Column) -> Column:
    """The ``v`` fields of an array of (``_k``, ``v``) structs, by ``_k``. The elements are
    compared by their keys alone (a VARIANT in ``v`` has no order)."""
    by_key = F.array_sort(arr, lambda a, b: F.when(a["_k"] < b["_k"], -1).when(a["_k"] > b["_k"], 1).otherwise(0))
    return F.transform(by_key, lambda x: x["v"])


#: Keys that a lookup hands to a level's scan as values; beyond, the level is narrowed by a semi join.
PUSHED_KEYS = 1000


def _narrowed(df: DataFrame, cols: Sequence[str], keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``cols`` are among ``keys``, NULLs alike. Few keys become a condition on the first column
    in the scan, which skips files and row groups of a table sorted by it; the exact match is a semi join."""
    keys = keys.toDF(*[f"_k{i}" for i in range(len(cols))]).distinct()
    first = [r[0] for r in keys.select("_k0").distinct().limit(PUSHED_KEYS + 1).collect()]
    if len(first) <= PUSHED_KEYS and all(v is not None for v in first):
        df = df.filter(F.col(cols[0]).isin(first))
    on = F.lit(True)
    for i, c in enumerate(cols):
        on = on & df[c].eqNullSafe(keys[f"_k{i}"])
    return df.join(keys, on, "left_semi")


def _restrict(t: Mapping[str, DataFrame], codes: DataFrame | Sequence) -> dict[str, DataFrame]:
    """Narrow every level to what the requested codes reach. A list of codes is a condition in every level's scan, with
    the keys that the level above reaches; a table of codes narrows by semi joins only."""
    t = {name: t[name] for name in t.keys()}
    if not isinstance(codes, DataFrame):
        t["finish_codes"] = t["finish_codes"].filter(F.col("code").isin(list(codes)))
        t["finish_code_steps"] = t["finish_code_steps"].filter(F.col("finish_code").isin(list(codes)))
        for level, col, above, key in (("substrates", "code", "finish_codes", "substrate_code"),
                                       ("finish_applied", "code", "finish_codes", "finish_applied_code"),
                                       ("sft_steps", "sft_code", "finish_code_steps", "sft_code"),
                                       ("sft_material_links", "sft_code", "finish_code_steps", "sft_code")):
            t[level] = _narrowed(t[level], [col], t[above].select(key))
        mats = t["sft_material_links"].select("base_spec", "variant")
        t["materials"] = _narrowed(t["materials"], ["base_spec", "variant"], mats)
        t["material_chemicals"] = _narrowed(t["material_chemicals"], ["base_spec", "variant"], mats)
        t["chemicals"] = _narrowed(t["chemicals"], ["cas"], t["material_chemicals"].select("cas"))
        return t
    req = codes.select(F.col("code").alias("_rq")).distinct()
    t["finish_codes"] = t["finish_codes"].join(req, F.col("code") == F.col("_rq"), "left_semi")
    t["finish_code_steps"] = t["finish_code_steps"].join(req, F.col("finish_code") == F.col("_rq"), "left_semi")
    steps = t["finish_code_steps"].select(F.col("sft_code").alias("_s")).distinct()
    t["sft_material_links"] = t["sft_material_links"].join(steps, F.col("sft_code") == F.col("_s"), "left_semi")
    mats = t["sft_material_links"].select(F.col("base_spec").alias("_b"), F.col("variant").alias("_v")).distinct()
    mc = t["material_chemicals"]
    t["material_chemicals"] = mc.join(mats, (mc["base_spec"] == mats["_b"]) & mc["variant"].eqNullSafe(mats["_v"]),
                                      "left_semi")
    return t


#: What a nested chemical, and a nested material besides its chemicals, can have; all by default.
CHEMICAL = ("name", "cas", "pct_wt_low", "pct_wt_high", "hazard_flags", "hazard_flags_valid", "hazard_flags_raw",
            "default_hazard_level", "composition_notes")
MATERIAL = ("base_spec", "variant", "description", "notes")


def chemicals_per_material(t: dict[str, DataFrame], chemical: Sequence[str] = CHEMICAL) -> DataFrame:
    """Level 4 (J4 + A11): one row per material with its ordered chemicals array, each with the fields ``chemical``.

    Hazard JSON is parsed once per chemical (the dimension), before the join, not once
    per composition row.
    """
    mc, ch = t["material_chemicals"], t["chemicals"]
    parsed, valid = parsed_hazard(F.col("hazard_flags"))
    chp = ch.select("name", "cas", parsed.alias("_hf"), valid.alias("_hv"), F.col("hazard_flags").alias("_raw"),
                    "default_hazard_level")
    j = mc.join(chp, "cas")
    named = {"hazard_flags": "_hf", "hazard_flags_valid": "_hv", "hazard_flags_raw": "_raw", "composition_notes": "notes"}
    item = F.struct(hazard_level_key(F.col("default_hazard_level"), F.col("name")).alias("_k"),
                    F.struct(*[F.col(named.get(f, f)).alias(f) for f in chemical]).alias("v"))
    g = j.groupBy("base_spec", "variant").agg(F.collect_list(item).alias("_c"))
    return g.select("base_spec", "variant", in_order(F.col("_c")).alias("chemicals"))


def materials_per_step(t: dict[str, DataFrame], material: Sequence[str] = MATERIAL,
                       chemical: Sequence[str] = CHEMICAL) -> DataFrame:
    """Level 3 (J3 + J5): one row per step with its materials (the fields ``material``, and the chemicals of each)."""
    mats = t["materials"]
    chem = chemicals_per_material(t, chemical)
    full = mats.join(chem, _nk(mats, chem, ["base_spec", "variant"], ["variant"]), "left") \
        .select(mats["base_spec"], mats["variant"], mats["description"], mats["notes"],
                F.coalesce(chem["chemicals"], F.array()).alias("chemicals"))
    links = t["sft_material_links"]
    j = links.join(full, _nk(links, full, ["base_spec", "variant"], ["variant"]), "inner")
    item = F.struct(F.struct(links["base_spec"].alias("k1"), links["variant"].alias("k2")).alias("_k"),
                    F.struct(*[(links if f in ("base_spec", "variant") else full)[f].alias(f) for f in material],
                             full["chemicals"].alias("chemicals")).alias("v"))
    g = j.groupBy(links["sft_code"]).agg(F.collect_list(item).alias("_m"))
    return g.select("sft_code", in_order(F.col("_m")).alias("materials"))


def steps_per_code(t: dict[str, DataFrame], order_cols: Sequence[str] = ("step_order",)) -> DataFrame:
    """Level 2 (J2 + O4 + A11): one row per (code, program) with ordered steps."""
    cs, st = t["finish_code_steps"], t["sft_steps"]
    mps = materials_per_step(t)
    j = cs.join(st, "sft_code").join(mps, "sft_code", "left")
    step = F.struct(F.col("sft_code"), *[F.col(o) for o in order_cols if o != "sft_code"],
                    F.col("parent_group"), F.col("description"), F.col("associated_specs"), F.col("source_doc"),
                    F.col("last_review"), F.col("notes"),
                    F.coalesce(F.col("materials"), F.array()).alias("materials"))
    key = F.struct(*[F.col(o).alias(f"k{i}") for i, o in enumerate(order_cols)], F.col("sft_code").alias("kz"))
    g = j.groupBy("finish_code", "program").agg(
        F.collect_list(F.struct(key.alias("_k"), step.alias("v"))).alias("_s"))
    return g.select("finish_code", "program", in_order(F.col("_s")).alias("steps"))


def step_documents(t: dict[str, DataFrame], codes: DataFrame | None = None, material: Sequence[str] = MATERIAL,
                   chemical: Sequence[str] = CHEMICAL) -> DataFrame:
    """Q1 at step grain: one row per (code, step) with its materials and chemicals nested.

    Each group holds one step's materials, so no code's whole tree is gathered in one
    task; ``hierarchy`` is this collected per code. ``material`` and ``chemical`` are the
    fields that the nested levels have.
    """
    if codes is not None:
        t = _restrict(t, codes)
    cs, st = t["finish_code_steps"], t["sft_steps"]
    mps = materials_per_step(t, material, chemical)
    j = cs.join(st, "sft_code").join(mps, "sft_code", "left")
    return j.select("finish_code", "program", "sft_code", "step_order", "parent_group", "description",
                    "associated_specs", "source_doc", "last_review", "notes",
                    F.coalesce(F.col("materials"), F.array()).alias("materials"))


def provenance(manifest: DataFrame) -> Column:
    """Q9 (A9 + A10): struct(csv_shas map, loaded_at) as an uncorrelated scalar subquery.

    The manifest holds one row per source file, so the map is bounded by the file count.
    """
    return manifest.agg(F.struct(
        F.map_from_entries(F.collect_list(F.struct("source_name", "sha256"))).alias("csv_shas"),
        F.coalesce(F.max("loaded_at"), F.current_timestamp()).alias("loaded_at"))).scalar()


def hierarchy(t: dict[str, DataFrame], codes: DataFrame | Sequence | None = None,
              order_cols: Sequence[str] = ("step_order",)) -> DataFrame:
    """Q1 + Q8 + Q9: one nested document per code.

    ``codes`` restricts the work to those codes (lookup): a list of a few, whose keys then go into the scan of every
    level, or a table of any size (column ``code``). Columns:
    finish_code, program, parsed{substrate{code,description}, finish_applied{...},
    seq_id, finish_description, notes, source_doc, program, associated_specs},
    direct_specs, finish_applied_specs, steps[...], provenance (when a
    ``metadata_versions`` table is present).
    """
    if codes is not None:
        t = _restrict(t, codes)
    head = code_headers(t)
    spc = steps_per_code(t, order_cols).select(F.col("finish_code").alias("_fc"), F.col("program").alias("_pr"), "steps")
    j = head.join(spc, (head["finish_code"] == spc["_fc"]) & (head["program"] == spc["_pr"]), "left")
    kept = [c for c in head.columns if c != "provenance"]
    return j.select(*kept, F.coalesce(F.col("steps"), F.array()).alias("steps"),
                    *[c for c in head.columns if c == "provenance"])


def code_headers(t: dict[str, DataFrame]) -> DataFrame:
    """Q1 without its steps, with Q8 and Q9: one row per code, its dimensions parsed out, its own
    and its finish's specifications as lists, and the load it comes from."""
    fc = t["finish_codes"].alias("fc")
    s = t["substrates"].alias("s")
    fa = t["finish_applied"].alias("fa")
    base = (fc.join(s, (F.col("fc.substrate_code") == F.col("s.code")) & (F.col("fc.program") == F.col("s.program")))
              .join(fa, (F.col("fc.finish_applied_code") == F.col("fa.code"))
                    & (F.col("fc.program") == F.col("fa.program"))))
    parsed = F.struct(
        F.struct(F.col("s.code").alias("code"), F.col("s.description").alias("description")).alias("substrate"),
        F.struct(F.col("fa.code").alias("code"), F.col("fa.description").alias("description")).alias("finish_applied"),
        F.col("fc.seq_id").alias("seq_id"), F.col("fc.description").alias("finish_description"),
        F.col("fc.notes").alias("notes"), F.col("fc.source_doc").alias("source_doc"),
        F.col("fc.program").alias("program"), F.col("fc.associated_specs").alias("associated_specs"))
    cols = [F.col("fc.code").alias("finish_code"), F.col("fc.program").alias("program"), parsed.alias("parsed"),
            _spec_list(F.col("fc.associated_specs")).alias("direct_specs"),
            _spec_list(F.col("fa.associated_specs")).alias("finish_applied_specs")]
    if "metadata_versions" in t:
        cols.append(provenance(t["metadata_versions"]).alias("provenance"))
    return base.select(*cols)


def _spec_list(c: Column) -> Column:
    """Q8 / P5: comma list to array, blank-safe (NULL or blank text -> empty array)."""
    return F.when(c.isNotNull() & (strip_ws(c) != ""), split_list(c)).otherwise(F.array().cast("array<string>"))


def available_codes(t: dict[str, DataFrame], k: int = 10) -> Column:
    """P2 + O2: the first ``k`` codes ascending, as one scalar subquery (a bounded
    top-k: each task keeps k candidates)."""
    return (t["finish_codes"].select("code").distinct().orderBy("code").limit(k)
            .agg(F.array_sort(F.collect_list("code")).alias("a")).scalar())


def lookup(t: dict[str, DataFrame], requested: DataFrame, available_k: int = 10,
           order_cols: Sequence[str] = ("step_order",)) -> DataFrame:
    """P1 + P2 + O2: answer a request list (column ``code``).

    Found codes get their document; unknown codes get ``error`` and the first
    ``available_k`` codes ascending (one bounded top-k, evaluated once as a scalar
    subquery).
    """
    docs = hierarchy(t, requested, order_cols)
    avail = available_codes(t, available_k)
    req = requested.select(F.col("code").alias("requested")).distinct()
    j = req.join(docs, req["requested"] == docs["finish_code"], "left")
    missing = F.col("finish_code").isNull()
    return j.select("requested", F.when(missing, F.lit("Finish code not found")).alias("error"),
                    F.when(missing, avail).alias("available_codes"), *[c for c in docs.columns])


def expanded_codes(t: dict[str, DataFrame]) -> DataFrame:
    """Q6 (P9 + J1): the expanded-codes view, dimensions joined by (code, program)."""
    fc, s, fa = t["finish_codes"].alias("fc"), t["substrates"].alias("s"), t["finish_applied"].alias("fa")
    j = (fc.join(s, (F.col("fc.substrate_code") == F.col("s.code")) & (F.col("fc.program") == F.col("s.program")))
           .join(fa, (F.col("fc.finish_applied_code") == F.col("fa.code"))
                 & (F.col("fc.program") == F.col("fa.program"))))
    return j.select(
        F.col("fc.code").alias("code"), F.col("fc.seq_id").alias("seq_id"),
        F.col("fc.description").alias("finish_description"), F.col("fc.notes").alias("notes"),
        F.col("fc.source_doc").alias("source_doc"), F.col("fc.program").alias("program"),
        F.col("fc.associated_specs").alias("finish_code_specs"),
        F.col("s.code").alias("substrate_code"), F.col("s.description").alias("substrate_description"),
        F.col("s.source_doc").alias("substrate_source_doc"), F.col("s.program").alias("substrate_program"),
        F.col("fa.code").alias("finish_applied_code"), F.col("fa.description").alias("finish_applied_description"),
        F.col("fa.source_doc").alias("finish_applied_source_doc"), F.col("fa.program").alias("finish_applied_program"),
        F.col("fa.associated_specs").alias("finish_applied_specs"))


def code_list(t: dict[str, DataFrame]) -> DataFrame:
    """Q2 + O1: codes with dimension names, ascending by code."""
    e = expanded_codes(t)
    return e.select(F.col("code"), F.col("finish_description").alias("description"),
                    F.col("substrate_description").alias("substrate"),
                    F.col("finish_applied_description").alias("finish_applied"),
                    "seq_id", "source_doc", "program").orderBy("code")


def flat_tree(t: dict[str, DataFrame]) -> DataFrame:
    """Q10 (J6): one row per code/step/material/chemical, left joins below the step."""
    e = expanded_codes(t).alias("e")
    cs, st = t["finish_code_steps"].alias("cs"), t["sft_steps"].alias("st")
    links, mats = t["sft_material_links"].alias("l"), t["materials"].alias("m")
    mc, ch = t["material_chemicals"].alias("mc"), t["chemicals"].alias("c")
    # The composition attaches to the materials before the links meet them: (l LEFT m) LEFT mc by
    # m's key equals l LEFT (m LEFT mc). The codes join the steps, whose rows are fewest. The
    # chemicals' texts come last, as their key is one of mc's columns: no other join carries them.
    full = mats.join(mc, (F.col("m.base_spec") == F.col("mc.base_spec")) & F.col("m.variant").eqNullSafe(
        F.col("mc.variant")), "left").select("m.base_spec", "m.variant", F.col("mc.cas").alias("_cas"),
                                             "mc.pct_wt_low", "mc.pct_wt_high").alias("k")
    j = (cs.join(e, (F.col("e.code") == F.col("cs.finish_code")) & (F.col("e.program") == F.col("cs.program")))
         .join(st, F.col("cs.sft_code") == F.col("st.sft_code"))
         .join(links, F.col("st.sft_code") == F.col("l.sft_code"), "left")
         .join(full, (F.col("l.base_spec") == F.col("k.base_spec"))
               & F.col("l.variant").eqNullSafe(F.col("k.variant")), "left")
         .join(ch, F.col("k._cas") == F.col("c.cas"), "left"))
    return j.select(
        F.col("e.code").alias("finish_code"), F.col("e.substrate_code"), F.col("e.substrate_description")
        .alias("substrate_desc"), F.col("e.finish_applied_code"),
        F.col("e.finish_applied_description").alias("finish_applied_desc"), F.col("e.seq_id"),
        F.col("st.sft_code").alias("sft_code"), F.col("st.description").alias("sft_desc"),
        F.col("cs.step_order").alias("step_order"), F.col("k.base_spec").alias("base_spec"),
        F.col("k.variant").alias("variant"), F.col("c.name").alias("chemical_name"), F.col("c.cas").alias("cas"),
        F.col("c.hazard_flags").alias("hazard_flags"), F.col("k.pct_wt_low").alias("pct_wt_low"),
        F.col("k.pct_wt_high").alias("pct_wt_high"))


def code_material_links(t: dict[str, DataFrame]) -> DataFrame:
    """(finish_code, base_spec, variant, n_links): each material a code reaches through
    its steps, with the number of link rows behind it. One join and one partial
    aggregate; the inputs are not de-duplicated first (that would be two more shuffles)."""
    cs = t["finish_code_steps"].select("finish_code", "sft_code")
    links = t["sft_material_links"].select("sft_code", "base_spec", "variant")
    return (cs.join(links, "sft_code").groupBy("finish_code", "base_spec", "variant")
            .agg(F.count(F.lit(1)).alias("n_links")))


def code_materials(t: dict[str, DataFrame]) -> DataFrame:
    """Distinct (finish_code, base_spec, variant) reached through the code's steps."""
    return code_material_links(t).select("finish_code", "base_spec", "variant")


def code_chemicals(t: dict[str, DataFrame], materials: DataFrame | None = None) -> DataFrame:
    """Q11 (J15): distinct chemicals of each code.

    Reduced to distinct (code, material) and then distinct (code, cas) before the
    chemical attributes are joined, so the material fan-out is paid on keys only.
    ``materials`` may pass an already computed ``code_materials``.
    """
    cm = (materials if materials is not None else code_materials(t)).alias("cm")
    mc = t["material_chemicals"].select("base_spec", "variant", "cas").alias("mc")
    cc = (cm.join(mc, (F.col("cm.base_spec") == F.col("mc.base_spec"))
                  & F.col("cm.variant").eqNullSafe(F.col("mc.variant")))
            .select(F.col("cm.finish_code").alias("finish_code"), F.col("mc.cas").alias("cas")).distinct())
    ch = t["chemicals"].select("name", "cas", "hazard_flags", "default_hazard_level")
    return cc.join(ch, "cas").select("finish_code", "name", "cas", "hazard_flags", "default_hazard_level")


def tag_exposure(t: dict[str, DataFrame], tag: str, tag_col: str = "hazard_flags") -> DataFrame:
    """Q12 (A8 + P8): count of distinct tagged chemicals per code, most exposed first.

    The tag test is a case-insensitive substring match (no wildcards), applied to the
    chemical table before the join.
    """
    ch = t["chemicals"].filter(F.lower(F.col(tag_col)).contains(tag.lower())).select("cas")
    cm = code_materials(t).alias("cm")
    mc = t["material_chemicals"].select("base_spec", "variant", "cas").join(ch, "cas", "left_semi").alias("mc")
    j = cm.join(mc, (F.col("cm.base_spec") == F.col("mc.base_spec")) & F.col("cm.variant").eqNullSafe(F.col("mc.variant")))
    return (j.groupBy(F.col("cm.finish_code").alias("finish_code"))
             .agg(F.count_distinct(F.col("mc.cas")).alias("tagged_count"))
             .orderBy(F.desc("tagged_count"), "finish_code"))


def chemicals_by_hazard(chemicals: DataFrame, min_level: int | None = 1) -> DataFrame:
    """Q3 / Q7 (P3 + O3): chemicals at or above ``min_level`` (1-5), highest first.

    ``min_level=None`` is the view: every chemical, NULL levels last.
    """
    if min_level is not None:
        if not isinstance(min_level, int) or not 1 <= min_level <= 5:
            raise ValueError(f"min_level must be 1-5, got: {min_level}")
        chemicals = chemicals.filter(F.col("default_hazard_level") >= min_level)
    parsed, valid = parsed_hazard(F.col("hazard_flags"))
    return (chemicals.select("name", "cas", "hazard_flags", parsed.alias("hazard_flags_parsed"),
                             valid.alias("hazard_flags_valid"), "default_hazard_level")
            .orderBy(F.col("default_hazard_level").desc_nulls_last(), F.col("name").asc()))
