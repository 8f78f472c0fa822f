"""Domain file contracts, natural keys and audit rule lists.

A contract names the columns a CSV must have (by header name; order is free), the
optional columns with their defaults, and the columns that are cast to a type. Tables
are keyed by natural keys; surrogate ids do not exist in this design.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from tessera.operators import audit as A


@dataclass(frozen=True)
class Contract:
    file: str
    table: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    typed: dict[str, str] = field(default_factory=dict)  # column -> Spark SQL type
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)  # name -> fallbacks (S8)


# The nine input files, in the reference's load order, with their
# required and optional columns.
CONTRACTS = [
    Contract("substrates.csv", "substrates", ("code", "description"), ("source_doc", "program")),
    Contract("finish_applied.csv", "finish_applied", ("code", "description"),
             ("source_doc", "program", "associated_specs")),
    Contract("finish_codes.csv", "finish_codes", ("finish_code", "substrate_code", "finish_applied_code", "seq_id"),
             ("description", "notes", "sft_steps", "source_doc", "program", "associated_specs"),
             aliases={"description": ("description", "finish_code_description")}),
    Contract("sft_steps.csv", "sft_steps", ("sft_code", "description"),
             ("parent_group", "associated_specs", "source_doc", "last_review", "notes")),
    Contract("finish_code_steps.csv", "finish_code_steps", ("finish_code", "sft_code", "step_order"),
             typed={"step_order": "int"}),
    Contract("materials_map.csv", "materials", ("base_spec",), ("variant", "description", "notes")),
    Contract("chemicals.csv", "chemicals", ("name",), ("cas", "hazard_flags", "default_hazard_level"),
             typed={"default_hazard_level": "int"}),
    Contract("sft_material_links.csv", "sft_material_links", ("sft_code", "base_spec"), ("variant", "note")),
    Contract("material_chemicals.csv", "material_chemicals", ("base_spec", "cas"),
             ("variant", "chemical_name", "pct_wt_low", "pct_wt_high", "notes"),
             typed={"pct_wt_low": "double", "pct_wt_high": "double"}),
]
CONTRACT_BY_FILE = {c.file: c for c in CONTRACTS}

# Natural keys of the published tables.
KEYS = {
    "substrates": ("code", "program"),
    "finish_applied": ("code", "program"),
    "finish_codes": ("code", "program"),
    "sft_steps": ("sft_code",),
    "finish_code_steps": ("finish_code", "program", "sft_code"),
    "materials": ("base_spec", "variant"),
    "chemicals": ("chem_key",),
    "metadata_versions": ("source_name",),
}

# Published column order per table.
COLUMNS = {
    "substrates": ["code", "description", "source_doc", "program", "created_at"],
    "finish_applied": ["code", "description", "source_doc", "program", "associated_specs", "created_at"],
    "finish_codes": ["code", "program", "substrate_code", "finish_applied_code", "seq_id", "description", "notes",
                     "source_doc", "associated_specs", "created_at"],
    "sft_steps": ["sft_code", "parent_group", "description", "associated_specs", "source_doc", "last_review",
                  "notes", "created_at"],
    "finish_code_steps": ["finish_code", "program", "sft_code", "step_order", "created_at"],
    "materials": ["base_spec", "variant", "description", "notes", "created_at"],
    "sft_material_links": ["sft_code", "base_spec", "variant", "note", "created_at"],
    "chemicals": ["name", "cas", "hazard_flags", "default_hazard_level", "chem_key", "created_at"],
    "material_chemicals": ["base_spec", "variant", "cas", "pct_wt_low", "pct_wt_high", "notes", "created_at"],
    "metadata_versions": ["source_name", "sha256", "rows_loaded", "loaded_at"],
}

DDL = {
    "substrates": "code string, description string, source_doc string, program string, created_at timestamp",
    "finish_applied": "code string, description string, source_doc string, program string, "
                      "associated_specs string, created_at timestamp",
    "finish_codes": "code string, program string, substrate_code string, finish_applied_code string, seq_id long, "
                    "description string, notes string, source_doc string, associated_specs string, "
                    "created_at timestamp",
    "sft_steps": "sft_code string, parent_group string, description string, associated_specs string, "
                 "source_doc string, last_review string, notes string, created_at timestamp",
    "finish_code_steps": "finish_code string, program string, sft_code string, step_order int, "
                         "created_at timestamp",
    "materials": "base_spec string, variant string, description string, notes string, created_at timestamp",
    "sft_material_links": "sft_code string, base_spec string, variant string, note string, created_at timestamp",
    "chemicals": "name string, cas string, hazard_flags string, default_hazard_level int, chem_key string, "
                 "created_at timestamp",
    "material_chemicals": "base_spec string, variant string, cas string, pct_wt_low double, pct_wt_high double, "
                          "notes string, created_at timestamp",
    "metadata_versions": "source_name string, sha256 string, rows_loaded long, loaded_at timestamp",
}


def domain_rules(extended: bool = False) -> A.Rules:
    """V1-V12 for the published domain tables (natural keys).

    ``extended`` adds the rule the reference documents but does not run: step orders of a
    code are 1..n.
    """
    fk = A.ForeignKey
    rules = A.Rules(
        foreign_keys=[
            fk("finish_codes", ("substrate_code", "program"), "substrates", ("code", "program")),
            fk("finish_codes", ("finish_applied_code", "program"), "finish_applied", ("code", "program")),
            fk("finish_code_steps", ("finish_code", "program"), "finish_codes", ("code", "program")),
            fk("finish_code_steps", ("sft_code",), "sft_steps", ("sft_code",)),
            fk("sft_material_links", ("sft_code",), "sft_steps", ("sft_code",)),
            fk("sft_material_links", ("base_spec", "variant"), "materials", ("base_spec", "variant"), ("variant",)),
            fk("material_chemicals", ("base_spec", "variant"), "materials", ("base_spec", "variant"), ("variant",)),
            fk("material_chemicals", ("cas",), "chemicals", ("cas",)),
            fk("spec_dependencies", ("spec_base_spec", "spec_variant"), "materials", ("base_spec", "variant"),
               ("spec_variant",)),
            fk("spec_dependencies", ("ref_base_spec", "ref_variant"), "materials", ("base_spec", "variant"),
               ("ref_variant",)),
        ],
        required=[
            A.Required("substrates", ("code", "description")),
            A.Required("finish_applied", ("code", "description")),
            A.Required("finish_codes", ("code", "substrate_code", "finish_applied_code", "seq_id")),
            A.Required("sft_steps", ("sft_code", "description")),
            A.Required("finish_code_steps", ("finish_code", "sft_code", "step_order")),
            A.Required("materials", ("base_spec",)),
            A.Required("sft_material_links", ("sft_code", "base_spec")),
            A.Required("chemicals", ("name",)),
            A.Required("material_chemicals", ("base_spec", "cas")),
            A.Required("metadata_versions", ("source_name", "sha256", "rows_loaded")),
        ],
        unique=[
            A.Unique("substrates", ("code", "program")), A.Unique("finish_applied", ("code", "program")),
            A.Unique("finish_codes", ("code", "program")), A.Unique("sft_steps", ("sft_code",)),
            A.Unique("finish_code_steps", ("finish_code", "program", "sft_code")),
            A.Unique("finish_code_steps", ("finish_code", "program", "step_order")),
            A.Unique("materials", ("base_spec", "variant")), A.Unique("chemicals", ("cas",)),
            A.Unique("metadata_versions", ("source_name",)),
        ],
        row_checks=[
            A.RowCheck("chemicals", "cas", "invalid_cas_format", "warning",
                       lambda df: F.col("cas").isNotNull() & ~F.col("cas").rlike(A.CAS_PATTERN), ("name",)),
            A.json_check("chemicals", "hazard_flags", ("name",)),
            A.range_check("chemicals", "default_hazard_level", 1, 5, ("name",)),
            A.inverted_range_check("material_chemicals", "pct_wt_low", "pct_wt_high", ("base_spec", "variant", "cas")),
            A.range_check("material_chemicals", "pct_wt_low", 0, float("inf"), ("base_spec", "variant", "cas"),
                          issue="check_failed"),
            A.range_check("material_chemicals", "pct_wt_high", float("-inf"), 100, ("base_spec", "variant", "cas"),
                          issue="check_failed"),
        ],
        sum_limits=[A.SumLimit("material_chemicals", ("base_spec", "variant"), "pct_wt_high", 100.0)],
        compositions=[A.Composition("finish_codes", "code", ("substrate_code", "finish_applied_code"), "seq_id",
                                    ("code", "program"), 2)],
    )
    if extended:
        rules.sequences.append(A.StepSequence("finish_code_steps", ("finish_code", "program"), "step_order"))
    return rules
