"""Registered queries: a callable over the given tables, and the same result as plain SQL where SQL can say it."""

from __future__ import annotations

import re
from collections import UserDict
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from varigrade.plans import fixtures, measurements, modelling
from varigrade.session import materialize, scratch_path


class SqlTexts(UserDict):
    """SQL by query; the stages a text mentions are put in front when it is asked for, whatever was registered first."""

    def __getitem__(self, name: str) -> str:
        return assemble(super().__getitem__(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES = SqlTexts()


class Tables:
    """Given and derived tables of one data folder, and the stages that several queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    @cached_property
    def measured(self) -> DataFrame:
        return measurements.measured_mutations(self["mutations"], self["phenotypes"], self["drug_codes"])

    @cached_property
    def summary(self) -> DataFrame:
        return measurements.variant_mic_summary(self["mutations"], self["phenotypes"], self["drug_codes"])

    @cached_property
    def mic(self) -> DataFrame:
        """The summary as a written stage, since several joins and aggregates read it."""
        return measurements.with_join_keys(materialize(self.summary))

    @cached_property
    def cleaned(self) -> DataFrame:
        return modelling.clean_catalogue(self["catalogue"])

    @cached_property
    def placed(self) -> DataFrame:
        return modelling.join_variant_positions(self.cleaned, modelling.clean_positions(self["positions"]))

    @cached_property
    def merged(self) -> DataFrame:
        return modelling.merge_measurements(self.cleaned, modelling.clean_positions(self["positions"]), self.mic)

    @cached_property
    def model(self) -> DataFrame:
        return modelling.modelling_table(self.cleaned, modelling.clean_positions(self["positions"]), self.mic)


# Stages of the SQL texts; each may use those before it.
STAGES = {name: fixtures.table_sql(name) for name in (*fixtures.TABLES, "predictions", "drug_codes")} | {
    "aa": """SELECT * FROM (VALUES ('A','Ala'),('R','Arg'),('N','Asn'),('D','Asp'),('C','Cys'),('Q','Gln'),('E','Glu'),
        ('G','Gly'),('H','His'),('I','Ile'),('L','Leu'),('K','Lys'),('M','Met'),('F','Phe'),('P','Pro'),('S','Ser'),
        ('T','Thr'),('W','Trp'),('Y','Tyr'),('V','Val'),('*','Ter')) AS t(one, three)""",
    "measured": """SELECT m.gene, m.mutation, m.amino_acid_number AS gene_position, m.ref, m.alt, p.drug, d.drug_name,
        p.log2mic FROM mutations m JOIN phenotypes p ON m.uniqueid = p.uniqueid
        LEFT JOIN drug_codes d ON p.drug = d.drug_code
        WHERE p.log2mic IS NOT NULL AND m.codes_protein AND m.ref IS NOT NULL AND m.alt IS NOT NULL""",
    "mic_groups": """SELECT gene, mutation, gene_position, ref, alt, drug, drug_name, avg(log2mic) AS mean_log2mic,
        median(log2mic) AS median_log2mic, count(*) AS "count" FROM measured
        GROUP BY ALL HAVING count(*) >= 5""",
    "mic_named": """SELECT g.*, concat(trim(g.gene), '_p.', r.three,
        regexp_extract(upper(trim(g.mutation)), '^[A-Z*](\\d+)[A-Z*]$', 1), a.three) AS variant
        FROM mic_groups g
        JOIN aa r ON r.one = regexp_extract(upper(trim(g.mutation)), '^([A-Z*])\\d+[A-Z*]$', 1)
        JOIN aa a ON a.one = regexp_extract(upper(trim(g.mutation)), '^[A-Z*]\\d+([A-Z*])$', 1)""",
    "mic": """SELECT *, lower(replace(variant, ' ', '')) AS variant_norm,
        lower(replace(trim(drug_name), ' ', '')) AS drug_norm FROM mic_named""",
    "cleaned": """SELECT "MUTATION" AS mutation, "DRUG" AS drug, "GENE" AS gene, "FINAL CONFIDENCE GRADING" AS grade,
        "VARIANT" AS variant, "PPV_DATASET ALL" AS ppv, lower(replace(trim("DRUG"), ' ', '')) AS drug_norm
        FROM catalogue""",
    "located": """SELECT trim(variant) AS variant, lower(replace(trim(variant), ' ', '')) AS variant_norm, chromosome,
        position, reference_nucleotide, alternative_nucleotide FROM positions""",
    "placed": """SELECT c.*, l.variant_norm, l.chromosome, l.position, l.reference_nucleotide, l.alternative_nucleotide
        FROM cleaned c LEFT JOIN located l ON c.variant = l.variant""",
    "exact_mic": """SELECT p.*, m.mean_log2mic, m.median_log2mic, m."count" FROM placed p LEFT JOIN mic m
        ON p.variant_norm IS NOT DISTINCT FROM m.variant_norm AND p.drug_norm IS NOT DISTINCT FROM m.drug_norm""",
    "variant_mic": """SELECT variant_norm, avg(mean_log2mic) AS mean_log2mic_variant,
        median(median_log2mic) AS median_log2mic_variant, CAST(sum("count") AS BIGINT) AS count_variant
        FROM mic WHERE variant_norm IS NOT NULL GROUP BY variant_norm""",
    "merged": """SELECT e.*, v.mean_log2mic_variant, v.median_log2mic_variant, v.count_variant,
        CASE WHEN e.mean_log2mic IS NULL THEN 0 ELSE 1 END AS has_exact_mic,
        CASE WHEN v.mean_log2mic_variant IS NULL THEN 0 ELSE 1 END AS has_variant_mic,
        coalesce(e.mean_log2mic, v.mean_log2mic_variant, 0.0) AS mean_log2mic_final,
        coalesce(e."count", v.count_variant, 0) AS mic_count_final
        FROM exact_mic e LEFT JOIN variant_mic v ON e.variant_norm = v.variant_norm""",
    "model_table": """SELECT mutation, drug, ppv, gene, grade, variant, drug_norm, chromosome, position,
        reference_nucleotide, alternative_nucleotide, mean_log2mic_final, mic_count_final, has_exact_mic,
        has_variant_mic FROM merged WHERE ppv > 0""",
    "kept_genes": "SELECT gene FROM model_table WHERE gene IS NOT NULL GROUP BY gene HAVING count(*) >= 10",
    "log": "SELECT * FROM predictions",
    "models_log": """SELECT 'a' AS model, * FROM predictions UNION ALL
        SELECT 'b' AS model, doc_id, fold, mutation, actual, (predicted + 1) % 4 AS predicted FROM predictions""",
}


def assemble(sql: str) -> str:
    """Prefix the stages that ``sql`` mentions, in order."""
    needed: set[str] = set()

    def mention(text: str) -> None:
        for name in STAGES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                mention(STAGES[name])

    mention(sql)
    chain = ", ".join(f"{name} AS ({STAGES[name]})" for name in STAGES if name in needed)
    if not chain:
        return sql
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    body = sql.replace("WITH RECURSIVE", ",", 1) if recursive else sql.replace("WITH", ",", 1) if \
        sql.lstrip().startswith("WITH") else sql
    return f"WITH {recursive}{chain} {body}"


def query(sql: str | None = None, name: str | None = None):
    """Register a function of ``Tables`` under its own name or ``name``, with the SQL that gives the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register
