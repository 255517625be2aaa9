"""Input tables of the analytics jobs, derived from whole generic tables.

Each table is a list of (column, expression) over one Parquet table. The expressions are plain SQL that
Spark and an ANSI SQL engine both accept, so the same text feeds the operators and their checks. No table is
filtered: the derived tables grow with the given ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_GENE = "concat('Gene', cast(floor(l_suppkey / 4) as bigint))"
_NUMBER = "1 + l_linenumber"
_REF = "substr('AAARN', cast(1 + l_partkey % 5 as int), 1)"
_ALT = "substr('VVVVLG*', cast(1 + l_orderkey % 7 as int), 1)"
_REF3 = "substr('AlaAlaAlaArgAsn', cast(1 + 3 * (l_partkey % 5) as int), 3)"
_ALT3 = "substr('ValValValValLeuGlyTer', cast(1 + 3 * (l_orderkey % 7) as int), 3)"
_CHANGE3 = f"concat({_REF3}, {_NUMBER}, {_ALT3})"
_A = "(l_partkey % 900 + 1)"
_B = "(l_partkey % 900 + 1 + l_linenumber)"

# One notation text per shape; {a} and {b} are positions.
_SHAPES = (
    "p.Cys{a}Ser", "p.Gly{a}*", "p.Lys{a}fs", "p.Ile{a}del", "p.Tyr{a}dup", "p.Arg{a}?", "p.PheSer{a}*",
    "p.Asn{a}_Glu{b}del", "p.Gln{a}_Trp{b}dup", "p.Met{a}_Lys{b}insArgCysPhe", "p.Tyr{a}_Ile{b}delinsHisAsn",
    "p.Ter{a}Lysext*?", "p.Ter{a}ext*?", "p.Ter{a}delins??", "n.-{a}T>C", "c.{a}del", "n.{a}dupT", "c.{a}delGinsCA",
    "n.{a}_{b}delTTC", "c.{a}_{b}insCAT", "n.{a}_{b}delinsGC", "c.-{b}_-{a}dup", "geneX_lof", "partial deletion",
    "p.cys{a}ser", "n.7G>R",
)


def _notation() -> str:
    arms = " ".join(f"when {number} then '{shape}'" for number, shape in enumerate(_SHAPES))
    shape = f"case cast(l_partkey % {len(_SHAPES)} as int) {arms} end"
    return f"replace(replace({shape}, '{{a}}', concat({_A}, '')), '{{b}}', concat({_B}, ''))"


TABLES = {
    "mutations": ("lineitem", [
        ("uniqueid", "l_orderkey"),
        ("gene", f"case when l_tax > 0.075 then lower({_GENE}) else {_GENE} end"),
        ("mutation", f"case when l_discount > 0.095 then concat(' ', lower(concat({_REF}, {_NUMBER}, {_ALT}))) "
                     f"when l_discount < 0.005 then concat({_REF}, {_NUMBER}, {_ALT}, '_del') "
                     f"else concat({_REF}, {_NUMBER}, {_ALT}) end"),
        ("amino_acid_number", f"cast({_NUMBER} as int)"),
        ("ref", f"case when l_quantity = 13 then null else {_REF} end"),
        ("alt", _ALT),
        ("codes_protein", "l_returnflag <> 'R'"),
        ("is_minor", "l_linestatus = 'F'"),
    ]),
    "phenotypes": ("orders", [
        ("uniqueid", "o_orderkey"),
        ("drug", "substr(o_orderpriority, 1, 1)"),
        ("log2mic", "case when o_orderstatus = 'P' then null else "
                    "cast(cast(floor(o_totalprice) as bigint) % 23 as double) * 0.5 - 3 end"),
        ("phenotype_quality", "case when o_orderpriority = '2-HIGH' and o_orderstatus = 'O' then null "
                              "else o_orderstatus end"),
    ]),
    "catalogue": ("lineitem", [
        ("DRUG", "case cast(cast(l_quantity as bigint) % 5 as int) when 0 then 'Amikacin' when 1 then ' kanamycin ' "
                 "when 2 then 'Streptomycin' when 3 then 'Isoniazid' end"),
        ("GENE", _GENE),
        ("MUTATION", f"concat('p.', {_CHANGE3})"),
        ("VARIANT", f"concat(case when l_linenumber = 1 then ' ' else '' end, {_GENE}, '_p.', {_CHANGE3})"),
        ("FINAL CONFIDENCE GRADING", "case cast(cast(floor(l_extendedprice) as bigint) % 6 as int) "
                                     "when 0 then '1) Assoc w R' when 1 then '2) Assoc w R - Interim' "
                                     "when 2 then '3) Uncertain significance' when 3 then '4) Not assoc w R - Interim' "
                                     "when 4 then '5) Not assoc w R' end"),
        ("PPV_DATASET ALL", "case when l_discount = 0 then null else l_discount * 10 end"),
    ]),
    "positions": ("part", [
        ("variant", "concat('Gene', cast(floor(p_partkey / 80) as bigint), '_p.Ala', 2 + p_size % 25, 'Val', "
                    "case when p_size = 7 then ' ' else '' end)"),
        ("chromosome", "'chr1'"),
        ("position", "cast(1000 * cast(floor(p_partkey / 80) as bigint) + p_size as bigint)"),
        ("reference_nucleotide", "case when p_size % 9 = 0 then null else "
                                 "substr('ACGT', cast(1 + p_partkey % 4 as int), 1) end"),
        ("alternative_nucleotide", "case when p_size % 5 = 0 then 'ACG' else "
                                   "substr('CGTA', cast(1 + p_partkey % 4 as int), 1) end"),
    ]),
    "loci": ("supplier", [
        ("name", "concat(case when s_suppkey % 10 = 9 then 'GENE' else 'Gene' end, s_suppkey)"),
        ("start_pos", "1000 * s_suppkey + 1"),
        ("stop_pos", "1000 * s_suppkey + 300 + 3 * s_suppkey"),
    ]),
    "descriptors": ("embeddings", [
        ("drug", "case cast(vec_id as int) when 0 then 'Amikacin' when 1 then 'Kanamycin' when 2 then 'Streptomycin' "
                 "when 3 then 'Isoniazid' else concat('Compound', vec_id) end"),
        ("embedding", "embedding"),
    ]),
    "notation": ("lineitem", [
        ("rid", "l_orderkey * 8 + l_linenumber"),
        ("gene", _GENE),
        ("mutation", _notation()),
    ]),
    "regression": ("events", [
        ("event_id", "event_id"),
        ("event_type", "event_type"),
        ("actual", "value"),
        ("predicted", "value * 0.5 + user_id % 8"),
    ]),
    "numbers": ("part", [
        ("p_partkey", "p_partkey"),
        ("p_size", "p_size"),
        ("p_retailprice", "p_retailprice"),
        ("p_brand", "p_brand"),
        ("constant", "cast(1 as int)"),
        ("gappy", "case when p_size % 7 = 0 then null else cast(p_size * 2 as int) end"),
        ("wild", "case when p_size % 11 = 0 then cast('Infinity' as double) when p_size % 11 = 1 then null "
                 "when p_size % 11 = 2 then cast('NaN' as double) else p_retailprice end"),
    ]),
}

_PREDICTIONS = """
select d.doc_id, cast(d.doc_id % 5 as int) as fold, concat('m', d.doc_id % 97) as mutation,
       cast(coalesce(l.quality, 0) + 2 * coalesce(l.toxic, 0) as int) as actual,
       cast((d.doc_id * 7 + d.n_chars) % 4 as int) as predicted
from documents d left join labels l on d.doc_id = l.doc_id
"""
_DRUG_CODES = """
select * from (values ('1', 'Amikacin'), ('2', 'Kanamycin'), ('3', 'Streptomycin'), ('4', 'Isoniazid'))
as codes(drug_code, drug_name)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, a derived table, or one of ``predictions`` and ``drug_codes``."""
    if name == "drug_codes":
        return spark.sql(_DRUG_CODES)
    if name == "predictions":
        return spark.sql(_PREDICTIONS.replace("from documents", "from {documents}").replace("join labels", "join {labels}"),
                         documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
    if name in TABLES:
        source, columns = TABLES[name]
        return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(
            *[f"{expression} AS `{column}`" for column, expression in columns])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_sql(name: str) -> str:
    """The same table as a SQL query over the given tables."""
    if name == "drug_codes":
        return _DRUG_CODES
    if name == "predictions":
        return _PREDICTIONS
    source, columns = TABLES[name]
    listed = ", ".join(f'{expression} AS "{column}"' for column, expression in columns)
    return f"SELECT {listed} FROM {source}"
