"""Queries over scans, columns, keys, joins and measurement aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from varigrade.functions.keys import normalize_key, stringify_strip
from varigrade.functions.notation import aa_three_to_one
from varigrade.functions.scores import cast_float32, evidence_weight, ppv_bin
from varigrade.operators import aggregates, columns, joins
from varigrade.plans import measurements, modelling
from varigrade.plans.registry import query
from varigrade.sources import readers, sinks


#: Documents of one file that ``verify_manifest`` checks.
PART_DOCS = 4_000


# scans and sinks

@query("SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_quantity >= 40")
def scan_parquet(t):
    path = f"{t.sf_dir}/lineitem.parquet"
    return readers.scan_parquet(t.spark, path, ["l_orderkey", "l_quantity", "l_returnflag"]).filter("l_quantity >= 40")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS drug_code, n_name AS drug_name FROM nation")
def scan_csv_gz(t):
    path = t.scratch("codes")
    t["nation"].selectExpr("string(n_nationkey) drug_code", "n_name drug_name").write.option(
        "header", True).csv(path, compression="gzip")
    return readers.scan_csv_gz(t.spark, path)


@query('SELECT variant, chromosome, position, reference_nucleotide, alternative_nucleotide FROM located')
def scan_tsv(t):
    path = t.scratch("positions")
    modelling.clean_positions(t["positions"]).drop("variant_norm").write.csv(path, sep="\t", header=True)
    return readers.scan_tsv(t.spark, path, readers.GENOMIC_POSITIONS)


@query('SELECT start_pos AS "Start", stop_pos AS "Stop", name AS "Name" FROM loci')
def trim_headers(t):
    path = t.scratch("loci")
    t["loci"].selectExpr("start_pos ` Start`", "stop_pos `Stop `", "name ` Name `").write.csv(path, sep="\t", header=True)
    return readers.scan_tsv_by_name(t.spark, path, {"Start": "bigint", "Stop": "bigint", "Name": "string"})


def _ragged(t) -> str:
    """All parts as a tab-separated table with blanks in its headers, columns nobody asks for, bad prices and lines cut or too long."""
    path, header = t.scratch("ragged"), "p_name\t p_retailprice \tp_partkey \tp_size"
    price = F.when(F.expr("p_size % 7 = 0"), "n/a").otherwise(F.col("p_retailprice").cast("string"))
    line = F.concat_ws("\t", "p_name", price, "p_partkey", "p_size")
    cut, longer = F.concat_ws("\t", "p_name", price), F.concat_ws("\t", line, F.lit("more"))
    shaped = F.when(F.expr("p_size % 11 = 0"), cut).when(F.expr("p_size % 11 = 1"), longer).otherwise(line)
    t["part"].select(shaped.alias(header)).write.csv(
        path, sep="\x01", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


_PRICES = {"p_partkey": "bigint", "p_retailprice": "double"}


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size % 11 > 1 AND p_size % 7 <> 0")
def scan_by_header(t):
    return readers.scan_by_header(t.spark, _ragged(t), _PRICES)[0]


@query("""SELECT CASE WHEN p_size % 11 <= 1 THEN 'line' ELSE 'p_retailprice' END AS "column", count(*) AS n FROM part
    WHERE p_size % 11 <= 1 OR p_size % 7 = 0 GROUP BY ALL""")
def scan_rejected(t):
    rejected = readers.scan_by_header(t.spark, _ragged(t), _PRICES)[1]
    return rejected.groupBy("column").agg(F.sum("n").alias("n"))


@query("SELECT * FROM measured")
def sink_parquet(t):
    path = t.scratch("measured")
    sinks.sink_parquet(t.measured, path)
    return t.spark.read.parquet(path)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def sink_csv(t):
    path = t.scratch("summary")
    sinks.sink_csv(aggregates.value_counts(t["events"], "event_type"), path)
    return t.spark.read.schema("event_type string, n bigint").csv(path, header=True)


@query("SELECT * FROM mic_groups")
def cache_table(t):
    path, inputs = t.scratch("stage"), [f"{t.sf_dir}/{name}.parquet" for name in ("lineitem", "orders")]
    sinks.cache_table(t.spark, path, lambda: aggregates.agg_variant_mic(t.measured), inputs)
    return sinks.cache_table(t.spark, path, lambda: aggregates.agg_variant_mic(t.measured), inputs)


@query("""SELECT concat('nation-', n_nationkey) AS name, CASE WHEN n_nationkey % 5 = 4 THEN 'missing'
    WHEN n_nationkey % 5 = 3 THEN 'mismatch' ELSE 'ok' END AS status FROM nation""")
def verify_manifest(t):
    """Files of all documents' texts, some for each nation, against a manifest worked out from the rows.

    A nation takes every 25th id, a file ``PART_DOCS`` documents of it and the first file the nation's name as its last line.
    Of some nations one file is not written, or its last line is another.
    """
    path = t.scratch("release")
    nation = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(25))
    docs = t["documents"].select(
        nation.cast("int").alias("nation"), F.coalesce(F.floor(F.col("doc_id") / (25 * PART_DOCS)), F.lit(0)).cast("int").alias("part"),
        F.lit(0).alias("last"), "doc_id", F.coalesce("text", F.lit("")).alias("line"))
    names = t["nation"].select(F.col("n_nationkey").cast("int").alias("nation"), F.lit(0).alias("part"), F.lit(1).alias("last"),
                               F.lit(None).cast("long").alias("doc_id"), F.col("n_name").alias("line"))
    order = ["nation", "part", "last", "doc_id", "line"]
    rows = docs.unionByName(names).repartition("nation", "part").sortWithinPartitions(*order)
    (rows.filter("nation % 5 <> 4 or part <> 0").select("nation", "part", "line").write.partitionBy("nation", "part").text(path))
    held = F.when((F.col("nation") % 5 == 3) & (F.col("last") == 1), "another").otherwise(F.col("line"))
    manifest = rows.select(F.concat_ws("/", "nation", "part").alias("name"), held.alias("line")).mapInArrow(
        readers.line_md5, "name string, md5 string")
    name = F.concat_ws("/", F.regexp_extract("path", "nation=([^/]+)/", 1), F.regexp_extract("path", "part=([^/]+)/", 1))
    checked = readers.compare_checksums(manifest, readers.file_checksums(t.spark, path, name=name))
    worst = F.max(F.when(F.col("status") == "missing", 2).when(F.col("status") == "mismatch", 1).otherwise(0))
    return checked.groupBy(F.concat(F.lit("nation-"), F.split("name", "/")[0]).alias("name")).agg(
        F.element_at(F.array(*map(F.lit, ("ok", "mismatch", "missing"))), worst + 1).alias("status"))


# columns

@query('SELECT "DRUG" AS drug, "GENE" AS gene, "MUTATION" AS mutation, "VARIANT" AS variant, '
       '"FINAL CONFIDENCE GRADING" AS grade, "PPV_DATASET ALL" AS ppv FROM catalogue')
def rename_columns(t):
    return columns.rename_columns(t["catalogue"], modelling.CATALOGUE_NAMES | {"absent": "still_absent"})


@query('SELECT "GENE", "PPV_DATASET ALL" FROM catalogue')
def project_columns(t):
    return columns.project_columns(t["catalogue"], ["GENE", "PPV_DATASET ALL"])


@query("SELECT uniqueid, log2mic FROM phenotypes")
def drop_if_exists(t):
    return columns.drop_if_exists(t["phenotypes"], ["drug", "phenotype_quality", "absent"])


@query("SELECT uniqueid, gene, mutation FROM mutations")
def dedupe_columns(t):
    m = t["mutations"]
    return columns.dedupe_columns(m.select("uniqueid", "gene", "mutation", F.lower("gene").alias("gene")))


@query("SELECT p_partkey, p_size, p_retailprice, constant, gappy, CASE WHEN isnan(wild) THEN NULL ELSE wild END AS wild "
       "FROM numbers")
def select_by_dtype(t):
    return columns.nan_to_null(columns.select_by_dtype(t["numbers"]))


@query("SELECT m.*, p.drug, p.log2mic, p.phenotype_quality FROM mutations m JOIN phenotypes p "
       "ON m.uniqueid = p.uniqueid WHERE p.log2mic IS NOT NULL AND m.codes_protein AND p.phenotype_quality IS NOT NULL "
       "AND NOT m.is_minor AND m.ref IS NOT NULL AND m.alt IS NOT NULL")
def filter_phenotyped(t):
    return columns.filter_phenotyped(joins.join_isolate_phenotype(t["mutations"], t["phenotypes"]))


@query("SELECT * FROM cleaned WHERE ppv > 0")
def filter_positive(t):
    return columns.filter_positive(t.cleaned)


@query("SELECT coalesce(drug_norm IN ('amikacin', 'kanamycin', 'streptomycin'), false) AS is_test, count(*) AS n, "
       "count(ppv) AS n_ppv FROM cleaned GROUP BY 1")
def isin_split(t):
    train, test = columns.isin_split(t.cleaned, "drug_norm", ["amikacin", "kanamycin", "streptomycin"])
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return both.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.count("ppv").alias("n_ppv"))


@query('SELECT "VARIANT" AS raw, lower(replace(trim("VARIANT"), \' \', \'\')) AS variant_norm, '
       'lower(replace(trim("DRUG"), \' \', \'\')) AS drug_norm FROM catalogue', name="normalize_key")
def normalize_key_columns(t):
    return t["catalogue"].select(F.col("VARIANT").alias("raw"), normalize_key(F.col("VARIANT")).alias("variant_norm"),
                                 normalize_key(F.col("DRUG")).alias("drug_norm"))


@query('SELECT coalesce(trim("DRUG"), \'nan\') AS drug_text, trim("DRUG") AS drug FROM catalogue', name="stringify_strip")
def stringify_strip_columns(t):
    return t["catalogue"].select(stringify_strip(F.col("DRUG"), "nan").alias("drug_text"),
                                 stringify_strip(F.col("DRUG")).alias("drug"))


@query("SELECT uniqueid, CAST(log2mic AS FLOAT) AS log2mic FROM phenotypes", name="cast_float32")
def cast_float32_column(t):
    return t["phenotypes"].select("uniqueid", cast_float32(F.col("log2mic")).alias("log2mic"))


@query("SELECT variant, drug_norm, mean_log2mic_final, mic_count_final, has_exact_mic, has_variant_mic FROM merged")
def mic_fallback(t):
    return t.merged.select("variant", "drug_norm", "mean_log2mic_final", "mic_count_final", "has_exact_mic",
                           "has_variant_mic")


@query("""SELECT mutation, drug, gene, variant, ppv, drug_norm, CASE grade WHEN '5) Not assoc w R' THEN 0
    WHEN '4) Not assoc w R - Interim' THEN 1 WHEN '2) Assoc w R - Interim' THEN 2 WHEN '1) Assoc w R' THEN 3 END
    AS resistant FROM cleaned WHERE grade IS NOT NULL AND grade NOT LIKE '3)%'""")
def encode_grade(t):
    return columns.encode_grade(t.cleaned)


@query("""SELECT variant, ppv, CASE WHEN ppv >= 0.8 THEN 3 WHEN ppv >= 0.6 THEN 2 WHEN ppv >= 0.2 THEN 1 ELSE 0 END
    AS ppv_bin FROM cleaned""", name="ppv_bin")
def ppv_bin_column(t):
    return t.cleaned.select("variant", "ppv", ppv_bin(F.col("ppv")).alias("ppv_bin"))


@query("SELECT variant, 3 * has_exact_mic + 1 + 2 * has_variant_mic AS weight FROM merged", name="evidence_weight")
def evidence_weight_column(t):
    return t.merged.select("variant", evidence_weight(F.col("has_exact_mic"), F.col("has_variant_mic")).alias("weight"))


@query("SELECT p_partkey, CASE WHEN wild IS NULL OR isnan(wild) OR isinf(wild) THEN -1.0 ELSE wild END AS wild, "
       "coalesce(gappy, -1) AS gappy FROM numbers")
def sanitize_sentinel(t):
    return columns.sanitize_numeric(t["numbers"].select("p_partkey", "wild", "gappy"))


@query("SELECT p_partkey, coalesce(gappy, 7) AS gappy, CASE WHEN isnan(wild) THEN 0.0 ELSE coalesce(wild, 0) END AS wild "
       "FROM numbers")
def fill_constants(t):
    return columns.fill_constants(t["numbers"].select("p_partkey", "gappy", "wild"), {"gappy": 7})


@query("SELECT p_partkey, gappy, wild FROM numbers WHERE gappy IS NOT NULL AND wild IS NOT NULL AND NOT isnan(wild)")
def drop_null_rows(t):
    return columns.drop_null_rows(t["numbers"].select("p_partkey", "gappy", "wild"))


@query("SELECT p_partkey, p_size, p_retailprice, p_brand, constant FROM numbers")
def drop_null_columns(t):
    return columns.drop_null_columns(t["numbers"])


@query("""SELECT 'gappy' AS "column", count(*) FILTER (gappy IS NULL) AS n_missing FROM numbers UNION ALL
    SELECT 'wild', count(*) FILTER (wild IS NULL OR isnan(wild)) FROM numbers""")
def null_profile(t):
    return columns.null_profile(columns.nan_to_null(t["numbers"]))


# variant names

@query("SELECT * FROM mic_named")
def to_hgvs_variant(t):
    return measurements.to_hgvs_variant(aggregates.agg_variant_mic(t.measured))


@query("""SELECT gene, count(*) AS n_rows, count(*) FILTER (ok) AS n_converted, count(*) FILTER (NOT ok) AS n_dropped
    FROM (SELECT gene, regexp_full_match(upper(trim(mutation)), '[ARNDCQEGHILKMFPSTWYV*]\\d+[ARNDCQEGHILKMFPSTWYV*]')
    AS ok FROM mutations) GROUP BY gene""")
def hgvs_coverage(t):
    return measurements.hgvs_coverage(t["mutations"])


@query("""SELECT uniqueid, mutation, CAST(CASE WHEN instr('ARNDCQEGHILKMFPSTWYVX', w) > 0
    THEN instr('ARNDCQEGHILKMFPSTWYVX', w) - 1 END AS INTEGER) AS wt_aa,
    TRY_CAST(substr(mutation, 2, greatest(length(mutation) - 2, 0)) AS INTEGER) AS position,
    CAST(CASE WHEN instr('ARNDCQEGHILKMFPSTWYVX', m) > 0
    THEN instr('ARNDCQEGHILKMFPSTWYVX', m) - 1 END AS INTEGER) AS mut_aa
    FROM (SELECT uniqueid, mutation, left(mutation, 1) AS w, right(mutation, 1) AS m FROM (
        SELECT uniqueid, upper(trim(mutation)) AS mutation FROM mutations))""")
def split_aa_change(t):
    upper = t["mutations"].select("uniqueid", F.upper(F.trim("mutation")).alias("mutation"))
    return measurements.split_aa_change(upper)


@query("""SELECT code, coalesce(one, code) AS letter, count(*) AS n FROM (
    SELECT substr("MUTATION", 3, 3) AS code FROM catalogue) LEFT JOIN aa ON code = three GROUP BY ALL""", name="aa_three_to_one")
def aa_three_to_one_codes(t):
    codes = t["catalogue"].select(F.substring("MUTATION", 3, 3).alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("letter", aa_three_to_one(F.col("code")))


# joins

@query("SELECT m.*, p.drug, p.log2mic, p.phenotype_quality FROM mutations m JOIN phenotypes p ON m.uniqueid = p.uniqueid")
def join_isolate_phenotype(t):
    return joins.join_isolate_phenotype(t["mutations"], t["phenotypes"])


@query("SELECT p.*, d.drug_name FROM phenotypes p LEFT JOIN drug_codes d ON p.drug = d.drug_code")
def join_drug_dim(t):
    return joins.join_drug_dim(t["phenotypes"], t["drug_codes"])


@query("SELECT * FROM placed")
def join_variant_positions(t):
    return t.placed


@query("SELECT * FROM exact_mic")
def join_mic_exact(t):
    mic = t.mic.select("variant_norm", "drug_norm", "mean_log2mic", "median_log2mic", "count")
    return joins.join_mic_exact(t.placed, mic)


@query("SELECT m.variant, m.drug_norm, v.* EXCLUDE (variant_norm), m.variant_norm FROM placed m "
       "LEFT JOIN variant_mic v ON m.variant_norm = v.variant_norm")
def join_mic_variant(t):
    placed = t.placed.select("variant", "drug_norm", "variant_norm")
    return joins.join_mic_variant(placed, aggregates.agg_variant_fallback(t.mic))


@query("""SELECT c.variant, c.drug, d.embedding[1] AS e0, d.embedding[64] AS e63,
    CASE WHEN d.embedding[1] > 0 THEN 1 WHEN d.embedding IS NOT NULL THEN 0 END AS f0
    FROM cleaned c LEFT JOIN descriptors d ON c.drug = d.drug""")
def join_drug_descriptors(t):
    rich = t["descriptors"].withColumn("fingerprint", F.transform("embedding", lambda x: (x > 0).cast("int")))
    joined = joins.join_drug_descriptors(t.cleaned, rich)
    return joined.select("variant", "drug", F.col("embedding")[0].alias("e0"), F.col("embedding")[63].alias("e63"),
                         F.col("fingerprint")[0].alias("f0"))


@query("SELECT c.variant, c.drug, list_sum(d.embedding::DOUBLE[]) AS total, len(d.embedding) AS width "
       "FROM cleaned c LEFT JOIN descriptors d ON c.drug = d.drug")
def map_lookup_vector(t):
    joined = joins.map_lookup_vector(t.cleaned.select("variant", "drug"), t["descriptors"], "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return joined.select("variant", "drug", total.alias("total"),
                         F.size("embedding").cast("bigint").alias("width"))


@query("SELECT m.variant, m.gene, l.start_pos, l.stop_pos FROM model_table m "
       "LEFT JOIN loci l ON lower(trim(m.gene)) = lower(trim(l.name))")
def join_gene_loci(t):
    return joins.join_gene_loci(t.model.select("variant", "gene"), t["loci"])


@query("SELECT * FROM loci WHERE name IN (SELECT gene FROM cleaned)")
def semi_needed_genes(t):
    return joins.semi_needed_genes(t["loci"], t.cleaned.select("gene").distinct())


@query("SELECT DISTINCT gene AS value FROM mutations WHERE gene IS NOT NULL AND gene NOT IN (SELECT gene FROM cleaned)")
def anti_unseen_vocab(t):
    return joins.anti_unseen_vocab(t["mutations"], aggregates.distinct_values(t.cleaned, "gene"), "gene")


# aggregates

@query("SELECT * FROM mic_groups")
def agg_variant_mic(t):
    return aggregates.agg_variant_mic(t.measured)


@query("SELECT * FROM mic_named")
def variant_mic_summary(t):
    return t.summary


@query("SELECT * FROM variant_mic")
def agg_variant_fallback(t):
    return aggregates.agg_variant_fallback(t.mic)


@query("SELECT DISTINCT gene AS value FROM measured")
def distinct_values(t):
    return aggregates.distinct_values(t.measured, "gene")


@query("SELECT grade, count(*) AS n FROM cleaned WHERE grade IS NOT NULL GROUP BY grade")
def value_counts(t):
    return aggregates.value_counts(t.cleaned, "grade")


@query("""SELECT 'grade' AS "column", count(DISTINCT grade) AS n_unique FROM cleaned UNION ALL
    SELECT 'variant', count(DISTINCT variant) FROM cleaned UNION ALL
    SELECT 'drug', count(DISTINCT drug) FROM cleaned""")
def n_unique(t):
    return aggregates.n_unique(t.cleaned, ["grade", "variant", "drug"])


@query("SELECT gene, count(*) AS n FROM cleaned GROUP BY gene ORDER BY n DESC")
def order_summary(t):
    return aggregates.order_summary(t.cleaned.groupBy("gene").agg(F.count(F.lit(1)).alias("n")), "n")


@query("""WITH samples AS (SELECT DISTINCT uniqueid AS sample, drug, log2mic > 2 AS resistant FROM phenotypes
        WHERE log2mic IS NOT NULL),
    carriers AS (SELECT DISTINCT uniqueid AS sample, concat(gene, '_', trim(mutation)) AS mutation FROM mutations),
    totals AS (SELECT drug, count(*) FILTER (resistant) AS r, count(*) FILTER (NOT resistant) AS s FROM samples GROUP BY drug),
    pairs AS (SELECT mutation, drug, count(*) FILTER (resistant) AS a, count(*) FILTER (NOT resistant) AS b
        FROM carriers JOIN samples USING (sample) GROUP BY mutation, drug)
    SELECT mutation, drug, a, b, r - a AS c, s - b AS d, a / nullif(a + r - a, 0) AS sensitivity,
        (s - b) / nullif(s, 0) AS specificity, a / nullif(a + b, 0) AS ppv,
        (a / nullif(b, 0)) / nullif((r - a) / nullif(s - b, 0), 0) AS odds_ratio
    FROM pairs JOIN totals USING (drug)""")
def contingency_metrics(t):
    tested = t["phenotypes"].filter("log2mic is not null").select(
        F.col("uniqueid").alias("sample"), "drug", (F.col("log2mic") > 2).alias("resistant")).distinct()
    carriers = t["mutations"].select(
        F.col("uniqueid").alias("sample"), F.concat_ws("_", "gene", F.trim("mutation")).alias("mutation"))
    return aggregates.mutation_contingency(carriers, tested)


@query("""WITH listed AS (SELECT DISTINCT m.uniqueid, m.gene, m.mutation FROM mutations m
        JOIN (SELECT DISTINCT gene, mutation FROM mic_groups) c ON m.gene = c.gene AND m.mutation = c.mutation)
    SELECT uniqueid, gene, mutation FROM (SELECT *, count(*) OVER (PARTITION BY uniqueid) AS n FROM listed) WHERE n = 1""")
def solo_filter(t):
    """The catalogue here: variants with a measurement summary."""
    return aggregates.solo_filter(t["mutations"], t.mic, ["gene", "mutation"], "uniqueid").select(
        "uniqueid", "gene", "mutation")


@query("SELECT * FROM merged")
def merge_measurements(t):
    return t.merged


@query("SELECT * FROM model_table")
def modelling_table(t):
    return t.model
