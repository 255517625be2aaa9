"""Queries over notation features, encoding, coordinates and splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from varigrade.functions.notation import FEATURES, mutation_features
from varigrade.operators import columns, coordinates, encoding, folds
from varigrade.plans import evaluation, modelling
from varigrade.plans.registry import STAGES, query
from varigrade.session import materialize

# The notation once more, as SQL: where the change is (site), what stands behind it (tail), then what the two say.
_AA = "[A-Z][a-z]{2}"
STAGES["parsed"] = f"""
    WITH sites AS (
        SELECT *, regexp_extract(mutation, '^(p\\.(?:{_AA})+\\d+(?:_{_AA}\\d+)?|[cn]\\.-?\\d+(?:_-?\\d+)?)', 1) AS place
        FROM notation),
    cut AS (
        SELECT *, substr(mutation, length(place) + 1) AS tail, contains(place, '_') AS ranged, place[1] = 'p' AS protein,
            (length(regexp_extract(place, '^p\\.([A-Za-z]+)', 1)) // 3) AS residues, substr(place, 3, 3) AS first_residue,
            TRY_CAST(regexp_extract(place, '(-?\\d+)', 1) AS INTEGER) AS a,
            TRY_CAST(regexp_extract(place, '_[^-0-9]*(-?\\d+)', 1) AS INTEGER) AS b FROM sites),
    told AS (
        SELECT *, CASE WHEN ranged THEN abs(b - a) + 1 ELSE 1 END AS span, CASE
            WHEN place = '' OR residues > 2 THEN NULL
            WHEN residues = 2 THEN CASE WHEN tail = '*' AND NOT ranged THEN 'nonsense' END
            WHEN protein AND ranged THEN CASE WHEN tail IN ('del', 'dup') THEN tail
                WHEN regexp_full_match(tail, '(del)?ins({_AA})+') THEN replace(regexp_extract(tail, '^[a-z]+'), ' ', '') END
            WHEN protein AND first_residue = 'Ter' AND regexp_full_match(tail, '({_AA})?ext[*][?]') THEN 'extension'
            WHEN protein AND first_residue = 'Ter' AND regexp_full_match(tail, 'delins[?]+') THEN 'delins'
            WHEN protein AND regexp_full_match(tail, '{_AA}') THEN 'missense'
            WHEN protein THEN CASE tail WHEN '*' THEN 'nonsense' WHEN '?' THEN 'uncertain' WHEN 'fs' THEN 'frameshift'
                WHEN 'del' THEN tail WHEN 'dup' THEN tail END
            WHEN regexp_full_match(tail, 'dup[ACGT]*') THEN 'dup'
            WHEN regexp_full_match(tail, 'del[ACGT]*') THEN 'del'
            WHEN regexp_full_match(tail, 'del[ACGT]*ins[ACGT]+') THEN 'delins'
            WHEN ranged AND regexp_full_match(tail, 'ins[ACGT]+') THEN 'ins'
            WHEN NOT ranged AND regexp_full_match(tail, '[ACGT]>[ACGT]') THEN 'SNV' END AS kind FROM cut),
    sized AS (
        SELECT *, length(regexp_extract(tail, 'ins(.*)$', 1)) AS added,
            CASE WHEN kind = 'missense' THEN tail WHEN kind = 'extension' AND tail[1] <> 'e' THEN left(tail, 3) END AS new3
        FROM told)
    SELECT rid, gene, mutation,
        coalesce(kind, CASE WHEN contains(lower(mutation), 'lof') OR contains(lower(mutation), 'loss of function') THEN 'LoF'
            WHEN contains(lower(mutation), 'deletion') THEN 'del' ELSE 'unknown' END) AS mut_type,
        CASE WHEN kind IS NOT NULL THEN a END AS mutation_position,
        CASE WHEN kind IS NOT NULL THEN CASE WHEN left(tail, 3) = 'del' THEN span ELSE 0 END END AS del_len,
        CAST(CASE WHEN kind IS NULL THEN NULL WHEN kind = 'dup' THEN span WHEN protein AND ranged THEN added // 3
            WHEN kind = 'ins' OR (kind = 'delins' AND NOT protein AND NOT ranged) THEN added ELSE 0 END AS INTEGER) AS ins_len,
        CASE WHEN kind = 'SNV' THEN tail[1] WHEN kind IS NOT NULL AND residues = 1 THEN coalesce(r.one, first_residue)
            END AS ref,
        CASE WHEN kind = 'nonsense' THEN '*' WHEN kind = 'SNV' THEN tail[3] WHEN new3 IS NOT NULL THEN coalesce(s.one, new3)
            END AS alt
    FROM sized LEFT JOIN aa r ON r.three = first_residue LEFT JOIN aa s ON s.three = new3"""
STAGES["graded"] = """
    SELECT * EXCLUDE (grade), CASE grade WHEN '5) Not assoc w R' THEN 0 WHEN '4) Not assoc w R - Interim' THEN 1
        WHEN '2) Assoc w R - Interim' THEN 2 WHEN '1) Assoc w R' THEN 3 END AS resistant
    FROM model_table WHERE grade IS NOT NULL AND grade NOT LIKE '3)%'"""
STAGES["drug_ids"] = """
    SELECT drug, row_number() OVER (ORDER BY drug) - 1 AS id FROM (SELECT DISTINCT drug FROM graded WHERE drug IS NOT NULL)"""
STAGES["common_genes"] = "SELECT gene FROM graded GROUP BY gene HAVING count(*) >= 10"
#: Elements of a drug descriptor.
WIDTH = 64
STAGES["clean_rows"] = """
    SELECT g.ppv, k.gene, g.drug_norm, g.position, g.mean_log2mic_final, g.mic_count_final, g.has_exact_mic,
        g.has_variant_mic, g.resistant, 'missense' AS mut_type,
        CAST(regexp_extract(mutation, '\\d+') AS INTEGER) AS mutation_position, 0 AS del_len, 0 AS ins_len,
        r.one AS ref, a.one AS alt, coalesce(i.id, -1) AS drug, CAST(coalesce(length(g.reference_nucleotide), 3) AS INTEGER) AS ref_len,
        CAST(coalesce(length(g.alternative_nucleotide), 3) AS INTEGER) AS alt_len,
        CASE WHEN length(g.reference_nucleotide) = 1 THEN g.reference_nucleotide ELSE 'LONG' END AS ref_base,
        CASE WHEN length(g.alternative_nucleotide) = 1 THEN g.alternative_nucleotide ELSE 'LONG' END AS alt_base,
        %s, CASE WHEN d.drug IS NULL THEN 0 ELSE 1 END AS has_descriptor
    FROM graded g LEFT JOIN drug_ids i ON g.drug = i.drug LEFT JOIN common_genes k ON g.gene = k.gene
    LEFT JOIN descriptors d ON g.drug = d.drug
    LEFT JOIN aa r ON r.three = substr(mutation, 3, 3) LEFT JOIN aa a ON a.three = right(mutation, 3)""" % ", ".join(f"d.embedding[{i + 1}] AS e_{i}" for i in range(WIDTH))
STAGES["grouped"] = """
    SELECT *, CASE WHEN position IS NULL THEN 'unknown_mutation'
        ELSE concat('gene_', coalesce(gene, 'unknown'), '_', position) END AS mutation_key FROM model_table"""


# notation

@query("SELECT * FROM parsed")
def parse_mutation(t):
    return modelling.parse_mutation(t["notation"])


@query("SELECT * FROM parsed")
def parse_mutation_in_place(t):
    return modelling.parse_mutation(t["notation"], dictionary=False)


@query("SELECT rid, mut_type, mutation_position, del_len, ins_len, ref, alt FROM parsed")
def struct_to_columns(t):
    parsed = mutation_features(t["notation"], "mutation")
    return columns.struct_to_columns(parsed.select("rid", F.struct(*FEATURES).alias("features")), "features")


@query("""SELECT gene, mut_type, count(*) AS n_rows, count(DISTINCT mutation_position) AS n_positions,
    avg(del_len) AS mean_del_len, avg(ins_len) AS mean_ins_len,
    count(*) / sum(count(*)) OVER (PARTITION BY gene) AS share FROM parsed GROUP BY gene, mut_type""")
def mutation_profile(t):
    return modelling.mutation_profile(t["notation"])


@query("""SELECT mutation, count(*) AS n FROM parsed WHERE mut_type = 'unknown' GROUP BY mutation
    ORDER BY n DESC, mutation LIMIT 20""")
def unparsed_mutations(t):
    return modelling.unparsed_mutations(t["notation"])


# encoding

@query("""SELECT c.variant, k.gene AS gene FROM cleaned c LEFT JOIN (
    SELECT gene FROM cleaned GROUP BY gene HAVING count(*) >= 600) k ON c.gene = k.gene""")
def prune_rare_categories(t):
    return encoding.prune_rare_categories(t.cleaned.select("variant", "gene"), "gene", 600)


_GRADES = ("1) Assoc w R", "2) Assoc w R - Interim", "3) Uncertain significance", "4) Not assoc w R - Interim",
           "5) Not assoc w R")


def _flags(column: str, levels) -> str:
    return ", ".join(f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS \"{column}_{v}\"" for v in levels)


@query(f"SELECT variant, {_flags('grade', _GRADES)} FROM cleaned")
def one_hot(t):
    return encoding.one_hot(t.cleaned.select("variant", "grade"), ["grade"])


@query(f"SELECT variant, {_flags('grade', _GRADES[1:])} FROM cleaned")
def one_hot_drop_first(t):
    return encoding.one_hot_drop_first(t.cleaned.select("variant", "grade"), ["grade"])


@query(f"SELECT variant, {_flags('grade', _GRADES)} FROM cleaned")
def one_hot_vectors(t):
    rows = t.cleaned.select("variant", "grade")
    hot = encoding.one_hot_vectors(["grade"]).fit(rows).transform(rows)
    spread = hot.select("variant", vector_to_array("grade_hot").alias("v"))
    return spread.select("variant", *[F.col("v")[i].cast("int").alias(f"grade_{v}") for i, v in enumerate(_GRADES)])


@query("""SELECT c.variant, c.drug, coalesce(i.id, -1) AS drug_code FROM cleaned c LEFT JOIN (
    SELECT drug, row_number() OVER (ORDER BY drug) - 1 AS id FROM (SELECT DISTINCT drug FROM cleaned WHERE drug IS NOT NULL)
    ) i ON c.drug = i.drug""")
def category_codes(t):
    return encoding.category_codes(t.cleaned.select("variant", "drug"), "drug", "drug_code")[0]


@query("""SELECT mutation AS value, row_number() OVER (ORDER BY mutation) - 1 AS id FROM (
    SELECT DISTINCT mutation FROM notation)""")
def build_vocab(t):
    return encoding.build_vocab(t["notation"], "mutation")


@query("""SELECT n.rid, n.mutation, coalesce(v.id, 0) AS mutation_id FROM notation n LEFT JOIN (
    SELECT mutation, row_number() OVER (ORDER BY mutation) - 1 AS id FROM (
        SELECT DISTINCT mutation FROM notation WHERE mutation LIKE 'p.%')) v ON n.mutation = v.mutation""")
def encode_with_vocab(t):
    rows = t["notation"].select("rid", "mutation")
    vocabulary = encoding.build_vocab(rows.filter(F.col("mutation").startswith("p.")), "mutation")
    return encoding.encode_with_vocab(rows, "mutation", vocabulary, "mutation_id")


@query("SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS e_{i}" for i in range(64)) + " FROM embeddings")
def array_to_columns(t):
    return columns.array_to_columns(t["embeddings"].select("vec_id", "embedding"), "embedding", "e", 64)


@query("""SELECT p_partkey, "column", value FROM (
    UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(constant AS DOUBLE) AS constant
        FROM numbers) ON p_size, p_retailprice, constant INTO NAME "column" VALUE value)""")
def unpivot_matrix(t):
    numbers = t["numbers"].select("p_partkey", F.col("p_size").cast("double"), "p_retailprice",
                                  F.col("constant").cast("double"))
    return columns.unpivot_columns(numbers, ["p_partkey"])


# coordinates

@query("""SELECT variant, CAST(coalesce(length(reference_nucleotide), 3) AS INTEGER) AS ref_len,
    CAST(coalesce(length(alternative_nucleotide), 3) AS INTEGER) AS alt_len,
    CASE WHEN length(reference_nucleotide) = 1 THEN reference_nucleotide ELSE 'LONG' END AS ref_base,
    CASE WHEN length(alternative_nucleotide) = 1 THEN alternative_nucleotide ELSE 'LONG' END AS alt_base FROM placed""")
def allele_length_bucket(t):
    return coordinates.allele_length_bucket(
        t.placed.select("variant", "reference_nucleotide", "alternative_nucleotide"))


@query("""SELECT variant, position, CASE WHEN position IS NOT NULL THEN
    concat('gene_', coalesce(k.gene, 'unknown'), '_', position) END AS mutation_key
    FROM placed p LEFT JOIN (SELECT gene FROM cleaned GROUP BY gene HAVING count(*) >= 600) k ON p.gene = k.gene""")
def mutation_key(t):
    rows = t.placed.select("variant", "gene", "position")
    kept = encoding.prune_rare_categories(t.cleaned.select("gene"), "gene", 600, "kept").select("gene", "kept").distinct()
    return coordinates.mutation_key(rows.join(kept, "gene", "left"), gene="kept").drop("gene", "kept")


@query("""SELECT p.variant, p.position, (p.position - l.start_pos + 1) / (l.stop_pos - l.start_pos + 1) AS norm_position,
    (l.stop_pos - l.start_pos + 1) - (p.position - l.start_pos + 1) AS distance_to_end,
    ((p.position - l.start_pos + 1) % 3 + 3) % 3 AS codon_position
    FROM placed p LEFT JOIN (SELECT * FROM loci WHERE name IN (SELECT gene FROM cleaned)) l
    ON lower(p.gene) = lower(l.name)""")
def gene_coordinates(t):
    rows = t.placed.select("variant", "gene", "position")
    return coordinates.attach_gene_coordinates(rows, t["loci"]).drop("gene")


# feature tables

def _elements(features):
    """The descriptor's elements in place of the array, which the SQL check compares as plain numbers."""
    return features.withColumns({f"e_{i}": F.get("embedding", F.lit(i)) for i in range(WIDTH)}).drop("embedding")


@query("SELECT * FROM clean_rows")
def clean_features(t):
    return _elements(evaluation.feature_tables(t.model, t["loci"], t["descriptors"])[0])


@query("""SELECT c.*, CASE WHEN c.position IS NOT NULL THEN
        concat('gene_', coalesce(c.gene, 'unknown'), '_', c.position) END AS mutation_key,
    (c.position - l.start_pos + 1) / (l.stop_pos - l.start_pos + 1) AS norm_position,
    (l.stop_pos - l.start_pos + 1) - (c.position - l.start_pos + 1) AS distance_to_end,
    ((c.position - l.start_pos + 1) % 3 + 3) % 3 AS codon_position
    FROM clean_rows c LEFT JOIN (SELECT * FROM loci WHERE name IN (SELECT gene FROM clean_rows)) l
    ON lower(c.gene) = lower(l.name)""")
def positioned_features(t):
    return _elements(evaluation.feature_tables(t.model, t["loci"], t["descriptors"])[1])


# splits

@query("""WITH RECURSIVE sizes AS (
        SELECT row_number() OVER (ORDER BY n DESC, mutation_key) AS i, n FROM (
            SELECT mutation_key, count(*) AS n FROM grouped GROUP BY mutation_key)),
    greedy(i, n, fold, l0, l1, l2, l3, l4) AS (
        SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
            CAST(0 AS BIGINT), CAST(0 AS BIGINT)
        UNION ALL
        SELECT i, n, f, l0 + CASE f WHEN 0 THEN n ELSE 0 END, l1 + CASE f WHEN 1 THEN n ELSE 0 END,
            l2 + CASE f WHEN 2 THEN n ELSE 0 END, l3 + CASE f WHEN 3 THEN n ELSE 0 END,
            l4 + CASE f WHEN 4 THEN n ELSE 0 END
        FROM (SELECT s.i, s.n, g.l0, g.l1, g.l2, g.l3, g.l4,
            CASE least(g.l0, g.l1, g.l2, g.l3, g.l4) WHEN g.l0 THEN 0 WHEN g.l1 THEN 1 WHEN g.l2 THEN 2 WHEN g.l3 THEN 3
                ELSE 4 END AS f FROM greedy g JOIN sizes s ON s.i = g.i + 1))
    SELECT fold, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS largest FROM greedy WHERE i > 0
    GROUP BY fold""")
def group_kfold(t):
    # written once: the group counts and the join back both read it
    keyed = materialize(coordinates.mutation_key(t.model.select("gene", "position")))
    split = folds.group_kfold(keyed, "mutation_key", 5, missing=coordinates.UNKNOWN_MUTATION)
    sizes = split.groupBy("fold", "mutation_key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("fold").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"),
                                     F.max("n").alias("largest"))


@query("""SELECT l_orderkey, l_linenumber, substr(md5(concat('42:', l_orderkey)), 1, 8) < '33333333' AS is_test
    FROM lineitem""")
def random_split(t):
    train, test = folds.random_split(t["lineitem"].select("l_orderkey", "l_linenumber"), "l_orderkey")
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("""SELECT fold, count(*) AS n_unseen, array_to_string(list_sort(list(mutation))[1:10], ' ') AS sample
    FROM (SELECT DISTINCT fold, mutation FROM log) GROUP BY fold""")
def fold_unseen_groups(t):
    return folds.fold_unseen_groups(t["predictions"], "mutation").withColumn("sample", F.array_join("sample", " "))
