import pytest
from pyspark.sql import functions as F

from varigrade.functions.notation import aa_change, aa_index, aa_three_to_one
from varigrade.plans.measurements import to_hgvs_variant
from varigrade.plans.modelling import mutation_profile, parse_mutation, unparsed_mutations

# text -> (type, position, deleted, inserted, ref, alt)
CASES = {
    "p.Cys31Ser": ("missense", 31, 0, 0, "C", "S"),
    "p.Phe8Ter": ("missense", 8, 0, 0, "F", "*"),
    "p.Qqq6Www": ("missense", 6, 0, 0, "Qqq", "Www"),
    "p.Gly17*": ("nonsense", 17, 0, 0, "G", "*"),
    "p.PheSer44*": ("nonsense", 44, 0, 0, None, "*"),
    "p.Lys73fs": ("frameshift", 73, 0, 0, "K", None),
    "p.Arg2?": ("uncertain", 2, 0, 0, "R", None),
    "p.Ile60del": ("del", 60, 1, 0, "I", None),
    "p.Asn20_Glu24del": ("del", 20, 5, 0, "N", None),
    "p.Tyr11dup": ("dup", 11, 0, 1, "Y", None),
    "p.Gln5_Trp6dup": ("dup", 5, 0, 2, "Q", None),
    "p.Met90_Lys91insArgCysPhe": ("ins", 90, 0, 3, "M", None),
    "p.Tyr12_Ile14delinsHisAsn": ("delins", 12, 3, 2, "Y", None),
    "p.Ter300Lysext*?": ("extension", 300, 0, 0, "*", "K"),
    "p.Ter300ext*?": ("extension", 300, 0, 0, "*", None),
    "p.Ter41delins??": ("delins", 41, 1, 0, "*", None),
    "n.-28T>C": ("SNV", -28, 0, 0, "T", "C"),
    "c.77G>T": ("SNV", 77, 0, 0, "G", "T"),
    "n.9delC": ("del", 9, 1, 0, None, None),
    "n.14_19del": ("del", 14, 6, 0, None, None),
    "c.-12_-9delTTCA": ("del", -12, 4, 0, None, None),
    "n.30_31insCA": ("ins", 30, 0, 2, None, None),
    "c.18delGinsCAT": ("delins", 18, 1, 3, None, None),
    "n.21_22delinsGC": ("delins", 21, 2, 0, None, None),
    "n.16dupT": ("dup", 16, 0, 1, None, None),
    "c.40_44dup": ("dup", 40, 0, 5, None, None),
    "geneX_LOF": ("LoF", None, None, None, None, None),
    "a loss of function": ("LoF", None, None, None, None, None),
    "deletion, hence lof": ("LoF", None, None, None, None, None),
    "partial deletion": ("del", None, None, None, None, None),
    "p.Cys3_deletion": ("del", None, None, None, None, None),
}
UNKNOWN = (
    "p.ala1val", "p.Ala1Val trailing", "p.Ala1Val1", "xp.Ala1Val", "c.1A>N", "c.5insA", "p.Ala5insGly", "p.TrpLeu266del",
    "p.AlaVal1fs", "p.Ala5_Val7fs", "p.Ala5_Val7*", "p.Ala5delinsGly", "p.Ala5delins???", "p.Ala5ext*?", "p.Ter5_Ala6ext*?",
    "c.5_7A>G", "n.5_delA", "p.Val3_Thr4insA", "p.Val3_Thr4insGlyS", "c.5_6insGGX", "c.A5", "", "a|b|c|d|fs", "p.A|l|1|2|del",
    "p.Ala1Val\nx",
)


@pytest.mark.parametrize("dictionary", [True, False])
def test_grammar(spark, dictionary):
    rows = [(t,) for t in [*CASES, *UNKNOWN]]
    df = spark.createDataFrame(rows, "mutation string")
    got = {r.mutation: tuple(r)[1:] for r in parse_mutation(df, dictionary=dictionary).collect()}
    for text, expected in CASES.items():
        assert got[text] == expected, text
    for text in UNKNOWN:
        assert got[text] == ("unknown", None, None, None, None, None), text


def test_null_padding_and_repeats(spark):
    df = spark.createDataFrame([(None,), (" p.Ala2Val\t",), ("p.Ala2Val",), ("p.Ala2Val",)], "mutation string")
    rows = parse_mutation(df).collect()
    assert len(rows) == 4
    assert sorted(str(r.mut_type) for r in rows) == ["None", "missense", "missense", "missense"]


def test_profile_and_unparsed(spark):
    texts = [("g", "p.Ala2Val"), ("g", "p.Ala3Val"), ("g", "odd"), ("g", "odd"), ("h", "c.1_3del"), ("h", "weird")]
    df = spark.createDataFrame(texts, "gene string, mutation string")
    profile = {(r.gene, r.mut_type): r for r in mutation_profile(df).collect()}
    assert profile["g", "missense"].n_rows == 2 and profile["g", "missense"].n_positions == 2
    assert profile["g", "unknown"].share == 0.5 and profile["g", "unknown"].mean_del_len is None
    assert profile["h", "del"].mean_del_len == 3.0
    assert [(r.mutation, r.n) for r in unparsed_mutations(df, top=1).collect()] == [("odd", 2)]


def test_variant_names(spark):
    df = spark.createDataFrame(
        [(" rpoB ", " s450l "), ("katG", "S315*"), ("katG", "S315del"), ("katG", "B3L"), (None, "S450L"), ("katG", None)],
        "gene string, mutation string")
    assert [r.variant for r in to_hgvs_variant(df).collect()] == ["rpoB_p.Ser450Leu", "katG_p.Ser315Ter"]
    assert to_hgvs_variant(df, stop="*").collect()[1].variant == "katG_p.Ser315*"


def test_residues(spark):
    df = spark.createDataFrame([("S450L",), ("*5X",), ("SxL",), ("S",)], "change string")
    rows = [tuple(r[0]) for r in df.select(aa_change(F.col("change"))).collect()]
    assert rows == [(15, 450, 10), (None, 5, 20), (15, None, 10), (15, None, 15)]
    codes = spark.createDataFrame([("Ter",), ("Stop",), ("Zzz",), (None,)], "c string")
    assert [r[0] for r in codes.select(aa_three_to_one(F.col("c"))).collect()] == ["*", "*", "Zzz", None]
    assert [r[0] for r in codes.select(aa_index(F.substring("c", 1, 1))).collect()] == [16, 15, 20, 20]
