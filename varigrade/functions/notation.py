"""Amino-acid codes and mutation notation as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrade.functions.keys import strip

# Amino-acid codes (three letters to one).
AA_THREE_TO_ONE = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C",
    "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
    "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P",
    "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
    "Ter": "*", "Stop": "*",
}
# Position of each letter in the residue alphabet; anything else takes the last one.
AA_INDEX = {letter: i for i, letter in enumerate("ARNDCQEGHILKMFPSTWYVX")}
AA_UNKNOWN = AA_INDEX["X"]


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def aa_three_to_one(code: Column) -> Column:
    """One-letter code; an unknown code is returned unchanged."""
    return F.coalesce(_lookup(AA_THREE_TO_ONE, code), code)


def aa_index(letter: Column, default: int = AA_UNKNOWN) -> Column:
    """Residue index on the 21-letter alphabet; missing and unknown letters take ``default``."""
    return F.coalesce(_lookup(AA_INDEX, letter), F.lit(default))


# A one-letter substitution such as S450L.
SUBSTITUTION = r"^[ARNDCQEGHILKMFPSTWYV*]\d+[ARNDCQEGHILKMFPSTWYV*]$"


def is_substitution(mutation: Column) -> Column:
    """True where the text is a one-letter substitution, whatever its case and padding."""
    return F.upper(strip(mutation)).rlike(SUBSTITUTION)


def hgvs_variant(gene: Column, mutation: Column, stop: str = "Ter") -> Column:
    """``gene_p.Ref3PosAlt3`` of a row that ``is_substitution``; ``stop`` is the text for a stop codon (``Ter`` or ``*``)."""
    three = {one: three for three, one in AA_THREE_TO_ONE.items() if one != "*"} | {"*": stop}
    text = F.upper(strip(mutation))
    number = F.substr(text, F.lit(2), F.length(text) - 2)
    return F.concat(strip(gene), F.lit("_p."), _lookup(three, F.left(text, F.lit(1))), number,
                    _lookup(three, F.right(text, F.lit(1))))


def aa_change(change: Column) -> Column:
    """Struct (wt_aa, position, mut_aa) of a substitution; null where a part cannot be read."""
    number = F.substr(change, F.lit(2), F.length(change) - 2)
    return F.struct(
        _lookup(AA_INDEX, F.substr(change, F.lit(1), F.lit(1))).alias("wt_aa"),
        number.try_cast("int").alias("position"),
        _lookup(AA_INDEX, F.substr(change, F.length(change), F.lit(1))).alias("mut_aa"),
    )


# The notation grammar. A name is a site (residues and numbers of a protein change, or the
# numbers of a nucleotide change) followed by a tail; the tail says what happened there.
_AA = "[A-Z][a-z]{2}"
SITE = rf"^(?:p\.({_AA})({_AA})?(\d+)(?:_{_AA}(\d+))?|[cn]\.(-?\d+)(?:_(-?\d+))?)(.*)$"
SITE_PARTS = "$1|$2|$3$5|$4$6|$7"
# Tails by kind of site: on one residue, on a residue range, on the stop codon, on one base, on a base range.
RESIDUE_TAILS = (
    ("fs", "frameshift"), (r"\*", "nonsense"), (r"\?", "uncertain"), ("del", "del"), (_AA, "missense"), ("dup", "dup"),
)
RESIDUE_RANGE_TAILS = (
    ("del", "del"), ("dup", "dup"), (f"ins(?:{_AA})+", "ins"), (f"delins(?:{_AA})+", "delins"),
)
STOP_TAILS = ((rf"(?:{_AA})?ext\*\?", "extension"), (r"delins\?+", "delins"))
BASE_TAILS = (
    ("[ACGT]>[ACGT]", "SNV"), ("del[ACGT]*", "del"), ("del[ACGT]*ins[ACGT]+", "delins"), ("dup[ACGT]*", "dup"),
)
BASE_RANGE_TAILS = (
    ("del[ACGT]*", "del"), ("ins[ACGT]+", "ins"), ("del[ACGT]*ins[ACGT]+", "delins"), ("dup[ACGT]*", "dup"),
)
FREE_TEXT_TYPES = (("lof", "LoF"), ("loss of function", "LoF"), ("deletion", "del"))

FEATURES = ("mut_type", "mutation_position", "del_len", "ins_len", "ref", "alt")


def _tail_type(tail: Column, tails: tuple[tuple[str, str], ...]) -> Column:
    arms = F
    for shape, kind in tails:
        arms = arms.when(tail.rlike(f"^{shape}$"), kind)
    return arms.otherwise(None)


def _free_text_type(text: Column) -> Column:
    arms = F
    for phrase, kind in FREE_TEXT_TYPES:
        arms = arms.when(F.lower(text).contains(phrase), kind)
    return arms.when(text.isNotNull(), "unknown")


def mutation_features(df: DataFrame, column: str) -> DataFrame:
    """Add ``FEATURES`` of the notation text in ``column``, row by row with no shuffle; a null text gives nulls.

    One pattern takes the text apart into residue, second residue, start, end and tail; the tail then meets
    only the few shapes that fit its kind of site. Deletion and insertion lengths are 0 where not involved; a
    delins over a base range has no insertion length.
    """
    text = F.col("_text")
    parts = F.split(F.when(text.rlike(SITE), F.regexp_replace(text, SITE, SITE_PARTS)), r"\|", 5)
    names = ("_residue", "_second", "_start", "_end", "_tail")
    sited = df.withColumn("_text", strip(F.col(column))).withColumn("_part", parts).select(
        "*", *[F.get("_part", F.lit(i)).alias(name) for i, name in enumerate(names)])

    residue, tail = F.col("_residue"), F.col("_tail")
    ranged = F.col("_end") != ""
    protein = F.when(F.col("_second") != "", F.when(~ranged & (tail == "*"), "nonsense")).otherwise(F.coalesce(
        F.when(~ranged & (residue == "Ter"), _tail_type(tail, STOP_TAILS)),
        F.when(ranged, _tail_type(tail, RESIDUE_RANGE_TAILS)).otherwise(_tail_type(tail, RESIDUE_TAILS))))
    nucleotide = F.when(ranged, _tail_type(tail, BASE_RANGE_TAILS)).otherwise(_tail_type(tail, BASE_TAILS))
    typed = sited.withColumns({
        "_kind": F.when(residue != "", protein).when(residue == "", nucleotide),
        "_from": F.col("_start").try_cast("int"),
        "_span": F.when(ranged, F.abs(F.col("_end").try_cast("int") - F.col("_start").try_cast("int")) + 1).otherwise(1),
    })

    kind, is_protein = F.col("_kind"), residue != ""
    inserted = F.length(F.regexp_extract(tail, "ins(.*)$", 1))
    del_len = F.when(tail.startswith("del"), F.col("_span")).otherwise(0)
    ins_len = (
        F.when(kind == "dup", F.col("_span"))
        .when(is_protein & ranged & kind.isin("ins", "delins"), (inserted / 3).cast("int"))
        .when((kind == "ins") | ((kind == "delins") & ~is_protein & ~ranged), inserted)
        .otherwise(0))
    ref = F.when(is_protein & (F.col("_second") == ""), aa_three_to_one(residue)).when(
        kind == "SNV", F.substring(tail, 1, 1))
    alt = (
        F.when(kind == "nonsense", "*").when(kind == "missense", aa_three_to_one(tail))
        .when(kind == "SNV", F.substring(tail, 3, 1))
        .when((kind == "extension") & (tail != "ext*?"), aa_three_to_one(F.substring(tail, 1, 3))))
    known = kind.isNotNull()
    values = (F.coalesce(kind, _free_text_type(text)), F.when(known, F.col("_from")), F.when(known, del_len),
              F.when(known, ins_len), F.when(known, ref), F.when(known, alt))
    return typed.select(*[F.col(f"`{c}`") for c in df.columns],
                        *[value.alias(name) for name, value in zip(FEATURES, values)])
