"""Column expressions on sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandweave.functions import batches as B

GAP, MISSING = "-", "?"

#: Symbols that each datatype admits, in upper case.
ALPHABETS = {
    "DNA": "-ACTGN?RYMKSWHBVD",
    "RNA": "-ACUGN?RYMKSWHBVD",
    "PROTEIN": "-ABCDEFGHIKLMNPQRSTVWXYZ?U",
}
#: The symbol for any residue.
ANY_RESIDUE = {"DNA": "N", "RNA": "N", "PROTEIN": "X"}


def degap(seq: Column) -> Column:
    return F.translate(seq, GAP, "")


def compact_residues(seq: Column) -> Column:
    """Residues as the sparse form keeps them: gaps and missing marks are left out."""
    return F.translate(seq, GAP + MISSING, "")


def n_residues(seq: Column) -> Column:
    return F.length(degap(seq))


def rna_to_dna(seq: Column) -> Column:
    return F.translate(seq, "U", "T")


def dna_to_rna(seq: Column) -> Column:
    return F.translate(seq, "T", "U")


def is_legal(seq: Column) -> Column:
    return ~seq.rlike("[^a-zA-Z?-]")


def in_alphabet(seq: Column, datatype: str) -> Column:
    letters = ALPHABETS[datatype.upper()]
    return F.length(F.translate(seq, letters + letters.lower(), "")) == 0


def missing_policy(seq: Column, policy: str, datatype: str) -> Column:
    """``absent`` deletes missing marks, ``ambiguous`` makes them the symbol for any residue."""
    if policy == "absent":
        return F.translate(seq, MISSING, "")
    if policy == "ambiguous":
        return F.translate(seq, MISSING, ANY_RESIDUE[datatype.upper()])
    raise ValueError(f"no such policy for missing data: {policy}")


def first_residue(seq: Column) -> Column:
    """0-based place of the first residue; the length if there is none."""
    return F.length(F.regexp_extract(seq, "^-*", 0))


def safe_name(name: Column) -> Column:
    """Letters and digits only, at most 80, in lower case."""
    return F.lower(F.substring(F.regexp_replace(name, "[^a-zA-Z0-9]", ""), 1, 80))


def inline_gap_counts(seq: Column) -> Column:
    """Each run of gaps as ``-`` and its length."""
    parts = F.regexp_extract_all(seq, F.lit("(-+|[^-]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith(GAP), F.concat(F.lit(GAP), F.length(p).cast("string"))).otherwise(p)), "")


def p_distance(a: Column, b: Column) -> Column:
    """Differing columns over columns that are not gaps in both; null where there is none."""
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    some = F.size(F.filter(pairs, lambda p: (p["x"] != GAP) | (p["y"] != GAP)))
    differ = F.size(F.filter(pairs, lambda p: p["x"] != p["y"]))
    return F.try_divide(differ.cast("double"), some.cast("double"))


def tree_model(datatype: Column, model: Column) -> Column:
    """The model name of one tree tool for the options of another. The names of both."""
    gamma, wag = model.contains("-gamma"), model.contains("-wag")
    protein = F.when(wag & gamma, "PROTGAMMAWAGF").when(wag, "PROTCATWAGF").when(gamma, "PROTGAMMAJTTF").otherwise("PROTCATJTTF")
    return F.when(F.upper(datatype) == "PROTEIN", protein).when(gamma, "GTRGAMMA").otherwise("GTRCAT")


def once(**columns: Column) -> Column:
    """Generated columns that are worked out once a row, however often later expressions use them;
    plain projections would be folded into those and repeated."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def symbols(seq: Column) -> Column:
    """The symbols of a row as an array; empty for an empty row, null for null."""
    return F.filter(F.split(seq, ""), lambda ch: ch != "")


def places_of(chars: Column, wanted) -> Column:
    """Ascending 0-based places of the symbols for which ``wanted(symbol)`` holds."""
    return F.filter(F.transform(chars, lambda ch, i: F.when(wanted(ch), i)), lambda i: i.isNotNull())


def _before(places: Column) -> Column:
    """Each place's predecessor; -1 before the first."""
    return F.concat(F.array(F.lit(-1)), F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))))


def placed(seq: Column, places: Column, width: Column) -> Column:
    """The symbols of ``seq`` at ascending ``places``, gaps elsewhere, ``width`` in all.

    Places without a symbol are gaps, symbols without a place go.
    """
    return B.udf("string", B.placed)(seq, places.cast("array<int>"), width.cast("int"))


def flags(places: Column) -> Column:
    """For ascending places, an array that is true at each of them and false between; it ends with the last."""
    parts = F.transform(F.arrays_zip(places.alias("p"), _before(places).alias("b")), lambda x: F.concat(F.array_repeat(F.lit(False), x["p"] - x["b"] - 1), F.array(F.lit(True))))
    return F.flatten(F.filter(parts, lambda x: x.isNotNull()))


def gap_runs(seq: Column) -> Column:
    """Runs of gaps as an array of (first, last), both included, from 0."""
    return B.udf("array<struct<first:int,last:int>>", B.gap_runs)(seq)


def residue_places(seq: Column, but: str = GAP) -> Column:
    """Ascending 0-based places of the symbols that are not among ``but``."""
    return B.udf("array<int>", B.places(but))(seq)


def propagate_gaps(guide: Column, target: Column) -> Column:
    """``target`` spread over ``guide``: a gap where the guide has one, else the target's next symbol.

    The result is as long as the guide: a shorter target ends in gaps, a longer one is cut.
    """
    return B.udf("string", B.propagated)(guide, target)


def impose_structure(primary: Column, structure: Column) -> Column:
    """The structure marks at the primary's residues, brackets of all kinds as round ones, others as dots."""
    pairs = F.filter(F.arrays_zip(F.split(primary, "").alias("p"), F.split(structure, "").alias("s")), lambda x: x["p"] != GAP)
    mark = F.transform(pairs, lambda x: F.when(x["s"].isin("(", "<", "{"), "(").when(x["s"].isin(")", ">", "}"), ")").otherwise("."))
    return F.array_join(mark, "")
