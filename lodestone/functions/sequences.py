"""Column builders for biological sequences and text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC nucleotide codes, their complements, and the bases each stands for.
CODES = "ACGTUMRWSYKVHDBNX"
COMPLEMENTS = "TGCAAKYWSRMBDHVNX"
STANDS_FOR = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT",
}
# The standard genetic code, bases in the order TCAG.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
GENETIC_CODE = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES + CODES.lower(), COMPLEMENTS + COMPLEMENTS.lower()))


def to_dna(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def to_rna(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def to_iupac(seq: Column) -> Column:
    """Symbols that are no nucleotide code become N; gaps stay."""
    return F.regexp_replace(F.upper(seq), r"[^ACGTUMRWSYKVHDBN.\-_]", "N")


def dealign(seq: Column) -> Column:
    return F.regexp_replace(seq, r"[-._~ ]", "")


def gc_share(seq: Column) -> Column:
    n = F.length(seq)
    return F.when(n > 0, (n - F.length(F.regexp_replace(seq, "[GCgc]", ""))) / n).otherwise(0.0)


def translate(seq: Column, frame: int = 0) -> Column:
    """Amino acids of whole codons from a frame; an unclear codon is X. Codons are cut in one pass, as a place in a text is found by walking to it."""
    code = F.create_map(*[F.lit(x) for kv in GENETIC_CODE.items() for x in kv])
    dna = F.coalesce(F.substring(F.upper(to_dna(seq)), frame + 1, (1 << 31) - 1), F.lit(""))
    codons = F.regexp_extract_all(dna, F.lit("(?s).{3}"), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.element_at(code, c), F.lit("X"))), "")


def degenerate_pattern(pattern: str) -> str:
    """A regular expression for an IUPAC pattern."""
    return "".join(f"[{STANDS_FOR[c]}]" if c in STANDS_FOR else c for c in pattern.upper())


def identity(a: Column, b: Column) -> Column:
    """Equal positions over the shorter ungapped length of two aligned sequences."""
    gap = r"[-._~ ]"
    x, y = F.split(a, ""), F.split(b, "")
    equal = F.aggregate(F.zip_with(x, y, lambda p, q: F.when((p == q) & ~p.rlike(gap), 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    short = F.least(F.length(F.regexp_replace(a, gap, "")), F.length(F.regexp_replace(b, gap, "")))
    return F.when(short > 0, equal / short).otherwise(0.0)


def sequence_format(first_line: Column) -> Column:
    """The format that a file's first line names."""
    return (
        F.when(first_line.rlike(r"^# STOCKHOLM 1\."), "stockholm")
        .when(first_line.rlike(r"^CLUSTAL"), "clustal")
        .when(first_line.rlike(r"(?i)^#NEXUS"), "nexus")
        .when(first_line.rlike(r"^!!|MSF:.*\.\.\s*$"), "msf")
        .when(first_line.rlike(r"^LOCUS"), "genbank")
        .when(first_line.rlike(r"^ID   "), "embl")
        .when(first_line.rlike(r"^>(P1|F1|DL|DC|RL|RC|N1|N3|XX);"), "pir")
        .when(first_line.rlike(r"^>"), "fasta")
        .when(first_line.rlike(r"^\s*\d+\s+\d+"), "phylip")
        .when(first_line.rlike(r"^;"), "ig")
        .otherwise("raw")
    )


def gcg_checksum(seq: Column) -> Column:
    """Sum of symbol codes weighted 1 to 57 cyclically, modulo 10000."""
    codes = F.transform(F.split(F.upper(seq), ""), lambda c, i: (i % 57 + 1) * F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda s, v: s + v) % 10000


def sequence_type(seq: Column) -> Column:
    """``dna``, ``rna``, ``protein`` or ``other``: by the letters that only one of them has; a sequence of bases alone is DNA or, with U, RNA."""
    letters = F.upper(dealign(seq))
    bases = letters.rlike(r"^[ACGTUN]+$")
    return (
        F.when(bases & letters.contains("U") & ~letters.contains("T"), "rna").when(bases, "dna")
        .when(letters.rlike(r"[EFIPQLJOZ*]") & letters.rlike(r"^[A-Z*]+$"), "protein").when(letters.rlike(f"^[{CODES}]+$"), "dna").otherwise("other")
    )


def digitise(seq: Column) -> Column:
    """Each symbol's place among the nucleotide codes, -1 for others."""
    return F.transform(F.filter(F.split(F.upper(seq), ""), lambda c: c != ""), lambda c: F.instr(F.lit(CODES), c) - 1)


def degenerate_score(a: Column, b: Column, match: float = 1.0, mismatch: float = -1.0) -> Column:
    """The mean score of the bases that two codes stand for."""
    stands = F.create_map(*[F.lit(x) for k, v in STANDS_FOR.items() for x in (k, v)])
    x, y = (F.filter(F.split(F.element_at(stands, F.upper(c)), ""), lambda s: s != "") for c in (a, b))
    same = F.size(F.array_intersect(x, y))
    pairs = F.size(x) * F.size(y)
    return (same * match + (pairs - same) * mismatch) / pairs
