"""Bases, ambiguity codes, codons and genotypes as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ambiguity code and the bases it stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}
COMPLEMENT = ("ACGTMRWSYKVHDBNacgtmrwsykvhdbn", "TGCAKYWSRMBDHVNtgcakywsrmbdhvn")
#: Amino acids of the standard code, codons in TCAG order, stops as _.
AMINO = "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def genetic_code() -> dict[str, str]:
    return dict(zip(map("".join, product("TCAG", repeat=3)), AMINO, strict=True))


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def diploid_code(a: Column, b: Column) -> Column:
    """The ambiguity code of two base letters; anything else is N."""
    pair = F.when(a <= b, F.concat(a, b)).otherwise(F.concat(b, a))
    codes = {x + y: next(k for k, v in IUPAC.items() if v == "".join(sorted({x, y}))) for x in "ACGT" for y in "ACGT" if x <= y}
    return F.coalesce(F.try_element_at(_map(codes), pair), F.lit("N"))


def diploid_alleles(code: Column) -> Column:
    """The two letters that a diploid code stands for."""
    pairs = {k: v if len(v) == 2 else v * 2 for k, v in IUPAC.items() if len(v) <= 2} | {"N": "NN"}
    return F.coalesce(F.try_element_at(_map(pairs), code), F.lit("NN"))


def haploid_letter(code: Column) -> Column:
    """A code as a haploid call: one base stays, ambiguity becomes N."""
    return F.when(code.isin(*"ACGT"), code).otherwise("N")


def consensus(bases: Column) -> Column:
    """The code of a set of letters given as text in base order; empty: N."""
    return F.coalesce(F.try_element_at(_map({v: k for k, v in IUPAC.items()}), bases), F.lit("N"))


def complement(seq: Column) -> Column:
    return F.translate(seq, *COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def expand_ambiguity(seq: Column) -> Column:
    """All sequences that an ambiguous one stands for, as an array in base order."""
    letters = F.filter(F.split(seq, ""), lambda x: x != "")
    options = _map(IUPAC)
    return F.aggregate(
        letters,
        F.array(F.lit("")),
        lambda acc, x: F.flatten(F.transform(acc, lambda p: F.transform(F.filter(F.split(F.coalesce(F.try_element_at(options, x), x), ""), lambda y: y != ""), lambda y: F.concat(p, y)))),
    )


def pieces(seq: Column, size: int) -> Column:
    """A text cut into pieces of ``size`` letters (the last may be shorter), in one pass over it."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def codons(seq: Column) -> Column:
    """Whole codons of a sequence, in one pass over it; none of null."""
    return F.regexp_extract_all(F.coalesce(seq, F.lit("")), F.lit("(?s)..."), F.lit(0))


def translate(seq: Column) -> Column:
    """Amino acids; _ for stop, X for what has no amino acid."""
    return F.array_join(F.transform(codons(seq), lambda c: F.coalesce(F.try_element_at(_map(genetic_code()), c), F.lit("X"))), "")


def count_stops(seq: Column, terminal: bool = False) -> Column:
    """Stop codons; the last codon counts only if ``terminal``."""
    inner = seq if terminal else F.substring(seq, F.lit(1), F.greatest(F.floor(F.length(seq) / 3) * 3 - 3, F.lit(0)).cast("int"))
    return F.size(F.filter(codons(inner), lambda c: c.isin(*[k for k, v in genetic_code().items() if v == "_"]))).cast("long")


def possible_codons(sets: Column) -> Column:
    """All codons of three texts of bases."""
    split = lambda x: F.filter(F.split(x, ""), lambda y: y != "")
    return F.aggregate(sets, F.array(F.lit("")), lambda acc, x: F.flatten(F.transform(acc, lambda p: F.transform(split(x), lambda y: F.concat(p, y)))))


def possible_amino_acids(sets: Column) -> Column:
    code = _map(genetic_code())
    return F.array_distinct(F.transform(possible_codons(sets), lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))))


def syn_non(sets: Column) -> Column:
    """syn or non if exactly one position has two alleles and the others one; else null."""
    sizes = F.transform(sets, lambda x: F.length(x))
    one = (F.size(F.filter(sizes, lambda n: n == 2)) == 1) & (F.size(F.filter(sizes, lambda n: n == 1)) == 2)
    return F.when(one, F.when(F.size(possible_amino_acids(sets)) == 1, "syn").otherwise("non"))


def degeneracy(sets: Column, position: int) -> Column:
    """0, 2 or 4 by how many amino acids the position (0..2) can give; else null.

    Defined where the other two positions have one allele. Four amino acids: 0, two or
    three: 2, one: 4; a stop counts as an amino acid.
    """
    others = [i for i in range(3) if i != position]
    ok = (F.length(sets[others[0]]) == 1) & (F.length(sets[others[1]]) == 1) & (F.length(sets[position]) >= 1)
    full = F.array(*[F.lit("ACGT") if i == position else sets[i] for i in range(3)])
    n = F.size(possible_amino_acids(full))
    return F.when(ok, F.when(n == 1, 4).when(n == 4, 0).otherwise(2))


def cds_positions(cds: Column, strand: Column, trim: bool = False) -> Column:
    """Genome positions of a coding sequence (array of start, end) in reading order."""
    p = F.flatten(F.transform(F.array_sort(cds), lambda x: F.sequence(x["start"], x["end"])))
    p = F.when(strand == "-", F.reverse(p)).otherwise(p)
    return F.slice(p, F.lit(1), (F.floor(F.size(p) / 3) * 3).cast("int")) if trim else p


def split_genotype(gt: Column) -> Column:
    """Letters of a genotype text, phased (A|T, A/T) or plain (AT)."""
    return F.filter(F.split(F.regexp_replace(gt, r"[/|]", ""), ""), lambda x: x != "")


def two_sequences(genotypes: Column, diploid_codes: bool = False) -> Column:
    """The two haplotypes (array of two texts) of an array of diploid genotypes: AT, A|T or codes.

    A genotype without two letters is N in both.
    """
    two = lambda g: split_genotype(diploid_alleles(g) if diploid_codes else F.coalesce(g, F.lit("")))
    return F.array(*[F.array_join(F.transform(genotypes, lambda g: F.when(F.size(two(g)) == 2, F.get(two(g), F.lit(i))).otherwise("N")), "") for i in range(2)])


def homozygous_letters(codes: Column) -> Column:
    """An array of diploid codes as haploid calls: heterozygous ones become N."""
    return F.transform(codes, haploid_letter)


def as_phased(alleles: Column, sep: str = "/") -> Column:
    return F.array_join(F.transform(alleles, lambda a: F.coalesce(F.substring(F.lit("ACGT"), (a + 1).cast("int"), F.lit(1)), F.lit("N"))), sep)


def as_count(alleles: Column, base: Column) -> Column:
    """How many alleles are ``base``; -1 if one is missing."""
    return F.when(F.exists(alleles, lambda a: a.isNull()), -1).otherwise(F.size(F.filter(alleles, lambda a: a == base)))


def as_coded(alleles: Column, order: Column, sep: str = "/") -> Column:
    """Alleles as places in ``order`` (array of bases), missing as a dot."""
    return F.array_join(F.transform(alleles, lambda a: F.coalesce((F.array_position(order, a) - 1).cast("string"), F.lit("."))), sep)


def random_allele(alleles: Column, *key: str, seed: int = 0) -> Column:
    """One allele chosen by hash of (seed, key), the same however rows are partitioned."""
    return F.get(alleles, F.pmod(F.xxhash64(F.lit(seed), *key), F.size(alleles)).cast("int"))


def force_ploidy(alleles: Column, ploidy: int) -> Column:
    """Padded with null, or cut if all alleles are equal; else all null."""
    none = F.array_repeat(F.lit(None).cast("bigint"), ploidy)
    same = F.size(F.array_distinct(alleles)) == 1
    n = F.size(alleles)
    return F.when(n <= ploidy, F.slice(F.concat(alleles, none), 1, ploidy)).when(same, F.slice(alleles, 1, ploidy)).otherwise(none)


def partial_to_missing(alleles: Column) -> Column:
    return F.when(F.exists(alleles, lambda a: a.isNull()), F.transform(alleles, lambda a: F.lit(None).cast("bigint"))).otherwise(alleles)
